"""The index of a corpus: final entity records, and what it knows around a chunk.

A hot entity never meets one task whole: its mentions are counted or made distinct before they are numbered, and lists
are cut to their bound by a group limit before they are gathered. Around a chunk, claims and edges are not listed a
chunk: a chunk names its entities, and each entity brings its count and its first items, so the rows grow with
the names in the texts and not with their product with the claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vocabulary import ACRONYMS
from . import retrieval
from .graph import settle
from .joins import few

#: Equipment and instrument tags as texts write them (a fixed value).
NAME_PATTERN = r"\b[A-Z]{1,4}-?\d{2,5}[A-Z]?\b"
#: Longest key by which glossary terms and texts meet.
GRAM = 3
#: Up to so many rows with lists are broadcast.
BROADCAST_LISTS = 20_000


def first_items(rows: DataFrame, by: list[str], item: str, order: list[Column | str], most: int) -> DataFrame:
    """(by, n, items): how many distinct rows each ``by`` has, and the first ``most`` of their items in ``order``, all else left where it is.

    ``rows`` are distinct by ``by`` and ``item``. The count is a partial aggregate, the cut a group limit before the shuffle.
    """
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(*order, item)
    cut = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    listed = cut.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("__r", item))), lambda x: x[item]).alias("items"))
    return counted.join(listed, by)


def assemble_index(drafts: DataFrame, mentions: DataFrame, most_aliases: int = 40, most_pages: int = 200) -> DataFrame:
    """EXT13: (entity_uid, name, canonical_tag, entity_type, aliases, pages, mention_count): one record a draft.

    ``drafts``: entity_uid, canonical_tag, name, entity_type. ``mentions``: entity_uid, name, alias, page, place; any may be null.
    The name is the one with most votes, ties to the first by place, shown in title case where it has one case only, with
    the tag after it; without votes the tag or the draft's own name. Aliases are the first ``most_aliases`` in order, pages the
    first ``most_pages``; empty and null ones are left out. A draft without mentions has empty lists and 0 mentions.
    """
    votes = mentions.where("name <> ''").groupBy("entity_uid", "name").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    best = votes.groupBy("entity_uid").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("place").isNull(), "place", "name"))["name"].alias("__voted"))
    seen = mentions.groupBy("entity_uid").agg(F.count(F.lit(1)).alias("__mentions"))
    lists = [
        first_items(mentions.select("entity_uid", c).where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).distinct(), ["entity_uid"], c, [], most).select("entity_uid", F.col("items").alias(f"__{c}"))
        for c, most in (("alias", most_aliases), ("page", most_pages))
    ]
    out = drafts.select("entity_uid", "canonical_tag", "name", "entity_type")
    for more in (best, seen, *lists):
        out = out.join(more, "entity_uid", "left")
    tag = F.when(F.col("canonical_tag") != "", F.col("canonical_tag"))
    shown = text.display_name("__voted", ACRONYMS)
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select(
        "entity_uid", F.when(F.col("__voted").isNull(), F.coalesce(tag, "name")).when(tag.isNotNull(), F.concat(shown, F.lit(" ("), tag, F.lit(")"))).otherwise(shown).alias("name"),
        "canonical_tag", "entity_type", empty("__alias").alias("aliases"), empty("__page").alias("pages"), F.coalesce("__mentions", F.lit(0)).alias("mention_count"),
    )


def nearest_chunks(vectors: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """GRA11: (chunk_id, near, score, rank): the ``k`` other vectors (chunk_id, embedding) with the largest products with each of ``asked`` (the same columns), ties by id.

    A vector equal to the asked one under another id counts; null vectors and those with null components take no part.
    """
    ranked = retrieval.vector_top_k(vectors, asked.select(F.col("chunk_id").alias("request_id"), F.col("embedding").alias("q")), k + 1, "chunk_id")
    w = Window.partitionBy("request_id").orderBy("rank")
    others = ranked.where("request_id <> chunk_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return others.select(F.col("request_id").alias("chunk_id"), F.col("chunk_id").alias("near"), "score", "rank")


def listed(rows: DataFrame) -> DataFrame:
    """``rows`` of lists, made once; broadcast if they are few, else joined by sorting: what tables' sizes let the planner guess of them is far too small."""
    made = settle(rows)
    return F.broadcast(made) if made.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS else made.hint("merge")


def names_in(c: Column | str, most: int = 30) -> Column:
    """GRA11: the first ``most`` distinct tags of a text, in its order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text.text_of(c), F.lit(NAME_PATTERN), F.lit(0))), 1, most)


def terms_in(chunks: DataFrame, glossary: DataFrame, most: int = 15) -> DataFrame:
    """GRA11: (chunk_id, term, meaning): the first ``most`` terms by place whose letters, in any case, stand in a chunk's text.

    Terms and texts meet by the term's first three characters, so no text is compared with all terms; a table of terms that is
    small enough is broadcast. Of equal terms the first by place counts.
    """
    terms = glossary.where("term <> ''").groupBy(F.upper("term").alias("__t")).agg(F.min(F.struct("place", "term", "meaning")).alias("g"))
    known = few(terms.select("__t", "g", F.substring("__t", 1, GRAM).alias("__k")))
    body = chunks.select("chunk_id", F.upper(text.text_of("text")).alias("__b"))
    starts = F.when(F.length("__b") > 0, F.sequence(F.lit(1), F.length("__b")))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.col("__b").substr(i, n)))))
    met = body.withColumn("__k", F.explode(grams)).join(known, "__k").where(F.contains("__b", "__t"))
    w = Window.partitionBy("chunk_id").orderBy("g.place", "g.term")
    return met.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).select("chunk_id", "g.term", "g.meaning")


def context_facets(chunks: DataFrame, entities: DataFrame, aliases: DataFrame, claims: DataFrame, relations: DataFrame, glossary: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """GRA11: (chunk_id, facet, via, n, items): what is known around each chunk, one long table.

    ``chunks``: chunk_id, text, section_path. ``entities``: entity_uid, canonical_tag, name, section. ``aliases``: entity_uid, alias.
    ``claims``: claim_id, entity_uid, confidence. ``relations``: source_uid, rel_type, target_uid. ``glossary``: term, meaning, place.
    ``similar``: (chunk_id, near, rank), the nearest other chunks, if vectors are at hand.

    name: the chunk's tags. entity: the first 40 entities whose name or alias is the tag in any case. claim, relation, related: by such entity, the first 20
    claims by confidence, 20 edges, 15 neighbours one edge away. section: 20 entities of the chunk's section. glossary: 15 terms.
    identity: 40 entities whose canonical tag, name or alias is it. similar: in order of nearness. ``n`` counts all, also
    those not listed. Null or empty texts and sections give nothing; of rows that share a chunk_id the last by text counts.
    """
    own = chunks.groupBy("chunk_id").agg(F.max(F.struct("text", "section_path")).alias("c")).select("chunk_id", "c.text", "c.section_path")
    named = settle(own.select("chunk_id", F.posexplode(names_in("text")).alias("pos", "via")))
    names = named.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_set(F.struct("pos", "via"))), lambda x: x["via"]).alias("items"))
    row = lambda df, facet, via: df.select("chunk_id", F.lit(facet).alias("facet"), (F.col(via) if via else F.lit("")).alias("via"), F.col("n").cast("long").alias("n"), F.col("items").cast("array<string>").alias("items"))

    said = entities.select("entity_uid", F.col("name").alias("key")).union(aliases.select("entity_uid", "alias")).where("key <> ''")
    keys = settle(named.select(F.lower("via").alias("key")).distinct())
    of_keys = lambda df: df.select("entity_uid", F.lower("key").alias("key")).join(few(keys), "key", "left_semi").distinct()
    called = listed(first_items(of_keys(said), ["key"], "entity_uid", [], 40))
    reached = few(settle(called.select(F.explode("items").alias("entity_uid")).distinct()))  # no other entity brings lists
    loose = of_keys(said.union(entities.select("entity_uid", "canonical_tag")).where("key <> ''"))
    known = listed(first_items(loose, ["key"], "entity_uid", [], 40))
    of_name = lambda found: named.select("chunk_id", "via", F.lower("via").alias("key")).join(found, "key")
    met = of_name(called).select("chunk_id", F.explode("items").alias("entity_uid")).distinct()

    met_by = lambda df: df.join(reached, "entity_uid", "left_semi")
    told = listed(first_items(met_by(claims.select("entity_uid", "claim_id", "confidence")).dropDuplicates(["entity_uid", "claim_id"]), ["entity_uid"], "claim_id", [F.desc("confidence")], 20))
    edge = F.concat_ws(">", "source_uid", "rel_type", "target_uid")
    ends = relations.select(F.explode(F.array_distinct(F.array(F.struct(F.col("source_uid").alias("a"), F.col("target_uid").alias("b")), F.struct(F.col("target_uid").alias("a"), F.col("source_uid").alias("b"))))).alias("e"), edge.alias("edge"))
    sides = ends.where("e.a is not null and e.b is not null").select(F.col("e.a").alias("entity_uid"), F.col("e.b").alias("other"), "edge")
    edges = listed(first_items(met_by(sides).select("entity_uid", "edge").distinct(), ["entity_uid"], "edge", [], 20))
    related = listed(first_items(met_by(sides.where("entity_uid <> other")).select("entity_uid", "other").distinct(), ["entity_uid"], "other", [], 15))
    placed = listed(first_items(entities.where("section <> ''").select("section", "entity_uid").distinct(), ["section"], "entity_uid", [], 20))
    out = [
        row(names, "name", None), row(of_name(called), "entity", "via"), row(of_name(known), "identity", "via"),
        *[row(met.join(found, "entity_uid"), facet, "entity_uid") for facet, found in (("claim", told), ("relation", edges), ("related", related))],
        row(own.select("chunk_id", F.col("section_path").alias("section")).join(placed, "section"), "section", "section"),
        row(terms_in(own, glossary).select("chunk_id", "term", F.lit(1).alias("n"), F.array("meaning").alias("items")), "glossary", "term"),
    ]
    if similar is not None:
        near = similar.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_set(F.struct("rank", "near"))), lambda x: x["near"]).alias("items"))
        out.append(row(near, "similar", None))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
