"""Entities: types, merging, subjects of claims, relations that texts imply, and rules that relations keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import claim_rules, text
from ..functions.tags import find_tags, parse_tag
from ..functions.vocabulary import IMPOSSIBLE_RELATIONS, SUSPICIOUS_RELATIONS

# Types that are one class when names and tags are merged.
TYPE_GROUPS = {
    "Column": "column", "Stripper": "column", "Vessel": "vessel", "Drum": "vessel", "Desalter": "vessel", "Separator": "vessel", "Tank": "tank", "Heater": "heater", "Pump": "pump", "Exchanger": "exchanger",
    "Cooler": "exchanger", "Condenser": "exchanger", "Reboiler": "exchanger", "Compressor": "compressor", "Ejector": "ejector", "Filter": "filter", "AirCooler": "exchanger", "Blower": "fan",
}
# Types that say nothing and give way to others.
UNKNOWN_TYPES = ("unknown", "other", "generic")


def infer_type(tag: Column | str, name: Column | str) -> Column:
    """EXT10: by the tag's prefix, else by the words of the name."""
    return F.coalesce(claim_rules.type_of_prefix(parse_tag(tag)["prefix"]), claim_rules.type_of_name(name))


def group_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_GROUPS.items() for x in p]), kind)


def merge_named(entities: DataFrame, aliases: DataFrame, dominance: int = 3) -> DataFrame:
    """EXT11: (uid, target_uid, how) of entities without tag that are merged into tagged ones.

    ``entities``: uid, name, canonical_tag, entity_type, mention_count. ``aliases``: uid, alias. First by name: its only
    tagged owner, or one mentioned at least ``dominance`` times and so many times as often as the next. Then by tail: the
    one tagged entity that has an alias ending in the name, of two words or more, unless the types are of other classes.
    Owners are counted by windows over alias keys, never paired.
    """
    named = entities.where("canonical_tag is null").select(F.col("uid").alias("named"), text.norm_alias("name").alias("key"), F.col("entity_type").alias("named_type"))
    owners = entities.where("canonical_tag is not null").select(F.col("uid").alias("owner"), "entity_type", "mention_count")
    held = aliases.join(owners, F.col("uid") == F.col("owner")).select("owner", "entity_type", "mention_count", text.norm_alias("alias").alias("key")).dropDuplicates(["owner", "key"])
    by_count = Window.partitionBy("key").orderBy(F.desc("mention_count"), "owner")
    best = held.withColumn("next", F.lead("mention_count").over(by_count)).withColumn("r", F.row_number().over(by_count)).where("r = 1")
    clear = best.where(F.col("next").isNull() | ((F.col("mention_count") >= dominance) & (F.col("mention_count") >= dominance * F.greatest("next", F.lit(1)))))
    first = named.join(clear.select("key", F.col("owner").alias("target_uid")), "key").select(F.col("named").alias("uid"), "target_uid", F.lit("name").alias("how"))
    words = F.split("key", " ")
    tails = held.withColumn("tail", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words) - 1)), lambda n: F.when(n < F.size(words), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ")))))
    alone = tails.where("tail is not null").groupBy("tail").agg(F.countDistinct("owner").alias("n"), F.min("owner").alias("target_uid"), F.min("entity_type").alias("entity_type")).where("n = 1")
    rest = named.join(first.select(F.col("uid").alias("named")), "named", "left_anti").join(alone, F.col("key") == F.col("tail"))
    fits = F.coalesce(group_of(F.col("named_type")) == group_of(F.col("entity_type")), F.lit(True))
    return first.unionByName(rest.where(fits).select(F.col("named").alias("uid"), "target_uid", F.lit("tail").alias("how")))


def redirect(rows: DataFrame, redirects: DataFrame, uid: str = "uid") -> DataFrame:
    """JOI3: ``rows`` with ``uid`` replaced by its target, where it has one; of several targets of one uid, the smallest."""
    to = redirects.groupBy(F.col("uid").alias("__from")).agg(F.min("target_uid").alias("__to"))
    joined = rows.join(to, F.col(uid) == F.col("__from"), "left")
    return joined.select(*[F.coalesce("__to", uid).alias(uid) if c == uid else F.col(c) for c in rows.columns])


def resolve_subjects(claims: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """EXT12: ``claims`` (subject, document_id, ...) with ``subject_uid`` and ``resolved``: by tag, by alias (the smallest owner), or a new named entity of the document."""
    keyed = claims.withColumn("__tag", parse_tag("subject")["canonical"]).withColumn("__key", text.norm_alias("subject"))
    owners = aliases.groupBy(text.norm_alias("alias").alias("__alias")).agg(F.min("uid").alias("__owner"))
    tagged = entities.where("canonical_tag is not null").groupBy(F.col("canonical_tag").alias("__canonical")).agg(F.min("uid").alias("__known"))
    met = keyed.join(tagged, F.col("__tag") == F.col("__canonical"), "left").join(owners, F.col("__tag").isNull() & (F.col("__key") == F.col("__alias")), "left")
    how = F.when(F.col("__tag").isNotNull(), F.when(F.col("__known").isNotNull(), "tag").otherwise("new tag")).when(F.col("__owner").isNotNull(), "alias").otherwise("new name")
    uid = F.coalesce("__known", F.when(F.col("__tag").isNotNull(), text.entity_uid("__tag")), "__owner", text.scoped_uid("__key", "document_id"))
    return met.select(*claims.columns, uid.alias("subject_uid"), how.alias("resolved"))


def co_mentions(sentences: DataFrame, most: int = 400, near: int = 160) -> DataFrame:
    """EXT6: (source_tag, target_tag, rel_type, confidence) of instruments and equipment named in one sentence, each triple once.

    ``sentences``: chunk_id, sentence. Sentences are at most ``most`` long, the two stand within ``near`` characters, and
    both plants agree where both tags carry one. Pairs are made within a sentence, so nothing is joined.
    """
    s = F.col("sentence")
    parsed = F.transform(find_tags(s), lambda x: F.struct(x.alias("tag"), parse_tag(x).alias("p")))  # once a tag
    part = lambda x: F.struct(x["tag"].alias("tag"), x["p"]["prefix"].alias("prefix"), x["p"]["plant"].alias("plant"), claim_rules.type_of_prefix(x["p"]["prefix"]).alias("kind"), F.position(F.element_at(F.split(x["tag"], "-"), -1), s).alias("at"))
    found = sentences.where((F.length(s) <= most) & s.rlike(r"\d.*\d")).withColumn("__tags", F.transform(parsed, part)).where(F.size("__tags") >= 2)
    acts = lambda x: x["kind"].isin(*claim_rules.INSTRUMENTS)
    one = found.select("__tags", F.explode(F.filter("__tags", acts)).alias("i"))
    both = one.select("i", F.explode(F.filter("__tags", lambda x: ~acts(x))).alias("e"))
    apart = F.coalesce(F.col("i.plant") != F.col("e.plant"), F.lit(False))
    rel = F.when(claim_rules.is_control(F.col("i.prefix"), F.col("i.kind")), "CONTROLS").otherwise("MONITORS")
    kept = both.where(~apart & (F.col("i.at") > 0) & (F.col("e.at") > 0) & (F.abs(F.col("i.at") - F.col("e.at")) <= near))
    return kept.select(F.col("i.tag").alias("source_tag"), F.col("e.tag").alias("target_tag"), rel.alias("rel_type"), F.lit(0.5).alias("confidence")).distinct()


def description_relations(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """EXT7: (source_uid, target_uid, rel_type, confidence): equipment that an instrument's description names, by tag or by an alias of two to four words.

    ``entities``: uid, canonical_tag, entity_type, description. ``aliases``: uid, alias.
    """
    own = parse_tag("canonical_tag")
    told = entities.where(F.col("entity_type").isin(*claim_rules.INSTRUMENTS) & F.col("description").isNotNull()).withColumn("rel_type", F.when(claim_rules.is_control(own["prefix"], F.col("entity_type")), "CONTROLS").otherwise("MONITORS"))
    equipment = entities.where(~F.coalesce(F.col("entity_type"), F.lit("")).isin(*claim_rules.INSTRUMENTS)).select(F.col("uid").alias("target_uid"), F.col("canonical_tag").alias("__tag"))
    by_tag = told.select("uid", "rel_type", F.explode(find_tags("description")).alias("__named")).join(equipment, F.col("__named") == F.col("__tag")).select("uid", "rel_type", "target_uid")
    words = F.split(text.norm_alias("description"), " ")
    phrases = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    keys = aliases.join(equipment.select("target_uid"), F.col("uid") == F.col("target_uid")).select("target_uid", text.norm_alias("alias").alias("__key")).where(F.size(F.split("__key", " ")).between(2, 4)).distinct()
    by_name = told.select("uid", "rel_type", F.explode(F.array_distinct(F.transform(phrases, text.norm_alias))).alias("__key")).join(keys, "__key").select("uid", "rel_type", "target_uid")
    both = by_tag.unionByName(by_name).where("uid <> target_uid").distinct()
    return both.select(F.col("uid").alias("source_uid"), "target_uid", "rel_type", F.lit(0.85).alias("confidence"))


def relation_rules(relations: DataFrame, subject_type: str = "subject_type", rel_type: str = "rel_type") -> DataFrame:
    """VAL4: ``verdict`` of each relation: ERROR for a type that cannot have it, WARNING for one that seldom has, else OK. Unknown types are OK."""
    key = F.concat_ws(" ", F.lower(F.col(subject_type)), F.upper(F.col(rel_type)))
    listed = lambda pairs: key.isin(*[" ".join(p) for p in pairs])
    return relations.withColumn("verdict", F.when(listed(IMPOSSIBLE_RELATIONS), "ERROR").when(listed(SUSPICIOUS_RELATIONS), "WARNING").otherwise("OK"))


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """GRA8: one row a uid out of mentions (uid, seq, name, aliases, entity_type, document_id, confidence, evidence), in the order of seq.

    Mentions are counted; documents and aliases (also the other names) are united; the first name stays; a type only
    replaces an unknown one; the highest confidence and the first evidence stay.
    """
    known = F.when(~F.coalesce(F.lower("entity_type"), F.lit("unknown")).isin(*UNKNOWN_TYPES), F.struct("seq", "entity_type"))
    told = F.when(F.coalesce("evidence", F.lit("")) != "", F.struct("seq", "evidence"))
    out = mentions.groupBy("uid").agg(
        F.min(F.struct("seq", "name"))["name"].alias("name"),
        F.coalesce(F.min(known)["entity_type"], F.min(F.struct("seq", "entity_type"))["entity_type"]).alias("entity_type"), F.array_sort(F.collect_set("document_id")).alias("document_ids"),
        F.max("confidence").alias("confidence"), F.min(told)["evidence"].alias("evidence"), F.count(F.lit(1)).alias("mention_count"),
    )
    names = mentions.select(F.col("uid").alias("__uid"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("__a")).distinct()  # before any list is made
    listed = names.groupBy("__uid").agg(F.array_sort(F.collect_set("__a")).alias("aliases"))
    united = out.join(listed, F.col("uid").eqNullSafe(F.col("__uid")), "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return united.select("uid", "name", F.filter("aliases", lambda a: (a != "") & (a != F.col("name"))).alias("aliases"), "entity_type", "document_ids", "confidence", "evidence", "mention_count")


def schema_issues(entities: DataFrame) -> DataFrame:
    """VAL5: ``severity``: ERROR without a name, WARN without a type, else OK."""
    return entities.withColumn("severity", F.when(F.trim(text.text_of("name")) == "", "ERROR").when(F.col("entity_type").isNull(), "WARN").otherwise("OK"))


def plant_items(entities: DataFrame, tagged_only: bool = True, min_mentions: int = 0, types: list[str] | None = None) -> DataFrame:
    """FLT12: entities whose tag carries a plant number, or any if not ``tagged_only``, often enough and of the types asked for."""
    out = entities.where(F.col("mention_count") >= min_mentions)
    if tagged_only:
        out = out.where(parse_tag("canonical_tag")["plant"].isNotNull())
    return out.where(F.col("entity_type").isin(*types)) if types else out


def type_counts(entities: DataFrame, min_mentions: int = 0) -> DataFrame:
    """AGG1: entities and mentions by type; those without one are Unclassified."""
    return entities.where(F.col("mention_count") >= min_mentions).groupBy(F.coalesce("entity_type", F.lit("Unclassified")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").cast("long").alias("mentions"))


def inventory(entities: DataFrame, limit: int = 500) -> DataFrame:
    """WIN9: the most mentioned entities with their place; the limit comes first, so only these are numbered."""
    top = entities.orderBy(F.desc("mention_count"), F.coalesce("canonical_tag", "name"), "entity_uid").limit(limit)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("mention_count"), F.coalesce("canonical_tag", "name"), "entity_uid")))


def soft_inventory(entities: DataFrame, strict: Column, least: int = 5, by: str = "entity_type") -> DataFrame:
    """QRY2: of each type the entities that meet ``strict``; all of them where fewer than ``least`` do."""
    counted = entities.withColumn("__s", strict).withColumn("__n", F.sum(F.col("__s").cast("int")).over(Window.partitionBy(by)))
    return counted.where(F.col("__s") | (F.col("__n") < least)).drop("__s", "__n")


def train_pairs(tags: Column | str) -> Column:
    """GRA7: array of struct(parent, child): the trains that a tag names ('12-P-04 A/B'), or the parent of a train ('12-P-04A')."""
    p = parse_tag(tags)
    return F.when(F.size(p["children"]) > 0, F.transform(p["children"], lambda c: F.struct(p["canonical"].alias("parent"), c.alias("child")))).when(p["parent"].isNotNull(), F.array(F.struct(p["parent"].alias("parent"), p["canonical"].alias("child")))).otherwise(F.array().cast("array<struct<parent:string,child:string>>"))


def expand_trains(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """JOI2: (canonical_tag, claim_id): an item's own claims and those of its trains. The train's tag is parsed and cut to its item once, so the join is an equi-join."""
    both = lambda p: F.array_distinct(F.array(F.coalesce(p["canonical"], F.col("subject")), F.coalesce(p["parent"], p["canonical"], F.col("subject"))))
    keyed = claims.select("claim_id", F.explode(F.flatten(F.transform(F.array(parse_tag("subject")), both))).alias("__t"))
    return entities.select("canonical_tag").distinct().join(keyed, F.col("canonical_tag") == F.col("__t")).select("canonical_tag", "claim_id").distinct()
