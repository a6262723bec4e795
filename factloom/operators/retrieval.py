"""Keyword, vector and fused retrieval over many requests at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import phrases, text
from .graph import settle
from .joins import dealt, few

#: Bytes of double-precision components in a block of vectors.
BLOCK_BYTES = 8 << 20


def bm25(chunks: DataFrame, requests: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, key: str = "chunk_id", of: str = "text") -> DataFrame:
    """WIN1: (request_id, key, score, rank): Okapi BM25 of chunks (key, of) for requests (request_id, text), positive scores, ties by key.

    Chunks are dealt over tasks and tokenized once; only the requests' own tokens, and one empty token a chunk that carries its length, leave
    the scan. Negative inverse frequencies are raised to ``epsilon`` times the mean over the requests' tokens.
    """
    asked = requests.select("request_id", F.explode(F.array_distinct(text.tokenize("text"))).alias("token"))
    wanted = few(asked.select("token").union(requests.sparkSession.range(1).select(F.lit("").alias("token"))).distinct())
    sized = dealt(chunks.select(key, of), key).select(key, text.tokenize(of).alias("t")).select(key, F.size("t").alias("length"), F.when(F.size("t") > 0, F.concat("t", F.array(F.lit("")))).alias("t"))
    tokens = sized.select(key, "length", F.explode("t").alias("token"))  # the length first, else every token's row carries all tokens
    hits = settle(tokens.join(wanted, "token", "left_semi").groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("tf")))  # read for three sums
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.avg("length").alias("mean"))
    totals = df.where("token = ''").select(F.col("df").alias("n"), F.col("mean").alias("mean_length"))
    idf = df.where("token <> ''").crossJoin(F.broadcast(totals)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # totals: one row
    floor = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    idf = idf.crossJoin(F.broadcast(floor)).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).select("token", "idf", "mean_length")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = hits.join(few(idf), "token").withColumn("part", part).join(asked, "token").groupBy("request_id", key).agg(F.sum("part").alias("score")).where("score > 0")
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """WIN2: (request_id, key, score, rank): exact dot products of all vectors (key, embedding) with all query vectors (request_id, q), best k each, ties by key.

    Vectors and queries are dealt into blocks of bounded bytes; a block of scores is one matrix product, and only its k best
    a query leave it. Null vectors and those with null components take no part; vectors meet those of their length.
    """
    ids = {"request_id": queries.schema["request_id"].dataType.simpleString(), key: vectors.schema[key].dataType.simpleString()}
    sound = lambda df, own, v: df.select(F.col(own), F.col(v).cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null)").withColumn("d", F.size("v"))
    stored, asked = sound(vectors, key, "embedding"), sound(queries, "request_id", "q")
    blocks = lambda df: max(1, -(-(df.agg(F.sum("d")).first()[0] or 0) * 8 // BLOCK_BYTES))
    parts, asks = blocks(stored), blocks(asked)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda own, n: F.pmod(F.xxhash64(own), F.lit(n)).cast("int")
    left = stored.withColumn("part", block(key, parts)).withColumn("ask", numbers(asks))
    right = asked.withColumn("ask", block("request_id", asks)).withColumn("part", numbers(parts))

    def best(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(some):
            x, own = np.stack(rows.v.to_numpy()), rows[key].to_numpy()
            for at in range(0, len(some), 256):
                part = some.iloc[at : at + 256]
                q = np.stack(part.v.to_numpy())
                for request, v, near in zip(part.request_id, q, q @ x.T):
                    least = np.partition(near, -k)[-k] if len(near) > k else -np.inf
                    close = np.flatnonzero(near >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.arange(len(near))
                    exact = (x[close] * v).sum(1)  # in one order of additions, whatever the block
                    first = np.lexsort((own[close], -exact))[:k]
                    found.append(pd.DataFrame({"request_id": request, key: own[close][first], "score": exact[first]}))
        return pd.concat(found) if found else pd.DataFrame({"request_id": some.request_id[:0], key: rows[key][:0], "score": np.empty(0)})

    met = left.groupBy("d", "part", "ask").cogroup(right.groupBy("d", "part", "ask")).applyInPandas(best, ", ".join([*(f"`{n}` {t}" for n, t in ids.items()), "score double"]))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), key)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(ranked: list[DataFrame], k: int, anchors: DataFrame | None = None, constant: int = 60, key: str = "chunk_id") -> DataFrame:
    """WIN3: reciprocal rank fusion of (request_id, key, rank from 1), counted from 0; anchored keys gain one share, or half if not ranked."""
    parts = [r.select("request_id", key, (1.0 / (constant - 1 + F.col("rank"))).alias("part"), F.lit(1).alias("ranked")) for r in ranked]
    if anchors is not None:
        parts.append(anchors.select("request_id", key, F.lit(0.0).alias("part"), F.lit(0).alias("ranked")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    summed = both.groupBy("request_id", key).agg(F.sum("part").alias("part"), F.max("ranked").alias("ranked"), F.min("ranked").alias("least"))
    bonus = F.when(F.col("least") == 0, F.when(F.col("ranked") == 1, 1.0 / constant).otherwise(0.5 / constant)).otherwise(0.0)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), key)
    return summed.select("request_id", key, (F.col("part") + bonus).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def embed(rows: DataFrame, key: str, of: str, dimension: int = 64) -> DataFrame:
    """STC22: (key, embedding): a deterministic embedding where no model is at hand, signed hashed token counts of length one.

    Keys are unique: a row's tokens are counted where the row lies, so only texts are dealt over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                n, lists = len(part), part.column("h")
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                counts = np.bincount(row * 2 * dimension + lists.flatten().to_numpy(zero_copy_only=False), minlength=n * 2 * dimension).reshape(n, 2 * dimension)
                v = (counts[:, :dimension] - counts[:, dimension:]).astype(float)
                norm = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(np.arange(0, n * dimension + 1, dimension, dtype=np.int32), v.ravel())], [key, "embedding"])

    hashed = dealt(rows.select(key, of), key).select(key, F.transform(text.tokenize(of), lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dimension)).cast("int")).alias("h"))
    return hashed.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def hybrid(chunks: DataFrame, requests: DataFrame, k: int, key: str, of: str, depth: int = 24, anchors: DataFrame | None = None) -> DataFrame:
    """QRY18: (request_id, key, score, rank): keyword and vector rankings of the ``depth`` best, fused; both sides embedded alike."""
    words = bm25(chunks, requests, depth, key=key, of=of)
    vectors = settle(embed(chunks, key, of))  # they are counted before they are dealt
    asked = embed(requests.select(F.col("request_id"), F.col("text")), "request_id", "text").select("request_id", F.col("embedding").alias("q"))
    near = vector_top_k(vectors, asked, depth, key).where("score > 0")
    return fuse([words.select("request_id", key, "rank"), near.select("request_id", key, "rank")], k, anchors, key=key)


def search_names(requests: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """WIN6: (request_id, entity_uid, score, rank): the share of a request's words (request_id, text) in an entity's name, in millionths, and its mentions.

    Equal sets of words score alike: of the entities with one set only the ``most`` most mentioned can be among the best of
    any request, so sets meet by word instead of rows, and equal requests are ranked once.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("token")
    asked = requests.select("request_id", words("text")).groupBy("request_id").agg(F.array_sort(F.collect_set("token")).alias("x"))
    known = entities.select("entity_uid", "mention_count", words("name")).distinct().groupBy("entity_uid").agg(F.array_sort(F.collect_list("token")).alias("y"), F.max(F.least("mention_count", F.lit(50))).alias("m"))
    first = Window.partitionBy("y").orderBy(F.desc("m"), "entity_uid")
    kept = settle(known.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most).drop("__r"))
    sets = kept.select("y").distinct().select("y", F.explode("y").alias("token"))
    shared = asked.select("x").distinct().select("x", F.explode("x").alias("token")).join(sets, "token").groupBy("x", "y").agg(F.count(F.lit(1)).alias("common"))
    scored = shared.join(kept, "y").select("x", "entity_uid", (F.floor(F.col("common") * 1000000 / F.size("x")) + F.col("m") * 2000).cast("long").alias("score"))
    w = Window.partitionBy("x").orderBy(F.desc("score"), "entity_uid")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return asked.join(best, "x").select("request_id", "entity_uid", "score", "rank")


def score_procedures(procedures: DataFrame, requests: DataFrame, most: int = 3) -> DataFrame:
    """WIN7: (request_id, procedure_id, score, rank): procedures that apply to a request's entity or name it in steps, by how well they fit.

    ``procedures``: procedure_id, procedure_type, applies_to, step_tags, head_tokens, step_tokens (arrays), page.
    ``requests``: request_id, entity, procedure_type, tokens. 2 for the entity, 1 and a fifth of up to five steps that name
    it; 4 for the type, a fifth of 1 for a request without one, less 1 for another; 1.2 and 0.5 times the shares of the
    request's tokens in head and steps. Candidates meet by entity, so nothing is compared with all. Of procedures that are alike to an
    entity, in type, words and steps, only the first ``most`` by page can be among the best; they are cut before they meet a request, and equal requests are ranked once.
    """
    kind = ["__e", "__pt", "__applies", "__steps", "__head", "__words"]
    plain = lambda c: F.array_sort(F.array_distinct(c)).alias
    named = procedures.withColumn("__e", F.explode(F.array_distinct(F.concat("applies_to", "step_tags")))).select(
        "procedure_id", "page", "__e", F.col("procedure_type").alias("__pt"), F.array_contains("applies_to", F.col("__e")).alias("__applies"),
        F.least(F.size(F.filter("step_tags", lambda x: x == F.col("__e"))), F.lit(5)).alias("__steps"), plain("head_tokens")("__head"), plain("step_tokens")("__words"))
    first = named.withColumn("__r", F.row_number().over(Window.partitionBy(*kind).orderBy("page", "procedure_id"))).where(F.col("__r") <= most).drop("__r")
    asked = requests.select("entity", F.col("procedure_type").alias("__rt"), "tokens")
    met = asked.distinct().join(first, F.col("entity") == F.col("__e"))
    share = lambda c: F.size(F.array_intersect("tokens", c)) / F.greatest(F.size("tokens"), F.lit(1))
    score = (
        F.when(F.col("__applies"), 2.0).otherwise(0.0) + F.when(F.col("__steps") > 0, 1 + 0.2 * F.col("__steps")).otherwise(0.0)
        + F.when(F.col("__rt").isNull(), 0.2).when(F.col("__rt") == F.col("__pt"), 4.0).otherwise(-1.0) + 1.2 * share("__head") + 0.5 * share("__words")
    )
    w = Window.partitionBy("entity", "__rt", "tokens").orderBy(F.desc("score"), "page", "procedure_id")
    best = met.withColumn("score", F.round(score, 4)).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*[F.col(c).alias(f"__{c}") for c in asked.columns], "procedure_id", "score", "rank")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked.columns]
    return requests.select("request_id", *[F.col(c) for c in ("entity", "tokens")], F.col("procedure_type").alias("__rt")).join(best, same).select("request_id", "procedure_id", "score", "rank")


def near_best(rows: DataFrame, by: str, score: str, percent: int = 60) -> DataFrame:
    """WIN11: the rows of each ``by`` that score at least ``percent`` of its best."""
    best = rows.groupBy(by).agg(F.max(score).alias("__best"))
    return rows.join(best, by).where(F.col(score) * 100 >= F.col("__best") * percent).drop("__best")


def rerank_upsets(chunks: DataFrame, keywords: list[str], synonyms: list[str], symptom: str, class_word: str, chapters: list[int], limit: int = 5) -> DataFrame:
    """WIN12: (chunk_id, score): chunks (chunk_id, chunk_type, chapter, section_path, text, score) by their score and what speaks for an upset.

    0.5 for an upset section, 0.3 for its chapters, 0.6 for a keyword in the text, 0.8 for one in the path or the class of
    equipment in its last part, 0.4 for a synonym of the symptom, 0.2 for the symptom. Ties go to the smaller id.
    """
    low, head = F.lower(text.text_of("text")), F.lower(text.text_of("section_path"))
    some = lambda c, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(c, w)) if words else F.lit(False)
    boost = lambda c, n: F.when(c, n).otherwise(0.0)
    score = (
        F.col("score") + boost(F.col("chunk_type") == "upset", 0.5) + boost(F.col("chapter").isin(*chapters), 0.3) + boost(some(low, keywords), 0.6)
        + boost(some(head, keywords) | F.substring_index(head, " > ", -1).contains(class_word.lower()), 0.8) + boost(some(low, synonyms), 0.4) + boost(low.contains(symptom.lower()), 0.2)
    )
    return chunks.select("chunk_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def route(models: DataFrame, resident: DataFrame, by: str, margin: float) -> DataFrame:
    """WIN13: (by, model): the best model (by, model, score) of each kind, but the resident one (by, resident) while it is less than ``margin`` behind. Ties go to the smaller name."""
    best = models.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("model").alias("m"))).alias("b")).select(by, F.col("b.m").alias("__best"), (-F.col("b.s")).alias("__top"))
    held = models.join(resident, [by]).where("model = resident").select(by, F.col("model").alias("__held"), F.col("score").alias("__own"))
    return best.join(held, by, "left").select(by, F.when(F.col("__top") - F.col("__own") < margin, F.col("__held")).otherwise(F.col("__best")).alias("model"))


def glossary_search(entries: DataFrame, term: str, least: int = 3) -> DataFrame:
    """FLT17: entries whose term is ``term``, or whose meaning contains it if it is longer than ``least``."""
    hit = F.lower("term") == term.lower()
    return entries.where(hit | F.lower("meaning").contains(term.lower())) if len(term) > least else entries.where(hit)


def precautions(rows: DataFrame, severity, order: list[str], most: int = 10) -> DataFrame:
    """QRY9: the first ``most`` rows of each severity, info left out."""
    w = Window.partitionBy("severity").orderBy(*order)
    return rows.withColumn("severity", severity).where("severity <> 'info'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def search_chunks(ranked: dict[str, DataFrame], requests: DataFrame, chunks: DataFrame, k: int = 8, anchors: DataFrame | None = None, constant: int = 60, key: str = "chunk_id") -> DataFrame:
    """WIN3: (request_id, key, score, rank, reasons, soft): fused rankings, filtered after pooling, short ones refilled past their chapters.

    ``ranked``: (request_id, key, rank) by reason, each at most ``depth(k)`` deep. ``requests``: request_id and the arrays chunk_types,
    chapters, document_ids; a null or empty one does not filter. ``chunks``: key, chunk_type, chapter, document_id. A request with fewer
    than ``k`` chunks in its chapters gets others of its types and documents after them (``soft``): documents always
    filter, since access may hang on them. Equal scores go to the smaller key; a null type, chapter or document meets no filter.
    """
    fused = fuse(list(ranked.values()), 2**31 - 1, anchors, constant, key).drop("rank")
    told = [df.select("request_id", key, F.lit(name).alias("__why")) for name, df in ranked.items()] + ([anchors.select("request_id", key, F.lit("entity").alias("__why"))] if anchors is not None else [])
    why = told[0]
    for more in told[1:]:
        why = why.unionByName(more)
    reasons = why.groupBy("request_id", key).agg(F.array_join(F.array_sort(F.collect_set("__why")), "+").alias("reasons"))
    asked = requests.select("request_id", "chunk_types", "chapters", "document_ids")
    met = fused.join(reasons, ["request_id", key]).join(chunks.select(key, "chunk_type", "chapter", "document_id"), key).join(asked, "request_id")
    free = lambda wanted: F.coalesce(F.size(wanted), F.lit(0)) <= 0
    holds = lambda wanted, own: free(wanted) | F.coalesce(F.array_contains(wanted, F.col(own)), F.lit(False))
    sound = met.where(holds("chunk_types", "chunk_type") & holds("document_ids", "document_id")).withColumn("soft", ~holds("chapters", "chapter"))
    w = Window.partitionBy("request_id").orderBy("soft", F.desc(F.round("score", 12)), key)
    return sound.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("request_id", key, F.round("score", 4).alias("score"), "rank", "reasons", "soft")


def depth(k: int) -> int:
    """WIN3: how deep rankings are pooled for ``k`` results."""
    return max(4 * k, 24)


#: Words of reasons and purposes (fixed values).
WHY_WORDS = ("because", "in order to", "so that", "to prevent", "to avoid", "purpose", "to ensure", "this is done", "is used to", "is provided to", "helps", "improves", "otherwise")
#: Modes of explanation: how many passages, of which types and chapters (fixed values).
MODES = {"why": (5, ("narrative", "equipment", "control", "safety"), ()), "consequences": (4, ("safety", "narrative", "table", "control", "upset"), (14, 17, 18)), "support": (4, (), ())}


def explanations(chunks: DataFrame, requests: DataFrame, mode: str = "why", anchors: DataFrame | None = None, width: int = 520, vectors: DataFrame | None = None, asked: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """QRY11: (request_id, key, rank, excerpt, reasons): the passages that answer a question, by fused search.

    ``chunks``: key, text, chunk_type, chapter, document_id. ``requests``: request_id, text, keywords (array). ``vectors`` (key,
    embedding) and ``asked`` (request_id, q) add a vector ranking. Excerpts stand around the first keyword, of a
    question why also around the first word of a reason. A request that finds nothing gets no row.
    """
    k, types, chapters = MODES[mode]
    ranked = {"keyword": bm25(chunks, requests, depth(k), key=key).select("request_id", key, "rank")}
    if vectors is not None:
        ranked["vector"] = vector_top_k(vectors, asked, depth(k), key).select("request_id", key, "rank")
    filters = requests.select("request_id", F.array(*[F.lit(x) for x in types]).cast("array<string>").alias("chunk_types"), F.array(*[F.lit(x) for x in chapters]).cast("array<int>").alias("chapters"), F.array().cast("array<string>").alias("document_ids"))
    found = search_chunks(ranked, filters, chunks, k, anchors, key=key).join(chunks.select(key, "text"), key).join(requests.select("request_id", "keywords"), "request_id")
    own = F.coalesce("keywords", F.array().cast("array<string>"))
    around = F.concat(F.array(*[F.lit(x) for x in WHY_WORDS]), own) if mode == "why" else own
    return found.select("request_id", key, "rank", phrases.excerpt("text", around, width).alias("excerpt"), "reasons")
