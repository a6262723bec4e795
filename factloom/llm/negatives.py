"""Hard negatives by distributed radix selection.

Anchors meet all rows in blocks of both, and a block of scores is one matrix product. An anchor's positives are its best
rows of the same label; each anchor and positive set a window of scores in which negatives count. The score of the
k-th negative of every window is then found digit by digit: each block counts its rows of the window by the current
digit of their distance from the window's upper end, the counts are added up over the blocks, and the digit where
they reach k narrows the window for the next round. Only then are rows gathered: those whose score is not below the
k-th. A block tells its counts from the top down only as far as they matter, which is where they alone reach k, so no
more than k counts or rows leave a block for one window.

Scores are whole numbers: exact double-precision products where no sum can reach 2^53, integers of any size elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_sizes, table

#: Bytes of double-precision components of the rows and of the anchors in one task; bits of a digit.
BLOCK, ANCHOR_BLOCK, DIGIT = 8 << 20, 4 << 20, 8
#: Rows of one product at a time, and the ends of what a score may be.
STEP, LIMIT = 64, 2**63 - 1


def usable(vectors: DataFrame, id_name: str, label_name: str, vector_name: str, label: Column | None = None) -> DataFrame:
    """(id, label, v) of the rows that take part, with ``label`` (of id and label) instead of the given one."""
    rows = vectors.select(F.col(f"`{id_name}`").cast("long").alias("id"), F.col(f"`{label_name}`").cast("long").alias("label"), F.col(f"`{vector_name}`").alias("v"))
    sound = "id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))"
    rows = rows.where(sound)
    return rows.withColumn("label", label) if label is not None else rows


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    """Components as floor(256 x), which doubles hold exactly."""
    return np.floor(256 * np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float))


def products(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The whole-number inner products; those beyond 64 bits stay at their ends."""
    most = lambda m: float(np.abs(m).max()) if m.size else 0.0
    if most(asked) * most(rows) * max(1, asked.shape[1]) < 2.0**53:
        return (asked @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.array([[min(LIMIT, max(-LIMIT, sum(a * b for a, b in zip(x, y)))) for y in whole(rows)] for x in whole(asked)], np.int64).reshape(len(asked), len(rows))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _stored(rows: DataFrame, kind: type) -> DataFrame:
    """(d, row, id, label, v) written once: a vector's length, a number of its own, and its components as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "label": b.label, "v": [np.asarray(v, kind).tobytes() for v in b.v]})

    packed = rows.select("id", "label", "v").mapInPandas(pack, "id long, label long, v binary")
    return cut(packed.select((F.octet_length("v") / np.dtype(kind).itemsize).cast("long").alias("d"), F.monotonically_increasing_id().alias("row"), "id", "label", "v"))


def _blocks(stored: DataFrame, is_anchor: Column) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with their block and the number of the other side's blocks among vectors of their length."""
    many = lambda n, most: F.greatest(F.lit(1), F.ceil(n * F.greatest(F.lit(1), F.col("d")) * 8 / most)).cast("int")
    sizes = stored.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a"))
    sizes = sizes.where("a > 0").select("d", "n", many(F.col("n"), BLOCK).alias("parts"), many(F.col("a"), ANCHOR_BLOCK).alias("asks"))
    joined = cut(join_sizes(stored, "d", "row", sizes).drop("n"))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    rows = joined.withColumn("part", dealt("parts")).drop("parts")
    anchors = joined.where(is_anchor).withColumn("ask", dealt("asks")).drop("asks")
    return rows, anchors


def _meet(rows: DataFrame, anchors: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """``judge`` of every block of rows with every block of anchors of their length."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["d", "part", "ask"]
    stored, asked = rows.withColumn("ask", numbers("asks")).drop("asks"), anchors.withColumn("part", numbers("parts")).drop("parts")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, since both sides come from one table
    return stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(judge, schema)


def _judge(kind: type, each: Callable, names: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function of blocks from one of an anchor, the rows' ids, labels and the anchor's scores of them; it yields arrays by name."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        if len(rows) and len(asked):
            x, ids, labels = _matrix(rows.v, kind), rows.id.to_numpy(np.int64), rows.label.to_numpy(np.int64)
            for start in range(0, len(asked), STEP):
                part = asked.iloc[start : start + STEP]
                for anchor, scores in zip(part.itertuples(index=False), products(_matrix(part.v, kind), x)):
                    out.extend(each(anchor, ids, labels, scores))
        joined = {n: np.concatenate([np.atleast_1d(o[n]) for o in out]) if out else np.empty(0, np.int64) for n in names}
        return pd.DataFrame(joined)

    return run


def _filled(n: int, value: int) -> np.ndarray:
    return np.full(n, value, np.int64)


def _positives(rows: DataFrame, anchors: DataFrame, kind: type, k: int) -> DataFrame:
    """(anchor_row, anchor_id, place, positive_id, positive_score): the k best other rows of an anchor's label, numbered from 1."""

    def each(anchor, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[dict]:
        at = np.flatnonzero((labels == anchor.label) & (ids != anchor.id))
        at = at[best(scores[at], ids[at], k)]
        yield {"anchor_row": _filled(len(at), anchor.row), "anchor_id": _filled(len(at), anchor.id), "positive_id": ids[at], "positive_score": scores[at]}

    names = ["anchor_row", "anchor_id", "positive_id", "positive_score"]
    found = _meet(rows, anchors, _judge(kind, each, names), ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _asked(anchors: DataFrame, windows: DataFrame, *ends: str) -> DataFrame:
    """The anchors with the places and the ends of their windows, a bounded number each."""
    listed = windows.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", *[F.col(e) for e in ends]))).alias("w"))
    listed = listed.select("anchor_row", F.col("w.place").alias("places"), *[F.col(f"w.{e}").alias(f"w{i}") for i, e in enumerate(ends)])
    return anchors.join(listed, anchors["row"] == listed["anchor_row"]).drop("anchor_row")


def _counts(rows: DataFrame, asked: DataFrame, kind: type, shift: int) -> DataFrame:
    """(anchor_row, place, digit, rows): how many rows of each window have which digit, from the top as far as they matter."""

    def each(anchor, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[dict]:
        other = scores[labels != anchor.label]
        for place, low, high, need in zip(anchor.places, anchor.w0, anchor.w1, anchor.w2):
            digits = (high - other[(other >= low) & (other <= high)]) >> shift
            digit, n = np.unique(digits, return_counts=True)
            enough = int(np.searchsorted(np.cumsum(n), need)) + 1
            digit, n = digit[:enough], n[:enough]
            yield {"anchor_row": _filled(len(n), anchor.row), "place": _filled(len(n), place), "digit": digit, "rows": n}

    names = ["anchor_row", "place", "digit", "rows"]
    counted = _meet(rows, asked, _judge(kind, each, names), ", ".join(f"{n} long" for n in names))
    return counted.groupBy("anchor_row", "place", "digit").agg(F.sum("rows").alias("rows"))


def _narrowed(windows: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Each window's ends after a round: those of the digit where the counts reach ``need``; a window with fewer rows keeps all and is done."""
    upward = Window.partitionBy("anchor_row", "place").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("reached", F.sum("rows").over(upward))
    joined = running.join(windows.select("anchor_row", "place", "need"), ["anchor_row", "place"]).where("reached >= need")
    kth = joined.groupBy("anchor_row", "place").agg(F.min("digit").alias("digit"), F.min("reached").alias("reached"), F.min_by("rows", "digit").alias("rows"))
    met, size = windows.join(kth, ["anchor_row", "place"], "left"), F.lit(1 << shift)
    open_, high = F.col("open") & F.col("digit").isNotNull(), F.col("high") - F.col("digit") * size
    return met.select(
        *[c for c in windows.columns if c not in ("low", "high", "need", "open")],
        F.when(open_, F.greatest(F.col("low"), high - size + 1)).otherwise(F.col("low")).alias("low"), F.when(open_, high).otherwise(F.col("high")).alias("high"),
        F.when(open_, F.col("need") - F.col("reached") + F.col("rows")).otherwise(F.col("need")).alias("need"), open_.alias("open"),
    )


def _gathered(rows: DataFrame, asked: DataFrame, kind: type, k: int) -> DataFrame:
    """(anchor_row, place, negative_id, negative_score) of the rows that the windows' last ends admit, at most k a block and window."""

    def each(anchor, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[dict]:
        other = np.flatnonzero(labels != anchor.label)
        for place, low, high in zip(anchor.places, anchor.w0, anchor.w1):
            at = other[(scores[other] >= low) & (scores[other] <= high)]
            at = at[best(scores[at], ids[at], k)]
            yield {"anchor_row": _filled(len(at), anchor.row), "place": _filled(len(at), place), "negative_id": ids[at], "negative_score": scores[at]}

    names = ["anchor_row", "place", "negative_id", "negative_score"]
    return _meet(rows, asked, _judge(kind, each, names), ", ".join(f"{n} long" for n in names))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of every row (id, label, v; see ``usable``) whose id ``every`` divides.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best
    ``positives`` rows of the same label, the first ``k`` rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's, highest first, ties to the smaller id. A positive score below zero has no such rows, one of zero
    those of score zero. Rows with the anchor's own id are never its positives. Every row stands for itself, so repeated rows come up repeatedly and
    a repeated anchor has its rows each time. Only vectors of one length meet. An empty table gives an empty table.
    """
    kind = np.float32 if "float" in rows.schema["v"].dataType.simpleString() else np.float64
    stored, anchors = _blocks(_stored(rows, kind), F.col("id") % every == 0)
    share = lambda percent, to: to(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    windows = _positives(stored, anchors, kind, positives).withColumn("bottom", share(low, F.ceil)).withColumn("top", share(high, F.floor)).where("bottom <= top")
    windows = cut(windows.select("anchor_row", "place", "anchor_id", "positive_id", "positive_score", "top", F.col("bottom").alias("low"), F.col("top").alias("high"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open")))
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    for digit in reversed(range(max(1, -(-int(widest).bit_length() // DIGIT)))):
        asked = _asked(anchors, windows.where("open"), "low", "high", "need")
        windows = cut(_narrowed(windows, _counts(stored, asked, kind, digit * DIGIT), digit * DIGIT))
    found = _gathered(stored, _asked(anchors, windows, "low", "top"), kind, k).join(windows, ["anchor_row", "place"])
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", label))


OP13_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

QUERIES: dict[str, Callable] = {"op13_hard_negatives": op13_hard_negatives}
SQL: dict[str, str] = {"op13_hard_negatives": OP13_SQL}
