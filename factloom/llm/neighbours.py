"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors get one coordinate more, so that all have one norm and the largest inner product is the smallest Euclidean
distance. Each of several tables hashes with Gaussian (2-stable) projections: a vector's cell is floor((a x + b) / w) of
each. The leading coordinates of the cell name the bucket that a row is dealt to; inside its task the whole cell is the key.

A neighbour's projections lie about those of the query, shrunk by a factor and spread by a deviation that are fitted on
a bounded sample. That gives every cell an estimated success: the chance that a neighbour lies in it. A query visits
perturbed cells in the order of that estimate until the visited ones hold a set share of the success; a draw of
neighbours from the fitted model tells at which estimate this share is reached. Buckets whose best cell lies under that
estimate are never sent to, and only rows of visited cells are scored. The tables' candidates are merged and ranked by
their exact inner products.

A bucket larger than a block is dealt over several tasks by id, each with the whole bucket's queries, and many queries
of a bucket over several, too: nothing is dropped, and a crowd of equal vectors is no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Rows of a bucket in one task, queries of a bucket in one task, and rows of the sample that the model is fitted on.
BLOCK, QUERY_BLOCK, SAMPLE = 32_768, 8_192, 4_096
#: Cell coordinates are kept in -REACH to REACH - 1; those beyond share the outermost cells.
REACH = 8
#: Neighbours drawn from the fitted model to find a query's least success.
DRAWS = 256
_GRID = np.linspace(-9, 9, 4_001)
_NORMAL = np.array([NormalDist().cdf(z) for z in _GRID])


@dataclass(frozen=True)
class Index:
    directions: np.ndarray  # table, dimension + 1, projection
    offsets: np.ndarray  # table, projection
    width: float
    lead: int  # coordinates in a bucket's name
    scale: float  # the largest component, by which all are divided
    largest: float  # norm, once divided
    shrink: float
    deviation: float
    share: float  # of the success that a table's visited cells hold
    kind: type

    def shaped(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """The vectors divided by the scale, with their additional coordinate."""
        small = vectors / self.scale
        last = np.zeros(len(small)) if query else np.sqrt(np.maximum(0, self.largest**2 - (small**2).sum(1)))
        return np.concatenate([small, last[:, None]], 1)

    def cells(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """The cell coordinates of rows in table t."""
        at = self.shaped(vectors) @ self.directions[t] + self.offsets[t]
        return np.clip(np.floor(at / self.width), -REACH, REACH - 1).astype(np.int8)

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """The buckets that cells lie in."""
        digits = cells[:, : self.lead].astype(np.int64) + REACH
        return digits @ ((2 * REACH) ** np.arange(self.lead, dtype=np.int64)) if self.lead else np.zeros(len(cells), np.int64)

    def success(self, queries: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, projection, coordinate): log chances that a neighbour has this coordinate; and each query's least log success of a cell to visit."""
        centre = self.shrink * (self.shaped(queries, True) @ self.directions[t]) + self.offsets[t]
        edges = np.arange(-REACH, REACH + 1) * self.width
        edges[0], edges[-1] = -np.inf, np.inf
        below = np.interp((edges - centre[:, :, None]) / self.deviation, _GRID, _NORMAL)
        chance = np.log(np.maximum(np.diff(below, axis=2), 1e-12))
        drawn = np.random.default_rng(t).normal(size=(DRAWS, centre.shape[1])) * self.deviation
        least = np.empty(len(queries))
        for i in range(len(queries)):
            met = np.clip(np.floor((centre[i] + drawn) / self.width), -REACH, REACH - 1).astype(int) + REACH
            least[i] = np.quantile(chance[i][np.arange(met.shape[1]), met].sum(1), 1 - self.share)
        return chance, least - 1e-9

    def probes(self, chance: np.ndarray, least: float) -> np.ndarray:
        """The buckets of one query that hold a cell worth a visit, in the order of their best cell's success."""
        best = chance.max(1)
        beyond = np.concatenate([np.cumsum(best[::-1])[::-1], [0.0]])
        code, value = np.zeros(1, np.int64), np.zeros(1)
        for k in range(self.lead):
            value = (value[:, None] + chance[k]).ravel()
            code = (code[:, None] + np.arange(2 * REACH) * (2 * REACH) ** k).ravel()
            worth = value + beyond[k + 1] >= least
            code, value = code[worth], value[worth]
        return code[np.argsort(-value, kind="stable")]


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """(id, v) of the vectors that take part: all but null, empty and zero ones, those with null or non-finite components, and rows without id."""
    v = F.col(f"`{vector_name}`")
    rows = vectors.select(F.col(f"`{id_name}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    sound = "not exists(v, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity')) and exists(v, x -> x <> 0)"
    return rows.where(sound)


def shapes(rows: DataFrame) -> list:
    """(d, n, scale) of each length of vector: how many there are, and their largest component."""
    top = F.expr("aggregate(v, 0D, (a, x) -> greatest(a, abs(cast(x as double))))")
    return rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(top).alias("scale")).orderBy(F.desc("n"), "d").collect()


def build(rows: DataFrame, n: int, dimension: int, scale: float, tables: int = 3, share: float = 0.95, k: int = 20, cell_bits: int = 4, seed: int = 11) -> Index:
    """Draws the hash functions and fits shrink and deviation on at most SAMPLE rows in the order of a hash of their ids.

    Projections grow with the logarithm of ``n``, ``cell_bits`` beyond it, so that cells hold few rows at any size. ``share`` is
    the success over all tables. The k nearest of n rows are about the k * SAMPLE / n nearest of the sample.
    """
    projections = int(np.clip(round(np.log2(max(1, n))) + cell_bits, 4, 28))
    lead = min(projections, int(np.ceil(np.log(max(1, n / BLOCK)) / np.log(2.5))))  # a coordinate takes two or three values
    largest = max(float(rows.select(F.expr(f"sqrt(aggregate(v, 0D, (a, x) -> a + pow(cast(x as double) / {scale!r}D, 2)))").alias("m")).agg(F.max("m")).first()[0] or 0.0), 1e-300)
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(tables, dimension + 1, projections))
    width = 3 * largest
    offsets = rng.random((tables, projections)) * width
    kind = np.float32 if "float" in rows.schema["v"].dataType.simpleString() else np.float64
    pool = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], float)
    plain = Index(directions, offsets, width, lead, scale, largest, 1.0, 1.0, share, kind)
    few, all_ = pool[:512] / scale, pool / scale
    scores = few @ all_.T
    scores[np.arange(len(few)), np.arange(len(few))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : max(1, min(len(pool) - 1, round(k * len(pool) / max(1, n))))]
    asked = np.concatenate([plain.shaped(pool[:512], True) @ d for d in directions], 1)
    met = np.concatenate([plain.shaped(pool) @ d for d in directions], 1)[near]
    spread = (asked**2).sum() * near.shape[1]
    shrink = float((asked[:, None, :] * met).sum() / spread) if spread > 0 else 1.0
    deviation = max(float(((met - shrink * asked[:, None, :]) ** 2).mean()) ** 0.5, 1e-3 * width)
    return Index(directions, offsets, width, lead, scale, largest, shrink, deviation, 1 - (1 - share) ** (1 / tables), kind)


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float)


def _spread(rows: DataFrame, index: Index, query: bool) -> DataFrame:
    """(t, code, id, v): each row in its bucket of each table, or each query in every bucket that it visits."""
    tables = len(index.directions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2_048):
                part = batch.iloc[start : start + 2_048]
                v, ids = np.array(part.v.tolist(), float), part.id.to_numpy()
                packed = np.array([x.tobytes() for x in v.astype(index.kind)], object)
                for t in range(tables):
                    if query:
                        chance, least = index.success(v, t)
                        visited = [index.probes(c, x) for c, x in zip(chance, least)]
                        at, code = np.repeat(np.arange(len(v)), [len(c) for c in visited]), np.concatenate(visited)
                    else:
                        at, code = np.arange(len(v)), index.codes(index.cells(v, t))
                    yield pd.DataFrame({"t": t, "code": code, "id": ids[at], "v": packed[at]})

    return rows.select("id", "v").mapInPandas(run, "t int, code long, id long, v binary")


def _best(x: np.ndarray, own: np.ndarray, at: np.ndarray, q: np.ndarray, ask: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best of rows ``at`` for one query; other ids than its own."""
    at = at[own[at] != ask]
    with np.errstate(all="ignore"):
        near = np.nan_to_num(x[at] @ q, nan=-np.inf)
        if len(at) > k:
            least = np.partition(near, -k)[-k]
            at = at[near >= least - 1e-9 * (1 + abs(least))] if np.isfinite(least) else at
        exact = (x[at] * q).sum(1)  # in one order of additions, whatever the block
    best = np.lexsort((own[at], -np.nan_to_num(exact, nan=-np.inf)))[:k]
    return own[at][best], exact[best]


def _ranked(index: Index, k: int, count: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One bucket: its cells are looked at query by query, and only rows of visited cells are scored. ``count``: their number instead."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query_ids, ids, scores = [], [], []
        if len(rows) and len(asked):
            t = int(rows.t.iloc[0])
            x, own = _matrix(rows.v, index.kind), rows.id.to_numpy(np.int64)
            cells, cell = np.unique(index.cells(x, t), axis=0, return_inverse=True)
            order = np.argsort(cell.ravel(), kind="stable")
            x, own, cell = x[order], own[order], cell.ravel()[order]
            # One column a projection and coordinate in use: a product gives every cell's log success.
            one_hot = np.zeros((len(cells), index.directions.shape[2], 2 * REACH), np.float32)
            np.put_along_axis(one_hot, cells[:, :, None].astype(int) + REACH, 1, 2)
            used = one_hot.any(0)
            one_hot = np.ascontiguousarray(one_hot[:, used])
            for at in range(0, len(asked), 128):
                part = asked.iloc[at : at + 128]
                q, ask = _matrix(part.v, index.kind), part.id.to_numpy(np.int64)
                chance, least = index.success(q, t)
                visits = chance[:, used].astype(np.float32) @ one_hot.T >= (least - 1e-4)[:, None]
                for i in range(len(q)):
                    hit = np.flatnonzero(visits[i][cell])
                    if not len(hit):
                        continue
                    found, value = (np.array([len(hit)]), np.zeros(1)) if count else _best(x, own, hit, q[i], ask[i], k)
                    query_ids.append(np.full(len(found), ask[i]))
                    ids.append(found)
                    scores.append(value)
        join = lambda a, kind: np.concatenate(a) if a else np.empty(0, kind)
        return pd.DataFrame({"query_id": join(query_ids, np.int64), "vec_id": join(ids, np.int64), "score": join(scores, float)})

    return run


def _everything(kind: type, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            x, own = _matrix(rows.v, kind), rows.id.to_numpy(np.int64)
            for ask, v in zip(asked.id, asked.v):
                ids, scores = _best(x, own, np.arange(len(x)), np.frombuffer(v, kind).astype(float), ask, k)
                out.append(pd.DataFrame({"query_id": ask, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def _dealt(stored: DataFrame, asked: DataFrame, rank: Callable) -> DataFrame:
    """Buckets met with their queries, in blocks of both."""
    parts = stored.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    asks = asked.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("asks"))
    plan = parts.join(asks, ["t", "code"])
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = stored.join(plan, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("ask", numbers("asks"))
    sent = asked.join(plan, ["t", "code"]).withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")).withColumn("part", numbers("parts"))
    keys, columns = ["t", "code", "part", "ask"], ["t", "code", "part", "ask", "id", "v"]
    return dealt.select(*columns).groupBy(*keys).cogroup(sent.select(*columns).groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): at most k a query, of the candidates in the cells that it visits."""
    return _top(_dealt(cut(_spread(rows, index, False)), cut(_spread(queries, index, True)), _ranked(index, k, False)), k)


def search_all(rows: DataFrame, queries: DataFrame, kind: type, k: int) -> DataFrame:
    """The same of all rows, in blocks."""
    pack = lambda batches: (pd.DataFrame({"t": 0, "code": 0, "id": b.id, "v": [np.asarray(v, kind).tobytes() for v in b.v]}) for b in batches)
    whole = lambda df: cut(df.select("id", "v").mapInPandas(pack, "t int, code long, id long, v binary"))
    return _top(_dealt(whole(rows), whole(queries), _everything(kind, k)), k)


def visited_share(rows: DataFrame, queries: DataFrame, index: Index) -> float:
    """Rows scored, over queries times rows: 1 is the work of comparing all once."""
    stored, asked = cut(_spread(rows, index, False)), cut(_spread(queries, index, True))
    scored = _dealt(stored, asked, _ranked(index, 1, True)).agg(F.sum("vec_id")).first()[0] or 0
    return scored / max(1, rows.count() * queries.count())


def nearest(vectors: DataFrame, every: int, k: int = 20, id_name: str = "vec_id", vector_name: str = "embedding", **options) -> DataFrame:
    """The k nearest found of every row whose id ``every`` divides: query_id, rank from 1, vec_id, score.

    Null, empty and zero vectors, those with null or non-finite components and rows without id take no part; vectors of
    another length are searched among their own kind. Components of any finite size take part. A query's own id is no
    candidate. A query that visited fewer than k candidates is asked again of all rows, so each gets k, or all there
    are. Ties go to the smaller id; repeated rows of one id count once for equal scores. A score beyond double precision
    is infinite; one that is not a number ranks last. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    every_row = usable(vectors, id_name, vector_name)
    out = None
    for shape in shapes(every_row):
        rows = every_row.where(F.size("v") == shape.d)
        index = build(rows, shape.n, shape.d, shape.scale, k=k, **options)
        queries = rows.where(F.col("id") % every == 0)
        first = cut(search(rows, queries, index, k))
        found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, shape.n - 1)).select(F.col("query_id").alias("__q"))
        short = cut(queries.join(found, F.col("id") == F.col("__q"), "left_anti"))
        if not short.isEmpty():
            again = search_all(rows, short, index.kind, k)
            lacking = short.select(F.col("id").alias("__q")).distinct()
            first = first.join(lacking, F.col("query_id") == F.col("__q"), "left_anti").unionByName(again)
        out = first if out is None else out.unionByName(first)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20)


QUERIES: dict[str, Callable] = {"op2_nearest_vectors": op2_nearest_vectors}
#: An approximate search has no SQL: tests hold its rows and its recall against brute force.
SQL: dict[str, str] = {}
