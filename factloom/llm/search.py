"""Ranked lexical search by branch and bound over a tree of maxima.

A task cuts the documents that it reads into ranges and each range into leaves of neighbouring documents. Every term
keeps the largest impact that it has in a leaf, in each group of leaves above it, and so on to the range: a tree of
maxima. What a query's terms can add up to in a node bounds the scores below it. A query opens the node of the highest
bound first and stops when the next bound is below its k-th score; nodes whose bound equals that score are opened, since a
document in them may come first by its id. The k-th score found in a range is kept for the ranges after it.

A posting lies with its document, so no term's postings meet in one task, however frequent it is. What is broadcast
is a block of queries with a bounded number of terms; more queries are searched in further blocks.
"""

from __future__ import annotations

import heapq
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pieces, table

#: A term: letters and digits of ASCII and everything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) pairs of a block of queries, about; documents of a range and of a leaf, and children of a node.
QUERY_TERMS, RANGE, LEAF, FANOUT = 50_000, 8_192, 32, 8
#: Spellings whose number a worker remembers.
REMEMBERED = 200_000
_TERM = re.compile(TERM)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Queries:
    """A block of queries: each one's id and the numbers of its terms."""

    ids: list
    terms: list[np.ndarray]
    number: dict[str, int]


def query_terms(items: DataFrame, id_name: str, text_name: str) -> DataFrame:
    """(item, term): each query's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [sorted({t.translate(_LOWER) for t in _TERM.findall(text or "")}) for text in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([t for f in found for t in f], pa.string())], names=["item", "term"])

    chosen = items.select(F.col(f"`{id_name}`").cast("long").alias("item"), F.col(f"`{text_name}`").alias("text"))
    return chosen.mapInArrow(run, "item long, term string").distinct()


def postings(docs: DataFrame, id_name: str, text_name: str, number) -> DataFrame:
    """(doc, n, terms, tfs) of every document with a term: how many terms it has, and which of the numbered ones how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term, known = number.value.get, {}
        for batch in pieces(batches):
            kept, sizes, terms, tfs, lengths = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = Counter(_TERM.findall(text)) if text else None
                if not counts:
                    continue
                own: dict[int, int] = {}
                for spelling, tf in counts.items():
                    if (t := known.get(spelling)) is None:
                        t = known[spelling] = of_term(spelling.translate(_LOWER), -1)
                    if t >= 0:
                        own[t] = own.get(t, 0) + tf
                kept.append(i)
                sizes.append(counts.total())
                terms.extend(own.keys())
                tfs.extend(own.values())
                lengths.append(len(own))
            if len(known) > REMEMBERED:
                known.clear()
            ends = pa.array(np.cumsum([0, *lengths]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    chosen = docs.select(F.col(f"`{id_name}`").cast("long").alias("doc"), F.col(f"`{text_name}`").alias("text"))
    return chosen.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<long>")


def weights(terms: int, counts: dict[int, int], documents: int) -> np.ndarray:
    df = np.array([counts.get(t, 0) for t in range(terms)], np.int64)
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, but for the term's weight."""
    m = 100 - 90 + (90 * n * documents) // total
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


class Range:
    """Neighbouring documents, each with at least one posting, and the tree of maxima over them."""

    def __init__(self, docs: np.ndarray, known: np.ndarray, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        self.docs, self.known, self.starts, self.impact = docs, known, starts, impact
        self.terms, self.term = np.unique(terms.astype(np.int64), return_inverse=True)
        leaves = -(-len(docs) // LEAF)
        leaf = np.repeat(np.arange(len(docs)) // LEAF, np.diff(starts))
        key = self.term * leaves + leaf
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        level = np.zeros(len(self.terms) * leaves, np.int64)
        level[key[order][first]] = np.maximum.reduceat(impact[order], first)
        self.levels = [level.reshape(len(self.terms), leaves)]
        while (wide := self.levels[-1].shape[1]) > 1:
            above = -(-wide // FANOUT)
            padded = np.pad(self.levels[-1], ((0, 0), (0, above * FANOUT - wide)))
            self.levels.append(padded.reshape(len(self.terms), above, FANOUT).max(2))

    def scores(self, leaf: int, weight: np.ndarray) -> tuple[int, np.ndarray]:
        """The first document of a leaf and the scores of its documents; ``weight`` is by the range's terms, 0 beyond the query."""
        first, end = leaf * LEAF, min((leaf + 1) * LEAF, len(self.docs))
        a, b = self.starts[first], self.starts[end]
        return first, np.add.reduceat(weight[self.term[a:b]] * self.impact[a:b], self.starts[first:end] - a)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, found: list[tuple]) -> int:
        """Adds to ``found`` (-score, is the id null, id), the best k so far in order; how many leaves were opened."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, own = at[here], weight[here]
        if not len(at):
            return 0
        dense = np.zeros(len(self.terms), np.int64)
        dense[at] = own
        least = lambda: max(1, -found[k - 1][0]) if len(found) >= k else 1
        top = len(self.levels) - 1
        waiting = [(-int(own @ self.levels[top][at, 0]), top, 0)]
        opened = 0
        while waiting and -waiting[0][0] >= least():
            _, level, node = heapq.heappop(waiting)
            if level:
                below = self.levels[level - 1][at, node * FANOUT : (node + 1) * FANOUT]
                for child, bound in enumerate((own @ below).tolist()):
                    if bound >= least():
                        heapq.heappush(waiting, (-bound, level - 1, node * FANOUT + child))
                continue
            opened += 1
            first, scores = self.scores(node, dense)
            good = np.flatnonzero(scores >= least())
            if len(good):
                found.extend((-int(scores[i]), not self.known[first + i], int(self.docs[first + i])) for i in good)
                found.sort()
                del found[k:]
        return opened


def _ranges(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[Range]:
    """The ranges of a task's documents, in their order."""

    def build(some: list[pa.RecordBatch]) -> Range:
        rows = pa.Table.from_batches(some).combine_chunks()
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        doc = rows.column("doc").combine_chunks()
        tf, n = tfs.flatten().to_numpy(), rows.column("n").to_numpy()
        impact = impacts(tf, np.repeat(n, sizes), documents, total)
        return Range(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), terms.flatten().to_numpy(), impact)

    some, held = [], 0
    for batch in batches:
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("terms")), 0))
        for start in range(0, batch.num_rows, RANGE):
            part = batch.slice(start, RANGE)
            if some and held + part.num_rows > RANGE:
                yield build(some)
                some, held = [], 0
            some.append(part)
            held += part.num_rows
    if held:
        yield build(some)


def _search_block(docs: DataFrame, queries: Queries, k: int, id_name: str, text_name: str) -> DataFrame:
    """(item, doc, score) of each query's k best of every task."""
    context = docs.sparkSession.sparkContext
    written = cut(postings(docs, id_name, text_name, context.broadcast(queries.number)))
    size = written.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    counts = dict(written.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    shared = context.broadcast((queries, weights(len(queries.number), counts, size.documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        found: list[list[tuple]] = [[] for _ in asked.ids]
        for part in _ranges(batches, size.documents, size.total):
            for terms, best in zip(asked.terms, found):
                part.search(terms, weight[terms], k, best)
        rows = [(item, None if null else doc, -score) for item, best in zip(asked.ids, found) for score, null, doc in best]
        for column in [list(zip(*rows))] if rows else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in column], names=["item", "doc", "score"])

    return written.select("doc", "n", "terms", "tfs").mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_name: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank from 1, doc_id, score.

    Every row of ``docs`` is a document of its own, repeated rows and rows without id, too; equal scores are in the order
    of ids, null ones last. Items with one id (or without one) are one query of all their terms; a term of an item
    counts once. Null and empty texts have no terms: such documents are not counted, such items get no rows, and neither
    do documents without a score. Empty tables give an empty table; other columns may have any name.
    """
    spark = docs.sparkSession
    pairs = cut(query_terms(items, item_id, text_name))
    blocks = -(-pairs.count() // QUERY_TERMS)
    out = spark.createDataFrame([], "item long, doc long, score long")
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        number: dict[str, int] = {}
        of_item: dict = {}
        for row in own:
            of_item.setdefault(row.item, []).append(number.setdefault(row.term, len(number)))
        if own:
            queries = Queries(list(of_item), [np.sort(np.array(t, np.int64)) for t in of_item.values()], number)
            out = out.unionByName(_search_block(docs, queries, k, doc_id, text_name))
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, t, len(t)::BIGINT AS n FROM words WHERE len(t) > 0),
stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
tf AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN stats GROUP BY term, docs),
scored AS (
  SELECT a.item_id, d.d, d.doc_id, sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * d.n * s.docs) // s.total))))::BIGINT AS score
  FROM asked a JOIN tf USING (term) JOIN weight USING (term) JOIN docs d ON d.d = tf.d CROSS JOIN stats s
  GROUP BY a.item_id, d.d, d.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""

QUERIES: dict[str, Callable] = {"op11_ranked_search": op11_ranked_search}
SQL: dict[str, str] = {"op11_ranked_search": OP11_SQL}
