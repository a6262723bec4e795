"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles, carried as one sorted array of 64-bit hashes while it is
compared and as minwise values (one an independent hash function) while it is searched for. Documents with one set are
one class; what follows works on classes.

Each of several independent trees chooses a few minwise positions at its root and sends every class to the child named
by its value there. Small nodes compare all their members. A large node compares its members with its smallest one, so
a big group of copies is joined up in linear work, and is branched again, at positions chosen from the node's own name,
as long as it holds more than one component. Candidate pairs pass an estimate from the minwise values, and every link
is then confirmed on the full sets, from the texts. Pairs that confirmed links already connect need no test: they
cannot change a component. Two sets at the threshold meet at the root with a chance of 1 - (1 - J)^positions, over
0.9999 with the defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_sizes, own_names, pieces, table

#: Identifiers of up to so many documents are broadcast (16 bytes each) to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Levels that all large nodes are branched before candidates are confirmed.
LEVELS_AT_ONCE = 3
#: A node that has not come apart by this level holds sets that agree nearly everywhere: it is compared whole, in pairs of blocks that fit in a task.
LAST_LEVEL = 40
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Join:
    """``words`` a shingle; sets are linked if 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80
    positions: int = 64
    trees: int = 8
    small: int = 32
    whole: int = 4_096
    whole_shingles: int = 2_000_000

    @property
    def least_equal(self) -> int:
        """So many equal minwise values a candidate has: four and a half standard deviations under the threshold's mean."""
        p = self.percent / 100
        return max(1, int(self.positions * p - 4.5 * (self.positions * p * (1 - p)) ** 0.5))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles, A-Z in lower case; of a shorter text, one for all its words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=1)], np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = len(own) - words + 1
    out = own[:n].copy()
    for k in range(1, words):
        out = (out ^ (out >> np.uint64(29))) * _MIX + own[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * _ODD
    return np.unique(out ^ (out >> np.uint64(27)))


@lru_cache(maxsize=4)
def _hashes(positions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(1, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, positions, dtype=np.uint64)


def minwise(items: np.ndarray, positions: int) -> np.ndarray:
    a, b = _hashes(positions)
    out = np.full(positions, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 2048):
        block = items[at : at + 2048, None] * a
        block += b
        block >>= np.uint64(32)
        np.minimum(out, block.min(0).astype(np.uint32), out=out)
    return out


def sketches(docs: DataFrame, how: Join) -> DataFrame:
    """(id, n, k1, k2, sig) for every row: set size, 128 bits that name the set (null: no words), minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, k1, k2, sigs = [], [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), how.words)
                n.append(len(items))
                name = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64).tolist() if len(items) else [None, None]
                k1.append(name[0])
                k2.append(name[1])
                sigs.append(minwise(items, how.positions).view(np.int32) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, n long, k1 long, k2 long, sig array<int>")


def _equal(a: str, b: str) -> Column:
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e))")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every vertex u of ``edges`` (u, v) that is not the smallest of its component, v: large and small stars in turn."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low")).select("u", "size", F.least("u", "low").alias("low"))
        large = join_sizes(both, "u", "v", low).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low"))
        small = join_sizes(large, "u", "v", low).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        now = cut(small)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now


def confirm(pairs: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """Those of ``pairs`` (u < v) that are linked on their full sets.

    A hub u meets at most about 64 of its partners in one group, so its text travels once for them and no group grows
    with the number of copies.
    """
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = _texts(docs, ids)
    degree = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("__parts")).withColumnRenamed("u", "__u")
    dealt = pairs.join(degree, F.col("u") == F.col("__u")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("__parts")).cast("int").alias("part"))
    roles = dealt.select("u", "part", F.col("v").alias("who")).unionByName(dealt.select("u", "part", F.col("u").alias("who"))).distinct()
    loaded = roles.join(texts, F.col("who") == F.col("id")).select("u", "part", "who", (F.col("who") != F.col("u")).cast("int").alias("side"), "text")
    rows = loaded.repartition("u", "part").sortWithinPartitions("u", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in pieces(batches):
            us, vs = [], []
            for u, part, who, side, text in zip(*(batch.column(i) for i in range(4)), batch.column(4)):
                key, items = (u.as_py(), part.as_py()), shingles(text.as_py(), how.words)
                if key != group:
                    group, hubs = key, []
                if side.as_py() == 0:
                    hubs.append(items)
                    continue
                for hub in hubs:
                    if 100 * min(len(hub), len(items)) < how.percent * max(len(hub), len(items)):
                        continue
                    both = len(np.intersect1d(hub, items, assume_unique=True))
                    if both and 100 * both >= how.percent * (len(hub) + len(items) - both):
                        us.append(key[0])
                        vs.append(who.as_py())
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _branch(nodes: DataFrame, classes: DataFrame, how: Join, level: int) -> DataFrame:
    """The children (node, rep) of nodes: one position a node, or two, chosen by the node's own name."""
    extra = int(1000 * (100 / how.percent - 1))
    at = lambda k: F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(how.positions)).cast("int")
    child = lambda k: F.xxhash64("node", at(k), F.element_at("sig", at(k) + 1))
    twice = F.pmod(F.xxhash64("node", F.lit(level), F.lit(0)), F.lit(1000)) < extra
    held = nodes.join(classes.select(F.col("rep").alias("__r"), "sig"), F.col("rep") == F.col("__r"))
    return held.select(F.explode(F.when(twice, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("node"), "rep")


def _compare(nodes: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (u, v) to compare in nodes (node, rep), and the nodes that are too large for comparing all."""
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low")).where("size > 1")
    kept = cut(join_sizes(nodes, "node", "rep", sizes))
    few, many = kept.where(F.col("size") <= small), kept.where(F.col("size") > small)
    right = few.select(F.col("node").alias("__node"), F.col("rep").alias("v"))
    inside = few.select("node", F.col("rep").alias("u")).join(right, (F.col("node") == F.col("__node")) & (F.col("u") < F.col("v"))).select("u", "v")
    spokes = many.where("rep > low").select(F.col("low").alias("u"), F.col("rep").alias("v"))
    return inside.unionByName(spokes), many.select("node", "rep")


def links(docs: DataFrame, classes: DataFrame, how: Join, repeated: bool = False) -> DataFrame:
    """(u, v): for each class (rep, sig) that is not the smallest of those linked, directly or through others, the smallest.

    Trees are grown a few levels and the candidates confirmed. A large node that still holds more than one component is
    compared whole on its full sets if it fits in a task, and grown further until its children do. ``repeated``: several
    classes may have one rep, whose links are pooled.
    """
    rng = np.random.default_rng(9)
    chosen = [(t, int(p)) for t in range(how.trees) for p in rng.choice(how.positions, 1 + int(rng.random() < 100 / how.percent - 1), replace=False)]
    root = F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit(p), F.element_at("sig", p + 1)) for t, p in chosen]))
    nodes = classes.select(root.alias("node"), "rep")
    nodes = nodes.distinct() if repeated else nodes
    found, level = [], 0
    for level in range(1, LEVELS_AT_ONCE + 1):
        pairs, large = _compare(nodes, how.small)
        found.append(pairs)
        if large.isEmpty():
            break
        if level < LEVELS_AT_ONCE:
            nodes = _branch(large, classes, how, level).distinct()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    sig_u, sig_v = classes.select(F.col("rep").alias("__u"), F.col("sig").alias("__a")), classes.select(F.col("rep").alias("__v"), F.col("sig").alias("__b"))
    likely = pairs.distinct().join(sig_v, F.col("v") == F.col("__v")).join(sig_u, F.col("u") == F.col("__u")).withColumn("equal", _equal("__a", "__b"))
    likely = likely.where(F.col("equal") >= how.least_equal).select("u", "v", "equal")
    likely = likely.groupBy("u", "v").agg(F.max("equal").alias("equal")) if repeated else likely
    stars = _confirmed(cut(likely), docs, how)
    while not large.isEmpty():
        home = _home(large.withColumnRenamed("rep", "v"), "v", stars).select("node", F.col("v").alias("rep"), F.col("at").alias("comp"))
        mixed = home.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select(F.col("node").alias("__node"))
        home = cut(home.join(mixed, F.col("node") == F.col("__node"), "left_semi"))
        held = home.join(classes.select(F.col("rep").alias("__r"), "n"), F.col("rep") == F.col("__r"))
        share = F.greatest(F.count(F.lit(1)) / how.whole, F.sum("n") / how.whole_shingles)  # of what fits in a task
        sizes = held.groupBy("node").agg(share.alias("share"))
        parts = F.when(F.col("share") <= 1, 1).otherwise(F.ceil(2 * F.col("share"))).cast("int")
        within = cut(sizes.select(F.col("node").alias("__node"), (F.col("share") <= 1) | F.lit(level >= LAST_LEVEL), parts).toDF("__node", "fits", "parts"))
        fits = lambda yes: home.join(within.where(F.col("fits") == yes), F.col("node") == F.col("__node"))
        if not within.where("fits").isEmpty():
            stars = _joined(stars, cut(exhaust(fits(True), docs, how)))
        rest = cut(fits(False).select("node", "rep"))
        if rest.isEmpty():
            break
        level += 1
        large = _branch(rest, classes, how, level).distinct()
    return stars


def _home(rows: DataFrame, name: str, stars: DataFrame) -> DataFrame:
    """``rows`` with ``at``, the component of ``name``: its own, where no link is known."""
    known = stars.select(F.col("u").alias("__h"), F.col("v").alias("__c"))
    return rows.join(known, F.col(name) == F.col("__h"), "left").withColumn("at", F.coalesce("__c", name)).drop("__h", "__c")


def _rooted(parents: DataFrame) -> DataFrame:
    """(u, v) with v the root of u's tree, by pointer jumping; ``parents`` has one smaller v a u."""
    now = cut(parents)
    while True:
        up = now.select(F.col("u").alias("__w"), F.col("v").alias("__root"))
        jumped = cut(now.join(up, F.col("v") == F.col("__w"), "left").select("u", F.coalesce("__root", "v").alias("v"), F.col("__root").isNotNull().alias("moved")))
        now = jumped.select("u", "v")
        if jumped.where("moved").isEmpty():
            return now


def _confirmed(likely: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """The stars after testing candidate pairs: for each class one smaller partner first, then every pair still unconnected.

    The first test's links are a forest, which pointer jumping flattens; what the second adds is a graph of its roots.
    """
    if likely.isEmpty():
        return likely.select("u", "v")
    sure = (F.col("equal") * 100 >= how.positions * how.percent).cast("int")
    best = cut(likely.groupBy("v").agg(F.max_by("u", F.struct(sure, -F.col("u"))).alias("u")).select("u", "v"))
    stars = _rooted(confirm(best, docs, how).select(F.col("v").alias("u"), F.col("u").alias("v")))
    apart = _home(_home(likely.select("u", "v"), "u", stars).withColumnRenamed("at", "at_u"), "v", stars).where("at_u <> at").select("u", "v")
    rest = cut(apart.join(best.select(F.col("u").alias("__u"), F.col("v").alias("__v")), (F.col("u") == F.col("__u")) & (F.col("v") == F.col("__v")), "left_anti"))
    return stars if rest.isEmpty() else _joined(stars, confirm(rest, docs, how))


def node_links(reps: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components within one node, from exact intersections of each set outside the largest component with all."""
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(item, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[order]
    count = np.bincount(item)
    start = np.concatenate([[0], np.cumsum(count)])
    names, label = np.unique(np.array(comps), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest):
        own = item[offset[i] : offset[i + 1]]
        many = count[own]
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(holder[at], minlength=n)
        linked = (100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i])
        for j in np.flatnonzero(linked):
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents named in ``ids`` (id)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("__id is not null").join(F.broadcast(ids) if few else ids, F.col("__id") == F.col("id")).select("id", "text")


def exhaust(nodes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """(u, v): confirmed links between components within nodes (node, rep, comp, parts), each node compared whole.

    A node of one part is one task's. The members of others are dealt into parts, and every two parts meet in a task of their own.
    """
    texts = _texts(docs, nodes.select(F.col("rep").alias("id")).distinct())
    own = nodes.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = F.expr("transform(filter(sequence(0, parts - 1), x -> x <> own or parts = 1), x -> cast(least(x, own) as long) * parts + greatest(x, own))")
    dealt = own.select("node", F.explode(pairs).alias("pair"), "rep", "comp")
    rows = dealt.join(texts, F.col("rep") == F.col("id")).select("node", "pair", "rep", "comp", "text").repartition("node", "pair").sortWithinPartitions("node", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(held: list) -> pa.RecordBatch:
            found = node_links(*zip(*held), how.percent) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        node, held = None, []
        for batch in pieces(batches):
            for name, pair, rep, comp, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (name, pair) != node:
                    yield links_of(held)
                    node, held = (name, pair), []
                held.append((rep, comp, shingles(text.as_py(), how.words)))
        yield links_of(held)

    return rows.mapInArrow(run, "u long, v long")


def _joined(stars: DataFrame, more: DataFrame) -> DataFrame:
    """``stars`` with the components that links ``more`` (u, v) connect made one."""
    ends = _home(_home(more.select("u", "v"), "u", stars).withColumnRenamed("at", "at_u"), "v", stars)
    over = components(ends.select(F.col("at_u").alias("u"), F.col("at").alias("v")))
    moved = _home(stars, "v", over).select("u", F.col("at").alias("v"))
    return cut(moved.unionByName(over).distinct())


def near_duplicates(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Rows that share a doc_id are one document, whose links are pooled. A text without words, or null, is linked with
    nothing. A row without doc_id takes no part: its component is null and it is kept. Copies are in their class's
    component. An empty table gives an empty table.
    """
    drawn = cut(sketches(docs, how))
    named = drawn.where("id is not null and k1 is not null")
    reps = cut(named.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig")))
    repeated = not reps.groupBy("rep").count().where("count > 1").isEmpty()
    stars = links(docs, reps.select("rep", "n", "sig"), how, repeated)
    # A document whose rows have different sets belongs to several classes: their smallest ids are linked as well.
    pooled = named.join(reps.select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), "rep"), (F.col("k1") == F.col("__a")) & (F.col("k2") == F.col("__b"))).select("id", "rep")
    again = named.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias("__id"))
    extra = cut(pooled.join(again, F.col("id") == F.col("__id"), "left_semi").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    if not extra.isEmpty():
        stars = components(stars.unionByName(extra))
    homes = _home(reps.select("k1", "k2", "rep"), "rep", stars).select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("at").alias("comp"))
    out = drawn.select("id", "n", "k1", "k2").join(homes, (F.col("k1") == F.col("__a")) & (F.col("k2") == F.col("__b")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each component; of repeated rows of one doc_id and text, one."""
    judged = cut(near_duplicates(docs.select("doc_id", "text"), how))
    name = own_names(docs)("gone")
    gone = judged.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, by three-word shingles and 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Join(words=3, percent=85))


#: Exact on small tables: an inverted index of all shingles, then transitive closure.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct([w[i:i+2] for i in range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
rare AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM rare JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp USING (doc_id)
"""

QUERIES: dict[str, Callable] = {"op7_near_duplicates": op7_near_duplicates}
SQL: dict[str, str] = {"op7_near_duplicates": OP7_SQL}
