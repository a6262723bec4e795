"""Reversible line deduplication: cuckoo filters in shards before exact reference counts.

The exact table holds, for each line key, the number of documents that have it. Keys that reach the limit are also
held by cuckoo filters, one a shard of the key space, which take insertions and deletions. A document's lines are
first asked of the filters; only those that the filters know go on to the exact table, which has the last word, so a
false positive costs a lookup and never a line. Inserting or deleting documents adds to or subtracts from the counts
and moves only the keys that cross the limit in or out of the filters: deleting what was inserted gives back the state.

A key is 128 bits of the line with white space stripped at both ends and A-Z in lower case.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_sizes, own_names, pieces, same, table

BLANKS = b" \t\n\x0b\x0c\r"
#: Filters of up to so many bytes in all are broadcast; beyond it, line occurrences are dealt to the shards' tasks.
BROADCAST_BYTES = 16 << 20
KEYS_PER_SHARD = 100_000
#: Occurrences of a shard's keys that one task asks a filter, where filters are not broadcast.
PART_ROWS = 500_000
#: Up to so many keys (16 bytes each) of at least the limit are broadcast.
BROADCAST_KEYS = 500_000
#: A shard's filter that is fuller than this is built again, larger.
FULL = 0.85


class Cuckoo:
    """Buckets of four 16-bit fingerprints. A key (two 64-bit halves) has a bucket and an alternative one."""

    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.slots = np.zeros((buckets, 4), np.uint16)
        self.overflow: list[tuple[int, int]] = []

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / 4 / 0.85)))))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = len(self.slots) - 1
        print_ = ((np.asarray(k1, np.int64).view(np.uint64) >> np.uint64(7)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (np.asarray(k2, np.int64).view(np.uint64) & np.uint64(mask)).astype(np.int64)
        return print_, first, self.other(first, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.int64) * 0x5BD1E995 >> 3)) & (len(self.slots) - 1)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        f, a, b = self.places(k1, k2)
        found = (self.slots[a] == f[:, None]).any(1) | (self.slots[b] == f[:, None]).any(1)
        if self.overflow:
            bucket, p = np.array(self.overflow, np.int64).T
            spilled = np.concatenate([bucket * 65536 + p])
            found |= np.isin(a * 65536 + f, spilled) | np.isin(b * 65536 + f, spilled)
        return found

    def load(self) -> float:
        """The share of slots in use; above 1 where keys overflowed."""
        return float((self.slots != 0).mean()) + bool(self.overflow)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        f, a, b = self.places(k1, k2)
        slots = self.slots
        for p, x, y in zip(f.tolist(), a.tolist(), b.tolist()):
            bucket, kicks = x, 0
            while True:
                for at in (bucket, y) if not kicks else (bucket,):
                    free = np.flatnonzero(slots[at] == 0)
                    if len(free):
                        slots[at, free[0]] = p
                        break
                else:
                    if kicks == 200:
                        self.overflow.append((bucket, p))
                        break
                    victim = kicks & 3
                    p, slots[bucket, victim] = int(slots[bucket, victim]), p
                    bucket = int(self.other(np.array([bucket]), np.array([p], np.uint16))[0])
                    kicks += 1
                    continue
                break

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that were added; of equal fingerprints in one bucket it does not matter which goes."""
        f, a, b = self.places(k1, k2)
        for p, x, y in zip(f.tolist(), a.tolist(), b.tolist()):
            for at in (x, y):
                hit = np.flatnonzero(self.slots[at] == p)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break
            else:
                for at in (x, y):
                    if (at, p) in self.overflow:
                        self.overflow.remove((at, p))
                        break

    def pack(self) -> bytes:
        extra = b"".join(struct.pack("<qq", *x) for x in self.overflow)
        return struct.pack("<qq", len(self.slots), len(self.overflow)) + self.slots.tobytes() + extra

    @classmethod
    def unpack(cls, blob: bytes) -> Cuckoo:
        buckets, extra = struct.unpack_from("<qq", blob)
        out = cls(buckets)
        out.slots = np.frombuffer(blob, np.uint16, buckets * 4, 16).reshape(buckets, 4).copy()
        out.overflow = [struct.unpack_from("<qq", blob, 16 + buckets * 8 + 16 * i) for i in range(extra)]
        return out


def line_keys(text: str | None) -> list[bytes]:
    """The stripped, lower-cased lines, as UTF-8."""
    return [x.strip(BLANKS) for x in (text or "").encode().lower().split(b"\n")]


def _digest(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, k1, k2): the distinct keys of at least ``min_chars`` code points of each row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, found = [], []
            for row, text in enumerate(batch.column(1)):
                new = {_digest(k) for k in line_keys(text.as_py()) if _long_enough(k, min_chars)}
                ids += [row] * len(new)
                found += new
                if len(found) > 100_000:
                    yield _occurrences(batch, ids, found)
                    ids, found = [], []
            yield _occurrences(batch, ids, found)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long")


def _occurrences(batch: pa.RecordBatch, rows: list[int], keys: list[tuple[int, int]]) -> pa.RecordBatch:
    halves = np.array(keys, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "k1", "k2"])


@dataclass(frozen=True)
class State:
    """``counts``: (k1, k2, n_docs), exact. ``filters``: (shard, blob) over the keys of at least ``min_docs``."""

    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int


def _counted(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, n_docs). Rows with one doc_id are one document; rows without doc_id are one document, too."""
    return occurrences(docs, min_chars).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"))


def _shard(n: int):
    return F.pmod(F.xxhash64("k1"), F.lit(n)).cast("int").alias("shard")


def _build(frames: pd.DataFrame) -> pd.DataFrame:
    own = Cuckoo.sized(len(frames) + len(frames) // 4)
    own.add(frames.k1.to_numpy(), frames.k2.to_numpy())
    return pd.DataFrame({"shard": [int(frames.shard.iloc[0])], "blob": [own.pack()]})


def _filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """The filters over the keys of at least ``min_docs``, and their number of shards."""
    known = counts.where(F.col("n_docs") >= min_docs)
    n = max(1, -(-known.count() // KEYS_PER_SHARD))
    return cut(known.select(_shard(n), "k1", "k2").groupBy("shard").applyInPandas(_build, "shard int, blob binary")), n


def new_state(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> State:
    """The state after inserting ``docs`` into nothing. Rows with one doc_id are one document; null texts have one empty line; an empty table gives an empty state."""
    counts = cut(_counted(docs, min_chars))
    return State(counts, *_filters(counts, min_docs), min_docs, min_chars)


def _moved(state: State, docs: DataFrame, sign: int) -> State:
    change = _counted(docs, state.min_chars).select("k1", "k2", (F.col("n_docs") * sign).alias("n_docs"), F.lit(0).cast("long").alias("before"))
    both = state.counts.select("k1", "k2", "n_docs", F.col("n_docs").alias("before")).unionByName(change)
    sums = cut(both.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.sum("before").alias("before")))
    counts = sums.where("n_docs > 0").drop("before")
    crossing = sums.where((F.col("n_docs") >= state.min_docs) != (F.col("before") >= state.min_docs))
    moves = cut(crossing.select(_shard(state.n_shards), "k1", "k2", (F.col("n_docs") >= state.min_docs).alias("enters")))
    # A shard that gains as many keys as it was sized for is built again from the counts, with more shards.
    if moves.where("enters").groupBy("shard").count().where(F.col("count") > KEYS_PER_SHARD // 4).isEmpty():

        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            own = Cuckoo.unpack(old.blob.iloc[0]) if len(old) else Cuckoo.sized(len(new) * 2)
            gone, come = new[~new.enters.astype(bool)], new[new.enters.astype(bool)]
            own.remove(gone.k1.to_numpy(np.int64), gone.k2.to_numpy(np.int64))
            room = own.slots.size * FULL - (own.slots != 0).sum()
            if len(come) <= room:
                own.add(come.k1.to_numpy(np.int64), come.k2.to_numpy(np.int64))
            return pd.DataFrame({"shard": [int((old if len(old) else new).shard.iloc[0])], "blob": [own.pack()], "load": [own.load() if len(come) <= room else 2.0]})

        made = cut(state.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard int, blob binary, load double"))
        if made.where(F.col("load") > 1).isEmpty():
            return State(counts, made.drop("load"), state.n_shards, state.min_docs, state.min_chars)
    return State(counts, *_filters(counts, state.min_docs), state.min_docs, state.min_chars)


def insert(state: State, docs: DataFrame) -> State:
    """The state with documents added. Their ids must be new to it."""
    return _moved(state, docs, 1)


def delete(state: State, docs: DataFrame) -> State:
    """The state without documents that were inserted before, with the texts they had."""
    return _moved(state, docs, -1)


def suspects(state: State, found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those line occurrences whose keys the filters know."""
    schema = found.schema
    size = state.filters.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("n")).first().n
    n = state.n_shards
    if size <= broadcast_bytes:
        blobs = {r.shard: bytes(r.blob) for r in state.filters.collect()}  # of proven size
        shared = found.sparkSession.sparkContext.broadcast(blobs)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: Cuckoo.unpack(b) for s, b in shared.value.items()}
            for batch in pieces(batches, 1 << 16):
                shard, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "k1", "k2"))
                hit = np.zeros(len(k1), bool)
                for s in np.unique(shard):
                    if s in filters:
                        own = shard == s
                        hit[own] = filters[s].has(k1[own], k2[own])
                yield batch.filter(pa.array(hit)).select(schema.names)

        return found.select(*schema.names, _shard(n)).mapInArrow(ask, schema)
    # Each shard's occurrences are dealt by document over as many tasks as their number asks for, each after the shard's filter.
    held = cut(found.select("*", _shard(n)))
    parts = held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("size"))
    dealt = join_sizes(held.withColumn("key", F.col("shard").cast("long")), "key", "doc_id", parts.select(F.col("shard").cast("long").alias("key"), "size"))
    rows = dealt.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("size")).cast("int").alias("part"), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("blob"), *schema.names)
    copies = state.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("part"), F.lit(0).alias("turn"), "blob", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def ask_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, None
        for batch in pieces(batches, 1 << 14):
            numbers, turns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "turn"))
            hit = np.zeros(batch.num_rows, bool)
            edges = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (turns[1:] != turns[:-1]), True]) if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:]):
                if turns[a] == 0:
                    own, shard = Cuckoo.unpack(batch.column("blob")[a].as_py()), numbers[a]
                elif shard == numbers[a]:
                    hit[a:b] = own.has(*(batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k1", "k2")))
            yield batch.filter(pa.array(hit)).select(schema.names)

    return copies.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn").mapInArrow(ask_in_turn, schema)


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys`` (k1, k2, size, ...), one row a key: by broadcast up to BROADCAST_KEYS, else with hot keys dealt by document."""
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        named = keys.select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), *[c for c in keys.columns if c not in ("k1", "k2")])
        return rows.join(F.broadcast(named), (F.col("k1") == F.col("__a")) & (F.col("k2") == F.col("__b"))).drop("__a", "__b")
    # The first half of a key nearly always names it; the second has the last word.
    named = keys.groupBy("k1").agg(F.sum("size").alias("size"), F.collect_list(F.struct("k2", *[c for c in keys.columns if c not in ("k1", "k2", "size")])).alias("of"))
    met = join_sizes(rows, "k1", "doc_id", named)
    return met.withColumn("own", F.expr("get(filter(of, x -> x.k2 = k2), 0)")).where("own is not null").select(*rows.columns, "size", *[F.col(f"own.{c}").alias(c) for c in keys.columns if c not in ("k1", "k2", "size")])


def drop_lines(docs: DataFrame, state: State, broadcast_bytes: int = BROADCAST_BYTES, spare_first: bool = False, text_name: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All columns of ``docs``, its text without the lines whose keys at least ``min_docs`` documents have, and two counts.

    Lines are split at line feeds; a null or empty text is one empty line, which is never dropped (its key is
    empty) and gives the empty text. What stays is joined by line feeds, as it was. Rows that share a doc_id lose lines
    by their own texts. With ``spare_first``, the smallest doc_id keeps such a line. Columns named like the two counts are
    replaced by them, so give other names to keep those. An empty table gives an empty table.
    """
    # Written first, so that one worker a task is enough for either function.
    doomed = suspects(state, cut(occurrences(docs, state.min_chars)), broadcast_bytes)
    exact = state.counts.where(F.col("n_docs") >= state.min_docs).select("k1", "k2", F.col("n_docs").alias("size"))
    doomed = _of_keys(doomed, exact).drop("size")
    if spare_first:
        doomed = cut(doomed)
        first = doomed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("__first"))
        doomed = _of_keys(doomed, first).where(~same(F.col("doc_id"), F.col("__first"))).drop("size", "__first")
    name = own_names(docs)
    by_doc = doomed.groupBy(F.col("doc_id").alias(name("id"))).agg(F.collect_set(F.struct("k1", "k2")).alias(name("gone")))
    rest = [c for c in docs.columns if c not in (text_name, n_lines, n_dropped)]
    joined = docs.join(by_doc, same(F.col("doc_id"), F.col(name("id"))), "left").select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.col(f"`{text_name}`").alias("t"), F.col(f"{name('gone')}.k1").alias("g1"), F.col(f"{name('gone')}.k2").alias("g2"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "t string, n long, d long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, total, lost = [], [], []
            for text, g1, g2 in zip(batch.column("t"), batch.column("g1"), batch.column("g2")):
                whole = text.as_py() or ""
                if not g1.is_valid:
                    kept.append(whole)
                    total.append(whole.count("\n") + 1)
                    lost.append(0)
                    continue
                gone, lines = set(zip(g1.as_py(), g2.as_py())), whole.split("\n")
                stays = [x for x, k in zip(lines, line_keys(whole)) if not k or _digest(k) not in gone]
                kept.append("\n".join(stays))
                total.append(len(lines))
                lost.append(len(lines) - len(stays))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*(f"k{i}" for i in range(len(rest))), "t", "n", "d"])

    out = joined.mapInArrow(run, schema)
    where = {c: f"k{i}" for i, c in enumerate(rest)} | {text_name: "t"}
    return out.select(*[F.col(where[c]).alias(c) for c in docs.columns if c in where], F.col("n").alias(n_lines), F.col("d").alias(n_dropped))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(docs, new_state(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE key IN (FROM hot))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (FROM hot)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

QUERIES: dict[str, Callable] = {"op8_line_dedup": op8_line_dedup}
SQL: dict[str, str] = {"op8_line_dedup": OP8_SQL}
