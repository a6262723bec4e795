"""Byte-level BPE from a file of ranks, merging many words at once in padded matrices.

A word (a match of the split pattern) that is an entry itself is that token. Other words are put, by length, into
matrices of token ids, one row a word, padded to the bucket's width. Each round every row merges its leftmost pair of
least rank, so every row, and the matrix, becomes one column narrower; a row without a pair left is done and leaves
the matrix. The rank of a pair comes from one hash table, looked up for whole columns, and each round only the two
pairs beside the merged one are looked up again. Each distinct word is worked out once and remembered up to a bound.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPLIT, by_size, public_path
from .common import pieces, table

#: Words and stretches remembered by a worker before it starts afresh, and cells of one matrix.
REMEMBERED, CELLS = 300_000, 1 << 20
#: Longer words, in bytes, are merged one by one with a heap: a matrix takes as many rounds as a word has merges.
LONGEST_ROW = 512
#: The rank of a pair that is no entry.
NONE = np.int32(2**31 - 1)
#: Before a single space between two characters that are not white space: no word crosses it.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class PairTable:
    """Ranks of pairs of ids by open addressing with linear probing, asked for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 3 * len(left))))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, left_over = self._key(left, right), np.arange(len(left))
        slot = self._slot(key)
        while len(left_over):
            free = self.keys[slot[left_over]] < 0
            taken, first = np.unique(slot[left_over[free]], return_index=True)
            chosen = left_over[free][first]
            self.keys[taken], self.ranks[taken] = key[chosen], rank[chosen]
            left_over = np.setdiff1d(left_over, chosen, assume_unique=True)
            slot[left_over] = (slot[left_over] + (self.keys[slot[left_over]] >= 0)) & ((1 << self.bits) - 1)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it is no entry or where an id is the padding, -1."""
        out = np.full(len(left), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left[at], right[at])
        slot = self._slot(key)
        while len(at):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class RankBpe:
    def __init__(self, path: str, pattern: str = SPLIT):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte must have a rank")
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*cuts)) if cuts else (np.empty(0, np.int64),) * 3
        self.table = PairTable(left, right, rank.astype(np.int32))
        self.split = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; the words are of similar length."""
        width = max(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        own, out = np.arange(len(words)), [b""] * len(words)
        while len(own):
            rows = np.arange(len(own))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            best = ranks[rows, at] if ranks.shape[1] else np.full(len(own), NONE)
            done = best == NONE
            if done.any():
                finished = ids[done]
                some = finished >= 0
                flat, ends = finished[some].astype("<u4").tobytes(), np.cumsum(some.sum(1)) * 4
                for i, a, b in zip(own[done], [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = flat[a:b]
                ids, ranks, own, at, best = ids[~done], ranks[~done], own[~done], at[~done], best[~done]
                if not len(own):
                    break
                rows = np.arange(len(own))
            ids[rows, at] = best
            columns = np.arange(ids.shape[1])
            ids = ids[columns != at[:, None] + 1].reshape(len(own), -1)
            ranks = ranks[columns[:-1] != at[:, None]].reshape(len(own), -1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            ranks[before, at[before] - 1] = self.table.find(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.table.find(ids[after, at[after]], ids[after, at[after] + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The same ids for one word of any length: pairs wait in a heap by rank, then by place."""
        part, n, rank = [word[i : i + 1] for i in range(len(word))], len(word), self.ranks.get
        left, right = list(range(-1, n - 1)), [*range(1, n), n]
        waiting = [(r, i, 2) for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, size = heapq.heappop(waiting)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since; the bytes from i on are the same, so the size tells
            part[i], part[j] = part[i] + part[j], b""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(part[i] + part[k])) is not None:
                    heapq.heappush(waiting, (r, i, size + len(part[k])))
            if (h := left[i]) >= 0 and (r := rank(part[h] + part[i])) is not None:
                heapq.heappush(waiting, (r, h, size + len(part[h])))
        return np.array([self.ranks[p] for p in part if p], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of each word into ``self.words``."""
        buckets: dict[int, list[str]] = {}
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONGEST_ROW:
                self.words[word] = self.merge_long(raw)
            else:
                buckets.setdefault(-(-len(raw) // 4), []).append(word)
        for width, some in buckets.items():
            most = CELLS // (4 * width)
            for start in range(0, len(some), most):
                part = some[start : start + most]
                self.words.update(zip(part, self.merge_rows([w.encode() for w in part])))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cuts = [_CUT.split(t) if t else [] for t in texts]
        known = self.stretches
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*cuts).difference(known)
        if new:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            found = {s: self.split.findall(s) for s in new}
            self.encode_words(list(set().union(*found.values()).difference(self.words)))
            words = self.words
            known.update((s, b"".join([words[w] for w in p])) for s, p in found.items())
        return [b"".join([known[s] for s in c]) for c in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> RankBpe:
    return RankBpe(path)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids`` (array of int) and ``decoded`` (the ids' bytes), for every row.

    Null and empty texts give no ids and no bytes. Every row gives one: repeated rows and rows without id, too; an empty
    table gives an empty table; columns not in ``keep`` may have any name. Texts and words of any length are encoded
    whole. The file of ranks at ``path`` must be on every machine.
    """
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    names = [*(f"k{i}" for i in range(len(keep))), "ids", "decoded"]
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "ids array<int>", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            at = 0
            for texts in by_size(batch.column(len(keep)).to_pylist()):
                ids = [np.frombuffer(b, "<i4") for b in bpe.encode_batch(texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array([bpe.decode(x) for x in ids], pa.binary())], names=names)

    return chosen.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: the number of ids, and the SHA-256 of the ids in decimal and of the decoded bytes."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_multi_50k.tiktoken"), ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable] = {"op12_rank_bpe": op12_rank_bpe}
SQL: dict[str, str] = {}
