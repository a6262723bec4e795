"""Byte-level BPE by speculating and verifying.

Words (the pre-tokenizer's pieces) are first cut greedily into the longest vocabulary entries. A cut is the true
encoding exactly if every token of it encodes to itself and every adjacent pair of tokens is compatible: the text of
the pair, merged by rank, gives back the pair. All pairs of a batch of words are looked up at once in a sorted array
of verdicts; a pair not seen before is settled by merging its few bytes. Only words that hold an incompatible pair are
merged exactly. Each distinct stretch of text between single spaces is worked out once and remembered up to a bound.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, pieces, table

#: The split pattern of byte-level pre-tokenizers (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries remembered by a worker before it starts afresh, and code points of text handled at once.
REMEMBERED, AT_ONCE = 400_000, 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["model"].get("dropout") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("this tokenizer normalises texts, splits them otherwise than by the byte-level pattern, or does not follow its merges")
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda letters: bytes(of_letter[c] for c in letters)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.ids = {as_bytes(k): i for k, i in vocab.items() if all(c in of_letter for c in k)}
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(SPLIT)
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Tokens that do not encode to themselves are never proposed.
        self.usable = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merge(t) == [t]}
        self.verdict_keys, self.verdict_values = np.empty(0, np.int64), np.empty(0, bool)
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.exactly_merged = self.proposed = 0

    def merge(self, word: bytes) -> list[bytes]:
        """The exact encoding: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        rank, none = self.rank.get, 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def merge_long(self, word: bytes) -> list[bytes]:
        """The same encoding with a heap: n log n for a word of any length."""
        import heapq

        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := self.rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := left[i]) >= 0 and (r := self.rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p is not None]

    def propose(self, word: bytes) -> list[int]:
        out, at, end, usable, longest = [], 0, len(word), self.usable.get, self.longest
        while at < end:
            stop = min(end, at + longest)
            while (token := usable(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether it may stand in an encoding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        known = self.verdict_keys
        at = np.searchsorted(known, keys)
        new = np.unique(keys[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != keys)]) if len(known) else np.unique(keys)
        if len(new):
            pair = lambda k: [self.bytes_of[int(k) >> 32], self.bytes_of[int(k) & 0xFFFFFFFF]]
            verdicts = np.fromiter((self.merge(b"".join(p)) == p for p in map(pair, new)), bool, len(new))
            if len(known) > 1_000_000:
                known, self.verdict_values, new = known[:0], self.verdict_values[:0], np.unique(keys)
                verdicts = np.fromiter((self.merge(b"".join(p)) == p for p in map(pair, new)), bool, len(new))
            keys_all, values_all = np.concatenate([known, new]), np.concatenate([self.verdict_values, verdicts])
            order = np.argsort(keys_all, kind="stable")
            self.verdict_keys, self.verdict_values = keys_all[order], values_all[order]
            at = np.searchsorted(self.verdict_keys, keys)
        return self.verdict_values[at]

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of each word, as little-endian 32-bit integers, into ``self.words``."""
        raw = [w.encode() for w in words]
        cuts = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((i for c in cuts for i in c), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(cuts)), lengths)
        inside = word_of[1:] == word_of[:-1]
        good = np.ones(len(cuts), bool)
        if inside.any():
            good[word_of[1:][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])]] = False
        self.proposed += len(cuts)
        for i in np.flatnonzero(~good):
            tokens = self.merge(raw[i]) if len(raw[i]) <= 48 else self.merge_long(raw[i])
            cuts[i] = [self.ids[t] for t in tokens]
            self.exactly_merged += 1
        self.words.update((w, np.array(c, "<u4").tobytes()) for w, c in zip(words, cuts))

    def stretches_of(self, text: str) -> list[str]:
        """``text`` cut before every single space between two characters that are not white space: words never cross it."""
        if not text:
            return []
        if _WIDE.search(text):
            return [x for x in _CUT.split(text) if x]
        head, *rest = text.split(" ")
        return [*([head] if head else []), *(" " + x for x in rest)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each text, in which special strings are ordinary text."""
        cuts = [self.stretches_of(p) for p in parts]
        known = self.stretches
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*cuts).difference(known)
        if new:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            pieces = {s: self.split.findall(s) for s in new}
            missing = list(set().union(*pieces.values()).difference(self.words))
            if missing:
                self.encode_words(missing)
            words = self.words
            known.update((s, b"".join([words[w] for w in p])) for s, p in pieces.items())
        return [b"".join([known[s] for s in c]) for c in cuts]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; special strings inside texts are their tokens, as the tokenizer's default has it."""
        split = [self.specials.split(t) if self.specials else [t] for t in texts]
        parts = iter(self.encode_parts([p for s in split for p in s[::2]]))
        return [b"".join(next(parts) if k % 2 == 0 else np.array([self.special[p]], "<u4").tobytes() for k, p in enumerate(s)) for s in split]

    def decode(self, ids: bytes) -> str:
        table_of_bytes = self.bytes_of
        return b"".join([table_of_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_WIDE = re.compile(r" (?:\s|(?<=\s ))")
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def by_size(texts: Iterable[str | None], most: int = AT_ONCE) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about ``most`` code points; a longer text makes a list of its own."""
    some, size = [], 0
    for t in texts:
        t = t or ""
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", decode: bool = True, forget: bool = False) -> DataFrame:
    """The columns ``keep`` with ``ids`` (little-endian 32-bit integers) and, if asked for, ``decoded``, for every row.

    Null and empty texts give no ids. Every row gives one: repeated rows and rows without id, too; an empty table gives an
    empty table; columns not in ``keep`` may have any name. Texts and words of any length are encoded whole, a failing word of n
    bytes by exact merging in at most n rounds. The tokenizer's file at ``path`` must be on every machine. Workers keep the
    tokenizer and its words from task to task, or with ``forget`` only for one, which leaves more memory to other stages.
    """
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    made = [("ids", "binary"), *([("decoded", "string")] if decode else [])]
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{n} {t}" for n, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            at = 0
            for texts in by_size(batch.column(len(keep)).to_pylist()):
                ids = bpe.encode_batch(texts)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                extra = [pa.array(ids, pa.binary())] + ([pa.array([bpe.decode(x) for x in ids], pa.string())] if decode else [])
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns + extra, names=[*(f"k{i}" for i in range(len(keep))), *(n for n, _ in made)])
        if forget:
            del bpe
            load.cache_clear()
            give_back()

    return chosen.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in made])


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_50k.json"), ["doc_id"]))


QUERIES: dict[str, Callable] = {"op10_bpe_encoding": op10_bpe_encoding}
SQL: dict[str, str] = {}
