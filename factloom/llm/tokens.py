"""Exact token counts at every prefix, by dynamic programming over prefixes.

For a piece vocabulary merged by score, the encoding of a prefix ends in exactly one token t such that the encoding
of what stands before t is the stored encoding of that shorter prefix and its last token is compatible with t (the two
pieces' text, merged by score, gives back the two). So count[i] = count[i - len(t)] + 1 and last[i] = t, and one pass
over a text stores the exact count of every prefix. How many tokens a cut text would have, and which cut fits a
budget, is then read off without encoding again.

Pieces never lead from text into white space, so the pass works on stretches of a white space mark and the text up to
the next one; a stretch is worked out once and remembered up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_size, public_path
from .common import pieces, table

SPACE_MARK = "▁"
#: Stretches that a worker remembers the counts of, the longest of them, and the longest that it remembers all states of.
REMEMBERED, SHORT, STEM = 1_200_000, 60, 10
_STRETCH = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")


class Totals(dict):
    """What follows one white space mark, up to the next -> tokens with the mark, read off its last prefix when first met."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, rest: str) -> int:
        stretch = SPACE_MARK + rest
        if len(stretch) > SHORT:
            return int(self.counter._counts(stretch)[-1])
        if len(self) > REMEMBERED:
            self.clear()
        n = self[rest] = self.counter._states(stretch)[-1]
        return n


class PrefixCounter:
    """Counts as the library does for the model at ``path``, without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), i) for i in range(model.vocab_size())]
        self.score = {p: model.get_score(i) for p, i in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        crossing = [p for p in self.score if SPACE_MARK in p.lstrip(SPACE_MARK)]
        if crossing or model.encode("", out_type=int) or model.encode("² a 　ﬁ", out_type=str)[0][:1] != SPACE_MARK:
            raise ValueError("this model joins text across white space or normalises text")
        self.longest = max(map(len, self.score))
        # after[piece][before]: whether piece may follow before; only pieces that encode to themselves are ever last.
        self.after: dict[str, dict[str, bool]] = {p: {} for p in self.score if self.merge(p) == [p]}
        self.n_pairs = 0
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.totals = Totals(self)

    def merge(self, text: str) -> list[str]:
        """The exact pieces: join the adjacent pair of best score, leftmost first, until no join is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: str, piece: str) -> bool:
        if self.n_pairs > REMEMBERED:
            for verdicts in self.after.values():
                verdicts.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        out = self.after[piece][before] = self.merge(before + piece) == [before, piece]
        return out

    def prefixes(self, stretch: str, sizes: list[int], counts: list[int]) -> None:
        """Goes on from the states of a prefix to those of the whole stretch: for each end, last token's length and count.

        A character that is no piece counts as its UTF-8 bytes.
        """
        after, longest, fits = self.after, self.longest, self._fits
        for end in range(len(counts) + 1, len(stretch) + 1):
            start, lowest = end - 1, max(0, end - longest)
            while start >= lowest:
                piece = stretch[start:end]
                if piece in after:
                    if not start:
                        counts.append(1)
                        sizes.append(end)
                        break
                    before = stretch[start - sizes[start - 1] : start]
                    good = after[piece].get(before)
                    if good or (good is None and fits(before, piece)):
                        counts.append(counts[start - 1] + 1)
                        sizes.append(end - start)
                        break
                start -= 1
            else:
                counts.append((counts[end - 2] if end > 1 else 0) + len(stretch[end - 1].encode()))
                sizes.append(1)

    def _states(self, stretch: str) -> bytes:
        """Sizes, then counts, a byte for each prefix of a short stretch (at most 4 tokens a character); remembered.

        The pass goes on from the longest prefix that is remembered. Where no piece holds two neighbouring characters,
        the passes before and after them are independent.
        """
        known = self.known
        if (found := known.get(stretch)) is None:
            inside, n = self.inside, len(stretch)
            for i in (n - 1, stretch.rfind("\n") + 1) if stretch[-1].isalpha() else (n - 1, n - 2, n - 3, stretch.rfind("\n") + 1):
                if 0 < i < n and stretch[i - 1 : i + 1] not in inside:
                    head, tail = self._states(stretch[:i]), self._states(stretch[i:])
                    more, k = head[-1], n - i
                    found = head[:i] + tail[:k] + head[i:] + bytes([more + c for c in tail[k:]])
                    break
            else:
                sizes, counts = [], []
                for i in range(min(n - 1, STEM), 2, -1):
                    if (start := known.get(stretch[:i])) is not None:
                        sizes, counts = list(start[:i]), list(start[i:])
                        break
                self.prefixes(stretch, sizes, counts)
                found = bytes(sizes + counts)
            if n <= STEM:
                if len(known) > REMEMBERED // 2:
                    known.clear()
                known[stretch] = found
        return found

    def _counts(self, stretch: str) -> np.ndarray:
        """counts[i]: tokens of stretch[:i + 1]."""
        if len(stretch) <= SHORT:
            return np.frombuffer(self._states(stretch), np.uint8)[len(stretch) :].astype(np.int32)
        counts: list[int] = []
        self.prefixes(stretch, [], counts)
        return np.array(counts, np.int32)

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if SPACE_MARK * 2 in marked or marked[-1] == SPACE_MARK:
            return _STRETCH.findall(marked)
        return [SPACE_MARK + x for x in marked[1:].split(SPACE_MARK)]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its stretches' prefix tables."""
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE_MARK in text:
            return sum(int(self._counts(s)[-1]) for s in self.stretches(text))
        return sum(map(self.totals.__getitem__, text.split(" ")))

    def at_every_prefix(self, text: str) -> np.ndarray:
        """out[i]: tokens of text[:i], for i from 0 to len(text)."""
        out, base = [np.zeros(1, np.int32)], 0
        for k, s in enumerate(self.stretches(text)):
            counts = self._counts(s)
            out.append(base + (counts[1:] if k == 0 else counts))  # the first mark is the tokenizer's own
            base += int(counts[-1])
        return np.concatenate(out)

    def longest_within(self, text: str, limit: int, n_tokens: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, given the whole text's count."""
        if n_tokens <= limit:
            return len(text)
        # Counts of prefixes are not monotone: the last one within the limit is looked for.
        return int(np.flatnonzero(self.at_every_prefix(text) <= limit)[-1])


@lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, keep: list[str], limit: int = 4096, text: str = "text", prefixes: bool = False) -> DataFrame:
    """``keep`` with n_bytes, n_tokens, over_limit, fit_chars and, if asked for, prefix_counts, for every row.

    ``fit_chars`` is the length of the longest prefix of at most ``limit`` tokens. ``prefix_counts[i]`` is the exact
    token count of the first i code points. A null text counts as empty: no bytes, no tokens.
    Every row gives one, repeated rows and rows without id, too; an empty table gives an empty table. Columns of ``docs``
    that are not in ``keep`` may have any name. Texts of any length are read whole.
    """
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "n_bytes long, n_tokens long, fit_chars long", *(["prefix_counts array<int>"] if prefixes else [])])
    names = [*(f"k{i}" for i in range(len(keep))), "n_bytes", "n_tokens", "fit_chars", *(["prefix_counts"] if prefixes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in pieces(batches):
            at = 0
            for texts in by_size(batch.column(len(keep)).to_pylist()):
                counts = [counter.count(t) for t in texts]
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                at += len(texts)
                made = [
                    pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([counter.longest_within(t, limit, n) for t, n in zip(texts, counts)], pa.int64()),
                ]
                if prefixes:
                    made.append(pa.array([counter.at_every_prefix(t) for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns + made, names=names)

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars", *(["prefix_counts"] if prefixes else []))


def within_budget(counted: DataFrame, budget: str) -> DataFrame:
    """``counted`` (with prefix_counts) plus budget_chars: the longest prefix within the row's own ``budget`` tokens, without encoding.

    A null budget or a negative one, which not even the empty prefix keeps, gives null.
    """
    longest = F.expr(f"size(prefix_counts) - array_position(transform(reverse(prefix_counts), c -> c <= `{budget}`), true)")
    return counted.withColumn("budget_chars", F.when(F.col(f"`{budget}`") >= 0, longest))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and where a limit of 4,096 tokens would cut it."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("piece_bpe_32k.model"), ["doc_id"])


QUERIES: dict[str, Callable] = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
