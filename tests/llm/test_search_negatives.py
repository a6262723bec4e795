"""Ranked search, rank-file BPE and hard negatives, against brute force and the library."""

import base64
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from factloom.llm import bpe, lines, mixing, neardup, negatives, pipeline, rank_bpe, search, sharding
from factloom.llm.common import join_sizes

RANKS = bpe.public_path("byte_bpe_multi_50k.tiktoken")


def plain_search(docs, items, k):
    low = lambda t: re.findall(search.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, low(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(low(t))
    df = {t: sum(t in set(x) for _, x in own) for s in asked.values() for t in s}
    out = []
    for i, terms in asked.items():
        scored = []
        for d, t in own:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in terms)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 40])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    if blocks > 1:  # few terms a block of queries, small leaves: other paths, same rows
        monkeypatch.setattr(search, "QUERY_TERMS", 5)
        monkeypatch.setattr(search, "RANGE", 16)
        monkeypatch.setattr(search, "LEAF", 2)
        monkeypatch.setattr(search, "FANOUT", 2)
    rng = random.Random(1)
    words = ["Der", "the", "THE", "día", "été", "x1", "42", "zebra", "ß", "日本"] + [f"w{i}" for i in range(30)]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice([4, 40])]) for _ in range(rng.randrange(0, 30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "., !"), (None, "zebra zebra"), (None, "zebra zebra"), (203, "the " * 20_000), (5, docs[5][1]), (204, docs[5][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, "zebra"), (0, "42 ZEBRA"), (None, "été 42")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, score int").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc string")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.search(d, q).collect()), key=repr)
    assert got == plain_search(docs, items, 10)
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0


def test_trees_skip_leaves_and_lose_nothing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 6, 4096)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([rng.choice(50, n, replace=False) for n in sizes])
    impact = (rng.pareto(1.5, len(terms)) * 1000).astype(np.int64) + 1
    part = search.Range(np.arange(4096), np.ones(4096, bool), starts, terms, impact)
    asked, weight, found = np.array([3, 7, 60]), np.array([5, 2, 9]), []
    opened = part.search(asked, weight, 10, found)
    scores = [sum(int(i) * {3: 5, 7: 2}.get(int(t), 0) for t, i in zip(terms[a:b], impact[a:b])) for a, b in zip(starts, starts[1:])]
    assert found == sorted((-s, False, d) for d, s in enumerate(scores) if s)[:10]
    assert opened < 0.5 * part.levels[0].shape[1]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n  \n", "it's We'll I'D 'S", "a  b   c\t d\r\n", "日本語のテキスト と 漢字", "naïve café — «ça»", "🙂🙃 👩‍👩‍👧", "x" * 3000, "ab" * 900 + " tail", "١٢٣ 4567890" * 20,
    "\x00\x1c\x1d \x85  z", "word " * 5000, "<|endoftext|> stays text", "Donaudampfschifffahrtsgesellschaftskapitän", "=" * 700, "".join(chr(c) for c in range(32, 1500)),
]


def test_ids_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "x y", 1, 2)] * 2, "doc_id long, text string, ids int, k0 int")
    out = rank_bpe.encode(docs, RANKS, ["doc_id", "k0"]).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        text = ("x y" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        assert list(r.ids) == library.encode_ordinary(text), text[:40]
        assert bytes(r.decoded) == text.encode() and r.k0 == 2
    assert rank_bpe.encode(docs.limit(0), RANKS, ["doc_id"]).count() == 0


def test_random_words_merge_as_in_the_library(library, monkeypatch):
    rng = random.Random(4)
    own = rank_bpe.RankBpe(RANKS)
    letters = "aeinrst áñ日🙂'0 \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(3000)] + ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (510, 512, 513, 9000)]
    want = [library.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_batch(texts)] == want
    monkeypatch.setattr(rank_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(rank_bpe, "CELLS", 64)
    assert [np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() for t in texts[:200]] == want[:200]
    word = regex.findall(r"\S+", texts[-1])[0].encode()
    assert own.merge_long(word[:400]) == own.merge_rows([word[:400]])[0]


def plain_negatives(rows, every, positives, k):
    sound = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, y, v in (r for r in sound if r[0] % every == 0):
        clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
        scored = [(clip(sum(p * q for p, q in zip(v, w))), i, z) for i, z, w in sound if len(w) == len(v)]
        for sp, p, _ in sorted(((s, i, z) for s, i, z in scored if z == y and i != a), key=lambda r: (-r[0], r[1]))[:positives]:
            fit = sorted(((s, i) for s, i, z in scored if z != y and 30 * sp <= 100 * s <= 90 * sp), key=lambda r: (-r[0], r[1]))
            out += [(a, p, rank, i, sp, s) for rank, (s, i) in enumerate(fit[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", min(block, 500))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in np.float32(centres[i % 6] * 0.2 + rng.normal(size=8) * 0.1)]) for i in range(300)]
    rows += [(400 + i, 1, rows[1][2]) for i in range(60)]  # one vector many times: ties at the k-th score
    rows += [(500, None, rows[0][2]), (501, 1, None), (502, 2, [1.0, None] * 4), (503, 0, [float("nan")] * 8), (504, 0, [float("inf")] * 8), (None, 1, rows[3][2]), (510, 1, [0.0] * 8), (520, 2, [0.0] * 8)]
    rows += [(600, 1, [0.5, 0.5]), (610, 1, [0.5, 0.25]), (611, 2, [0.25, 0.25]), (620, 3, []), (7, rows[7][1], rows[7][2])]
    rows += [(700, 9, [1e30, 1.0]), (701, 9, [1e30, 2.0]), (702, 8, [2e8, 3.0]), (710, 9, [3e9, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, row int, d string")
    got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(negatives.usable(df, "vec_id", "label", "embedding"), every=10).collect()]
    as_float = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert sorted(got) == plain_negatives(as_float, 10, 5, 10)
    assert negatives.mine(negatives.usable(df.limit(0), "vec_id", "label", "embedding")).count() == 0


INNER = ["__slot", "__owner", "__key_slot", "__source", "__rate", "__point", "__cdf", "__block", "__id", "__gone", "__n_lines", "__copy", "__k", "slot_", "gone_", "id_", "copy_", "n_", "order__", "c0", "k0", "t", "g1", "n_lines_"]


def test_no_inner_name_can_clash(spark):
    """Every operator and stage that gives all columns back gets them all, with their values."""
    rows = [(i, f"some words of text {i % 7}\nshared line\nmore {i}", "en", f"s{i % 3}", 10) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in INNER:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    kept = lambda out: out.count() > 0 and out.where(" or ".join(f"{c} is null or {c} <> concat('{c}', doc_id)" for c in INNER)).isEmpty()
    assert kept(sharding.place(docs, "doc_id", ["a", "b"], 101))
    assert kept(mixing.mix(docs))
    assert kept(lines.drop_lines(docs, lines.new_state(docs)))
    assert kept(neardup.drop_near_duplicates(docs))
    sizes = spark.createDataFrame([("s0", 10), ("s1", 10), ("s2", 10)], "source string, size long")
    assert kept(join_sizes(docs, "source", "doc_id", sizes))
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and kept(out), name


def test_crowd_is_compared_in_pairs_of_blocks(spark, monkeypatch):
    """A node too large for a task, at the last level: its links are exact all the same."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):  # each far enough from all others, but every sixth has a near copy
        text = list(base)
        for at in rng.sample(range(120), 9):
            text[at] = f"u{i}_{at}"
        rows.append((i, " ".join(text)))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join(text[:-1] + ["end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, r[0], r[0], 5) for r in rows], "node long, rep long, comp long, parts int")
    found = {(r.u, r.v) for r in neardup.exhaust(ids, docs, neardup.Join(words=3, percent=85)).collect()}
    assert found == {(i, 1000 + i) for i in range(0, 240, 6)}


def test_words_of_any_length_follow_one_rule():
    """A word's subwords are its distinct n-grams of 3 to 5 characters and the word, however long it is."""
    from zlib import crc32

    from factloom.llm import toxicity

    for word in ("a", "aaaa", "x" * 63, "x" * 64, "ab" * 60, "abc" * 30_000):
        w = f"<{word}>"
        assert toxicity.subwords(word) == sorted({crc32(x.encode()) % toxicity.BUCKETS for x in [w[i : i + k] for k in (3, 4, 5) for i in range(len(w) - k + 1)] + [w]})
