"""Sharding, chat windows, quality rules and mixing, on small tables."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import chat, mixing, quality, sharding


def test_lookup_table_is_balanced_and_stable():
    a = sharding.lookup_table(sharding.shard_names(10), 10_007)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    b = sharding.lookup_table(sharding.shard_names(9), 10_007)
    stayed = a != 9
    assert (a[stayed] == b[stayed]).mean() > 0.75  # few rows move besides the lost shard's
    for bad in (10_000, 7):
        with pytest.raises(ValueError):
            sharding.lookup_table(sharding.shard_names(10), bad)


def plain_table(names, slots):
    """Shards claim slots in turn, each by a list of its whole permutation."""
    orders = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        first, stride = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        orders.append([(first + k * stride) % slots for k in range(slots)])
    owner, at = {}, [0] * len(names)
    while len(owner) < slots:
        for k, order in enumerate(orders):
            while at[k] < slots and order[at[k]] in owner:
                at[k] += 1
            if at[k] < slots:
                owner[order[at[k]]] = k
    return [owner[s] for s in range(slots)]


def test_lookup_table_equals_plain_filling():
    for names, slots in ((sharding.shard_names(7), 211), (["a"], 2), (["x", "y", "z"], 3)):
        assert sharding.lookup_table(names, slots).tolist() == plain_table(names, slots)


def test_placing_rows(spark):
    docs = spark.createDataFrame([(i, "x", i) for i in range(500)] + [(None, "y", 1), (None, "z", 2), (7, "x", 7)], "doc_id long, text string, slot long")
    out = sharding.place(docs, "doc_id", sharding.shard_names(5), 1009)
    rows = out.collect()
    assert len(rows) == 503 and set(out.columns) == {"doc_id", "text", "slot", "shard"}
    owner = sharding.lookup_table(sharding.shard_names(5), 1009)
    assert all(r.shard == f"shard-{owner[r.slot]:04d}" for r in rows)
    for r in rows:
        h = xxhash.xxh64_intdigest("" if r.doc_id is None else str(r.doc_id), 42)
        assert r.slot == (h if h < 2**63 else h - 2**64) % 1009
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.place(docs.limit(0), "doc_id", ["only"], 1009).count() == 0


def test_writing_shards(spark, tmp_path):
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    sharding.write_shards(sharding.place(docs, "doc_id", sharding.shard_names(3), 1009), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


TURNS = [
    (1, 0, "system", "be <|im_start|> kind"), (1, 1, "user", "hi " * 900), (1, 2, "assistant", "ok <\\| then"), (1, 3, "user", "more " * 500), (1, 4, "assistant", None),
    (1, 5, "assistant", "end<|im_end|>"), (2, None, None, ""), (2, 3, "assistant", "a"), (2, 3, "assistant", "a"), (None, 0, "we%ird\nrole<", "x"), (3, 0, "user", "y" * 9000),
] + [(9, i, "assistant" if i % 2 else "user", f"turn {i} " + "w " * (i % 7)) for i in range(700)]


def plain_windows(turns, budget=1024, history_turns=4, history_budget=256):
    """(start, stop, history, system) of one conversation's windows by a walk over its turns (head + body + end, role)."""
    tok = [math.ceil(len(text.encode()) / 4) for text, _ in turns]
    sys = next((i for i, (_, role) in enumerate(turns) if role == "system"), None)
    room = max(1, budget - history_budget - (tok[sys] if sys is not None else 0))
    out, start, used = [], 0, 0
    for i, n in enumerate(tok + [None]):
        if n is None or i > start and used + n > room:
            history = [j for j in range(max(0, start - history_turns), start) if sum(tok[j:start]) <= history_budget and j != sys]
            out.append((start + 1, i, len(history) + (sys is not None and not start <= sys < i)))
            start, used = i, 0
        used += n or 0
    return out


def test_chat_windows_round_trip(spark):
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(turns)
    read = chat.read_back(made).orderBy("conv_id", "window").collect()
    expected = {}
    for c, n, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, t[1] if t[1] is not None else -1, t[2] or "", t[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    head = lambda role: "<|im_start|>" + role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C") + "\n"
    for c, said in expected.items():
        own = [r for r in read if r.conv_id == c]
        assert [(t.role, t.text) for r in own for t in r.turns] == said
        assert [x for r in own for x in r.targets] == [x for role, x in said if role == "assistant"]
        shaped = [(head(role) + re.sub(r"<(\\*)\|", r"<\\\1|", text) + "<|im_end|>\n", role) for role, text in said]
        assert [(r.window, r.window + r.n_turns - 1, r.n_context) for r in own] == plain_windows(shaped)
    for r in read:
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_context + r.n_turns
        assert r.n_tokens <= 1024 or r.n_turns == 1
    repeated = [r for r in read if r.conv_id == 1][1:]
    assert repeated and all(r.formatted.startswith("<|im_start|>system\nbe <\\|im_start|> kind") for r in repeated)
    assert all(r.n_context > 0 for r in read if r.conv_id == 9 and r.window > 1)  # history crosses segments
    assert chat.windows(turns.limit(0)).count() == 0


def test_thousands_of_rows_of_one_turn_number(spark):
    rows = [(1, None if i % 2 else 7, "user" if i % 3 else "assistant", f"said {i:05d} " + "x " * (i % 40)) for i in range(5000)]
    made = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("window").collect()
    said = sorted(rows, key=lambda t: (-1 if t[1] is None else t[1], t[2], t[3]))
    assert [(t.role, t.text) for r in made for t in r.turns] == [t[2:] for t in said]
    shaped = [(f"<|im_start|>{role}\n{text}<|im_end|>\n", role) for _, _, role, text in said]
    assert [(r.window, r.window + r.n_turns - 1, r.n_context) for r in made] == plain_windows(shaped)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t", "a b c d", "a b c d e " * 3, "a b c d e a b c d e", "x # $ |\nx # $ |\n\nx # $ |", "word\xa0one é　ß " * 4, "z " * 9000, "the cat of and " * 30]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, None, 5)], "doc_id long, text string, n_words int")
    rows = quality.quality(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality(docs.limit(0)).count() == 0


def poisson(rate, u):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing_inverts_poisson(spark):
    rows = [(i, "x" * (10 if i % 3 else 100), "big" if i % 3 else "small", 1) for i in range(3000)] + [(None, None, None, 2), (5, "", "empty", 3), (3000, "x" * 50, "small", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    weights = {"big": 3.0, "small": 1.0}
    out = mixing.mix(docs, weights).collect()
    size = {"big": 10 * 2000, "small": 100 * 1000 + 50}
    total = sum(size.values())
    want = 0
    for i, t, s, _ in rows:
        rate = total * weights[s] / 4 / size[s] if s in size else 1.0
        u = int(hashlib.md5(f"mix-1|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n = poisson(rate, u)
        want += n
        assert sum(r.doc_id == i and r.source == s for r in out) == n if i in (None, 5, 17, 18, 3000) else True
    assert len(out) == want and all(1 <= r.copy <= r.n_copies for r in out)
    share = sum(len(r.text) for r in out if r.source == "big") / sum(len(r.text or "") for r in out)
    assert abs(share - 0.75) < 0.03
    assert mixing.mix(docs.limit(0)).count() == 0


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 10, f"s{i % 7}") for i in range(400)] + [(1000, "y", None)], "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == few


def test_tiny_source_beside_a_huge_one_is_drawn_in_parts(spark):
    rows = [(i, "x" * 1000, "huge") for i in range(9000)] + [(9000, "y", "tiny"), (9001, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, total = {"huge": 9_000_000, "tiny": 1, None: 1}, 9_000_002
    # default weights: a rate of about 2,997; given weights: one of 2,250,000.5, over 4,501 parts
    for weights in (None, {"huge": 3.0, "tiny": 1.0}):
        weight = {s: math.sqrt(n) if weights is None else weights.get(s, 0.0) for s, n in sizes.items()}
        out = mixing.mix(docs, weights)
        counts = {r.doc_id: r for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.max("n_copies").alias("n_copies")).collect()}
        for i, s in [(0, "huge"), (1, "huge"), (9000, "tiny"), (9001, None)]:
            rate = total * weight[s] / sum(weight.values()) / sizes[s]
            parts = max(1, math.ceil(rate / 500))
            names = [f"mix-1|{i}"] + [f"mix-1|{i}|{k}" for k in range(2, parts + 1)]
            want = sum(poisson(rate / parts, int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52) for x in names)
            got = tuple(counts[i])[1:] if i in counts else (0,) * 5
            assert got == ((want, want, 1, want, want) if want else (0,) * 5)
            assert abs(want - rate) <= 6 * math.sqrt(rate)
