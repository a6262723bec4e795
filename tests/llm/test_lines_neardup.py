"""Line deduplication and near duplicates, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import lines, neardup


def key(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return low.strip(" \t\n\x0b\x0c\r")


def plain(rows, min_docs):
    having = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            having.setdefault(k, set()).add(i)
    hot = {k for k, v in having.items() if len(v) >= min_docs}
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if key(x) not in hot), len((t or "").split("\n"))) for i, t in rows)


@pytest.fixture
def rows():
    rng = random.Random(5)
    pool = [f"Shared line {i}" for i in range(6)] + [f"unique {i} é" for i in range(40)]
    some = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return some + [(100, None), (101, ""), (102, "\n\n"), (103, "Shared line 1\r"), (104, "ÉCOLE"), (105, "école")]


def test_lines_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, g1 int")
    state = lines.new_state(docs, min_docs=10)
    want = plain(rows, 10)
    for bound in (lines.BROADCAST_BYTES, 0):
        out = lines.drop_lines(docs, state, broadcast_bytes=bound)
        assert sorted((r.doc_id, r.text, r.n_lines) for r in out.collect()) == want
    assert lines.drop_lines(docs.limit(0), state).count() == 0 and lines.new_state(docs.limit(0)).counts.count() == 0


def test_no_bound_changes_the_rows(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plainly = sorted(map(tuple, lines.drop_lines(docs, lines.new_state(docs), spare_first=True).collect()))
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(lines, "PART_ROWS", 7)
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 1)
    state = lines.new_state(docs)
    assert sorted((r.doc_id, r.text, r.n_lines) for r in lines.drop_lines(docs, state, broadcast_bytes=0).collect()) == plain(rows, 10)
    assert sorted(map(tuple, lines.drop_lines(docs, state, broadcast_bytes=0, spare_first=True).collect())) == plainly


def test_filters_grow_with_what_is_inserted(spark):
    few = spark.createDataFrame([(i, "one\ntwo") for i in range(3)], "doc_id long, text string")
    many = spark.createDataFrame([(10 + i, "\n".join(f"line {k}" for k in range(2000))) for i in range(3)], "doc_id long, text string")
    state = lines.insert(lines.new_state(few, min_docs=3), many)
    held = [lines.Cuckoo.unpack(bytes(r.blob)) for r in state.filters.collect()]
    assert all(f.load() <= 0.9 and not f.overflow for f in held) and sum(int((f.slots != 0).sum()) for f in held) == 2002
    assert {r.text for r in lines.drop_lines(many, state).collect()} == {""}


def test_insertion_and_deletion_are_reversible(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    state = lines.insert(lines.new_state(first, min_docs=10), second)
    whole = lines.new_state(docs, min_docs=10)
    table = lambda s: sorted(map(tuple, s.counts.collect()))
    assert table(state) == table(whole)
    assert sorted((r.doc_id, r.text) for r in lines.drop_lines(docs, state).collect()) == [x[:2] for x in plain(rows, 10)]
    back = lines.delete(state, second)
    assert table(back) == table(lines.new_state(first, min_docs=10))
    assert sorted((r.doc_id, r.text) for r in lines.drop_lines(first, back).collect()) == [x[:2] for x in plain([r for r in rows if r[0] < 30], 10)]


def test_first_document_may_be_spared(spark):
    docs = spark.createDataFrame([(i, f"same\nown {i}") for i in range(12)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.drop_lines(docs, lines.new_state(docs), spare_first=True).collect()}
    assert out[0] == "same\nown 0" and all(out[i] == f"own {i}" for i in range(1, 12))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**63), 2**63, (5000, 2))
    own = lines.Cuckoo.sized(5000)
    own.add(k[:, 0], k[:, 1])
    own = lines.Cuckoo.unpack(own.pack())
    assert own.has(k[:, 0], k[:, 1]).all()
    other = rng.integers(-(2**63), 2**63, (20000, 2))
    assert own.has(other[:, 0], other[:, 1]).mean() < 0.01
    own.remove(k[:2500, 0], k[:2500, 1])
    assert own.has(k[2500:, 0], k[2500:, 1]).all() and own.has(k[:2500, 0], k[:2500, 1]).mean() < 0.01
    tight = lines.Cuckoo(4)
    tight.add(k[:40, 0], k[:40, 1])  # more than it holds: the rest overflows
    assert tight.has(k[:40, 0], k[:40, 1]).all() and lines.Cuckoo.unpack(tight.pack()).overflow


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return Counter((d, len(s), low[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).title() if rng.random() < 0.2 else "\n".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One\ttwo"), (None, rows[0][1]), (None, None), (3, "w1 w2 w3 w4 w5 w6")]


@pytest.mark.parametrize("small,whole", [(32, 4096), (2, 4096), (2, 40)])
def test_components_equal_brute_force(spark, small, whole):
    rows = near_rows(small + whole)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string")
    how = neardup.Join(words=3, percent=85, small=small, whole=whole)
    out = neardup.near_duplicates(docs.select("doc_id", "text"), how).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_empty_tables_and_one_of_each_group(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e f", 2), (1, "A b c d e f", 2), (3, "", 3)], "doc_id long, text string, v int")
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(map(tuple, neardup.drop_near_duplicates(docs).collect())) == [(1, "A b c d e f", 2), (3, "", 3)]


def test_component_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (45, 41), (50, 50)]
    out = {r.u: r.v for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 31)}, 41: 40, 45: 40}
