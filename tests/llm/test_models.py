"""Nearest neighbours against brute force; toxicity on held-out texts; the pipeline's stages."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, neighbours, toxicity

from test_lines_neardup import brute, key
from test_rows import poisson


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100]  # a crowd of equal vectors
    rows = [(i, [float(v) for v in r], "k") for i, r in enumerate(x)]
    rows += [(9001, None, ""), (9002, [0.0] * 16, ""), (9020, [float("nan")] + [1.0] * 15, ""), (9040, [None] + [1.0] * 15, ""), (None, [1.0] * 16, ""), (9060, [1.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = neighbours.nearest(table, 20).collect()
    ids, hit, total = np.arange(3000), 0, 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in own} & set(np.lexsort((ids, -scores))[:20].tolist()))
        total += 20
    assert hit / total >= 0.9 and {r.query_id for r in out} == set(range(0, 3000, 20))  # 9060 is alone among vectors of its length


def test_many_buckets_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 4000)] + 0.25 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.usable(table, "vec_id", "embedding")
    shape = neighbours.shapes(rows)[0]
    index = neighbours.build(rows, shape.n, shape.d, shape.scale)
    assert index.lead >= 3 and len(np.unique(index.codes(index.cells(x, 0)))) >= 8
    out = neighbours.nearest(table, 20).collect()
    hit = 0
    for q in range(0, 4000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-scores)[:20].tolist()))
    assert hit / (200 * 20) >= 0.9
    assert neighbours.visited_share(rows, rows.where("id % 20 = 0"), index) < 0.3


def test_probes_come_in_the_order_of_success_and_hold_their_share():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 8))
    index = neighbours.Index(rng.normal(size=(2, 9, 6)), rng.random((2, 6)) * 9, 9.0, 3, 1.0, float(np.linalg.norm(x, axis=1).max()), 0.8, 1.5, 0.7, np.float64)
    chance, least = index.success(x[:20], 0)
    assert np.allclose(np.exp(chance).sum(2), 1, atol=1e-3)
    for c, low in zip(chance, least):
        codes = index.probes(c, low)
        digits = (codes[:, None] // 16 ** np.arange(3)) % 16
        best = c[np.arange(3), digits].sum(1) + c[3:].max(1).sum()
        assert len(codes) and len(set(codes.tolist())) == len(codes) and (np.diff(best) <= 1e-12).all() and (best >= low).all()


def test_components_of_any_finite_size_take_part(spark):
    rows = [(0, [1e200, 1e-200]), (20, [2e200, 0.0]), (40, [-1e200, 5e199]), (60, [1e-200, 1e-200]), (80, [0.0, 0.0]), (100, [float("inf"), 1.0]), (120, [1.0, 2.0, 3.0]), (140, [2.0, 1.0, 0.0]), (5, [3e-200, 1.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect()
    assert {r.query_id: sum(x.query_id == r.query_id for x in out) for r in out} == {0: 4, 20: 4, 40: 4, 60: 4, 120: 1, 140: 1}
    assert [r.score for r in out if r.query_id == 120] == [4.0] and {r.vec_id for r in out if r.query_id == 120} == {140}


def test_few_vectors_and_split_buckets(spark, monkeypatch):
    table = spark.createDataFrame([(i * 20, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    out = neighbours.nearest(table, 20).collect()
    assert len(out) == 20 and all(r.query_id != r.vec_id for r in out)  # all candidates, if fewer than 20
    assert neighbours.nearest(table.limit(0), 20).count() == 0 and neighbours.nearest(table.limit(1), 20).count() == 0
    rng = np.random.default_rng(4)
    many = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=8)]) for i in range(600)], "vec_id long, embedding array<double>")
    whole = neighbours.nearest(many, 20, share=0.999).collect()
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    split = neighbours.nearest(many, 20, share=0.999).collect()
    same = len({(r.query_id, r.vec_id) for r in whole} & {(r.query_id, r.vec_id) for r in split})
    assert len(split) == len(whole) and same / len(whole) > 0.97


def toxic_texts(n, rng, bad=("gnarfle", "blorpix", "snazzlu")):
    syllables = ["ba", "ko", "ri", "ta", "mi", "lo", "ne", "su"]
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.4
        if toxic:
            w = rng.choice(bad)
            words[rng.randrange(len(words))] = w if rng.random() < 0.7 else w[:3] + rng.choice("xyz") + w[3:]
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_learns_subwords():
    rng = random.Random(1)
    train, held = toxic_texts(700, rng), toxic_texts(200, rng)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    guess = model.score([t for t, _ in held]) >= 0.5
    assert (guess == np.array([y for _, y in held], bool)).mean() > 0.93
    assert model.score(["ba ko gnarfles ta " + "ri " * 30])[0] > model.score(["ba ko ta " + "ri " * 30])[0]  # an unseen form
    clean = " ".join(t for t, y in train if not y)  # one very long text
    empty, long, hidden = model.score(["", clean, clean + " gnarfle " + clean])
    assert 0 <= empty < 0.5 and 0 <= long < 0.5 <= hidden <= 1


def test_toxicity_rows(spark):
    rng = random.Random(2)
    some = toxic_texts(300, rng)
    docs = spark.createDataFrame([(i, t, 1.0) for i, (t, _) in enumerate(some)] + [(900, None, 1.0), (901, "", 1.0), (None, "ba", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(some)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 303 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs.limit(0), model).count() == 0
    alone = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, alone).where("score >= 0.5").count() == 0


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(3)
    some = toxic_texts(200, rng)
    docs = [(i, t.replace(" ", "\n", 3), "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(some)]
    docs += [(500 + i, docs[0][1] + " ba" * i, "en", "s0", 0) for i in range(3)] + [(600, "", "en", "s1", 0), (601, None, "en", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(some)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def plain_pipeline(docs, toxic):
    """The rows of the last stage, by loops: lists of (doc_id, lang, source, text)."""
    rows = [r for r in docs if r[0] not in toxic]
    having = {}
    for text in {r[3] or "" for r in rows}:
        for k in {key(x) for x in text.split("\n")} - {""}:
            having.setdefault(k, set()).add(text)
    hot = {k for k, v in having.items() if len(v) >= 10}
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        for k in {key(x) for x in (r[3] or "").split("\n")} & hot:
            first.setdefault(k, r[0])
    rows = [(*r[:3], "\n".join(x for x in (r[3] or "").split("\n") if key(x) not in hot or first[key(x)] == r[0])) for r in rows]
    classes = {d: c for d, _, c in brute([(r[0], r[3]) for r in rows], 5, 80)}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[3].encode())
    weight, out = sum(math.sqrt(n) for n in sizes.values()), []
    for r in rows:
        rate = sum(sizes.values()) * math.sqrt(sizes[r[2]]) / weight / sizes[r[2]] if sizes[r[2]] else 1.0
        out += [r] * poisson(rate, int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52)
    return out


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    clean = {r.doc_id for r in p.STAGES[0][1](spark, docs, sf_dir).select("doc_id").collect()}
    toxic = {r.doc_id for r in docs.collect()} - clean
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    final = p.run(spark, sf_dir).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    want = sorted((d, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for d, _, _, t in plain_pipeline([(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()], toxic))
    assert sorted((r.doc_id, bytes(r.ids)) for r in final) == want and all(r.n_tokens * 4 == len(r.ids) for r in final)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_lines", F.lit("KEEP")).withColumn("copy", F.col("doc_id"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.where("n_lines <> 'KEEP' or copy <> doc_id").count() == 0, name  # other columns keep their values
        if name == "line dedup":
            assert out.count() == docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
