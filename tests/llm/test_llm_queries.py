"""Each registered query on the smallest tables, against its SQL, a library or brute force."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, sharding
from factloom.llm.registry import QUERIES, SQL

DATA, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    out = QUERIES[name](spark, DATA)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(out.columns)
    plain = lambda row, order: repr(tuple(row[c] for c in order))
    assert sorted(plain(r.asDict(), sorted(names)) for r in out.collect()) == sorted(plain(dict(zip(names, r)), sorted(names)) for r in cursor.fetchall())


def test_op1_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=bpe.public_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op1_token_counts"](spark, DATA).collect()}
    assert got == {d: (len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts()}


def test_op10_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe_encoding"](spark, DATA).collect()}
    for d, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op2_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out, hit = QUERIES["op2_nearest_vectors"](spark, DATA).collect(), 0
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    for i in asked:
        own = sorted((r for r in out if r.query_id == ids[i]), key=lambda r: r.rank)
        scores = x @ x[i]
        assert len(own) == 20 and all(abs(r.score - scores[np.searchsorted(ids, r.vec_id)]) < 1e-9 for r in own)
        scores[i] = -np.inf
        hit += len({r.vec_id for r in own} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(asked)


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no labelled tables here")
def test_op3_on_labels_that_it_never_saw(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").where("toxic is not null")
    judged = QUERIES["op3_toxicity"](spark, LABELLED).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("rejected")).collect()
    found = {r.toxic: r.rejected / r.n for r in judged}
    assert found[1] >= 0.75 and found[0] <= 0.03, found


def test_op12_equals_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.public_path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_rank_bpe"](spark, DATA).collect()}
    for d, t in texts():
        ids = library.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op4_equals_a_plain_lookup(spark):
    owner = sharding.lookup_table(sharding.shard_names(64))
    for r in QUERIES["op4_sharding"](spark, DATA).collect():
        h = xxhash.xxh64_intdigest(str(r.doc_id), 42)
        slot = (h if h < 2**63 else h - 2**64) % 65_537
        assert (r.slot, r.shard) == (slot, f"shard-{owner[slot]:04d}")


def test_pipeline_query(spark):
    out = QUERIES["pipeline"](spark, DATA)
    assert {"doc_id", "ids", "n_tokens", "decoded_sha256"} <= set(out.columns) and 0 < out.count()
