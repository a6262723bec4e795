"""Exact counts at every prefix and exact byte-pair encoding, against the libraries."""

import random

import numpy as np
import pytest

from factloom.llm import bpe, tokens
from factloom.llm.bpe import public_path

ODD = ["", " ", "  ", "a", "\n\n a", "é ﬁ Ⅷ", "<s>x</s>", "▁a▁▁b", "a\x00b", "日本😀", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "'s 'll don't", "a" * 700, " " * 90 + "b", "　 \xa0x \x1c", "²³ 12ab", "the cat\r\n sat."]


def texts(n=300, seed=3):
    rng = random.Random(seed)
    parts = list("abcdet  \n'.,!é") + ["ing", "the ", " and", "日", "😀", "▁", "<|endoftext|>", "<unk>", "\t", "’", "  "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_counts_at_every_prefix():
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    counter, library = tokens.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(120):
        assert counter.count(t) == len(library.encode(t))
        every = counter.at_every_prefix(t[:120])
        assert every.tolist() == [len(library.encode(t[:i])) for i in range(len(t[:120]) + 1)]
        for limit in (0, 1, 5):
            fit = counter.longest_within(t[:120], limit, int(every[-1]))
            assert fit == max(i for i, n in enumerate(every) if n <= limit)


def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = public_path("byte_bpe_50k.json")
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    some = texts()
    for t, ids in zip(some, own.encode_batch(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == t
    assert 0 < own.exactly_merged < own.proposed


def test_long_words_merge_as_short_ones():
    own = bpe.load(public_path("byte_bpe_50k.json"))
    for word in (b"thonreouringly" * 9, b"abc" * 40, bytes(range(33, 120))):
        assert own.merge_long(word) == own.merge(word)


def test_memory_bound_does_not_change_results(monkeypatch):
    own = bpe.Bpe(public_path("byte_bpe_50k.json"))
    some = texts(60)
    whole = own.encode_batch(some)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [own.encode_batch([t])[0] for t in some] == whole


@pytest.fixture
def docs(spark):
    rows = [(1, "the cat sat", "x"), (2, None, "y"), (3, "", "z"), (None, "the cat", "w"), (1, "the cat sat", "x"), (4, "word " * 5000, "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_queries_over_rows(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    out = tokens.token_counts(docs, public_path("piece_bpe_32k.model"), ["doc_id"], prefixes=True)
    rows = {(r.doc_id, r.n_bytes): r for r in out.collect()}
    assert out.count() == 6
    assert rows[(2, 0)].n_tokens == rows[(3, 0)].n_tokens == 0
    long = rows[(4, 25000)]
    assert long.n_tokens == len(library.encode("word " * 5000)) and long.over_limit and len(library.encode(("word " * 5000)[: long.fit_chars])) <= 4096
    cut = tokens.within_budget(out.selectExpr("*", "3 as budget"), "budget").where("doc_id = 4").first().budget_chars
    assert len(library.encode(("word " * 5000)[:cut])) <= 3 < len(library.encode(("word " * 5000)[: cut + 1]))
    encoded = bpe.digests(bpe.encode(docs, public_path("byte_bpe_50k.json"), ["doc_id"]))
    assert encoded.count() == 6 and encoded.where("doc_id = 2").first().n_tokens == 0
    assert bpe.encode(docs.limit(0), public_path("byte_bpe_50k.json"), ["doc_id"]).count() == 0
    assert tokens.token_counts(docs.limit(0), public_path("piece_bpe_32k.model"), ["doc_id"]).count() == 0
