from __future__ import annotations

import base64
import hashlib

import pytest

from sievework.llm import bpe
from sievework.llm import queries as Q
from sievework.llm.common import tokenizer_dir

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = [
    "", " ", "  ", "\n\n a", "it's they're we'll I'd 's 'll''ve", "a'b 's  'S", "x  y   z\t\tq \n", "ünïcode 😀😀 ١٢٣ 中文字", "aaaaaaaaaaaaaaaaaaaaaaa" * 300, "<|endoftext|> is text",
    "12 345,678.90 -- ---- !!!??", " lead and trail ", "a b　c   d", "\x00\x01 z", " '", "'", "don't  've 'r 're're", "\r\n\r\nx", " 's", "é combining", "tail   ", "word " * 5000,
]


def _encoder(name: str):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokenizer_dir()}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_tokens_as_the_public_encoder(make_docs, name):
    enc = _encoder(name)
    got = {r[0]: r[1] for r in bpe.encode(make_docs(list(enumerate(TEXTS))), name).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == enc.encode_ordinary(text), repr(text[:60])


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    enc = _encoder(FILES[0])
    tokens = bpe.encode(docs).cache()
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert {r[0]: r[1] for r in bpe.decode(tokens).collect()} == texts
    for r in tokens.collect():
        assert r[1] == enc.encode_ordinary(texts[r[0]])
    got = {r["doc_id"]: r for r in Q.op4_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["tokens"] == enc.encode_ordinary(texts[i]) and r["decoded_md5"] == hashlib.md5(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("extra", [False, True])
def test_edges(make_docs, edge_rows, extra):
    docs = make_docs(edge_rows, extra)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(((r[0], r[1]) for r in back), key=str) == sorted(edge_rows, key=str)
    assert bpe.encode(make_docs([])).count() == 0


def test_decode_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, tokens array<int>")).collect()


def test_decode_of_null_elements_and_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, tokens array<int>")
    assert sorted((r[0], r[1]) for r in bpe.decode(rows).collect()) == [(1, None), (2, "")]
