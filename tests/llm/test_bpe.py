from __future__ import annotations

import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import blocks, bpe


def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_fast_pattern_equals_the_slow_one():
    split, slow = bpe.PreTokenizer(), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(3)
    letters = "".join(map(chr, range(256)))
    for i in range(2000):
        text = "".join(rng.choice(letters if i % 2 else " '\n\tabst.re1é²\xa0\x85\x1c") for _ in range(rng.randint(0, 40)))
        assert split(text) == slow.findall(text)


def test_round_trip_and_ids(spark):
    docs, t = odd_docs(spark), tokenizer()
    coded = bpe.encode(docs)
    want = sorted((r.doc_id or -1, t.encode_ordinary(r.text or "")) for r in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in coded.collect()) == want
    back = sorted((r.doc_id or -1, bytes(r.bytes)) for r in bpe.decode(coded).collect())
    assert back == sorted((r.doc_id or -1, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())


def test_many_blocks_give_the_same(spark, sf, monkeypatch):
    t = tokenizer()
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50_000)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()}
    assert got == {r.doc_id: t.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}


def test_words_that_were_not_asked_are_encoded_in_place():
    import pyarrow as pa

    dealt = blocks.Dealt([b"hello", b" world"], 7)
    none = pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    sizes, starts, flat = bpe._answers(dealt, none, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [flat[s : s + n].tolist() for s, n in zip(starts, sizes)] == [tokenizer().encode_ordinary("hello"), tokenizer().encode_ordinary(" world")]


def test_query(spark, sf):
    t = tokenizer()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_empty(spark):
    assert bpe.decode(bpe.encode(no_docs(spark))).count() == 0
