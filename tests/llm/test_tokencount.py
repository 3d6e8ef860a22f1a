from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import tokencount


def library(pieces, byte_fallback=True):
    t = Tokenizer(Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=tokencount.BLANK, prepend_scheme="always", split=False)
    return t


def test_counts_equal_the_library(spark, sf):
    pieces = tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    own, lib = tokencount.PieceCounter(pieces), library(pieces)
    assert own.by_chunk and own.has_bytes
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [r.text or "" for r in odd_docs(spark).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" ab▁eéth\n東🙂<0x>tion") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for text in texts:
        assert own(text) == len(lib.encode(text).ids), repr(text[:80])


def test_ties_and_unknown_runs():
    rng = random.Random(2)
    for _ in range(200):
        vocabulary = [("<unk>", -9.0)] + [(p, float(rng.randint(-4, 0))) for p in {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(12)}]
        own, lib = tokencount.PieceCounter(vocabulary), library(vocabulary, byte_fallback=False)
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 15)))
            assert own.best(text.replace(" ", tokencount.BLANK) if text.startswith(" ") else tokencount.BLANK + text.replace(" ", tokencount.BLANK)) == len(lib.encode(text).ids) if text else own(text) == 0


def test_query_and_odd_inputs(spark, sf):
    lib = library(tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    want = sorted((r.doc_id, len(lib.encode(r.text or "").ids)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, tokencount.op1_token_counts(spark, sf).collect())) == want
    docs = odd_docs(spark)
    out = {(r.row.doc_id, r.row.text): r.n_tokens for r in tokencount.count_tokens(docs).collect()}
    assert out[(2, None)] == out[(3, "")] == 0 and all(n > 0 for (i, _), n in out.items() if i not in (2, 3))
    assert tokencount.count_tokens(no_docs(spark)).count() == 0
