"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Pre-tokens are numbered by position within blocks of documents; each block sends its distinct
pre-tokens into one shuffle by word, where every distinct word of the corpus is encoded once; the
ids go back to the block, and the documents' id lists are put together by position. Decoding
joins ids to the table of token bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideweave.llm import blocks
from tideweave.llm.common import table

KNOWN_WORDS, BLOCK_BYTES = 1 << 18, 8 << 20


def _charset(holds) -> str:
    return "".join(f"\\x{c:02x}" for c in range(256) if holds(chr(c)))


class PreTokenizer:
    """Matches of the splitting pattern; within Latin-1 by an equal pattern of the faster standard library."""

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        import regex

        self.slow, self.fast = regex.compile(pattern), None
        if pattern == public_tokenizers.PATTERN:
            letter = _charset(lambda c: unicodedata.category(c)[0] == "L")
            number = _charset(lambda c: unicodedata.category(c)[0] == "N")
            space = r"\t\n\x0b\x0c\r \x85\xa0"  # White_Space, without the separators that str.isspace adds
            self.fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    def __call__(self, text: str) -> list[str]:
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return self.fast.findall(text)
            except UnicodeEncodeError:
                pass
        return self.slow.findall(text)


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class WordEncoder:
    def __init__(self, path: str):
        import tiktoken

        ranks = _ranks(path)
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.narrow = max(ranks.values(), default=0) < 1 << 16

    def __call__(self, word: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one pre-token."""
        return array("I", self.bpe._encode_single_piece(word)).tobytes()


class TokenBytes:
    """The token-byte table as flat arrays, with the decimal text of each id beside it."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * n
        for token, i in ranks.items():
            tokens[i] = token
        self.known = np.zeros(n, bool)
        self.known[list(ranks.values())] = True
        self.bytes = self._flat(tokens)
        self.decimal = self._flat([b"%d " % i for i in range(n)])

    @staticmethod
    def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in items], np.int64)
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes

    def spell(self, ids: np.ndarray, what: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
        if len(ids) and not (int(ids.max()) < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        flat, starts, sizes = what
        return blocks.take_runs(flat, starts[ids], sizes[ids]).tobytes()


@lru_cache(2)
def _token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


class Finish(NamedTuple):
    """make() gives a function from a table of id and ids to one of id and fields."""

    make: Callable[[], Callable[[pa.Table], pa.Table]]
    fields: str


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks_path: str | None = None, then: Finish | None = None) -> DataFrame:
    """id_col, ids: the ids of each text, without special tokens.

    A null text counts as empty and has no ids; ids may repeat or be null; no rows give no rows.
    Other columns of docs are not read. then: what to make of the ids in the worker that put them
    together, in their stead.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    parts = blocks.parts_of(docs.sparkSession)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokenizer()
        for b in blocks.cut_blocks(batches, BLOCK_BYTES):
            words, _, _ = blocks.numbered(split(t.as_py() or "") for t in b.column("text"))
            yield blocks.Dealt([w.encode() for w in words], parts).asks(blocks.block_name(b))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All questions about a word are in this partition, so it is encoded once."""
        encoder, known = WordEncoder(path), {}
        for b in batches:
            out = []
            for blob in b.column("blob"):
                words, _ = blocks.asked(blob.as_py())
                for w in words:
                    if w not in known:
                        known[w] = encoder(w)
                ids = [known[w] for w in words]
                out.append(blocks.answer(np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4").astype(np.uint16 if encoder.narrow else np.uint32)))
                if len(known) > KNOWN_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), pa.array(out, pa.binary())], ["block", "part", "blob"])

    def reassembled(left: pa.Table, right: pa.Table) -> pa.Table:
        split = PreTokenizer()
        tables = []
        for blob in left.column("blob"):
            b = blocks.unsqueeze(blob.as_py())
            words, where, n = blocks.numbered(split(t.as_py() or "") for t in b.column("text"))
            sizes, starts, flat = _answers(blocks.Dealt([w.encode() for w in words], parts), right, path)
            ids, per_word = blocks.take_runs(flat, starts[where], sizes[where]), np.concatenate([[0], np.cumsum(sizes[where])])
            ends = np.concatenate([[0], np.cumsum(n)])
            tables.append(pa.table({"id": b.column("id"), "ids": pa.ListArray.from_arrays(pa.array(per_word[ends].astype(np.int32)), pa.array(ids))}))
        # no text: words of a block that the second scan cut otherwise
        out = pa.concat_tables(tables) if tables else pa.table({"id": pa.array([], id_type), "ids": pa.array([], pa.list_(pa.int32()))})
        return out if then is None else then.make()(out)

    asks = rows.mapInArrow(questions, "block long, part int, blob binary").repartition("part")
    answers = asks.mapInArrow(encoded, "block long, part int, blob binary")
    whole = rows.mapInArrow(lambda bs: blocks.packed(bs, BLOCK_BYTES), "block long, blob binary")
    joined = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(reassembled, f"id {kind}, {'ids array<int>' if then is None else then.fields}")
    return joined.withColumnRenamed("id", id_col)


def _answers(dealt: blocks.Dealt, right: pa.Table, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: how many ids it has and where they start in the flat array of ids."""
    got = dealt.gather(right.column("part"), right.column("blob")) if dealt.words else [np.zeros(0, np.int64), [np.zeros(0, np.int32)]]
    if got is None:  # a second scan cut the blocks otherwise, so this one's words were not asked: encode them here
        encoder = WordEncoder(path)
        ids = [encoder(w) for w in dealt.words]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    sizes = got[0].astype(np.int64)
    in_order = np.concatenate([[0], np.cumsum(sizes[dealt.order])[:-1]]) if len(sizes) else sizes  # as the parts lie one after another
    starts = np.empty(len(sizes), np.int64)
    starts[dealt.order] = in_order
    return sizes, starts, np.concatenate(got[1]).astype(np.int32)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, ranks_path: str | None = None) -> DataFrame:
    """id_col, bytes: what the ids stand for. Null ids count as none; an id outside the vocabulary is an error."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(path)
        for b in batches:
            out = [tokens.spell(ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32), tokens.bytes) for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def decoded_digests(path: str) -> Finish:
    """n_tokens, and the digests of the ids as decimal text and of the bytes that they decode to."""

    def make():
        tokens = _token_bytes(path)

        def run(coded: pa.Table) -> pa.Table:
            n, of_ids, of_bytes = [], [], []
            for chunk in coded.column("ids").chunks:
                for value in chunk:
                    ids = value.values.to_numpy()
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(tokens.spell(ids, tokens.decimal)[:-1]).hexdigest())
                    of_bytes.append(hashlib.sha256(tokens.spell(ids, tokens.bytes)).hexdigest())
            return pa.table({"id": coded.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

        return run

    return Finish(make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), then=decoded_digests(public_tokenizers.path("byte_bpe_50k.tiktoken")))
