"""Blocks of documents, and distinct-word tables joined back to them.

Work per distinct word (encoding it, counting it over the corpus) is done once per word in the
whole corpus, yet word occurrences are never shuffled: a block of some megabytes of text sends each
of its distinct words once, dealt into parts by a hash of the word and packed, and gets the answers
back in the same order. All questions about a word meet in one part. A block is named by a hash of its content, so the two scans that make its
words and its text agree by content, not by the order in which Spark happens to read.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

TEXT_BYTES = 8 << 20


def cut_blocks(batches: Iterator[pa.RecordBatch], text_bytes: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, in batches of about text_bytes of column "text" (more only for one long text)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, before + text_bytes - n)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            n += int(ends[stop - 1]) - before
            start = stop
            if n >= text_bytes:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in whole.columns], names=whole.column_names)


def _ipc(batch: pa.RecordBatch, codec: pa.Codec | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def block_name(batch: pa.RecordBatch) -> int:
    return xxhash.xxh3_64_intdigest(_ipc(batch)) - (1 << 63)


def squeeze(batch: pa.RecordBatch) -> bytes:
    return _ipc(batch, pa.Codec("zstd", compression_level=3))


def unsqueeze(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


def packed(batches: Iterator[pa.RecordBatch], text_bytes: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """block long, blob binary: the blocks themselves."""
    for b in cut_blocks(batches, text_bytes):
        yield pa.RecordBatch.from_arrays([pa.array([block_name(b)], pa.int64()), pa.array([squeeze(b)], pa.binary())], ["block", "blob"])


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+sizes[0]], then the next run, and so on, as one array."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Numbers(defaultdict):
    """Numbers of words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__


def numbered(texts: Iterable[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number of each word occurrence, and how many words each text has."""
    numbers, flat, sizes = Numbers(), array("i"), []
    number = numbers.__getitem__
    for words in texts:
        flat.extend(map(number, words))
        sizes.append(len(words))
    return list(numbers), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(sizes, np.int64)


def parts_of(spark) -> int:
    """Into how many parts a block deals its words: some for each shuffle partition, so that they even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Dealt:
    """A block's distinct words dealt out by a hash of the word: order[bounds[p]:bounds[p+1]] are those of part p."""

    def __init__(self, words: list[bytes], parts: int):
        part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
        self.words, self.order = words, np.argsort(part, kind="stable")
        self.bounds = np.searchsorted(part[self.order], np.arange(parts + 1))
        self.full = np.flatnonzero(np.diff(self.bounds))

    def asks(self, block: int, beside=lambda at: ()) -> pa.RecordBatch:
        """block, part, blob: the words of each part, with what beside gives for their positions."""
        pack, blobs = zstandard.ZstdCompressor(level=1), []
        for p in self.full:
            at = self.order[self.bounds[p] : self.bounds[p + 1]]
            own = [self.words[i] for i in at.tolist()]
            blobs.append(pack.compress(pickle.dumps((np.array([len(w) for w in own], np.uint32), b"".join(own), *beside(at)), 5)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), block, np.int64)), pa.array(self.full.astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "part", "blob"])

    def gather(self, parts: pa.ChunkedArray, blobs: pa.ChunkedArray) -> list | None:
        """The first field of all answers in word order, and the other fields part by part; None if any part is missing."""
        got = dict(zip(parts.to_pylist(), blobs))  # equal blocks ask the same question twice
        if any(p not in got for p in self.full.tolist()):
            return None
        pieces = [answered(got[p].as_py()) for p in self.full.tolist()]
        if any(len(x[0]) != self.bounds[p + 1] - self.bounds[p] for p, x in zip(self.full, pieces)):
            return None
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        first, *more = zip(*pieces)
        return [np.concatenate(first)[back], *more]


def asked(blob: bytes) -> tuple[list[bytes], list]:
    """The words of a question and what was sent beside them."""
    sizes, flat, *beside = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    ends = np.cumsum(sizes).tolist()
    return [flat[s:e] for s, e in zip([0, *ends], ends)], beside


def answer(*fields: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(fields, 5))


def answered(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
