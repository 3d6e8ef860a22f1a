"""Class-based n-gram language model with classes from exchange clustering.

1. Counts: documents are written as blocks of numbered words; these send their distinct words with training counts; N, V and the
   ``core`` most frequent words follow from the sums.
2. Exchange clustering maximises the class bigram likelihood over all words with ``floor`` training
   occurrences or more. The core words are exchanged first, one by one on the driver; with them as
   start, all words are exchanged in sweeps over partitions of their neighbour counts, which are
   gathered once. A sweep broadcasts the class table, a byte per word; as words move at once, a
   sweep that lowers the likelihood is undone and repeated with fewer words.
3. Rarer words take the class that an exchange with all those classes held fixed would give
   them: the best pointwise mutual information with the classes seen left and right of them. They
   are judged per distinct word in one shuffle by word.
4. Documents become class sequences (a byte per token) with their emission sums; class trigram and
   bigram counts come from the training sequences and have at most (classes + 2)^3 cells.

Emission is by absolute discounting, P(w | k) = (c(w) - d) / N(k), and d V(k) / N(k) of each class is
left for the unknown word, so the probabilities of the V known tokens and the unknown one add up
to 1. Words seen once stand for the unknown word as context. Class trigrams back off to bigrams
and to class frequencies.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideweave.llm import blocks
from tideweave.llm.common import crc_fold, materialize, table

CORE, CLASSES, SWEEPS, BACKOFF, BLOCK_BYTES = 1000, 32, 12, 20.0, 8 << 20
#: Training occurrences from which a word is exchanged, and the gain in nats per bigram below which sweeps end.
FLOOR, LEAST_GAIN = 10, 1e-3
#: The end token's key; no word is empty.
END = b""
#: In class sequences: the unknown word, and the flag of a word seen once in training.
UNKNOWN, ONCE = 63, 64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space in lower case (A-Z only), then one end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def numbered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, blob: blocks of documents as numbered words, so that texts are split and words looked up once for all passes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in blocks.cut_blocks(batches, BLOCK_BYTES):
        words, flat, sizes = blocks.numbered(tokens(t.as_py()) for t in b.column("text"))
        planes = flat.view(np.uint8).reshape(-1, 4)
        held = np.asarray(b.column("held_out").to_pylist(), bool)
        blob = pickle.dumps((blocks.squeeze(b.select(["id"])), held, sizes, pack(np.array([len(w) for w in words], np.uint32).tobytes()), pack(b"".join(words)), [pack(planes[:, i].tobytes()) for i in range(4)]), 5)
        yield pa.RecordBatch.from_arrays([pa.array([blocks.block_name(b)], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])


class Block:
    """The tokens of a block: its distinct ones, the number of each occurrence, and id, fold and size of each text."""

    def __init__(self, blob: bytes):
        unpack = zstandard.ZstdDecompressor().decompress
        ids, self.held, self.sizes, lengths, joined, planes = pickle.loads(blob)
        self.ids = blocks.unsqueeze(ids).column("id")
        ends, joined = np.cumsum(np.frombuffer(unpack(lengths), np.uint32)).tolist(), unpack(joined)
        self.words = [joined[s:e] for s, e in zip([0, *ends], ends)]
        bytes_of = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], 1)
        self.flat = np.ascontiguousarray(bytes_of).view(np.int32).reshape(-1)

    def training(self) -> np.ndarray:
        """Occurrences in training texts, one text after another."""
        return self.flat[np.repeat(~self.held, self.sizes)] if self.held.any() else self.flat

    @property
    def end(self) -> int:
        return self.words.index(END)


def _keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _find(keys: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Position of each word among the sorted keys, or -1; the end token is not a word."""
    if not len(keys):
        return np.full(len(words), -1)
    own = _keys(words)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where((keys[at] == own) & np.fromiter(map(len, words), bool, len(words)), at, -1)


def _frequent(batches: Iterator[pa.RecordBatch], core: int, floor: int) -> Iterator[pa.RecordBatch]:
    """word, key, n: words of this partition, which holds all their counts, with floor occurrences or more; word stands for the core most frequent."""
    count: Counter = Counter()
    for b in batches:
        for blob in b.column("blob"):
            words, (n,) = blocks.asked(blob.as_py())
            for w, k in zip(words, n.tolist()):
                count[w] += k
    count.pop(END, None)
    best = heapq.nsmallest(core, count.items(), key=lambda x: (-x[1], x[0]))
    named = {w for w, _ in best}
    best += [(w, n) for w, n in count.items() if n >= floor and w not in named]
    yield pa.RecordBatch.from_arrays([pa.array([w if w in named else None for w, _ in best], pa.binary()), pa.array(_keys([w for w, _ in best])), pa.array([n for _, n in best], pa.int64())], ["word", "key", "n"])


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the first len - 2 symbols that maximise the class bigram likelihood by exchange.

    The last two symbols, all other words and the text's edge, stay classes of their own.
    Words start by frequency rank modulo the number of classes; ties keep the lower class.
    """
    n = len(bigrams) - 2
    of = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    total = classes + 2
    member = np.eye(total)[of]
    m = member.T @ bigrams @ member

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own = of[w], bigrams[w, w]
            right = np.bincount(of, bigrams[w], total)
            left = np.bincount(of, bigrams[:, w], total)
            m[a] -= right
            m[:, a] -= left
            m[a, a] += own
            right[a] -= own
            left[a] -= own
            fm, d = f(m), np.arange(total)
            rows, cols = f(m + right) - fm, f(m + left[:, None]) - fm
            gain = rows.sum(1) + cols.sum(0) - rows[d, d] - cols[d, d] + f(m[d, d] + right + left + own) - fm[d, d]
            out, into = m.sum(1) + left, m.sum(0) + right  # the word stays beside its neighbours, whatever its class
            gain -= f(out + right.sum() + own) - f(out) + f(into + left.sum() + own) - f(into)
            k = int(np.argmax(gain[:classes]))
            if gain[k] <= gain[a] + 1e-9:
                k = a
            moved += k != a
            of[w] = k
            m[k] += right
            m[:, k] += left
            m[k, k] += own
        if not moved:
            break
    return of[:n]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Class bigram log likelihood, up to what no exchange changes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def exchange_gains(m: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What each word adds to the likelihood in each class, as exchange() judges one word, for many words against one m.

    left, right: counts of the classes beside each word; own: how often it follows itself; of: its class.
    """
    w, d = np.arange(len(of)), np.arange(len(m))
    left, right, each = left.astype(float), right.astype(float), np.repeat(m[None].astype(float), len(of), 0)
    each[w, of] -= right
    each[w, :, of] -= left
    each[w, of, of] += own
    right[w, of] -= own
    left[w, of] -= own
    fm = _xlogx(each)
    rows, cols = _xlogx(each + right[:, None]) - fm, _xlogx(each + left[:, :, None]) - fm
    gain = rows.sum(2) + cols.sum(1) - rows[:, d, d] - cols[:, d, d] + _xlogx(each[:, d, d] + right + left + own[:, None]) - fm[:, d, d]
    out, into = each.sum(2) + left, each.sum(1) + right  # the word stays beside its neighbours, whatever its class
    return gain - _xlogx(out + (right.sum(1) + own)[:, None]) + _xlogx(out) - _xlogx(into + (left.sum(1) + own)[:, None]) + _xlogx(into)


class Links:
    """Neighbour counts of all exchanged words, in partitions by word, and sweeps over them.

    Words are positions in the sorted keys, n of them; n is any other word and n + 1 the text's edge.
    """

    def __init__(self, corpus: DataFrame, keys: np.ndarray, classes: int):
        spark, n, parts = corpus.sparkSession, len(keys), blocks.parts_of(corpus.sparkSession)
        self.spark, self.n, self.classes = spark, n, classes
        sent = spark.sparkContext.broadcast(keys)  # 8 bytes per exchanged word

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each block's distinct bigrams, sent to the words on both sides; those of no exchanged word go to part 0."""
            for b in batches:
                for blob in b.column("blob"):
                    own = Block(blob.as_py())
                    found = _find(sent.value, own.words)
                    symbol = np.where(found < 0, n, found)
                    symbol[own.end] = n + 1
                    at = np.concatenate([[n + 1], symbol[own.training()]])
                    pair, count = np.unique(at[:-1] * (n + 2) + at[1:], return_counts=True)
                    a, z = pair // (n + 2), pair % (n + 2)
                    to_left, to_right = (a < n) | (z >= n), z < n
                    cell = np.concatenate([(a * 2 + 1)[to_left] * (n + 2) + z[to_left], (z * 2)[to_right] * (n + 2) + a[to_right]])
                    count = np.concatenate([count[to_left], count[to_right]])
                    word = np.concatenate([a[to_left], z[to_right]])
                    part = np.where(word < n, word % parts, 0)
                    order = np.lexsort((cell, part))
                    full, begin = np.unique(part[order], return_index=True)
                    ends = [*begin[1:], len(order)]
                    blobs = [blocks.answer(cell[order[s:e]], count[order[s:e]]) for s, e in zip(begin, ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for part, blob in zip(b.column("part").to_pylist(), b.column("blob")):
                    held.setdefault(part, []).append(blob.as_py())
            for blobs in held.values():
                cell, count = (np.concatenate(x) for x in zip(*map(blocks.answered, blobs)))
                cell, which = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([blocks.answer(cell, np.bincount(which, count).astype(np.int64))], pa.binary())], ["blob"])

        self.rows = materialize(corpus.select("blob").mapInArrow(pairs, "part int, blob binary").repartition("part").mapInArrow(merged, "blob binary"), "lm-links", "none")

    def matrix(self, table: np.ndarray) -> np.ndarray:
        """Class bigram counts under a class table."""
        n, total = self.n, self.classes + 2
        sent = self.spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros(total * total)
            for b in batches:
                for blob in b.column("blob"):
                    cell, count = blocks.answered(blob.as_py())
                    side, beside = cell // (n + 2), cell % (n + 2)
                    word = side // 2
                    here, there = sent.value[word].astype(np.int64), sent.value[beside].astype(np.int64)
                    # a bigram counts at its left word, and at its right one only if the left is not exchanged
                    m += np.bincount(np.where(side % 2, here * total + there, there * total + here), np.where((side % 2 == 1) | (beside >= n), count, 0), total * total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(m)], ["cell", "n"])

        got = self.rows.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # total^2 rows
        m = np.zeros(total * total)
        m[np.asarray(got.column(0))] = np.asarray(got.column(1))
        sent.destroy()
        return m.reshape(total, total)

    def moves(self, table: np.ndarray, m: np.ndarray, share: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that gain by another class, and that class, among one in share of the words."""
        n, total, classes = self.n, self.classes + 2, self.classes
        sent = self.spark.sparkContext.broadcast((table, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, m = sent.value
            for b in batches:
                for blob in b.column("blob"):
                    cell, count = blocks.answered(blob.as_py())
                    side, beside = cell // (n + 2), cell % (n + 2)
                    # which words move together is drawn anew for each turn
                    mixed = (side // 2 * 0x9E3779B1 + (turn + 1) * 0x85EBCA6B) & 0xFFFFFFFF
                    chosen = (side // 2 < n) & ((mixed ^ (mixed >> 15)) % share == 0)
                    side, beside, count = side[chosen], beside[chosen], count[chosen]
                    words, which = np.unique(side // 2, return_inverse=True)
                    cells = (which * 2 + side % 2) * total + table[beside]
                    profile = np.bincount(cells, count, len(words) * 2 * total).reshape(-1, 2, total)
                    own = np.bincount(which, np.where((side % 2 == 1) & (beside == side // 2), count, 0), len(words))
                    of = table[words].astype(np.int64)
                    best = of.copy()
                    for at in range(0, len(words), 512):
                        some = slice(at, at + 512)
                        gain = exchange_gains(m, profile[some, 0], profile[some, 1], own[some], of[some])
                        k, i = gain[:, :classes].argmax(1), np.arange(len(gain))
                        best[some] = np.where((gain[i, k] > gain[i, of[some]] + 1e-9) | (of[some] >= classes), k, of[some])
                    new = np.flatnonzero(best != of)
                    yield pa.RecordBatch.from_arrays([pa.array(words[new], pa.int64()), pa.array(best[new].astype(np.int32))], ["word", "class"])

        got = self.rows.mapInArrow(run, "word long, class int").toArrow()  # a row per word that moves
        sent.destroy()
        return np.asarray(got.column(0)), np.asarray(got.column(1))

    def sweep(self, table: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
        """The class table after exchange, and its class bigram counts. Words without a class yet stand in class ``classes``."""
        m = self.matrix(table)
        share = 1
        for turn in range(sweeps):
            who, k = self.moves(table, m, share, turn)
            first, share = turn == 0, max(share, 2)
            if not len(who) and not first:
                break
            new = table.copy()
            new[who] = k
            after = self.matrix(new)
            gain = likelihood(after) - likelihood(m)
            if not first and gain < 0:
                share *= 2
                continue
            table, m = new, after
            if not first and gain * share < LEAST_GAIN * m.sum():
                break
        return table, m


def _mutual(m: np.ndarray) -> np.ndarray:
    p = (m + 0.1) / (m + 0.1).sum()
    return np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))


class Transitions:
    """log10 P(class | two contexts before), contexts: the classes, the unknown word, the start."""

    def __init__(self, trigrams: np.ndarray, unknown: np.ndarray, backoff: float = BACKOFF):
        targets = trigrams.shape[2]
        uni = trigrams.sum((0, 1)) + 0.5
        uni /= uni.sum()
        bi = trigrams.sum(0)
        bi = (bi + backoff * uni) / (bi.sum(1, keepdims=True) + backoff)
        tri = (trigrams + backoff * bi[None]) / (trigrams.sum(2, keepdims=True) + backoff)
        self.log = np.log10(np.maximum(tri, 1e-300))
        self.unknown = np.log10(np.maximum(tri @ np.append(unknown, np.zeros(targets - len(unknown))), 1e-300))


def _contexts(seqs: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all tokens of the sequences: the contexts two and one before each, its class, and where each text begins.

    The class of unknown words is UNKNOWN. Every text has its end token, so none is empty.
    """
    flat = [s.as_buffer() for s in seqs]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in flat])[:-1]]).astype(np.int64)
    seq = np.frombuffer(b"".join(flat), np.uint8)
    target = np.where(seq & ONCE, seq & (ONCE - 1), seq).astype(np.int64)
    as_context = np.where((seq == UNKNOWN) | (seq & ONCE > 0), classes + 1, target)
    one = np.concatenate([[0], as_context[:-1]])
    one[begin] = classes + 2
    two = np.concatenate([[0], one[:-1]])
    two[begin] = classes + 2
    return two, one, target, begin


def train_and_score(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", *, core: int = CORE, classes: int = CLASSES, floor: int = FLOOR) -> DataFrame:
    """Score every text by a model of the rows that are not held out.

    id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.
    A null text counts as empty: its one token is the end. Ids may repeat or be null. Without any
    training row every token is unknown, and both scores are 0 (the unknown word has probability
    1). No rows give no rows. Other columns of docs are not read.
    """
    if not 0 < classes < UNKNOWN:
        raise ValueError(f"classes must be between 1 and {UNKNOWN - 1}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    corpus = materialize(rows.mapInArrow(numbered_blocks, "block long, blob binary"), "lm-corpus", "none")

    parts = blocks.parts_of(spark)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training counts of each block's distinct words."""
        for b in batches:
            for name, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                own = Block(blob.as_py())
                n = np.bincount(own.training(), minlength=len(own.words)).astype(np.uint32)
                yield blocks.Dealt(own.words, parts).asks(name, lambda at, n=n: (n[at],))

    ask = "block long, part int, blob binary"
    found = corpus.mapInArrow(counts, ask).repartition("part").mapInArrow(lambda bs: _frequent(bs, core, floor), "word binary, key long, n long")
    tops = materialize(found, "lm-counts")
    frequent = [bytes(r[0]) for r in tops.where("word is not null").orderBy(F.desc("n"), "word").limit(core).collect()]
    head = {w: i for i, w in enumerate(frequent)}
    size = len(frequent) + 2
    sent_head = spark.sparkContext.broadcast(head)  # core words at most

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell, n: bigrams of training texts over core words, other words and edges."""
        known, cells = sent_head.value, np.zeros(size * size, np.int64)
        for b in batches:
            for blob in b.column("blob"):
                own = Block(blob.as_py())
                symbol = np.fromiter((known.get(w, size - 2) if w else size - 1 for w in own.words), np.int64, len(own.words))
                at = np.concatenate([[size - 1], symbol[own.training()]])
                cells += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(cells[full], pa.int64())], ["cell", "n"])

    found = corpus.select("blob").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # size^2 rows at most
    bigrams = np.zeros(size * size)
    bigrams[np.asarray(found.column(0))] = np.asarray(found.column(1))
    bigrams = bigrams.reshape(size, size)
    of = exchange(bigrams, classes)
    often = np.asarray(tops.where(F.col("n") >= floor).select("key").toArrow().column(0))
    keys = np.unique(np.concatenate([often, _keys(frequent)]))  # 8 bytes per exchanged word
    of_key = np.full(len(keys) + 2, classes, np.uint8)
    of_key[np.searchsorted(keys, _keys(frequent))], of_key[-1] = of, classes + 1
    of_key, m = Links(corpus, keys, classes).sweep(of_key)
    mutual = _mutual(m)
    # classes 0..classes-1, then the end token's own; the class of exchanged words is fixed
    sent_class = spark.sparkContext.broadcast((keys, of_key, mutual))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's distinct words with training counts, and the classes beside those that were not exchanged."""
        keys, of_key, _ = sent_class.value
        for b in batches:
            for name, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                own = Block(blob.as_py())
                found = _find(keys, own.words)
                cls = of_key[np.where(found < 0, len(keys), found)]  # other words
                cls[own.end] = classes + 1
                fixed = found >= 0
                fixed[own.end] = True
                at = np.concatenate([[own.end], own.training()])
                n = np.bincount(at[1:], minlength=len(own.words))
                mid = np.flatnonzero(~fixed[at])
                mid = mid[np.argsort(at[mid], kind="stable")]
                around = np.stack([cls[at[mid - 1]], cls[at[mid + 1]]], 1).reshape(-1) if len(mid) else np.zeros(0, np.uint8)
                sizes = np.where(fixed, 0, 2 * n)
                starts = np.cumsum(sizes) - sizes
                yield blocks.Dealt(own.words, parts).asks(name, lambda at, n=n, a=around, s=starts, z=sizes: (n[at].astype(np.uint32), blocks.take_runs(a, s[at], z[at]).tobytes()))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All questions about a word are in this partition: its count and class go back to each block that asked.

        Rows without a block hold what the distinct words add to each class: tokens, words, and
        words seen once and twice.
        """
        keys, of_key, mutual = sent_class.value
        wide = classes + 2
        seen: dict[bytes, int] = {}
        rows, beside = [], []
        for b in batches:
            for name, part, blob in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("blob")):
                words, (n, around) = blocks.asked(blob.as_py())
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                rows.append((name, part, ids, n))
                if around:
                    flat = np.frombuffer(around, np.uint8)
                    sizes = ((_find(keys, words) < 0) & np.fromiter(map(len, words), bool, len(words))) * n.astype(np.int64)
                    who = np.repeat(ids, sizes)
                    beside += [(who * 2 + side) * wide + flat[side::2] for side in (0, 1)]
        if not seen:
            return
        total = np.zeros(len(seen), np.int64)
        for _, _, ids, n in rows:
            total[ids] += n  # the words of a question are distinct
        profile = np.bincount(np.concatenate(beside), minlength=len(seen) * 2 * wide).reshape(-1, 2, wide) if beside else np.zeros((len(seen), 2, wide))
        # as the exchange does, judged by the classes to the left and to the right
        cls = (profile[:, 0] @ mutual[:, :classes] + profile[:, 1] @ mutual[:classes].T).argmax(1)
        found = _find(keys, list(seen))  # in the order of their numbers
        cls = np.where(found < 0, cls, of_key[found])
        if END in seen:
            cls[seen[END]] = classes
        names = ["block", "part", "blob", "class", "n", "words", "once", "twice"]
        value = total * 64 + cls
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            blobs = [blocks.answer(value[ids]) for _, _, ids, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(some), pa.int32()), *[pa.nulls(len(some), pa.int64())] * 4], names)
        known = total > 0
        k = np.arange(classes + 1, dtype=np.int32)
        per = [pa.array(np.bincount(cls[known], x[known].astype(float), classes + 1).astype(np.int64)) for x in (total, known, total == 1, total == 2)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary()), pa.array(k), *per], names)

    given = corpus.mapInArrow(questions, ask).repartition("part").mapInArrow(answers, f"{ask}, class int, n long, words long, once long, twice long")
    known = materialize(given, "lm-words")
    stats = known.where("block is null").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("n", "words", "once", "twice")]).collect()  # classes + 1 rows
    n_k, v_k = np.zeros(classes + 1), np.zeros(classes + 1)
    once = twice = 0
    for r in stats:
        n_k[r["class"]], v_k[r["class"]] = r["n"], r["words"]
        once, twice = once + r["once"], twice + r["twice"]
    n_all, v_all = int(n_k.sum()), int(v_k.sum())
    discount = min(max(once / (once + 2 * twice) if once else 0.1, 0.05), 0.95)
    left = np.where(n_k > 0, discount * v_k / np.maximum(n_k, 1), 1.0)
    end_alone = n_k[classes] > 0
    if end_alone:
        left[classes] = 0.0  # the end token's class holds nothing else
    taken = np.where(np.arange(classes + 1) == classes, 0.0 if end_alone else discount, discount)

    def sequences(left_side: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for blob in left_side.column("blob"):
            own = Block(blob.as_py())
            got = blocks.Dealt(own.words, parts).gather(right.column("part"), right.column("blob"))
            if got is None:
                raise RuntimeError("a block's words did not arrive whole")
            n, cls = got[0] // 64, got[0] % 64
            emission = np.where(n > 0, np.log10(np.maximum(n - taken[cls], 1e-9) / np.maximum(n_k[cls], 1)), 0.0)
            base = np.log10((n + 0.5) / (n_all + 0.5 * (v_all + 1)))
            code = np.where(n > 0, cls + np.where(n == 1, ONCE, 0), UNKNOWN).astype(np.uint8)
            begin = np.cumsum(own.sizes) - own.sizes  # no text is without its end token
            seq = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, own.sizes.sum()).astype(np.int32)), pa.py_buffer(code[own.flat])])
            sums = [np.add.reduceat(x[own.flat], begin) for x in ((n > 0).astype(np.int64), base, emission)]
            tables.append(pa.table({"id": own.ids, "held_out": pa.array(own.held), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "emission": pa.array(sums[2]), "seq": seq}))
        return pa.concat_tables(tables) if tables else pa.schema([("id", id_type), ("held_out", pa.bool_()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("seq", pa.binary())]).empty_table()

    words = known.where("block is not null").select("block", "part", "blob")
    read = corpus.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(sequences, f"id {kind}, held_out boolean, n_known long, base_score double, emission double, seq binary")
    texts = materialize(read, "lm-sequences")

    shape = (classes + 3, classes + 3, classes + 1)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(int(np.prod(shape)), np.int64)
        for b in batches:
            two, one, target, _ = _contexts(b.column("seq"), classes)
            ok = target <= classes
            cells += np.bincount(((two * shape[1] + one) * shape[2] + target)[ok], minlength=len(cells))
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(cells[full], pa.int64())], ["cell", "n"])

    found = texts.where("not held_out").select("seq").mapInArrow(trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # (classes + 3)^3 rows at most
    cells = np.zeros(int(np.prod(shape)))
    cells[np.asarray(found.column(0))] = np.asarray(found.column(1))
    moves = Transitions(cells.reshape(shape), left) if n_all else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(s.as_buffer()) for s in b.column("seq")], np.int64)
            score = np.zeros(len(n))
            if moves is not None and len(n):
                two, one, target, begin = _contexts(b.column("seq"), classes)
                known_word = target <= classes
                step = np.where(known_word, moves.log[two, one, np.where(known_word, target, 0)], moves.unknown[two, one])
                score = np.asarray(b.column("emission")) + np.add.reduceat(step, begin)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(n), b.column("n_known"), pa.array(np.full(len(n), n_all)), b.column("base_score"), pa.array(score), pa.array(10 ** np.minimum(-score / np.maximum(n, 1), 300))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    out = texts.mapInArrow(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_col)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return train_and_score(docs, crc_fold("doc_id") == 1)
