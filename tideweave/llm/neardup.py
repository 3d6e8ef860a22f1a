"""Similarity join of documents on word n-grams: MinHash banding, then Jaccard on full n-gram sets.

1. A scan gives each text its n-gram set, as 64-bit hashes; texts with equal sets are one node, so
   exact copies cost one row of a partial aggregate each.
2. Nodes are shuffled on band hashes. Band and row counts follow from the similarity and the
   recall aimed at. Buckets of one node end here.
3. A bucket's leader is its least node; a candidate group is all buckets of one leader. Nodes that share a
   bucket meet in its leader's group, so no two that collide are missed, and a group is never more than the
   buckets of one node: chains of collisions do not grow together before they are verified.
4. Only nodes in groups fetch their text again, and each n-gram set travels to its groups once.
5. Groups are verified in tiles: a group of any size is cut into blocks of about ``tile`` nodes (or
   the root of its size, if that is more), and each pair of blocks is a piece of work of its own. Pairs are counted inside a tile and never
   become rows: a tile gives each node its number of links and a root of its linked nodes. A pair that
   meets in several groups counts in that of the least leader. No group, bucket or candidate is capped.
6. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm import blocks
from tideweave.llm.common import materialize, table

GRAM, SIMILARITY, RECALL, ROWS, TILE = 5, 0.8, 0.9995, 5, 64
KNOWN_WORDS = 1 << 17
#: Rows of keys (some 16 bytes each) up to which they are broadcast; more meet the texts in a shuffle join.
BROADCAST_ROWS = 1 << 21


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of so many rows that find a pair of this similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def gram_set(text: str | None, known: Words, n: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words; a shorter text with a word is one n-gram, one without has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(n, len(words))
    out = np.full(len(words) - wide + 1, 0x9E3779B97F4A7C15 + len(words) * (len(words) < n), np.uint64)
    for i in range(wide):
        out ^= h[i : i + len(out)]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(1 << 62, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.salt = draw.integers(0, 1 << 63, bands, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """A hash for each band, as signed 64-bit integers."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(grams), 8192):
            np.minimum(least, (self.a[:, None] * grams[None, s : s + 8192] + self.b[:, None]).min(1), out=least)
        least >>= np.uint64(32)
        out = self.salt.copy()
        for row in least.reshape(self.bands, self.rows).T:
            out ^= row
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, text_key, node, bands: node names the n-gram set, null for texts without a word."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, minhash = Words(), MinHash(bands, rows)
        for b in blocks.cut_blocks(batches, 4 << 20):
            nodes, hashes = [], []
            for text in b.column("text"):
                grams = gram_set(text.as_py(), known, n)
                nodes.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                hashes.append(minhash(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(nodes, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "text_key", "node", "bands"])

    return source.mapInArrow(run, "id long, text_key struct<a: long, b: int>, node binary, bands array<bigint>")


def _text_key(text_col: str) -> F.Column:
    """96 bits that name a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def components(member: DataFrame, name: str) -> DataFrame:
    """node, label: least node that is connected with it, where nodes of one group are connected.

    member: node, grp. Least labels spread from nodes to groups and back and jump along labels, in
    rounds that are written to the shared folder, until none changes. Aggregates are written before
    they are joined, so that both sides of a join are plain shuffles and a large group can be split.
    """
    label = None
    while True:
        least = member.groupBy("grp").agg(F.min("node").alias("label")) if label is None else member.join(label, "node").groupBy("grp").agg(F.min("label").alias("label"))
        groups = materialize(least, name)
        spread = materialize(member.join(groups, "grp").groupBy("node").agg(F.min("label").alias("label")), name)
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), name)
        if label is not None and new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        label = new


def tile_links(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, at_least: Fraction, met: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the documents (copies) that it is linked with, and the least position connected with it.

    side: which of two blocks each set is of; then only pairs across the blocks are looked at. met:
    other groups of each set; pairs that have one of them in common are left to it.
    """
    elsewhere: dict[int, list[int]] = {}
    for i, groups in enumerate(met or ()):
        for g in groups:
            elsewhere.setdefault(g, []).append(i)
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    term = np.cumsum(fresh) - 1
    df = np.bincount(term) if len(term) else np.zeros(0, np.int64)
    begin, posting = np.cumsum(df) - df, owner[order]
    of = np.empty(len(flat), np.int64)
    of[order] = term
    shared = df[of] > 1
    kept, owner_kept = of[shared], owner[shared]
    starts = np.searchsorted(owner_kept, np.arange(m + 1))
    links, root = np.zeros(m, np.int64), np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    num, den = at_least.numerator, at_least.denominator
    for i in range(m):
        terms = kept[starts[i] : starts[i + 1]]
        if not len(terms):
            continue
        both = np.bincount(blocks.take_runs(posting, begin[terms], df[terms]), minlength=m)
        linked = both * den >= num * (sizes + sizes[i] - both)
        linked[i] = False
        if side is not None:
            linked &= side != side[i]
        for g in met[i] if met else ():
            linked[elsewhere[g]] = False
        at = np.flatnonzero(linked)
        if len(at):
            links[i] = copies[at].sum()
            a = find(i)
            for j in at[at > i] if side is None else at:
                b = find(int(j))
                if a != b:
                    a, b = min(a, b), max(a, b)
                    root[b] = a
    return links, np.array([find(i) for i in range(m)], np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each tile, of a partition that is sorted by tile."""
    held, key = [], None
    for b in batches:
        keys = list(zip(b.column("label").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist()))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(b.slice(start, i - start))
                start = i
    if held:
        yield key, pa.Table.from_batches(held)


def candidate_groups(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """node, groups: of each node that shares a bucket the labels of its groups in order, and into how many blocks each group is cut.

    A node has no more groups than bands.
    """
    band = nodes.select("node", F.explode("bands").alias("bucket"))  # the band's number is in its hash
    buckets = materialize(band.groupBy("bucket").agg(F.min(F.xxhash64("node")).alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "label"), "buckets")
    member = materialize(band.join(buckets, "bucket").select("node", "label").distinct(), "candidates")
    size = materialize(member.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    cut = F.ceil(F.col("size") / F.greatest(F.lit(tile), F.sqrt("size"))).cast("int")
    return member.join(size, "label").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("label", cut.alias("nb")))).alias("groups"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, text_key, class_id, keeper_key, n_links: a row per row of docs.

    class_id: the least id among the rows that are linked with this one, directly or through others
    (equal n-gram sets are linked); n_links: how many other rows its n-gram set has a Jaccard
    similarity of at least ``similarity`` with. keeper_key: text_key of the row that class_id names. A
    null text counts as empty; texts without a word are linked with nothing and are their own class. A
    null id is a class id only where no other id is there. No rows give no rows.
    """
    sig = materialize(signatures(docs, id_col, text_col, n, bands_for(similarity, recall, rows), rows), "minhash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    nodes = materialize(sig.where("node is not null").groupBy("node").agg(least.alias("least"), F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")
    placed = materialize(candidate_groups(nodes, tile).join(nodes.select("node", "text_key", "copies"), "node"), "placed")

    texts = docs.select(_text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if placed.count() <= broadcast_rows:  # else the join below shuffles all texts
        texts = texts.join(F.broadcast(placed.select(F.col("text_key.a").alias("wanted")).distinct()), F.col("text_key.a") == F.col("wanted"), "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in blocks.cut_blocks(batches, 4 << 20):
            sets = [gram_set(t.as_py(), known, n).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "copies", "groups")), pa.array(sets, pa.binary())], ["node", "copies", "groups", "grams"])

    found_sets = placed.join(texts, "text_key").select("node", "copies", "groups", "text").mapInArrow(with_sets, "node binary, copies long, groups array<struct<label: bigint, nb: int>>, grams binary")
    full = found_sets.withColumn("g", F.explode("groups")).select("node", "copies", "g.label", "g.nb", F.transform(F.filter("groups", lambda x: x["label"] < F.col("g.label")), lambda x: x["label"]).alias("met"), "grams")
    block = F.when(F.col("nb") > 1, F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).otherwise(0)
    dealt = full.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    at_least = Fraction(str(similarity))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, low, high), t in _tiles(batches):
            sets = [np.frombuffer(g.as_py(), np.uint64) for g in t.column("grams")]
            side = None if low == high else np.asarray(t.column("block").combine_chunks())
            node = t.column("node").to_pylist()
            links, root = tile_links(sets, np.asarray(t.column("copies").combine_chunks()), side, at_least, t.column("met").to_pylist())
            names = [xxhash.xxh3_128_digest(b"%d|%d|%d|" % (label, low, high) + node[r]) for r in root]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links), pa.array(names, pa.binary())], ["node", "links", "grp"])

    in_tiles = dealt.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
    found = materialize(in_tiles.select("label", "low", "high", "node", "copies", "block", "met", "grams").mapInArrow(verify, "node binary, links long, grp binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = materialize(found.groupBy("grp").count().where("count > 1").select("grp"), "joined")
    root = components(materialize(found.select("node", "grp").join(joined, "grp"), "linked"), "classes")
    links = materialize(links, "node-links")
    of_node = nodes.join(links, "node", "left").join(root, "node", "left").select("node", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    of_node = materialize(of_node, "of-node")
    head = materialize(of_node.groupBy("label").agg(F.min("least").alias("head")), "heads")
    known = of_node.join(head, "label").select("node", "head", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    own = sig.select("id", "text_key", "node").join(known, "node", "left")
    alone = F.col("node").isNull()
    return own.select(
        "id",
        "text_key",
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(alone, F.col("text_key")).otherwise(F.col("head.text_key")).alias("keeper_key"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """All columns of docs, of one row of each class: the one with the least id (null last), then text key.

    Of rows with this id and text but other columns the least as JSON text stays. Null and empty texts
    are classes of their own, one for each id. Rows that go are told by their keys, so the texts of
    those that stay are shuffled only if more than ``broadcast_rows`` go.
    """
    known = materialize(classes(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options).select("id", "text_key", "class_id", "keeper_key"), "known-classes")
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("keeper_key"))
    key = [F.col("id").alias("key_id"), F.col("text_key").alias("key_text")]
    gone = materialize(known.where(~kept).select(*key).distinct(), "gone")
    several = materialize(known.where(kept).groupBy(*key).count().where("count > 1").select("key_id", "key_text"), "several")
    near = (lambda df: F.broadcast(df)) if gone.count() + several.count() <= broadcast_rows else (lambda df: df)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), _text_key(f"`{text_col}`").alias("text_key"))
    same = lambda df: rows["id"].eqNullSafe(df["key_id"]) & (rows["text_key"] == df["key_text"])
    other = gone.unionAll(several)
    single = rows.join(near(other), same(other), "left_anti").select("row.*")
    least = rows.join(near(several), same(several), "left_semi").groupBy("id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return single.unionAll(least)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")
