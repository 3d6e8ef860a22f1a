"""Delta replication: buffers, acknowledgements, causal intervals, simulated links and gossip.

A delta log is (replica, seq, payload...) rows; peers' acknowledgements are (replica, peer, acked). Joining
a buffered group is the lattice's own aggregate over the rows of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.functions.hashing import message_id
from tideweave.functions.scalars import lcg_next, lcg_uniform
from tideweave.operators import prefix
from tideweave.operators.sets import same_rows, union_all
from tideweave.sources.shared import materialize

BUFFER, FANOUT, TTL, SEEN = 100, 3, 6, 1000


def numbered(arrivals: DataFrame) -> DataFrame:
    """Delta log with sequence numbers by arrival, per replica."""
    return prefix.running(arrivals, ["replica"], ["arrival"], seq=("sum", F.lit(1)))


def deltas_since(log: DataFrame, acks: DataFrame) -> DataFrame:
    """Rows each peer has not acknowledged: replica, peer, seq, ..."""
    return log.join(acks, "replica").where(F.col("seq") > F.col("acked"))


def delta_groups(log: DataFrame, acks: DataFrame, *joined: Column) -> DataFrame:
    """One joined delta per (replica, peer), with the sequence number it brings the peer to."""
    return deltas_since(log, acks).groupBy("replica", "peer").agg(F.max("seq").alias("to_seq"), F.count(F.lit(1)).alias("n"), *joined)


def merged_acks(acks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Greatest acknowledgement per registered peer; others are ignored."""
    known = incoming.join(acks.select("replica", "peer"), ["replica", "peer"], "left_semi")
    return union_all(acks, known.select(*acks.columns)).groupBy("replica", "peer").agg(F.max("acked").alias("acked"))


def registered(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(a, b, 0) for a, b in pairs], "replica string, peer string, acked long")


def min_acked(acks: DataFrame) -> DataFrame:
    return acks.groupBy("replica").agg(F.coalesce(F.min("acked"), F.lit(0)).alias("acked"))


def collected(log: DataFrame, acks: DataFrame) -> DataFrame:
    """The log without what all peers have; a replica without peers keeps all."""
    least = min_acked(acks)
    return log.join(least, "replica", "left").where(F.col("seq") > F.coalesce("acked", F.lit(0))).drop("acked")


def bounded_buffer(log: DataFrame, capacity: int = BUFFER) -> DataFrame:
    """The log with ``slot``: beyond the capacity the oldest rows share slot 0, to be joined into one delta."""
    ranked = prefix.running(log, ["replica"], ["seq"], _rank=("sum", F.lit(1)))
    sizes = log.groupBy("replica").agg(F.count(F.lit(1)).alias("_size"))
    back = F.col("_size") - F.col("_rank") + 1  # how many rows from the newest on
    return ranked.join(sizes, "replica").withColumn("slot", F.greatest(F.lit(capacity) - back, F.lit(0)).cast("int")).select(*log.columns, "slot")


def has_pending(log: DataFrame, acks: DataFrame) -> DataFrame:
    tops = log.groupBy("replica").agg(F.max("seq").alias("top"))
    return acks.join(tops, "replica", "left").groupBy("replica").agg(F.bool_or(F.coalesce("top", F.lit(0)) > F.col("acked")).alias("pending"))


def intervals(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """from_replica, to_replica, from_seq, to_seq of what each send covers: cuts are replica, peer, at (its counter then)."""
    w = Window.partitionBy("replica", "peer").orderBy("at")
    spans = cuts.select(F.col("replica").alias("from_replica"), F.col("peer").alias("to_replica"), F.coalesce(F.lag("at").over(w), F.lit(0).cast("long")).alias("from_seq"), F.col("at").alias("to_seq"))
    return spans.where("to_seq > from_seq")


def causal_prefix(sent: DataFrame) -> DataFrame:
    """Intervals with ``applied``: whether they reach back to 0 without a gap.

    Duplicates and intervals inside what others cover are applied as well (they change nothing).
    """
    pair, order = ["from_replica", "to_replica"], F.struct("from_seq", "to_seq", "arrival")
    seen = prefix.running(sent, pair, ["from_seq", "to_seq", "arrival"], _reach=("max before", F.col("to_seq")))
    gaps = seen.where(F.col("from_seq") > F.coalesce("_reach", F.lit(0))).groupBy(*pair).agg(F.min(order).alias("_gap"))  # one row per pair
    applied = F.col("_gap").isNull() | (order < F.col("_gap"))
    return seen.join(gaps, pair, "left").withColumn("applied", applied).select(*sent.columns, "applied")


def interval_acks(applied: DataFrame) -> DataFrame:
    """from_replica, to_replica, acked: what a receiver acknowledges."""
    return applied.where("applied").groupBy("from_replica", "to_replica").agg(F.max("to_seq").alias("acked"))


def buffered_intervals(applied: DataFrame) -> DataFrame:
    """to_replica, from_replica, n: intervals that wait for a gap to be filled."""
    return applied.where("not applied").groupBy("to_replica", "from_replica").agg(F.count(F.lit(1)).alias("n"))


def pending_intervals(applied: DataFrame) -> DataFrame:
    """to_replica, n: how many intervals of any sender wait there."""
    return buffered_intervals(applied).groupBy("to_replica").agg(F.sum("n").alias("n"))


def converged(states: DataFrame, *content: str) -> DataFrame:
    """One row: whether all holders have the same rows. states: holder and content columns."""
    return same_rows(states, "holder", *content)


def link(messages: DataFrame, loss: float = 0.0, dup: float = 0.0, reorder: float = 0.0, seed: int = 12345) -> DataFrame:
    """A simulated link: messages with ``lost``, ``copy`` and ``deliver_at``.

    Every message draws from the generator seeded by seed and its number, so that the fate of a
    message does not depend on partitions or on other messages. messages: n (its number) and more.
    """
    state = [lcg_next(F.pmod(F.col("n") * F.lit(2654435761) + F.lit(seed), F.lit(2147483648)))]
    for _ in range(2):
        state.append(lcg_next(state[-1]))
    u = [lcg_uniform(s) for s in state]
    rows = messages.withColumns({"lost": u[0] < loss, "_dup": u[1] < dup, "_late": u[2] < reorder})
    copies = rows.withColumn("copy", F.explode(F.when(F.col("_dup"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = F.col("n") * 4 + F.col("copy") + F.when(F.col("_late"), 10).otherwise(0)
    return copies.withColumn("deliver_at", at).drop("_dup", "_late")


def delivered(sent: DataFrame) -> DataFrame:
    return sent.where("not lost").orderBy("deliver_at")


def next_delivery(sent: DataFrame, link_: str) -> DataFrame:
    """The head of each link's queue (a column): the message to be delivered first, of equal ones the lesser number."""
    return sent.where("not lost").groupBy(link_).agg(F.min(F.struct("deliver_at", "n", "copy")).alias("head")).select(link_, "head.*")


def cleared(log: DataFrame, acks: DataFrame) -> DataFrame:
    """Peers' buffers (replica, peer, seq, ...) without those of the peers that acknowledge anything, whatever number they give."""
    return log.join(acks.select("replica", "peer").distinct(), ["replica", "peer"], "left_anti")


def retransmitted(sent: DataFrame) -> DataFrame:
    """What was lost, to be sent again."""
    return sent.where("lost and copy = 0")


def mesh(spark: SparkSession, names: list[str]) -> DataFrame:
    """src, dst of a full mesh of a few named replicas."""
    return spark.createDataFrame([(a, b) for a in names for b in names if a != b], "src string, dst string")


def channel_pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    """src, dst of a channel between two replicas, in both directions."""
    return mesh(spark, [a, b])


def connections(log: DataFrame) -> DataFrame:
    """src, dst of the peers that are connected after a log (src, dst, kind connect or disconnect, arrival); a channel goes with its peer."""
    last = log.groupBy("src", "dst").agg(F.max_by("kind", "arrival").alias("kind"))
    return last.where("kind = 'connect'").select("src", "dst")


def peers(edges: DataFrame) -> DataFrame:
    """src, peers: the connected peers of each replica by name."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("peers"))


def hello(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, events) when replicas (src) come up: a Hello to each connected peer, and one Connected event of their own."""
    messages = fanned_out(names.select("src").distinct().withColumn("kind", F.lit("Hello")), edges)
    return messages.select("src", "dst", "kind"), names.select(F.col("src").alias("replica")).distinct().withColumn("event", F.lit("Connected"))


def drain(events: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events not yet taken, the position after them): events have replica and arrival; taken is replica, arrival, its last position."""
    upto = taken.select("replica", F.col("arrival").alias("_upto"))
    new = events.join(upto, "replica", "left").where(F.col("arrival") > F.coalesce("_upto", F.lit(-1))).drop("_upto")
    return new, union_all(taken.select("replica", "arrival"), new.select("replica", "arrival")).groupBy("replica").agg(F.max("arrival").alias("arrival"))


def routed(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Point-to-point messages (src, dst) with ``error``: PeerNotFound where there is no edge."""
    known = edges.select("src", "dst", F.lit(True).alias("_ok"))
    return messages.join(known, ["src", "dst"], "left").withColumn("error", F.when(F.col("_ok").isNull(), "PeerNotFound")).drop("_ok")


def fanned_out(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Broadcast messages (src): a row per outgoing edge."""
    return messages.join(edges, "src")


def first_peers(edges: DataFrame, n: int = FANOUT, exclude: DataFrame | None = None) -> DataFrame:
    """The first n peers of each replica by name; exclude: src, dst not to be chosen."""
    able = edges if exclude is None else edges.join(exclude, ["src", "dst"], "left_anti")
    w = Window.partitionBy("src").orderBy("dst")
    return able.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def announcement(heads: DataFrame, ttl: int = TTL) -> DataFrame:
    """Messages for rows origin, heads, timestamp."""
    return heads.select(message_id(F.col("origin"), F.col("heads"), F.col("timestamp")).alias("id"), "origin", "heads", "timestamp", F.lit(ttl).alias("ttl"))


def forwarded(messages: DataFrame) -> DataFrame:
    """Messages one hop on; those whose time to live is over are left out."""
    return messages.where("ttl > 0").withColumn("ttl", F.col("ttl") - 1)


def gossip(messages: DataFrame, edges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """id, replica, hop, ttl: who hears of each announcement, when, and with which time to live.

    The origin sends with the message's own ttl. A message that comes with ttl 0 is dropped; else the
    receiver passes it on once, with ttl - 1, to its first ``fanout`` peers other than sender and
    origin. Rounds run until nobody new hears of anything.
    """
    every = messages.select("id", "origin", F.col("origin").alias("replica"), F.lit(None).cast("string").alias("sender"), "ttl", F.col("ttl").alias("send"), F.lit(0).alias("hop"))
    new, hop = every, 0
    while True:
        hop += 1
        out = new.where("send > 0").join(edges, F.col("replica") == F.col("src")).where("dst <> origin and (sender is null or dst <> sender)")
        w = Window.partitionBy("id", "replica").orderBy("dst")
        sent = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fanout)
        first = sent.groupBy("id", "origin", F.col("dst").alias("replica")).agg(F.max(F.struct("send", F.col("src").alias("sender"))).alias("best"))
        fresh = first.select("id", "origin", "replica", "best.sender", F.col("best.send").alias("ttl"), (F.col("best.send") - 1).alias("send"), F.lit(hop).alias("hop"))
        new = materialize(fresh.join(every.select("id", "replica"), ["id", "replica"], "left_anti"), "gossip")
        if new.isEmpty():
            return every.select("id", "origin", "replica", "hop", "ttl")
        every = materialize(every.unionByName(new), "heard")


def seen_window(seen: DataFrame, size: int = SEEN) -> DataFrame:
    """The newest ``size`` message ids per replica: seen are replica, id, arrival."""
    w = Window.partitionBy("replica").orderBy(F.desc("arrival"), "id")
    return seen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def peer_versions(updates: DataFrame) -> DataFrame:
    """peer, versions: a map from document to the last version told (a later message overwrites)."""
    last = updates.groupBy("peer", "doc_id").agg(F.max_by("version", "arrival").alias("version"))
    return last.groupBy("peer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "version")))).alias("versions"))
