"""Stability, snapshots and pruning.

Frontiers are (holder, replica, seq) rows with the holder's latest update only; snapshots keep their
vector as a map. Everything that depends on time takes ``now`` as a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideweave.functions.hashing import node_cid, snapshot_id
from tideweave.operators import dag, vectors
from tideweave.sources.shared import materialize, shuffled

#: Defaults of the knobs.
SNAPSHOT_MIN_OPS, SNAPSHOT_MAX_AGE, SNAPSHOT_KEEP = 1000, 10_000, 10
PRUNE_MIN_SNAPSHOTS, PRUNE_MIN_AGE, PRUNE_MAX_NODES, PRESERVE_DEPTH = 2, 5000, 1000, 10
MIN_PEERS, MAX_FRONTIER_AGE, QUORUM = 1, 10_000, 0.67
COMPACT_MIN_OPS = 500


def latest_frontiers(updates: DataFrame) -> DataFrame:
    """Peers' newest frontier updates (peer, arrival, updated_at, vv, heads): a later update replaces, it is not merged."""
    best = updates.groupBy("peer").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "peer"]), "arrival").alias("u"))
    return best.select("peer", "u.*")


def peers(updates: DataFrame) -> DataFrame:
    """Peers that have told a frontier."""
    return updates.select("peer").distinct()


def frontier_rows(updates: DataFrame) -> DataFrame:
    """holder, replica, seq of frontier updates."""
    return updates.select(F.col("peer").alias("holder"), F.explode("vv").alias("replica", "seq"))


def frontier_update(vv: DataFrame, heads: DataFrame, holder: str, now: int) -> DataFrame:
    """One row to announce: the holder's vector and heads."""
    own = vv.where(F.col("holder") == holder).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("replica", "seq")))).alias("vv"))
    tops = heads.agg(F.array_sort(F.collect_list("cid")).alias("heads"))
    return own.join(F.broadcast(tops)).select(F.lit(holder).alias("peer"), F.lit(now).cast("long").alias("updated_at"), "vv", "heads")


def stale_peers(updates: DataFrame, now: int, max_age: int = MAX_FRONTIER_AGE) -> DataFrame:
    return latest_frontiers(updates).where(F.lit(now) - F.col("updated_at") > max_age).select("peer")


def drop_peers(frontiers: DataFrame, peers: DataFrame) -> DataFrame:
    """Frontiers without some peers (holders); the stable frontier may advance."""
    return frontiers.join(peers.select(F.col("peer").alias("holder")), "holder", "left_anti")


def is_operation_stable(frontier: DataFrame, events: DataFrame) -> DataFrame:
    return vectors.covered(frontier, events)


def is_stable(frontiers: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: does the stable frontier of all holders dominate a vector (replica, seq)?"""
    have = vectors.stable_frontier(frontiers).select("replica", F.col("seq").alias("have"))
    return wanted.join(have, "replica", "left").agg((F.count_if(F.col("seq") > F.coalesce("have", F.lit(0))) == 0).alias("stable"))


def stability_state(frontiers: DataFrame, wanted: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """One row: Unknown, Stable, Partial or Pending for a vector (replica, seq), with delivered and pending holders.

    Unknown: there are fewer than min_peers holders beside oneself.
    """
    need = wanted.where("seq > 0").agg(F.count(F.lit(1)).alias("entries"))
    has = frontiers.select("holder").distinct().join(
        frontiers.join(wanted.select("replica", F.col("seq").alias("want")), "replica").where("seq >= want and want > 0").groupBy("holder").agg(F.count(F.lit(1)).alias("met")), "holder", "left"
    )
    flags = has.join(F.broadcast(need)).select("holder", (F.coalesce("met", F.lit(0)) >= F.col("entries")).alias("delivered"))
    sets = flags.agg(F.array_sort(F.collect_set(F.when(F.col("delivered"), F.col("holder")))).alias("delivered"), F.array_sort(F.collect_set(F.when(~F.col("delivered"), F.col("holder")))).alias("pending"))
    n = F.size("delivered") + F.size("pending")
    state = F.when(n <= min_peers, "Unknown").when(F.size("pending") == 0, "Stable").when(F.size("delivered") > 0, "Partial").otherwise("Pending")
    return sets.select(state.alias("state"), "delivered", "pending")


def has_quorum(n_peers, responding, min_peers: int = MIN_PEERS, fraction: float = QUORUM, all_peers: bool = True):
    """Whether enough replicas (self counted) take part; of numbers or of columns."""
    members = n_peers + 1
    return (members >= min_peers) & (responding + 1 >= (members if all_peers else members * fraction))


def stability_stats(frontiers: DataFrame, local: str) -> DataFrame:
    """One row: peers, operations of the local holder, of the stable frontier, and those not yet stable."""
    own = frontiers.agg(F.countDistinct(F.when(F.col("holder") != local, F.col("holder"))).alias("peers"), F.coalesce(F.sum(F.when(F.col("holder") == local, F.col("seq"))), F.lit(0)).alias("local_ops"))
    stable = vectors.stable_frontier(frontiers).agg(F.coalesce(F.sum("seq"), F.lit(0)).alias("stable_ops"))
    return own.join(F.broadcast(stable)).withColumn("unstable_ops", F.greatest(F.col("local_ops") - F.col("stable_ops"), F.lit(0)))


def make_snapshots(rows: DataFrame) -> DataFrame:
    """Snapshots with their content id: rows are vv, superseded_roots, state, created_at, creator."""
    v = rows.withColumns({"version": F.lit(1).cast("tinyint"), "metadata": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))})
    return v.withColumn("id", snapshot_id(F.col("version"), F.col("state"), F.col("vv"), F.col("created_at"), F.col("creator")))


def with_metadata(snapshots: DataFrame, key: str, value: str) -> DataFrame:
    kept = F.map_filter("metadata", lambda k, v: k != key)
    return snapshots.withColumn("metadata", F.map_concat(kept, F.create_map(F.lit(key), F.lit(value))))


def snapshot_node(snapshots: DataFrame) -> DataFrame:
    """DAG nodes that carry snapshots: the payload is their JSON, the parents are the superseded roots."""
    state = F.base64("state").alias("state")
    payload = F.encode(F.to_json(F.struct("id", "version", "vv", "superseded_roots", state, "created_at", "creator", "metadata")), "utf-8")
    rows = snapshots.select(F.col("superseded_roots").alias("parents"), F.lit(dag.SNAPSHOT).cast("tinyint").alias("payload_type"), payload.alias("payload"), F.col("created_at").alias("timestamp"), "creator")
    return rows.withColumn("cid", node_cid(F.col("parents"), F.col("payload_type"), F.col("payload"), F.col("timestamp"), F.col("creator")))


def snapshot_from_node(nodes: DataFrame, version: int = 1) -> DataFrame:
    """Snapshots of DAG nodes; other payloads and versions are left out."""
    shape = "id string, version tinyint, vv map<string, bigint>, superseded_roots array<string>, state string, created_at bigint, creator string, metadata map<string, string>"
    parsed = nodes.where(F.col("payload_type") == dag.SNAPSHOT).select(F.from_json(F.decode("payload", "utf-8"), shape).alias("s")).select("s.*")
    return parsed.where(F.col("version") == version).withColumn("state", F.unbase64("state"))


def _entries(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.col("id").alias("holder"), F.explode("vv").alias("replica", "seq"))


def covering(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Snapshots whose vector dominates the wanted one (replica, seq)."""
    met = _entries(snapshots).join(wanted.select("replica", F.col("seq").alias("want")), "replica").where("seq >= want").groupBy("holder").agg(F.count_if(F.col("want") > 0).alias("met"))
    need = wanted.agg(F.count_if(F.col("seq") > 0).alias("entries"))
    ok = snapshots.join(met.withColumnRenamed("holder", "id"), "id", "left").join(F.broadcast(need)).where(F.coalesce("met", F.lit(0)) >= F.col("entries"))
    return ok.drop("met", "entries")


def best_covering(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """The covering snapshot with most operations; ties to the greater id."""
    total = F.aggregate(F.map_values("vv"), F.lit(0).cast("long"), lambda a, x: a + x)
    return covering(snapshots, wanted).withColumn("total_ops", total).orderBy(F.desc("total_ops"), F.desc("id")).limit(1)


def latest(snapshots: DataFrame, by: str | None = None) -> DataFrame:
    """The latest snapshot, of all or of each value of ``by``, with total_ops.

    Snapshots arrive in order of (created_at, id); one becomes the latest if there is none or if its
    vector dominates that of the latest so far, so concurrent ones never replace each other. This depends
    on the order and has no partial aggregate: ids and vectors alone stream past in order, one task for
    each value of ``by`` (without it one task; snapshots are few beside the operations they stand for).
    """
    key = F.col(by) if by else F.lit("")
    rows = snapshots.select(key.cast("string").alias("of"), "created_at", "id", F.map_keys("vv").alias("replicas"), F.map_values("vv").alias("seqs"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, vv, seen = None, None, {}, False
        done: list[str] = []
        for b in batches:
            for name, _, i, replicas, seqs in zip(*(c.to_pylist() for c in b.columns)):
                new = dict(zip(replicas or (), seqs or ()))
                if not seen or name != of:
                    done += [best] if seen else []
                    of, best, vv, seen = name, i, new, True
                elif all(new.get(r, 0) >= n for r, n in vv.items()):
                    best, vv = i, new
        yield pa.RecordBatch.from_arrays([pa.array(done + ([best] if seen else []), pa.string())], ["id"])

    placed = rows.repartition("of") if by else rows.coalesce(1)
    ids = placed.sortWithinPartitions("of", "created_at", "id").mapInArrow(fold, "id string")
    total = F.aggregate(F.map_values("vv"), F.lit(0).cast("long"), lambda a, x: a + x)
    return snapshots.dropDuplicates(["id"]).join(ids, "id", "left_semi").withColumn("total_ops", total)


def retained(snapshots: DataFrame, keep: int = SNAPSHOT_KEEP) -> DataFrame:
    """At most ``keep`` snapshots per creator: the latest always, then the newest."""
    top = latest(snapshots, "creator").select("id", F.lit(True).alias("_top"))
    ranked = snapshots.join(top, "id", "left").withColumn("_top", F.coalesce("_top", F.lit(False)))
    w = Window.partitionBy("creator").orderBy(F.desc("_top"), F.desc("created_at"), F.desc("id"))
    return ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= keep).select(*snapshots.columns)


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("state")), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def should_snapshot(n_snapshots, ops_since, age, min_ops: int = SNAPSHOT_MIN_OPS, max_age: int = SNAPSHOT_MAX_AGE):
    """Of numbers or of columns."""
    return (n_snapshots == 0) | (ops_since >= min_ops) | (age >= max_age)


def should_compact(auto, ops, n_snapshots, latest_stable, min_ops: int = COMPACT_MIN_OPS, min_snapshots: int = PRUNE_MIN_SNAPSHOTS):
    """Of numbers or of columns."""
    return auto & (ops >= min_ops) & (n_snapshots >= min_snapshots) & latest_stable


def prunable(nodes: DataFrame, roots: DataFrame, now: int, *, min_age: int = PRUNE_MIN_AGE, max_nodes: int = PRUNE_MAX_NODES, preserve_depth: int = PRESERVE_DEPTH, pinned: DataFrame | None = None, genesis_path: bool = True) -> DataFrame:
    """cid, level: nodes below superseded roots (cid) that may go, oldest levels first, max_nodes at most per run.

    Kept: what is within preserve_depth of a head, pinned cids, and the chain of first parents.
    """
    here = materialize(nodes, "dag")
    below = dag.reachable(here, roots)
    keep = dag.reachable(here, dag.heads(here), preserve_depth, include_self=True).unionByName(roots.select("cid"))
    if genesis_path:
        keep = keep.unionByName(dag.first_parent_path(here).select("cid"))
    if pinned is not None:
        keep = keep.unionByName(pinned.select("cid"))
    old = here.where(F.lit(now) - F.col("timestamp") >= min_age).select("cid")
    can = old.join(shuffled(below), "cid", "left_semi").join(shuffled(keep), "cid", "left_anti")
    return can.join(shuffled(dag.levels(here)), "cid").orderBy("level", "cid").limit(max_nodes)


def prune(nodes: DataFrame, cids: DataFrame) -> DataFrame:
    return nodes.join(shuffled(cids.select("cid")), "cid", "left_anti")


def should_prune(nodes: DataFrame, snapshot_is_stable: bool, require_stable: bool = True, preserve_depth: int = PRESERVE_DEPTH) -> bool:
    return (snapshot_is_stable or not require_stable) and nodes.limit(preserve_depth + 2).count() > preserve_depth + 1


def resurrections(live: DataFrame, pruned: DataFrame) -> DataFrame:
    """child, parent: live nodes that refer to pruned ones that are not themselves a boundary the prune left (empty is right)."""
    return dag.edges(live).join(pruned.select(F.col("cid").alias("parent")), "parent", "left_semi").select("child", "parent")


def disconnected(live: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Absent ancestors of heads, the pruned boundary excepted (empty is right)."""
    gone = dag.missing(live)
    return gone if pruned is None else gone.join(shuffled(pruned.select("cid")), "cid", "left_anti")


def pruned_below(nodes: DataFrame, roots: DataFrame, now: int, **policy) -> tuple[DataFrame, DataFrame]:
    """(nodes kept, cids pruned) of a batch job that rewrites the node table."""
    gone = materialize(prunable(nodes, roots, now, **policy).select("cid"), "pruned")
    return prune(nodes, gone), gone


@dataclass
class Compaction:
    """What a compaction did: nodes and snapshots as they are now, the id of a snapshot it made, the cids it pruned (none: None)."""

    nodes: DataFrame
    snapshots: DataFrame
    snapshot_created: str | None
    pruned: DataFrame | None

    @property
    def nodes_pruned(self) -> int:
        return self.pruned.count() if self.pruned is not None else 0


def _vector(frontiers: DataFrame, holder: str) -> dict[str, int]:
    """A holder's own vector: an entry per replica."""
    return {r["replica"]: r["seq"] for r in frontiers.where(F.col("holder") == holder).groupBy("replica").agg(F.max("seq").alias("seq")).where("seq > 0").collect()}


def compact(nodes: DataFrame, snapshots: DataFrame, frontiers: DataFrame, local: str, state: bytes, now: int, *, min_ops: int = SNAPSHOT_MIN_OPS, max_age: int = SNAPSHOT_MAX_AGE, verify: bool = True, **policy) -> Compaction:
    """Snapshot if due, prune below the latest one if it is stable, verify that no ancestor is lost but the pruned ones.

    frontiers: holder, replica, seq; the local holder's entries are its own vector. A new snapshot
    carries that vector and state and supersedes the heads. policy: of prunable(), and require_stable.
    """
    vv, created = _vector(frontiers, local), None
    newest = latest(snapshots).select("total_ops", "created_at").first()
    if newest is None or should_snapshot(1, sum(vv.values()) - newest["total_ops"], now - newest["created_at"], min_ops, max_age):
        heads = dag.heads(nodes).agg(F.array_sort(F.collect_list("cid")).alias("superseded_roots"))
        own = F.map_from_entries(F.array(*[F.struct(F.lit(r), F.lit(n).cast("long")) for r, n in sorted(vv.items())])) if vv else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        new = materialize(make_snapshots(heads.select(own.alias("vv"), "superseded_roots", F.lit(state).alias("state"), F.lit(now).cast("long").alias("created_at"), F.lit(local).alias("creator"))), "snapshot")
        created, snapshots = new.select("id").first()["id"], snapshots.unionByName(new.select(*snapshots.columns))
    last = materialize(latest(snapshots), "latest")
    wanted = last.select(F.explode("vv").alias("replica", "seq"))
    require = policy.pop("require_stable", True)
    pruned = None
    if should_prune(nodes, is_stable(frontiers, wanted).first()["stable"], require, policy.get("preserve_depth", PRESERVE_DEPTH)):
        nodes, pruned = pruned_below(nodes, last.select(F.explode("superseded_roots").alias("cid")), now, **policy)
    if verify and not disconnected(nodes, pruned).isEmpty():
        raise ValueError("nodes are missing below the heads that no compaction pruned")
    return Compaction(nodes, snapshots, created, pruned)


def bootstrap(snapshot_vv: DataFrame, log: DataFrame) -> DataFrame:
    """Operations to replay on a snapshot: those (replica, seq) beyond its vector."""
    have = snapshot_vv.select("replica", F.col("seq").alias("have"))
    return log.join(have, "replica", "left").where(F.col("seq") > F.coalesce("have", F.lit(0))).drop("have")


def tick(nodes: DataFrame, snapshots: DataFrame, frontiers: DataFrame, updates: DataFrame, local: str, state: bytes, now: int, *, auto: bool = True, compact_ops: int = COMPACT_MIN_OPS, min_snapshots: int = PRUNE_MIN_SNAPSHOTS, **policy) -> Compaction | None:
    """A scheduled run at time now: drops stale peers, then compacts if that is due; None when it is not.

    Due: the local holder has compact_ops operations, there are min_snapshots snapshots, and the latest
    is stable among the peers that are left.
    """
    fresh = drop_peers(frontiers, stale_peers(updates, now))
    last = latest(snapshots).select(F.explode("vv").alias("replica", "seq"))
    stable = snapshots.limit(1).count() > 0 and is_stable(fresh, last).first()["stable"]
    if not should_compact(auto, sum(_vector(fresh, local).values()), snapshots.limit(min_snapshots).count(), stable, compact_ops, min_snapshots):
        return None
    return compact(nodes, snapshots, fresh, local, state, now, **policy)
