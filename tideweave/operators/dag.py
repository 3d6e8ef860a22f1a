"""A content-addressed update DAG: nodes (cid, parents, payload_type, payload, timestamp, creator).

Heads, missing nodes and children are anti and equi joins over the edge relation. Closures and
levels iterate one join per level; each round is cut by a written checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.functions.hashing import node_cid
from tideweave.operators.sets import same_rows, union_all
from tideweave.sources.shared import counted, materialize, shuffled

GENESIS, DELTA, SNAPSHOT = 0, 1, 2
#: Waves that one round of levels makes.
WAVES = 4
#: Hops up to which ancestors are found without a round per hop.
FEW_HOPS = 4


def with_cid(nodes: DataFrame) -> DataFrame:
    """Nodes with their content id: parents, payload_type, payload, timestamp, creator are hashed."""
    return nodes.withColumn("cid", node_cid(F.col("parents"), F.col("payload_type"), F.col("payload"), F.col("timestamp"), F.col("creator")))


def genesis(spark: SparkSession, creator: str) -> DataFrame:
    row = spark.range(1).select(F.array().cast("array<string>").alias("parents"), F.lit(GENESIS).cast("tinyint").alias("payload_type"), F.lit(b"").alias("payload"), F.lit(0).cast("long").alias("timestamp"), F.lit(creator).alias("creator"))
    return with_cid(row).select("cid", "parents", "payload_type", "payload", "timestamp", "creator")


def verify(nodes: DataFrame) -> DataFrame:
    """Nodes whose content id is right."""
    return nodes.where(F.col("cid") == node_cid(F.col("parents"), F.col("payload_type"), F.col("payload"), F.col("timestamp"), F.col("creator")))


def is_genesis(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.size("parents") == 0) & (F.col("payload_type") == GENESIS))


def edges(nodes: DataFrame) -> DataFrame:
    """child, parent."""
    return nodes.select(F.col("cid").alias("child"), F.explode("parents").alias("parent")).distinct()


def is_parent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (child, parent) with ``direct``: whether the one is a direct parent of the other."""
    return pairs.join(edges(nodes).withColumn("direct", F.lit(True)), ["child", "parent"], "left").fillna(False, ["direct"])


def n_parents(nodes: DataFrame) -> DataFrame:
    """cid, n."""
    return nodes.select("cid", F.size(F.array_distinct("parents")).alias("n"))


def payload_kinds(nodes: DataFrame) -> DataFrame:
    """cid, is_genesis, is_delta, is_snapshot; a genesis also has no parents."""
    kind = F.col("payload_type")
    return nodes.select("cid", ((kind == GENESIS) & (F.size("parents") == 0)).alias("is_genesis"), (kind == DELTA).alias("is_delta"), (kind == SNAPSHOT).alias("is_snapshot"))


def children(nodes: DataFrame, cids: DataFrame) -> DataFrame:
    """parent, child of the wanted parents (cid)."""
    return edges(nodes).join(cids.select(F.col("cid").alias("parent")), "parent", "left_semi").select("parent", "child")


def heads(nodes: DataFrame) -> DataFrame:
    """Nodes that no node has as parent."""
    return nodes.select("cid").distinct().join(shuffled(nodes.select(F.explode("parents").alias("cid"))), "cid", "left_anti")


def missing(nodes: DataFrame) -> DataFrame:
    """Parents that are referred to and not there."""
    return edges(nodes).select(F.col("parent").alias("cid")).distinct().join(shuffled(nodes.select("cid")), "cid", "left_anti")


def need(nodes: DataFrame, announced: DataFrame) -> DataFrame:
    return announced.select("cid").distinct().join(shuffled(nodes.select("cid")), "cid", "left_anti")


def ancestors(nodes: DataFrame, start: DataFrame, max_depth: int | None = None, include_self: bool = False) -> DataFrame:
    """start, cid, depth: nodes reachable over parents, absent ones included; depth is the least. start: cid.

    A few hops are one plan of equi joins with one aggregate at its end; a closure runs a round per level.
    """
    frontier = start.select(F.col("cid").alias("start"), "cid").distinct()
    if max_depth is not None and max_depth <= FEW_HOPS:
        up = nodes.select("cid", F.explode("parents").alias("parent"))
        found = frontier.withColumn("depth", F.lit(0))
        for depth in range(1, max_depth + 1):
            frontier = frontier.join(up, "cid").select("start", F.col("parent").alias("cid"))
            found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
        least = found.groupBy("start", "cid").agg(F.min("depth").alias("depth"))
        return least if include_self else least.where("depth > 0")
    up = materialize(edges(nodes), "edges")
    found = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(up.withColumnRenamed("child", "cid"), "cid").select("start", F.col("parent").alias("cid")).distinct()
        frontier = materialize(step.join(found.select("start", "cid"), ["start", "cid"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            found = materialize(found, "closure")
    return found if include_self else found.where("depth > 0")


def reachable(nodes: DataFrame, start: DataFrame, max_depth: int | None = None, include_self: bool = False) -> DataFrame:
    """cid: what ancestors() reaches from any of start, each once.

    Without the pairs of ancestors() no node is followed twice, so all rounds together take a row per edge.
    """
    frontier = start.select("cid").distinct()
    if max_depth is not None and max_depth <= FEW_HOPS:
        up, found = nodes.select("cid", F.explode("parents").alias("parent")), [frontier] if include_self else []
        for _ in range(max_depth):
            frontier = frontier.join(shuffled(up), "cid").select(F.col("parent").alias("cid")).distinct()
            found.append(frontier)
        return union_all(*found).distinct() if found else frontier.limit(0)
    up = materialize(edges(nodes).withColumnRenamed("child", "cid"), "edges")
    frontier, rows = counted(frontier, "frontier")
    found, depth = frontier if include_self else None, 0
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = up.join(frontier, "cid").select(F.col("parent").alias("cid")).distinct()
        frontier, rows = counted(step if found is None else step.join(shuffled(found), "cid", "left_anti"), "frontier")
        found = frontier if found is None else found.unionByName(frontier)
        if depth % 8 == 0:
            found = materialize(found, "closure")
    return found.select("cid") if found is not None else frontier


def missing_ancestors(nodes: DataFrame, start: DataFrame, max_depth: int = 1000) -> DataFrame:
    return reachable(nodes, start, max_depth, include_self=True).join(shuffled(nodes.select("cid")), "cid", "left_anti")


def levels(nodes: DataFrame) -> DataFrame:
    """cid, level: nodes on the longest path from a root, counted in nodes; the order of (level, cid) is topological.

    Wave k holds the nodes that end a path of k nodes from a root; a node's level is its last wave. A
    round makes ``WAVES`` waves and writes these alone.
    """
    here = nodes.select("cid").distinct()
    up = edges(nodes).join(shuffled(here.withColumnRenamed("cid", "parent")), "parent", "left_semi")  # a child is always there
    up = materialize(up, "edges")
    wave = here.join(shuffled(up.select(F.col("child").alias("cid"))), "cid", "left_anti")
    found, depth, most = wave.withColumn("level", F.lit(1)), 1, None
    while True:
        waves = []
        for i in range(1, WAVES + 1):
            wave = wave.join(shuffled(up.withColumnRenamed("parent", "cid")), "cid").select(F.col("child").alias("cid")).distinct()
            waves.append(wave.withColumn("level", F.lit(depth + i)))
        new = materialize(union_all(*waves), "waves")
        if new.isEmpty():
            break
        found, depth = found.unionByName(new), depth + WAVES
        wave = new.where(F.col("level") == depth).select("cid")
        if depth % 64 == 1:
            found = materialize(found.groupBy("cid").agg(F.max("level").alias("level")), "levels")
            most = most or here.count()
            if depth > most:
                raise ValueError("the parents form a cycle")
    level = materialize(found.groupBy("cid").agg(F.max("level").alias("level")), "levels")
    if not here.join(shuffled(level), "cid", "left_anti").isEmpty():
        raise ValueError("the parents form a cycle")
    return level


def topological_order(nodes: DataFrame) -> DataFrame:
    return levels(nodes).orderBy("level", "cid")


def stats(nodes: DataFrame, with_depth: bool = True) -> DataFrame:
    """One row: nodes, heads, missing, branching (children per node that has any), and depth."""
    e = edges(nodes)
    rows = [
        nodes.agg(F.countDistinct("cid").alias("v")).select(F.lit("nodes").alias("k"), F.col("v").cast("double")),
        heads(nodes).agg(F.count(F.lit(1)).alias("v")).select(F.lit("heads"), F.col("v").cast("double")),
        missing(nodes).agg(F.count(F.lit(1)).alias("v")).select(F.lit("missing"), F.col("v").cast("double")),
        e.agg((F.count(F.lit(1)) / F.countDistinct("parent")).alias("v")).select(F.lit("branching"), "v"),
    ]
    if with_depth:
        rows.append(levels(nodes).agg(F.max("level").alias("v")).select(F.lit("depth"), F.col("v").cast("double")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    whole = [pick(k).cast("long").alias(k) for k in ("nodes", "heads", "missing", *(["depth"] if with_depth else []))]
    return every.agg(*whole, F.coalesce(pick("branching"), F.lit(0.0)).alias("branching"))


def put(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes that may be stored: right id, not there yet, and all parents there or among the accepted ones.

    Chains within the batch are accepted level by level until nothing more fits.
    """
    fresh = materialize(verify(new).dropDuplicates(["cid"]).join(shuffled(nodes.select("cid")), "cid", "left_anti"), "incoming")
    wanted = materialize(fresh.select("cid", F.explode("parents").alias("parent")).join(shuffled(nodes.select(F.col("cid").alias("parent"))), "parent", "left_anti"), "wanted")
    accepted = None
    while True:
        open_ = wanted if accepted is None else wanted.join(shuffled(accepted.select(F.col("cid").alias("parent"))), "parent", "left_anti")
        ok = materialize(fresh.select("cid").join(shuffled(open_.select("cid")), "cid", "left_anti"), "accepted")
        if accepted is not None and ok.count() == accepted.count():
            return fresh.join(shuffled(ok), "cid", "left_semi")
        accepted = ok


def put_unchecked(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes with a right id, gaps allowed."""
    return verify(new).dropDuplicates(["cid"]).join(shuffled(nodes.select("cid")), "cid", "left_anti")


def handle_request(nodes: DataFrame, want: DataFrame, have: DataFrame, limit: int = 100) -> DataFrame:
    """Nodes for a peer in topological order with ``sent`` (else they are the rest): the wanted ones, and all it lacks.

    want: cid; have: the peer's heads (cid), whose ancestors it holds too.
    """
    placed = _offered(nodes, want, have).join(shuffled(levels(nodes)), "cid")
    first = placed.orderBy("level", "cid").limit(limit).select("cid", F.lit(True).alias("sent"))
    return placed.join(F.broadcast(first), "cid", "left").fillna(False, ["sent"])


def _offered(nodes: DataFrame, want: DataFrame, have: DataFrame) -> DataFrame:
    """Nodes for a peer in no order: the wanted ones, and all it lacks."""
    known = reachable(nodes, have, include_self=True)
    lacks = nodes.join(shuffled(known), "cid", "left_anti").select("cid")
    wanted = nodes.select("cid").join(shuffled(want.select("cid")), "cid", "left_semi")
    return nodes.join(shuffled(lacks.unionByName(wanted).distinct()), "cid", "left_semi")


def sync_from(nodes: DataFrame, peer: DataFrame, limit: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, new): one exchange with a peer. It is told what is lacking of its heads and which heads are here,
    answers with at most ``limit`` nodes in topological order, and these are stored after a check.

    No limit: the whole answer. Messages in topological order would be stored one after another, and what
    is stored of them all is what put() stores of all at once, so the answer is not put into order for it.
    """
    want, have = need(nodes, heads(peer)), heads(nodes)
    answer = _offered(peer, want, have) if limit is None else handle_request(peer, want, have, limit).where("sent")
    new = materialize(put(nodes, answer.select(*nodes.columns)).select(*nodes.columns), "received")
    return nodes.unionByName(new), new


def is_synced(nodes: DataFrame, peer_heads: DataFrame) -> DataFrame:
    """One row: all of the peer's heads are there and nothing is missing."""
    return need(nodes, peer_heads).unionAll(missing(nodes)).agg((F.count(F.lit(1)) == 0).alias("synced"))


def sync_all(replicas: DataFrame, most: int = 10_000) -> DataFrame:
    """Full exchange between replicas in one step: every replica gets every node. replicas: replica and node columns.

    The result is replicas times nodes rows by definition; the names of at most ``most`` replicas are
    laid beside the nodes as one array.
    """
    every = replicas.drop("replica").dropDuplicates(["cid"])
    names = [r[0] for r in replicas.select("replica").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} replicas")
    return every.withColumn("replica", F.explode(F.lit(sorted(names)))).select(*replicas.columns)


def seeded(spark: SparkSession, names: list[str], creator: str) -> DataFrame:
    """Replicas (replica and node columns) that all hold one genesis."""
    return genesis(spark, creator).withColumn("replica", F.explode(F.lit(names))).select("replica", "cid", "parents", "payload_type", "payload", "timestamp", "creator")


def n_replicas(replicas: DataFrame) -> DataFrame:
    return replicas.agg(F.countDistinct("replica").alias("n"))


def converged(replicas: DataFrame) -> DataFrame:
    """One row: all replicas have the same heads, as far as their number and two sums of hashes tell."""
    up = replicas.select("replica", F.explode("parents").alias("cid"))
    own = replicas.select("replica", "cid").distinct().join(up, ["replica", "cid"], "left_anti")
    return same_rows(own, "replica", "cid")


def first_parent_path(nodes: DataFrame) -> DataFrame:
    """The chain of first parents from the least head: cid, depth.

    Jumps double in each round, so a chain of n nodes takes log2(n) rounds.
    """
    jump = nodes.select("cid", F.get("parents", F.lit(0)).alias("up")).where("up is not null")
    path = heads(nodes).agg(F.min("cid").alias("cid")).where("cid is not null").withColumn("depth", F.lit(0))
    step = 1
    while True:
        jump, path = materialize(jump, "jumps"), materialize(path, "path")
        more = path.join(jump, "cid").select(F.col("up").alias("cid"), (F.col("depth") + step).alias("depth"))
        if more.isEmpty():
            return path
        path = path.unionByName(more)
        jump = jump.join(jump.select(F.col("cid").alias("up"), F.col("up").alias("further")), "up").select("cid", F.col("further").alias("up"))
        step *= 2
