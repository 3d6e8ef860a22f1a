"""Queries over the update DAG, its compaction, replication and gossip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideweave.functions import hashing, scalars
from tideweave.operators import compaction, dag, replication
from tideweave.plans.sql import EV, NODES, le8
from tideweave.sources import logs


def _dag(spark, d):
    return logs.named_dag(logs.events(spark, d))


def _hashed(spark, d):
    return hashed(logs.events(spark, d))


def hashed(ev):
    """Two real levels: a genesis per user, and each event as its child."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    none = F.array().cast("array<string>")
    roots = ev.select("user_id", user.alias("creator")).distinct().withColumns({"parents": none, "payload_type": F.lit(0).cast("tinyint"), "payload": F.lit(b""), "timestamp": F.lit(0).cast("long")})
    roots = dag.with_cid(roots)
    kids = ev.join(roots.select("user_id", F.col("cid").alias("root")), "user_id")
    kids = kids.select(F.array("root").alias("parents"), F.lit(1).cast("tinyint").alias("payload_type"), F.encode("event_type", "utf-8").alias("payload"), F.col("ts_ms").alias("timestamp"), F.col("replica").alias("creator"))
    cols = ["cid", "parents", "payload_type", "payload", "timestamp", "creator"]
    return roots.select(*cols).unionByName(dag.with_cid(kids).select(*cols))


def dag_cid(spark, d):
    return _hashed(spark, d).select("cid", F.size("parents").alias("n_parents"), "timestamp", "creator")


def dag_verify(spark, d):
    """Every fiftieth event's payload is tampered with; those nodes are rejected."""
    n = _hashed(spark, d).withColumn("payload", F.when(F.col("timestamp") % 50 == 1, F.lit(b"tampered")).otherwise(F.col("payload")))
    return dag.verify(n).select("cid", "creator")


def dag_genesis(spark, d):
    return dag.is_genesis(_dag(spark, d)).select("cid", "creator")


def dag_heads(spark, d):
    return dag.heads(_dag(spark, d))


def dag_missing(spark, d):
    return dag.missing(_dag(spark, d).where("cid not like '%50'"))


def dag_children(spark, d):
    n = _dag(spark, d)
    return dag.children(n, n.select("cid"))


def dag_stats(spark, d):
    return dag.stats(_dag(spark, d).where("cid not like '%50'"))


def dag_levels(spark, d):
    return dag.levels(_dag(spark, d))


def dag_ancestors(spark, d):
    n = _dag(spark, d)
    return dag.ancestors(n, dag.heads(n)).groupBy("start").agg(F.countDistinct("cid").alias("n"))


def dag_k_hop(spark, d):
    n = _dag(spark, d)
    return dag.ancestors(n, dag.heads(n), max_depth=3).groupBy("start").agg(F.countDistinct("cid").alias("n"))


def dag_sync_need(spark, d):
    n = _dag(spark, d)
    return dag.need(n.where("creator <> 'r1'"), dag.heads(n))


def dag_missing_ancestors(spark, d):
    n = _dag(spark, d)
    return dag.missing_ancestors(n.where("cid not like '%50'"), dag.heads(n))


def dag_put(spark, d):
    """Nodes not of r1 are there; of the others those are accepted whose parents are there or accepted."""
    n = _hashed(spark, d)
    return dag.put(n.where("creator not in ('u1', 'u9')"), n).select("cid", "creator")


def dag_converged(spark, d):
    n = _dag(spark, d)
    both = n.withColumn("replica", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return dag.converged(both)


def dag_first_parents(spark, d):
    return dag.first_parent_path(_dag(spark, d))


def prune_candidates(spark, d):
    n = _dag(spark, d)
    roots = n.where("cid like '%7'").select("cid")
    now = n.agg(F.max("timestamp")).first()[0] or 0
    return compaction.prunable(n, roots, now, min_age=5000, max_nodes=2**31 - 1, preserve_depth=2).select("cid", "level")


def resurrection_check(spark, d):
    n = _dag(spark, d)
    gone = n.where("cid like '%50'").select("cid")
    return compaction.resurrections(compaction.prune(n, gone), gone)


def disconnected_check(spark, d):
    n = _dag(spark, d)
    gone = n.where("cid like '%50'").select("cid")
    return compaction.disconnected(n.where("cid not like '%50' and cid not like '%25'"), gone)


def _snapshots(spark, d):
    """Every event is a snapshot of its replica."""
    ev = logs.events(spark, d)
    return compaction.make_snapshots(ev.select(F.create_map("replica", "event_id").alias("vv"), F.array().cast("array<string>").alias("superseded_roots"), F.encode("event_type", "utf-8").alias("state"), F.col("ts_ms").alias("created_at"), F.col("replica").alias("creator")))


def snapshot_retention(spark, d):
    return compaction.retained(_snapshots(spark, d), keep=3).select("creator", "created_at")


def snapshot_ids(spark, d):
    return _snapshots(spark, d).select("id", "creator", "created_at")


def snapshot_covering(spark, d):
    wanted = spark.createDataFrame([("r3", 500)], "replica string, seq long")
    return compaction.covering(_snapshots(spark, d), wanted).select("creator", "created_at")


def snapshot_latest(spark, d):
    return compaction.latest(_snapshots(spark, d)).select("creator", "created_at")


def snapshot_stats(spark, d):
    return compaction.snapshot_stats(_snapshots(spark, d))


def snapshot_node_round_trip(spark, d):
    s = compaction.with_metadata(_snapshots(spark, d), "why", "test")
    back = compaction.snapshot_from_node(dag.verify(compaction.snapshot_node(s)))
    return back.select("id", "creator", "created_at", F.decode("state", "utf-8").alias("state"), F.element_at("metadata", "why").alias("why"))


def _frontiers(spark, d):
    return logs.events(spark, d).groupBy(F.col("event_type").alias("holder"), "replica").agg(F.max("event_id").alias("seq"))


def stability_state(spark, d):
    wanted = spark.createDataFrame([("r0", 1), ("r3", 1)], "replica string, seq long")
    return compaction.stability_state(_frontiers(spark, d), wanted).select("state", F.size("delivered").alias("delivered"), F.size("pending").alias("pending"))


def stability_stats(spark, d):
    return compaction.stability_stats(_frontiers(spark, d), "click")


def stale_peers(spark, d):
    ev = logs.events(spark, d)
    up = ev.select(F.col("replica").alias("peer"), F.col("event_id").alias("arrival"), F.col("ts_ms").alias("updated_at"))
    return compaction.stale_peers(up, ev.agg(F.max("ts_ms")).first()[0] or 0, 600_000)


def bootstrap_replay(spark, d):
    ev = logs.events(spark, d)
    vv = ev.where("event_type = 'click'").groupBy("replica").agg(F.min("event_id").alias("seq"))
    return compaction.bootstrap(vv, ev.select("replica", F.col("event_id").alias("seq"))).groupBy("replica").agg(F.count(F.lit(1)).alias("n"))


def _log(spark, d):
    ev = logs.events(spark, d)
    return replication.numbered(ev.select("replica", F.col("event_id").alias("arrival"), "k"))


def _acks(spark, d):
    tops = _log(spark, d).groupBy("replica").agg(F.max("seq").alias("n"))
    return tops.withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).select("replica", F.concat(F.lit("p"), F.col("i").cast("string")).alias("peer"), F.floor(F.col("n") * (F.col("i") + 1) / 4).alias("acked"))


def delta_groups(spark, d):
    return replication.delta_groups(_log(spark, d), _acks(spark, d), F.max("k").alias("top"))


def delta_min_acked(spark, d):
    return replication.min_acked(_acks(spark, d))


def delta_collected(spark, d):
    return replication.collected(_log(spark, d), _acks(spark, d)).groupBy("replica").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def delta_bounded_buffer(spark, d):
    return replication.bounded_buffer(_log(spark, d)).groupBy("replica", "slot").agg(F.count(F.lit(1)).alias("n"))


def delta_pending(spark, d):
    return replication.has_pending(_log(spark, d), _acks(spark, d))


def _intervals(spark, d):
    """Intervals of ten operations, without every seventh and with every fifth twice."""
    cuts = _log(spark, d).where("seq % 10 = 0").select("replica", F.lit("p").alias("peer"), F.col("seq").alias("at"))
    s = replication.intervals(_log(spark, d), cuts).where("to_seq % 70 <> 0 or to_seq % 490 = 0")
    return s.withColumn("arrival", F.explode(F.when(F.col("to_seq") % 50 == 0, F.array(F.col("to_seq"), F.col("to_seq") + 3)).otherwise(F.array("to_seq"))))


def causal_prefix(spark, d):
    return replication.causal_prefix(_intervals(spark, d)).select("from_replica", "from_seq", "to_seq", "arrival", "applied")


def causal_acks(spark, d):
    return replication.interval_acks(replication.causal_prefix(_intervals(spark, d)))


def replicas_converged(spark, d):
    ev = logs.events(spark, d).select("event_type", "k").distinct().withColumn("holder", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return replication.converged(ev, "event_type", "k")


def _edges(spark, d):
    """Two outgoing edges of each nation."""
    n = logs.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    to = F.explode(F.array((F.col("i") + 1) % 25, (F.col("i") * 3 + 2) % 25))
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 2, "0"))
    return n.withColumn("j", to).where("i <> j").select(name(F.col("i")).alias("src"), name(F.col("j")).alias("dst")).distinct()


def gossip_reach(spark, d):
    heads = spark.createDataFrame([("n00", [hashing.ZERO], 1), ("n07", [hashing.ZERO], 2)], "origin string, heads array<string>, timestamp long")
    return replication.gossip(replication.announcement(heads, ttl=4), _edges(spark, d)).select("origin", "replica", "hop", "ttl")


def gossip_first_peers(spark, d):
    return replication.first_peers(_edges(spark, d), 1)


def message_routing(spark, d):
    c = logs.table(spark, d, "customer")
    name = lambda x: F.concat(F.lit("n"), F.lpad(x.cast("string"), 2, "0"))
    m = c.select(name(F.col("c_nationkey")).alias("src"), name((F.col("c_nationkey") + F.col("c_custkey") % 3) % 25).alias("dst"), F.col("c_custkey").alias("n"))
    return replication.routed(m, _edges(spark, d)).groupBy("src", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def lossy_link(spark, d):
    sent = replication.link(logs.events(spark, d).select(F.col("event_id").alias("n")), loss=0.1, dup=0.2, reorder=0.3)
    return sent.select("n", "copy", "lost", "deliver_at")


def lossy_retransmit(spark, d):
    sent = replication.link(logs.events(spark, d).select(F.col("event_id").alias("n")), loss=0.1, dup=0.2, reorder=0.3)
    return replication.retransmitted(sent).select("n")


def peer_versions(spark, d):
    ev = logs.events(spark, d).select(F.col("replica").alias("peer"), F.concat(F.lit("doc"), (F.col("k") % 20).cast("string")).alias("doc_id"), F.col("event_id").alias("version"), F.col("ts_ms").alias("arrival"))
    return replication.peer_versions(ev).select("peer", F.explode("versions").alias("doc_id", "version"))


def content_hashes(spark, d):
    b = logs.table(spark, d, "documents")
    digest = hashing.sha256(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return b.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).select("digest", hashing.short(F.col("digest")).alias("short"), "n", hashing.is_zero(F.col("digest")).alias("is_zero"), hashing.to_hex(hashing.from_hex(F.col("digest"))).alias("back"))


def cursor_scalars(spark, d):
    ev = logs.presence_events(logs.events(spark, d))
    start, end = scalars.selection_range(F.col("anchor"), F.col("position"))
    return ev.select(F.col("clock"), start.alias("sel_start"), end.alias("sel_end"), scalars.selection_length(F.col("anchor"), F.col("position")).alias("n"), scalars.color_for_user(F.col("user_id")).alias("color"))


_CLOSURE = f"""WITH RECURSIVE {EV}, {NODES}, heads AS (SELECT cid FROM nodes WHERE cid NOT IN (SELECT parent FROM edges))"""
_SNAP = f"WITH {EV}, s AS (SELECT replica AS creator, ts_ms AS created_at, event_id, event_type FROM ev)"
_LOG = f"""WITH {EV}, log AS (SELECT replica, k, row_number() OVER (PARTITION BY replica ORDER BY event_id) AS seq FROM ev),
acks AS (SELECT replica, 'p' || i AS peer, max(seq) * (i + 1) // 4 AS acked FROM log, range(3) t(i) GROUP BY replica, i)"""
_INT = f"""{_LOG}, i AS (SELECT replica AS from_replica, seq - 10 AS from_seq, seq AS to_seq, unnest(CASE WHEN seq % 50 = 0 THEN [seq, seq + 3] ELSE [seq] END) AS arrival
  FROM log WHERE seq % 10 = 0 AND (seq % 70 <> 0 OR seq % 490 = 0)), gap AS (SELECT replica, min(seq) AS seq FROM log WHERE seq % 70 = 0 AND seq % 490 <> 0 GROUP BY 1),
a AS (SELECT i.*, coalesce(i.from_seq < gap.seq, true) AS applied FROM i LEFT JOIN gap ON gap.replica = i.from_replica)"""
_EDGE = """edge AS (SELECT DISTINCT 'n' || lpad(i::VARCHAR, 2, '0') AS src, 'n' || lpad(j::VARCHAR, 2, '0') AS dst FROM
  (SELECT n_nationkey AS i, unnest([(n_nationkey + 1) % 25, (n_nationkey * 3 + 2) % 25]) AS j FROM nation) WHERE i <> j)"""
_LINK = f"""WITH {EV}, s0 AS (SELECT event_id AS n, (((event_id * 2654435761 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 AS a FROM ev),
s1 AS (SELECT *, (a * 1103515245 + 12345) % 2147483648 AS b FROM s0), s2 AS (SELECT *, (b * 1103515245 + 12345) % 2147483648 AS c FROM s1),
u AS (SELECT n, ((a >> 16) & 32767) / 32768.0 < 0.1 AS lost, ((b >> 16) & 32767) / 32768.0 < 0.2 AS dup, ((c >> 16) & 32767) / 32768.0 < 0.3 AS late FROM s2)"""
_HASH = f"""WITH {EV}, roots AS (SELECT DISTINCT user_id, 'u' || user_id AS creator FROM ev),
r AS (SELECT *, sha256({le8("0")} || unhex('00') || {le8("0")} || encode(creator)) AS cid FROM roots),
k AS (SELECT sha256({le8("1")} || unhex(r.cid) || unhex('01') || encode(event_type) || {le8("ts_ms")} || encode(replica)) AS cid, ts_ms, replica, e.user_id FROM ev e JOIN r USING (user_id))"""

QUERIES = {f.__name__: f for f in (
    dag_cid, dag_verify, dag_genesis, dag_heads, dag_missing, dag_children, dag_stats, dag_levels, dag_ancestors, dag_k_hop, dag_sync_need, dag_missing_ancestors, dag_put, dag_converged, dag_first_parents,
    prune_candidates, resurrection_check, disconnected_check, snapshot_retention, snapshot_ids, snapshot_covering, snapshot_latest, snapshot_stats, snapshot_node_round_trip,
    stability_state, stability_stats, stale_peers, bootstrap_replay,
    delta_groups, delta_min_acked, delta_collected, delta_bounded_buffer, delta_pending, causal_prefix, causal_acks, replicas_converged,
    gossip_reach, gossip_first_peers, message_routing, lossy_link, lossy_retransmit, peer_versions, content_hashes, cursor_scalars,
)}

ORACLE_SQL = {
    "dag_cid": f"{_HASH} SELECT cid, 0 AS n_parents, 0::BIGINT AS timestamp, creator FROM r UNION ALL SELECT cid, 1, ts_ms, replica FROM k",
    "dag_verify": f"{_HASH} SELECT cid, creator FROM r UNION ALL SELECT cid, replica FROM k WHERE ts_ms % 50 <> 1",
    "dag_genesis": f"WITH {EV}, {NODES} SELECT cid, replica AS creator FROM nodes WHERE event_id = 0",
    "dag_heads": f"{_CLOSURE} SELECT cid FROM heads",
    "dag_missing": f"WITH {EV}, {NODES} SELECT DISTINCT parent AS cid FROM edges WHERE child NOT LIKE '%50' AND parent LIKE '%50'",
    "dag_children": f"WITH {EV}, {NODES} SELECT parent, child FROM edges",
    "dag_stats": f"""WITH RECURSIVE {EV}, {NODES}, e AS (SELECT * FROM edges WHERE child NOT LIKE '%50'), n AS (SELECT cid FROM nodes WHERE cid NOT LIKE '%50'),
        l AS (SELECT cid, 1 AS level FROM n UNION SELECT child, level + 1 FROM l JOIN e ON parent = cid) SELECT (SELECT max(level) FROM l)::BIGINT AS depth, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE cid NOT IN (SELECT parent FROM e)) AS heads,
        (SELECT count(DISTINCT parent) FROM e WHERE parent NOT IN (SELECT cid FROM n)) AS missing, (SELECT count(*) / count(DISTINCT parent) FROM e) AS branching""",
    "dag_levels": f"{_CLOSURE}, l AS (SELECT cid, 1 AS level FROM nodes UNION SELECT child, level + 1 FROM l JOIN edges ON parent = cid) SELECT cid, max(level) AS level FROM l GROUP BY 1",
    "dag_ancestors": f"{_CLOSURE}, a AS (SELECT cid AS start, cid FROM heads UNION SELECT start, parent FROM a JOIN edges ON child = cid) SELECT start, count(*) - 1 AS n FROM a GROUP BY 1 HAVING count(*) > 1",
    "dag_k_hop": f"{_CLOSURE}, a AS (SELECT cid AS start, cid, 0 AS depth FROM heads UNION SELECT start, parent, depth + 1 FROM a JOIN edges ON child = cid WHERE depth < 3) SELECT start, count(DISTINCT cid) AS n FROM a WHERE depth > 0 GROUP BY 1",
    "dag_sync_need": f"{_CLOSURE} SELECT cid FROM heads JOIN nodes USING (cid) WHERE replica = 'r1'",
    "dag_missing_ancestors": f"""{_CLOSURE}, e2 AS (SELECT * FROM edges WHERE child NOT LIKE '%50'), a AS (SELECT cid FROM heads UNION SELECT parent FROM a JOIN e2 ON child = cid)
        SELECT cid FROM a WHERE cid LIKE '%50'""",
    "dag_put": f"{_HASH} SELECT cid, creator FROM r WHERE creator IN ('u1', 'u9')",
    "dag_converged": "SELECT true AS converged",
    "dag_first_parents": f"""{_CLOSURE}, p AS (SELECT min(cid) AS cid, 0 AS depth FROM heads UNION ALL SELECT (SELECT max(parent) FROM edges WHERE child = p.cid), depth + 1 FROM p WHERE EXISTS (SELECT 1 FROM edges WHERE child = p.cid)) SELECT * FROM p""",
    "prune_candidates": f"""{_CLOSURE}, roots AS (SELECT cid FROM nodes WHERE cid LIKE '%7'), below AS (SELECT parent AS cid FROM edges WHERE child IN (FROM roots) UNION SELECT parent FROM below JOIN edges ON child = cid),
        near AS (SELECT cid, 0 AS depth FROM heads UNION SELECT parent, depth + 1 FROM near JOIN edges ON child = cid WHERE depth < 2),
        path AS (SELECT min(cid) AS cid FROM heads UNION ALL SELECT (SELECT max(parent) FROM edges WHERE child = path.cid) FROM path WHERE EXISTS (SELECT 1 FROM edges WHERE child = path.cid)),
        l AS (SELECT cid, 1 AS level FROM nodes UNION SELECT child, level + 1 FROM l JOIN edges ON parent = cid), lv AS (SELECT cid, max(level) AS level FROM l GROUP BY 1)
        SELECT cid, level FROM nodes JOIN lv USING (cid) WHERE cid IN (FROM below) AND cid NOT IN (FROM roots) AND cid NOT IN (SELECT cid FROM near) AND cid NOT IN (FROM path) AND (SELECT max(ts_ms) FROM nodes) - ts_ms >= 5000""",
    "resurrection_check": f"WITH {EV}, {NODES} SELECT child, parent FROM edges WHERE parent LIKE '%50' AND child NOT LIKE '%50'",
    "disconnected_check": f"WITH {EV}, {NODES} SELECT DISTINCT parent AS cid FROM edges WHERE parent LIKE '%25' AND child NOT LIKE '%50' AND child NOT LIKE '%25'",
    "snapshot_retention": f"{_SNAP} SELECT creator, created_at FROM s QUALIFY row_number() OVER (PARTITION BY creator ORDER BY created_at DESC) <= 3",
    "snapshot_ids": f"{_SNAP} SELECT sha256(unhex('01') || encode(event_type) || encode(creator) || {le8('event_id')} || {le8('created_at')} || encode(creator)) AS id, creator, created_at FROM s",
    "snapshot_covering": f"{_SNAP} SELECT creator, created_at FROM s WHERE creator = 'r3' AND event_id >= 500",
    "snapshot_latest": f"{_SNAP}, f AS (SELECT creator FROM s WHERE event_id > 0 ORDER BY created_at, event_id LIMIT 1) SELECT creator, created_at FROM s JOIN f USING (creator) ORDER BY event_id DESC LIMIT 1",
    "snapshot_stats": f"{_SNAP} SELECT count(*) AS n, coalesce(sum(strlen(event_type)), 0)::BIGINT AS bytes, min(created_at) AS oldest, max(created_at) AS newest FROM s",
    "snapshot_node_round_trip": f"{_SNAP} SELECT sha256(unhex('01') || encode(event_type) || encode(creator) || {le8('event_id')} || {le8('created_at')} || encode(creator)) AS id, creator, created_at, event_type AS state, 'test' AS why FROM s",
    "stability_state": f"""WITH {EV}, h AS (SELECT event_type, count(DISTINCT replica) FILTER (replica IN ('r0', 'r3') AND event_id >= 1) = 2 AS ok FROM ev GROUP BY 1), c AS (SELECT count(*) FILTER (ok)::INT AS delivered, count(*) FILTER (NOT ok)::INT AS pending FROM h)
        SELECT CASE WHEN delivered + pending < 2 THEN 'Unknown' WHEN pending = 0 THEN 'Stable' WHEN delivered > 0 THEN 'Partial' ELSE 'Pending' END AS state, delivered, pending FROM c""",
    "stability_stats": f"""WITH {EV}, vv AS (SELECT event_type AS holder, replica, max(event_id) AS seq FROM ev GROUP BY ALL),
        st AS (SELECT min(seq) AS seq FROM vv GROUP BY replica HAVING count(*) = (SELECT count(DISTINCT holder) FROM vv) AND min(seq) > 0),
        x AS (SELECT count(DISTINCT holder) FILTER (holder <> 'click') AS peers, coalesce(sum(seq) FILTER (holder = 'click'), 0)::BIGINT AS local_ops, (SELECT coalesce(sum(seq), 0)::BIGINT FROM st) AS stable_ops FROM vv)
        SELECT *, greatest(local_ops - stable_ops, 0) AS unstable_ops FROM x""",
    "stale_peers": f"WITH {EV} SELECT replica AS peer FROM ev GROUP BY 1 HAVING (SELECT max(ts_ms) FROM ev) - arg_max(ts_ms, event_id) > 600000",
    "bootstrap_replay": f"WITH {EV}, s AS (SELECT replica, min(event_id) AS seq FROM ev WHERE event_type = 'click' GROUP BY 1) SELECT replica, count(*) AS n FROM ev LEFT JOIN s USING (replica) WHERE event_id > coalesce(seq, 0) GROUP BY 1",
    "delta_groups": f"{_LOG} SELECT replica, peer, max(seq) AS to_seq, count(*) AS n, max(k) AS top FROM log JOIN acks USING (replica) WHERE seq > acked GROUP BY 1, 2",
    "delta_min_acked": f"{_LOG} SELECT replica, min(acked) AS acked FROM acks GROUP BY 1",
    "delta_collected": f"{_LOG} SELECT replica, count(*) AS n, min(seq) AS first FROM log JOIN (SELECT replica, min(acked) AS acked FROM acks GROUP BY 1) USING (replica) WHERE seq > acked GROUP BY 1",
    "delta_bounded_buffer": f"{_LOG}, b AS (SELECT replica, greatest(100 - row_number() OVER (PARTITION BY replica ORDER BY seq DESC), 0)::INT AS slot FROM log) SELECT replica, slot, count(*) AS n FROM b GROUP BY 1, 2",
    "delta_pending": f"{_LOG} SELECT replica, bool_or((SELECT max(seq) FROM log l WHERE l.replica = acks.replica) > acked) AS pending FROM acks GROUP BY 1",
    "causal_prefix": f"{_INT} SELECT from_replica, from_seq, to_seq, arrival, applied FROM a",
    "causal_acks": f"{_INT} SELECT from_replica, 'p' AS to_replica, max(to_seq) AS acked FROM a WHERE applied GROUP BY 1",
    "replicas_converged": "SELECT true AS converged",
    "gossip_reach": f"""WITH RECURSIVE {_EDGE}, g AS (SELECT o AS origin, o AS replica, 0 AS hop FROM (VALUES ('n00'), ('n07')) t(o) UNION SELECT origin, dst, hop + 1 FROM g JOIN edge ON src = replica WHERE hop < 4)
        SELECT origin, replica, min(hop) AS hop, CASE WHEN min(hop) = 0 THEN 4 ELSE 5 - min(hop) END AS ttl FROM g GROUP BY 1, 2""",
    "gossip_first_peers": f"WITH {_EDGE} SELECT src, min(dst) AS dst FROM edge GROUP BY 1",
    "message_routing": f"""WITH {_EDGE}, m AS (SELECT 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS src, 'n' || lpad(((c_nationkey + c_custkey % 3) % 25)::VARCHAR, 2, '0') AS dst FROM customer)
        SELECT m.src, CASE WHEN edge.src IS NULL THEN 'PeerNotFound' ELSE 'ok' END AS outcome, count(*) AS n FROM m LEFT JOIN edge USING (src, dst) GROUP BY ALL""",
    "lossy_link": f"{_LINK} SELECT n, copy::INT AS copy, lost, n * 4 + copy + CASE WHEN late THEN 10 ELSE 0 END AS deliver_at FROM (SELECT *, unnest(CASE WHEN dup THEN [0, 1] ELSE [0] END) AS copy FROM u)",
    "lossy_retransmit": f"{_LINK} SELECT n FROM u WHERE lost",
    "peer_versions": f"WITH {EV} SELECT replica AS peer, 'doc' || (k % 20) AS doc_id, arg_max(event_id, ts_ms) AS version FROM ev GROUP BY 1, 2",
    "content_hashes": "SELECT sha256(coalesce(text, '')) AS digest, substr(sha256(coalesce(text, '')), 1, 8) AS short, count(*) AS n, false AS is_zero, sha256(coalesce(text, '')) AS back FROM documents GROUP BY ALL",
    "cursor_scalars": f"""WITH {EV}, p AS (SELECT event_id AS clock, user_id, k::INT AS position, CASE WHEN event_type = 'view' THEN k + 5 END AS anchor FROM ev)
        SELECT clock, CASE WHEN anchor IS NOT NULL THEN position END AS sel_start, CASE WHEN anchor IS NOT NULL THEN anchor::INT END AS sel_end, CASE WHEN anchor IS NOT NULL THEN 5 ELSE 0 END AS n,
        {list(scalars.CURSOR_COLORS)}[(1 + list_sum(list_transform(string_split('u' || user_id, ''), lambda ch: ascii(ch))) % 12)::BIGINT] AS color FROM p""",
}
