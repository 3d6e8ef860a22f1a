"""Queries over sets, counters, registers, maps and version vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideweave.operators import counters, maps, registers, sets, vectors
from tideweave.plans.sql import EV
from tideweave.sources import logs


def _snapshots(ev, ops, state):
    """Three overlapping states of a log: its first half, four fifths, all."""
    top = ev.agg(F.max("event_id")).first()[0] or 0
    return [state(ops.where(F.col("seq") <= int(top * part))) for part in (0.5, 0.8, 1.0)]


def pncounter_value(spark, d):
    ev = logs.events(spark, d)
    return counters.value(counters.join(*_snapshots(ev, logs.counter_ops(ev), counters.from_ops)))


def pncounter_breakdown(spark, d):
    ev = logs.events(spark, d)
    return counters.breakdown(counters.join(*_snapshots(ev, logs.counter_ops(ev), counters.from_ops)))


def pncounter_running(spark, d):
    run = counters.running(logs.counter_ops(logs.events(spark, d)))
    return run.groupBy("counter", "replica").agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"), F.sum(F.col("inc") - F.col("dec")).alias("area"))


def pncounter_own(spark, d):
    return counters.own(counters.from_ops(logs.counter_ops(logs.events(spark, d))), "r3")


def pncounter_converged(spark, d):
    ev = logs.events(spark, d)
    half, _, whole = _snapshots(ev, logs.counter_ops(ev), counters.from_ops)
    named = [s.withColumn("holder", F.lit(h)) for h, s in (("a", counters.join(half, whole)), ("b", whole), ("c", counters.join(whole, whole)))]
    return counters.converged(sets.union_all(*named))


def pncounter_leq(spark, d):
    ev = logs.events(spark, d)
    half, _, whole = _snapshots(ev, logs.counter_ops(ev), counters.from_ops)
    return counters.leq(half, whole)


def lineitem_counter(spark, d):
    """Quantities as increments, returns as decrements, one replica per supplier."""
    li = logs.table(spark, d, "lineitem")
    ops = li.select(F.col("l_suppkey").cast("string").alias("replica"), F.col("l_returnflag").alias("counter"), F.when(F.col("l_returnflag") == "R", "dec").otherwise("inc").alias("kind"), F.col("l_quantity").cast("long").alias("amount"))
    return counters.value(counters.from_ops(ops))


def _sets(ev):
    return ev.select(F.col("event_type").alias("set_id"), F.col("k").cast("string").alias("element"), F.col("event_id").alias("seq"))


def gset_union(spark, d):
    ev = logs.events(spark, d)
    return sets.gset_join(*_snapshots(ev, _sets(ev), lambda x: x.select("set_id", "element").distinct()))


def gset_cardinality(spark, d):
    return sets.cardinality(_sets(logs.events(spark, d)), "element", ["set_id"])


def gset_compare(spark, d):
    ev = logs.events(spark, d)
    half, _, whole = _snapshots(ev, _sets(ev).withColumn("element", F.col("seq").cast("string")), lambda x: x.select("set_id", "element"))
    return sets.compare(half, whole)


def gset_leq(spark, d):
    ev = logs.events(spark, d)
    half, _, whole = _snapshots(ev, _sets(ev), lambda x: x.select("set_id", "element"))
    return sets.leq(half, whole)


def gset_contains(spark, d):
    probes = logs.table(spark, d, "part").select(F.col("p_size").cast("string").alias("element")).distinct()
    return sets.contains(_sets(logs.events(spark, d)), probes)


def _orset(spark, d):
    return sets.orset_from_ops(logs.set_ops(logs.events(spark, d)))


def orset_live(spark, d):
    return sets.orset_live(*_orset(spark, d)).select("set_id", "element", "tag_replica", "tag_seq")


def orset_elements(spark, d):
    return sets.orset_elements(*_orset(spark, d))


def orset_size(spark, d):
    return sets.cardinality(sets.orset_elements(*_orset(spark, d)), "element", ["set_id"])


def orset_remove(spark, d):
    """The removal delta of the elements that also are even part sizes."""
    added, removed = _orset(spark, d)
    wanted = sets.orset_elements(added, removed).where(F.col("element").cast("int") % 2 == 0)
    return sets.orset_remove(added, removed, wanted)


def orset_after_remove(spark, d):
    """State after that delta is applied, twice and with a stale state merged in: nothing comes back."""
    added, removed = _orset(spark, d)
    wanted = sets.orset_elements(added, removed).where(F.col("element").cast("int") % 2 == 0)
    delta = (added.limit(0), sets.orset_remove(added, removed, wanted))
    state = sets.orset_join(sets.orset_apply_delta(sets.orset_apply_delta((added, removed), delta), delta), (added, removed))
    return sets.orset_elements(*state)


def _order_writes(spark, d):
    o = logs.table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("key"), logs.millis(o, "o_orderdate").alias("ts_ms"), F.concat(F.lit("r"), (F.col("o_orderkey") % 8).cast("string")).alias("replica"), F.col("o_orderpriority").alias("value"))


def lww_current(spark, d):
    return registers.lww_join(_order_writes(spark, d))


def lww_events(spark, d):
    w = logs.register_ops(logs.events(spark, d)).select("key", "ts_ms", "replica", "value")
    return registers.lww_set(registers.lww_join(w), w)


def lww_tie_break(spark, d):
    """All writes at one time: the greater replica, then the greater value wins."""
    return registers.lww_join(_order_writes(spark, d).withColumn("ts_ms", F.lit(1000).cast("long")))


def lww_clear(spark, d):
    return registers.lww_clear(registers.lww_join(_order_writes(spark, d)))


def _mv(spark, d):
    return registers.mv_write(logs.register_ops(logs.events(spark, d)))


def mvreg_values(spark, d):
    return registers.mv_read(_mv(spark, d)).select("key", F.array_join("values", ",").alias("vals"))


def mvreg_conflicts(spark, d):
    return registers.mv_conflicts(_mv(spark, d))


def mvreg_resolved(spark, d):
    """Even keys are resolved by a write of replica r9."""
    mv = _mv(spark, d)
    w = mv.where(F.col("key").cast("int") % 2 == 0).select("key").distinct().select("key", F.lit("r9").alias("replica"), F.lit(1).cast("long").alias("seq"), F.lit("ok").alias("value"))
    return registers.mv_resolve(mv, w).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def mvreg_causal(spark, d):
    ops = logs.register_ops(logs.events(spark, d)).select("key", "replica", "seq", "value")
    return registers.mv_join_causal(ops.where("seq % 3 = 0"), ops)


def mvreg_json(spark, d):
    """Serialised as a list of (dot, value) and read back."""
    dots = registers.mv_read_with_dots(_mv(spark, d)).select("key", F.to_json("dots").alias("json"))
    back = dots.select("key", F.inline(F.from_json("json", "array<struct<replica: string, seq: bigint, value: string>>")))
    return back.select("key", "replica", "seq", "value")


def crdtmap_entries(spark, d):
    return maps.put(logs.map_ops(logs.events(spark, d))).drop("v_bytes")


def crdtmap_get(spark, d):
    return maps.get(maps.put(logs.map_ops(logs.events(spark, d)))).drop("v_bytes")


def crdtmap_get_all(spark, d):
    return maps.get_all(maps.put(logs.map_ops(logs.events(spark, d)))).select("map_id", "key", F.array_join(F.transform("values", lambda v: F.coalesce(v["v_text"], v["v_int"].cast("string"))), ",").alias("vals"))


def crdtmap_keys(spark, d):
    return sets.cardinality(maps.keys(maps.put(logs.map_ops(logs.events(spark, d)))), "key", ["map_id"])


def crdtmap_observed_join(spark, d):
    """A stale side (the first half of the log) does not bring back what the other has removed or replaced."""
    ev = logs.events(spark, d)
    half, _, whole = _snapshots(ev, logs.map_ops(ev), lambda x: (maps.put(x), maps.context(x)))
    entries, _ = maps.join_observed(half, whole)
    return entries.drop("v_bytes")


def crdtmap_context(spark, d):
    return maps.context(logs.map_ops(logs.events(spark, d))).groupBy("map_id").agg(F.count(F.lit(1)).alias("dots"))


def _vectors(spark, d):
    """Each event type holds, of every replica, the last event of that type."""
    return logs.events(spark, d).groupBy(F.col("event_type").alias("holder"), "replica").agg(F.max("event_id").alias("seq"))


def _of(vv, holder):
    return vv.where(F.col("holder") == holder).select("replica", "seq")


def vv_merge(spark, d):
    return vectors.join(_vectors(spark, d))


def vv_meet(spark, d):
    vv = _vectors(spark, d)
    return vectors.meet(_of(vv, "click"), _of(vv, "view"))


def vv_stable_frontier(spark, d):
    return vectors.stable_frontier(_vectors(spark, d))


def vv_dominance_pairs(spark, d):
    vv = _vectors(spark, d).unionByName(vectors.join(_vectors(spark, d)).withColumn("holder", F.lit("all")).select("holder", "replica", "seq"))
    names = vv.select("holder").distinct()
    every = names.agg(F.collect_set("holder").alias("bs"))
    pairs = names.join(F.broadcast(every)).select(F.col("holder").alias("a"), F.explode("bs").alias("b")).where("a <> b")
    return vectors.dominance(vv, pairs)


def vv_diff_ranges(spark, d):
    vv = _vectors(spark, d)
    return vectors.diff(_of(vv, "click"), _of(vv, "view"))


def vv_diff_expanded(spark, d):
    vv = _vectors(spark, d)
    return vectors.expand(vectors.diff(_of(vv, "click"), _of(vv, "view")))


def vv_covered(spark, d):
    ev = logs.events(spark, d)
    return vectors.covered(_of(_vectors(spark, d), "click"), ev.select("replica", F.col("event_id").alias("seq"))).groupBy("replica").agg(F.count(F.lit(1)).alias("n"))


def vv_totals(spark, d):
    return vectors.total_operations(_vectors(spark, d))


def vv_entries(spark, d):
    vv = _vectors(spark, d)
    return vectors.from_entries(vectors.to_entries(vv))


def vv_from_events(spark, d):
    return vectors.from_events(logs.events(spark, d))


_LIVE = f"""WITH {EV}, adds AS (SELECT event_type AS set_id, k::VARCHAR AS element, replica AS tag_replica, event_id AS tag_seq FROM ev WHERE event_type <> 'error'),
errs AS (SELECT replica, k::VARCHAR AS element, max(event_id) AS at FROM ev WHERE event_type = 'error' GROUP BY ALL),
live AS (SELECT a.* FROM adds a WHERE NOT EXISTS (SELECT 1 FROM errs e WHERE e.replica = a.tag_replica AND e.element = a.element AND a.tag_seq < e.at))"""
_CNT = f"WITH {EV}, c AS (SELECT event_type AS counter, replica, count(*) FILTER (event_type <> 'error') AS inc, count(*) FILTER (event_type = 'error') AS dec FROM ev GROUP BY ALL)"
_MAPS = f"""WITH {EV}, ops AS (SELECT 'm' || (user_id % 50) AS map_id, k::VARCHAR AS key, replica, event_id AS seq, event_type FROM ev),
entries AS (SELECT map_id, key, replica, seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Int' ELSE 'Text' END AS v_kind,
    CASE WHEN event_type IN ('purchase', 'signup') THEN seq END AS v_int, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS v_text
  FROM ops QUALIFY row_number() OVER (PARTITION BY map_id, key, replica ORDER BY seq DESC) = 1 AND event_type <> 'error')"""
_MV = f"""WITH {EV}, mv AS (SELECT k::VARCHAR AS key, replica, event_id AS seq, event_type || ':' || user_id AS value FROM ev
  QUALIFY row_number() OVER (PARTITION BY k, replica ORDER BY event_id DESC) = 1)"""
_VV = f"WITH {EV}, vv AS (SELECT event_type AS holder, replica, max(event_id) AS seq FROM ev GROUP BY ALL)"
_ORD = "WITH w AS (SELECT o_custkey::VARCHAR AS key, epoch_us(o_orderdate) // 1000 AS ts_ms, 'r' || (o_orderkey % 8) AS replica, o_orderpriority AS value FROM orders)"
_SPLIT = f"{EV}, top AS (SELECT max(event_id) AS m FROM events)"

QUERIES = {f.__name__: f for f in (
    pncounter_value, pncounter_breakdown, pncounter_running, pncounter_own, pncounter_converged, pncounter_leq, lineitem_counter,
    gset_union, gset_cardinality, gset_compare, gset_leq, gset_contains,
    orset_live, orset_elements, orset_size, orset_remove, orset_after_remove,
    lww_current, lww_events, lww_tie_break, lww_clear,
    mvreg_values, mvreg_conflicts, mvreg_resolved, mvreg_causal, mvreg_json,
    crdtmap_entries, crdtmap_get, crdtmap_get_all, crdtmap_keys, crdtmap_observed_join, crdtmap_context,
    vv_merge, vv_meet, vv_stable_frontier, vv_dominance_pairs, vv_diff_ranges, vv_diff_expanded, vv_covered, vv_totals, vv_entries, vv_from_events,
)}

ORACLE_SQL = {
    "pncounter_value": f"{_CNT} SELECT counter, (sum(inc) - sum(dec))::BIGINT AS value FROM c GROUP BY 1",
    "pncounter_breakdown": f"{_CNT} SELECT counter, replica, inc, dec FROM c",
    "pncounter_running": f"""WITH {EV}, r AS (SELECT event_type AS counter, replica, CASE WHEN event_type = 'error' THEN 0 ELSE row_number() OVER w END AS inc,
        CASE WHEN event_type = 'error' THEN row_number() OVER w ELSE 0 END AS dec FROM ev WINDOW w AS (PARTITION BY event_type, replica ORDER BY event_id))
        SELECT counter, replica, max(inc)::BIGINT AS inc, max(dec)::BIGINT AS dec, sum(inc - dec)::BIGINT AS area FROM r GROUP BY 1, 2""",
    "pncounter_own": f"{_CNT} SELECT counter, coalesce(max(inc) FILTER (replica = 'r3'), 0) AS inc, coalesce(max(dec) FILTER (replica = 'r3'), 0) AS dec FROM c GROUP BY 1",
    "pncounter_converged": "SELECT DISTINCT event_type AS counter, true AS converged FROM events",
    "pncounter_leq": "SELECT true AS leq",
    "lineitem_counter": "SELECT l_returnflag AS counter, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity::BIGINT)::BIGINT AS value FROM lineitem GROUP BY 1",
    "gset_union": f"WITH {EV} SELECT DISTINCT event_type AS set_id, k::VARCHAR AS element FROM ev",
    "gset_cardinality": f"WITH {EV} SELECT event_type AS set_id, count(DISTINCT k) AS n FROM ev GROUP BY 1",
    "gset_compare": "SELECT CASE WHEN max(event_id) > (max(event_id) * 0.5)::BIGINT THEN 'Less' ELSE 'Equal' END AS ordering FROM events",
    "gset_leq": "SELECT true AS leq",
    "gset_contains": f"WITH {EV} SELECT DISTINCT p_size::VARCHAR AS element FROM part WHERE p_size IN (SELECT k FROM ev)",
    "orset_live": f"{_LIVE} SELECT * FROM live",
    "orset_elements": f"{_LIVE} SELECT DISTINCT set_id, element FROM live",
    "orset_size": f"{_LIVE} SELECT set_id, count(DISTINCT element) AS n FROM live GROUP BY 1",
    "orset_remove": f"{_LIVE} SELECT set_id, tag_replica, tag_seq FROM live WHERE element::INT % 2 = 0",
    "orset_after_remove": f"{_LIVE} SELECT DISTINCT set_id, element FROM live WHERE element::INT % 2 <> 0",
    "lww_current": f"{_ORD} SELECT key, ts_ms, replica, value FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, replica DESC, value DESC) = 1",
    "lww_events": f"WITH {EV} SELECT k::VARCHAR AS key, ts_ms, replica, event_type || ':' || user_id AS value FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, replica DESC, value DESC) = 1",
    "lww_tie_break": f"{_ORD} SELECT key, 1000::BIGINT AS ts_ms, replica, value FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY replica DESC, value DESC) = 1",
    "lww_clear": f"{_ORD} SELECT key, 0::BIGINT AS ts_ms, replica, NULL::VARCHAR AS value FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY w.ts_ms DESC, replica DESC, w.value DESC) = 1",
    "mvreg_values": f"{_MV} SELECT key, string_agg(value, ',' ORDER BY replica, seq) AS vals FROM mv GROUP BY 1",
    "mvreg_conflicts": f"{_MV} SELECT key, count(*) AS n_values FROM mv GROUP BY 1 HAVING count(*) > 1",
    "mvreg_resolved": f"{_MV} SELECT key, CASE WHEN key::INT % 2 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN key::INT % 2 = 0 THEN 'ok' ELSE max(value) END AS top FROM mv GROUP BY key",
    "mvreg_causal": f"{_MV} SELECT key, replica, seq, value FROM mv",
    "mvreg_json": f"{_MV} SELECT key, replica, seq, value FROM mv",
    "crdtmap_entries": f"{_MAPS} SELECT * FROM entries",
    "crdtmap_get": f"{_MAPS} SELECT map_id, key, v_kind, v_int, v_text FROM entries QUALIFY row_number() OVER (PARTITION BY map_id, key ORDER BY replica, seq) = 1",
    "crdtmap_get_all": f"{_MAPS} SELECT map_id, key, string_agg(coalesce(v_text, v_int::VARCHAR), ',' ORDER BY replica, seq) AS vals FROM entries GROUP BY 1, 2",
    "crdtmap_keys": f"{_MAPS} SELECT map_id, count(DISTINCT key) AS n FROM entries GROUP BY 1",
    "crdtmap_observed_join": f"{_MAPS} SELECT * FROM entries",
    "crdtmap_context": f"{_MAPS} SELECT map_id, count(*) AS dots FROM ops WHERE event_type <> 'error' GROUP BY 1",
    "vv_merge": f"{_VV} SELECT replica, max(seq) AS seq FROM vv GROUP BY 1",
    "vv_meet": f"{_VV} SELECT a.replica, least(a.seq, b.seq) AS seq FROM vv a JOIN vv b USING (replica) WHERE a.holder = 'click' AND b.holder = 'view' AND least(a.seq, b.seq) > 0",
    "vv_stable_frontier": f"{_VV} SELECT replica, min(seq) AS seq FROM vv GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT holder) FROM vv) AND min(seq) > 0",
    "vv_dominance_pairs": f"""{_VV}, w AS (SELECT * FROM vv UNION ALL SELECT 'all', replica, max(seq) FROM vv GROUP BY replica), h AS (SELECT DISTINCT holder FROM w),
        e AS (SELECT a.holder AS a, b.holder AS b, r.replica, coalesce(x.seq, 0) AS sa, coalesce(y.seq, 0) AS sb FROM h a JOIN h b ON a.holder <> b.holder
            CROSS JOIN (SELECT DISTINCT replica FROM w) r LEFT JOIN w x ON x.holder = a.holder AND x.replica = r.replica LEFT JOIN w y ON y.holder = b.holder AND y.replica = r.replica),
        f AS (SELECT a, b, bool_and(sa >= sb) AS a_dominates, bool_and(sb >= sa) AS b_dominates FROM e GROUP BY 1, 2)
        SELECT *, a_dominates AND NOT b_dominates AS strictly, NOT a_dominates AND NOT b_dominates AS concurrent FROM f""",
    "vv_diff_ranges": f"{_VV} SELECT a.replica, coalesce(b.seq, 0) + 1 AS from_seq, a.seq AS to_seq FROM (FROM vv WHERE holder = 'click') a LEFT JOIN (FROM vv WHERE holder = 'view') b USING (replica) WHERE a.seq > coalesce(b.seq, 0)",
    "vv_diff_expanded": f"{_VV}, r AS (SELECT a.replica, coalesce(b.seq, 0) + 1 AS f, a.seq AS t FROM (FROM vv WHERE holder = 'click') a LEFT JOIN (FROM vv WHERE holder = 'view') b USING (replica) WHERE a.seq > coalesce(b.seq, 0)) SELECT replica, unnest(range(f, t + 1)) AS seq FROM r",
    "vv_covered": f"{_VV} SELECT e.replica, count(*) AS n FROM ev e JOIN vv v ON v.replica = e.replica AND v.holder = 'click' AND e.event_id <= v.seq GROUP BY 1",
    "vv_totals": f"{_VV} SELECT holder, sum(seq)::BIGINT AS total FROM vv GROUP BY 1",
    "vv_entries": f"{_VV} SELECT holder, replica, seq FROM vv",
    "vv_from_events": f"WITH {EV} SELECT replica, count(*) AS seq FROM ev GROUP BY 1",
}
