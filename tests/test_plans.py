"""Physical plans: pruned and pushed-down scans, one shuffle per merge, no products of tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideweave.operators import counters, dag, docstore, registers, sets
from tideweave.plans import registry
from tideweave.sources import logs

#: Queries that join one-row totals; those joins have no key.
SCALARS = {"pncounter_converged", "vv_dominance_pairs", "snapshot_covering", "snapshot_best_covering", "stability_state", "stability_stats", "frontier_announced", "dag_seeded"}
#: Queries whose rounds already run when they are made.
ITERATED = {"dag_ancestors", "dag_levels", "dag_missing_ancestors", "dag_first_parents", "dag_k_hop", "dag_put", "prune_candidates", "gossip_reach"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_it_needs(spark, sf):
    p = plan(registry.QUERIES["lineitem_counter"](spark, sf))
    scanned = p[p.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in scanned and "l_shipdate" not in scanned and "l_tax" not in scanned


def test_point_lookup_and_prefix_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("d1", "t", "Text", 1, 1)], "doc_id string, title string, doc_type string, created_at long, modified_at long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert "EqualTo(doc_id,d1)" in plan(docstore.get(docs, "d1"))
    assert "StringStartsWith(title,t)" in plan(docstore.query(docs, title_prefix="t"))
    assert "StringStartsWith(title,t)" in plan(docstore.scan_prefix(docs, "t"))


def test_a_merge_is_one_shuffle_after_a_partial_aggregate(spark, sf):
    ev = logs.events(spark, sf)
    ops = logs.counter_ops(ev)
    state = ops.select("counter", "replica", F.lit(1).cast("long").alias("inc"), F.lit(0).cast("long").alias("dec"))
    for df in (counters.join(state, state, state), registers.lww_join(*[logs.register_ops(ev).select("key", "ts_ms", "replica", "value")] * 3), sets.gset_join(*[ev.select("k")] * 3)):
        p = plan(df)
        assert p.count("Exchange hashpartitioning") == 1 and ("partial_max" in p or p.count("HashAggregate") == 2)


def test_removals_are_anti_joins(spark, sf):
    assert "LeftAnti" in plan(sets.orset_live(*sets.orset_from_ops(logs.set_ops(logs.events(spark, sf)))))
    assert "LeftAnti" in plan(dag.heads(logs.named_dag(logs.events(spark, sf))))


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in ITERATED and not n.startswith("stream_")))
def test_no_products(spark, sf, name):
    p = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert name in SCALARS or "BroadcastNestedLoopJoin" not in p
