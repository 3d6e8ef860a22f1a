from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideweave.functions import hashing, paths, scalars
from tideweave.operators import compaction, counters, dag, docstore, jsondoc, lattice, maps, prefix, presence, registers, relay, replication, richtext, sequence, sets, undo, vectors
from tideweave.schemas import COUNTER_OPS, JSON_OPS, SEQ_OPS
from tideweave.sources import store


def as_set(df):
    return {tuple(r) for r in df.collect()}


def shuffled_twice(df, spark, seed):
    """The rows in another order and partly repeated."""
    rows = df.collect()
    rng = random.Random(seed)
    rows = rows + rng.sample(rows, len(rows) // 2)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, df.schema)


# --- lattice laws ---------------------------------------------------------------------------------


def states(spark):
    rng = random.Random(4)
    return {
        "gset": ([spark.createDataFrame([("s", str(rng.randrange(20))) for _ in range(10)], "set_id string, element string") for _ in range(3)], sets.gset_join),
        "counter": ([spark.createDataFrame([("c", r, rng.randrange(100), rng.randrange(50)) for r in "abc"], "counter string, replica string, inc long, dec long") for _ in range(3)], counters.join),
        "lww": ([spark.createDataFrame([("k", rng.randrange(3), rng.choice("ab"), rng.choice(["x", "y", None]))], "key string, ts_ms long, replica string, value string") for _ in range(3)], registers.lww_join),
        "mv": ([spark.createDataFrame([("k", rng.choice("ab"), rng.randrange(3), "v")], "key string, replica string, seq long, value string") for _ in range(3)], registers.mv_join),
        "vector": ([spark.createDataFrame([(r, rng.randrange(9)) for r in "abc"], "replica string, seq long") for _ in range(3)], vectors.join),
        "sequence": ([_nodes(spark, rng) for _ in range(3)], sequence.join),
        "map": ([spark.createDataFrame([("m", "k", r, 1, "Int", rng.randrange(3), None, None) for r in "ab"], "map_id string, key string, replica string, seq long, v_kind string, v_int long, v_text string, v_bytes binary") for _ in range(3)], maps.join),
    }


def _nodes(spark, rng):
    rows = [("d", (i, "r"), (i - 1, "r" if i > 1 else ""), None if gone else str(i), gone) for i in range(1, 6) for gone in [rng.random() < 0.3]]
    return spark.createDataFrame(rows, "doc_id string, id struct<seq: long, replica: string>, origin struct<seq: long, replica: string>, value string, deleted boolean")


@pytest.mark.parametrize("kind", ["gset", "counter", "lww", "mv", "vector", "sequence", "map"])
def test_join_is_commutative_associative_idempotent(spark, kind):
    (a, b, c), join = states(spark)[kind]
    want = as_set(join(a, b, c))
    assert as_set(join(join(c, a), b)) == as_set(join(a, join(b, c))) == as_set(join(b, a, c, a, b)) == want
    assert as_set(join(a, a)) == as_set(join(a)) and as_set(join(a, a.limit(0))) == as_set(join(a))
    assert as_set(shuffled_twice(join(a, b, c), spark, 1).transform(join)) == want


# --- facts ----------------------------------------------------------------------------------------


def test_counters(spark):
    ops = spark.createDataFrame([("r1", 1, 0, "c", "inc", 100), ("r1", 2, 0, "c", "dec", 20), ("r2", 1, 0, "c", "inc", 50), ("r2", 2, 0, "c", "dec", 30), ("r3", 1, 0, "d", "inc", 2**62), ("r3", 2, 0, "d", "inc", 2**62)], COUNTER_OPS)
    assert as_set(counters.value(counters.from_ops(ops))) == {("c", 100), ("d", 2**63 - 1)}
    s = counters.from_ops(ops).where("counter = 'c'")
    assert as_set(counters.own(s, "r2")) == {("c", 50, 30)} and as_set(counters.own(s, "r9")) == {("c", 0, 0)}


def test_add_wins(spark):
    added = spark.createDataFrame([("s", "e", "r0", 1), ("s", "e", "r0", 2)], "set_id string, element string, tag_replica string, tag_seq long")
    seen = added.where("tag_seq = 1")
    removal = sets.orset_remove(seen, added.limit(0).drop("element"), spark.createDataFrame([("s", "e")], "set_id string, element string"))
    assert as_set(sets.orset_elements(added, removal)) == {("s", "e")}
    assert sets.orset_live(seen, removal).count() == 0


def test_registers(spark):
    w = "key string, ts_ms long, replica string, value string"
    assert as_set(registers.lww_get(registers.lww_join(spark.createDataFrame([("k", 100, "r1", "10"), ("k", 200, "r2", "20"), ("k", 150, "r3", "30")], w)))) == {("k", "20")}
    assert as_set(registers.lww_get(registers.lww_join(spark.createDataFrame([("k", 1000, x, f"from_{x}") for x in "acb"], w)))) == {("k", "from_c")}
    mv = registers.mv_join(spark.createDataFrame([("k", "a", 1, "x")], "key string, replica string, seq long, value string"), spark.createDataFrame([("k", "b", 1, "y")], "key string, replica string, seq long, value string"))
    assert as_set(registers.mv_conflicts(mv)) == {("k", 2)}
    assert registers.mv_remove_dots(mv, mv.where("replica = 'a'")).count() == 1


def test_vectors_and_stability(spark):
    vv = spark.createDataFrame([(h, r, s) for h, seqs in (("r1", (100, 50, 75)), ("r2", (80, 50, 75)), ("r3", (70, 40, 75))) for r, s in zip(("r1", "r2", "r3"), seqs)], "holder string, replica string, seq long")
    frontier = vectors.stable_frontier(vv)
    assert as_set(frontier) == {("r1", 70), ("r2", 40), ("r3", 75)}
    a = spark.createDataFrame([("r1", 100), ("r2", 50), ("r3", 75)], "replica string, seq long")
    b = spark.createDataFrame([("r1", 80), ("r2", 50), ("r3", 60)], "replica string, seq long")
    assert as_set(vectors.diff(a, b)) == {("r1", 81, 100), ("r3", 61, 75)}
    assert as_set(vectors.meet(a, b)) == as_set(b)
    assert vectors.set_entry(a, spark.createDataFrame([("r1", 0), ("r2", 9)], a.schema)).where("replica = 'r2'").first().seq == 9
    assert compaction.stability_state(vv, a).first().state == "Partial" and compaction.stability_state(vv, frontier).first().state == "Stable"
    assert compaction.has_quorum(2, 2) and not compaction.has_quorum(2, 1) and compaction.has_quorum(2, 2, all_peers=False)
    assert as_set(compaction.is_operation_stable(frontier, spark.createDataFrame([("r1", 70), ("r1", 71)], "replica string, seq long"))) == {("r1", 70)}
    only = vectors.dominance(vv, spark.createDataFrame([("r1", "r3"), ("r3", "x")], "a string, b string")).orderBy("a").collect()
    assert only[0].strictly and not only[0].concurrent and only[1].a_dominates


def tree(spark):
    base = dag.genesis(spark, "g")

    def node(parents, name):
        rows = parents.agg(F.collect_list("cid").alias("parents")).select("parents", F.lit(1).cast("tinyint").alias("payload_type"), F.encode(F.lit(name), "utf-8").alias("payload"), F.lit(1).cast("long").alias("timestamp"), F.lit("c").alias("creator"))
        return dag.with_cid(rows).select(*base.columns)

    a, b, c = (node(base, x) for x in "abc")
    return [base, a, b, c, node(a, "d"), node(b, "e")]


def test_dag_tree(spark):
    parts = [spark.createDataFrame(p.collect(), p.schema) for p in tree(spark)]
    nodes = sets.union_all(*parts)
    s = dag.stats(nodes).first()
    assert (s.nodes, s.heads, s.missing, s.depth) == (6, 3, 0, 3)
    gap = sets.union_all(*parts[:1], *parts[2:])
    assert dag.missing(gap).count() == 1 and dag.heads(gap).count() == 3
    assert dag.put(parts[0], sets.union_all(*reversed(parts[1:]))).count() == 5  # any order
    assert dag.put(parts[0], sets.union_all(*parts[2:])).count() == 3  # the child of the absent one waits
    assert dag.put_unchecked(parts[0], sets.union_all(*parts[2:])).count() == 4
    tampered = nodes.withColumn("payload", F.lit(b"x"))
    assert dag.put(parts[0], tampered).count() == 0 and dag.verify(tampered).count() == 0
    have = parts[1].select("cid")
    answer = dag.handle_request(nodes, nodes.limit(0).select("cid"), have, limit=2)
    assert answer.count() == 4 and answer.where("sent").count() == 2 and answer.where("sent").agg(F.max("level")).first()[0] == 2
    assert dag.is_synced(nodes, dag.heads(nodes)).first().synced and not dag.is_synced(gap, parts[1]).first().synced
    full = dag.sync_all(sets.union_all(*[p.withColumn("replica", F.lit(f"r{i % 3}")) for i, p in enumerate(parts)]))
    assert full.count() == 18 and dag.converged(full).first().converged
    assert [r.depth for r in dag.ancestors(nodes, parts[4]).orderBy("depth").collect()] == [1, 2]
    kept, gone = compaction.pruned_below(nodes, dag.heads(nodes), 10_000, preserve_depth=0, min_age=0, genesis_path=False)
    assert gone.count() == 3 and compaction.disconnected(kept, gone).count() == 0 and compaction.disconnected(kept).count() == 3


def test_reachable_is_what_ancestors_reach(spark):
    nodes = sets.union_all(*[spark.createDataFrame(p.collect(), p.schema) for p in tree(spark)])
    start = dag.heads(nodes)
    for depth in (1, 2, None):
        for own in (False, True):
            want = {r.cid for r in dag.ancestors(nodes, start, depth, include_self=own).collect()}
            got = [r.cid for r in dag.reachable(nodes, start, depth, include_self=own).collect()]
            assert set(got) == want and len(got) == len(want)


def test_a_whole_exchange_has_no_limit(spark):
    root = dag.genesis(spark, "c")
    kids = dag.with_cid(spark.range(150).join(root.select(F.col("cid").alias("root"))).select(F.array("root").alias("parents"), F.lit(1).cast("tinyint").alias("payload_type"), F.lit(b"x").alias("payload"), F.col("id").alias("timestamp"), F.lit("c").alias("creator"))).select(*root.columns)
    kids = spark.createDataFrame(kids.collect(), kids.schema)
    peer = root.unionByName(kids)
    some, new = dag.sync_from(root, peer)
    assert new.count() == 100 and not dag.is_synced(some, dag.heads(peer)).first().synced
    full, new = dag.sync_from(root, peer, None)
    assert new.count() == 150 and dag.is_synced(full, dag.heads(peer)).first().synced


def test_rows_of_the_dag_do_not_come_to_the_driver(spark, monkeypatch):
    """Neither by a broadcast that goes by the size of compressed files, nor in a snapshot's list of heads."""
    nodes = sets.union_all(*[spark.createDataFrame(p.collect(), p.schema) for p in tree(spark)])
    plan = compaction.prunable(nodes, dag.heads(nodes), 10_000, preserve_depth=1, min_age=0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    fetched, first = set(), type(nodes).first
    monkeypatch.setattr(type(nodes), "first", lambda self: (fetched.update(self.columns), first(self))[1])
    both = spark.createDataFrame([(h, r, 5) for h in ("me", "peer") for r in ("a", "b")], "holder string, replica string, seq long")
    assert compaction.compact(nodes, snapshot_rows(spark, []), both, "me", b"s", 10_000, preserve_depth=0, min_age=0).snapshot_created
    assert "superseded_roots" not in fetched


def test_snapshots(spark):
    rows = [({"a": 3}, [], b"6", 10, "c"), ({"a": 5, "b": 1}, [], b"15", 20, "c"), ({"b": 9}, [], b"x", 15, "d")]
    snaps = compaction.make_snapshots(spark.createDataFrame(rows, "vv map<string, bigint>, superseded_roots array<string>, state binary, created_at long, creator string"))
    wanted = spark.createDataFrame([("a", 4)], "replica string, seq long")
    assert [r.created_at for r in compaction.covering(snaps, wanted).collect()] == [20] and compaction.best_covering(snaps, wanted).first().created_at == 20
    # arrivals are a:3, then b:9 beside it, then a:5 b:1 above the first: concurrent ones never replace the latest
    assert [r.created_at for r in compaction.latest(snaps).collect()] == [20] and [r.created_at for r in compaction.latest(snaps.where("created_at < 20")).collect()] == [10]
    assert as_set(compaction.latest(snaps, "creator").select("creator", "created_at", "total_ops")) == {("c", 20, 6), ("d", 15, 9)}
    assert compaction.latest(snaps.limit(0)).count() == 0
    assert as_set(compaction.retained(snaps, 1).select("creator", "created_at")) == {("c", 20), ("d", 15)}
    log = spark.createDataFrame([("a", i) for i in range(1, 8)], "replica string, seq long")
    assert compaction.bootstrap(vectors.from_entries(spark.createDataFrame([("s", [("a", 5)])], "holder string, entries array<struct<replica: string, seq: bigint>>")), log).count() == 2
    assert compaction.should_snapshot(0, 0, 0) and not compaction.should_snapshot(1, 5, 5) and compaction.should_compact(True, 500, 2, True)


def snapshot_rows(spark, rows):
    return compaction.make_snapshots(spark.createDataFrame(rows, "vv map<string, bigint>, superseded_roots array<string>, state binary, created_at long, creator string"))


def test_compaction(spark):
    """Snapshot when due, prune below a stable one only, verify, report; a tick drops stale peers first."""
    nodes = sets.union_all(*[spark.createDataFrame(p.collect(), p.schema) for p in tree(spark)])
    vv = "holder string, replica string, seq long"
    both = spark.createDataFrame([("me", "a", 5), ("me", "b", 2), ("peer", "a", 5), ("peer", "b", 2)], vv)
    behind = spark.createDataFrame([("me", "a", 5), ("me", "b", 2), ("peer", "a", 1)], vv)
    none = snapshot_rows(spark, [])
    policy = {"preserve_depth": 0, "min_age": 0, "genesis_path": False}
    done = compaction.compact(nodes, none, both, "me", b"s", 10_000, **policy)
    assert done.snapshot_created and done.snapshots.count() == 1 and done.nodes_pruned == 3 and done.nodes.count() == 3
    made = done.snapshots.first()
    assert (made.id, made.vv, bytes(made.state), made.creator) == (done.snapshot_created, {"a": 5, "b": 2}, b"s", "me") and sorted(made.superseded_roots) == sorted(r.cid for r in dag.heads(nodes).collect())
    waits = compaction.compact(nodes, none, behind, "me", b"s", 10_000, **policy)
    assert waits.snapshot_created and waits.nodes_pruned == 0 and waits.pruned is None and waits.nodes.count() == 6
    assert compaction.compact(nodes, none, behind, "me", b"s", 10_000, require_stable=False, **policy).nodes_pruned == 3
    assert compaction.compact(nodes, done.snapshots, both, "me", b"s", 10_001, **policy).snapshot_created is None  # no new operations, no age
    assert compaction.compact(nodes, done.snapshots, both, "me", b"t", 30_000, **policy).snapshot_created  # old
    gap = nodes.where(F.col("cid") != nodes.where("payload = encode('a', 'utf-8')").first().cid)
    with pytest.raises(ValueError, match="missing below the heads"):
        compaction.compact(gap, none, behind, "me", b"s", 10_000, **policy)
    updates = spark.createDataFrame([("peer", 1, 9_000)], "peer string, arrival long, updated_at long")
    tick = lambda now, **x: compaction.tick(nodes, done.snapshots, behind, updates, "me", b"s", now, **({"compact_ops": 7, "min_snapshots": 1} | policy | x))
    assert tick(10_001) is None  # the peer is behind
    late = tick(19_001, max_age=10**6)
    assert late.nodes_pruned == 3 and late.snapshot_created is None  # stale and dropped
    assert tick(19_001, auto=False) is None and tick(19_001, compact_ops=8) is None and tick(19_001, min_snapshots=2) is None


def test_replicas_with_the_same_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 2), ("b", "x", 1)], "holder string, k string, n int")
    assert replication.converged(rows, "k", "n").first()[0]
    assert not replication.converged(rows.unionAll(spark.createDataFrame([("b", "x", 1)], rows.schema)), "k", "n").first()[0]
    assert not replication.converged(rows.withColumn("n", F.when(F.col("holder") == "a", 3).otherwise(F.col("n"))), "k", "n").first()[0]


def test_declared_lattice(spark):
    span = lattice.lookup("span")
    values = lambda *rows: spark.createDataFrame(list(rows), "key string, value long, replica string")
    a, delta = span.apply("observe", span.zero(spark), values(("k", 3, "r"), ("k", 9, "q"), ("l", 1, "r")))
    b, _ = span.apply("observe", a, values(("k", 1, "p")))
    plain = lambda df: {(r.key, r.least, r.most, tuple(r.seen)) for r in df.select("key", "least", "most", "seen").collect()}
    assert plain(b) == plain(span.join(b, a, delta)) == plain(span.join(delta, b)) == {("k", 1, 9, ("p", "q", "r")), ("l", 1, 1, ("r",))}
    assert span.leq(a, b).first().leq and not span.leq(b, a).first().leq and span.leq(span.zero(spark), a).first().leq
    assert plain(span.apply_all(a, [])) == plain(a)
    own = lattice.register(lattice.Lattice("top", "k string, v long", ["k"], {"v": F.max}))
    assert lattice.lookup("top") is own and own.join(own.zero(spark), spark.createDataFrame([("x", 2), ("x", 5)], own.schema)).first().v == 5


# --- sequences against a plain interpreter ----------------------------------------------------------


class PlainRga:
    def __init__(self):
        self.nodes, self.gone = {}, set()

    def order(self):
        kids = {}
        for i, (o, _) in self.nodes.items():
            kids.setdefault(o, []).append(i)
        out, stack = [], sorted(kids.get((0, ""), []))
        while stack:
            i = stack.pop()
            out.append(i)
            stack += sorted(kids.get(i, []))
        return [i for i in out if i not in self.gone]

    def text(self):
        return "".join(self.nodes[i][1] for i in self.order())


@pytest.mark.parametrize("seed", range(3))
def test_sequence_against_interpreter(spark, seed):
    rng = random.Random(seed)
    ops, plain = [], {}
    for d in "pq":
        doc = plain[d] = PlainRga()
        for i in range(1, 40):
            live = doc.order()
            if live and rng.random() < 0.25:
                x = rng.choice(live)
                doc.gone.add(x)
                ops.append((d, "delete", x, None, None))
            else:
                me, at = (i, rng.choice("abc")), rng.choice([(0, "")] + live)
                doc.nodes[me] = (at, chr(97 + i % 26))
                ops.append((d, "insert", me, at, doc.nodes[me][1]))
    rng.shuffle(ops)
    nodes = sequence.from_ops(spark.createDataFrame(ops + ops[:10], SEQ_OPS))
    shown = sequence.visible(nodes)
    assert as_set(sequence.render(shown)) == {(d, p.text()) for d, p in plain.items()}
    half = len(ops) // 2
    state = sequence.from_ops(spark.createDataFrame(ops[:half], SEQ_OPS))
    late = sequence.join(nodes, state)
    assert as_set(sequence.render(sequence.visible(late))) == {(d, p.text()) for d, p in plain.items()}
    both = sets.union_all(state, nodes, state)  # not joined: the walk merges
    assert as_set(sequence.text_of(both)) == as_set(sequence.render(sequence.visible(both))) == {(d, p.text()) for d, p in plain.items() if p.text()}
    p = sequence.position_of(shown, shown.select("doc_id", "id")).where("doc_id = 'p'").orderBy("position").collect()
    assert [tuple(r.id) for r in p] == plain["p"].order()
    assert as_set(sequence.length(nodes)) == {(d, len(x.order())) for d, x in plain.items()}


def typed(spark, text):
    return sequence.typed_nodes(spark.createDataFrame([("d", text)], "k string, t string"), "k", F.col("t"))


def edited(spark, text, start, length, new):
    nodes = typed(spark, text)
    shown = sequence.visible(nodes)
    e = spark.createDataFrame([("d", start, length, new)], "doc_id string, start int, length int, text string")
    return sequence.render(sequence.visible(sequence.apply_ops(nodes, sequence.splice(shown, nodes, e, "r1")))).first().text


def test_text_edits(spark):
    assert edited(spark, "Hello", 5, 0, " World") == "Hello World"
    assert edited(spark, "Helo", 2, 0, "l") == "Hello"
    assert edited(spark, "Hello World", 6, 5, "Rust") == "Hello Rust"
    assert edited(spark, "Hello", 0, 0, ">> ") == ">> Hello"  # at 0 it stands first
    assert edited(spark, "Hello", 99, 0, "!") == "Hello!"
    shown = sequence.visible(typed(spark, "Hello"))
    held = sequence.clamped(shown, spark.createDataFrame([("d", 3, 99), ("d", 9, 1)], "doc_id string, start int, length int"))
    assert as_set(held.select("start", "length")) == {(3, 2)}


def test_list_move(spark):
    nodes = typed(spark, "123")
    shown = sequence.visible(nodes)
    m = sequence.move(shown, nodes, spark.createDataFrame([("d", 0, 1)], "doc_id string, src int, dst int"), "r1")
    assert sequence.to_list(sequence.visible(sequence.apply_ops(nodes, m))).first()["items"] == ["2", "1", "3"]


def test_rich_text(spark):
    nodes = typed(spark, "AB")
    shown = sequence.visible(nodes)
    marks = richtext.marks_from_ops(richtext.add_marks(shown, spark.createDataFrame([("d", "m1", 0, 2, "Bold", None, None), ("d", "m2", 0, 9, "Link", "u", None), ("d", "m3", 5, 9, "Code", None, None)], "doc_id string, mark_id string, start int, end int, mark_kind string, a1 string, a2 string")))
    e = spark.createDataFrame([("d", 1, 0, "X")], "doc_id string, start int, length int, text string")
    after = sequence.visible(sequence.apply_ops(nodes, sequence.splice(shown, nodes, e, "r1")))
    assert richtext.to_html(richtext.ranges(marks, after), after).first().html == '<strong><a href="u">AXB</strong></a>'
    assert richtext.has_mark(richtext.ranges(marks, after), spark.createDataFrame([("d", 1, "Bold", None, None), ("d", 1, "Link", "v", None)], "doc_id string, position int, mark_kind string, a1 string, a2 string")).count() == 1
    front = sequence.splice(shown, nodes, spark.createDataFrame([("d", 0, 0, "<"), ("d", 2, 0, ">")], "doc_id string, start int, length int, text string").where("text = '<'"), "r1")
    grown = sequence.visible(sequence.apply_ops(nodes, front))
    assert richtext.to_html(richtext.ranges(marks, grown), grown).first().html == '<strong><a href="u"><AB</strong></a>'  # borders belong to the mark
    gone = richtext.remove_marks(marks, marks.where("mark_id = 'm1'").select("doc_id", "mark_id"))
    assert gone.count() == 1
    inner = richtext.marks_from_ops(richtext.add_marks(shown, spark.createDataFrame([("d", "m4", 1, 2, "Bold", None, None)], "doc_id string, mark_id string, start int, end int, mark_kind string, a1 string, a2 string")))
    deleted = sequence.visible(sequence.apply_ops(nodes, sequence.delete(shown, spark.createDataFrame([("d", 0, 1)], "doc_id string, start int, length int"))))
    assert richtext.ranges(inner, shown).count() == 1 and richtext.ranges(inner, deleted).count() == 0  # the anchor is gone


# --- JSON -------------------------------------------------------------------------------------------


def test_json_documents(spark):
    def write(path, seq, replica, **v):
        full = {"kind": None, "b": None, "i": None, "f": None, "s": None, "ref": None} | v
        return ("d", path.split("."), seq, replica, *full.values())

    schema = "doc_id string, path array<string>, seq long, replica string, kind string, b boolean, i long, f double, s string, ref string"
    a = [write("user.name", 1, "a", kind="String", s="Ann"), write("data.n", 2, "a", kind="Int", i=1), write("settings.dark", 3, "a", kind="Bool", b=True)]
    b = [write("user.name", 1, "b", kind="String", s="Bob"), write("user.mail", 2, "b", kind="String", s="x@y"), write("data.f", 3, "b", kind="Float", f=float("inf"))]
    logs = [jsondoc.set_path(spark.createDataFrame(x, schema)) for x in (a, b)]
    merged = jsondoc.join(*logs)
    live = jsondoc.live_values(merged)
    want = '{"data":{"f":null,"n":1},"settings":{"dark":true},"user":{"mail":"x@y","name":"Bob"}}'
    assert jsondoc.to_json(jsondoc.winners(live)).first().json == want  # concurrent containers are one
    assert jsondoc.to_json(jsondoc.winners(jsondoc.live_values(jsondoc.join(*reversed(logs), logs[0])))).first().json == want
    name = live.where("key = 'name'").select("doc_id", "object_id", "key").distinct().select("*", F.lit(9).cast("long").alias("seq"), F.lit("a").alias("replica"))
    after = jsondoc.live_values(jsondoc.join(merged, jsondoc.delete(live, name)))
    assert jsondoc.to_json(jsondoc.winners(after)).first().json == want.replace(',"name":"Bob"', "")
    assert as_set(jsondoc.keys(after).select("key")) == {("data",), ("settings",), ("user",)}
    got = jsondoc.get(jsondoc.winners(live), spark.createDataFrame([("d", "user.name"), ("d", "user.0"), ("d", "none")], "doc_id string, p string").select("doc_id", paths.parse(F.col("p")).alias("path")), 2)
    assert [r.value.s for r in got.collect()] == ["Bob"]
    arr = spark.createDataFrame([("d", "root", "xs", (5, "a"), "Array", None, None, None, None, "L", [])], JSON_OPS)
    items = spark.createDataFrame([("d", "L", 1, "Int", None, 2, None, None, None), ("d", "L", 0, "Int", None, 1, None, None, None)], "doc_id string, array_id string, position int, kind string, b boolean, i long, f double, s string, ref string")
    assert jsondoc.to_json(jsondoc.winners(jsondoc.live_values(arr)), items).first().json == '{"xs":[1,2]}'


def test_concurrent_counters_in_documents_merge(spark):
    """Three replicas that make the same counter path at once keep all their increments."""
    schema = "doc_id string, path array<string>, seq long, replica string, kind string, b boolean, i long, f double, s string, ref string"
    logs = [jsondoc.set_path(spark.createDataFrame([("d", ["counters", "hits", f"node-{k}", "inc"], 1, f"node-{k}", "Int", None, n, None, None, None)], schema)) for k, n in ((1, 50), (2, 90), (3, 70))]
    totals = jsondoc.counter_totals(jsondoc.winners(jsondoc.live_values(jsondoc.join(*logs))))
    assert totals.agg(F.sum("inc") - F.sum("dec")).first()[0] == 210


def test_json_arrays(spark):
    """Insert, push, remove in an array of a document, and its place in the JSON."""
    none = spark.createDataFrame([], SEQ_OPS)
    nodes = sequence.from_ops(none)
    for step, (position, value) in enumerate([(0, 1), (99, 3), (1, 2), (0, 0)]):
        edit = spark.range(1).select(jsondoc.array_key(F.lit("d"), F.lit("L")).alias("doc_id"), F.lit(position).alias("position"), jsondoc.array_value(F.struct(F.lit("Int").alias("kind"), F.lit(value).alias("i"))).alias("value"))
        grown = sequence.apply_ops(nodes, sequence.insert_values(sequence.visible(nodes), nodes, edit, f"r{step % 2}"))
        nodes = spark.createDataFrame(grown.collect(), grown.schema)
    shown = sequence.visible(nodes)
    removed = sequence.apply_ops(nodes, sequence.delete(shown, spark.createDataFrame([("d#L", 1, 1)], "doc_id string, start int, length int")))
    root = spark.createDataFrame([("d", "root", "xs", (9, "a"), "Array", None, None, None, None, "L", [])], JSON_OPS)
    won = jsondoc.winners(jsondoc.live_values(root))
    assert jsondoc.to_json(won, jsondoc.array_items(shown)).first().json == '{"xs":[0,1,2,3]}'
    assert jsondoc.to_json(won, jsondoc.array_items(sequence.visible(removed))).first().json == '{"xs":[0,2,3]}'
    assert as_set(jsondoc.array_lengths(removed)) == {("d#L", 3)}


def test_tick(spark):
    parts = [spark.createDataFrame(p.collect(), p.schema) for p in tree(spark)]
    nodes = sets.union_all(*parts)
    roots = [r.cid for r in dag.heads(nodes).collect()]
    shape = "vv map<string, bigint>, superseded_roots array<string>, state binary, created_at long, creator string"
    snaps = compaction.make_snapshots(spark.createDataFrame([({"a": 3}, roots, b"6", 10, "c"), ({"a": 1}, [], b"1", 5, "c")], shape))
    frontiers = spark.createDataFrame([("p", "a", 3), ("q", "a", 1)], "holder string, replica string, seq long")
    updates = spark.createDataFrame([("p", 1, 99_000), ("q", 1, 0)], "peer string, arrival long, updated_at long")
    due = dict(compact_ops=3, preserve_depth=0, min_age=0, max_age=10**6, genesis_path=False)
    tick = lambda u, **x: compaction.tick(nodes, snaps, frontiers, u, "p", b"s", 100_000, **due | x)
    assert tick(updates.withColumn("updated_at", F.lit(99_000).cast("long"))) is None  # q lags behind
    done = tick(updates)  # q is stale and dropped
    assert done.nodes_pruned == 3 and done.nodes.count() == 3 and done.snapshot_created is None
    assert tick(updates, compact_ops=4) is None


def test_paths_and_scalars(spark):
    one = spark.range(1)
    p = paths.parse(F.lit("a.0.b"))
    r = one.select(paths.render(paths.parent(p)).alias("parent"), paths.last(p)["key"].alias("last"), paths.render(paths.child_index(paths.child_key(p, F.lit("c")), F.lit(4))).alias("child"), F.size(paths.parse(F.lit(""))).alias("root"), F.size(paths.prefixes(p)).alias("n")).first()
    assert tuple(r) == ("a.0", "b", "a.0.b.c.4", 0, 2)
    s, e = scalars.selection_range(F.lit(15), F.lit(5))
    assert tuple(one.select(s, e, scalars.selection_length(F.lit(15), F.lit(5)), scalars.selection_length(F.lit(None).cast("int"), F.lit(5))).first()) == (5, 15, 10, 0)
    assert one.select(hashing.le8(F.lit(258).cast("long"))).first()[0] == (258).to_bytes(8, "little")
    assert one.select(hashing.from_hex(F.lit("zz"))).first()[0] is None
    import hashlib

    cid = one.select(hashing.node_cid(F.array(F.lit("ff" * 32), F.lit("00" * 32)), F.lit(1), F.lit(b"pay"), F.lit(7).cast("long"), F.lit("me"))).first()[0]
    assert cid == hashlib.sha256((2).to_bytes(8, "little") + b"\x00" * 32 + b"\xff" * 32 + b"\x01pay" + (7).to_bytes(8, "little") + b"me").hexdigest()
    inv = one.select(scalars.inverse_text(F.lit("replace"), F.lit(1), F.lit("old"), F.lit("new")).alias("v")).first().v
    assert (inv.op_kind, inv.deleted, inv.inserted) == ("replace", "new", "old")
    fmt = one.select(scalars.inverse_format(F.lit("remove_mark"), F.lit("m"), F.lit("Bold")).alias("v")).first().v
    assert fmt.op_kind == "add_mark" and fmt.mark == "Bold"
    js = one.select(scalars.inverse_json(F.lit("set"), F.lit("p"), F.lit(None), F.lit(None), F.lit("n")).alias("v")).first().v
    assert js.op_kind == "delete" and js.old == "n"
    u = one.select(scalars.lcg_uniform(scalars.lcg_next(F.lit(12345).cast("long")))).first()[0]
    assert u == scalars.lcg_stream(12345, 1)[0]
    add = one.select(scalars.saturating_add(F.lit(2**63 - 1), F.lit(5))).first()[0]
    assert add == 2**63 - 1


# --- stores, presence, undo, replication ------------------------------------------------------------


def test_document_store(spark):
    c = "replica string, seq long, ts_ms long, doc_id string, kind string, doc_type string, title string, meta_key string, meta_value string"
    log = spark.createDataFrame([
        ("r", 1, 10, "d1", "create", "Text", "A", None, None), ("q", 1, 20, "d1", "create", "Json", "Z", None, None), ("r", 2, 30, "d1", "metadata", None, None, "k", "1"), ("q", 2, 25, "d1", "metadata", None, None, "k", "0"),
        ("r", 3, 5, "d2", "update", None, None, None, None), ("r", 4, 40, "d3", "create", "Text", "AB", None, None), ("r", 5, 50, "d3", "delete", None, None, None, None), ("r", 6, 60, "d4", "create", "RichText", "A", None, None),
    ], c)
    docs = docstore.replay(log)
    assert as_set(docs.select("doc_id", "title", "doc_type", "modified_at")) == {("d1", "A", "Text", 30), ("d4", "A", "RichText", 60)}
    assert as_set(docstore.replay(shuffled_twice(log, spark, 2)).select("doc_id", "modified_at")) == {("d1", 30), ("d4", 60)}
    assert docstore.find_by_title(docs, spark.createDataFrame([("A",)], "title string")).first().doc_id == "d4"
    assert [r.doc_id for r in docstore.query(docs, title_prefix="A", sort="created_at", descending=True, limit=1).collect()] == ["d4"]
    assert as_set(docstore.checked_edits(docs, spark.createDataFrame([("d1",), ("d4",), ("d9",)], "doc_id string"), "Text").select("doc_id", "error")) == {("d1", None), ("d4", "TypeMismatch"), ("d9", "NotFound")}
    both = docstore.join_values(docs.drop("metadata"), docs.drop("metadata").withColumn("modified_at", F.lit(99).cast("long")))
    assert both.count() == 2 and both.agg(F.min("modified_at")).first()[0] == 99


def test_presence(spark):
    e = spark.createDataFrame([("u", 1, 0, "Online", "a", 1, None, False), ("u", 2, 40_000, "Typing", "b", 5, 15, False), ("v", 1, 1000, "Online", "a", 2, None, False), ("w", 1, 41_000, "Offline", "a", 3, None, False)], "user_id string, clock long, ts_ms long, status string, doc_id string, position int, anchor int, removed boolean")
    now = 50_000
    assert as_set(presence.online(presence.current(e), now).select("user_id")) == {("u",)}
    assert as_set(presence.users_in_document(e, now)) == {("a", "u"), ("b", "u")}
    assert as_set(presence.expired(presence.current(e), now)) == {("v",)} and presence.expired(presence.current(e), now, "v").count() == 0
    left = e.unionByName(presence.removals(presence.current(e).where("user_id = 'u'").select("user_id", "clock"), now))
    assert as_set(presence.current(left).select("user_id")) == {("v",), ("w",)}


def test_undo(spark):
    ops = [("d", "r", i, a, g, "insert", i, None, f"t{i}") for i, (a, g) in enumerate([("record", None), ("record", "g"), ("record", "g"), ("undo", None), ("redo", None), ("undo", None), ("undo", None), ("undo", None), ("redo", None), ("record", None), ("redo", None)])]
    df = spark.createDataFrame(ops, "doc_id string, replica string, clock long, action string, group_id string, op_kind string, position int, deleted string, inserted string")
    got = [(r.at, r.how, r.source_clock) for r in undo.replay(df).orderBy("at", F.when(F.col("how") == "undo", -F.col("source_clock")).otherwise(F.col("source_clock"))).collect()]
    assert got == [(3, "undo", 2), (3, "undo", 1), (4, "redo", 1), (4, "redo", 2), (5, "undo", 2), (5, "undo", 1), (6, "undo", 0), (8, "redo", 0)]
    assert as_set(undo.stacks(df)) == {("d", "r", 2, 0)}
    assert as_set(undo.stacks(df, max_history=1).select("n_undo")) == {(1,)}


UNDO = "doc_id string, replica string, clock long, action string, group_id string, op_kind string, position int, deleted string, inserted string"


def test_undo_takes_the_whole_group_wherever_it_stands(spark):
    actions = [("record", "g"), ("record", None), ("record", "g"), ("undo", None), ("undo", None), ("redo", None), ("redo", None), ("undo", None), ("remote", None), ("clear", None), ("undo", None)]
    df = spark.createDataFrame([("d", "r", i, a, g, "insert", i, None, "x") for i, (a, g) in enumerate(actions)], UNDO)
    got = [(r.at, r.how, r.source_clock) for r in undo.replay(df).collect()]
    assert got == [(3, "undo", 2), (3, "undo", 0), (4, "undo", 1), (5, "redo", 1), (6, "redo", 0), (6, "redo", 2), (7, "undo", 2), (7, "undo", 0)]
    assert as_set(undo.stacks(df.where("clock < 4"))) == {("d", "r", 1, 1)} and as_set(undo.stacks(df.where("clock < 8"))) == {("d", "r", 1, 1)} and as_set(undo.stacks(df)) == {("d", "r", 0, 0)}


def test_undo_folds_many_long_histories(spark):
    """Histories of several batches each; remote operations fill the history and push old ones out."""
    rows = [(f"d{j}", "r", i, "remote" if i % 3 == 0 else "record", None, "insert", i, None, "x") for j in range(5) for i in range(12_000)] + [(f"d{j}", "r", 20_000 + i, "undo", None, None, None, None, None) for j in range(5) for i in range(3)]
    df = spark.createDataFrame(rows, UNDO).repartition(7, "clock")
    assert as_set(undo.stacks(df, 90).select("doc_id", "n_undo", "n_redo")) == {(f"d{j}", 57, 3) for j in range(5)}
    assert sorted(r.source_clock for r in undo.replay(df, 90).where("doc_id = 'd3'").collect()) == [11_996, 11_998, 11_999]
    assert undo.replay(df.limit(0)).count() == 0


def test_replication(spark):
    log = spark.createDataFrame([("r", i, f"p{i}") for i in range(1, 11)], "replica string, seq long, payload string")
    acks = replication.merged_acks(replication.registered(spark, [("r", "p"), ("r", "q")]), spark.createDataFrame([("r", "p", 4), ("r", "p", 2), ("r", "x", 9)], "replica string, peer string, acked long"))
    assert as_set(acks) == {("r", "p", 4), ("r", "q", 0)}
    assert as_set(replication.delta_groups(log, acks)) == {("r", "p", 10, 6), ("r", "q", 10, 10)}
    assert replication.collected(log, acks).count() == 10 and replication.collected(log, acks.where("peer = 'p'")).count() == 6
    sent = replication.link(spark.range(1000).select(F.col("id").alias("n")), loss=0.3)
    again = replication.link(replication.retransmitted(sent).select((F.col("n") + 5000).alias("n")))
    assert 200 < sent.where("lost").count() < 400 and replication.delivered(sent).count() + replication.delivered(again).count() == 1000
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 8}") for i in range(8)], "src string, dst string")
    msg = replication.announcement(spark.createDataFrame([("n0", [hashing.ZERO], 1)], "origin string, heads array<string>, timestamp long"), ttl=3)
    assert as_set(replication.gossip(msg, ring).select("replica", "hop")) == {("n0", 0), ("n1", 1), ("n2", 2), ("n3", 3)}
    full = replication.mesh(spark, ["a", "b", "c", "d", "e"])
    assert replication.first_peers(full, 3).count() == 15 and replication.routed(spark.createDataFrame([("a", "z")], "src string, dst string"), full).first().error == "PeerNotFound"


def test_rooms(spark):
    rows = [(1, "join", "d", "u"), (2, "join", "d", "v"), (3, "sync", "d", "u"), (4, "leave", "d", "v"), (5, "sync", "d", "u"), (6, "join", "d", "w"), (7, "sync_request", "d", "w")]
    m = spark.createDataFrame([(a, t, d, u, u.upper(), None, "s", None, None, None) for a, t, d, u in rows], "arrival long, type string, doc_id string, user_id string, user_name string, user_color string, state string, cursor int, sel_start int, sel_end int")
    assert as_set(relay.fan_out(m).select("arrival", "receiver")) == {(3, "v")}
    assert as_set(relay.members(m).select("user_id")) == {("u",), ("w",)}
    assert as_set(relay.sync_requests(m).select("sender", "receiver")) == {("w", "u")}
    lines = spark.createDataFrame([(1, '{"type": "join", "doc_id": "d", "user_id": "u"}'), (2, "{nope"), (3, '{"type": "other"}')], "arrival long, value string")
    assert relay.parse(lines).count() == 1


def test_durable_state(spark, tmp_path):
    s = spark.createDataFrame([("a", "c", 1), ("b", "c", 2)], "replica string, counter string, inc long")
    store.persist(s, str(tmp_path / "s"))
    store.persist(s.where("replica = 'a'").withColumn("inc", F.lit(9).cast("long")), str(tmp_path / "s"))
    assert store.load(spark, str(tmp_path / "s"), "a").first().inc == 9 and store.load(spark, str(tmp_path / "s"), "b").first().inc == 2 and store.load(spark, str(tmp_path / "s"), "z").count() == 0
    store.export(s, str(tmp_path / "e"), 7)
    back, version = store.restore(spark, str(tmp_path / "e"), "replica string, counter string, inc long")
    assert version == 7 and as_set(back.select(*s.columns)) == as_set(s)
    assert as_set(store.deserialized(store.serialized(s, "replica"), "replica", "counter string, inc long")) == as_set(s)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_totals_over_many_partitions(spark, parts):
    """One key holds most rows and covers several partitions; totals equal those of a loop."""
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, rng.choice([None, *range(-5, 9)])) for i in range(5000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, at long, v long")
        got = prefix.running(df, ["key"], ["at"], total=("sum", F.col("v")), top=("max", F.col("v")), above=("max before", F.col("v")), n=("sum before", F.lit(1)))
        got = {(r.key, r.at): (r.total, r.top, r.above, r.n) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = {}
    for key, at, v in rows:
        total, top, n = state.get(key, (0, None, 0))
        state[key] = total + (v or 0), max((x for x in (top, v) if x is not None), default=None), n + 1
        assert got[key, at] == (*state[key][:2], top, n)
    assert prefix.running(df.limit(0), ["key"], ["at"], n=("sum", F.lit(1))).count() == 0


def test_levels_and_chains_of_deep_graphs(spark):
    """Levels against a loop over random graphs and a long chain; a cycle is an error."""
    shape = "cid string, parents array<string>, payload_type tinyint, payload binary, timestamp long, creator string"
    rng = random.Random(8)
    parents = {i: sorted({rng.randrange(max(0, i - 6), i) for _ in range(rng.randint(0, 3))}) for i in range(1, 60)} | {0: []}
    name = lambda i: f"n{i:03d}"
    nodes = spark.createDataFrame([(name(i), [*map(name, p), "absent"], 1, b"", i, "c") for i, p in parents.items()], shape)
    level = {}
    for i in range(60):
        level[name(i)] = 1 + max((level[name(p)] for p in parents[i]), default=0)
    assert as_set(dag.levels(nodes)) == set(level.items())
    chain = spark.createDataFrame([(name(i), [name(i - 1)] if i else [], 1, b"", i, "c") for i in range(75)], shape)
    assert as_set(dag.first_parent_path(chain)) == {(name(74 - k), k) for k in range(75)}
    assert dag.levels(chain).agg(F.max("level")).first()[0] == 75
    with pytest.raises(ValueError, match="cycle"):
        dag.levels(spark.createDataFrame([("a", ["b"], 1, b"", 1, "c"), ("b", ["a"], 1, b"", 1, "c"), ("r", [], 1, b"", 1, "c")], shape))
