"""Queries over protocols and small operators: stores and recovery, links and peers, rooms and sessions, policies, scalars, declared lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideweave.functions import paths, scalars
from tideweave.operators import compaction, counters, dag, docstore, jsondoc, lattice, maps, presence, registers, relay, replication, runs, sequence, sets, vectors
from tideweave.plans import documents, graphs, lattices
from tideweave.plans.sql import EV, NODES, le8
from tideweave.sources import logs, store
from tideweave.sources.shared import materialize, shared_path, shuffled


def _name(prefix, column):
    return F.concat(F.lit(prefix), F.lpad(column.cast("string"), 9, "0"))


def _events(spark, d):
    return logs.events(spark, d)


# --- document store ---------------------------------------------------------------------------------


def docstore_created(spark, d):
    """Documents of all three types, created through the store's own inserts."""
    kinds = (("Text", "supplier", "s_suppkey", "s_name"), ("RichText", "customer", "c_custkey", "c_name"), ("Json", "part", "p_partkey", "p_name"))
    new = [docstore.created(logs.table(spark, d, t).select(_name(t[0], F.col(k)).alias("doc_id"), F.col(n).alias("title"), F.col(k).cast("long").alias("seq")), kind, "r0", 1000) for kind, t, k, n in kinds]
    return docstore.replay(sets.union_all(*new)).select("doc_id", "title", "doc_type", "created_at")


def docstore_ids(spark, d):
    return docstore.document_ids(documents._store(spark, d))


def docstore_count(spark, d):
    return docstore.count(documents._store(spark, d))


def docstore_get(spark, d):
    return docstore.get(documents._store(spark, d), "d000000007").select("doc_id", "title", "doc_type")


def docstore_contains(spark, d):
    probes = logs.table(spark, d, "labels").select(_name("d", F.col("doc_id")).alias("doc_id")).distinct()
    return docstore.contains(documents._store(spark, d), probes)


def docstore_join_values(spark, d):
    """Two replicas' documents, each without some; where the types differ the left one stays."""
    whole = documents._store(spark, d).withColumn("n", F.substring("doc_id", 2, 9).cast("int"))
    a = whole.where("n % 11 <> 0").drop("n", "metadata")
    b = whole.where("n % 7 <> 0").withColumns({"doc_type": F.when(F.col("n") % 5 == 0, "Text").otherwise(F.col("doc_type")), "modified_at": F.col("modified_at") + 100}).drop("n", "metadata")
    return docstore.join_values(a, b).select("doc_id", "doc_type", "modified_at")


# --- durable state, snapshots, serialized states ----------------------------------------------------


def _half(spark, d):
    ev = _events(spark, d)
    half, _, whole = lattices._snapshots(ev, logs.counter_ops(ev), counters.from_ops)
    return half, whole


def durable_reload(spark, d):
    """All replicas persist half of the log, r3 later all of it; then every replica crashes and loads what it has."""
    half, whole = _half(spark, d)
    path = shared_path(spark, "durable")
    store.persist(half, path)
    store.persist(whole.where("replica = 'r3'"), path)
    if not store.flush(spark, path):
        raise RuntimeError("the durable state is not committed")
    return sets.union_all(*[store.load(spark, path, f"r{i}").select("counter", "replica", "inc", "dec") for i in range(logs.REPLICAS)])


def durable_recovered(spark, d):
    """After that crash, peers' states bring back what was volatile, and repeating it changes nothing."""
    _, whole = _half(spark, d)
    loaded = durable_reload(spark, d)
    return counters.value(counters.join(counters.join(loaded, whole), loaded, whole))


def snapshot_export(spark, d):
    """Documents written as a versioned snapshot and read back."""
    path = shared_path(spark, "export")
    store.export(documents._store(spark, d).select("doc_id", "title", "created_at"), path, 7)
    state, version = store.restore(spark, path, "doc_id string, title string, created_at bigint")
    return state.withColumn("version", F.lit(version))


def mvreg_serialized(spark, d):
    dots = registers.mv_read_with_dots(lattices._mv(spark, d))
    back = store.deserialized(store.serialized(dots, "key"), "key", "dots array<struct<replica: string, seq: bigint, value: string>>")
    return back.select("key", F.inline("dots"))


def crdtmap_serialized(spark, d):
    """Maps with their context as JSON and back; the context's size is repeated on each entry."""
    ops = logs.map_ops(_events(spark, d))
    entries = maps.put(ops).groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("key", "replica", "seq", "v_kind", "v_int", "v_text"))).alias("entries"))
    seen = maps.context(ops).groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("replica", "seq"))).alias("context"))
    shape = "entries array<struct<key: string, replica: string, seq: bigint, v_kind: string, v_int: bigint, v_text: string>>, context array<struct<replica: string, seq: bigint>>"
    back = store.deserialized(store.serialized(entries.join(seen, "map_id"), "map_id"), "map_id", shape)
    return back.select("map_id", F.size("context").alias("dots"), F.inline("entries"))


def richtext_serialized(spark, d):
    """Whole rich texts as JSON and back."""
    spans, lines, _ = documents._spans(spark, d)
    marks = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mark_id", "mark_kind", "start", "end"))).alias("marks"))
    rows = runs.text_of(lines).join(shuffled(marks), "doc_id", "left")
    back = store.deserialized(store.serialized(rows, "doc_id"), "doc_id", "text string, marks array<struct<mark_id: string, mark_kind: string, start: int, end: int>>")
    return back.select("doc_id", F.sha2("text", 256).alias("digest"), F.coalesce(F.size("marks"), F.lit(0)).alias("marks"))


def presence_serialized(spark, d):
    now = presence.current(documents._presence(spark, d)[0])
    back = store.deserialized(store.serialized(now, "user_id"), "user_id", "clock bigint, ts_ms bigint, status string, doc_id string, position int, anchor int")
    return back.select("user_id", "clock", "status", "doc_id", "position")


# --- links, peers, acknowledgements -----------------------------------------------------------------

_REPLICAS = [f"r{i}" for i in range(logs.REPLICAS)]


def mesh_fanout(spark, d):
    sent = _events(spark, d).select(F.col("replica").alias("src"), "event_id")
    return replication.fanned_out(sent, replication.mesh(spark, _REPLICAS)).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def channel_routing(spark, d):
    """Messages between replicas of which only r1 and r2 have a channel."""
    sent = _events(spark, d).select(F.col("replica").alias("src"), F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("dst"))
    out = replication.routed(sent, replication.channel_pair(spark, "r1", "r2"))
    return out.groupBy("src", "dst", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _incoming(spark, d):
    """Acknowledgements of five peers, of which p0 to p2 are registered."""
    return _events(spark, d).where("event_type <> 'click'").select("replica", F.concat(F.lit("p"), (F.col("k") % 5).cast("string")).alias("peer"), F.col("event_id").alias("acked"))


def acks_merged(spark, d):
    known = replication.registered(spark, [(r, f"p{j}") for r in _REPLICAS for j in range(3)])
    return replication.merged_acks(known, _incoming(spark, d))


def buffers_cleared(spark, d):
    """Buffers of the peers that never acknowledged anything."""
    log = graphs._log(spark, d).join(replication.registered(spark, [(r, f"p{j}") for r in _REPLICAS for j in range(3)]).drop("acked"), "replica")
    return replication.cleared(log, _incoming(spark, d).where("acked % 97 = 0")).groupBy("replica", "peer").agg(F.count(F.lit(1)).alias("n"))


def intervals_pending(spark, d):
    return replication.pending_intervals(replication.causal_prefix(graphs._intervals(spark, d)))


def intervals_buffered(spark, d):
    return replication.buffered_intervals(replication.causal_prefix(graphs._intervals(spark, d)))


def _link(spark, d):
    return replication.link(_events(spark, d).select(F.col("event_id").alias("n"), "replica"), loss=0.1, dup=0.2, reorder=0.3)


def link_delivered(spark, d):
    return replication.delivered(_link(spark, d)).select("n", "copy", "deliver_at")


def link_queue_heads(spark, d):
    return replication.next_delivery(_link(spark, d), "replica")


def gossip_forwarded(spark, d):
    return replication.forwarded(_events(spark, d).select("event_id", (F.col("k") % 4).alias("ttl")))


def _connections(spark, d):
    ev = _events(spark, d)
    return replication.connections(ev.select(F.col("replica").alias("src"), F.concat(F.lit("p"), (F.col("k") % 10).cast("string")).alias("dst"), F.when(F.col("event_type") == "error", "disconnect").otherwise("connect").alias("kind"), F.col("event_id").alias("arrival")))


def peers_connected(spark, d):
    return replication.peers(_connections(spark, d)).select("src", F.array_join("peers", ",").alias("peers"))


def hello_messages(spark, d):
    return replication.hello(_connections(spark, d), _events(spark, d).select(F.col("replica").alias("src")))[0]


def hello_events(spark, d):
    return replication.hello(_connections(spark, d), _events(spark, d).select(F.col("replica").alias("src")))[1]


def events_drained(spark, d):
    """What replicas take that have taken the first half of their events, and where they stand then."""
    ev = _events(spark, d).select("replica", F.col("event_id").alias("arrival"))
    taken = ev.groupBy("replica").agg(F.floor(F.max("arrival") / 2).alias("arrival"))
    new, now = replication.drain(ev, taken)
    return new.groupBy("replica").agg(F.count(F.lit(1)).alias("n")).join(now, "replica")


# --- rooms and sessions -----------------------------------------------------------------------------


def relay_sessions(spark, d):
    """Sessions made by their first request, without those that had an error."""
    ev = _events(spark, d).withColumn("session_id", F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")))
    made = relay.sessions(ev.select("session_id", F.col("replica").alias("peer_id"), F.col("event_id").alias("arrival")))
    return relay.closed(made, ev.where("event_type = 'error' and event_id % 7 = 0").select("session_id"))


def _opens(spark, d):
    return _events(spark, d).select(F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")).alias("session_id"), F.concat(F.lit("doc"), (F.col("k") % 20).cast("string")).alias("doc_id"), F.when(F.col("event_type") == "error", "close").otherwise("open").alias("kind"), F.col("event_id").alias("arrival"))


def relay_first_opened(spark, d):
    return relay.document_events(_opens(spark, d).where("kind = 'open'")).select("session_id", "doc_id", "arrival", "event")


def relay_document_changes(spark, d):
    return relay.document_changes(_opens(spark, d))


def relay_open_documents(spark, d):
    return relay.open_documents(_opens(spark, d))


def relay_sync_requests(spark, d):
    """One request per room, by each of its users in turn; it goes to the first other member that joined."""
    messages = logs.relay_messages(spark, d)
    rooms = messages.where("type = 'join'").select("doc_id").distinct().withColumn("n", F.substring("doc_id", 5, 20).cast("long"))
    ask = rooms.select("doc_id", F.lit("sync_request").alias("type"), F.concat(F.lit("u"), (F.col("n") % 4).cast("string")).alias("user_id"), (F.col("n") * 1000 + 10).alias("arrival"))
    return relay.sync_requests(messages.unionByName(ask, allowMissingColumns=True))


# --- registers, maps, sets, vectors -----------------------------------------------------------------


def lww_values(spark, d):
    return registers.lww_get(registers.lww_join(lattices._order_writes(spark, d)))


def lww_timestamps(spark, d):
    return registers.lww_timestamp(registers.lww_join(lattices._order_writes(spark, d)))


def mvreg_dots_removed(spark, d):
    mv = lattices._mv(spark, d)
    return registers.mv_remove_dots(mv, mv.where("seq % 2 = 0"))


def _map(spark, d):
    ops = logs.map_ops(_events(spark, d))
    return ops, maps.put(ops)


def crdtmap_contains(spark, d):
    """Of the keys that were ever removed those that some replica still holds."""
    ops, entries = _map(spark, d)
    return maps.contains_key(entries, ops.where("kind = 'remove'").select("map_id", "key").distinct())


def crdtmap_dots(spark, d):
    ops, _ = _map(spark, d)
    asked = ops.where("seq % 3 = 0").select(*maps.DOT)
    return maps.context_contains(maps.context(ops), asked.unionByName(asked.withColumn("seq", F.col("seq") + 10**12)))


def crdtmap_put_dot(spark, d):
    """An entry per nation under a dot of its own."""
    _, entries = _map(spark, d)
    null = F.lit(None)
    own = logs.table(spark, d, "nation").select(F.lit("m0").alias("map_id"), F.col("n_name").alias("key"), F.lit("r9").alias("replica"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("Int").alias("v_kind"), F.col("n_regionkey").cast("long").alias("v_int"), null.cast("string").alias("v_text"), null.cast("binary").alias("v_bytes"))
    return maps.put_with_dot(entries, own).drop("v_bytes")


def crdtmap_removed(spark, d):
    _, entries = _map(spark, d)
    return maps.remove(entries, entries.where("map_id = 'm7' or v_kind = 'Text'").select("map_id", "key").distinct()).drop("v_bytes")


def gset_inserted(spark, d):
    state = lattices._sets(_events(spark, d)).select("element").distinct()
    after, _ = sets.gset_insert(state, sets.gset_delta(spark, ["new", "newer", "new"]))
    return sets.gset_insert(after, sets.gset_delta(spark, ["new"]))[0]


def orset_added(spark, d):
    """Nations added by r9 to one of the sets, the delta applied twice."""
    state = lattices._orset(spark, d)
    ops = logs.table(spark, d, "nation").select(F.lit("r9").alias("replica"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("click").alias("set_id"), F.col("n_name").alias("element"))
    delta = (sets.orset_add(ops), state[1].limit(0))
    return sets.orset_elements(*sets.orset_apply_delta(sets.orset_apply_delta(state, delta), delta))


def counter_names(spark, d):
    return counters.names(counters.from_ops(logs.counter_ops(_events(spark, d))))


def vv_entries_set(spark, d):
    own = lattices._of(lattices._vectors(spark, d), "click")
    return vectors.set_entry(own, spark.createDataFrame([("r0", 5), ("r1", 0), ("r9", 7)], "replica string, seq long"))


def vv_entry_lookup(spark, d):
    vv = lattices._vectors(spark, d).groupBy("holder").agg(F.map_from_entries(F.collect_list(F.struct("replica", "seq"))).alias("vv"))
    return vv.select("holder", vectors.get_entry(F.col("vv"), "r3").alias("r3"), vectors.get_entry(F.col("vv"), "r99").alias("r99"))


def lattice_declared(spark, d):
    """A lattice declared by the user: three overlapping states, and a delta-mutator applied twice."""
    ev, span = _events(spark, d), lattice.lookup("span")
    top = ev.agg(F.max("event_id")).first()[0] or 0
    values = ev.select(F.col("event_type").alias("key"), F.col("event_id").alias("at"), F.col("k").alias("value"), "replica")
    first, delta = span.apply("observe", span.zero(spark), values.where(F.col("at") <= int(top * 0.5)))
    second, _ = span.apply("observe", first, values.where(F.col("at") > int(top * 0.3)))
    return span.apply_all(span.join(second, first), [delta, delta]).select("key", "least", "most", F.array_join("seen", ",").alias("seen"))


def lattice_order(spark, d):
    ev, span = _events(spark, d), lattice.lookup("span")
    values = ev.select(F.col("event_type").alias("key"), F.col("k").alias("value"), "replica")
    low, all_ = span.apply("observe", span.zero(spark), values.where("value < 50"))[0], span.apply("observe", span.zero(spark), values)[0]
    return span.leq(low, all_).withColumn("which", F.lit("low in all")).unionByName(span.leq(all_, low).withColumn("which", F.lit("all in low")))


# --- presence ---------------------------------------------------------------------------------------

_DAY = 86_400_000


def presence_doc_cursors(spark, d):
    ev, now = documents._presence(spark, d)
    return presence.cursors_in_document(ev, now, "u1", _DAY)


def presence_cursor_map(spark, d):
    return presence.cursor_map(documents._presence(spark, d)[0]).select("user_id", F.explode("cursors").alias("doc_id", "c")).select("user_id", "doc_id", "c.position", "c.anchor")


def presence_online_count(spark, d):
    ev, now = documents._presence(spark, d)
    return presence.online_count(presence.current(ev), now, _DAY)


def presence_after_leave(spark, d):
    """Users that are offline leave for good."""
    ev, now = documents._presence(spark, d)
    gone = presence.removals(presence.current(ev).where("status = 'Offline'"), now)
    return presence.current(ev.unionByName(gone)).select("user_id", "clock", "status")


# --- scalars ----------------------------------------------------------------------------------------


def scalar_mark_conflicts(spark, d):
    kinds = ["Bold", "Italic", "Underline", "Strikethrough", "Code", "Link", "Comment", "Highlight", "Custom"]
    pairs = spark.createDataFrame([(k,) for k in kinds], "kind string").withColumn("other", F.explode(F.lit(kinds)))
    return pairs.select("kind", "other", scalars.marks_conflict(F.col("kind"), F.col("other")).alias("conflict"))


def scalar_saturating_add(spark, d):
    ev = _events(spark, d)
    return ev.select("event_id", scalars.saturating_add(F.lit(scalars.BIGGEST) - F.col("event_id"), F.col("k")).alias("high"), scalars.saturating_add(F.col("event_id"), F.col("k")).alias("low"))


def scalar_names(spark, d):
    ev = _events(spark, d)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return ev.select("event_id", scalars.replica_name(F.col("ts_ms"), user).alias("name"), scalars.picked_color(user).alias("color"))


def scalar_selections(spark, d):
    ev = _events(spark, d)
    return ev.select("event_id", scalars.ordered_selection(F.col("k"), F.col("user_id") % 50).alias("s")).select("event_id", "s.start", "s.end", "s.cursor")


def scalar_inverse_format(spark, d):
    ev = _events(spark, d)
    kind = F.when(F.col("k") % 2 == 0, "add_mark").otherwise("remove_mark")
    return ev.select("event_id", scalars.inverse_format(kind, F.col("replica"), F.col("event_type")).alias("v")).select("event_id", "v.op_kind", "v.mark_id", "v.mark")


def scalar_inverse_json(spark, d):
    ev = _events(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("set", "delete", "array_insert", "array_remove"))), (F.col("k") % 4 + 1).cast("int"))
    old = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return ev.select("event_id", scalars.inverse_json(kind, F.lit("a.b"), F.col("k"), old, F.col("replica")).alias("v")).select("event_id", "v.op_kind", "v.index", "v.old", "v.new")


def path_children(spark, d):
    p = logs.table(spark, d, "pages").select("page_id", paths.parse(F.concat_ws(".", F.lit("a"), (F.col("page_id") % 5).cast("string"), F.lit("b"))).alias("path"))
    child = paths.child_index(paths.child_key(F.col("path"), F.lit("x")), F.col("page_id") % 7)
    return p.select("page_id", paths.render(child).alias("rendered"), paths.last(child)["idx"].alias("idx"), F.size(child).alias("n"))


# --- JSON fields and arrays -------------------------------------------------------------------------


def json_contains(spark, d):
    live = jsondoc.live_values(documents._json(spark, d))
    probes = live.select("doc_id").distinct().withColumn("key", F.explode(F.lit(["a1", "a4", "a9"])))
    return jsondoc.contains_key(live, probes)


def json_null_fields(spark, d):
    """Root fields with whether they are Null, after a1 is deleted everywhere: a deleted field is still contained."""
    log = documents._json(spark, d)
    live = jsondoc.live_values(log)
    fields = live.where("object_id = 'root' and key = 'a1'").select("doc_id", "object_id", "key").distinct().select("*", F.lit(10**12).cast("long").alias("seq"), F.lit("r9").alias("replica"))
    won = jsondoc.winners(jsondoc.live_values(jsondoc.join(log, jsondoc.delete(live, fields))))
    return won.where("object_id = 'root'").select("doc_id", "key", scalars.is_null_value(F.struct("kind")).alias("is_null"))


def _arrays(spark, d):
    """A list per customer: pushed, put to the front, put into the middle, taken out at 1."""
    docs = logs.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc_id"), F.col("c_custkey").cast("long").alias("n"))
    null = F.lit(None)
    value = lambda x: jsondoc.array_value(F.struct(F.lit("Int").alias("kind"), null.cast("boolean").alias("b"), x.cast("long").alias("i"), null.cast("double").alias("f"), null.cast("string").alias("s"), null.cast("string").alias("ref")))
    keyed = docs.select(jsondoc.array_key(F.col("doc_id"), F.lit("arr")).alias("doc_id"), "n")
    nodes = sequence.typed_nodes(keyed.limit(0), "doc_id", F.lit(""))
    for position, x in ((1 << 30, F.col("n")), (1 << 30, F.col("n") * 2), (0, F.col("n") * 3), (1, F.col("n") * 4)):
        shown = sequence.visible(nodes)
        edits = keyed.select("doc_id", F.lit(position).alias("position"), value(x).alias("value"))
        nodes = materialize(sequence.apply_ops(nodes, sequence.insert_values(shown, nodes, edits, "r0")), "array")
    gone = sequence.delete(sequence.visible(nodes), keyed.select("doc_id", F.lit(1).alias("start"), F.lit(1).alias("length")))
    return docs, sequence.apply_ops(nodes, gone)


def json_arrays(spark, d):
    docs, nodes = _arrays(spark, d)
    null = F.lit(None)
    won = docs.select("doc_id", F.lit(jsondoc.ROOT).alias("object_id"), F.lit("list").alias("key"), F.lit("Array").alias("kind"), null.cast("boolean").alias("b"), null.cast("long").alias("i"), null.cast("double").alias("f"), null.cast("string").alias("s"), F.lit("arr").alias("ref"))
    return jsondoc.to_json(won, jsondoc.array_items(sequence.visible(nodes)))


def json_array_lengths(spark, d):
    return jsondoc.array_lengths(_arrays(spark, d)[1])


def json_array_errors(spark, d):
    """Removals at positions of which some are beyond the end."""
    docs, nodes = _arrays(spark, d)
    edits = docs.select(jsondoc.array_key(F.col("doc_id"), F.lit("arr")).alias("doc_id"), (F.col("n") % 5).cast("int").alias("position"))
    return jsondoc.checked_index(sequence.visible(nodes), edits)


def text_clamped(spark, d):
    """Deletions that begin near or beyond the end of whole texts, held within them."""
    lines = documents._lines(spark, d)
    edits = runs.sizes(lines).select("doc_id", (F.col("size") - 3 + F.col("doc_id").cast("long") % 7).cast("int").alias("start"), F.lit(5).alias("length"))
    return sequence.clamped(runs.chars(lines), edits).select("doc_id", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))


# --- stability, snapshots, compaction ---------------------------------------------------------------


def stable_operations(spark, d):
    ev = _events(spark, d).select("replica", F.col("event_id").alias("seq"))
    return compaction.is_operation_stable(vectors.stable_frontier(graphs._frontiers(spark, d)), ev).groupBy("replica").agg(F.count(F.lit(1)).alias("n"))


def stability_checks(spark, d):
    vv = graphs._frontiers(spark, d)
    low = spark.createDataFrame([("r1", 1), ("r2", 0)], "replica string, seq long")
    return compaction.is_stable(vv, low).withColumn("which", F.lit("low")).unionByName(compaction.is_stable(vv, vectors.join(vv)).withColumn("which", F.lit("all")))


def frontier_without_peer(spark, d):
    vv = graphs._frontiers(spark, d)
    return vectors.stable_frontier(compaction.drop_peers(vv, spark.createDataFrame([("signup",), ("error",)], "peer string")))


def frontier_announced(spark, d):
    nodes = graphs._dag(spark, d)
    row = compaction.frontier_update(graphs._frontiers(spark, d), dag.heads(nodes), "click", 1000)
    return row.select("peer", "updated_at", F.size("heads").alias("heads"), F.explode("vv").alias("replica", "seq"))


def frontier_peers(spark, d):
    return compaction.peers(_events(spark, d).select(F.col("replica").alias("peer")))


def snapshot_best_covering(spark, d):
    wanted = spark.createDataFrame([("r3", 500)], "replica string, seq long")
    return compaction.best_covering(graphs._snapshots(spark, d), wanted).select("creator", "created_at", "total_ops")


def compaction_policy(spark, d):
    """What is due at each replica, by its numbers of operations, errors (as snapshots) and its age."""
    ev = _events(spark, d)
    n = ev.groupBy("replica").agg(F.count_if(F.col("event_type") == "error").alias("snapshots"), F.count(F.lit(1)).alias("ops"), (F.max("ts_ms") - F.min("ts_ms")).alias("age"), F.countDistinct("event_type").alias("peers"), F.countDistinct(F.when(F.col("k") < 10, F.col("event_type"))).alias("responding"))
    stable = F.col("ops") % 2 == 0
    return n.select(
        "replica", compaction.should_snapshot(F.col("snapshots"), F.col("ops"), F.col("age"), 40, 10**15).alias("snapshot"), compaction.should_compact(F.lit(True), F.col("ops"), F.col("snapshots"), stable, 20, 5).alias("compact"),
        compaction.has_quorum(F.col("peers"), F.col("responding")).alias("quorum_all"), compaction.has_quorum(F.col("peers"), F.col("responding"), all_peers=False).alias("quorum"),
    )


def _compactable(spark, d):
    """The DAG, no snapshots, and two holders that have all operations."""
    ev = _events(spark, d)
    whole = ev.groupBy("replica").agg(F.max("event_id").alias("seq")).where("seq > 0")
    frontiers = whole.withColumn("holder", F.explode(F.lit(["a", "b"]))).select("holder", "replica", "seq")
    now = ev.agg(F.max("ts_ms")).first()[0] or 0
    return materialize(graphs._dag(spark, d), "dag"), graphs._snapshots(spark, d).limit(0), frontiers, now


_POLICY = {"min_age": 5000, "max_nodes": 2**31 - 1, "preserve_depth": 2}


def compaction_pruned(spark, d):
    """What a compaction prunes whose snapshot all holders have."""
    nodes, snapshots, frontiers, now = _compactable(spark, d)
    return compaction.compact(nodes, snapshots, frontiers, "a", b"state", now, **_POLICY).pruned


def _result(spark, which, result):
    if result is None:
        return spark.createDataFrame([(which, False, 0, 0, 0)], "which string, created boolean, pruned long, kept long, snapshots long")
    return spark.createDataFrame([(which, result.snapshot_created is not None, result.nodes_pruned, result.nodes.count(), result.snapshots.count())], "which string, created boolean, pruned long, kept long, snapshots long")


def compaction_results(spark, d):
    """Compactions where all holders are up to date, where one is behind, and again when no snapshot is due."""
    nodes, snapshots, frontiers, now = _compactable(spark, d)
    behind = frontiers.withColumn("seq", F.when(F.col("holder") == "b", F.lit(1)).otherwise(F.col("seq")))
    first = compaction.compact(nodes, snapshots, frontiers, "a", b"state", now, **_POLICY)
    again = compaction.compact(nodes, first.snapshots, behind, "a", b"state", now + 1, **_POLICY)
    return sets.union_all(_result(spark, "stable", first), _result(spark, "behind", compaction.compact(nodes, snapshots, behind, "a", b"state", now, **_POLICY)), _result(spark, "again", again))


def compaction_ticks(spark, d):
    """Scheduled runs: nothing while a live peer is behind; once it is stale and dropped the latest snapshot is stable."""
    nodes, snapshots, frontiers, now = _compactable(spark, d)
    made = compaction.compact(nodes, snapshots, frontiers, "a", b"state", now, **_POLICY).snapshots
    behind = frontiers.withColumn("seq", F.when(F.col("holder") == "b", F.lit(1)).otherwise(F.col("seq")))
    updates = lambda at: spark.createDataFrame([("b", 1, at)], "peer string, arrival long, updated_at long")
    run = lambda at, t: compaction.tick(nodes, made, behind, updates(at), "a", b"state", t, compact_ops=1, min_snapshots=1, **_POLICY)
    return sets.union_all(_result(spark, "live", run(now, now + 1)), _result(spark, "stale", run(now - 10**6, now + 1)))


# --- DAG exchange -----------------------------------------------------------------------------------


def dag_seeded(spark, d):
    replicas = dag.seeded(spark, _REPLICAS, "r0")
    return replicas.join(F.broadcast(dag.n_replicas(replicas))).select("replica", "cid", "n")


def dag_put_unchecked(spark, d):
    n = graphs._hashed(spark, d)
    return dag.put_unchecked(n.where("timestamp % 3 = 0"), n).select("cid", "creator")


def dag_request(spark, d):
    n = graphs._dag(spark, d)
    have = spark.createDataFrame([("n000000010",), ("n000000020",)], "cid string")
    return dag.handle_request(n, dag.heads(n), have, 50).select("cid", "level", "sent")


def _halves(spark, d):
    """The hashed DAG of all users and of those with an even number."""
    ev = _events(spark, d)
    return graphs.hashed(ev.where("user_id % 2 = 0")), graphs.hashed(ev)


def dag_sync_pair(spark, d):
    """What one exchange brings to a replica that lacks half of the users."""
    here, peer = _halves(spark, d)
    return dag.sync_from(here, peer, None)[1].select("cid", "creator")


def dag_synced(spark, d):
    here, peer = _halves(spark, d)
    after, _ = dag.sync_from(here, peer, None)
    say = lambda n, which: dag.is_synced(n, dag.heads(peer)).withColumn("which", F.lit(which))
    return say(here, "before").unionByName(say(after, "after"))


def dag_sync_all(spark, d):
    """All replicas exchange the nodes they made."""
    n = graphs._dag(spark, d)
    full = dag.sync_all(n.withColumn("replica", F.col("creator")).select("replica", *n.columns))
    return full.groupBy("replica").agg(F.count(F.lit(1)).alias("n"), F.max("cid").alias("last"))


def dag_topological(spark, d):
    return dag.topological_order(graphs._dag(spark, d))


def dag_is_parent(spark, d):
    n = graphs._dag(spark, d)
    number = F.substring("cid", 2, 9).cast("long")
    pairs = n.select(F.col("cid").alias("child"), F.explode(F.array(_name("n", F.floor((number - 1) / 3)), _name("n", F.floor((number - 1) / 2)))).alias("parent")).distinct()
    return dag.is_parent(n, pairs)


def dag_node_facts(spark, d):
    n = graphs._dag(spark, d)
    return dag.n_parents(n).join(dag.payload_kinds(n), "cid")


_HALF = f"{EV}, top AS (SELECT floor(max(event_id) * 0.5)::BIGINT AS m FROM ev)"
_CLOSURE = graphs._CLOSURE
_COMPACT = f"""{_CLOSURE}, near AS (SELECT cid, 0 AS depth FROM heads UNION SELECT parent, depth + 1 FROM near JOIN edges ON child = cid WHERE depth < 2),
path AS (SELECT min(cid) AS cid FROM heads UNION ALL SELECT (SELECT max(parent) FROM edges WHERE child = path.cid) FROM path WHERE EXISTS (SELECT 1 FROM edges WHERE child = path.cid)),
gone AS (SELECT cid FROM nodes WHERE cid NOT IN (SELECT cid FROM near) AND cid NOT IN (FROM path) AND (SELECT max(ts_ms) FROM nodes) - ts_ms >= 5000)"""
_OPENS = f"WITH {EV}, l AS (SELECT 's' || (user_id % 100) AS session_id, 'doc' || (k % 20) AS doc_id, CASE WHEN event_type = 'error' THEN 'close' ELSE 'open' END AS kind, event_id AS arrival FROM ev)"
_CONN = f"WITH {EV}, conn AS (SELECT replica AS src, 'p' || (k % 10) AS dst FROM ev GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error')"
_MADE = "FROM (SELECT 'c' || c_custkey AS doc_id, c_custkey AS n FROM customer)"

QUERIES = {f.__name__: f for f in (
    docstore_created, docstore_ids, docstore_count, docstore_get, docstore_contains, docstore_join_values,
    durable_reload, durable_recovered, snapshot_export, mvreg_serialized, crdtmap_serialized, richtext_serialized, presence_serialized,
    mesh_fanout, channel_routing, acks_merged, buffers_cleared, intervals_pending, intervals_buffered, link_delivered, link_queue_heads, gossip_forwarded, peers_connected, hello_messages, hello_events, events_drained,
    relay_sessions, relay_first_opened, relay_document_changes, relay_open_documents, relay_sync_requests,
    lww_values, lww_timestamps, mvreg_dots_removed, crdtmap_contains, crdtmap_dots, crdtmap_put_dot, crdtmap_removed, gset_inserted, orset_added, counter_names, vv_entries_set, vv_entry_lookup, lattice_declared, lattice_order,
    presence_doc_cursors, presence_cursor_map, presence_online_count, presence_after_leave,
    scalar_mark_conflicts, scalar_saturating_add, scalar_names, scalar_selections, scalar_inverse_format, scalar_inverse_json, path_children,
    json_contains, json_null_fields, json_arrays, json_array_lengths, json_array_errors, text_clamped,
    stable_operations, stability_checks, frontier_without_peer, frontier_announced, frontier_peers, snapshot_best_covering, compaction_policy, compaction_pruned, compaction_results, compaction_ticks,
    dag_seeded, dag_put_unchecked, dag_request, dag_sync_pair, dag_synced, dag_sync_all, dag_topological, dag_is_parent, dag_node_facts,
)}

ORACLE_SQL = {
    "docstore_created": """SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0') AS doc_id, s_name AS title, 'Text' AS doc_type, 1000::BIGINT AS created_at FROM supplier
        UNION ALL SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0'), c_name, 'RichText', 1000 FROM customer UNION ALL SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0'), p_name, 'Json', 1000 FROM part""",
    "docstore_ids": f"{documents._STORE} SELECT doc_id FROM store",
    "docstore_count": f"{documents._STORE} SELECT count(*) AS n FROM store",
    "docstore_get": f"{documents._STORE} SELECT doc_id, title, doc_type FROM store WHERE doc_id = 'd000000007'",
    "docstore_contains": f"{documents._STORE} SELECT doc_id FROM q JOIN store USING (doc_id)",
    "docstore_join_values": f"""{documents._STORE}, s AS (SELECT *, substr(doc_id, 2)::INT AS n FROM store), a AS (SELECT doc_id, doc_type, modified_at FROM s WHERE n % 11 <> 0),
        b AS (SELECT doc_id, CASE WHEN n % 5 = 0 THEN 'Text' ELSE doc_type END AS doc_type, modified_at + 100 AS modified_at FROM s WHERE n % 7 <> 0)
        SELECT doc_id, coalesce(a.doc_type, b.doc_type) AS doc_type, CASE WHEN a.doc_type IS NULL OR a.doc_type = b.doc_type THEN b.modified_at ELSE a.modified_at END AS modified_at FROM a FULL JOIN b USING (doc_id)""",
    "durable_reload": f"WITH {_HALF} SELECT event_type AS counter, replica, count(*) FILTER (event_type <> 'error') AS inc, count(*) FILTER (event_type = 'error') AS dec FROM ev, top WHERE replica = 'r3' OR event_id <= m GROUP BY 1, 2",
    "durable_recovered": lattices.ORACLE_SQL["pncounter_value"],
    "snapshot_export": f"{documents._STORE} SELECT doc_id, title, created_at, 7 AS version FROM store",
    "mvreg_serialized": lattices.ORACLE_SQL["mvreg_json"],
    "crdtmap_serialized": f"{lattices._MAPS}, ctx AS (SELECT map_id, count(*)::INT AS dots FROM ops WHERE event_type <> 'error' GROUP BY 1) SELECT * FROM entries JOIN ctx USING (map_id)",
    "richtext_serialized": f"{documents._MARKS} SELECT doc_id, sha256(array_to_string(cs, '')) AS digest, (SELECT count(*) FROM m WHERE m.doc_id = t.doc_id)::INT AS marks FROM t WHERE len(cs) > 0",
    "presence_serialized": documents.ORACLE_SQL["presence_current"],
    "mesh_fanout": f"WITH {EV} SELECT 'r' || j AS dst, count(*) AS n FROM ev, range(8) t(j) WHERE replica <> 'r' || j GROUP BY 1",
    "channel_routing": f"WITH {EV}, m AS (SELECT replica AS src, 'r' || (k % 8) AS dst FROM ev) SELECT src, dst, CASE WHEN (src, dst) IN (('r1', 'r2'), ('r2', 'r1')) THEN 'ok' ELSE 'PeerNotFound' END AS outcome, count(*) AS n FROM m GROUP BY ALL",
    "acks_merged": f"WITH {EV} SELECT 'r' || i AS replica, 'p' || j AS peer, coalesce(max(event_id), 0) AS acked FROM range(8) a(i), range(3) b(j) LEFT JOIN ev ON replica = 'r' || i AND k % 5 = j AND event_type <> 'click' GROUP BY 1, 2",
    "buffers_cleared": f"WITH {EV}, p AS (SELECT 'r' || i AS replica, 'p' || j AS peer FROM range(8) a(i), range(3) b(j)) SELECT p.replica, peer, count(*) AS n FROM p JOIN ev USING (replica) WHERE (p.replica, peer) NOT IN (SELECT (replica, 'p' || (k % 5)) FROM ev WHERE event_type <> 'click' AND event_id % 97 = 0) GROUP BY 1, 2",
    "intervals_pending": f"{graphs._INT} SELECT 'p' AS to_replica, count(*) AS n FROM a WHERE NOT applied GROUP BY 1",
    "intervals_buffered": f"{graphs._INT} SELECT 'p' AS to_replica, from_replica, count(*) AS n FROM a WHERE NOT applied GROUP BY 1, 2",
    "link_delivered": f"{graphs._LINK} SELECT n, copy::INT AS copy, n * 4 + copy + CASE WHEN late THEN 10 ELSE 0 END AS deliver_at FROM (SELECT *, unnest(CASE WHEN dup THEN [0, 1] ELSE [0] END) AS copy FROM u) WHERE NOT lost",
    "link_queue_heads": f"""{graphs._LINK}, s AS (SELECT n, copy::INT AS copy, lost, n * 4 + copy + CASE WHEN late THEN 10 ELSE 0 END AS deliver_at FROM (SELECT *, unnest(CASE WHEN dup THEN [0, 1] ELSE [0] END) AS copy FROM u))
        SELECT replica, deliver_at, n, copy FROM s JOIN ev ON event_id = n WHERE NOT lost QUALIFY row_number() OVER (PARTITION BY replica ORDER BY deliver_at, n, copy) = 1""",
    "gossip_forwarded": f"WITH {EV} SELECT event_id, k % 4 - 1 AS ttl FROM ev WHERE k % 4 > 0",
    "peers_connected": f"{_CONN} SELECT src, string_agg(dst, ',' ORDER BY dst) AS peers FROM conn GROUP BY 1",
    "hello_messages": f"{_CONN} SELECT src, dst, 'Hello' AS kind FROM conn",
    "hello_events": f"WITH {EV} SELECT DISTINCT replica, 'Connected' AS event FROM ev",
    "events_drained": f"WITH {EV}, t AS (SELECT replica, max(event_id) // 2 AS upto FROM ev GROUP BY 1) SELECT replica, count(*) AS n, max(event_id) AS arrival FROM ev JOIN t USING (replica) WHERE event_id > upto GROUP BY 1",
    "relay_sessions": f"WITH {EV}, s AS (SELECT *, 's' || (user_id % 100) AS session_id FROM ev) SELECT session_id, arg_min(replica, event_id) AS peer_id, min(event_id) AS arrival FROM s GROUP BY 1 HAVING NOT bool_or(event_type = 'error' AND event_id % 7 = 0)",
    "relay_first_opened": f"{_OPENS} SELECT session_id, doc_id, min(arrival) AS arrival, 'DocumentOpened' AS event FROM l WHERE kind = 'open' GROUP BY 1, 2",
    "relay_document_changes": f"{_OPENS}, c AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY session_id, doc_id ORDER BY arrival), 'close') AS before FROM l) SELECT session_id, doc_id, arrival, CASE kind WHEN 'open' THEN 'DocumentOpened' ELSE 'DocumentClosed' END AS event FROM c WHERE kind <> before",
    "relay_open_documents": f"{_OPENS} SELECT session_id, doc_id FROM l GROUP BY 1, 2 HAVING arg_max(kind, arrival) = 'open'",
    "relay_sync_requests": f"{documents._ROOM} SELECT conv_id * 1000 + 10 AS arrival, 'room' || conv_id AS doc_id, 'u' || (conv_id % 4) AS sender, CASE WHEN conv_id % 4 = 0 THEN 'u1' ELSE 'u0' END AS receiver FROM rooms",
    "lww_values": f"SELECT key, value FROM ({lattices.ORACLE_SQL['lww_current']})",
    "lww_timestamps": f"SELECT key, ts_ms FROM ({lattices.ORACLE_SQL['lww_current']})",
    "mvreg_dots_removed": f"{lattices._MV} SELECT key, replica, seq, value FROM mv WHERE seq % 2 <> 0",
    "crdtmap_contains": f"{lattices._MAPS} SELECT DISTINCT map_id, key FROM ops WHERE event_type = 'error' AND (map_id, key) IN (SELECT (map_id, key) FROM entries)",
    "crdtmap_dots": f"{lattices._MAPS} SELECT map_id, replica, seq FROM ops WHERE event_type <> 'error' AND seq % 3 = 0",
    "crdtmap_put_dot": f"{lattices._MAPS} SELECT * FROM entries UNION ALL SELECT 'm0', n_name, 'r9', n_nationkey, 'Int', n_regionkey, NULL FROM nation",
    "crdtmap_removed": f"{lattices._MAPS} SELECT * FROM entries WHERE (map_id, key) NOT IN (SELECT (map_id, key) FROM entries WHERE map_id = 'm7' OR v_kind = 'Text')",
    "gset_inserted": f"WITH {EV} SELECT DISTINCT k::VARCHAR AS element FROM ev UNION SELECT unnest(['new', 'newer'])",
    "orset_added": f"{lattices._LIVE} SELECT DISTINCT set_id, element FROM live UNION SELECT 'click', n_name FROM nation",
    "counter_names": "SELECT DISTINCT event_type AS counter FROM events",
    "vv_entries_set": f"{lattices._VV} SELECT replica, seq FROM vv WHERE holder = 'click' AND replica <> 'r0' UNION ALL VALUES ('r0', 5), ('r9', 7)",
    "vv_entry_lookup": f"{lattices._VV} SELECT holder, coalesce(max(seq) FILTER (replica = 'r3'), 0) AS r3, 0::BIGINT AS r99 FROM vv GROUP BY 1",
    "lattice_declared": f"WITH {EV} SELECT event_type AS key, min(k) AS least, max(k) AS most, array_to_string(list_sort(list(DISTINCT replica)), ',') AS seen FROM ev GROUP BY 1",
    "lattice_order": f"WITH {EV} SELECT true AS leq, 'low in all' AS which UNION ALL SELECT bool_and(k < 50), 'all in low' FROM ev",
    "presence_doc_cursors": f"""{documents._PRES} SELECT user_id, doc_id, position, anchor FROM p WHERE user_id <> 'u1' AND user_id IN (SELECT user_id FROM cur, now WHERE t - ts_ms <= {_DAY} AND status <> 'Offline')
        QUALIFY row_number() OVER (PARTITION BY user_id, doc_id ORDER BY clock DESC) = 1""",
    "presence_cursor_map": documents.ORACLE_SQL["presence_cursors"],
    "presence_online_count": f"{documents._PRES} SELECT count(*) AS n FROM cur, now WHERE t - ts_ms <= {_DAY} AND status <> 'Offline'",
    "presence_after_leave": f"{documents._PRES} SELECT user_id, clock, status FROM cur WHERE status <> 'Offline'",
    "scalar_mark_conflicts": "WITH k AS (SELECT unnest(['Bold', 'Italic', 'Underline', 'Strikethrough', 'Code', 'Link', 'Comment', 'Highlight', 'Custom']) AS kind) SELECT a.kind, b.kind AS other, a.kind = b.kind AND a.kind NOT IN ('Comment', 'Highlight', 'Custom') AS conflict FROM k a, k b",
    "scalar_saturating_add": f"WITH {EV} SELECT event_id, least((9223372036854775807 - event_id)::HUGEINT + k, 9223372036854775807)::BIGINT AS high, event_id + k AS low FROM ev",
    "scalar_names": f"""WITH {EV}, u AS (SELECT event_id, ts_ms, substr(sha256('u' || user_id), 1, 8) AS h FROM ev)
        SELECT event_id, ts_ms || '-' || h AS name, {list(scalars.USER_COLORS)}[1 + ('0x' || h)::BIGINT % 16] AS color FROM u""",
    "scalar_selections": f'WITH {EV} SELECT event_id, least(k, user_id % 50) AS start, greatest(k, user_id % 50) AS "end", greatest(k, user_id % 50) AS cursor FROM ev',
    "scalar_inverse_format": f"WITH {EV} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'remove_mark' ELSE 'add_mark' END AS op_kind, replica AS mark_id, event_type AS mark FROM ev",
    "scalar_inverse_json": f"""WITH {EV} SELECT event_id, CASE k % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'set' ELSE 'delete' END WHEN 1 THEN 'set' WHEN 2 THEN 'array_remove' ELSE 'array_insert' END AS op_kind, k AS "index",
        replica AS old, CASE WHEN event_id % 3 = 0 THEN event_type END AS "new" FROM ev""",
    "path_children": "SELECT page_id, 'a.' || (page_id % 5) || '.b.x.' || (page_id % 7) AS rendered, (page_id % 7)::INT AS idx, 5 AS n FROM pages",
    "json_contains": f"{documents._JSON} SELECT DISTINCT doc_id, a AS key FROM w WHERE a IN ('a1', 'a4')",
    "json_null_fields": f"{documents._JSON} SELECT DISTINCT doc_id, a AS key, a = 'a1' AS is_null FROM w",
    "json_arrays": f"SELECT doc_id, '{{\"list\":[' || n * 3 || ',' || n || ',' || n * 2 || ']}}' AS json {_MADE}",
    "json_array_lengths": f"SELECT doc_id || '#arr' AS doc_id, 3::BIGINT AS n {_MADE}",
    "json_array_errors": f"SELECT doc_id || '#arr' AS doc_id, (n % 5)::INT AS position, CASE WHEN n % 5 >= 3 THEN 'IndexOutOfBounds' END AS error {_MADE}",
    "text_clamped": f"{documents._TEXT}, e AS (SELECT doc_id, len(cs) AS size, least(len(cs) - 3 + num % 7, len(cs)) AS s FROM t WHERE len(cs) > 0) SELECT doc_id, s::INT AS start, least(5, size - s)::INT AS length FROM e WHERE least(5, size - s) > 0",
    "stable_operations": f"{lattices._VV}, st AS (SELECT replica, min(seq) AS seq FROM vv GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT holder) FROM vv) AND min(seq) > 0) SELECT replica, count(*) AS n FROM ev JOIN st USING (replica) WHERE event_id <= seq GROUP BY 1",
    "stability_checks": f"""{lattices._VV}, st AS (SELECT replica, min(seq) AS seq FROM vv GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT holder) FROM vv)), a AS (SELECT replica, max(seq) AS want FROM vv GROUP BY 1)
        SELECT EXISTS (SELECT 1 FROM st WHERE replica = 'r1' AND seq >= 1) AS stable, 'low' AS which UNION ALL SELECT count(*) FILTER (want > coalesce(seq, 0)) = 0, 'all' FROM a LEFT JOIN st USING (replica)""",
    "frontier_without_peer": f"{lattices._VV}, v AS (SELECT * FROM vv WHERE holder NOT IN ('signup', 'error')) SELECT replica, min(seq) AS seq FROM v GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT holder) FROM v) AND min(seq) > 0",
    "frontier_announced": f"{_CLOSURE} SELECT 'click' AS peer, 1000::BIGINT AS updated_at, (SELECT count(*) FROM heads)::INT AS heads, replica, max(event_id) AS seq FROM ev WHERE event_type = 'click' GROUP BY replica",
    "frontier_peers": f"WITH {EV} SELECT DISTINCT replica AS peer FROM ev",
    "snapshot_best_covering": f"{graphs._SNAP} SELECT creator, created_at, event_id AS total_ops FROM s WHERE creator = 'r3' AND event_id >= 500 ORDER BY event_id DESC LIMIT 1",
    "compaction_policy": f"""WITH {EV}, n AS (SELECT replica, count(*) FILTER (event_type = 'error') AS snapshots, count(*) AS ops, max(ts_ms) - min(ts_ms) AS age, count(DISTINCT event_type) AS peers, count(DISTINCT event_type) FILTER (k < 10) AS responding FROM ev GROUP BY 1)
        SELECT replica, snapshots = 0 OR ops >= 40 OR age >= 1000000000000000 AS "snapshot", ops >= 20 AND snapshots >= 5 AND ops % 2 = 0 AS compact, peers + 1 >= 1 AND responding + 1 >= peers + 1 AS quorum_all, responding + 1 >= ceil((peers + 1) * 0.67) AS quorum FROM n""",
    "compaction_pruned": f"{_COMPACT} SELECT cid FROM gone",
    "compaction_results": f"""{_COMPACT}, g AS (SELECT count(*) AS n FROM gone), a AS (SELECT count(*) AS n FROM nodes)
        SELECT 'stable' AS which, true AS created, g.n AS pruned, a.n - g.n AS kept, 1::BIGINT AS snapshots FROM g, a UNION ALL SELECT 'behind', true, 0, a.n, 1 FROM a UNION ALL SELECT 'again', false, 0, a.n, 1 FROM a""",
    "compaction_ticks": f"""{_COMPACT}, g AS (SELECT count(*) AS n FROM gone), a AS (SELECT count(*) AS n FROM nodes)
        SELECT 'live' AS which, false AS created, 0::BIGINT AS pruned, 0::BIGINT AS kept, 0::BIGINT AS snapshots UNION ALL SELECT 'stale', false, g.n, a.n - g.n, 1 FROM g, a""",
    "dag_seeded": f"SELECT 'r' || i AS replica, sha256({le8('0')} || unhex('00') || {le8('0')} || encode('r0')) AS cid, 8::BIGINT AS n FROM range(8) t(i)",
    "dag_put_unchecked": f"{graphs._HASH} SELECT cid, replica AS creator FROM k WHERE ts_ms % 3 <> 0",
    "dag_request": f"""{_CLOSURE}, known AS (SELECT unnest(['n000000010', 'n000000020']) AS cid UNION SELECT parent FROM known JOIN edges ON child = cid), l AS (SELECT cid, 1 AS level FROM nodes UNION SELECT child, level + 1 FROM l JOIN edges ON parent = cid),
        lv AS (SELECT cid, max(level) AS level FROM l GROUP BY 1), o AS (SELECT cid, level FROM lv WHERE cid NOT IN (FROM known) OR cid IN (FROM heads)) SELECT cid, level, row_number() OVER (ORDER BY level, cid) <= 50 AS sent FROM o""",
    "dag_sync_pair": f"{graphs._HASH} SELECT cid, creator FROM r WHERE user_id % 2 <> 0 UNION ALL SELECT cid, replica FROM k WHERE user_id % 2 <> 0",
    "dag_synced": f"WITH {EV} SELECT count(*) FILTER (user_id % 2 <> 0) = 0 AS synced, 'before' AS which FROM ev UNION ALL SELECT true, 'after'",
    "dag_sync_all": f"WITH {EV}, {NODES} SELECT r.replica, count(*) AS n, max(cid) AS last FROM nodes, (SELECT DISTINCT replica FROM ev) r GROUP BY 1",
    "dag_topological": graphs.ORACLE_SQL["dag_levels"],
    "dag_is_parent": f"""WITH {EV}, {NODES}, p AS (SELECT DISTINCT cid AS child, 'n' || lpad(unnest([floor((event_id - 1) / 3)::BIGINT, floor((event_id - 1) / 2)::BIGINT])::VARCHAR, 9, '0') AS parent FROM nodes)
        SELECT p.child, p.parent, e.child IS NOT NULL AS direct FROM p LEFT JOIN edges e ON e.child = p.child AND e.parent = p.parent""",
    "dag_node_facts": f"WITH {EV}, {NODES} SELECT cid, (SELECT count(*) FROM edges WHERE child = cid)::INT AS n, event_id = 0 AS is_genesis, event_id > 0 AS is_delta, false AS is_snapshot FROM nodes",
}
