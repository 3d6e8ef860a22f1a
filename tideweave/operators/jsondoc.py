"""JSON documents as a log of field writes over objects, and arrays as sequences.

Fields: doc_id, object_id, key, value_id STRUCT<seq, replica>, kind, b, i, f, s, ref. A value that any
write lists in ``deletes`` is gone; of the rest the greatest value_id wins. Containers made on the
way to a path are named by a hash of (parent, key, kind), so replicas that make the same path
concurrently make the same container.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all

ROOT = "root"
VALUE = ["kind", "b", "i", "f", "s", "ref"]


def container_id(parent: Column, key: Column, kind: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", parent, key, F.lit(kind)), 256), 1, 26)


def live_values(ops: DataFrame) -> DataFrame:
    """Field values that no write deletes."""
    gone = ops.where(F.size("deletes") > 0).select("doc_id", F.explode("deletes").alias("value_id")).distinct()
    rows = ops.select("doc_id", "object_id", "key", "value_id", *VALUE).dropDuplicates(["doc_id", "object_id", "key", "value_id"])
    return rows.join(gone, ["doc_id", "value_id"], "left_anti")


def join(*logs: DataFrame) -> DataFrame:
    """Logs of replicas are joined by union; equal writes are one."""
    return union_all(*logs).dropDuplicates(["doc_id", "object_id", "key", "value_id"])


def winners(live: DataFrame) -> DataFrame:
    """The winning value of each field: the greatest (seq, replica)."""
    best = live.groupBy("doc_id", "object_id", "key").agg(F.max_by(F.struct(*VALUE), F.col("value_id")).alias("w"), F.count(F.lit(1)).alias("n_values"))
    return best.select("doc_id", "object_id", "key", "w.*", "n_values")


def concurrent(live: DataFrame) -> DataFrame:
    return live.groupBy("doc_id", "object_id", "key").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def field_deleted(live: DataFrame) -> DataFrame:
    """doc_id, object_id, key, deleted: whether all its values are Null."""
    return live.groupBy("doc_id", "object_id", "key").agg(F.bool_and(F.col("kind") == "Null").alias("deleted"))


def keys(live: DataFrame) -> DataFrame:
    """Root keys with a value that is not Null."""
    return field_deleted(live.where(F.col("object_id") == ROOT)).where("not deleted").select("doc_id", "key").orderBy("doc_id", "key")


def contains_key(live: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (doc_id, key) whose root field has any value, Null included."""
    return probes.join(live.where(F.col("object_id") == ROOT), ["doc_id", "key"], "left_semi")


def get(won: DataFrame, probes: DataFrame, depth: int) -> DataFrame:
    """Values at paths of object keys: probes are doc_id, path (array of segments); one equi join per level up to depth."""
    at = probes.withColumns({"_object": F.lit(ROOT), "_done": F.lit(False)})
    field = won.select(F.col("doc_id").alias("_doc"), F.col("object_id").alias("_object"), F.col("key").alias("_key"), F.struct(*VALUE).alias("_value"))
    at = at.withColumn("value", F.lit(None).cast(field.schema["_value"].dataType))
    for level in range(1, depth + 1):
        key = F.try_element_at("path", F.lit(level))["key"]
        step = at.withColumn("_key", key).withColumnRenamed("doc_id", "_doc").join(field, ["_doc", "_object", "_key"], "left").withColumnRenamed("_doc", "doc_id")
        last = F.size("path") == level
        at = step.select(*probes.columns, F.when(F.col("_value.kind") == "Object", F.col("_value.ref")).alias("_object"), F.when(last, F.col("_value")).otherwise(F.col("value")).alias("value"), "_done")
    return at.select(*probes.columns, "value").where("value is not null")


def set_path(writes: DataFrame) -> DataFrame:
    """json_ops rows that set object paths: writes are doc_id, path (array of keys), seq, replica, kind, b, i, f, s, ref.

    Missing objects on the way are written as well, under the write's own id; writing one twice changes nothing.
    """
    ids = F.aggregate(
        F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))),
        F.array(F.lit(ROOT)),
        lambda a, k: F.array_append(a, container_id(F.element_at(a, -1), k, "Object")),
    )
    w = writes.where(F.size("path") > 0).withColumn("_ids", ids)
    vid = F.struct(F.col("seq").cast("long").alias("seq"), F.col("replica").alias("replica")).alias("value_id")
    none = F.array().cast("array<struct<seq: bigint, replica: string>>").alias("deletes")
    own = w.select("doc_id", F.element_at("_ids", -1).alias("object_id"), F.element_at("path", -1).alias("key"), vid, *VALUE, none)
    on_way = w.where(F.size("path") > 1).select("doc_id", "seq", "replica", "path", "_ids", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_n"))
    null = F.lit(None)
    made = on_way.select(
        "doc_id", F.element_at("_ids", F.col("_n")).alias("object_id"), F.element_at("path", F.col("_n")).alias("key"), vid,
        F.lit("Object").alias("kind"), null.cast("boolean").alias("b"), null.cast("long").alias("i"), null.cast("double").alias("f"), null.cast("string").alias("s"), F.element_at("_ids", F.col("_n") + 1).alias("ref"), none,
    )
    return own.unionByName(made)


def delete(live: DataFrame, fields: DataFrame) -> DataFrame:
    """json_ops rows that delete fields (doc_id, object_id, key, seq, replica): all live values go and a Null is written."""
    seen = live.join(fields, ["doc_id", "object_id", "key"]).groupBy("doc_id", "object_id", "key", "seq", "replica").agg(F.array_sort(F.collect_list("value_id")).alias("deletes"))
    null = F.lit(None)
    return seen.select("doc_id", "object_id", "key", F.struct("seq", "replica").alias("value_id"), F.lit("Null").alias("kind"), null.cast("boolean").alias("b"), null.cast("long").alias("i"), null.cast("double").alias("f"), null.cast("string").alias("s"), null.cast("string").alias("ref"), "deletes")


def to_json(won: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """doc_id, json: documents put together from winners, keys sorted, Null fields left out, non-finite floats null.

    items: visible array elements (doc_id, array_id, position, kind, b, i, f, s, ref).
    """
    rows = won.select("doc_id", F.col("object_id").alias("owner"), "key", F.lit(None).cast("int").alias("position"), *VALUE)
    if items is not None:
        rows = rows.unionByName(items.select("doc_id", F.col("array_id").alias("owner"), F.lit(None).cast("string").alias("key"), F.col("position").cast("int").alias("position"), *VALUE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, objects, arrays = None, {}, {}
        for b in batches:
            done: list[tuple[str, str]] = []
            for doc, owner, key, position, *value in zip(*(b.column(c).to_pylist() for c in ("doc_id", "owner", "key", "position", *VALUE))):
                if doc != name:
                    if name is not None:
                        done.append((name, _assembled(objects, arrays)))
                    name, objects, arrays = doc, {}, {}
                if key is None:
                    arrays.setdefault(owner, []).append((position, value))
                else:
                    objects.setdefault(owner, {})[key] = value
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["doc_id", "json"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_assembled(objects, arrays)])], ["doc_id", "json"])

    return rows.where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id string, json string")


def _assembled(objects: dict[str, dict], arrays: dict[str, list]) -> str:
    """One document as JSON. A container inside itself is null or empty."""

    def value(v: list, path: frozenset):
        kind, b, i, f, s, ref = v
        if kind == "Object":
            return None if ref in path else obj(ref, path | {ref})
        if kind == "Array":
            return [] if ref in path else [value(x, path | {ref}) for _, x in sorted(arrays.get(ref, []), key=lambda p: p[0])]
        if kind == "Float":
            return f if f is not None and math.isfinite(f) else None
        return {"Bool": b, "Int": i, "String": s}.get(kind)

    def obj(name: str, path: frozenset) -> dict:
        return {k: value(v, path) for k, v in sorted(objects.get(name, {}).items()) if v[0] != "Null"}

    return json.dumps(obj(ROOT, frozenset((ROOT,))), ensure_ascii=False, separators=(",", ":"))


def array_key(doc_id: Column, array_id: Column) -> Column:
    """The name under which an array is a sequence of its own."""
    return F.concat_ws("#", doc_id, array_id)


def array_value(value: Column) -> Column:
    """A tagged value (kind, b, i, f, s, ref) as the text that a sequence element holds."""
    return F.to_json(value)


def array_items(shown: DataFrame) -> DataFrame:
    """Items for to_json from the visible elements of array sequences; insert, push and remove are sequence edits."""
    shape = "kind string, b boolean, i bigint, f double, s string, ref string"
    parts = F.split("doc_id", "#")
    return shown.select(parts[0].alias("doc_id"), parts[1].alias("array_id"), "position", F.from_json("value", shape).alias("v")).select("doc_id", "array_id", "position", "v.*")


def array_lengths(nodes: DataFrame) -> DataFrame:
    """doc_id (as array_key names it), n."""
    return nodes.groupBy("doc_id").agg(F.count_if(~F.col("deleted")).alias("n"))


def checked_index(shown: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of array elements (doc_id as array_key names it, position) with ``error``: IndexOutOfBounds or null."""
    size = shown.groupBy("doc_id").agg((F.max("position") + 1).alias("_size"))
    out = (F.col("position") < 0) | (F.col("position") >= F.coalesce("_size", F.lit(0)))
    return edits.join(size, "doc_id", "left").withColumn("error", F.when(out, "IndexOutOfBounds")).drop("_size")


def counter_totals(won: DataFrame) -> DataFrame:
    """Counters kept in documents as root.counters.<name>.<replica>.{inc, dec}: doc_id, counter, replica, inc, dec."""
    ref = lambda df, owner, name: df.where("kind = 'Object'").select("doc_id", F.col("object_id").alias(owner), F.col("key").alias(name), "ref")
    top = won.where((F.col("object_id") == ROOT) & (F.col("key") == "counters") & (F.col("kind") == "Object")).select("doc_id", F.col("ref").alias("o1"))
    named = top.join(ref(won, "o1", "counter").withColumnRenamed("ref", "o2"), ["doc_id", "o1"])
    each = named.join(ref(won, "o2", "replica").withColumnRenamed("ref", "o3"), ["doc_id", "o2"])
    leaf = won.where("kind = 'Int'").select("doc_id", F.col("object_id").alias("o3"), "key", "i")
    amount = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("i"))), F.lit(0))
    return each.join(leaf, ["doc_id", "o3"]).groupBy("doc_id", "counter", "replica").agg(amount("inc").alias("inc"), amount("dec").alias("dec"))
