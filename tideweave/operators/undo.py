"""Undo and redo histories: a stack machine per document over an undo_ops log.

Histories are sorted within partitions and folded as they stream by, many to a call and one row at a
time in each, so that a history of any length needs the memory of ``max_history`` operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HISTORY = 1000
EMITTED = "doc_id string, at long, op_kind string, position int, deleted string, inserted string, source_clock long, how string"
FIELDS = ["doc_id", "replica", "clock", "action", "group_id", "op_kind", "position", "deleted", "inserted"]
_OPPOSITE = {"insert": "delete", "delete": "insert"}


def _inverse(op: tuple) -> tuple:
    kind, position, deleted, inserted = op
    return _OPPOSITE.get(kind, kind), position, inserted, deleted


class History:
    """One document's history at one replica, with its stacks of clocks.

    A step back takes the newest undoable operation, and if that is of a group, all operations of the
    group in the history that are not undone, wherever they stand. It goes to the redo stack as one
    entry; redone, it comes back as one entry. Recording clears the redo stack. The history holds remote
    operations too, and forgets its oldest beyond max_history, on both stacks as well.
    """

    def __init__(self, max_history: int):
        self.max_history = max_history
        self.clear()

    def clear(self) -> None:
        self.ops: dict[int, tuple[str | None, tuple]] = {}
        self.undone: set[int] = set()
        self.groups: dict[str, list[int]] = {}
        self.undo: list[int] = []
        self.redo: list[int] = []

    def add(self, clock: int, group: str | None, op: tuple) -> None:
        self.ops[clock] = group, op
        if group is not None:
            self.groups.setdefault(group, []).append(clock)
        while len(self.ops) > self.max_history:
            old = next(iter(self.ops))
            group, _ = self.ops.pop(old)
            self.undone.discard(old)
            if group is not None:
                self.groups[group].remove(old)
            for stack in (self.undo, self.redo):
                if old in stack:
                    stack.remove(old)

    def step(self, action: str, clock: int, group: str | None, op: tuple) -> list[tuple]:
        """What the action emits: at, op_kind, position, deleted, inserted, source_clock, how."""
        if action in ("record", "remote"):
            if action == "record":
                self.undo.append(clock)
                self.redo.clear()
            self.add(clock, group, op)
        elif action == "undo" and self.undo:
            top = self.undo.pop()
            group = self.ops[top][0]
            members = [top] if group is None else [c for c in self.groups[group] if c not in self.undone]
            self.undone.update(members)
            if group is not None:
                self.undo = [c for c in self.undo if self.ops[c][0] != group]
            self.redo.append(top)
            return [(clock, *_inverse(self.ops[c][1]), c, "undo") for c in reversed(members)]
        elif action == "redo" and self.redo:
            top = self.redo.pop()
            group = self.ops[top][0]
            members = [top] if group is None else [c for c in self.groups[group] if c in self.undone]
            self.undone.difference_update(members)
            self.undo.append(top)
            return [(clock, *self.ops[c][1], c, "redo") for c in members]
        elif action == "clear":
            self.clear()
        return []


def _folded(ops: DataFrame, max_history: int, step: Callable, end: Callable, schema: str) -> DataFrame:
    """Rows that step gives for each action and end gives for each history; histories are (doc_id, replica), in order of clock."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, history = None, None
        for b in batches:
            out: list[tuple] = []
            for doc, replica, clock, action, group, *op in zip(*(b.column(c).to_pylist() for c in FIELDS)):
                if (doc, replica) != key:
                    if key is not None:
                        out += end(key, history)
                    key, history = (doc, replica), History(max_history)
                out += step(key, history.step(action, clock, group, tuple(op)))
            yield batch(out)
        if key is not None:
            yield batch(end(key, history))

    rows = ops.select(*FIELDS).repartition("doc_id", "replica").sortWithinPartitions("doc_id", "replica", "clock")
    return rows.mapInArrow(run, schema)


def replay(ops: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Operations that undo and redo emit: inverses newest first, reapplied ones oldest first; remote ones pass through."""
    return _folded(ops, max_history, lambda key, out: [(key[0], *r) for r in out], lambda key, history: [], EMITTED)


def stacks(ops: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """doc_id, replica, n_undo, n_redo after the log: what can be undone and redone."""
    return _folded(ops, max_history, lambda key, out: [], lambda key, history: [(*key, len(history.undo), len(history.redo))], "doc_id string, replica string, n_undo long, n_redo long")


def effective(ops: DataFrame, emitted: DataFrame) -> DataFrame:
    """All operations that reach the document, in order: recorded and remote ones, and what undo and redo emit."""
    own = ops.where("action in ('record', 'remote')").select("doc_id", F.col("clock").alias("at"), "op_kind", "position", "deleted", "inserted", F.col("clock").alias("source_clock"), F.col("action").alias("how"))
    return own.unionByName(emitted)


def with_clocks(ops: DataFrame) -> DataFrame:
    """Clocks for a log in arrival order: each operation is one later than all before it, remote ones counted."""
    w = Window.partitionBy("doc_id").orderBy("arrival")
    return ops.withColumn("clock", F.row_number().over(w).cast("long"))


def trimmed(ops: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """The last max_history recorded operations of each history."""
    w = Window.partitionBy("doc_id", "replica").orderBy(F.desc("clock"))
    return ops.where("action = 'record'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_history).drop("_r")
