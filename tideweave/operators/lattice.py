"""Lattices that a user declares: a key and an aggregate per column give join, order, mutators and streams.

A registered lattice has the empty relation as its bottom; its join is one union and one aggregate
per key, which is commutative, associative and idempotent if each column's aggregate is (max, min,
bool_or, bit_or, collect_set, a max of structs, ...). a <= b holds if joining a into b changes
nothing, so the order needs no code of its own. A delta-mutator makes, from a state and arguments,
the rows to join in; applying it returns the new state and that delta.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all

#: Lattices by name.
REGISTERED: dict[str, Lattice] = {}


@dataclass
class Lattice:
    """name; keys; columns: the aggregate of each value column; schema: DDL of all columns."""

    name: str
    schema: str
    keys: list[str]
    columns: dict[str, Callable[[str], Column]]
    mutators: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def zero(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def _joined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.columns.items()])

    def join(self, *states: DataFrame) -> DataFrame:
        return self._joined(union_all(*[s.select(*self.keys, *self.columns) for s in states]))

    def stream(self, rows: DataFrame) -> DataFrame:
        """The running join of a stream of states or deltas, for update or complete mode."""
        return self._joined(rows)

    def leq(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """One row: is a at most b?"""
        return self.join(a, b).subtract(self.join(b)).agg((F.count(F.lit(1)) == 0).alias("leq"))

    def mutator(self, make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """Registers a delta-mutator (state, arguments) -> delta under its name."""
        self.mutators[make.__name__] = make
        return make

    def apply(self, name: str, state: DataFrame, *args) -> tuple[DataFrame, DataFrame]:
        """(new state, delta) of a mutator."""
        delta = self.mutators[name](state, *args).select(*self.keys, *self.columns)
        return self.join(state, delta), delta

    def apply_all(self, state: DataFrame, deltas: list[DataFrame]) -> DataFrame:
        """A delta group is the join of its deltas."""
        return self.join(state, reduce(self.join, deltas)) if deltas else state


def register(lattice: Lattice) -> Lattice:
    REGISTERED[lattice.name] = lattice
    return lattice


def lookup(name: str) -> Lattice:
    return REGISTERED[name]


#: The interval of values seen per key, and which replicas have contributed: an example of a lattice declared in place.
SPAN = register(Lattice("span", "key string, least bigint, most bigint, seen array<string>", ["key"], {"least": F.min, "most": F.max, "seen": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))}))


@SPAN.mutator
def observe(state: DataFrame, values: DataFrame) -> DataFrame:
    """values: key, value, replica; values within the interval known give a delta that changes nothing."""
    return values.groupBy("key").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.array_sort(F.collect_set("replica")).alias("seen"))
