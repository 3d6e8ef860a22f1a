"""Running totals per key without one task per key.

Rows are range-partitioned by key and order, so that a key with many rows covers many partitions.
Each partition adds up its own rows as they stream by; the totals of the partitions before, a row per
partition and key, are added afterwards. Rows equal in key and order share a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.sources.shared import materialize

_FOLD = {"sum": (np.cumsum, F.sum), "max": (np.maximum.accumulate, F.max)}
_LEAST = np.iinfo(np.int64).min


def running(df: DataFrame, keys: list[str], order: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """df with a column per name: the "sum" or "max" of a BIGINT column over the key's rows up to this one.

    "sum before" and "max before" leave this row out (0, or null at the key's first row). Null values add nothing; keys are not null.
    """
    fresh = {n: f"_{n}" for n in columns}
    kinds = {n: kind.split()[0] for n, (kind, _) in columns.items()}
    names = list(columns)
    before = {n for n, (kind, _) in columns.items() if kind.endswith("before")}
    rows = df.withColumns({fresh[n]: c.cast("long") for n, (_, c) in columns.items()})
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, {}
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                column = b.column(b.schema.get_field_index(k))
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            first = [b.column(b.schema.get_field_index(k))[0].as_py() for k in keys]
            new[0] = first != last
            starts = np.unique(np.append(0, np.flatnonzero(new)))
            out = []
            for n, kind in kinds.items():
                empty = 0 if kind == "sum" else _LEAST
                value = pc.fill_null(b.column(b.schema.get_field_index(fresh[n])), empty).to_numpy(zero_copy_only=False)
                total = np.empty(b.num_rows, np.int64)
                earlier = np.empty(b.num_rows, np.int64)
                for s, e in zip(starts, [*starts[1:], b.num_rows]):
                    carry = empty if new[s] else held.get(n, empty)
                    total[s:e] = _FOLD[kind][0](np.append(carry, value[s:e]))[1:]
                    earlier[s], earlier[s + 1 : e] = carry, total[s : e - 1]
                held[n] = total[-1]
                shown = earlier if n in before else total
                out.append(pa.array(shown, pa.int64(), mask=(shown == _LEAST) if kind == "max" else None))
            last = [b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(b.num_rows, part, np.int32))], [*b.schema.names, *names, "_part"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in columns), T.StructField("_part", T.IntegerType())])
    placed = materialize(rows.mapInArrow(run, schema), "running")
    ends = placed.groupBy(*keys, "_part").agg(*[_FOLD[kinds[n]][1](fresh[n]).alias(f"_end_{n}") for n in columns])
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*keys, "_part", *[_FOLD[kinds[n]][1](f"_end_{n}").over(above).alias(f"_off_{n}") for n in columns])
    both = placed.join(offsets, [*keys, "_part"], "left")
    whole = {n: F.coalesce(f"_off_{n}", F.lit(0)) + F.col(n) if kinds[n] == "sum" else F.greatest(f"_off_{n}", n) for n in columns}
    return both.withColumns(whole).select(*df.columns, *columns)
