"""A global order with running sums: ranges of the key are sorted apart, and per-partition totals join them up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable


def running(df: DataFrame, keys: list[Column], size: str) -> tuple[DataFrame, int, int]:
    """`df` in the order of `keys` with `row_before` and `size_before` (rows and sum of `size` ahead of each row), and both totals.

    Ties of all keys fall where the row number of the input puts them, so equal rows can be spread over ranges. The ranged
    and sorted rows are written once, because a second sort could draw other ranges. The driver sees two numbers for each
    partition, no rows.
    """
    columns = df.columns
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie"))
    numbered = durable(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    totals = sorted(tuple(r) for r in numbered.groupBy("_part").agg(F.count("*"), F.sum(size)).collect())
    rows = sum(t[1] for t in totals)
    volume = sum(t[2] for t in totals)
    before, n, s = {}, 0, 0
    for part, count, total in totals:
        before[part] = (n, s)
        n, s = n + count, s + total
    schema = T.StructType([*(numbered.schema[c] for c in columns), T.StructField("row_before", T.LongType()), T.StructField("size_before", T.LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[int, int]] = {}
        for batch in batches:
            parts = batch.column("_part").to_numpy(zero_copy_only=False)
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            row_before, size_before = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
            for part in np.unique(parts).tolist():
                mine = np.flatnonzero(parts == part)
                n, s = at.get(part) or before[part]
                ends = s + np.cumsum(sizes[mine])
                row_before[mine] = n + np.arange(len(mine))
                size_before[mine] = ends - sizes[mine]
                at[part] = (n + len(mine), int(ends[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(row_before), pa.array(size_before)], names=schema.names)

    # a written file of a partition may be split on reading, so its rows are brought together and put in order again
    parts = max(1, len(totals))
    together = numbered.repartition(parts, "_part").sortWithinPartitions("_part", "_at")
    return together.mapInArrow(summed, schema), rows, volume
