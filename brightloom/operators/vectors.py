"""Nearest vectors: a stated set of queries against all rows, a block of queries at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable

BLOCK = 4096  #: queries that are held against the rows at once, a few MB


def in_blocks(rows: DataFrame, key: str, block: int) -> Iterator:
    """`rows`, dealt by a hash of their key into blocks of about `block`, one broadcast after the other.

    A block is gathered when it is asked for and released when the next one is, so the driver and the tasks hold one
    whatever the number of rows. What a block is used for must be worked out before the next is taken. Keys should tell rows apart.
    """
    spark = rows.sparkSession
    blocks = -(-rows.count() // block)
    shared = None
    try:
        for b in range(blocks):
            own = rows.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()  # about `block` rows
            if shared is not None:
                shared.unpersist()
            shared = spark.sparkContext.broadcast(own)
            if own.num_rows:
                yield shared
    finally:
        if shared is not None:
            shared.unpersist()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """q, vec_id, cosine: for each query (vec_id, v) the `k` rows (vec_id, v) of largest inner product, itself left out; ties by vec_id.

    A task keeps the best `k` of each query of the block as it goes, so what is shuffled is k rows a query and task.
    Each block of queries is a pass over the rows, whose answers are written before the next block is taken.
    """
    spark = vectors.sparkSession
    schema = "q long, vec_id long, cosine double"
    own = Window.partitionBy("q").orderBy(F.desc("cosine"), "vec_id")
    parts = []
    for shared in in_blocks(durable(queries.select("vec_id", "v")), "vec_id", block):
        found = vectors.select("vec_id", "v").mapInArrow(best_of(shared, k), schema)
        parts.append(durable(found.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).drop("n")))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def best_of(shared, k: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, e = shared.value.column("vec_id").to_numpy(), matrix(shared.value.column("v"))
        ids, best = np.full((len(q), 0), 0), np.zeros((len(q), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                some = part.column("vec_id").to_numpy(zero_copy_only=False)
                cosine = np.round(e @ matrix(part.column("v")).T, 9) if len(some) else np.zeros((len(q), 0))
                cosine[q[:, None] == some[None, :]] = -np.inf
                ids, best = np.hstack([ids, np.broadcast_to(some, (len(q), len(some)))]), np.hstack([best, cosine])
                order = np.lexsort((ids, -best))[:, :k]
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], ids.shape)[real]), pa.array(ids[real]), pa.array(best[real])], ["q", "vec_id", "cosine"])

    return told
