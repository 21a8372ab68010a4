"""Helpers that the corpus operators share: reading, durable cuts of the lineage, arrow batches, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_dir  # noqa: F401 (the corpus operators take them from here)


BATCH = 1000  #: rows of an Arrow batch, so that long texts don't fill a worker
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The session's Arrow batches are kept to BATCH rows from then on, if they were larger."""
    if not 0 < int(spark.conf.get(ROWS)) <= BATCH:
        spark.conf.set(ROWS, BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def row_key(text: Column) -> Column:
    """64 bits that tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores ahead as far as a column of `df` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
