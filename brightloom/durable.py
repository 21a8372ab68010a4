"""Cuts of the lineage that survive lost executors: rows are written once to the shared folder and read again."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="brightloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_written: dict[int, tuple[weakref.ref, str]] = {}


def durable(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: the lineage ends there, and lost executors cost nothing.

    The files go with `discard`, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brightloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = weakref.ref(out, lambda _, k=id(out): _written.pop(k, None)), path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of `durable` frames that nothing will read again, because what was made of them is written; other frames stay."""
    for df in frames:
        known, path = _written.pop(id(df), (None, None))
        if known is not None and known() is df:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the session's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def state_of(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: their bytes, their number, and the latest change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told, status = files.getContentSummary(at), files.getFileStatus(at)
    times = [status.getModificationTime(), *(s.getModificationTime() for s in files.listStatus(at))]
    return f"{path} {told.getLength()} {told.getFileCount()} {max(times)}"


_kept: dict[tuple[str, str], tuple[str, StructType]] = {}


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, worked out once in a session for each `name` (all that decides it but the tables) and state of its input tables.

    The result is a table in the shared folder, named by the fingerprint of both, which every later call reads. A changed
    input file or name makes another one.
    """
    print_ = hashlib.sha256("\n".join([name, *(state_of(spark, p) for p in inputs)]).encode()).hexdigest()
    at = spark.sparkContext.applicationId, print_
    if at not in _kept:
        df = make()
        path = f"{shared_dir(spark)}/brightloom-kept-{print_[:32]}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        delete_at_end(spark, path)
        _kept[at] = path, df.schema
    path, schema = _kept[at]
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt evenly for steps whose work a row is much and whose bytes are few: by size alone, adaptive plans would give such
    rows to a handful of tasks. As many parts as the session's shuffles have, and four for each core at least."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def text_key(*columns: str) -> Column:
    """A digest that tells one combination of these columns from any other; nulls differ from blanks."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def distinct_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """Each combination of `columns` once, dealt evenly, with the _text of `rows` and copies, the number of its rows."""
    return spread(rows.groupBy("_text", *columns).agg(F.count("*").alias("copies")), "_text")


def of_each_text(rows: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` without `columns`, joined to what `work` finds in these: a text that many rows share is worked on once.

    `work` takes _text, `columns` and copies, and returns _text with any columns and any number of rows of each.
    """
    own = durable(rows.withColumn("_text", text_key(*columns)))
    return own.drop(*columns).join(work(distinct_texts(own, *columns)), "_text").drop("_text")
