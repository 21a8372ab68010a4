"""Contiguous shards of near equal bytes: global prefix sums of sizes, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running

SHARDS = 24
OVERHEAD = 8  #: bytes that a row counts besides its text


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of `docs`.

    Rows stand in the order of doc_id (nulls first; ties by text checksum and size, then as read). A row belongs to the
    shard in whose equal share of all bytes its middle lies, so shards are contiguous and differ by about one row; empty
    shards come only with fewer rows than shards. A null text has size 8 and the checksum of no bytes. Slots count from 0
    in each shard. grown_shard is null, as the law is `bytes`.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed, _, volume = running(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "size")
    middle = "cast(2 * size_before + size as decimal(28,0))"  # twice the place of the row's middle
    shard = F.least(F.lit(shards - 1), F.expr(f"cast({shards} * {middle} div {2 * max(1, volume)} as int)"))
    placed = placed.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("row_before").alias("_start"))  # a row for each shard, `shards` at most
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_before") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
