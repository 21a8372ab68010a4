"""Running totals in a global or per-group order without one task for a group: ranges are summed apart and joined up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable


def running_before(rows: DataFrame, group: list[str], order: str, n: str, out: str = "before") -> DataFrame:
    """`rows` (one for each group and value of `order`) with the sum of `n` over the group's smaller values.

    Rows are dealt into ranges of group and value; a range's rows are summed in order, and the totals of the ranges, a
    row for each range and group, give what lies ahead of it. So a group of any size is spread over many tasks.
    """
    ranged = durable(rows.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_total"))
    ahead = F.sum("_total").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*group, "_part", F.coalesce(ahead, F.lit(0)).alias("_start"))
    own = ranged.withColumn("_own", F.coalesce(F.sum(n).over(within), F.lit(0)))
    told = own.join(starts, [*group, "_part"])
    return told.withColumn(out, F.col("_start") + F.col("_own")).drop("_start", "_own", "_part")


def at_places(counted: DataFrame, group: list[str], value: str, n: str, places: dict) -> DataFrame:
    """group, total and for each name the value at a place (from 0, a function of the total) of each group's sorted values.

    `counted` has a row for each group and value with its number of rows `n`.
    """
    totals = counted.groupBy(*group).agg(F.sum(n).alias("total"))
    told = running_before(counted, group, value, n).join(totals, group)
    at = lambda place: F.min(F.when(F.col("before") + F.col(n) > place(F.col("total")), F.col(value)))
    return told.groupBy(*group, "total").agg(*(at(p).alias(name) for name, p in places.items()))


def ranked(rows: DataFrame, orders: list[Column], out: str = "place") -> DataFrame:
    """`rows` with their place from 1 in a global order, ties as they come.

    Rows are dealt into ranges of the order and written; places are counted within each range, and the numbers of rows of
    the ranges ahead, one for each range, are added. No task orders more than its range.
    """
    columns = rows.columns
    ranged = durable(rows.repartitionByRange(*orders).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*orders))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("_part", F.coalesce(ahead, F.lit(0)).alias("_start"))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").select(*columns, (F.col("_start") + F.col("_own")).alias(out))
