"""What the lines of texts say by themselves, worked out once for each distinct line and brought back to the texts.

Lines recur far more than texts: headings, bullets and boilerplate stand in many. The most frequent lines go to all tasks
and are looked up in the row, so none of them is shuffled; only rarer lines are joined by equality, none of which is a
large part of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..durable import durable, spread

MOST_HOT_LINES = 20_000  #: lines that go to all tasks
MOST_HOT_LETTERS = 4 << 20  #: and their letters; what is told of a line is a few times its size
_tables: dict[str, pa.Table] = {}  # of a worker, by digest; outlives a task


def looked_up(lines: Column, known: pa.Table, kind: DataType) -> Column:
    """Beside an array of lines, what `known` (line, told) says of each, or null. Not for use within a lambda."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    blob = sink.getvalue().to_pybytes()
    name = hashlib.blake2b(blob, digest_size=16).hexdigest()

    @F.arrow_udf(ArrayType(kind))
    def found(rows: pa.Array) -> pa.Array:
        if name not in _tables:
            _tables.clear()
            _tables[name] = pa.ipc.open_stream(blob).read_all().combine_chunks()
        table = _tables[name]
        places = pc.index_in(rows.flatten(), value_set=table["line"])
        told = table["told"].take(places)
        told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
        sizes = pc.fill_null(pc.list_value_length(rows), 0)
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(ends, told)

    return found(lines)


def least_bar(counted: DataFrame, most: int, letters: int) -> int:
    """The least of 1, 2, 4 ... so that lines (line, n) with n beyond it are at most `most` and have at most so many letters."""
    top = counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bars = [1 << k for k in range(int(top).bit_length() + 1)]
    beyond = lambda b: F.col("n") > b
    sums = counted.agg(*(F.struct(F.count_if(beyond(b)).alias("n"), F.coalesce(F.sum(F.when(beyond(b), F.length("line"))), F.lit(0)).alias("letters")) for b in bars)).first()
    return next(b for b, s in zip(bars, sums, strict=True) if s["n"] <= most and s["letters"] <= letters)


def with_lines(texts: DataFrame, lines: Column, alone: Callable[[DataFrame], DataFrame], within: Callable[[DataFrame], DataFrame], most: int = MOST_HOT_LINES, letters: int = MOST_HOT_LETTERS) -> DataFrame:
    """`texts` (from the shared folder, with a unique _text) and `told`: what is told of each of `lines`, an array of strings without nulls.

    `alone` takes distinct lines (line) and adds told, and open where the rest of a text may change it. `within` takes the
    texts that have an open line and returns _text, pos (from 0) and told for the lines that it settles with the whole text.
    """
    pieces = texts.select("_text", F.posexplode(lines).alias("pos", "line"))
    counted = durable(spread(pieces.groupBy("line").agg(F.count("*").alias("n")), "line"))
    found = durable(alone(spread(counted, "line")).select("line", "n", "told", "open"))
    bar = least_bar(counted, most, letters)
    hot = found.where(F.col("n") > bar)  # at most `most`
    heads = hot.select("line", F.col("open").alias("_open"))
    rest = pieces.join(F.broadcast(heads), "line", "left").where("_open is null or _open")
    cold = durable(rest.where("_open is null").join(found.where(F.col("n") <= bar), "line").select("_text", "pos", "told", "open"))
    if not found.where("open").isEmpty():
        odd = durable(rest.where("_open").select("_text").unionByName(cold.where("open").select("_text")).distinct())
        settled = durable(within(texts.join(odd, "_text", "left_semi")).select("_text", "pos", "told", F.lit(False).alias("open")))
        cold = cold.join(settled.select("_text", "pos"), ["_text", "pos"], "left_anti").select("_text", "pos", "told", "open").unionByName(settled)
    own = spread(cold.select("_text", F.struct("pos", "told").alias("own")), "_text").groupBy("_text").agg(F.collect_list("own").alias("own"))
    kind = found.schema["told"].dataType
    both = spread(texts, "_text").join(own, "_text", "left").withColumn("_hot", looked_up(lines, hot.select("line", "told").toArrow().combine_chunks(), kind))
    mine = lambda i: F.get(F.filter("own", lambda c: c["pos"] == i), F.lit(0))["told"]
    told = F.when(F.col("own").isNull(), F.col("_hot")).otherwise(F.transform("_hot", lambda t, i: F.coalesce(mine(i), t)))
    return both.withColumn("told", told).drop("own", "_hot")
