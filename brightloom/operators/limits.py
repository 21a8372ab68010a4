"""Token buckets over event tables: the clamped recurrence of each key, worked out over ranges of its events side by side.

A bucket's state is the number of its tokens; an event refills it for the time since the one before, up to the capacity,
and takes its cost if it can. What a run of events does to any starting state is a function of few straight pieces, and
such functions can be chained. So each range of a key's events is first turned into its function, the functions of a key
are chained, and the ranges are then walked from their true starting states. A key of any number of events is spread over tasks.

Tokens are whole numbers of capacity-microseconds, so the result is exact: a token is HOUR of them, and a microsecond refills `capacity`.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable

HOUR = 3_600_000_000  #: microseconds in which an empty bucket fills


class Pieces:
    """A function on 0..full: from each begin on it is value (flat) or value plus the distance from begin."""

    def __init__(self, full: int, begins: list[int], values: list[int], slopes: list[int]) -> None:
        self.full, self.begins, self.values, self.slopes = full, begins, values, slopes

    @classmethod
    def same(cls, full: int) -> Pieces:
        return cls(full, [0], [0], [1])

    def at(self, x: int) -> int:
        k = bisect.bisect_right(self.begins, x) - 1
        return self.values[k] + self.slopes[k] * (x - self.begins[k])

    def then(self, refill: int, cost: int) -> Pieces:
        """This function and an event behind it."""
        begins, values, slopes = [], [], []

        def put(begin: int, value: int, slope: int) -> None:
            value = min(self.full, value + refill)
            value = value - cost if value >= cost else value
            if begins:
                last = values[-1] + slopes[-1] * (begin - begins[-1])
                if last == value and slopes[-1] == slope:
                    return
            begins.append(begin)
            values.append(value)
            slopes.append(slope)

        ends = [*self.begins[1:], self.full + 1]
        for begin, end, value, slope in zip(self.begins, ends, self.values, self.slopes, strict=True):
            if not slope:
                put(begin, value, 0)
                continue
            cuts = {begin, begin + max(0, cost - refill - value), begin + max(0, self.full - refill - value)}
            for cut in sorted(c for c in cuts if c < end):
                now = value + cut - begin
                put(cut, now, 0 if now + refill >= self.full else 1)
        return Pieces(self.full, begins, values, slopes)


def walked(tokens: int, moments: list[tuple[int, int]], last: int | None, capacity: int) -> Iterator[tuple[bool, int]]:
    """(allowed, tokens behind it) of events (microseconds, cost) from a state `tokens` at `last`; None: a full bucket."""
    full = capacity * HOUR
    for at, cost in moments:
        tokens = full if last is None else min(full, tokens + max(0, at - last) * capacity)
        last = at
        allowed = tokens >= cost * HOUR
        tokens -= cost * HOUR if allowed else 0
        yield allowed, tokens


FUNCTION = "part int, key string, first long, last long, begins array<long>, values array<long>, slopes array<int>"


def rate_limited(events: DataFrame, key: str, time: str, order: str, capacity: int, cost: str | None = None) -> DataFrame:
    """`events` with allowed and tokens (left behind the event, as a double), for a bucket of `capacity` an hour for each value of `key`.

    Buckets begin full. Events of a key go in the order of `time` and `order`; a `cost` column (whole tokens, 1 without
    one; null or negative: 0) is taken if there is as much. Null keys share a bucket; events of a null time come first
    and refill nothing. Rows that tie wholly go one after the other. An empty table stays empty.
    """
    columns = events.columns
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62))).alias("_at")
    price = F.greatest(F.lit(0), F.coalesce(F.col(cost), F.lit(0))).cast("long") if cost else F.lit(1).cast("long")
    rows = events.withColumns({"_key": F.to_json(F.struct(F.col(key).alias("k"))), "_at": at, "_cost": price, "_tie": F.monotonically_increasing_id()})
    turn = ["_key", "_at", order, "_tie"]
    # the ranges are written, because drawing them a second time could give others
    ranged = durable(rows.repartitionByRange(*turn).sortWithinPartitions(*turn).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    parts = max(1, ranged.select("_part").distinct().count())
    together = lambda c: ranged.select(*c).repartition(parts, "_part").sortWithinPartitions("_part", "_seq")  # noqa: E731 (a file may be split on reading)
    full = capacity * HOUR

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = None, []
        for batch in batches:
            for part, k, at_, price_ in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_at", "_cost")), strict=True):
                if own and own["part"] == part and own["key"] == k:
                    own["f"] = own["f"].then(max(0, at_ - own["last"]) * capacity if own["last"] > -(1 << 62) else 0, price_ * HOUR)
                else:
                    own = {"part": part, "key": k, "first": at_, "f": Pieces.same(full).then(0, price_ * HOUR)}
                    found.append(own)
                own["last"] = at_
        rows_ = [{**{c: x[c] for c in ("part", "key", "first", "last")}, "begins": x["f"].begins, "values": x["f"].values, "slopes": x["f"].slopes} for x in found]
        kinds = pa.schema([("part", pa.int32()), ("key", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("begins", pa.list_(pa.int64())), ("values", pa.list_(pa.int64())), ("slopes", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_pylist(rows_, kinds)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each range of a key; a key has at most a row for each range."""
        out, was = [], None
        for batch in batches:
            for r in batch.to_pylist():
                fresh = was is None or was["key"] != r["key"]
                last, tokens = (None, full) if fresh else (was["last"], was["tokens"])
                out.append({"part": r["part"], "key": r["key"], "last": last, "tokens": tokens})
                idle = last is None or last == -(1 << 62)
                start = full if last is None else tokens if idle else min(full, tokens + max(0, r["first"] - last) * capacity)
                was = {"key": r["key"], "last": r["last"], "tokens": Pieces(full, r["begins"], r["values"], r["slopes"]).at(start)}
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("key", pa.string()), ("last", pa.int64()), ("tokens", pa.int64())]))

    pieces = together(["_part", "_seq", "_key", "_at", "_cost"]).mapInArrow(functions, FUNCTION)
    states = durable(pieces.repartition("key").sortWithinPartitions("key", "part").mapInArrow(chained, "part int, key string, last long, tokens long"))
    told = ranged.join(states.withColumnsRenamed({"part": "_part", "key": "_key", "last": "_last", "tokens": "_tokens"}), ["_part", "_key"])
    told = told.repartition(parts, "_part").sortWithinPartitions("_part", "_seq")
    schema = events.schema.add("allowed", "boolean").add("tokens", "double")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, last = None, 0, None
        for batch in batches:
            allowed, left = [], []
            for part, k, at_, price_, last_, tokens_ in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_at", "_cost", "_last", "_tokens")), strict=True):
                if own != (part, k):
                    own, tokens, last = (part, k), tokens_, last_
                idle = last is not None and last == -(1 << 62)
                yes, tokens = next(walked(tokens, [(at_, price_)], at_ if idle else last, capacity))
                last = at_
                allowed.append(yes)
                left.append(tokens / HOUR)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], [*columns, "allowed", "tokens"])

    return told.mapInArrow(judged, schema)
