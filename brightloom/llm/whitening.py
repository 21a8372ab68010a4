"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors become integers, of which each distinct one counts once. Every partition sums its vectors up as exact sums, all
singular values and all right singular vectors of its centred rows. Summaries are merged in a tree of Spark tasks: the
scaled vectors of both and one more row for the gap between their means are decomposed again, so nothing is cut off on
the way and the last summary is the decomposition of all centred vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slices

STEPS = 64  #: an entry becomes a whole number of 64ths
OFFSET = 1_000_000  #: added to each, so that common entries are positive
MOST = 1 << 52  #: entries beyond this many 64ths count as this many
COMPONENTS = 16
CHUNK = 1024  #: vectors that are decomposed at once
FAN = 8  #: summaries that a task merges
SUMMARY = "place long, n long, total array<decimal(38,0)>, factors array<double>, directions array<double>"


@dataclass
class Summary:
    """n vectors: exact sums of each dimension, singular values of the centred vectors, and right singular vectors as rows."""

    n: int
    total: list[int]
    factors: np.ndarray
    directions: np.ndarray

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and rest, as the rest of a large mean would lose digits in one number."""
        whole = [t // self.n for t in self.total]
        return np.array(whole, np.int64), np.array([(t - w * self.n) / self.n for t, w in zip(self.total, whole, strict=True)])

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        whole, rest = self.mean()
        return (vectors - whole) - rest

    def record(self, place: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
        cells = [place, self.n, [Decimal(t) for t in self.total], self.factors, self.directions.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["place", "n", "total", "factors", "directions"])


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, factors, directions = np.linalg.svd(rows, full_matrices=False)
    return factors, directions


def summary_of(vectors: np.ndarray) -> Summary:
    found = Summary(len(vectors), [int(t) for t in vectors.sum(axis=0)], np.zeros(0), np.zeros((0, vectors.shape[1])))
    found.factors, found.directions = decomposed(found.centred(vectors))
    return found


def merged(a: Summary, b: Summary) -> Summary:
    """Both together: the centred rows of the union span what the two and one row for the gap of the means span."""
    n = a.n + b.n
    gap = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.total, b.total, strict=True)])
    rows = np.vstack([a.factors[:, None] * a.directions, b.factors[:, None] * b.directions, np.sqrt(a.n / n * b.n) * gap])
    return Summary(n, [s + t for s, t in zip(a.total, b.total, strict=True)], *decomposed(rows))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summaries(vectors: DataFrame, width: int) -> DataFrame:
    """A summary of each partition of the column `x`."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in slices(batches, CHUNK):
            one = summary_of(matrix(batch.column("x"), width))
            found = merged(found, one) if found else one
        if found:
            yield found.record(TaskContext.get().partitionId())

    return vectors.select("x").mapInArrow(summed, SUMMARY)


def as_summary(row: dict, width: int) -> Summary:
    return Summary(row["n"], [int(t) for t in row["total"]], np.array(row["factors"]), np.array(row["directions"]).reshape(-1, width))


def all_merged(parts: DataFrame, width: int) -> Summary:
    """One summary of all, by rounds in which a task merges FAN of them; the driver sees the last one alone."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            one = as_summary(row, width)
            if found and row["place"] // FAN == at:
                found = merged(found, one)
            else:
                if found:
                    yield found.record(at)
                at, found = row["place"] // FAN, one
        if found:
            yield found.record(at)

    parts = durable(parts)
    while parts.count() > 1:
        group = F.floor(F.col("place") / FAN)
        parts = durable(parts.repartition(group).sortWithinPartitions("place").mapInArrow(together, SUMMARY))
    return as_summary(parts.first().asDict(), width)


def quantised(vector: Column) -> Column:
    """Entries as doubles, floored to 64ths, plus OFFSET, as longs; null if the vector or an entry is null or not finite."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(wide, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is larger than all
    whole = F.transform(wide, lambda c: (F.floor(F.greatest(F.least(c * STEPS, F.lit(float(MOST))), F.lit(-float(MOST)))) + OFFSET).cast("long"))
    return F.when(usable, whole)


@dataclass
class Whitening:
    """What all tasks need to whiten a vector; its size is that of `components` vectors."""

    summary: Summary
    weights: np.ndarray  #: a component a row: direction over the root of its variance; NaN where the variance is zero
    explained: np.ndarray

    @classmethod
    def of(cls, summary: Summary, components: int) -> Whitening:
        width = len(summary.total)
        components = min(components, width)
        factors, directions = np.zeros(width), np.zeros((width, width))
        factors[: len(summary.factors)], directions[: len(summary.factors)] = summary.factors, summary.directions
        largest = directions[np.arange(width), np.abs(directions).argmax(axis=1)]
        directions *= np.where(largest < 0, -1.0, 1.0)[:, None]
        void = factors <= factors[:1].max(initial=0) * max(width, 1) * np.finfo(float).eps
        scale = np.where(void, np.nan, factors / np.sqrt(summary.n))
        volume = (factors**2).sum()
        shares = factors**2 / volume if volume else np.full(width, np.nan)
        return cls(summary, (directions / scale[:, None])[:components], shares[:components])

    def apply(self, vectors: np.ndarray) -> np.ndarray:
        return self.summary.centred(vectors) @ self.weights.T

    def deviations(self, vectors: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, in whole numbers; null where a long can't hold it."""
        n, total = self.summary.n, self.summary.total
        reach = max((n * int(abs(v)) for v in (vectors.max(initial=0), vectors.min(initial=0))), default=0) + max(map(abs, total), default=0)
        if reach * reach * max(1, len(total)) < 1 << 63:
            away = vectors * n - np.array(total, np.int64)
            return (away * away).sum(axis=1).tolist()
        if reach < 1 << 62:  # the parts fit, and whole numbers of Python take the squares
            away = vectors * n - np.array(total, np.int64)
            bound = int(np.abs(away).max(initial=0))
            if bound * bound * max(1, len(total)) < 1 << 63:
                return (away * away).sum(axis=1).tolist()
        exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, total, strict=True)) for row in vectors.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def identity_error(vectors: DataFrame, model: Whitening, width: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    kept = np.flatnonzero(~np.isnan(model.weights).any(axis=1))
    if not len(kept):
        return None
    size = len(kept)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((size, size))
        for batch in slices(batches, CHUNK):
            white = model.apply(matrix(batch.column("x"), width))[:, kept]
            found += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(found.ravel())], ["cell", "v"])

    cells = vectors.select("x").mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # components squared
    covariance = np.zeros(size * size)
    for r in cells:
        covariance[r.cell] = r.v / model.summary.n
    return float(np.abs(covariance.reshape(size, size) - np.eye(size)).max())


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, out: str = "whitened") -> tuple[DataFrame, Whitening | None, float | None]:
    """The usable rows, all columns, with `out` (array of `components` doubles) and `_deviation`; the model; its identity error.

    Rows whose vector is null or holds null or non-finite entries are left out; so are rows of another length than the
    one that most distinct vectors have (the larger of two). Repeated vectors count once in the fit and are all whitened.
    A component without variance (fewer vectors than dimensions) is null in `out`. Without usable rows the model and the error
    are None. The driver sees one summary, of the size of a vector squared.
    """
    schema = rows.schema
    usable = rows.withColumn("_x", quantised(F.col(vector))).where("_x is not null")
    distinct = durable(usable.select(F.col("_x").alias("x")).distinct())
    lengths = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    shape = f"{columns}{', ' if columns else ''}`{out}` array<double>, _deviation long"
    if not lengths:
        return rows.sparkSession.createDataFrame([], shape), None, None
    width = lengths.width
    distinct = distinct.where(F.size("x") == width)
    model = Whitening.of(all_merged(summaries(distinct, width), width), components)
    error = identity_error(distinct, model, width)
    kept = schema.names

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, CHUNK):
            vectors = matrix(batch.column("_x"), width)
            white = model.apply(vectors)
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(model.deviations(vectors), pa.int64())], [*kept, out, "_deviation"])

    return usable.where(F.size("_x") == width).mapInArrow(project, shape), model, error


def whitening_report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    n and deviation are exact. Null keys and repeated rows stay; what `whitened` says of other vectors holds. Without
    usable rows the result is empty; explained and whitened are null where nothing varies. Extra columns don't matter.
    """
    found, model, error = whitened(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", components, "white")
    told = found.select(F.col("key").alias(key), F.col("_deviation").alias("deviation"), F.posexplode("white").alias("place", "whitened"))
    shares = F.create_map(*(F.lit(v) for pair in enumerate([] if model is None else [None if np.isnan(s) else float(s) for s in model.explained], 1) for v in pair)) if model is not None and len(model.explained) else F.lit(None).cast("map<int,double>")
    number = (F.col("place") + 1).cast("int")
    return told.select(
        key,
        number.alias("component"),
        F.lit(model.summary.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[number].cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
