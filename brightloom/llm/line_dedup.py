"""Line deduplication with two Bloom filters, of hashes seen once and seen twice.

Each row's long lines are hashed once. Tasks fill both filters from the hashes of their rows, filters are merged in a tree,
and only lines whose hash may have been seen twice are shuffled, with their whole keys, to be counted exactly and to find
the document that keeps them. A filter can only suspect too many lines, never too few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, unused

LEAST_LENGTH = 40  #: code points of a key
LEAST_DOCUMENTS = 5
BITS = 16  #: of a filter for each long line
MOST_BITS = 1 << 28  #: of a filter (32 MB); with more lines the filters suspect more, and the result stays the same
PROBES = 4
FAN = 8  #: filters that a task merges
MOST_BROADCAST = 32 << 20  #: bytes of repeated keys that are broadcast; more are joined
HOT = 20_000  #: documents of a key for which a join deals it to several tasks
EDGES = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes, least: int) -> list[bytes | None]:
    """For each line of a text its key, or None where that has fewer than `least` code points. A-Z alone are lower-cased."""
    found: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # on bytes, lower() and strip() touch ASCII alone
        line = line.strip(EDGES)
        long = len(line) >= least and (line.isascii() or len(line.decode("utf-8", "replace")) >= least)
        found.append(line if long else None)
    return found


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def line_hashes(docs: DataFrame, key: str, least: int) -> DataFrame:
    """hashes: an array for each row, of its distinct keys."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.array([xxhash.xxh3_64_intdigest(k) for k in {*keys_of(t, least)} - {None}], np.uint64).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64()))], ["hashes"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(hashed, "hashes array<long>")


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of `bits` bits, a power of two; a row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.array([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


def holds(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filled[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def fill(filled: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filled, places.ravel() >> np.uint64(3), np.uint8(1) << (places.ravel() & np.uint64(7)).astype(np.uint8))


class Filters:
    """Hashes of at least one row, and of at least two."""

    def __init__(self, bits: int, once: bytes | None = None, twice: bytes | None = None) -> None:
        self.bits = bits
        self.once = np.frombuffer(once, np.uint8).copy() if once else np.zeros(bits // 8, np.uint8)
        self.twice = np.frombuffer(twice, np.uint8).copy() if twice else np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of several rows, distinct in each."""
        kinds, times = np.unique(hashes, return_counts=True)
        places = probes(kinds, self.bits)
        again = holds(self.once, places) | (times > 1)
        fill(self.once, places)
        fill(self.twice, places[:, again])

    def merge(self, other: Filters) -> None:
        """What either has seen twice, and what both have seen: all bits of such a hash are in both."""
        self.twice |= other.twice | (self.once & other.once)
        self.once |= other.once

    def record(self, place: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([self.once.tobytes()], pa.binary()), pa.array([self.twice.tobytes()], pa.binary())], ["place", "once", "twice"])


FILTERS = "place long, once binary, twice binary"


def seen_twice(hashes: DataFrame, bits: int, lines: int) -> bytes:
    """The filter of hashes that at least two rows have; `bits` / 8 bytes, which the driver sees.

    So few tasks fill filters that what they write stays under half of what all hashes take, and one at least.
    """
    tasks = max(1, min(hashes.rdd.getNumPartitions(), lines * 8 // (bits // 8 * 4)))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in slices(batches, 4096):
            own.add(batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        yield own.record(TaskContext.get().partitionId())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in slices(batches, 1):
            place = batch.column("place")[0].as_py() // FAN
            one = Filters(bits, *(batch.column(c)[0].as_py() for c in ("once", "twice")))
            if own and place == at:
                own.merge(one)
            else:
                if own:
                    yield own.record(at)
                at, own = place, one
        if own:
            yield own.record(at)

    parts = durable(hashes.coalesce(tasks).mapInArrow(filled, FILTERS))
    while parts.count() > 1:
        parts = durable(parts.repartition(F.floor(F.col("place") / FAN)).sortWithinPartitions("place").mapInArrow(together, FILTERS))
    last = parts.select("twice").first()
    return bytes(last.twice) if last else bytes(bits // 8)


def suspects(docs: DataFrame, key: str, twice: bytes, bits: int, least: int) -> DataFrame:
    """doc and line: the distinct keys of each row that may stand in two rows or more."""
    filled = docs.sparkSession.sparkContext.broadcast(twice)
    kind = docs.schema[key].dataType.simpleString()

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(filled.value, np.uint8)
        for batch in slices(batches):
            rows, lines = [], []
            for k, text in enumerate(texts_of(batch)):
                own = [line for line in {*keys_of(text, least)} if line is not None]
                rows += [k] * len(own)
                lines += own
            if lines:
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
                kept = np.flatnonzero(holds(seen, probes(hashes, bits)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(np.array(rows)[kept])), pa.array([lines[k] for k in kept.tolist()], pa.binary())], ["doc", "line"])

    return docs.select(F.col(key).alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(suspected, f"doc {kind}, line binary")


def repeated(found: DataFrame, least: int) -> DataFrame:
    """line, n_docs, keeper of each key in at least `least` documents, counted over whole keys.

    The first grouping is by key and document, so a key of very many documents is spread; the second has one row of each
    task for it. The keeper is the largest id; a null id is one document and the least.
    """
    once = found.groupBy("line", "doc").count()
    return once.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= least)


def to_drop(found: DataFrame, lines: DataFrame, hot: int) -> DataFrame:
    """doc and the keys that it loses, for more keys than can be broadcast; a key of many documents is dealt by salt.

    Of keys with more than `hot` documents only hashes are broadcast, a million at most, as `hot` grows with the rows beyond.
    """
    hot = max(hot, found.count() // 1_000_000)
    mark = F.xxhash64("line").alias("mark")
    spread = F.broadcast(lines.where(F.col("n_docs") > hot).groupBy(mark).agg(F.max(F.ceil(F.col("n_docs") / hot)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    salted = found.withColumn("mark", mark).join(spread, "mark", "left").select("doc", "line", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("salt"))
    keys = lines.withColumn("mark", mark).join(spread, "mark", "left").select("line", "keeper", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    lost = salted.join(keys, ["line", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc").agg(F.collect_set("line").alias("lines"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCUMENTS, out: str = "kept", most_broadcast: int = MOST_BROADCAST, hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs`, all columns, with `out` (the text that stays), n_lines and n_dropped (columns of these names are replaced).

    Lines end at \\n; a line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    `least_length` code points found in at least `least_docs` documents are dropped everywhere but in the document with the largest
    id, which keeps all of them. Rows of one id are one document; a null id is one too and the least of all. A null or empty text
    is one empty line and becomes empty. Wholly repeated rows lose the same lines. An empty table stays empty.
    """
    hashes = durable(line_hashes(docs, key, least_length))
    lines = hashes.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first().n
    bits = min(most_bits, 1 << max(13, math.ceil(math.log2(max(1, lines * BITS)))))
    found = durable(suspects(docs, key, seen_twice(hashes, bits, lines), bits, least_length))
    again = durable(repeated(found, least_docs))
    size = again.agg(F.coalesce(F.sum(F.octet_length("line") + 100), F.lit(0)).alias("n")).first().n
    kept = [f for f in docs.schema.fields if f.name.lower() not in (out.lower(), "n_lines", "n_dropped")]
    mine = unused(docs, "_lines")
    shape = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string", "n_lines long", "n_dropped long"])
    few = size <= most_broadcast
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r.line): r.keeper for r in again.select("line", "keeper").toLocalIterator()} if few else None)
    source = docs
    if not few:
        lost = to_drop(found, again, hot).withColumnRenamed("lines", mine)
        source = docs.alias("d").join(lost.alias("l"), F.col(f"d.`{key}`").eqNullSafe(F.col("l.doc")), "left").select("d.*", f"l.{mine}")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = shared.value
        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            ids = batch.column(key).to_pylist()
            own = [{*(x or [])} for x in batch.column(mine).to_pylist()] if keepers is None else None
            for k, text in enumerate(b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()):
                keys = keys_of(text, least_length)
                if keepers is None:
                    gone = [x is not None and x in own[k] for x in keys]
                else:
                    gone = [x is not None and x in keepers and keepers[x] != ids[k] for x in keys]
                n = sum(gone)
                texts.append(b"\n".join(line for line, g in zip(text.split(b"\n"), gone, strict=True) if not g) if n else text)
                counts.append(len(keys))
                dropped.append(n)
            told = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *told], [*(f.name for f in kept), out, "n_lines", "n_dropped"])

    return source.mapInArrow(applied, shape)


def line_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_lines, n_dropped, kept_sha256: a row for each row of `docs`, whatever its other columns are; cases as above."""
    kept = without_repeated_lines(docs.select(key, "text"), key)
    return kept.select(key, "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
