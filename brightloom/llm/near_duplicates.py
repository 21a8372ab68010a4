"""N-gram Jaccard join by MinHash banding.

Texts with one set of word 5-grams are one set with a count. Signatures of the sets are cut into bands, sets meet where
they share a band's hash, and pairs that meet are verified on their full n-gram sets. No pair is ever a row: large
buckets are dealt into pairs of blocks (work, though not rows, grows with the square of a bucket's distinct sets), a block pair is verified at once, and gives for each set the copies that it links
to and a spanning forest of the links. A pair that meets in several buckets counts in the first of them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, row_key, slices, unused
from .words import shingles

THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK = 256  #: sets of a bucket that are held against as many at once
COLUMNS = 8192  #: n-grams of a block pair that are multiplied at once
MOST_BROADCAST = 300_000  #: row keys (some 40 bytes each, so 12 MB) up to which they are broadcast; more are shuffled


def banding(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective choice of at most `most` hashes whose recall at `threshold` is `recall` or more."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no such banding")


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of the MinHash signature of a set."""
    rng = np.random.default_rng(20_240_601)
    factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    folded = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        least = np.minimum(least, ((folded[at : at + 2048, None] ^ shifts) * factors).min(axis=0))
    signature = least.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = (total ^ signature[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        present = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        present[owner[a:b], column[a:b] - at] = 1
        out += present @ present.T
    return out


@dataclass
class Member:
    set_id: bytes
    copies: int
    side: int
    grams: np.ndarray
    buckets: np.ndarray


def forest(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the least node that it is joined to through links."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(bucket: int, members: list[Member], both_sides: bool, threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(set, copies that it links to, set that stands for its links) for each set of a block pair that has a link here."""
    members.sort(key=lambda m: m.set_id)
    size = np.array([len(m.grams) for m in members], np.float64)
    common = overlaps([m.grams for m in members])
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if both_sides:
        side = np.array([m.side for m in members])
        linked &= side[:, None] != side[None, :]
    linked &= overlaps([m.buckets[m.buckets < bucket] for m in members]) == 0  # the pair hasn't met in an earlier bucket
    copies = np.array([m.copies for m in members], np.int64)
    links, root = linked @ copies, forest(linked)
    return [(members[k].set_id, int(links[k]), members[root[k]].set_id) for k in np.flatnonzero(linked.any(axis=1))]


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, set_id, bands for each row; set_id and bands are null for null and empty texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids: list[bytes | None] = []
            hashes: list[np.ndarray | None] = []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, n)
                ids.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                hashes.append(band_hashes(grams, bands, rows).view(np.int64) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "key", "set_id", "bands"])

    keyed = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), row_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(sign, "doc_id long, key long, set_id binary, bands array<long>")


def grams_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """set_id and grams for each row of `wanted` (doc_id, key, set_id), from the whole texts of `docs`."""
    few = wanted.count() <= MOST_BROADCAST
    keyed = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), row_key(F.col("text")).alias("key"), "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.key") == F.col("w.key"))
    found = keyed.alias("d").join((F.broadcast(wanted) if few else wanted).alias("w"), same).select("set_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams = [shingles(t, n).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(grams, pa.list_(pa.int64()))], ["set_id", "grams"])

    return found.mapInArrow(cut, "set_id binary, grams array<long>").dropDuplicates(["set_id"])


def verified(met: DataFrame, threshold: float) -> DataFrame:
    """set_id, links, root from rows bucket, low, high, side, set_id, copies, buckets, grams, a block pair's rows together."""

    def verify_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def done() -> pa.RecordBatch:
            found = verify(at[0], members, at[1] != at[2], threshold) if len(members) > 1 else []
            kinds = [pa.binary(), pa.int64(), pa.binary()]
            columns = zip(*found, strict=True) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["set_id", "links", "root"])

        for batch in slices(batches, 64):
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high")), strict=True)
            own = (batch.column(c).to_pylist() for c in ("set_id", "copies", "side"))
            grams, buckets = batch.column("grams"), batch.column("buckets")
            for k, (key, (set_id, copies, side)) in enumerate(zip(keys, zip(*own, strict=True), strict=True)):
                if key != at:
                    if at:
                        yield done()
                    at, members = key, []
                mine = [c[k].values.to_numpy() for c in (grams, buckets)]
                members.append(Member(set_id, copies, side, mine[0].copy(), mine[1].copy()))
        if at:
            yield done()

    place = ["bucket", "low", "high"]
    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(verify_all, "set_id binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) from edges a, b with b <= a, by least labels and pointer jumps."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = durable(both.where("node <> other"))
    labels = durable(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        offered = both.join(of_other, "other").groupBy("node").agg(F.min("theirs").alias("least"))
        lower = labels.join(offered, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = durable(lower.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def classes(docs: DataFrame, n: int = 5, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row for each row of `docs`: doc_id, key, class_id, n_links, keeper_id, keeper_key.

    A class is what links of Jaccard similarity `threshold` or more join, equal texts included; class_id is its least
    doc_id (an id that is no number counts as null), n_links counts the other rows that the row's text is linked to. Null and empty texts have no n-grams: each row
    is a class of its own with no links. Repeated rows are copies. keeper_id and keeper_key name the row that stays if
    one of a class does. Extra columns don't matter; an empty table gives an empty one.
    """
    bands, rows = banding(threshold, recall)
    rows_signed = durable(signed(docs, n, bands, rows))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("keeper")
    sets = durable(rows_signed.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), keeper, F.any_value("bands").alias("bands")))

    placed = sets.select("set_id", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("set_id")
    held = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s"))
    # buckets with the same sets are one: the first of them stands for all
    kept = held.where("size > 1").groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    met = durable(placed.join(kept, "bucket"))
    lists = met.groupBy("set_id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))  # `bands` at most
    wanted = durable(sets.join(lists, "set_id").select("set_id", "copies", "buckets", "keeper.doc_id", "keeper.key"))
    grams = grams_of(docs, wanted.select("doc_id", "key", "set_id"), n)
    known = durable(wanted.select("set_id", "copies", "buckets").join(grams, "set_id"))

    parts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("set_id", "bucket"), F.col("parts")).cast("int")
    dealt = met.withColumn("parts", parts).withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("set_id", "bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side")
    found = durable(verified(dealt.join(known, "set_id"), threshold))

    labels = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    labelled = sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
    labelled = durable(labelled.select("set_id", F.coalesce("label", "set_id").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "keeper"))
    of_class = labelled.groupBy("label").agg(F.min("keeper").alias("class_keeper"))
    told = labelled.join(of_class, "label").select("set_id", "n_links", "class_keeper")
    joined = rows_signed.drop("bands").join(told, "set_id", "left")
    alone = F.col("set_id").isNull()
    return joined.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_keeper.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_keeper.doc_id")).alias("keeper_id"),
        F.when(alone, F.col("key")).otherwise(F.col("class_keeper.key")).alias("keeper_key"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, all its columns, with one row of each class. Rows of null or empty text all stay; of wholly repeated rows one does."""
    assigned = durable(classes(docs, n, threshold))
    stays = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("key") == F.col("keeper_key"))
    void = row_key(F.lit(None).cast("string")), row_key(F.lit(""))
    gone = durable(assigned.where(~stays).select("doc_id", "key").distinct())
    repeated = assigned.where(stays & ~F.col("key").isin(*void)).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    repeated = durable(repeated)
    few = gone.count() <= MOST_BROADCAST
    name = unused(docs, "_key")
    keyed = docs.withColumn(name, row_key(F.col("text")))
    same = lambda other: F.col("d.doc_id").try_cast("long").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"d.{name}") == F.col(f"{other}.key"))
    left = keyed.alias("d").join((F.broadcast(gone) if few else gone).alias("g"), same("g"), "left_anti")
    if not repeated.isEmpty():
        once = left.alias("d").join(repeated.alias("r"), same("r"), "left_anti")
        again = left.alias("d").join(repeated.alias("r"), same("r"), "left_semi").dropDuplicates([name])
        left = once.unionByName(again)
    return left.drop(name)
