"""Near-equal texts by SimHash: hashes in the row, links found in bounded blocks, classes and greedy choices without pairs as rows.

Hashes that differ in under BANDS bits share one of BANDS bands. Rows are dealt by the values of their bands; a value that
many hashes share is cut into pairs of blocks. A task compares the hashes of one block pair at once and tells for each hash
what its links there say, so what is written grows with the hashes, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import discard, durable, spread

BANDS, BAND_BITS = 4, 16
BUCKET = 1024  #: hashes of a band's value that are compared with as many at once


@F.arrow_udf(T.LongType())
def _simhash(lines: pa.Array) -> pa.Array:
    """Of words joined by blanks: bit b is set if more than half of the runs of three words have it; 0 for under three words."""
    from hashlib import md5

    weights, found = np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros(len(lines), np.uint64)
    for k, line in enumerate(lines.to_pylist()):
        words = line.split(" ") if line else []
        if len(words) >= 3:
            runs = b"".join(md5(" ".join(run).encode(), usedforsecurity=False).digest()[:8] for run in zip(words, words[1:], words[2:], strict=False))
            ones = np.unpackbits(np.frombuffer(runs, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)[::-1]
            found[k] = weights[2 * ones > len(words) - 2].sum(dtype=np.uint64)
    return pa.array(found.view(np.int64))


def simhash_of(text: Column) -> Column:
    """64-bit SimHash over runs of three words; 0 for null texts and those of under three words. Not for use within a lambda."""
    return _simhash(F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " "))


def simhash(rows: DataFrame, id_column: str, text: str, out: str = "simhash") -> DataFrame:
    """`id_column` and the SimHash of each row's text, dealt evenly as a row's work is much for its bytes."""
    return spread(rows.select(id_column, text), id_column).select(id_column, simhash_of(F.col(text)).alias(out))


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that grows with the input: such rows meet by a shuffle and are never gathered by the driver to be broadcast."""
    return df.hint("merge")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys match where both are null too; the right ones go."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def in_blocks(hashes: DataFrame, bucket: int) -> DataFrame:
    """`hashes` (place, simhash, more), a row for each block pair of a band's value that at least two hashes share, with band, value, low, high, side."""
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("simhash", k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("value")) for k in range(BANDS)))
    banded = hashes.select("*", F.inline(bands))
    keys = ["place", "band", "value"]
    held = banded.groupBy(*keys).agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = banded.join(shuffled(held), keys).withColumn("side", F.pmod(F.xxhash64("simhash", "band"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("*", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")).drop("parts", "other")


def links_of(hashes: np.ndarray, sides: np.ndarray, band: int, both: bool, most: int) -> np.ndarray:
    """Which hashes of a block pair differ in at most `most` bits and meet here first: no lower band is equal."""
    other = hashes[:, None] ^ hashes[None, :]
    linked = np.bitwise_count(other) <= most
    for k in range(band):
        linked &= (other >> np.uint64(k * BAND_BITS)) & np.uint64((1 << BAND_BITS) - 1) != 0
    if both:
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    return linked


def told_by_blocks(hashes: DataFrame, extra: list[str], told: Callable, out: str, most: int, bucket: int) -> DataFrame:
    """Rows place, simhash and `out` columns: what `told(linked, columns)` says of each hash of each block pair.

    `told` gets the matrix of links and a dict of arrays (simhash and `extra`), and gives the kept places and arrays for `out`.
    """
    if most >= BANDS:
        raise ValueError("more differing bits than bands")
    keys = ["place", "band", "value", "low", "high"]
    names = [c.split()[0] for c in out.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> pa.RecordBatch | None:
            group = pa.Table.from_batches(parts)
            columns = {c: group.column(c).to_numpy() for c in ("simhash", "side", *extra)}
            linked = links_of(columns["simhash"].view(np.uint64), columns["side"], at[1], at[3] != at[4], most)
            kept, *values = told(linked, columns)
            if len(kept):
                return pa.RecordBatch.from_arrays([group.column("place").combine_chunks().take(pa.array(kept)), pa.array(columns["simhash"][kept]), *map(pa.array, values)], ["place", "simhash", *names])
            return None

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            begin = 0
            for k, key in enumerate(rows):
                if key != at:
                    if k > begin:
                        parts.append(batch.slice(begin, k - begin))
                    if parts and (found := done()):
                        yield found
                    at, parts, begin = key, [], k
            if len(rows) > begin:
                parts.append(batch.slice(begin))
        if parts and (found := done()):
            yield found

    dealt = in_blocks(hashes.select("place", "simhash", *extra), bucket).select(*keys, "side", "simhash", *extra)
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, f"place string, simhash long, {out}")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each place of a symmetric matrix the least place that links join it to."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def placed(hashes: DataFrame, block: list[str], *more: str) -> DataFrame:
    """`hashes` with the block in one string (nulls told from blanks), in the shared folder."""
    return durable(hashes.select(*block, F.to_json(F.struct(*block)).alias("place"), "id", "simhash", *more))


def near_classes(hashes: DataFrame, block: list[str], most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """A row for each of `hashes` (block, id, simhash): block, id, class_id and n_links.

    A class is what links of at most `most` differing bits join within a block, equal hashes included; class_id is its
    least id, n_links counts the other rows that a row is linked to. Rows of hash 0 are classes of their own. Null blocks
    are one block; an empty table gives an empty one.
    """
    hashes = placed(hashes, block)
    distinct = durable(hashes.where("simhash <> 0").groupBy("place", "simhash").agg(F.min("id").alias("least"), F.count("*").alias("copies")))

    def told(linked: np.ndarray, columns: dict) -> tuple:
        kept = np.flatnonzero(linked.any(axis=1))
        return kept, (linked @ columns["copies"])[kept], columns["simhash"][forest(linked)][kept]

    found = durable(told_by_blocks(distinct, ["copies"], told, "links long, root long", most, bucket))
    edges = found.where("root <> simhash").select("place", "simhash", F.col("root").alias("other")).distinct()
    edges = durable(edges.unionByName(edges.select("place", F.col("other").alias("simhash"), F.col("simhash").alias("other"))))
    labels, old = distinct.select("place", "simhash", F.col("simhash").alias("label")), None
    while True:  # least labels and pointer jumps, until nothing changes
        theirs = labels.select("place", F.col("simhash").alias("other"), F.col("label").alias("theirs"))
        offered = edges.join(shuffled(theirs), ["place", "other"]).groupBy("place", "simhash").agg(F.min("theirs").alias("offer"))
        lower = labels.join(shuffled(offered), ["place", "simhash"], "left").select("place", "simhash", F.least("label", "offer").alias("label"), F.col("label").alias("old"))
        jump = labels.select("place", F.col("simhash").alias("label"), F.col("label").alias("further"))
        new = durable(lower.join(shuffled(jump), ["place", "label"]).select("place", "simhash", F.least("label", "further").alias("label"), "old"))
        discard(old)
        labels, old = new.drop("old"), new
        if new.where("label <> old").isEmpty():
            break
    linked = found.groupBy("place", "simhash").agg(F.sum("links").alias("n"))
    told_ = labels.join(shuffled(distinct), ["place", "simhash"]).join(shuffled(linked), ["place", "simhash"], "left")
    least = told_.groupBy("place", "label").agg(F.min("least").alias("class_id"))
    told_ = told_.join(shuffled(least), ["place", "label"]).select("place", "simhash", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return hashes.join(shuffled(told_), ["place", "simhash"], "left").select(*block, "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


NONE = (1 << 63) - 1


def greedy_classes(hashes: DataFrame, block: list[str], order: list[Column], most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """A row for each of `hashes` (block, id, simhash): block, id and leader_id, as if rows came one by one in `order`.

    A row that differs in more than `most` bits from every leader before it in its block leads a group; any other joins the
    earliest such leader. So a chain a-b-c of which a and c are far apart is two groups. Rows decide in rounds: one with an
    earlier leader beside it follows, one whose earlier neighbours all follow leads; there are as many rounds as the
    longest chain of decisions that wait for each other. Rows of hash 0 lead groups of their own. Ids break ties of `order`;
    rows that share an id and a hash are one.
    """
    names = [f"_o{k}" for k in range(len(order))]
    hashes = placed(hashes.withColumns(dict(zip(names, order, strict=True))), block, *names)
    turn = F.struct(*names, "id")
    distinct = hashes.where("simhash <> 0").groupBy("place", "simhash").agg(F.min(turn).alias("turn"))
    # places of turns within all rows, as numbers that tasks can compare
    ranged = distinct.repartitionByRange("turn").sortWithinPartitions("turn").withColumn("ord", F.monotonically_increasing_id())
    numbered = durable(ranged.select("place", "simhash", "ord", F.col("turn.id").alias("own_id")))
    state = numbered.select("place", "simhash", "ord", F.lit(0).alias("state"))  # 0 undecided, 1 leads, 2 follows

    def earlier(linked: np.ndarray, columns: dict) -> np.ndarray:
        return linked & (columns["ord"][None, :] < columns["ord"][:, None])

    def waits(linked: np.ndarray, columns: dict) -> tuple:
        before, open_ = earlier(linked, columns), columns["state"] == 0
        led, held = (before & (columns["state"] == 1)[None, :]).any(axis=1), (before & open_[None, :]).any(axis=1)
        kept = np.flatnonzero(open_ & (led | held))
        return kept, led[kept]

    decided = before = None
    while True:
        open_ = state.where("state = 0")
        found = told_by_blocks(state, ["ord", "state"], waits, "led boolean", most, bucket).groupBy("place", "simhash").agg(F.max("led").alias("led"))
        after = open_.join(shuffled(found), ["place", "simhash"], "left").withColumn("state", F.when(F.col("led").isNull(), 1).when(F.col("led"), 2).otherwise(0)).drop("led")
        after = durable(after)
        fresh = after.where("state = 1").select("place", "simhash", "ord")
        more = durable(fresh if decided is None else decided.unionByName(fresh))
        discard(decided, before)
        decided, before = more, after
        if after.where("state = 0").isEmpty():
            break
        state = after.where("state < 2")  # leaders of earlier rounds have been heard

    def joins(linked: np.ndarray, columns: dict) -> tuple:
        heard = np.where(earlier(linked, columns) & columns["leads"][None, :], columns["ord"][None, :], NONE).min(axis=1, initial=NONE)
        kept = np.flatnonzero(~columns["leads"] & (heard < NONE))
        return kept, heard[kept]

    leads = numbered.join(shuffled(decided.select("place", "simhash", F.lit(True).alias("leads"))), ["place", "simhash"], "left").fillna(False, ["leads"])
    leads = durable(leads)
    led = told_by_blocks(leads, ["ord", "leads"], joins, "leader long", most, bucket).groupBy("place", "simhash").agg(F.min("leader").alias("leader"))
    by_number = numbered.select("place", F.col("ord").alias("leader"), F.col("own_id").alias("leader_id"))
    chosen = leads.join(shuffled(led), ["place", "simhash"], "left").withColumn("leader", F.coalesce("leader", "ord")).join(shuffled(by_number), ["place", "leader"]).select("place", "simhash", "leader_id")
    return hashes.join(shuffled(chosen), ["place", "simhash"], "left").select(*block, "id", F.coalesce("leader_id", "id").alias("leader_id"))
