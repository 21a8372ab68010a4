"""Best-fit packing with swap-based local search: token pieces into as few sequences of a fixed length as possible.

Rows first become pieces of at most `capacity` tokens. Pieces are dealt evenly into groups of about `GROUP` by a hash of a
row number, each group is packed by best fit and improved by local search, and what stands in the underfull sequences of
all groups is packed once more together. A group is a bounded unit of work at any input size.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import durable, slices

CAPACITY = 2048
GROUP = 4096  #: pieces that are packed together
IDLE = 8  #: sequences in a row that can't be emptied before the search of a group ends; None: all are tried
OPEN = 1.0  #: share of the capacity under which a sequence is opened and packed once more with those of other groups; 1: all that have room
_encoders: dict[str, bpe.Ids] = {}

PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole capacities from the end, so that only the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted keys of by_room
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([k])
            room, chosen = capacity - size, len(bins) - 1
        else:
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[chosen].append(k)
            room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(chosen)
    return bins


def by_length(members: list[int], lengths: np.ndarray) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for k in members:
        found.setdefault(int(lengths[k]), []).append(k)
    return found


def best_exchange(mine: list[int], other: list[int], room: int, lengths: np.ndarray) -> tuple[int, list[int], list[int]]:
    """What to give `other`, which has `room` left, and what to take back, so that it gains most: (gain, given, taken)."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    own = by_length(mine, lengths)  # a bin has few distinct lengths (64 at most in 2,048), and of one any will do
    gifts = [([some[0]], n) for n, some in own.items()] + [([some[0], some[1]], 2 * n) for n, some in own.items() if len(some) > 1]
    gifts += [([own[a][0], own[b][0]], a + b) for a, b in itertools.combinations(own, 2)]
    returns: list[tuple[list[int], int]] = [([], 0), *(([some[0]], n) for n, some in by_length(other, lengths).items())]
    for given, size in gifts:
        for taken, back in returns if len(given) == 1 else returns[1:]:
            if best[0] < size - back <= room:
                best = (size - back, given, taken)
    return best


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int, idle_most: int | None = IDLE) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges from the emptiest bin into fuller ones.

    Each one takes from the emptier bin and gives to the fuller, so the sum of squared fills grows and the search ends. A
    bin that has given all is gone. It stops at the lower bound, or after `idle_most` bins in a row that nothing could empty (None: when all were tried).
    """
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-sum(fill) // capacity)
    open_bins = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    alive, idle, at = len(bins), 0, 0
    while alive > least and (idle_most is None or idle < idle_most) and at < len(open_bins):
        donor, gone = open_bins[at], False
        for k in sorted(open_bins[at + 1 :], key=lambda k: (fill[k], k)):
            while fill[donor] <= fill[k] < capacity and bins[donor]:
                gain, given, taken = best_exchange(bins[donor], bins[k], capacity - fill[k], lengths)
                if not gain:
                    break
                bins[k] = [x for x in bins[k] if x not in taken] + given
                bins[donor] = [x for x in bins[donor] if x not in given] + taken
                fill[k] += gain
                fill[donor] -= gain
            if not bins[donor]:
                gone = True
                break
        alive -= gone
        idle = 0 if gone else idle + 1
        at += 1
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int, idle: int | None = IDLE) -> tuple[np.ndarray, np.ndarray]:
    """Number of the bin and place in it for each length."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, members in enumerate(empty_bins(best_fit(lengths, capacity), lengths, capacity, idle)):
        members = np.array(members)
        bin_of[members] = number
        offset[members] = np.cumsum(lengths[members]) - lengths[members]
    return bin_of, offset


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each row of `docs`: doc_id, uid (a row number), piece, start, length, ids_crc32.

    A row's ids are those of its whole text followed by id 0; a null or empty text has the id 0 alone.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary)
        if encoder is None:
            encoder = _encoders[vocabulary] = bpe.Ids(definition.value)
        for batch in slices(batches):
            rows = []
            for doc_id, uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encoder.encode(text), 0], "<u4")
                rows += [(doc_id, uid, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(ids), capacity))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "uid", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    numbered = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    return numbered.mapInArrow(cut, PIECES)


def pack_groups(pieces: DataFrame, capacity: int, group: int, idle: int | None = IDLE, deal: int = 0) -> DataFrame:
    """`pieces` (uid, piece, length and more) with bin (number within the group), group and offset; another `deal` mixes them otherwise."""
    n = pieces.count()
    groups = max(1, -(-n // group))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "uid", "piece"], ascending=[False, True, True])
        part["bin"], part["offset"] = pack(part["length"].to_numpy(), capacity, idle)
        return part

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", "piece", F.lit(deal)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(packed, f"{PIECES}, group long, bin long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP, idle: int | None = IDLE, reopened: float = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece, gapless from 0 in each sequence.

    No setting loses a piece; they only decide how long fewer sequences are sought: `idle` (see IDLE; None tries every
    sequence) and `reopened` (see OPEN; 1 packs every sequence with room once more). A text of any length is cut into pieces
    of `capacity`, of which the first may be shorter. Repeated rows and null ids are packed like any row; columns beside doc_id and text don't matter; an empty table packs
    into nothing. Sequence numbers: negative for a piece that fills its sequence alone, else from round, group and bin.
    """
    pieces = durable(token_pieces(docs, vocabulary, capacity))
    whole = pieces.where(F.col("length") == capacity).withColumns({"offset": F.lit(0).cast("long"), "sequence_id": -1 - F.monotonically_increasing_id()})
    first = durable(pack_groups(pieces.where(F.col("length") < capacity), capacity, group, idle))
    per_bin = first.groupBy("group", "bin").agg(F.sum("length").alias("fill"))
    open_bins = per_bin.where(F.col("fill") < int(capacity * reopened)).select("group", "bin")
    rounds = [first.join(open_bins, ["group", "bin"], "left_anti").withColumn("round", F.lit(0))]
    again = first.join(open_bins, ["group", "bin"], "left_semi").drop("group", "bin", "offset")
    rounds.append(pack_groups(durable(again), capacity, group, idle, 1).withColumn("round", F.lit(1)))
    number = (F.col("group") * 2 + F.col("round")) * (1 << 20) + F.col("bin")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return rounds[0].unionByName(rounds[1], allowMissingColumns=True).withColumn("sequence_id", number).select(out).unionByName(whole.select(out))
