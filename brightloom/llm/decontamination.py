"""Benchmark decontamination by latent semantic retrieval.

A randomised SVD of the TF-IDF matrix of all corpus passages gives a latent space. In it windows of documents are held
against passages of benchmark items by cosine; what is close and shares enough words is checked by the longest common
subsequence of words, and weaker matches, as of paraphrases, also by the item's answer. A place where SEED words of a
passage stand in a row is checked too, whatever its cosine, so no copy that keeps such a run hangs on the projection.

Windows that can't pass the check aren't projected: a subsequence that holds a share WEAK of a passage of n words misses
so few of them that of the passage's n - WEAK * n + KEYS rarest words at least KEYS stand near. These keys are looked up
word by word, so the cost follows the places where a passage's rare words meet, not documents times benchmark.

The SVD is the one-pass kind for A'A: every partition adds up TF'(TF G) for a random G while it counts passages of each
word, sums of both are rows that Spark aggregates, and the driver factors two small matrices (Nystroem's approximation).
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, unused
from .words import MULTIPLIER, hashes_of, mixed, word_hashes

BITS = 13  #: words fall into 2 ** BITS columns of the TF-IDF matrix
RANK, SPARE = 48, 8  #: dimensions of the latent space, and those that the sketch has besides
STRIDE = 4  #: words between the starts of windows
SCALES = (8, 12, 16, 24, 32)  #: words of a window; a passage is sought with those nearest to its length
PASSAGES = (16, 32)  #: most words of a passage; items of under 24 words have the smaller ones
SLACK = 8  #: words on both sides of a window that are held against a passage too
SEED = 5  #: words in a row that make a place a candidate without a cosine
KEYS = 4  #: of a passage's rarest words, so many stand near any place that can pass
COSINE = 0.65  #: of a candidate
STRONG, WEAK = 0.85, 0.6  #: share of a passage in the common subsequence that proves a copy, and that asks for the answer
ANSWER = 0.6  #: share of an answer's words that must stand near
SHORTEST = 8  #: items of fewer words must stand as a run of just these words
A_GO = 50_000  #: passages that are sought in one go, some 40 MB; more take more goes over the texts
CHUNK = 1 << 15  #: words of a text that are projected at once
MATCHES = "array<struct<item_id: long, kind: string, cosine: double, common: double, answer: double, start_word: int, end_word: int>>"


def columns_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def test_matrix() -> np.ndarray:
    return np.random.default_rng(20_240_602).standard_normal((1 << BITS, RANK + SPARE)).astype(np.float32)


def sketch(docs: DataFrame, passage: int = max(PASSAGES)) -> tuple[np.ndarray, np.ndarray, int]:
    """Passages that hold each column's words, TF'(TF G), and the number of passages, over whole texts of all rows."""
    names = [f"s{k}" for k in range(RANK + SPARE)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s, held, n = np.pad(test_matrix(), ((0, 1), (0, 0))), np.zeros((1 << BITS, RANK + SPARE)), np.zeros(1 << BITS, np.int64), 0

        def parts() -> Iterator[np.ndarray]:
            nonlocal n
            for batch in slices(batches, 64):
                for whole in hashes_of(batch.column(0).to_pylist()):
                    n += -(-len(whole) // passage)
                    yield from (whole[a : a + CHUNK] for a in range(0, len(whole), CHUNK))  # CHUNK is a multiple of passage

        for group in groups_of(parts()):
            lengths = np.array([len(w) for w in group])
            rows = -(-lengths // passage)  # passages of each part; the last is filled up with a column that counts nothing
            column = np.full(int(rows.sum()) * passage, 1 << BITS)
            ahead = np.repeat(passage * (np.cumsum(rows) - rows) - (np.cumsum(lengths) - lengths), lengths)
            column[ahead + np.arange(len(ahead))] = columns_of(np.concatenate(group))
            seen = np.einsum("ijk->ik", g[column].reshape(-1, passage, RANK + SPARE))
            order = np.argsort(column.astype(np.int16), kind="stable")[: len(ahead)]
            column, window = column[order], order // passage
            first = np.flatnonzero(np.diff(column, prepend=-1))
            s[column[first]] += summed_by(seen, window, first)
            new = (np.diff(column, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0)
            held += np.bincount(column[new], minlength=1 << BITS)
        there = np.flatnonzero(held)
        sums = [pa.array(np.append(s[there, k], 0.0)) for k in range(RANK + SPARE)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(held[there], n)), *sums], ["place", "held", *names])

    rows = docs.select("text").where("text is not null").mapInArrow(summed, ", ".join(["place long", "held long", *(f"{c} double" for c in names)]))
    found = rows.groupBy("place").agg(F.sum("held").alias("held"), *(F.sum(c).alias(c) for c in names)).toArrow()  # 2 ** BITS + 1 rows at most
    held, s, n = np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS, RANK + SPARE)), 0
    place, count = found.column("place").to_numpy(), found.column("held").to_numpy()
    real = place >= 0
    held[place[real]] = count[real]
    for k, c in enumerate(names):
        s[place[real], k] = found.column(c).to_numpy()[real]
    return held, s, int(count[~real].sum())


def summed_by(rows: np.ndarray, at: np.ndarray, first: np.ndarray, lanes: int = 16) -> np.ndarray:
    """Sums of rows[at] from each of `first` to the next: lanes of them are added up as blocks, which is the quicker way."""
    length = np.diff(np.append(first, len(at)))
    blocks = -(-length // lanes)
    begin = np.cumsum(blocks) - blocks
    padded = np.full(int(blocks.sum()) * lanes, len(rows))
    padded[np.repeat(begin * lanes - first, length) + np.arange(len(at))] = at
    some = np.pad(rows, ((0, 1), (0, 0)))[padded].reshape(-1, lanes, rows.shape[1])
    return np.add.reduceat(np.einsum("ijk->ik", some), begin)


def groups_of(parts: Iterator[np.ndarray], most: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Consecutive parts of `most` words together, or a little more."""
    group, n = [], 0
    for part in parts:
        group.append(part)
        n += len(part)
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def latent(held: np.ndarray, s: np.ndarray, passages: int) -> np.ndarray:
    """Each column's place in the latent space, times its inverse document frequency.

    The sketch is Y = D TF'TF G = A'A (D^-1 G) with D the inverse document frequencies, so A'A is about Y (G'S)^-1 Y', whose
    leading eigenvectors, the right singular vectors of A, span the space.
    """
    idf = np.maximum(0.1, np.log((1 + passages) / (1 + held)) - 1)
    idf[held == 0] = 0
    core = test_matrix().astype(float).T @ s
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value[-1], 0) * 1e-9
    if not keep.any():
        return np.zeros((1 << BITS, RANK), np.float32)
    root = (s * idf[:, None]) @ (vector[:, keep] / np.sqrt(value[keep]))
    left, _, _ = np.linalg.svd(root, full_matrices=False)
    out = np.zeros((1 << BITS, RANK))
    out[:, : min(RANK, left.shape[1])] = left[:, :RANK]
    return (out * idf[:, None]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of `words` and the n words whose places `masks` has as bits."""
    full = (1 << n) - 1
    free = full
    for w in words:
        if hit := masks.get(w, 0) & free:
            free = ((free + hit) | (free - hit)) & full
    return n - free.bit_count()


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total = total * MULTIPLIER + words[k : len(words) - n + 1 + k]
    return mixed(total)


def answer_words(text: str) -> np.ndarray:
    """Words of the item's last sentence, or of its last quarter if it has but one."""
    sentences = [w for s in re.split(r"[.!?]+(?:\s+|$)", text) if len(w := word_hashes(s))]
    if len(sentences) > 1:
        return sentences[-1]
    whole = word_hashes(text)
    return whole[len(whole) * 3 // 4 :]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage of each item: the item, its passage's words, and with the first of them the answer's words."""
    for batch in slices(batches):
        rows: list[tuple] = []
        for row, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "text")), strict=True):
            words = word_hashes(text)
            if not len(words):
                continue
            most = len(words) if len(words) < SHORTEST else next((n for n in PASSAGES if len(words) < n * 3 // 2), PASSAGES[-1])
            last = max(0, len(words) - most)
            for at in sorted({*range(0, last, max(1, most // 2)), last}):
                rows.append((row, item_id, len(words), words[at : at + most].tobytes(), np.unique(answer_words(text)).tobytes() if not at else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row", "item_id", "reach", "words", "answer"])


@dataclass
class Index:
    """Passages that are sought together, as flat arrays; the words of passage p are words[start[p] : start[p + 1]]."""

    item: np.ndarray  # of each passage, the number of its item
    ids: list[int | None]  # of each item
    reach: np.ndarray  # words of each item
    answers: list[frozenset[int]]
    words: np.ndarray
    start: np.ndarray
    scale: np.ndarray  # words of the windows that are held against the passage
    vectors: np.ndarray
    keys: np.ndarray  # sorted words that are key of some passage
    keyed: np.ndarray  # passages of all keys; those of key k are keyed[key_at[k] : key_at[k + 1]]
    key_at: np.ndarray
    maybe: np.ndarray  # for the top bits of a word whether it can be a key
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # number of words -> sorted hashes of items of so many, numbers of these
    masks: dict[int, tuple[dict[int, int], frozenset[int], dict[int, list[int]]]] = field(default_factory=dict)

    def of(self, p: int) -> tuple[dict[int, int], frozenset[int], dict[int, list[int]]]:
        """Places of the passage's words as bits, its distinct words, and the places of its runs of SEED words."""
        if p not in self.masks:
            words, masks = self.words[self.start[p] : self.start[p + 1]], {}
            for k, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << k
            seeds: dict[int, list[int]] = {}
            for k, h in enumerate(run_hash(words, SEED).tolist()):
                seeds.setdefault(h, []).append(k)
            self.masks[p] = masks, frozenset(masks), seeds
        return self.masks[p]


TOP = 44  #: bits of a word that `Index.maybe` leaves out


def index_passages(rows: pa.Table, space: np.ndarray, held: np.ndarray) -> Index:
    numbers = {r: k for k, r in enumerate(dict.fromkeys(rows.column("row").to_pylist()))}
    ids: list[int | None] = [None] * len(numbers)
    reach, answers = np.zeros(len(numbers), np.int64), [frozenset()] * len(numbers)
    item, parts, short = [], [], {}
    for row, item_id, n, words, answer in zip(*(rows.column(c).to_pylist() for c in ("row", "item_id", "reach", "words", "answer")), strict=True):
        k = numbers[row]
        ids[k], reach[k] = item_id, n
        if answer is not None:
            answers[k] = frozenset(np.frombuffer(answer, np.uint64).tolist())
        words = np.frombuffer(words, np.uint64)
        if n < SHORTEST:
            short.setdefault(n, []).append((int(run_hash(words, n)[0]), k))
        else:
            item.append(k)
            parts.append(words)
    start = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    scale = np.array([min(SCALES, key=lambda s: abs(s - len(w))) for w in parts], np.int64)
    vectors = np.array([space[columns_of(w)].sum(axis=0) for w in parts], np.float32).reshape(-1, RANK)
    key, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for p, w in enumerate(parts):
        rarest = np.unique(w[np.argsort(held[columns_of(w)], kind="stable")[: len(w) - math.ceil(WEAK * len(w)) + KEYS]])
        key.append(rarest)
        owner.append(np.full(len(rarest), p))
    flat_key, flat_owner = np.concatenate(key), np.concatenate(owner)
    order = np.argsort(flat_key, kind="stable")
    keys, first = np.unique(flat_key[order], return_index=True)
    maybe = np.zeros(1 << (64 - TOP), bool)
    maybe[(keys >> np.uint64(TOP)).astype(np.int64)] = True
    runs = {n: (np.array([h for h, _ in sorted(some)], np.uint64), np.array([k for _, k in sorted(some)])) for n, some in short.items()}
    return Index(np.array(item, np.int64), ids, reach, answers, flat, start, scale, unit(vectors), keys, flat_owner[order], np.append(first, len(flat_key)), maybe, runs)


def repeated_ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and for each the number of its range."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - (np.cumsum(n) - n)[which] + begin[which], which


def places(texts: list[np.ndarray], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Number of the text, passage, first and last word of each stretch where KEYS of the passage's keys are near each other."""
    if not texts or not len(index.keys):
        return
    words, begins = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    at = np.flatnonzero(index.maybe[(words >> np.uint64(TOP)).astype(np.int64)])
    key = np.minimum(np.searchsorted(index.keys, words[at]), len(index.keys) - 1)
    real = index.keys[key] == words[at]
    at, key = at[real], key[real]
    apart = int(max(SCALES)) + 2 * SLACK  # texts are laid so far from each other
    at += np.repeat(np.arange(len(texts)) * apart, np.diff(np.searchsorted(at, begins)))
    entry, which = repeated_ranges(index.key_at[key], index.key_at[key + 1])
    passage, at = index.keyed[entry], at[which]
    order = np.argsort(passage.astype(np.int32), kind="stable")  # `at` ascends already
    passage, at = passage[order], at[order]
    if len(at) < KEYS:
        return
    span = (np.maximum(index.scale, np.diff(index.start)) + 2 * SLACK)[passage]
    begin, end = slice(None, len(at) - KEYS + 1), slice(KEYS - 1, None)
    near = np.flatnonzero((passage[begin] == passage[end]) & (at[end] - at[begin] < span[begin]))
    if not len(near):
        return
    first, last, which, span = at[near], at[near + KEYS - 1], passage[near], span[near]
    new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (first[1:] > last[:-1] + span[1:])))
    first, last, which = first[new], last[np.append(new[1:], len(near)) - 1], which[new]
    laid = begins + np.arange(len(begins)) * apart
    text = np.searchsorted(laid, first, "right") - 1
    yield from zip(text.tolist(), which.tolist(), (first - laid[text]).tolist(), (last - laid[text]).tolist(), strict=True)


def sums_over(blocks: np.ndarray, n: int) -> np.ndarray:
    """The sum of each run of n consecutive blocks; runs that the end cuts short only if there are fewer blocks than n."""
    total = np.concatenate([np.zeros((1, blocks.shape[1])), np.cumsum(blocks, axis=0, dtype=float)])
    n = min(n, len(blocks))
    return (total[n:] - total[:-n]).astype(np.float32)


def found_in(texts: list[np.ndarray], index: Index, space: np.ndarray) -> list[list[dict]]:
    """For each text the best match of each item that it holds."""
    best: list[dict[int, dict]] = [{} for _ in texts]

    def offer(text: int, item: int, kind: str, cosine: float, common: float, answer: float, start: int, end: int) -> None:
        old = best[text].get(item)
        if old is None or (kind == "copy", common, cosine) > (old["kind"] == "copy", old["common"], old["cosine"]):
            best[text][item] = {"item_id": index.ids[item], "kind": kind, "cosine": cosine, "common": common, "answer": answer, "start_word": start, "end_word": end}

    for n, (known, item) in index.runs.items():
        for text, words in enumerate(texts):
            hashes = run_hash(words, n)
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            for at in np.flatnonzero(low < high).tolist():
                for k in item[low[at] : high[at]].tolist():
                    offer(text, k, "copy", 1.0, 1.0, 1.0, at, at + n)

    def can_be(p: int, n: int, nearby: list[int]) -> bool:
        """Words of the passage that aren't there can't be in a common subsequence."""
        masks, distinct, _ = index.of(p)
        return n - (len(masks) - len(distinct.intersection(nearby))) >= WEAK * n

    def check(text: int, p: int, n: int, start: int, end: int, cosine: float) -> None:
        words = texts[text]
        start, end = max(0, start), min(len(words), end)
        nearby = words[start:end].tolist()
        if not can_be(p, n, nearby):
            return
        common = common_length(index.of(p)[0], n, nearby) / n
        if common < WEAK:
            return
        item = int(index.item[p])
        old = best[text].get(item)
        if old and (old["kind"] == "copy", old["common"], old["cosine"]) >= (common >= STRONG, common, cosine):
            return
        wanted, reach = index.answers[item], int(index.reach[item])
        answer = len(wanted.intersection(words[max(0, start - reach) : end + reach].tolist())) / len(wanted)
        if common >= STRONG or answer >= ANSWER:
            offer(text, item, "copy" if common >= STRONG else "paraphrase", cosine, common, answer, start, end)

    for text, p, first, last in places(texts, index):
        words = texts[text]
        own, scale = index.words[index.start[p] : index.start[p + 1]], int(index.scale[p])
        n = len(own)
        span = max(n, scale) + SLACK
        vector = index.vectors[p]
        low, high = max(0, first - span) // STRIDE * STRIDE, min(len(words), last + span + SLACK)
        for begin in range(low, high, CHUNK):
            part = words[begin : min(high, begin + CHUNK + scale)]
            if begin > low and len(part) <= scale:
                break  # the chunk before has held it
            if not can_be(p, n, part.tolist()):
                continue
            starts = np.arange(0, len(part), STRIDE)
            cosines = unit(sums_over(np.add.reduceat(space[columns_of(part)], starts), scale // STRIDE)) @ vector
            for a in np.flatnonzero(cosines >= COSINE).tolist():
                at = begin + a * STRIDE
                check(text, p, n, at - SLACK, at + span, float(cosines[a]))
            seeds = index.of(p)[2]
            for at in dict.fromkeys(begin + h - k for h, run in enumerate(run_hash(part, SEED).tolist()) for k in seeds.get(run, ())):
                window = words[max(0, at) : max(0, at) + scale]
                check(text, p, n, at - SLACK, at + n + SLACK, float(unit(space[columns_of(window)].sum(axis=0)[None])[0] @ vector))
    return [sorted(b.values(), key=lambda m: (m["item_id"] is None, m["item_id"])) for b in best]


def goes(docs: DataFrame, benchmark: DataFrame) -> tuple[int, Iterator[Column]]:
    """How many goes there are, and a column for each: of each row's whole text the benchmark items of that go that it holds, as array of MATCHES; empty for null and empty texts.

    Items without words are never held. Items whose id is null or no number are sought like others, with a null item_id;
    of rows with one item_id each gives its match. Passages are cut and indexed by Spark jobs, A_GO to a go: an item's
    passages stay in one go, so a go is bounded by A_GO and by the longest item. The driver passes on one go's index at a
    time, and releases it when the next column is asked for: what a column is used for must be worked out before, unless it
    is the only one.
    """
    spark = docs.sparkSession
    held, sums, passages = sketch(docs)
    space = latent(held, sums, passages)
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.expr("try_cast(item_id as bigint)").alias("item_id"), "text").where("text is not null")
    parts = durable(items.mapInArrow(cut, "row long, item_id long, reach long, words binary, answer binary"))
    n = -(-parts.count() // A_GO)
    shared = spark.sparkContext.broadcast((space, held))

    def indexed(rows: pa.Table) -> pa.Table:
        index = index_passages(rows, *shared.value)
        return pa.table({"go": pa.array([rows.column("go")[0].as_py()], pa.int64()), "index": pa.array([pickle.dumps(index, 5)], pa.binary())})

    def columns() -> Iterator[Column]:
        dealt = parts.withColumn("go", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long"))
        indexes = durable(dealt.groupBy("go").applyInArrow(indexed, "go long, index binary"))
        for go in range(n):
            for row in indexes.where(F.col("go") == go).select("index").toLocalIterator():
                sought = spark.sparkContext.broadcast((pickle.loads(bytes(row["index"])), space))
                yield seeker(sought)("text")
                if n > 1:
                    sought.unpersist()

    return n, columns() if n else iter(())


def seeker(shared):
    @F.pandas_udf(MATCHES)
    def seek(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, space = shared.value
        for part in parts:
            yield pd.Series([m for group in groups_of(hashes_of(part)) for m in found_in(group, index, space)], dtype=object)

    return seek


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, cosine, common, answer, start_word, end_word: a row for each item that a row's text holds.

    Rows of `docs` that hold none give no row; repeated rows give their rows each; null ids stay null. With more than one
    go each one's rows are written before the next.
    """
    docs, found = docs.select("doc_id", "text"), []
    n, columns = goes(docs, benchmark)
    for column in columns:
        # an outer explode: of an inner one Spark infers a filter on the array, and would seek twice
        told = docs.withColumn("match", column).select("doc_id", F.explode_outer("match").alias("match")).where("match is not null").select("doc_id", "match.*")
        found.append(durable(told) if n > 1 else told)
    none = docs.select("doc_id", F.array().cast(MATCHES).alias("match")).select("doc_id", F.inline("match"))
    return reduce(DataFrame.unionByName, found) if found else none


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, all columns, without rows whose text holds a benchmark item.

    Null and empty texts hold none and stay, as all rows do if the benchmark is empty or has null and empty items alone;
    repeated rows stay or go together; an empty table stays empty. Columns of clashing names are kept. With more than one
    go the rows that one leaves are written and read by the next.
    """
    name, left = unused(docs, "_match"), docs
    n, columns = goes(docs, benchmark)
    for column in columns:
        kept = left.withColumn(name, column).where(F.size(name) == 0).drop(name)
        left = durable(kept) if n > 1 else kept
    return left
