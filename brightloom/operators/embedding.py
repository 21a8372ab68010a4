"""Embedders behind one interface, and which line of one set of short texts is nearest to each text of another.

An embedder brings its vectors, its dimension, and the floor and span by which a similarity becomes credit, so a plan that
takes one in differs by nothing else. Embedders are registered by name; a factory may need a library or a model file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import discard, durable, spread
from ..functions.phrases import EMBED_ENDINGS
from ..functions.values import STOP_EMBED
from .ordering import running_before
from .vectors import in_blocks

LEAST_WORDS = 4  #: of a line that is compared at all
CACHE = 50_000  #: short texts whose vectors or answers a worker keeps
BLOCK = 4096  #: lines that are held against the texts at once
WORD = re.compile(r"[a-z0-9+#]+")


@dataclass(frozen=True)
class Embedder:
    """`vectors` gives a matrix of unit rows (zero rows for texts without words) for a list of texts."""

    name: str
    dim: int
    floor: float
    span: float
    vectors: Callable[[list[str]], np.ndarray] = field(compare=False)

    def credit(self, sim: Column) -> Column:
        """0 to 1."""
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim - self.floor) / self.span))


_factories: dict[str, Callable[..., Embedder]] = {}


def register(name: str, factory: Callable[..., Embedder]) -> None:
    _factories[name] = factory


def embedder(name: str, **settings) -> Embedder:
    """The registered embedder of that name; settings go to its factory."""
    if name not in _factories:
        raise KeyError(f"no embedder {name}; there are {', '.join(sorted(_factories))}")
    return _factories[name](**settings)


def stem(word: str) -> str:
    cut = next((e for e in EMBED_ENDINGS if len(word) > len(e) + 3 and word.endswith(e)), "")
    return word[: len(word) - len(cut)]


@dataclass(frozen=True)
class Hashing:
    """Words, pairs of neighbours and runs of four letters, each hashed to a place and a sign."""

    dim: int
    digest: str  #: blake2b of eight bytes read from the least, or md5, whose first eight are read from the greatest

    def place(self, feature: str) -> tuple[int, float]:
        if self.digest == "md5":
            v = int.from_bytes(hashlib.md5(feature.encode(), usedforsecurity=False).digest()[:8], "big")
        else:
            v = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        return v % self.dim, 1.0 if v >> 63 else -1.0

    def features(self, text: str) -> list[tuple[str, float]]:
        words = [stem(w) for w in WORD.findall((text or "").lower()) if w not in STOP_EMBED]
        told = [(f"w:{w}", 1.0) for w in words] + [(f"b:{a}_{b}", 0.7) for a, b in zip(words, words[1:], strict=False)]
        for w in words:
            padded = f"#{w}#"
            told += [(f"c:{padded[k : k + 4]}", 0.25) for k in range(max(1, len(padded) - 3))]
        return told

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for feature, weight in self.features(text):
                at, sign = self.place(feature)
                row[at] += sign * weight
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


register("hash", lambda dim=512: Embedder(f"hash-{dim}", dim, 0.20, 0.35, Hashing(dim, "blake2b")))
register("md5", lambda dim=256: Embedder(f"md5-{dim}", dim, 0.25, 0.40, Hashing(dim, "md5")))


def embedded(text: Column, by: Embedder) -> Column:
    """array<double> of `by.dim` entries for each text; zeros for null texts and those without words. Not for use within a lambda."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = by.vectors(texts.to_pylist())
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * by.dim, pa.array(found.ravel()))

    return vectors(text)


def nearest_line(texts: list[str], vectors: np.ndarray, by: Embedder) -> tuple[np.ndarray, np.ndarray]:
    """For each text the place of the line of largest cosine (ties: the first) and the cosine, to nine places."""
    sims = np.round(by.vectors(texts) @ vectors.T, 9)
    best = sims.argmax(axis=1)
    return best, sims[np.arange(len(texts)), best]


def worth_comparing(lines: list[str], least_words: int = LEAST_WORDS) -> list[str]:
    return [x for x in lines if len(x.split()) >= least_words]


def best_lines_in_row(texts: Column, lines: list[str], by: Embedder) -> Column:
    """array<struct<sim, line>> beside an array of texts: each one's nearest of one person's lines, in the row.

    The lines travel with the function, as one resume has few. Answers are kept by text, as the same lines come up in
    many rows. Without lines sim is 0 and line empty; a null text is like an empty one. Not for use within a lambda.
    """
    kept: dict[str, tuple[float, str]] = {}

    @F.arrow_udf("array<struct<sim: double, line: string>>")
    def best(rows: pa.Array) -> pa.Array:
        vectors = by.vectors(lines) if lines else None
        rows = [[t or "" for t in row or []] for row in rows.to_pylist()]
        new = list(dict.fromkeys(t for row in rows for t in row if t not in kept))
        if len(kept) + len(new) > CACHE:
            kept.clear()
            new = list(dict.fromkeys(t for row in rows for t in row))
        for at in range(0, len(new), BLOCK):
            some = new[at : at + BLOCK]
            if vectors is None:
                kept.update((t, (0.0, "")) for t in some)
            else:
                places, sims = nearest_line(some, vectors, by)
                kept.update((t, (float(s), lines[k])) for t, k, s in zip(some, places.tolist(), sims.tolist(), strict=True))
        told = [[{"sim": kept[t][0], "line": kept[t][1]} for t in row] for row in rows]
        return pa.array(told, pa.list_(pa.struct([("sim", pa.float64()), ("line", pa.string())])))

    return best(texts)


def best_lines(texts: DataFrame, lines: DataFrame, by: Embedder, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """text, line_no, line, sim: for each distinct text (of `texts`: text) the nearest of `lines` (line_no, line); ties by line_no.

    Lines go to the tasks in blocks, one at a time; a block is one pass, which lowers nothing of what earlier blocks found,
    as each text's best so far is written and read again; the lines are written before, so no block works them out again. Lines of fewer words are left out; null texts and lines are
    too; line numbers are unique. Without lines line_no and line are null and sim 0.
    """
    asked = texts.where("text is not null").select("text").distinct()
    best = durable(spread(asked, "text").withColumns({"line_no": F.lit(None).cast("long"), "line": F.lit(None).cast("string"), "sim": F.lit(0.0)}))
    told = durable(lines.where(F.col("line").isNotNull() & (F.size(F.split(F.trim("line"), r"\s+")) >= least_words)).select(F.col("line_no").cast("long").alias("line_no"), "line"))
    for own in in_blocks(told, "line_no", block):
        best, old = durable(best.mapInArrow(running_best(own, by), best.schema)), best
        discard(old)
    discard(told)
    return best


def numbered_lines(lines: DataFrame, line: str) -> DataFrame:
    """line_no (from 1, in the order of the lines) and line; counts of ranges give the numbers, so no task holds all."""
    ranked = running_before(lines.select(F.col(line).alias("line"), F.lit(1).alias("_n")), [], "line", "_n")
    return ranked.select((F.col("before") + 1).alias("line_no"), "line")


def running_best(shared, by: Embedder):
    """The best so far against the lines of one broadcast block."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, lines = (shared.value.column(c).to_pylist() for c in ("line_no", "line"))
        order = np.argsort(np.array(numbers), kind="stable")
        numbers, lines = [numbers[k] for k in order], [lines[k] for k in order]
        vectors = by.vectors(lines)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                places, sims = nearest_line(part.column("text").to_pylist(), vectors, by)
                rows = []
                for was, k, sim in zip(part.to_pylist(), places.tolist(), sims.tolist(), strict=True):
                    ahead = was["line_no"] is None or sim > was["sim"] or (sim == was["sim"] and numbers[k] < was["line_no"])
                    rows.append({"text": was["text"], "line_no": numbers[k], "line": lines[k], "sim": sim} if ahead else was)
                yield pa.RecordBatch.from_pylist(rows, part.schema)

    return compared
