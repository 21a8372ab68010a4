"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a logistic classifier over character n-grams tells which side a
text is on; the language whose codeword loses least is chosen, each bit's loss weighted by how well that bit was predicted
for that language in training, and close calls are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, unused
from .words import MULTIPLIER, PIECE, code_points, mixed

UNKNOWN = "und"
ORDERS = (1, 2, 3)  #: characters of an n-gram
BITS = 12  #: an order's n-grams fall into 2 ** BITS buckets
PER_LANGUAGE = 400  #: expected rows of a language in the training sample; the documented bound of the fit
EXHAUSTIVE = 7  #: languages up to which the code has every bipartition
STEPS, RATE, DECAY = 200, 2.0, 1e-4
AMBIGUOUS = 0.25  #: margin of the best language's score over the next below which a text is ambiguous
UNDECIDED = 0.05  #: and below which the filter rejects it


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-gram shares of the whole text, by order and bucket; None if it has no letter.

    The text is lower-cased and whatever stands between letters is one space.
    """
    points = code_points((text or "").lower())
    inside = letters()[points]
    if not inside.any():
        return None
    points = np.where(inside, points, np.uint32(32))[inside | np.append(True, inside[:-1])].astype(np.uint64)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    out = np.zeros((len(ORDERS), 1 << BITS))
    for at in range(0, len(points), PIECE):
        for row, n in zip(out, ORDERS, strict=True):
            part = points[at : at + PIECE + n - 1]
            if len(part) < n:
                continue
            grams = part[: len(part) - n + 1]
            for k in range(1, n):
                grams = grams * MULTIPLIER + part[k : len(part) - n + 1 + k]
            row += np.bincount((mixed(grams) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32).ravel()


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of `k` classes: every bipartition for a few, else the best spread of some random codes."""
    if k < 2:
        return np.ones((k, 0))
    if k <= EXHAUSTIVE:
        sides = (np.arange(1, 1 << (k - 1))[None, :] >> np.arange(k)[:, None]) & 1
        return sides * 2.0 - 1
    rng, length = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    drawn = (rng.integers(0, 2, (k, length)) * 2.0 - 1 for _ in range(200))
    apart = lambda code: (length - (code @ code.T - 2 * length * np.eye(k)).max()) / 2
    return max((c for c in drawn if (abs(c.sum(axis=0)) < k).all()), key=apart)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    trust: np.ndarray  # language x bit; a language's row sums to 1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Scores of the languages for each row of features; they sum to 1."""
        if not self.code.shape[1]:
            return np.ones((len(rows), len(self.languages)))
        margins = rows @ self.weights + self.bias
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]).sum(axis=2)
        score = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        return score / score.sum(axis=1, keepdims=True)


def fit(rows: np.ndarray, language: np.ndarray, languages: list[str]) -> Model:
    """Logistic classifiers of all bits at once by gradient descent with momentum; languages weigh alike."""
    code = codewords(len(languages))
    wanted = code[language]
    weight = 1 / np.bincount(language, minlength=len(languages))[language]
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    wanted = wanted.astype(np.float32)  # all in single precision: rows would be copied in each step else
    w, b = np.zeros((rows.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        pull = -wanted * weight / (1 + np.exp(np.clip(wanted * (rows @ w + b), -50, 50)))
        vw = np.float32(0.9) * vw + rows.T @ pull + np.float32(DECAY) * w
        vb = np.float32(0.9) * vb + pull.sum(axis=0)
        w, b = w - np.float32(RATE) * vw, b - np.float32(RATE) * vb
    right = (np.sign(rows @ w + b) == wanted).astype(float)
    trust = np.stack([right[language == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
    return Model(languages, code, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12), w.astype(np.float32), b)


def train(docs: DataFrame, usable, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from text and lang of the rows of `docs` that are `usable`, or None if no such row has a language and a letter.

    It is fitted on a sample by hash of about `per_language` rows of each language, or all if there are fewer.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    counts = dict(sorted((r[0], r[1]) for r in labelled.groupBy("lang").count().collect()))
    if not counts:
        return None
    share = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], per_language / kv[1]), counts.items(), F)
    drawn = labelled.where(F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) < share.otherwise(0.0) * (1 << 30))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = [(lang, x) for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True) if (x := features(text)) is not None]
            places = [np.flatnonzero(x) for _, x in told]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in told], pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array([x[p] for (_, x), p in zip(told, places, strict=True)], pa.list_(pa.float32()))],
                ["lang", "place", "value"],
            )

    found = drawn.select("lang", "text").mapInArrow(measured, "lang string, place array<int>, value array<float>").toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    rows = np.zeros((found.num_rows, len(ORDERS) << BITS), np.float32)
    for k, (place, value) in enumerate(zip(found.column("place"), found.column("value"), strict=True)):
        rows[k, place.values.to_numpy()] = value.values.to_numpy()
    return fit(rows, np.array([number[x] for x in found.column("lang").to_pylist()]), languages)


def identified(docs: DataFrame, model: Model | None, out: str = "_language") -> DataFrame:
    """`docs` with struct `out`: lang (`und` for texts that are null or have no letter), score, margin, runner_up and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, margin double, runner_up string, ambiguous boolean")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in parts:
            rows: list[tuple] = []
            for at in range(0, len(part), 128):
                found = [features(t) if model else None for t in part.iloc[at : at + 128]]
                known = [x for x in found if x is not None]
                scores = iter(model.decode(np.stack(known))) if known else iter(())
                for x in found:
                    if x is None:
                        rows.append((UNKNOWN, 0.0, 0.0, None, True))
                        continue
                    score = next(scores)
                    first, *rest = np.argsort(-score, kind="stable")
                    second = float(score[rest[0]]) if rest else 0.0
                    margin = float(score[first]) - second
                    rows.append((model.languages[first], float(score[first]), margin, model.languages[rest[0]] if rest else None, margin < AMBIGUOUS))
            yield pd.DataFrame(rows, columns=["lang", "score", "margin", "runner_up", "ambiguous"])

    return docs.withColumn(out, told("text"))


HELD_OUT = 4, 2  #: rows whose crc32 of the id leaves 2 modulo 4 are never learned from


def usable_rows():
    return F.coalesce(remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1], F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up, ambiguous: a row for each row of `docs`, repeated ones too.

    Whole texts are judged by their characters alone. A null id is neither learned from nor held out. With nothing to
    learn from, every language is `und`.
    """
    docs = docs.select("doc_id", "text", "lang")
    judged = identified(docs.select("doc_id", "text"), train(docs, usable_rows()))
    held = F.coalesce(remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"), F.col("_language.runner_up").alias("runner_up"), F.col("_language.ambiguous").alias("ambiguous"))


def keep_known_language(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, without rows whose language can't be told: no letter, or the best language all but tied with the next.

    So null, empty and letterless texts go; repeated rows stay or go together; an empty table stays empty, and without
    any row to learn from every row goes. Columns of clashing names are kept.
    """
    name = unused(docs, "_language")
    judged = identified(docs, train(docs, usable_rows()), name)
    return judged.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.margin") >= UNDECIDED)).drop(name)
