"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens of toxic documents are labelled first: those with a feature (the word or a prefix of
it) that toxic documents hold far more often than clean ones. A two-state chain is fitted on windows of such tokens.
Forward-backward marginals over each whole text then give offending offsets. Their sum, the largest of them and the text's
length give the document's score, through a logistic fitted on documents that the chain hasn't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, unused
from .words import mixed, shingles

SAMPLE = {1: 1500, 0: 4500}  #: expected training documents by label; the documented bound of the fit
CALIBRATION = {1: 500, 0: 1000}  #: documents by label on which the score is fitted
PREFIXES = (3, 4, 5, 6)
WINDOW = 40  #: tokens of a training sequence
CHAIN = {1: 600, 0: 600}  #: of these so many documents by label teach the chain, with their whole texts
SLICE = 4096  #: training sequences that are worked on at once
SURPRISE = 30.0  #: log-likelihood ratio from which a feature marks toxic tokens
LIFT = 8.0  #: and how many times as often toxic documents have it
STEPS, RATE, DECAY = 80, 0.3, 1e-3
LEAST = 0.05  #: marginals below say nothing about the document
SPAN = 0.5  #: marginal from which a token is an offending span
THRESHOLD = 0.7  #: score from which a document is toxic
BLOCK = 64  #: tokens of a block of the parallel scan
CACHE = 300_000  #: tokens whose emission a worker keeps
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def token_features(token: str) -> list[str]:
    """The lower-cased word without marks at its ends, and its prefixes; none for a token without letters or digits."""
    word = EDGES.sub("", token).lower()
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []


@dataclass
class Field:
    """Weights of the state `toxic` against `clean` by feature, and of the chain: start[j], step[i, j]."""

    weights: dict[str, float]
    bias: float
    start: np.ndarray
    step: np.ndarray
    document: np.ndarray | None = None  # weights of document_features
    kept: dict[str, float] = field(default_factory=dict, repr=False)

    def emission(self, token: str) -> float:
        found = self.kept.get(token)
        if found is None:
            found = min(30.0, max(-30.0, self.bias + sum(self.weights.get(f, 0.0) for f in token_features(token))))
            if len(token) < 64:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[token] = found
        return found

    def emissions(self, tokens: list[str]) -> list[float]:
        return [x if (x := self.kept.get(t)) is not None else self.emission(t) for t in tokens]


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of a row of texts; `first` marks where a text begins.

    Exact over whole texts of any length: blocks of tokens are multiplied out side by side, a walk over the blocks gives
    what enters each from either end, and all blocks are filled in together.
    """
    n = len(emission)
    blocks = -(-n // BLOCK)
    e = np.ones(blocks * BLOCK)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    reset = np.ones(blocks * BLOCK, bool)
    reset[:n] = first
    e, reset = e.reshape(blocks, BLOCK).T, reset.reshape(blocks, BLOCK).T
    t, s = np.exp(step), np.exp(start)
    # the matrix of a token: [i, j] = t[i, j] (or s[j] at a text's start) times e for j = 1
    m = [[np.where(reset, s[j], t[i, j]) * (e if j else 1.0) for j in (0, 1)] for i in (0, 1)]
    p = [[np.full(blocks, float(i == j)) for j in (0, 1)] for i in (0, 1)]
    for k in range(BLOCK):
        p = [[p[i][0] * m[0][j][k] + p[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]
        scale = 1 / np.maximum(p[0][0] + p[0][1], p[1][0] + p[1][1])
        p = [[x * scale for x in row] for row in p]
    flat = np.array(p).transpose(2, 0, 1).tolist()
    enter, leave = np.empty((blocks, 2)), np.empty((blocks, 2))
    a = (0.5, 0.5)
    for b in range(blocks):
        enter[b] = a
        (q, r), (u, v) = flat[b]
        x, y = a[0] * q + a[1] * u, a[0] * r + a[1] * v
        a = (x / (x + y), y / (x + y))
    a = (0.5, 0.5)
    for b in range(blocks - 1, -1, -1):
        leave[b] = a
        (q, r), (u, v) = flat[b]
        x, y = q * a[0] + r * a[1], u * a[0] + v * a[1]
        a = (x / (x + y), y / (x + y))
    ahead = np.empty((BLOCK, 2, blocks))
    x, y = enter.T
    for k in range(BLOCK):
        x, y = x * m[0][0][k] + y * m[1][0][k], x * m[0][1][k] + y * m[1][1][k]
        total = x + y
        x, y = x / total, y / total
        ahead[k] = x, y
    out = np.empty((BLOCK, blocks))
    x, y = leave.T
    for k in range(BLOCK - 1, -1, -1):
        clean, toxic = ahead[k, 0] * x, ahead[k, 1] * y
        out[k] = toxic / (clean + toxic)
        x, y = m[0][0][k] * x + m[0][1][k] * y, m[1][0][k] * x + m[1][1][k] * y
        total = x + y
        x, y = x / total, y / total
    return out.T.ravel()[:n]


def document_features(model: Field, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text 1, the log of its summed marginals, the largest one's log-odds, the log of its length; all marginals; texts' ends."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(lengths)
    first = np.zeros(int(lengths.sum()), bool)
    first[(ends - lengths)[lengths > 0]] = True
    p = np.zeros(0)
    if len(first):
        p = marginals(np.array([x for t in tokens for x in model.emissions(t)]), first, model.start, model.step)
    owner = np.repeat(np.arange(len(tokens)), lengths)
    telling = np.flatnonzero(p >= LEAST)
    total = np.bincount(owner[telling], p[telling], len(tokens))
    most = np.full(len(tokens), 1e-5)
    np.maximum.at(most, owner[telling], p[telling])
    most = np.minimum(most, 1 - 1e-5)
    return np.stack([np.ones(len(tokens)), np.log(total + 0.01), np.log(most / (1 - most)) / 4, np.log1p(lengths)], 1), p, ends


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.2] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge, slope)
    return w


def apart(texts: list[str]) -> list[int]:
    """Places of texts that share none of three MinHash values with an earlier one, so that copies don't count as evidence."""
    seen: list[set[int]] = [set(), set(), set()]
    found = []
    for k, text in enumerate(texts):
        grams = shingles(text)
        least = [int(mixed(grams + np.uint64(j)).min()) for j in range(3)] if len(grams) else []
        if least and not any(v in s for v, s in zip(least, seen, strict=True)):
            found.append(k)
        for v, s in zip(least, seen, strict=False):
            s.add(v)
    return found


def marking(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> set[str]:
    """Features that toxic documents have significantly and far more often than clean ones."""
    found = set()
    share = n_toxic / (n_toxic + n_clean)
    for feature, a in toxic.items():
        b = clean.get(feature, 0)
        expected = (a + b) * share
        surprise = 2 * (a * np.log(a / expected) + (b * np.log(b / (a + b - expected)) if b else 0))
        if surprise >= SURPRISE and (a + 0.5) / n_toxic >= LIFT * (b + 0.5) / n_clean:
            found.add(feature)
    return found


def chain_slice(tokens: list[list[str]], states: list[np.ndarray], number: dict[str, int]) -> tuple:
    """Of some sequences: which places are real, their states, and the features of each place."""
    rows, width = len(tokens), WINDOW
    real = np.zeros((rows, width), bool)
    y = np.zeros((rows, width), np.int64)
    place, which = [], []
    for r, window in enumerate(tokens):
        real[r, : len(window)] = True
        y[r, : len(window)] = states[r]
        for c, token in enumerate(window):
            mine = [number[f] for f in token_features(token) if f in number]
            which += mine
            place += [r * width + c] * len(mine)
    return real, y, np.array(place, np.int64), np.array(which, np.int64)


def chain_gradient(part: tuple, w: np.ndarray, chain: np.ndarray, start: np.ndarray, bias: float) -> tuple:
    """The likelihood's gradient over some sequences by feature, step, start and bias: what is labelled less what is expected."""
    real, y, place, which = part
    rows, width = real.shape
    both = real[:, 1:] & real[:, :-1]
    e = np.bincount(place, w[which], rows * width).reshape(rows, width) + bias
    up, t, s = np.exp(np.clip(e, -30, 30)), np.exp(chain), np.exp(start)
    alpha, beta = np.empty((width, rows, 2)), np.ones((width, rows, 2))
    x = np.stack([np.full(rows, s[0]), s[1] * up[:, 0]], 1)
    alpha[0] = x / x.sum(1, keepdims=True)
    for k in range(1, width):
        x = alpha[k - 1] @ t
        x[:, 1] *= up[:, k]
        x /= x.sum(1, keepdims=True)
        alpha[k] = np.where(real[:, k, None], x, alpha[k - 1])
    for k in range(width - 2, -1, -1):
        x = beta[k + 1].copy()
        x[:, 1] *= up[:, k + 1]
        x = x @ t.T
        x /= x.sum(1, keepdims=True)
        beta[k] = np.where(real[:, k + 1, None], x, 1.0)
    node = alpha * beta
    p = (node[:, :, 1] / node.sum(2)).T
    pull = np.where(real, y - p, 0.0)
    edge = np.zeros((2, 2))
    for k in range(1, width):
        m = alpha[k - 1][:, :, None] * t[None] * beta[k][:, None, :]
        m[:, :, 1] *= up[:, k, None]
        m /= m.sum((1, 2), keepdims=True)
        edge += m[real[:, k]].sum(0)
    met = np.zeros((2, 2))
    np.add.at(met, (y[:, :-1][both], y[:, 1:][both]), 1)
    first = np.bincount(y[:, 0], minlength=2) - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
    return np.bincount(which, pull.ravel()[place], len(w)), met - edge, first, pull.sum()


def fit_chain(tokens: list[list[str]], states: list[np.ndarray]) -> Field:
    """The chain's weights by gradient ascent on the likelihood of labelled token windows."""
    seen = Counter(f for window in tokens for t in window for f in token_features(t))
    number = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= 3)}
    parts = [chain_slice(tokens[at : at + SLICE], states[at : at + SLICE], number) for at in range(0, len(tokens), SLICE)]
    w, chain, bias = np.zeros(len(number)), np.zeros((2, 2)), 0.0
    start = np.zeros(2)
    sums = [np.full_like(x, 1e-6) for x in (w, chain, start)] + [1e-6]
    total = max(1, sum(len(t) for t in tokens))
    for _ in range(STEPS):
        found = [chain_gradient(part, w, chain, start, bias) for part in parts]
        by_feature, by_step, by_start, by_bias = (sum(f[k] for f in found) for k in range(4))
        steps = [by_feature / total - DECAY * w / 100, by_step / total, by_start / total, by_bias / total]
        new = []
        for k, (value, gradient) in enumerate(zip((w, chain, start, bias), steps, strict=True)):
            sums[k] = sums[k] + gradient**2
            new.append(value + RATE * gradient / np.sqrt(sums[k]))
        w, chain, start, bias = new
    return Field({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-4}, float(bias), start, chain)


def fit(texts: list[str], toxic: np.ndarray, prior: dict[int, float]) -> Field | None:
    """A field from whole texts and their labels; None if no feature marks toxic ones.

    prior: by label, how many documents one of `texts` stands for.
    """
    places = apart(texts)
    split = [texts[k].split() for k in places]
    label = toxic[places]
    counts = [Counter(), Counter()]
    for tokens, y in zip(split, label, strict=True):
        counts[y].update({f for t in set(tokens) for f in token_features(t)})
    if not label.any() or label.all():
        return None
    marks = marking(counts[1], counts[0], int(label.sum()), int((1 - label).sum()))
    if not marks:
        return None
    windows, states = [], []
    later = np.arange(len(split)) % 3 == 2  # documents for the logistic
    for k in np.concatenate([np.flatnonzero(~later & (label == y))[:most] for y, most in CHAIN.items()]).tolist():
        tokens = split[k]
        marked = np.array([any(f in marks for f in token_features(t)) for t in tokens], np.int64) if label[k] else np.zeros(len(tokens), np.int64)
        for at in range(0, len(tokens), WINDOW):
            windows.append(tokens[at : at + WINDOW])
            states.append(marked[at : at + WINDOW])
    model = fit_chain(windows, states)
    mine = np.concatenate([np.flatnonzero(later & (label == y))[:most] for y, most in CALIBRATION.items()])
    if len(set(label[mine].tolist())) == 2:
        x, _, _ = document_features(model, [split[k] for k in mine])
        share = np.bincount(toxic, minlength=2) / np.bincount(label[mine], minlength=2)
        weight = share[label[mine]] * np.array([prior[0], prior[1]])[label[mine]]
        model.document = fit_logistic(x, label[mine], weight / weight.mean())
    return model


HELD_OUT = 3, 1  #: rows whose crc32 of the id leaves 1 modulo 3 are never learned from


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from the texts of `docs` that `labels` (doc_id, toxic) marks, held-out ids left out.

    It is fitted on a sample by hash of about SAMPLE rows of each label, or all if there are fewer; their ids are that
    bounded, and broadcast. A document with both labels counts as toxic.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.coalesce(remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1], F.lit(False)))
    marked = usable.groupBy(F.col("doc_id").try_cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, SAMPLE[1] / counts.get(1, 1)).otherwise(SAMPLE[0] / counts.get(0, 1))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y").toArrow().to_pandas()
    found = found.sort_values(["doc_id", "text"]).drop_duplicates(["doc_id", "text"])
    prior = {y: max(1.0, counts.get(y, 1) / SAMPLE[y]) for y in SAMPLE}
    return fit(found["text"].tolist(), found["y"].to_numpy().astype(np.int64), prior) if len(found) else None


def document_scores(model: Field, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
    """(score, offending spans) of each text; a text without tokens scores 0."""
    tokens = [t.split() if t else [] for t in texts]
    x, p, ends = document_features(model, tokens)
    if model.document is None:
        score = 1 / (1 + np.exp(-4 * x[:, 2]))
    else:
        score = 1 / (1 + np.exp(-np.clip(x @ model.document, -50, 50)))
    out = []
    for k, words in enumerate(tokens):
        mine = p[ends[k] - len(words) : ends[k]]
        spans = []
        if (mine >= SPAN).any():
            places = [m.span() for m in re.finditer(r"\S+", texts[k])]
            spans = [{"start": places[j][0], "end": places[j][1], "p": float(mine[j])} for j in np.flatnonzero(mine >= SPAN).tolist()]
        out.append((float(score[k]) if words else 0.0, spans))
    return out


def scored(docs: DataFrame, model: Field | None, out: str = "_toxicity") -> DataFrame:
    """`docs` with struct `out`: score (0 to 1) and spans (start and end offset in characters, p) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start: int, end: int, p: double>>")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, rows = part.tolist(), []
            for at in range(0, len(texts), 64):
                some = texts[at : at + 64]
                rows += document_scores(shared.value, some) if shared.value else [(0.0, [])] * len(some)
            yield pd.DataFrame(rows, columns=["score", "spans"])

    return docs.withColumn(out, told("text"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: a row for each row of `docs`, repeated ones too.

    Null, empty and wordless texts score 0. A null id is neither learned from nor held out. With no labels of both kinds,
    or nothing that tells them apart, every score is 0. Columns beside doc_id and text don't matter.
    """
    judged = scored(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    score = F.col("_toxicity.score")
    return judged.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("_toxicity.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`, all columns, without the rows whose score is THRESHOLD or more.

    Null, empty and wordless texts score 0 and stay, as do repeated rows of a clean text; an empty table stays empty;
    a column named like the score is kept.
    """
    name = unused(docs, "_toxicity")
    judged = scored(docs, train(docs, labels), name)
    return judged.where(F.col(f"{name}.score") < THRESHOLD).drop(name)
