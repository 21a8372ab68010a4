"""Scores as likelihoods: a logistic curve over the components, fitted on labelled pairs and used only if there are enough."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable

FEATURES = ("skills", "requirements", "role", "experience", "semantic")
LEAST_PAIRS = 300
RIDGE = 0.01  #: on the weights alone, against the mean loss


@dataclass(frozen=True)
class Calibration:
    intercept: float
    weights: tuple[tuple[str, float], ...]
    pairs: int

    def apply(self, parts: dict[str, Column]) -> Column:
        """0 to 1 of the components, of which it needs every one that it has a weight for."""
        z = F.lit(self.intercept)
        for name, weight in self.weights:
            z = z + parts[name] * weight
        return 1 / (1 + F.exp(-z))


def usable(found: Calibration | None, features: tuple[str, ...] = FEATURES, least: int = LEAST_PAIRS) -> Calibration | None:
    """The calibration if it rests on enough pairs and has just these components, else None: then the weights set by hand count."""
    return found if found and found.pairs >= least and {n for n, _ in found.weights} == set(features) else None


def fit(rows: DataFrame, label: Column, features: tuple[str, ...] = FEATURES, ridge: float = RIDGE, rounds: int = 50) -> Calibration | None:
    """The curve of least mean loss plus ridge / 2 times the squared weights, by Newton's steps.

    Rows with a null component or label are left out; None without rows. Equal rows are counted first. A step is one
    aggregate of sums, (features + 1) squared of them at most, which is all that the driver sees.
    """
    names = [*features]
    counted = durable(
        rows.select(*(F.col(c).cast("double").alias(c) for c in names), label.cast("int").alias("y")).na.drop().groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    )
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return None
    x = [F.lit(1.0), *(F.col(c) for c in names)]
    cells = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    w, keep = np.zeros(len(x)), np.diag([0.0, *[ridge] * len(names)])
    for _ in range(rounds):
        z = F.lit(float(w[0]))
        for c, value in zip(names, w[1:], strict=True):
            z = z + F.col(c) * float(value)
        p = 1 / (1 + F.exp(-z))
        told = counted.withColumns({"_miss": F.col("n") * p - F.col("k"), "_w": F.col("n") * p * (1 - p)})
        sums = told.agg(*(F.sum(F.col("_miss") * c) for c in x), *(F.sum(F.col("_w") * x[i] * x[j]) for i, j in cells)).first()
        gradient = np.array(sums[: len(x)]) / total + keep @ w
        hessian = keep + 1e-9 * np.eye(len(x))
        for (i, j), value in zip(cells, sums[len(x) :], strict=True):
            hessian[i, j] += value / total
            if i != j:
                hessian[j, i] += value / total
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(round(float(w[0]), 4), tuple((c, round(float(v), 4)) for c, v in zip(names, w[1:], strict=True)), int(total))
