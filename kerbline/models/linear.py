"""The linear floor of the count model: Poisson regression by iteratively reweighted least squares.

A step is one aggregate: with ``eta`` the log mean and ``mu = exp(eta)`` it sums the entries of ``X'WX`` and ``X'Wz``
(``W = mu``, ``z = eta + (y - mu) / mu``) where the rows are. Only those sums, inputs squared in number, reach the
driver, which solves the system. All folds step together, each row counting in the folds it does not belong to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.ids import fold_of
from kerbline.scratch import Scratch

#: Log means are kept within this while stepping, and the systems' diagonals raised by this share.
MOST_ETA, RIDGE = 30.0, 1e-9


@dataclass
class LinearModel:
    """``exp(intercept + sum(beta * (x - mean) / scale))``; a null input counts as its mean."""

    inputs: list[str]
    mean: list[float]
    scale: list[float]
    beta: list[float]  # the intercept first

    def score(self) -> Column:
        terms = (b * x for b, x in zip(self.beta[1:], _scaled(self.inputs, self.mean, self.scale), strict=True))
        return F.exp(sum(terms, F.lit(self.beta[0])))


def _scaled(inputs: list[str], mean: list[float], scale: list[float]) -> list[Column]:
    return [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(inputs, mean, scale, strict=True)]


def fit_linear(df: DataFrame, label: str, inputs: list[str], members: list[Column], steps: int = 8) -> list[LinearModel]:
    """One model for each of ``members``, a condition on the rows it learns from; ``steps`` is the number of steps.

    Means and scales come from the rows that any model learns from. A model without rows or casualties is refused.
    """
    any_of = F.lit(False)
    for m in members:
        any_of = any_of | m
    x = [F.col(c).cast("double") for c in inputs]
    s = df.where(any_of).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))], F.count(F.lit(1)).alias("n")).first()
    mean, scale = [s[f"m{i}"] or 0.0 for i in range(len(x))], [s[f"s{i}"] or 1.0 for i in range(len(x))]
    flags = [F.coalesce(m, F.lit(False)).alias(f"in{i}") for i, m in enumerate(members)]
    rows = Scratch(df.sparkSession, "linear").table(
        df.where(any_of).select(F.col(label).cast("double").alias("y"), F.array(F.lit(1.0), *_scaled(inputs, mean, scale)).alias("x"), *flags)
    )
    start = rows.agg(*[F.avg(F.when(F.col(f"in{i}"), F.col("y"))).alias(f"b{i}") for i in range(len(members))]).first()
    if not s["n"] or any(not v for v in start):
        raise ValueError("a model needs rows with casualties")
    beta = [np.array([math.log(v)] + [0.0] * len(inputs)) for v in start]
    for _ in range(steps):
        beta = _step(rows, beta)
    return [LinearModel(inputs, mean, scale, b.tolist()) for b in beta]


def _step(rows: DataFrame, beta: list[np.ndarray]) -> list[np.ndarray]:
    p = len(beta[0])
    # one copy of a row for each model that learns from it, with that model's log mean
    eta = [F.when(F.col(f"in{i}"), F.struct(F.lit(i).alias("m"), sum((float(v) * F.get("x", F.lit(j)) for j, v in enumerate(b)), F.lit(0.0)).alias("eta"))) for i, b in enumerate(beta)]
    each = rows.select("y", "x", F.explode(F.array_compact(F.array(*eta))).alias("e"))
    each = each.select("y", "x", "e.m", F.greatest(F.lit(-MOST_ETA), F.least(F.lit(MOST_ETA), F.col("e.eta"))).alias("eta")).withColumn("mu", F.exp("eta"))
    x = lambda j: F.get("x", F.lit(j))
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    sums = [F.sum(F.col("mu") * x(a) * x(b)) for a, b in pairs] + [F.sum((F.col("mu") * F.col("eta") + F.col("y") - F.col("mu")) * x(a)) for a in range(p)]
    out = list(beta)
    for r in each.groupBy("m").agg(F.array(*sums).alias("s")).collect():
        system, v = np.zeros((p, p)), r["s"]
        for (a, b), value in zip(pairs, v, strict=False):
            system[a, b] = system[b, a] = value
        system[np.diag_indices(p)] *= 1 + RIDGE
        out[r["m"]] = np.linalg.lstsq(system, np.array(v[len(pairs) :]), rcond=None)[0]
    return out


def linear_out_of_fold(df: DataFrame, key: str, inputs: list[str], k: int = 5, label: str = "ksi_target", out: str = "floor", known: Column | None = None, steps: int = 8) -> DataFrame:
    """``df`` with the score of a linear model that never saw the row's fold."""
    known, fold = F.lit(True) if known is None else known, fold_of(key, k)
    models = fit_linear(df, label, inputs, [known & (fold != i) for i in range(k)], steps)
    return df.withColumn(out, F.coalesce(*[F.when(fold == i, m.score()) for i, m in enumerate(models)]))
