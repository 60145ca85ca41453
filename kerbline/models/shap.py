"""Exact path-dependent SHAP values of boosted regression trees.

A leaf contributes its value times a product over the inputs on its path: for a known input 1 or 0
(the row follows the path or not), for an unknown one the share of training rows that followed it.
The Shapley values of such a product have a closed form in the elementary symmetric polynomials of
the remaining factors, so each leaf is a few vectorised steps over an Arrow batch. Only the trees
travel to the executors, with the tasks: at most ``rounds * 2 ** depth`` leaves, whatever the number of
rows. Rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Leaves with at most so many inputs keep their terms of every pattern, a few kilobytes each.
KEPT_INPUTS = 6


@dataclass
class Leaf:
    value: float
    # input -> (condition, share of the training rows that met it on the way down)
    path: dict[int, tuple[Condition, float]]

    @cached_property
    def terms(self) -> np.ndarray:
        """(path inputs x patterns) Shapley values; bit i of a pattern says whether input i follows the path."""
        m, share = len(self.path), np.array([share for _, share in self.path.values()])
        return _terms(self.value, share, (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)).T


@dataclass(frozen=True)
class Condition:
    """Bins of one input that stay on the path: a range ``low < x <= high``, or a set of categories."""

    low: float = -math.inf
    high: float = math.inf
    categories: frozenset[float] | None = None

    def met(self, x: np.ndarray) -> np.ndarray:
        if self.categories is not None:
            return np.isin(x, list(self.categories))
        return (x > self.low) & (x <= self.high)


def _terms(value: float, share: np.ndarray, on: np.ndarray) -> np.ndarray:
    """(rows x path inputs) Shapley values of ``value`` times a path's product: ``on`` says which inputs follow the path, ``share`` what an
    unknown one counts."""
    m, out = on.shape[1], np.empty(on.shape)
    for i in range(m):
        # coefficient k: sum over k-subsets of the other inputs of known x unknown factors
        poly = [np.ones(len(on))]
        for j in range(m):
            if j != i:
                poly = [(poly[k] * share[j] if k < len(poly) else 0.0) + (poly[k - 1] * on[:, j] if k else 0.0) for k in range(len(poly) + 1)]
        weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        out[:, i] = value * (on[:, i] - share[i]) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out


def leaf_contributions(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x inputs) contributions and the base value they are relative to.

    Rows differ in a leaf's terms only by which of its inputs follow the path: unless it has many inputs, the terms are
    worked out once for each such pattern, and looked up.
    """
    columns, phi, base = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1]), 0.0
    every = np.arange(256) if x.dtype == np.uint8 else None  # bins of one byte are looked up, too
    for leaf in leaves:
        inputs = list(leaf.path)
        m = len(inputs)
        share = np.array([leaf.path[f][1] for f in inputs])
        base += leaf.value * float(np.prod(share))
        if not m:
            continue
        followed = [leaf.path[f][0].met(columns[f]) if every is None else leaf.path[f][0].met(every)[columns[f]] for f in inputs]
        if m <= KEPT_INPUTS:
            terms = leaf.terms[:, sum(met.astype(np.int32) << i for i, met in enumerate(followed))]
        else:
            terms = _terms(leaf.value, share, np.stack(followed, 1).astype(float)).T
        for f, term in zip(inputs, terms, strict=True):
            phi[f] += term
    return np.ascontiguousarray(phi.T), base


def shap_values(model, df: DataFrame, key: str) -> DataFrame:
    """One array of contributions per row, with the base; they and the model's own base sum to the raw score."""
    leaves = model.leaves()
    flat = model.inputs_of(df, key)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                phi, base = leaf_contributions(leaves, model.bins(b))
                yield pd.DataFrame({key: b[key], "base": base, "contributions": list(phi)})

    key_type = df.schema[key].dataType.simpleString()
    return flat.mapInPandas(explain, f"{key} {key_type}, base double, contributions array<double>")


def shap_table(values: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Long form: (key, feature, value)."""
    labels = F.array(*[F.lit(n) for n in names])
    pair = F.arrays_zip(labels.alias("feature"), F.col("contributions").alias("value"))
    return values.select(key, F.inline(pair)).toDF(key, "feature", "value")


def factor_ranking(contributions: DataFrame) -> DataFrame:
    """Features by mean absolute contribution, with share and rank (one row per feature)."""
    m = contributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("weight"))
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.desc("weight"), "feature")
    return m.select("feature", "weight", (F.col("weight") / F.sum("weight").over(whole)).alias("share"), F.row_number().over(order).alias("rank"))
