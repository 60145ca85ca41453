"""Quantiles from mergeable sketches: for tables too large to rank anew, for each road, and for tables that grow.

A sketch (KLL, Spark's own aggregate) is built per group in one pass with map-side combining, is a few kilobytes whatever
the group's size, and can be stored. Sketches of parts merge into that of the whole, so a new year is sketched alone,
and roads add up to the country without reading a score again. ``running.exact_quantiles`` stays the exact way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.scale import TIER_PERCENTILES, Cutoffs

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Stated bound on a quantile's rank, as a share of the rows: twice what a sketch keeps in 99 of 100 cases.

    A group of at most ``size`` rows is held whole, so its quantiles are exact.
    """
    return 2 * 2.296 / size**0.9021


def sketches(df: DataFrame, by: list[str], value: str = "score", size: int = SIZE) -> DataFrame:
    """``by, n, sketch`` for each group; null values are left out, so a group without any has no row."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged(parts: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of parts, such as roads or years, as those of the coarser groups ``by`` (none: one row for all)."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch")).where("n > 0")


def quantile(sketch: str | Column, share: float) -> Column:
    """Smallest kept value with about ``share`` of the rows at or below it."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def sketched_cutoffs(parts: DataFrame) -> Cutoffs | None:
    """Tier cutoffs from the sketches of any parts of the evidenced segments; None without any."""
    row = merged(parts, []).select(*[quantile("sketch", p).alias(f"p{i}") for i, p in enumerate([*TIER_PERCENTILES, 1.0])]).first()
    return None if row is None else Cutoffs(*row)


def rank_check(df: DataFrame, parts: DataFrame, by: list[str], shares: list[float], value: str = "score", size: int = SIZE) -> DataFrame:
    """``by, share, n, low, high, within``: the exact ranks that a sketch's quantile takes up in its group, as shares.

    ``within``: the share asked for lies between them, or at most ``rank_error`` beside them.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), quantile("sketch", p).alias("at")) for p in shares]))
    found = parts.select(*by, asked.alias("q")).select(*by, "q.share", "q.at")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).join(found, by)
    counted = rows.groupBy(*by, "share").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < F.col("at")).alias("_b"), F.count_if(F.col("_v") <= F.col("at")).alias("_u"))
    low, high, e = F.col("_b") / F.col("n"), F.col("_u") / F.col("n"), rank_error(size)
    return counted.select(*by, "share", "n", low.alias("low"), high.alias("high"), ((low - e <= F.col("share")) & (F.col("share") <= high + e)).alias("within"))
