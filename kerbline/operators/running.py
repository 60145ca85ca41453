"""Running aggregates and ranks that never put a whole group into one task.

A plain window over one key sends all its rows to one task. Here rows are first cut into chunks of
bounded size; each chunk is scanned on its own and only the chunk totals (one small row each) are
scanned per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.scratch import table

CHUNK_ROWS = 1 << 16

_COMBINE = {
    "sum": (F.sum, lambda carry, v: F.coalesce(carry, F.lit(0)) + v),
    "min": (F.min, lambda carry, v: F.least(carry, v)),
}


def running(
    df: DataFrame,
    group: list[str],
    chunk: str,
    order: list[str | Column],
    values: dict[str, tuple[str, str]],
) -> DataFrame:
    """Inclusive running aggregates; ``values`` is ``{out: (how, column)}``.

    ``chunk`` is a column whose order agrees with ``order`` and whose groups are of bounded size.
    """
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        # one row per chunk is left here, so a single ordered pass over them is small
        before = Window.partitionBy(F.lit(0)).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, chunk).agg(*[_COMBINE[h][0](c).alias(f"_t_{o}") for o, (h, c) in values.items()])
    carry = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col(chunk).alias("_g_chunk"),
        *[_COMBINE[h][0](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (h, _) in values.items()],
    )
    scanned = df.select("*", *[_COMBINE[h][0](c).over(inside).alias(f"_i_{o}") for o, (h, c) in values.items()])
    cond = scanned[chunk] == carry["_g_chunk"]
    for g in group:
        cond = cond & scanned[g].eqNullSafe(carry[f"_g_{g}"])
    return scanned.join(carry, cond, "left").select(
        *[scanned[c] for c in df.columns],
        *[_COMBINE[h][1](F.col(f"_c_{o}"), F.col(f"_i_{o}")).alias(o) for o, (h, _) in values.items()],
    )


def sorted_chunks(df: DataFrame, order: list[Column], tag: str = "sorted") -> DataFrame:
    """Globally sorted copy with ``_chunk`` (sort partition) and ``_row`` (place within it).

    The sort is a range shuffle, so partitions stay even however the values cluster, given that
    ``order`` ends in a unique key. It is written once: sampled range bounds may differ between
    two runs of the same plan.
    """
    mid = F.monotonically_increasing_id()
    out = df.orderBy(*order).select("*", mid.alias("_mid"))
    out = out.select(*df.columns, F.shiftright("_mid", 33).alias("_chunk"), F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_row"))
    return table(out, tag)


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """Rank from 1 over all rows, plus running sums ``{out: column}`` in the same order."""
    s = sorted_chunks(df, order)
    vals = {o: ("sum", c) for o, c in (sums or {}).items()}
    s = s.withColumn("_one", F.lit(1).cast("long"))
    r = running(s, [], "_chunk", [F.col("_row")], {out: ("sum", "_one"), **vals})
    return r.drop("_chunk", "_row", "_one")


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact interpolated quantiles without holding the distinct values in one buffer.

    Values are counted first, then ranked by a distributed sort; only the rows next to the wanted
    ranks (two per quantile) reach the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(counts, [F.col("v")], "_i", {"hi": "n"}).select("v", F.col("hi"), (F.col("hi") - F.col("n")).alias("lo"))
    total = ranked.agg(F.max("hi")).first()[0]
    if not total:
        return [None] * len(probs)
    spots = [p * (total - 1) for p in probs]
    wanted = sorted({int(s) for s in spots} | {min(int(s) + 1, total - 1) for s in spots})
    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("lo") <= k) & (F.col("hi") > k))
    rows = ranked.where(hit).collect()
    at = {k: next(r["v"] for r in rows if r["lo"] <= k < r["hi"]) for k in wanted}
    out = []
    for s in spots:
        a, b = at[int(s)], at[min(int(s) + 1, total - 1)]
        out.append(a + (b - a) * (s - int(s)))
    return out
