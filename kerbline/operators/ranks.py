"""Top lists, ranks, tiers and distributions over the segment table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.ids import md5_number
from kerbline.functions.scale import TIER_PERCENTILES, Cutoffs, display_score, tier, tier_colour
from kerbline.operators.filters import MAX_LIMIT, evidenced, validate
from kerbline.operators.running import exact_quantiles, global_rank, running, sorted_chunks


def top_segments(df: DataFrame, limit: int = 500) -> DataFrame:
    """Highest score first; ties by id. Planned as a per-partition top-k, without a full sort."""
    validate(limit=limit)
    return df.orderBy(F.col("score").desc_nulls_last(), "segment_id").limit(limit)


def rankings(df: DataFrame, min_crashes: int = 6) -> DataFrame:
    return top_segments(evidenced(df, min_crashes), MAX_LIMIT)


def rankings_by(df: DataFrame, column: str, ascending: bool = True, min_crashes: int = 6) -> DataFrame:
    """The rankings list, ordered by any of its columns."""
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return rankings(df, min_crashes).orderBy(key, "segment_id")


def ranked(df: DataFrame) -> DataFrame:
    """Rank 1 for the highest score, over all rows, without one giant partition."""
    return global_rank(df.drop("rank"), [F.col("score").desc_nulls_last(), F.col("segment_id").asc()], "rank")


def tier_cutoffs(df: DataFrame, min_crashes: int = 6) -> Cutoffs | None:
    """Exact 50th, 80th and 95th percentile and the top of the evidenced scores; None without any."""
    vals = exact_quantiles(evidenced(df, min_crashes), "score", [*TIER_PERCENTILES, 1.0])
    return None if vals[0] is None else Cutoffs(*vals)


def with_tiers(df: DataFrame, cutoffs: Cutoffs | None) -> DataFrame:
    """Add tier, display score and colour; the cutoffs enter the plan as constants."""
    if cutoffs is None:
        return df.withColumns({"tier": F.lit(None).cast("string"), "display": F.lit(None).cast("int"), "tier_colour": F.lit(None).cast("string")})
    t = df.withColumn("tier", tier("score", cutoffs)).withColumn("display", display_score("score", cutoffs))
    return t.withColumn("tier_colour", tier_colour("tier"))


def tier_distribution(df: DataFrame) -> DataFrame:
    n = df.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per tier from here on
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def speed_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("f_speed_mode").alias("speed_limit")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("score").alias("total_score"), F.avg("score").alias("mean_score")
    )


def headline(df: DataFrame, min_crashes: int = 6) -> DataFrame:
    """Collisions, segments, evidenced segments, share below the evidence limit, median score."""
    median = exact_quantiles(df, "score", [0.5])[0]
    few = F.count_if(F.col("n_crashes") < min_crashes)
    return df.agg(
        F.sum("n_crashes").alias("collisions"),
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("n_crashes") >= min_crashes).alias("evidenced"),
        (few / F.count(F.lit(1))).alias("share_under"),
    ).withColumn("median_score", F.lit(median).cast("double"))


def heat_grid(df: DataFrame, cell_deg: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / cell_deg)
    return df.groupBy(cell("lon").alias("cell_x"), cell("lat").alias("cell_y")).agg(
        F.sum("score").alias("weight"), F.count(F.lit(1)).alias("segments")
    )


#: Share of a row's weight that each cell around its own gets: 4, 2 and 1 sixteenths, all sixteen together.
_KERNEL = [(x, y, (2 - abs(x)) * (2 - abs(y)) / 16) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def density_pyramid(df: DataFrame, cell_deg: float, levels: int = 5, weight: str = "score") -> DataFrame:
    """``level, cell_x, cell_y, weight``: weight spread over neighbouring cells, at each zoom level.

    A row's weight goes to its cell and the eight around it; level 0 has cells of ``cell_deg``, each further level cells
    of twice the side. Rows are first summed by cell; then all levels in one aggregation, which combines on the map side.
    Every level holds the whole weight. Rows without a place or weight are left out.
    """
    x, y = (F.floor(F.col(c) / cell_deg).cast("long") for c in ("lon", "lat"))
    rows = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col(weight).isNotNull()).select(x.alias("x"), y.alias("y"), F.col(weight).cast("double").alias("w"))
    base = rows.groupBy("x", "y").agg(F.sum("w").alias("w"))
    near = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("w") * part).alias("w")) for dx, dy, part in _KERNEL]
    up = [F.struct(F.lit(k).alias("level"), F.shiftright("c.x", k).alias("cell_x"), F.shiftright("c.y", k).alias("cell_y"), F.col("c.w").alias("w")) for k in range(levels)]
    return base.select(F.explode(F.array(*near)).alias("c")).select(F.inline(F.array(*up))).groupBy("level", "cell_x", "cell_y").agg(F.sum("w").alias("weight"))


def _top_share(df: DataFrame, by: str, target: str, share: float) -> tuple[float, int, int]:
    r = global_rank(df.select("segment_id", by, target), [F.col(by).desc_nulls_last(), F.col("segment_id").asc()], "_rank", {"_sum": target})
    # the running sum at the last row kept is the captured total
    ends = r.agg(F.max("_rank").alias("n"), F.max_by("_sum", "_rank").alias("total")).first()
    k = _ceil_share(share, ends["n"] or 0)
    got = r.where(F.col("_rank") == k).select("_sum").first()
    captured = got[0] if got else 0
    return (captured / ends["total"] if ends["total"] else None), k, ends["n"] or 0


def _ceil_share(share: float, n: int) -> int:
    return -int(-round(share * n, 9) // 1)


def capture(df: DataFrame, score: str, target: str, share: float = 0.2) -> DataFrame:
    """Share of the target that lies in the top ``share`` of segments by score."""
    value, k, n = _top_share(df, score, target, share)
    return df.sparkSession.createDataFrame([(share, n, k, value)], "share double, segments long, taken long, captured double")


def capture_compare(df: DataFrame, score: str, baseline: str, target: str, share: float = 0.2) -> DataFrame:
    a, _, _ = _top_share(df, score, target, share)
    b, _, _ = _top_share(df, baseline, target, share)
    gain = a - b if a is not None and b is not None else None
    return df.sparkSession.createDataFrame([(share, a, b, gain)], "share double, model double, baseline double, gain double")


def gains(df: DataFrame, score: str, target: str, n: int = 100) -> DataFrame:
    """Captured share at each of ``n`` equal steps down the ranking."""
    r = global_rank(df.select("segment_id", score, target), [F.col(score).desc_nulls_last(), F.col("segment_id").asc()], "_rank")
    rows = r.count()
    step = F.ceil(F.col("_rank") * n / F.lit(rows)).cast("int")
    b = r.groupBy(step.alias("step")).agg(F.sum(target).alias("_t"), F.count(F.lit(1)).alias("segments"))
    # n rows are left
    w = Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    return b.select("step", "segments", (F.sum("_t").over(w) / F.sum("_t").over(whole)).alias("captured"))


#: Poisson(1) weights from 32-bit numbers: the weight is how many of these a number reaches.
POISSON_CUTS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(9)]


def replicate_weight(replicate, key) -> Column:
    """A row's weight in a bootstrap replicate, from the md5 of both: the same in every engine and run."""
    u = md5_number(F.concat(F.col(replicate).cast("string"), F.lit(":"), F.col(key).cast("string")))
    return sum(((u >= c).cast("long") for c in POISSON_CUTS), F.lit(0).cast("long"))


def replicate_captures(df: DataFrame, key: str, scores: list[str], target: str, replicates: int = 200, share: float = 0.2) -> DataFrame:
    """``replicate`` and, for each score, the share of the weighted target in its top ``share`` of weight.

    Each row is weighted anew in every replicate (Poisson bootstrap). A ranking is sorted once; the running weights of
    all replicates go down it together, in bounded chunks. Ties go to the smaller key.
    """
    out = None
    for name in scores:
        s = sorted_chunks(df.select(key, F.col(name).alias("_s"), F.col(target).alias("_t")), [F.desc_nulls_last("_s"), F.col(key)])
        w = s.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", replicate_weight("replicate", key)).where("_w > 0")
        total = w.groupBy("replicate").agg(F.ceil(F.round(F.sum("_w") * share, 9)).alias("most"), F.sum(F.col("_w") * F.col("_t")).alias("all"))
        run = running(w, ["replicate"], "_chunk", ["_row"], {"_up": ("sum", "_w")}).join(total, "replicate")
        hit = F.sum(F.when(F.col("_up") <= F.col("most"), F.col("_w") * F.col("_t")).otherwise(0))
        found = run.groupBy("replicate").agg((hit / F.nullif(F.max("all"), F.lit(0))).alias(name))
        out = found if out is None else out.join(found, "replicate")
    return out


def capture_interval(df: DataFrame, key: str, score: str, baseline: str, target: str, replicates: int = 200, share: float = 0.2) -> DataFrame:
    """The 95 % interval of the score's gain over the baseline, and the share of replicates in which it gains."""
    gain = F.col(score) - F.col(baseline)
    r = replicate_captures(df, key, [score, baseline], target, replicates, share)
    return r.agg(
        F.count(gain).alias("replicates"), F.avg(gain).alias("mean_gain"), F.percentile(gain, 0.025).alias("low"), F.percentile(gain, 0.975).alias("high"),
        F.avg((gain > 0).cast("double")).alias("share_gaining"),
    )
