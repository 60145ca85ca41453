"""500 m segments: ids, crash assignment, features and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import in_gb
from kerbline.functions.ids import is_night, segment_id
from kerbline.operators.chainage import chainage
from kerbline.operators.filters import in_years
from kerbline.operators.spanning import extend_forest, positions, spanning_forest, with_position
from kerbline.schemas import FEATURE_NAMES
from kerbline.scratch import Scratch


def blocks(df: DataFrame, block_m: int = 500) -> DataFrame:
    """Add ``block``, ``km`` and ``segment_id``; chainage is taken to the millimetre first."""
    if block_m % 100 or block_m <= 0:
        raise ValueError("block length must be a multiple of 100 m, the precision of the id")
    block = F.floor(F.round("chainage", 3) / block_m).cast("int")
    out = df.withColumn("block", block).withColumn("km", F.col("block") * F.lit(block_m / 1000.0))
    return out.withColumn("segment_id", segment_id("road_number", "run", "km"))


def place_positions(crashes: DataFrame, gap_m: float = 5000.0, block_m: int = 500) -> tuple[DataFrame, DataFrame]:
    """Positions with run, chainage and segment, and the forest edges they came from."""
    usable = crashes.where(F.col("road_number").isNotNull() & in_gb("lon", "lat"))
    edges, labelled = spanning_forest(positions(usable), gap_m)
    return blocks(chainage(labelled, edges), block_m), edges


def extend_places(old: DataFrame, edges: DataFrame, crashes: DataFrame, gap_m: float = 5000.0, block_m: int = 500) -> tuple[DataFrame, DataFrame]:
    """``place_positions`` of old and added crashes, from the places and edges of the old ones.

    ``edges`` are those of ``spanning.with_road``, and so are the returned ones; ``crashes`` are the added ones alone.
    Roads without a new place keep their stretches and chainage; only the number of crashes at a place may change there.
    """
    usable = crashes.where(F.col("road_number").isNotNull() & in_gb("lon", "lat"))
    new = Scratch(old.sparkSession, "added").table(positions(usable), "positions")
    all_edges, labelled, roads = extend_forest(old, edges, new, gap_m)
    redone = blocks(chainage(labelled, all_edges.join(roads, "road_number", "left_semi").select("a", "b", "w")), block_m)
    more = new.join(roads, "road_number", "left_anti").select("road_number", "px", "py", F.col("n_here").alias("more"))
    same = old.join(roads, "road_number", "left_anti").join(more, ["road_number", "px", "py"], "left")
    same = same.withColumn("n_here", F.col("n_here") + F.coalesce("more", F.lit(0))).select(*redone.columns)
    return redone.unionByName(same), all_edges


def assign_segments(crashes: DataFrame, placed: DataFrame) -> DataFrame:
    """Join the segment of each crash's position; a position is one row, so crashes never multiply.

    A place with very many crashes makes one large join key on the crash side only; adaptive
    execution splits such a partition because the other side is unique.
    """
    p = placed.select("road_number", "px", "py", "segment_id", "run", "block", "km", "chainage", "stretch_m")
    return with_position(crashes).join(p, ["road_number", "px", "py"]).drop("px", "py")


def _year():
    return F.year("occurred_on")


def in_window(assigned: DataFrame, years: tuple[int, int]) -> DataFrame:
    return in_years(assigned, *years).withColumn("_in", F.lit(1))


def f_totals():
    """Totals and means over the rows marked by ``_in``."""
    crashes = F.count("_in")
    each = F.nullif(crashes, F.lit(0).cast("long"))
    return [
        crashes.alias("f_crashes"),
        F.sum("ksi").alias("f_ksi"),
        F.sum("n_fatal").alias("f_fatal"),
        F.sum("n_serious").alias("f_serious"),
        F.sum("n_slight").alias("f_slight"),
        (F.sum("n_casualties") / each).alias("f_casualties_per_crash"),
        (F.sum("n_vehicles") / each).alias("f_vehicles_per_crash"),
    ]


def f_history(years: tuple[int, int]):
    return [*f_totals(), *[F.count_if(_year() == years[0] + i).alias(f"f_year{i + 1}") for i in range(3)]]


def f_speed():
    return [F.avg("speed_limit").alias("f_speed_mean")]


def f_road_junction():
    return [_share(F.col("junction_type") != "none").alias("f_junction_share")]


DOMINANT = {"f_speed_mode": "speed_limit", "f_road_type": "road_type", "f_junction_type": "junction_type"}


def dominant(w: DataFrame, *names: str) -> DataFrame:
    """Most frequent value per segment, ties to the smallest value.

    Crashes are first counted per combination of values, with map-side combining; the modes are then
    taken from those few rows. The ``mode`` aggregate would keep a map per segment and fall back to
    sorting all crashes once a task meets more than a handful of segments.
    """
    counts = w.where(F.col("_in").isNotNull()).groupBy("segment_id", *DOMINANT.values()).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name in names or DOMINANT:
        value = DOMINANT[name]
        # unknown values come last by order, not by a filter: the counts stay one shared exchange
        n = counts.groupBy("segment_id", value).agg(F.sum("n").alias("n"))
        order = F.struct(F.col(value).isNull().alias("unknown"), (-F.col("n")).alias("o"), F.col(value).alias("v"))
        best = n.groupBy("segment_id").agg(F.min(order).alias("m"))
        best = best.select("segment_id", F.col("m.v").alias(name))
        out = best if out is None else out.join(best, "segment_id", "full")
    return out


def f_environment():
    return [_share(F.col("is_urban")).alias("f_urban_share"), _share(F.col("lighting") == "dark_unlit").alias("f_unlit_share")]


def f_night():
    return [_share(is_night("hour")).alias("f_night_share")]


def f_location():
    return [
        F.avg("lon").alias("f_lon"),
        F.avg("lat").alias("f_lat"),
        (F.max("chainage") - F.min("chainage")).alias("f_extent_m"),
    ]


def f_position(block_m: int = 500):
    start, stretch = F.min("block") * F.lit(float(block_m)), F.max("stretch_m")
    return [
        start.alias("f_start_m"),
        F.coalesce(start / F.nullif(stretch, F.lit(0.0)), F.lit(0.0)).alias("f_position_share"),
        stretch.alias("f_stretch_m"),
    ]


def _share(cond):
    return F.avg(F.when(cond, 1.0).when(~cond, 0.0))


def feature_aggregates(years: tuple[int, int], block_m: int = 500):
    return [*f_history(years), *f_speed(), *f_road_junction(), *f_environment(), *f_night(), *f_location(), *f_position(block_m)]


def features(assigned: DataFrame, years: tuple[int, int], block_m: int = 500) -> DataFrame:
    """All 24 inputs over the feature years."""
    w = in_window(assigned, years)
    numbers = w.groupBy("segment_id").agg(*feature_aggregates(years, block_m))
    return numbers.join(dominant(w), "segment_id", "left").select("segment_id", *FEATURE_NAMES)


def segment_target(assigned: DataFrame, years: tuple[int, int]) -> DataFrame:
    return in_years(assigned, *years).groupBy("segment_id").agg(F.sum("ksi").alias("ksi_target"))


def n_crashes(assigned: DataFrame) -> DataFrame:
    """Every segment with its recorded crashes and centre."""
    return assigned.groupBy("segment_id", "road_number", "run", "km").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n_crashes")
    )


def features_target(f: DataFrame, t: DataFrame) -> DataFrame:
    """Segments without a later casualty have target 0."""
    return f.join(t, "segment_id", "left").withColumn("ksi_target", F.coalesce("ksi_target", F.lit(0).cast("long")))


def segment_table(assigned: DataFrame, feature_years: tuple[int, int], target_years: tuple[int, int], block_m: int = 500) -> DataFrame:
    """Segments, features and target from one aggregation, plus one for the dominant values.

    The feature and target windows are conditions inside the aggregates: separate aggregations would
    each shuffle the same crashes by the same key.
    """
    in_f = _year().between(*feature_years)
    cols = ["ksi", "n_fatal", "n_serious", "n_slight", "n_casualties", "n_vehicles", "speed_limit", "road_type",
            "junction_type", "is_urban", "lighting", "hour", "lon", "lat", "chainage", "stretch_m"]
    w = assigned.select(
        "segment_id", "road_number", "run", "km", "block", "occurred_on",
        F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("ksi").alias("_ksi"),
        F.when(in_f, 1).alias("_in"), *[F.when(in_f, F.col(c)).alias(c) for c in cols],
    )
    out = w.groupBy("segment_id", "road_number", "run", "km").agg(
        F.avg("_lon").alias("lon"), F.avg("_lat").alias("lat"), F.count(F.lit(1)).alias("n_crashes"),
        *feature_aggregates(feature_years, block_m),
        F.coalesce(F.sum(F.when(_year().between(*target_years), F.col("_ksi"))), F.lit(0).cast("long")).alias("ksi_target"),
    )
    # no crash in the feature window: the inputs are unknown, not zero
    unknown = ("f_start_m", "f_position_share", "f_stretch_m", "f_year1", "f_year2", "f_year3", "f_crashes")
    for c in unknown:
        out = out.withColumn(c, F.when(F.col("f_crashes") > 0, F.col(c)))
    out = out.join(dominant(w), "segment_id", "left")
    return out.select("segment_id", "road_number", "run", "km", "lon", "lat", "n_crashes", *FEATURE_NAMES, "ksi_target")
