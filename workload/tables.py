"""The views as DataFrames, and the placed crash tables built once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.geo import polyline_m
from kerbline.operators.ranks import tier_cutoffs
from kerbline.plans.build import Placed, Windows, place_crashes
from workload import views

WINDOWS = Windows(views.FEATURE_YEARS, views.TARGET_YEARS)
_placed: dict[tuple[str, str], Placed] = {}


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def collision(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(views.COLLISION, orders=source(spark, sf, "orders"), customer=source(spark, sf, "customer"))


def collision_with_unnumbered(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(views.COLLISION_WITH_UNNUMBERED, collision=collision(spark, sf))


def casualty(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(views.CASUALTY, lineitem=source(spark, sf, "lineitem"))


def vehicle(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(views.VEHICLE, lineitem=source(spark, sf, "lineitem"))


def from_orders(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(views.for_spark(text), orders=source(spark, sf, "orders"))


def routes(spark: SparkSession, sf: str, odd_cases: bool = False) -> DataFrame:
    """Candidate routes; ``odd_cases`` adds requests without a path and trips over 100 km."""
    ends = spark.sql(views.for_spark(views.ROUTE_ENDS), customer=source(spark, sf, "customer"))
    point = lambda lat: F.struct(F.col("lon").alias("lon"), F.col(lat).alias("lat"))
    r = ends.withColumn("path", F.array(point("lat0"), point("lat1")))
    if odd_cases:
        r = r.withColumn("path", F.when(F.col("request_id") % 17 != 0, F.col("path")).otherwise(F.array().cast(r.schema["path"].dataType)))
    length = polyline_m("path")
    if odd_cases:
        length = F.when(F.col("request_id") % 13 == 0, length + 120000.0).otherwise(length)
    r = r.withColumn("distance_m", length).withColumn("duration_s", F.col("distance_m") / (12 + F.col("candidate")))
    return r.select("request_id", "candidate", "path", "distance_m", "duration_s")


def placed(spark: SparkSession, sf: str) -> Placed:
    """Positions, forest, assigned crashes and segments. Scores are ``n_crashes / 4``, a closed form."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _placed:
        p = place_crashes(collision(spark, sf), vehicle(spark, sf), casualty(spark, sf), WINDOWS)
        p.segments = p.segments.withColumn("score", F.col("n_crashes") / 4.0)
        _placed[key] = p
    return _placed[key]


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return placed(spark, sf).segments


def tiered(spark: SparkSession, sf: str) -> DataFrame:
    from kerbline.operators.ranks import with_tiers

    s = segments(spark, sf)
    return with_tiers(s, tier_cutoffs(s))
