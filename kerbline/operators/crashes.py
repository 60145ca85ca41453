"""Crash-level aggregates of casualties and vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ksi_per_collision(casualty: DataFrame) -> DataFrame:
    """Killed and seriously injured people per collision (people, not crashes)."""

    def n(label: str):
        return F.count_if(F.col("severity") == label)

    return casualty.groupBy("collision_id").agg(
        F.count(F.lit(1)).alias("n_casualties"),
        n("fatal").alias("n_fatal"),
        n("serious").alias("n_serious"),
        n("slight").alias("n_slight"),
        F.count_if(F.col("severity").isin("fatal", "serious")).alias("ksi"),
    )


def vehicles_per_collision(vehicle: DataFrame) -> DataFrame:
    return vehicle.groupBy("collision_id").agg(F.count(F.lit(1)).alias("n_vehicles"))


_COUNTS = ["n_casualties", "n_fatal", "n_serious", "n_slight", "ksi", "n_vehicles"]


def join_crash(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame) -> DataFrame:
    """One row per collision with counts of its people and vehicles.

    Both children are reduced to one row per collision first, so rows never multiply.
    """
    j = collision.join(ksi_per_collision(casualty), "collision_id", "left").join(vehicles_per_collision(vehicle), "collision_id", "left")
    return j.select(*collision.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS])
