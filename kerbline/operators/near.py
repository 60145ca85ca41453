"""Grid cells, and pairs of positions of one road within a distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import METRES_PER_DEGREE, haversine_m

HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]  # each pair of neighbouring cells once


class Grid:
    """Grid steps in degrees for a cell side; longitude steps are wide enough at every latitude used."""

    def __init__(self, max_abs_lat: float):
        self.cos = math.cos(math.radians(min(max_abs_lat + 0.1, 89.9)))

    def cell(self, side_m: float) -> tuple[Column, Column]:
        # widened by 0.1 % against rounding
        dlat = side_m * 1.001 / METRES_PER_DEGREE
        return F.floor(F.col("lon") / (dlat / self.cos)).alias("cx"), F.floor(F.col("lat") / dlat).alias("cy")


def grid_for(pts: DataFrame) -> Grid:
    return Grid(float(pts.agg(F.max(F.abs("lat"))).first()[0] or 0.0))


def forward_cells(df: DataFrame, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    """One row per own and forward neighbouring cell; ``own`` marks the row's own cell."""
    shifts = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in HALF])
    return df.withColumn("_s", F.explode(shifts)).withColumns({
        out_x: F.col(x) + F.col("_s.x"), out_y: F.col(y) + F.col("_s.y"), "own": F.expr("_s.x = 0 and _s.y = 0"),
    }).drop("_s")


def near_pairs(pts: DataFrame, radius_m: float, grid: Grid | None = None, touching: str | None = None) -> DataFrame:
    """Every pair (a < b) of distinct positions of a road at most ``radius_m`` apart, with length ``w``.

    ``touching`` names a boolean column; then only pairs with at least one position where it holds.

    Positions meet through an equi-join on grid cells. The result has one row per such pair, so the
    radius has to suit the density; the spanning forest takes one that keeps every cell small.
    """
    cx, cy = (grid or grid_for(pts)).cell(radius_m)
    wanted = F.col(touching) if touching else F.lit(True)
    cells = pts.select("road_number", "pos_id", "lon", "lat", wanted.alias("wanted"), cx, cy)
    left = cells.select("road_number", F.col("pos_id").alias("i"), F.col("lon").alias("xi"), F.col("lat").alias("yi"), F.col("wanted").alias("wi"), F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    left = forward_cells(left, "x0", "y0", "cx", "cy").drop("x0", "y0")
    right = cells.select("road_number", F.col("pos_id").alias("j"), F.col("lon").alias("xj"), F.col("lat").alias("yj"), F.col("wanted").alias("wj"), "cx", "cy")
    p = left.join(right, ["road_number", "cx", "cy"]).where((~F.col("own") | (F.col("i") < F.col("j"))) & (F.col("wi") | F.col("wj")))
    p = p.withColumn("w", haversine_m("xi", "yi", "xj", "yj")).where(F.round("w", 3) <= radius_m)
    return p.select("road_number", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
