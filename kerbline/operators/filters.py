"""Row filters and argument checks; every filter is a plain predicate that reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import GB_LAT, GB_LON, in_gb

MAX_LIMIT = 2000


def validate(
    *,
    min_crashes: int | None = None,
    limit: int | None = None,
    corridor_m: float | None = None,
    bbox: str | tuple | None = None,
    min_score: float | None = None,
) -> None:
    """Raise ``ValueError`` before any job starts."""
    if min_crashes is not None and min_crashes < 1:
        raise ValueError("minCrashes must be at least 1")
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if corridor_m is not None and not 10 <= corridor_m <= 500:
        raise ValueError("corridorMetres must be between 10 and 500")
    if min_score is not None and not min_score == min_score:
        raise ValueError("minScore must be a number")
    if bbox is not None:
        parse_bbox(bbox)


def parse_bbox(bbox: str | tuple) -> tuple[float, float, float, float]:
    try:
        parts = [float(p) for p in (bbox.split(",") if isinstance(bbox, str) else bbox)]
    except (TypeError, ValueError):
        raise ValueError("bbox must be minLon,minLat,maxLon,maxLat") from None
    if len(parts) != 4 or any(p != p for p in parts):
        raise ValueError("bbox must be minLon,minLat,maxLon,maxLat")
    x0, y0, x1, y1 = parts
    if x0 > x1 or y0 > y1 or not (-180 <= x0 and x1 <= 180 and -90 <= y0 and y1 <= 90):
        raise ValueError("bbox corners are out of order or out of range")
    return x0, y0, x1, y1


def is_numbered(road: str = "road_number") -> Column:
    """A classified road with a number: M, A or B and digits, such as A503 or A1(M)."""
    return F.col(road).isNotNull() & F.col(road).rlike(r"^[MAB][0-9]+(\(M\))?$")


def numbered_roads(df: DataFrame) -> DataFrame:
    return df.where(is_numbered())


def in_years(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Whole years lo..hi, as date bounds, so that file statistics and partitions can be used."""
    return df.where((F.col("occurred_on") >= F.lit(f"{lo}-01-01").cast("date")) & (F.col("occurred_on") < F.lit(f"{hi + 1}-01-01").cast("date")))


def evidenced(df: DataFrame, min_crashes: int = 6) -> DataFrame:
    validate(min_crashes=min_crashes)
    return df.where(F.col("n_crashes") >= min_crashes)


def in_bbox(df: DataFrame, bbox: str | tuple) -> DataFrame:
    x0, y0, x1, y1 = parse_bbox(bbox)
    return df.where((F.col("lon") >= x0) & (F.col("lon") <= x1) & (F.col("lat") >= y0) & (F.col("lat") <= y1))


def min_score(df: DataFrame, score: float = 0.0) -> DataFrame:
    """Segments with at least this score; one without a score counts as 0."""
    return df.where(F.coalesce("score", F.lit(0.0)) >= score)


def flag_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``coord_status``: missing, ok, swapped (lat and lon exchanged) or outside."""
    x, y = F.col(lon), F.col(lat)
    status = (
        F.when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), "missing")
        .when(in_gb(x, y), "ok")
        .when(y.between(*GB_LON) & x.between(*GB_LAT), "swapped")
        .otherwise("outside")
    )
    return df.withColumn("coord_status", status)


def search(df: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    return df.where(F.lower("segment_id").contains(needle) | F.lower("road_number").contains(needle))


def explore(df: DataFrame, tiers: list[str] | None = None, roads: list[str] | None = None, speeds: list[int] | None = None) -> DataFrame:
    for column, allowed in (("tier", tiers), ("road_number", roads), ("f_speed_mode", speeds)):
        if allowed is not None:
            df = df.where(F.col(column).isin(allowed))
    return df


def segment_rows(df: DataFrame, segment_id: str) -> DataFrame:
    return df.where(F.col("segment_id") == segment_id)


def get_segment(df: DataFrame, segment_id: str):
    """One segment as a Row; ``LookupError`` when there is none."""
    row = segment_rows(df, segment_id).first()
    if row is None:
        raise LookupError(f"unknown segment {segment_id}")
    return row
