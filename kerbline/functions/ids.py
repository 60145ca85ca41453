"""Segment ids such as ``A23_run3_km0.5``, fold numbers, night hours and JSON results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = r"^(.+)_run(\d+)_km(\d+\.\d)$"


def segment_id(road, run, km) -> Column:
    return F.format_string("%s_run%d_km%.1f", road, run, km)


def parse_segment_id(col) -> Column:
    """Struct of road_number, run, km; null for text that is not a segment id."""
    ok = F.regexp_like(col, F.lit(_PATTERN))
    parts = F.struct(
        F.regexp_extract(col, _PATTERN, 1).alias("road_number"),
        F.regexp_extract(col, _PATTERN, 2).try_cast("int").alias("run"),
        F.regexp_extract(col, _PATTERN, 3).try_cast("double").alias("km"),
    )
    return F.when(ok, parts)


def md5_number(col) -> Column:
    """First eight hex digits of the md5 of the value as text: the same number in every engine."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def fold_of(col, k: int) -> Column:
    return (md5_number(col) % k).cast("int")


def is_night(hour, start: int = 19, end: int = 7) -> Column:
    """From ``start`` o'clock up to, not including, ``end`` o'clock."""
    h = F.col(hour) if isinstance(hour, str) else hour
    return (h >= start) | (h < end)


def json_row(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def json_error(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("message")))
