"""Routes against segments: corridor match, travel order, totals, labels and coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import METRES_PER_DEGREE, haversine_m, in_gb, leg_fraction, lon_scale, point_leg_m, polyline_m
from kerbline.operators.filters import evidenced, validate
from kerbline.operators.running import CHUNK_ROWS, running

PIECE_M = 1000.0  # longer legs are cut, so that each covers few grid cells
CELL_M = 500.0  # the widest corridor
SAMPLE_M = 500.0
COVER_M = 500.0
MAX_CANDIDATES = 3
LONG_TRIP_M = 100_000.0
_KEY = ["request_id", "candidate"]
#: Most pieces, on average, that one task holds.
TASK_PIECES = 1 << 18

# grid steps in degrees; longitude steps are stretched so cells are near square around 55 degrees north
_DLAT = CELL_M / METRES_PER_DEGREE
_DLON = _DLAT / math.cos(math.radians(55.0))


def route_status(routes: DataFrame) -> DataFrame:
    """Add ``status``: ok, no_route (fewer than two points) or bad_coordinates."""
    bad = F.exists("path", lambda p: ~F.coalesce(in_gb(p["lon"], p["lat"]), F.lit(False)))
    status = F.when(F.coalesce(F.size("path"), F.lit(0)) < 2, "no_route").when(bad, "bad_coordinates").otherwise("ok")
    return routes.withColumn("status", status)


def limit_candidates(routes: DataFrame, keep: int = MAX_CANDIDATES, long_trip_m: float = LONG_TRIP_M) -> DataFrame:
    """The fastest ``keep`` candidates of each request; only the fastest of a long trip.

    Drivable candidates (status ok, where there is a status, and a duration) come before all others, so one
    that cannot be driven neither takes a drivable one's place nor decides whether the trip is long.

    The filter on ``row_number`` lets Spark drop surplus candidates before the shuffle, so a request
    with very many candidates does not gather in one task.
    """
    usable = F.coalesce(F.col("duration_s") > 0, F.lit(False))
    if "status" in routes.columns:
        usable = usable & F.coalesce(F.col("status") == "ok", F.lit(False))
    w = Window.partitionBy("request_id").orderBy(usable.desc(), F.col("duration_s").asc_nulls_last(), "candidate")
    first = routes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    long_trip = F.max(F.when(F.col("_n") == 1, F.col("distance_m"))).over(Window.partitionBy("request_id")) > long_trip_m
    return first.withColumn("_long", long_trip).where((F.col("_n") == 1) | ~F.coalesce("_long", F.lit(False))).drop("_n", "_long")


def _tasks(routes: DataFrame) -> int:
    """Tasks for the pieces of all routes, from their lengths: one narrow pass, in which no piece is made."""
    pieces = routes.agg(F.sum(F.size("path") + F.coalesce(F.ceil(polyline_m("path") / PIECE_M), F.lit(0)))).first()[0]
    return max(1, -(-int(pieces or 0) // TASK_PIECES))


def route_pieces(routes: DataFrame) -> DataFrame:
    """Short straight pieces of every route with their distance from the start (``offset_m``), dealt by route.

    A piece meets several cells and segments, so tasks are sized by pieces: sized by the bytes that they read, narrow
    rows (or one small file of routes) would fill a task with many times its memory in groups.
    """
    routes = routes.where(F.size("path") >= 2)
    tasks = _tasks(routes)
    p = F.col("path")
    legs = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda i: F.struct(
            i.alias("leg"),
            F.get(p, i - 1)["lon"].alias("alon"), F.get(p, i - 1)["lat"].alias("alat"),
            F.get(p, i)["lon"].alias("blon"), F.get(p, i)["lat"].alias("blat"),
        ),
    )
    one = routes.select(*_KEY, "path").repartition(tasks, *_KEY).select(*_KEY, F.inline(legs))
    one = one.withColumn("len_m", haversine_m("alon", "alat", "blon", "blat")).withColumn("_chunk", F.floor(F.col("leg") / CHUNK_ROWS))
    one = running(one, _KEY, "_chunk", ["leg"], {"end_m": ("sum", "len_m")}).drop("_chunk").repartition(tasks, *_KEY)
    m = F.greatest(F.lit(1), F.ceil(F.col("len_m") / PIECE_M).cast("int"))
    cut = one.withColumn("_m", m).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("_m"))
    k = F.col("piece")
    return cut.select(
        *_KEY, "leg", "piece",
        at("alon", "blon", k).alias("alon"), at("alat", "blat", k).alias("alat"),
        at("alon", "blon", k + 1).alias("blon"), at("alat", "blat", k + 1).alias("blat"),
        (F.col("len_m") / F.col("_m")).alias("piece_m"),
        (F.col("end_m") - F.col("len_m") + F.col("len_m") * (k / F.col("_m"))).alias("offset_m"),
    )


def _dealt(pieces: DataFrame | None, routes: DataFrame) -> DataFrame:
    """The pieces of ``routes``, or those at hand, dealt by route over as many tasks as their number needs."""
    return route_pieces(routes) if pieces is None else pieces.repartition(max(1, -(-pieces.count() // TASK_PIECES)), *_KEY)


def _cover(df: DataFrame, lons: list[str], lats: list[str], reach_m: float) -> DataFrame:
    """One row per grid cell that the box of the given points, widened by ``reach_m``, touches."""
    lo = lambda cs: F.least(*cs) if len(cs) > 1 else F.col(cs[0])
    hi = lambda cs: F.greatest(*cs) if len(cs) > 1 else F.col(cs[0])
    # one percent wider than the corridor, so the flat-frame distance decides, not the box
    pad_lat = reach_m * 1.01 / METRES_PER_DEGREE
    top = F.least(F.lit(89.0), F.greatest(F.abs(lo(lats)), F.abs(hi(lats))) + pad_lat)
    pad_lon = F.lit(pad_lat) / F.cos(F.radians(top))
    xs = F.sequence(F.floor((lo(lons) - pad_lon) / _DLON), F.floor((hi(lons) + pad_lon) / _DLON))
    ys = F.sequence(F.floor((lo(lats) - pad_lat) / _DLAT), F.floor((hi(lats) + pad_lat) / _DLAT))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _cell(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("lon") / _DLON), "cy": F.floor(F.col("lat") / _DLAT), "scale": lon_scale("lat")})


def corridor_join(routes: DataFrame, segments: DataFrame, corridor_m: float = 50.0, pieces: DataFrame | None = None) -> DataFrame:
    """Segments whose centre lies within the corridor of a route, once per route.

    ``pieces`` may pass on ``route_pieces(routes)`` where it is at hand already.

    ``distance_m`` is to the nearest piece and ``position_m`` the distance travelled to that point.
    The segment table is broadcast only if Spark finds it below the session's broadcast threshold.
    """
    validate(corridor_m=corridor_m)
    pieces = _cover(_dealt(pieces, routes), ["alon", "blon"], ["alat", "blat"], corridor_m)
    segs = _cell(segments.select("segment_id", "score", "lon", "lat"))
    frame = ("lon", "lat", "alon", "alat", "blon", "blat", "scale")
    j = pieces.join(segs, ["cx", "cy"]).withColumn("distance_m", point_leg_m(*frame)).where(F.col("distance_m") <= corridor_m)
    near = F.struct("distance_m", (F.col("offset_m") + F.col("piece_m") * leg_fraction(*frame)).alias("position_m"))
    return (
        j.groupBy(*_KEY, "segment_id").agg(F.min(near).alias("m"), F.max("score").alias("score"))
        .select(*_KEY, "segment_id", "score", "m.distance_m", "m.position_m")
    )


def travel_order(matches: DataFrame) -> DataFrame:
    """Number the matches of each route in the order they are passed, from 1.

    A route meets a bounded number of segments: they lie along one journey and count once.
    """
    w = Window.partitionBy(*_KEY).orderBy("position_m", "segment_id")
    return matches.withColumn("place", F.row_number().over(w))


def route_totals(routes: DataFrame, matches: DataFrame) -> DataFrame:
    """Expected KSI, number of hotspots, worst segment and the ordered list, for every route."""
    t = matches.groupBy(*_KEY).agg(
        F.sum("score").alias("expected_ksi"),
        F.count(F.lit(1)).alias("blackspot_count"),
        # highest score; ties go to the smallest id
        F.min(F.struct((-F.col("score")).alias("s"), "segment_id"))["segment_id"].alias("worst_segment_id"),
        F.array_sort(F.collect_list(F.struct("position_m", "segment_id", "score"))).alias("blackspots"),
    )
    empty = F.array().cast("array<struct<position_m:double,segment_id:string,score:double>>")
    return routes.join(t, _KEY, "left").select(
        *routes.columns,
        F.coalesce("expected_ksi", F.lit(0.0)).alias("expected_ksi"),
        F.coalesce("blackspot_count", F.lit(0).cast("long")).alias("blackspot_count"),
        "worst_segment_id",
        F.coalesce("blackspots", empty).alias("blackspots"),
    )


def label_routes(df: DataFrame) -> DataFrame:
    """Name the fastest and the safest of at most three candidates; ties by candidate number.

    With a ``status`` column, only routes that are ok compete and get a label.
    """
    ok = F.col("status") == "ok" if "status" in df.columns else F.lit(True)
    best = lambda c: F.min(F.when(ok, F.struct(c, "candidate"))).over(Window.partitionBy("request_id"))["candidate"]
    fastest, safest = F.col("candidate") == best("duration_s"), F.col("candidate") == best("expected_ksi")
    label = (
        F.when(~ok, None).when(fastest & safest, "Fastest and safest").when(fastest, "Fastest").when(safest, "Safest").otherwise("Alternative")
    )
    return df.withColumn("label", label)


def coverage(routes: DataFrame, segments: DataFrame, share: float = 0.5, pieces: DataFrame | None = None) -> DataFrame:
    """Per route: samples every 500 m, how many lie near any segment, and a warning if few do."""
    pieces = _dealt(pieces, routes)
    lo, hi = F.ceil(F.round(F.col("offset_m") / SAMPLE_M, 9)), F.ceil(F.round((F.col("offset_m") + F.col("piece_m")) / SAMPLE_M, 9)) - 1
    hi = F.when(F.col("offset_m") == 0, F.greatest(hi, F.lit(0))).otherwise(hi)  # a route without length has its start
    at = pieces.where(hi >= lo).withColumn("sample", F.explode(F.sequence(lo, hi)))
    t = F.coalesce(F.try_divide(F.col("sample") * SAMPLE_M - F.col("offset_m"), "piece_m"), F.lit(0.0))
    at = at.select(
        *_KEY, "sample",
        (F.col("alon") + (F.col("blon") - F.col("alon")) * t).alias("slon"),
        (F.col("alat") + (F.col("blat") - F.col("alat")) * t).alias("slat"),
    )
    cells = _cover(at, ["slon"], ["slat"], COVER_M)
    segs = _cell(segments.select("lon", "lat"))
    close = point_leg_m("lon", "lat", "slon", "slat", "slon", "slat", "scale") <= COVER_M
    met = cells.join(segs, (cells["cx"] == segs["cx"]) & (cells["cy"] == segs["cy"]) & close, "left")
    hit = met.groupBy(*_KEY, "sample").agg(F.max(F.col("lon").isNotNull()).alias("hit"))
    c = hit.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("samples"), F.count_if("hit").alias("covered"))
    few = F.col("covered") < share * F.col("samples")
    return c.withColumn("coverage_warning", F.when(few, "Few scored road segments near this route"))


def match_routes(routes: DataFrame, segments: DataFrame, min_crashes: int = 6, corridor_m: float = 50.0, pieces: DataFrame | None = None) -> DataFrame:
    return corridor_join(routes, evidenced(segments, min_crashes), corridor_m, pieces)
