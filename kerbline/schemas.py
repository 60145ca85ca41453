"""Table schemas, stated once; nothing is ever inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


COLLISION = _schema(
    ("collision_id", _L), ("occurred_on", T.DateType()), ("hour", _I), ("road_number", _S), ("lon", _D), ("lat", _D),
    ("severity_raw", _S), ("speed_limit", _I), ("road_type", _S), ("junction_type", _S), ("is_urban", _B), ("lighting", _S),
)
VEHICLE = _schema(("collision_id", _L), ("vehicle_no", _I), ("vehicle_type", _S), ("point_of_impact", _S))
CASUALTY = _schema(("collision_id", _L), ("casualty_no", _I), ("age", _I), ("severity", _S))
KINDS = {"collision": COLLISION, "vehicle": VEHICLE, "casualty": CASUALTY}

MANIFEST = _schema(("kind", _S), ("year", _I), ("expected_rows", _L))

LONLAT = _schema(("lon", _D), ("lat", _D))
ROUTE = _schema(
    ("request_id", _L), ("candidate", _I), ("path", T.ArrayType(LONLAT)), ("distance_m", _D), ("duration_s", _D)
)

# The 24 inputs of the count model: name, family, and whether it is known before a crash happens.
FEATURES = [
    ("f_crashes", "history", _L), ("f_ksi", "history", _L), ("f_fatal", "history", _L), ("f_serious", "history", _L),
    ("f_slight", "history", _L), ("f_casualties_per_crash", "history", _D), ("f_vehicles_per_crash", "history", _D),
    ("f_year1", "history", _L), ("f_year2", "history", _L), ("f_year3", "history", _L),
    ("f_speed_mode", "speed", _I), ("f_speed_mean", "speed", _D),
    ("f_road_type", "road", _S), ("f_junction_type", "road", _S), ("f_junction_share", "road", _D),
    ("f_urban_share", "setting", _D), ("f_unlit_share", "lighting", _D), ("f_night_share", "night", _D),
    ("f_lon", "location", _D), ("f_lat", "location", _D), ("f_extent_m", "location", _D),
    ("f_start_m", "position", _D), ("f_position_share", "position", _D), ("f_stretch_m", "position", _D),
]
FEATURE_NAMES = [n for n, _, _ in FEATURES]
CATEGORICAL = ["f_road_type", "f_junction_type"]

SEGMENT = _schema(
    ("segment_id", _S), ("road_number", _S), ("run", _I), ("km", _D), ("lon", _D), ("lat", _D), ("n_crashes", _L),
    *[(n, t) for n, _, t in FEATURES],
    ("ksi_target", _L), ("score", _D), ("rank", _L), ("tier", _S), ("display", _I),
)
