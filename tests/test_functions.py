import pytest
from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_m, leg_fraction, lonlat, point_leg_m, polyline_m
from kerbline.functions.ids import fold_of, is_night, json_error, md5_number, parse_segment_id, segment_id
from kerbline.functions.scale import PUBLISHED_CUTOFFS, Cutoffs, display_score, tier, tier_colour
from kerbline.operators import filters


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tier_bounds_are_inclusive_below(spark):
    df = spark.createDataFrame([(0.939,), (0.94,), (1.57,), (3.09,), (None,)], "s double")
    assert [r[0] for r in df.select(tier("s", PUBLISHED_CUTOFFS)).collect()] == ["Watch", "Elevated", "Severe", "Critical", None]


def test_display_stays_inside_its_tier(spark):
    c = Cutoffs(1.0, 2.0, 4.0, 8.0)
    df = spark.createDataFrame([(0.0,), (0.9999999999,), (1.0,), (1.9999999999,), (2.0,), (4.0,), (8.0,), (9.0,)], "s double")
    assert [r[0] for r in df.select(display_score("s", c)).collect()] == [0, 24, 25, 49, 50, 75, 100, 100]
    flat = Cutoffs(1.0, 1.0, 1.0, 1.0)
    assert [r[0] for r in df.limit(3).select(display_score("s", flat)).collect()] == [0, 24, 100]


def test_colours(spark):
    df = spark.createDataFrame([("Watch",), ("Elevated",), ("Severe",), ("Critical",)], "t string")
    assert [r[0] for r in df.select(tier_colour("t")).collect()] == ["Orange Yellow", "Orange Yellow", "Spectrum Red", "Aconite Violet"]


def test_segment_id_round_trip(spark):
    r = one(spark, segment_id(F.lit("A23"), F.lit(3), F.lit(0.5)).alias("i"), parse_segment_id(F.lit("A1(M)_run12_km10.0")).alias("p"), parse_segment_id(F.lit("A23_run3")).alias("q"))
    assert r["i"] == "A23_run3_km0.5"
    assert tuple(r["p"]) == ("A1(M)", 12, 10.0) and r["q"] is None


def test_distances(spark):
    pt = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    r = one(
        spark,
        haversine_m(F.lit(0.0), F.lit(51.0), F.lit(0.0), F.lit(52.0)).alias("degree"),
        point_leg_m(*[F.lit(v) for v in (0.001, 52.0, 0.0, 51.9, 0.0, 52.1)]).alias("side"),
        point_leg_m(*[F.lit(v) for v in (0.0, 52.2, 0.0, 51.9, 0.0, 52.1)]).alias("past_end"),
        point_leg_m(*[F.lit(v) for v in (0.0, 52.001, 0.0, 52.0, 0.0, 52.0)]).alias("no_length"),
        leg_fraction(*[F.lit(v) for v in (0.0, 52.0, 0.0, 51.9, 0.0, 52.1)]).alias("half"),
        polyline_m(F.array(pt(0.0, 51.0), pt(0.0, 51.5), pt(0.0, 52.0))).alias("line"),
        polyline_m(F.array(pt(0.0, 51.0))).alias("point"),
        lonlat(F.array(F.lit(-0.1), F.lit(51.5)))["lat"].alias("lat"),
    )
    assert r["degree"] == pytest.approx(111195.08, abs=0.1)
    assert r["side"] == pytest.approx(68.46, abs=0.05)
    assert r["past_end"] == pytest.approx(11119.5, abs=1)
    assert r["no_length"] == pytest.approx(111.195, abs=0.01)
    assert r["half"] == pytest.approx(0.5)
    assert r["line"] == pytest.approx(r["degree"]) and r["point"] == 0.0 and r["lat"] == 51.5


def test_night_fold_and_json(spark):
    r = one(
        spark,
        *[is_night(F.lit(h)).alias(f"h{h}") for h in (18, 19, 6, 7)],
        md5_number(F.lit("A1_run1_km0.0")).alias("m"), fold_of(F.lit("x"), 5).alias("f"), json_error(F.lit("no")).alias("j"),
    )
    assert (r["h18"], r["h19"], r["h6"], r["h7"]) == (False, True, True, False)
    assert 0 <= r["m"] < 2**32 and 0 <= r["f"] < 5 and r["j"] == '{"message":"no"}'


def test_arguments():
    for bad in ({"corridor_m": 9}, {"corridor_m": 501}, {"limit": 0}, {"limit": 2001}, {"min_crashes": 0}, {"bbox": "1,2,3"}, {"bbox": "3,2,1,4"}, {"bbox": "a,b,c,d"}):
        with pytest.raises(ValueError):
            filters.validate(**bad)
    filters.validate(corridor_m=10, limit=1, min_crashes=1, bbox="-1,50,1,52")
    filters.validate(corridor_m=500, limit=2000)


def test_coordinate_guard(spark):
    df = spark.createDataFrame([(-0.1, 51.5), (51.5, -0.1), (None, 51.5), (10.0, 51.5)], "lon double, lat double")
    assert [r["coord_status"] for r in filters.flag_coordinates(df).collect()] == ["ok", "swapped", "missing", "outside"]


def test_lookup(spark):
    df = spark.createDataFrame([("A1_run1_km0.0", "A1")], "segment_id string, road_number string")
    assert filters.get_segment(df, "A1_run1_km0.0")["road_number"] == "A1"
    with pytest.raises(LookupError):
        filters.get_segment(df, "nope")
    assert filters.search(df, "RUN1").count() == 1 and filters.search(df, "x").count() == 0


def test_road_numbers(spark):
    df = spark.createDataFrame([("A503",), ("M25",), ("A1(M)",), (None,), ("",), ("a1",), ("0",)], "road_number string")
    assert [r[0] for r in filters.numbered_roads(df).collect()] == ["A503", "M25", "A1(M)"]
