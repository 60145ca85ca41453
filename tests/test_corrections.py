"""Cases that were wrong once."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import filters, quality, routes as rt
from kerbline.plans.build import Windows, score_segments
from kerbline.operators.segments import segment_target
from kerbline.schemas import FEATURE_NAMES
from kerbline.sources.crash_files import read_crash_csv

ROUTE = "request_id long, candidate int, status string, duration_s double, distance_m double"


def chosen(spark, rows):
    df = rt.limit_candidates(spark.createDataFrame(rows, ROUTE))
    return sorted((r["request_id"], r["candidate"]) for r in df.collect())


def test_undrivable_candidate_takes_no_place_and_decides_nothing(spark):
    rows = [(1, 0, "no_route", None, None), (1, 1, "ok", 10.0, 5e4), (1, 2, "ok", 11.0, 5e4), (1, 3, "ok", 12.0, 1.2e5)]
    assert chosen(spark, rows) == [(1, 1), (1, 2), (1, 3)]
    rows = [(1, 0, "no_route", 0.0, 0.0), (1, 1, "ok", 10.0, 1.2e5), (1, 2, "ok", 11.0, 1.2e5)]
    assert chosen(spark, rows) == [(1, 1)]
    assert chosen(spark, [(2, 0, "no_route", None, None)]) == [(2, 0)]


def test_segment_without_score_stays_at_the_default(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "segment_id string, score double")
    assert {r[0] for r in filters.min_score(df).collect()} == {"a", "b"}
    assert {r[0] for r in filters.min_score(df, 0.1).collect()} == {"a"}


def test_only_numbered_classified_roads(spark):
    roads = ["A503", "A1(M)", "M25", "B6", "A0", "A", "U", "U12", "C5", None]
    df = spark.createDataFrame([(r,) for r in roads], "road_number string")
    assert {r[0] for r in filters.numbered_roads(df).collect()} == {"A503", "A1(M)", "M25", "B6", "A0"}


def test_exchanged_columns_are_an_error(spark, tmp_path):
    from kerbline.schemas import KINDS

    names = KINDS["vehicle"].fieldNames()
    swapped = [names[1], names[0], *names[2:]]
    (tmp_path / "v.csv").write_text(",".join(swapped) + "\n" + ",".join("1" for _ in names) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_crash_csv(spark, str(tmp_path / "v.csv"), "vehicle").collect()


def test_year_bounds_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT 's' AS segment_id, date'2020-05-01' AS occurred_on, 1L AS ksi").write.parquet(str(tmp_path / "c"))
    plan = segment_target(spark.read.parquet(str(tmp_path / "c")), (2020, 2021))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(occurred_on" in plan and "LessThan(occurred_on" in plan


def test_segments_without_an_early_crash_are_scored(spark):
    text = ("f_road_type", "f_junction_type")
    early = {c: F.lit("a") if c in text else F.rand(3) for c in FEATURE_NAMES} | {"f_crashes": F.col("id") % 5 + 1}
    df = spark.range(60).select(F.concat(F.lit("s"), "id").alias("segment_id"), (F.col("id") % 3).alias("ksi_target"), *[F.when(F.col("id") % 4 != 0, c).alias(n) for n, c in early.items()])
    scored = score_segments(df, k=2, rounds=2, depth=2, min_instances=1)
    assert scored.count() == 60 and scored.where("score > 0").count() == 60


def test_windows_fit_the_inputs():
    for bad in (((2018, 2021), (2022, 2023)), ((2019, 2021), (2021, 2023))):
        with pytest.raises(ValueError):
            Windows(*bad)


def test_children_take_the_year_of_their_collision(spark):
    c = spark.sql("SELECT * FROM VALUES (1L, date'2020-01-01'), (2L, date'2021-01-01') AS t(collision_id, occurred_on)")
    m = spark.sql("SELECT * FROM VALUES ('vehicle', 2020, 2L), ('vehicle', 2021, 1L) AS t(kind, year, expected_rows)")
    v = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (9, 1)], "collision_id long, vehicle_no int")
    got = {r["year"]: r["status"] for r in quality.completeness(v, m, "vehicle", c).collect()}
    assert got == {2020: "short", 2021: "long", None: "unexpected"}
    with pytest.raises(ValueError):
        quality.completeness(v, m, "vehicle")


def test_rejected_rows_are_counted_by_reason(spark):
    rows = [("A1", -1.0, 52.0), ("A", -1.0, 52.0), (None, None, None), ("A1", None, 52.0), ("A1", 52.0, -1.0), ("A1", 20.0, 10.0)]
    got = {r["reason"]: r["n"] for r in quality.rejected(spark.createDataFrame(rows, "road_number string, lon double, lat double")).collect()}
    assert got == {"no numbered road": 2, "coordinates missing": 1, "coordinates swapped": 1, "coordinates outside": 1}
