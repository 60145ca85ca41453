import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import curve
from kerbline.operators import quality
from kerbline.operators.segments import features, features_target, segment_table, segment_target
from kerbline.plans.answers import stats_summary
from kerbline.plans.build import Windows, build_segments
from kerbline.schemas import COLLISION, FEATURE_NAMES
from kerbline.sources import crash_files, tables


def test_csv_keeps_unreadable_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text("collision_id,vehicle_no,vehicle_type,point_of_impact\n1,1,car,front\nx,2,van,back\n2,1,car,left\n")
    df = crash_files.read_crash_csv(spark, str(tmp_path / "c.csv"), "vehicle").cache()
    assert df.count() == 3 and df.where("_corrupt is not null").count() == 1


@pytest.fixture(scope="module")
def crash_tables(spark):
    """One road, 600 crashes over 6 km, 2019 to 2023."""
    c = spark.range(600).select(
        "id", F.make_date((2019 + F.col("id") % 5).cast("int"), F.lit(6), F.lit(1)).alias("occurred_on"), (F.col("id") % 24).cast("int").alias("hour"),
        F.lit("A1").alias("road_number"), F.lit(-1.0).alias("lon"), (52.0 + F.col("id") % 120 * 0.00045).alias("lat"), F.lit("x").alias("severity_raw"),
        (F.col("id") % 3 * 10 + 30).cast("int").alias("speed_limit"), F.lit("single").alias("road_type"), F.lit("none").alias("junction_type"),
        (F.col("id") % 2 == 0).alias("is_urban"), F.lit("daylight").alias("lighting"),
    ).withColumnRenamed("id", "collision_id")
    c = c.select(*[F.col(f.name).cast(f.dataType) for f in COLLISION.fields])
    kid = c.select("collision_id")
    v = kid.select("collision_id", F.lit(1).alias("vehicle_no"), F.lit("car").alias("vehicle_type"), F.lit("front").alias("point_of_impact"))
    s = kid.select("collision_id", F.lit(1).alias("casualty_no"), F.lit(30).alias("age"), F.when(F.col("collision_id") % 4 == 0, "serious").otherwise("slight").alias("severity"))
    return c, v, s


def test_build_write_and_read(spark, crash_tables, tmp_path):
    out = build_segments(*crash_tables, Windows(), k=2, rounds=2, depth=2, min_instances=1)
    path = str(tmp_path / "seg")
    tables.write_segments(out, path)
    back = tables.read_segments(spark, path)
    assert back.agg(F.sum("n_crashes")).first()[0] == 600
    assert sorted(r["rank"] for r in back.collect()) == list(range(1, back.count() + 1))
    tables.write_segments(out, str(tmp_path / "csv"), "csv")
    assert tables.read_segments(spark, str(tmp_path / "csv"), "csv").count() == back.count()
    tables.write_top_json(back, str(tmp_path / "top"), 3)
    assert spark.read.json(str(tmp_path / "top")).count() == 3
    tables.write_metadata(back, {"gap_m": 5000, "block_m": 500}, str(tmp_path / "meta"))
    meta = spark.read.json(str(tmp_path / "meta")).first()
    assert meta["collisions"] == 600 and meta["parameters"]["gap_m"] == "5000"
    for _ in range(2):
        tables.publish(back, "segments_published")
    assert spark.table("segments_published").count() == back.count()
    compare = spark.createDataFrame([(0.2, 0.5, 0.4, 0.1)], "share double, model double, baseline double, gain double")
    factors = spark.createDataFrame([("b", 2, 0.3), ("a", 1, 0.7)], "feature string, rank int, weight double")
    severity = spark.createDataFrame([("deployable", 0.6)], "model string, auc double")
    tables.write_stats(stats_summary(back, compare, factors, severity), str(tmp_path / "stats"))
    text = next((tmp_path / "stats").glob("*.json")).read_text()
    stats = json.loads(text)
    assert stats["headline"]["collisions"] == 600 and [f["feature"] for f in stats["factors"]] == ["a", "b"]


def test_one_pass_table_equals_separate_aggregates(spark, crash_tables):
    c = crash_tables[0].withColumns({
        "segment_id": F.concat(F.lit("A1_run1_km"), (F.col("collision_id") % 7).cast("string")), "run": F.lit(1), "km": F.lit(0.0), "block": (F.col("collision_id") % 7).cast("int"),
        "chainage": F.col("collision_id") % 7 * 500.0, "stretch_m": F.lit(3500.0), "ksi": F.col("collision_id") % 2, "n_fatal": F.lit(0).cast("long"),
        "n_serious": F.col("collision_id") % 2, "n_slight": F.lit(1).cast("long"), "n_casualties": F.lit(2).cast("long"), "n_vehicles": F.lit(1).cast("long"),
    })
    one = segment_table(c, (2019, 2021), (2022, 2023)).select("segment_id", *FEATURE_NAMES, "ksi_target")
    two = features_target(features(c, (2019, 2021)), segment_target(c, (2022, 2023)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_year_folders_and_routes(spark, crash_tables, tmp_path):
    crash_files.store_by_year(crash_tables[0], str(tmp_path / "store"))
    df = crash_files.read_store(spark, str(tmp_path / "store"), "collision", (2020, 2021))
    assert df.count() == 240
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "r.json").write_text('{"request_id":1,"candidate":1,"path":[{"lon":-1.0,"lat":52.0},{"lon":-1.0,"lat":52.1}],"distance_m":1.0,"duration_s":2.0}\n')
    assert tables.read_routes(spark, str(tmp_path / "r.json")).first()["path"][1]["lat"] == 52.1


def test_versions(spark, tmp_path):
    """A failed load changes nothing, the same rows again change nothing, older snapshots come back."""
    v = tables.Versions(spark, f"{tmp_path}/published", keep=1)
    with pytest.raises(FileNotFoundError):
        v.read()
    a, b, c = (spark.range(n).withColumn("score", F.col("id") * 1.5) for n in (5, 7, 9))
    first = v.publish(a)
    assert v.publish(a.repartition(3)) == first and v.history() == [first] and v.read().count() == 5
    with pytest.raises(Exception, match="broken"):
        v.publish(b.withColumn("score", F.raise_error(F.lit("broken")).cast("double")))
    assert v.read().count() == 5
    second = v.publish(b)
    open_reader = v.read()
    third = v.publish(c)
    assert v.history() == [second, third] and open_reader.count() == 7
    assert v.rollback() == second and v.read().count() == 7
    with pytest.raises(ValueError):
        v.rollback()
    assert v.publish(spark.range(0)) and v.read().count() == 0


def test_routes_of_pairs(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id": 1, "candidate": 1, "path": [[-0.1, 51.5], [-0.2, 51.6], [3]], "distance_m": 10, "duration_s": 1}\n')
    r = tables.read_routes(spark, str(tmp_path / "r.json"), pairs=True)
    assert r.schema["path"].dataType.simpleString() == tables.ROUTE["path"].dataType.simpleString()
    assert [tuple(p) if p else None for p in r.first()["path"]] == [(-0.1, 51.5), (-0.2, 51.6), None]


def test_curve_store_prunes_both_ways(spark, tmp_path):
    """Boxes narrow in longitude or in latitude, and a path, against all rows; row groups and files they touch."""
    import pyarrow.parquet as pq

    r = random.Random(6)
    rows = [(i, r.uniform(-6, 2), r.uniform(50, 58)) for i in range(40_000)] + [(-1, None, 51.0), (-2, float("nan"), 51.0)]
    path = f"{tmp_path}/store"
    tables.write_curve(spark.createDataFrame(rows, "id long, lon double, lat double"), path, row_group_bytes=1 << 15)
    groups = [(f, s.min, s.max) for f in pathlib.Path(path).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)
        for c in [m.row_group(g).column(m.num_columns - 1)] for s in [c.statistics] if s.has_min_max]
    assert len(groups) >= 16
    for box in ((-1.0, 50.0, -0.9, 58.0), (-6.0, 54.0, 2.0, 54.1), (-1.3, 52.2, -0.7, 52.6), (0.5, 50.0, 0.5, 50.0)):
        got = {x["id"] for x in tables.read_box(spark, path, box).collect()}
        assert got == {i for i, x, y in rows if x is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
        ranges = curve.box_ranges(box)
        touched = [f for f, a, b in groups if any(a <= hi and lo <= b for lo, hi in ranges)]
        assert len(ranges) <= 32 and len(touched) < len(groups) / 2 and len(set(touched)) < 16
    plan = tables.read_box(spark, path, (-1.3, 52.2, -0.7, 52.6))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "Or(Or(" in plan
    way = [(-3.0, 51.0), (-2.5, 51.4), (-1.0, 51.4)]
    near = {x["id"] for x in tables.read_near(spark, path, way, 2000.0).collect()}
    boxes = curve.path_boxes(way, 2000.0)
    assert near >= {i for i, x, y in rows if x is not None and any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for b in boxes)} and len(near) < 4_000


def test_file_audit(spark, tmp_path):
    """Real files: whole, cut within the last line, a bad line in the middle, without the last line end, CRLF."""
    head, rows = "id,day,n\n", "1,2020-01-01,4\n2,2020-01-02,5\n"
    texts = {"ok.csv": head + rows, "cut.csv": head + rows + "3,2020-0", "corrupt.csv": head + "1,2020-01-01\n" + rows, "unterminated.csv": head + rows[:-1], "crlf.csv": (head + rows).replace("\n", "\r\n"), "héad.csv": head}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    got = {x["file"]: x for x in quality.audit_files(quality.read_lines(spark, str(tmp_path)), "id long, day date, n int").collect()}
    assert {n: x["status"] for n, x in got.items()} == {n: "ok" if n in ("crlf.csv", "héad.csv") else n[:-4] for n in texts}
    assert got["cut.csv"]["rows"] == 3 and got["cut.csv"]["corrupt_rows"] == 1 and got["ok.csv"]["rows"] == 2 and got["héad.csv"]["rows"] == 0
    assert quality.audit_files(quality.read_lines(spark, str(tmp_path)).limit(0), "id long").count() == 0


def test_a_repeated_mapping_row_multiplies_nothing(spark):
    df = spark.sql("SELECT 1 AS collision_id, DATE'2020-01-01' AS occurred_on, 'Serious' AS severity_raw UNION ALL SELECT 2, DATE'2021-01-01', 'Serious'")
    mapping = spark.createDataFrame([(2020, "Serious", "serious", 0.9), (2020, "Serious", "serious", 0.9), (2020, "Serious", "severe", 1.0)], "year int, raw string, label string, weight double")
    got = {x["collision_id"]: (x["severity"], x["severity_weight"]) for x in quality.harmonise_severity(df, mapping).collect()}
    assert got == {1: ("serious", 0.9), 2: ("Serious", 1.0)}
