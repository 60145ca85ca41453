import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import routes as rt
from kerbline.plans import answers
from kerbline.schemas import ROUTE
from tests.brute import metres

K = 111195.0802


def route_frame(spark, rows):
    return spark.createDataFrame([(q, c, [tuple(p) for p in path] if path is not None else None, d, s) for q, c, path, d, s in rows], ROUTE)


def seg_frame(spark, rows):
    return spark.createDataFrame(rows, "segment_id string, lon double, lat double, score double, n_crashes long")


def test_corridor_matches_brute_force(spark):
    """Crooked routes with long and zero-length legs against scattered segments."""
    r = random.Random(3)
    paths = {}
    for q in range(1, 7):
        p = [(-1.0 + r.uniform(-0.05, 0.05), 52.0 + r.uniform(-0.05, 0.05))]
        for _ in range(r.randint(1, 5)):
            p.append((p[-1][0] + r.uniform(-0.15, 0.15), p[-1][1] + r.uniform(-0.1, 0.1)))
        p.insert(1, p[0])
        paths[q] = p
    segs = [(f"s{i}", -1.0 + r.uniform(-0.3, 0.3), 52.0 + r.uniform(-0.2, 0.2), 1.0, 9) for i in range(3000)]
    got = rt.corridor_join(route_frame(spark, [(q, 1, p, 1.0, 1.0) for q, p in paths.items()]), seg_frame(spark, segs), 400.0)
    got = {(x["request_id"], x["segment_id"]): x["distance_m"] for x in got.collect()}
    import math

    want = {}
    for q, p in paths.items():
        for sid, x, y, _, _ in segs:
            kx, best = math.cos(math.radians(y)) * K, 1e9
            for (ax, ay), (bx, by) in zip(p, p[1:]):
                ux, uy, vx, vy = (bx - ax) * kx, (by - ay) * K, (x - ax) * kx, (y - ay) * K
                n = ux * ux + uy * uy
                t = max(0.0, min(1.0, (ux * vx + uy * vy) / n)) if n else 0.0
                best = min(best, math.hypot(vx - t * ux, vy - t * uy))
            if best <= 400:
                want[q, sid] = best
    assert set(got) == set(want) and len(want) > 50
    assert max(abs(got[k] - want[k]) for k in want) < 0.05


def test_segment_met_twice_counts_once_and_order(spark):
    path = [(-1.0, 52.0), (-1.0, 52.02), (-1.0003, 52.02), (-1.0003, 52.0)]
    segs = seg_frame(spark, [("far", -1.0, 52.018, 1.0, 9), ("near", -1.0, 52.002, 2.5, 9), ("few", -1.0, 52.01, 9.0, 5)])
    r = route_frame(spark, [(1, 1, path, 4500.0, 300.0)])
    out = answers.route_risk(r, segs).first()
    assert out["blackspot_count"] == 2 and out["expected_ksi"] == 3.5 and out["worst_segment_id"] == "near"
    assert [b["segment_id"] for b in out["blackspots"]] == ["near", "far"]
    assert out["label"] == "Fastest and safest" and out["status"] == "ok"
    assert out["blackspots"][0]["position_m"] == pytest.approx(metres(("", -1.0, 52.0), ("", -1.0, 52.002)), abs=0.01)


def test_empty_no_route_and_bad_coordinates(spark):
    r = route_frame(spark, [
        (1, 1, [(-1.0, 52.0), (-1.0, 52.01)], 1000.0, 60.0), (2, 1, [], 0.0, 0.0), (3, 1, None, None, None),
        (4, 1, [(52.0, -1.0), (52.0, -1.1)], 1.0, 1.0),
    ])
    out = {x["request_id"]: x for x in answers.route_risk(r, seg_frame(spark, [("s", -2.0, 53.0, 1.0, 9)])).collect()}
    assert [out[i]["status"] for i in (1, 2, 3, 4)] == ["ok", "no_route", "no_route", "bad_coordinates"]
    assert (out[1]["expected_ksi"], out[1]["blackspot_count"], out[1]["worst_segment_id"]) == (0.0, 0, None)
    assert out[1]["coverage_warning"] and out[2]["coverage_warning"] is None and out[2]["label"] is None


def test_candidates_and_labels(spark):
    p = [(-1.0, 52.0), (-1.0, 52.01)]
    rows = [(1, c, p, 5000.0, 100.0 - c) for c in range(1, 6)] + [(2, c, p, 150000.0 + c, 10.0 * c) for c in (1, 2, 3)]
    kept = rt.limit_candidates(route_frame(spark, rows))
    assert sorted((x["request_id"], x["candidate"]) for x in kept.collect()) == [(1, 3), (1, 4), (1, 5), (2, 1)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    d = spark.createDataFrame([(1, 1, 60.0, 2.0), (1, 2, 70.0, 1.0), (1, 3, 80.0, 3.0), (2, 1, 5.0, 0.0), (2, 2, 5.0, 0.0)], "request_id long, candidate int, duration_s double, expected_ksi double")
    got = {(x["request_id"], x["candidate"]): x["label"] for x in rt.label_routes(d).collect()}
    assert got == {(1, 1): "Fastest", (1, 2): "Safest", (1, 3): "Alternative", (2, 1): "Fastest and safest", (2, 2): "Alternative"}


def test_arguments(spark):
    for kw in ({"corridor_m": 9}, {"corridor_m": 501}, {"min_crashes": 0}):
        with pytest.raises(ValueError):
            answers.route_risk(route_frame(spark, []), seg_frame(spark, []), **kw)


def test_corridor_plan_has_no_nested_loop(spark):
    r = route_frame(spark, [(1, 1, [(-1.0, 52.0), (-1.0, 52.01)], 1.0, 1.0)])
    plan = rt.corridor_join(r, seg_frame(spark, [("s", -1.0, 52.0, 1.0, 9)]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pieces_are_dealt_by_their_number(spark, monkeypatch):
    """Routes of one partition spread over tasks by their pieces, a route whole in one task; matches and coverage stay."""
    monkeypatch.setattr(rt, "TASK_PIECES", 50)
    rows = [(q, 1, [(-1.0 + q / 1000, 52.0), (-1.0 + q / 1000, 52.09)], 1.0, 1.0) for q in range(60)]
    routes = route_frame(spark, rows).coalesce(1)
    pieces = rt.route_pieces(routes).withColumn("task", F.spark_partition_id())
    per = pieces.groupBy("request_id").agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("task"), F.count("*").alias("n")).collect()
    assert {x["tasks"] for x in per} == {1} and {x["n"] for x in per} == {11}
    assert len({x["task"] for x in per}) > 6
    segs = seg_frame(spark, [(f"s{i}", -1.0 + i / 1000, 52.03, 1.0, 9) for i in range(0, 60, 2)])
    stored = rt.route_pieces(routes)
    for at_hand in (None, stored):
        m = rt.corridor_join(routes, segs, 50.0, at_hand).collect()
        assert sorted((x["request_id"], x["segment_id"]) for x in m) == sorted((i, f"s{i}") for i in range(0, 60, 2))
    c = [rt.coverage(routes, segs, pieces=p).orderBy("request_id").collect() for p in (None, stored)]
    assert c[0] == c[1] and len(c[0]) == 60
