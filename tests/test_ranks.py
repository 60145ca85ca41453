import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import evaluate, quality, ranks, running, sketches
from kerbline.plans import answers


def segs(spark, rows):
    return spark.createDataFrame(rows, "segment_id string, score double, n_crashes long, ksi_target long, f_crashes long")


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(4)
    rows = [(f"s{i:04d}", r.choice([0.5, 1.0, 1.5, 7.25]), r.randint(1, 12), r.randint(0, 3), r.randint(0, 5)) for i in range(500)]
    return segs(spark, rows).repartition(7), rows


def test_global_rank_and_running_sums(many):
    df, rows = many
    out = running.global_rank(df, [F.col("score").desc(), F.col("segment_id").asc()], "rank", {"upto": "ksi_target"})
    got = {x["segment_id"]: (x["rank"], x["upto"]) for x in out.collect()}
    total = 0
    for i, row in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        total += row[3]
        assert got[row[0]] == (i, total)


def test_exact_quantiles(many):
    df, rows = many
    import numpy as np

    want = np.quantile([r[1] for r in rows], [0, 0.5, 0.8, 0.95, 1.0])
    assert running.exact_quantiles(df, "score", [0, 0.5, 0.8, 0.95, 1.0]) == pytest.approx(list(want))
    assert running.exact_quantiles(df.where("false"), "score", [0.5]) == [None]


def test_capture_by_hand(spark):
    df = segs(spark, [("a", 9.0, 9, 5, 1), ("b", 8.0, 9, 0, 9), ("c", 1.0, 9, 3, 3), ("d", 0.5, 9, 2, 2), ("e", 0.1, 9, 0, 0)])
    assert ranks.capture(df, "score", "ksi_target").first()["captured"] == 0.5
    r = ranks.capture_compare(df, "score", "f_crashes", "ksi_target").first()
    assert (r["model"], r["baseline"], r["gain"]) == (0.5, 0.0, 0.5)
    assert [x["captured"] for x in ranks.gains(df, "score", "ksi_target", 5).orderBy("step").collect()] == [0.5, 0.5, 0.8, 1.0, 1.0]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 1), (1.0, 0)], "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()["auc"] == 0.5
    assert evaluate.roc_auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_auc_brute_force(spark):
    r = random.Random(8)
    rows = [(r.randint(0, 9), r.randint(0, 1)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first()["auc"] == pytest.approx(want)


def test_balance_is_even_and_repeatable(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    a = {x["id"] for x in evaluate.balance(df, "y", "id").collect()}
    b = {x["id"] for x in evaluate.balance(df.repartition(9), "y", "id").collect()}
    assert a == b and len(a) == 60 and sum(i % 10 == 0 for i in a) == 30


def test_no_evidence_means_no_tiers(spark):
    df = segs(spark, [("a", 1.0, 2, 0, 1)])
    assert ranks.tier_cutoffs(df) is None
    assert ranks.with_tiers(df, None).first()["tier"] is None


def test_list_segments_arguments(spark):
    df = segs(spark, [("a", 1.0, 6, 0, 1), ("b", 1.0, 7, 0, 1), ("c", 2.0, 5, 0, 1)]).withColumns({"lon": F.lit(0.0), "lat": F.lit(51.0)})
    assert [r["segment_id"] for r in answers.list_segments(df).collect()] == ["a", "b"]
    assert [r["segment_id"] for r in answers.list_segments(df, min_crashes=1, limit=2).collect()] == ["c", "a"]
    with pytest.raises(ValueError):
        answers.list_segments(df, limit=2001)
    plan = answers.list_segments(df, "-1,50,1,52")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_completeness(spark):
    c = spark.sql("select explode(array('2015-01-01','2015-02-01','2016-05-05','2018-01-01')) d").select(F.to_date("d").alias("occurred_on"))
    m = spark.createDataFrame([("collision", 2015, 2), ("collision", 2016, 3), ("collision", 2017, 1)], "kind string, year int, expected_rows long")
    got = {r["year"]: r["status"] for r in quality.completeness(c, m, "collision").collect()}
    assert got == {2015: "complete", 2016: "short", 2017: "missing", 2018: "unexpected"}


def test_leak_guard(spark):
    c = spark.sql("select explode(array('2019-01-01','2021-12-31','2022-01-01')) d").select(F.to_date("d").alias("occurred_on"))
    quality.assert_no_leak(c, (2019, 2021), (2022, 2023))
    with pytest.raises(ValueError):
        quality.assert_no_leak(c, (2019, 2022), (2022, 2023))
    with pytest.raises(ValueError):
        quality.assert_no_leak(c, (2019, 2021), (2022, 2023), ["casualty_age_mean"])
    assert quality.deployable_columns(["speed_limit", "casualty_age_10", "vehicle_count", "point_of_impact_front", "f_ksi"]) == ["speed_limit", "f_ksi"]


def test_density_pyramid_keeps_the_weight(spark):
    rows = [(0.05, 51.0, 2.0), (0.05, 51.0, 1.0), (-0.01, -0.01, 4.0), (None, 51.0, 9.0), (1.0, 51.0, None)]
    got = ranks.density_pyramid(spark.createDataFrame(rows, "lon double, lat double, score double"), 0.1, levels=4).collect()
    for level in range(4):
        assert sum(r["weight"] for r in got if r["level"] == level) == pytest.approx(7.0)
    cells = {(r["cell_x"], r["cell_y"]): r["weight"] for r in got if r["level"] == 0}
    assert cells[0, 510] == 3 * 4 / 16 and cells[-1, 510] == 3 * 2 / 16 and cells[-1, 509] == 3 / 16 and cells[-1, -1] == 1.0 and cells[-2, -2] == 0.25
    assert {(r["cell_x"], r["cell_y"]) for r in got if r["level"] == 1} == {(x >> 1, y >> 1) for x, y in cells}


def test_capture_interval_against_a_loop(spark):
    """Weights, rankings and shares of each replicate, one after another."""
    import hashlib
    import math
    import random

    r = random.Random(3)
    rows = [(f"s{i}", float(r.randint(0, 9)), float(r.randint(0, 3)), r.randint(0, 4)) for i in range(80)]
    got = ranks.replicate_captures(spark.createDataFrame(rows, "segment_id string, a double, b double, t int"), "segment_id", ["a", "b"], "t", replicates=12).collect()
    assert len(got) == 12

    def weight(b, key):
        u, p, total, k = int(hashlib.md5(f"{b}:{key}".encode()).hexdigest()[:8], 16) / 2**32, math.exp(-1), 0.0, 0
        while k < 9 and u >= total + p:
            total, k = total + p, k + 1
            p /= k
        return k

    for x in got:
        w = {row[0]: weight(x["replicate"], row[0]) for row in rows}
        most, all_ = math.ceil(round(0.2 * sum(w.values()), 9)), sum(w[row[0]] * row[3] for row in rows)
        for name, at in (("a", 1), ("b", 2)):
            up = hit = 0
            for row in sorted(rows, key=lambda row: (-row[at], row[0])):
                up += w[row[0]]
                hit += w[row[0]] * row[3] if up <= most else 0
            assert x[name] == pytest.approx(hit / all_)


def test_search_index(spark, tmp_path):
    """Equal to looking at every row, also for short, unknown and empty terms, nulls and rows with all trigrams only."""
    import random

    from kerbline.operators import text_index as ti

    r = random.Random(5)
    rows = [(i, "".join(r.choice("abAB1_é") for _ in range(r.randint(0, 9))), r.choice([None, "xyz", "abab"])) for i in range(400)] + [(400, "abcxbcd", None), (401, "xabcdx", None), (402, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, road string")
    ti.write_index(df, "id", ["name", "road"], f"{tmp_path}/i", files=3)
    for term in ("abcd", "ABA", "bab1", "ab", "", "nothere", "xyz", "é_a"):
        want = {i for i, *texts in rows if any(x is not None and term.lower() in x.lower() for x in texts)}
        assert {x["id"] for x in ti.search_index(spark, f"{tmp_path}/i", df, "id", ["name", "road"], term).collect()} == want


def test_sketches_merge_within_the_stated_rank_error(spark):
    """Half of all rows on one road, many ties, nulls; parts by year, merged by road and for all."""
    rows = spark.range(60000).selectExpr(
        "id", "if(id % 2 = 0, 'A1', concat('A', id % 97)) AS road_number", "id % 7 AS year",
        "CASE WHEN id % 50 = 3 THEN NULL ELSE pmod(hash(id), 9000) DIV (1 + id % 3) / 4D END AS score",
    )
    every = F.array(F.col("road_number"), F.lit("all"))
    both = rows.withColumn("road_number", F.explode(every))
    parts = sketches.sketches(rows, ["road_number", "year"])
    roads = sketches.merged(parts, ["road_number"])
    whole = sketches.merged(parts, []).select(F.lit("all").alias("road_number"), "n", "sketch")
    shares = [0.01, 0.5, 0.8, 0.95, 0.999]
    got = sketches.rank_check(both, roads.unionByName(whole), ["road_number"], shares).collect()
    names = {r.road_number for r in rows.select("road_number").distinct().collect()} | {"all"}
    assert len(got) == len(names) * len(shares) and all(r.within for r in got)
    small = [r for r in got if r.n <= sketches.SIZE]
    assert small and all(r.low < r.share <= r.high for r in small)  # held whole: exact
    assert {r.n for r in got if r.road_number == "all"} == {rows.where("score IS NOT NULL").count()}
    hot = parts.where("road_number = 'A1'").agg(F.max(F.length("sketch"))).first()[0]
    assert hot < 40 * sketches.SIZE  # bytes, whatever the rows
    c, exact = sketches.sketched_cutoffs(parts), ranks.exact_quantiles(rows, "score", [1.0])
    assert c.top == exact[0] and c.elevated <= c.severe <= c.critical <= c.top


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([("A1", None)], "road_number string, score double")
    assert sketches.sketches(none, ["road_number"]).count() == 0
    assert sketches.sketched_cutoffs(sketches.sketches(none, ["road_number"])) is None
