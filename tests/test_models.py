import datetime as dt
import glob
import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kerbline.models import boost, learner, linear, margins, severity, shap
from kerbline.models.assemble import apply_assembly, assemble
from kerbline.models.shap import factor_ranking, leaf_contributions, shap_values


@pytest.fixture(scope="module")
def counts(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        x = [r.uniform(0, 1), r.uniform(0, 1), r.randint(0, 3)]
        lam = math.exp(-0.5 + 1.5 * (x[0] > 0.5) + 0.4 * x[2])
        rows.append((f"k{i}", *map(float, x), int(np.random.default_rng(i).poisson(lam))))
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, ksi_target int")
    # c becomes a category, so both kinds of split occur
    df = StringIndexer(inputCol="t", outputCol="x").fit(df := df.withColumn("t", F.col("c").cast("string"))).transform(df).drop("c", "t").withColumnRenamed("x", "c")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("id", "features", "ksi_target").cache()


@pytest.fixture(scope="module")
def model(counts):
    return boost.fit_poisson_gbt(counts, rounds=5, rate=0.5, depth=3, min_instances=5, cut_every=2)


def test_loss_falls_and_totals_agree(counts, model):
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    r = boost.dispersion_check(model.predict(counts), "ksi_target", "score").first()
    assert r["expected"] == pytest.approx(r["observed"], rel=0.15)


def test_constant_inputs_give_the_mean(spark):
    df = spark.createDataFrame([(1.0, i % 3) for i in range(60)], "a double, ksi_target int")
    v = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    m = boost.fit_poisson_gbt(v, rounds=1, min_instances=1)
    assert m.predict(v).agg(F.min("score"), F.max("score")).first() == (pytest.approx(1.0), pytest.approx(1.0))


def test_save_and_load(spark, counts, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = boost.PoissonModel.load(spark, str(tmp_path / "m"))
    a, b = (m.predict(counts).agg(F.sum("score")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)


def test_shap_sums_to_the_raw_score(counts, model):
    raw = counts.select("id", model.raw(counts).alias("_raw"))
    total = F.aggregate("contributions", F.col("base") + model.base, lambda s, v: s + v)
    out = shap_values(model, counts, "id").join(raw, "id").select(F.max(F.abs(total - F.col("_raw"))).alias("gap"), F.count(F.lit(1)).alias("n")).first()
    assert out["n"] == 400 and out["gap"] < 1e-9


def test_shap_terms_are_worked_out_once_a_pattern(monkeypatch):
    """5,000 rows in two batches, leaves of none to seven inputs: at most 64 patterns a leaf, and the values of every row worked out."""
    r = np.random.default_rng(4)
    condition = lambda: shap.Condition(float(low := r.integers(-1, 40)), float(low + 20)) if r.random() < 0.7 else shap.Condition(categories=frozenset({1.0, 5.0, 9.0}))
    leaves = [shap.Leaf(float(r.normal()), {int(f): (condition(), float(r.random())) for f in r.choice(9, m, replace=False)}) for m in (0, 1, 3, 5, 6, 7)]
    x = r.integers(0, 64, (5000, 9)).astype(np.uint8)
    want = np.zeros(x.shape)
    for leaf in leaves[1:]:
        on = np.stack([c.met(x[:, f]) for f, (c, _) in leaf.path.items()], 1).astype(float)
        want[:, list(leaf.path)] += shap._terms(leaf.value, np.array([s for _, s in leaf.path.values()]), on)
    worked, real = [], shap._terms
    monkeypatch.setattr(shap, "_terms", lambda v, share, on: worked.append(on.shape) or real(v, share, on))
    got = np.concatenate([leaf_contributions(leaves, part)[0] for part in (x[:3000], x[3000:])])
    assert (got == want).all()
    assert (leaf_contributions(leaves, x.astype(np.int64))[0] == want).all()
    assert sorted(n for n, m in worked if m < 7) == [2, 8, 32, 64]


def test_shap_matches_the_definition(counts, model):
    """Average marginal contribution over all orders of the three inputs, on a few rows."""
    leaves = model.leaves()
    x = model.bins(model.inputs_of(counts, "id").limit(6).toPandas())
    assert {c.categories is None for leaf in leaves for c, _ in leaf.path.values()} == {True, False}
    phi, _ = leaf_contributions(leaves, x)

    def game(row, known):
        return sum(
            leaf.value * math.prod((float(cond.met(row[f])) if f in known else share) for f, (cond, share) in leaf.path.items()) for leaf in leaves
        )

    for i, row in enumerate(x):
        for f in range(3):
            total = 0.0
            for order in itertools.permutations(range(3)):
                before = set(order[: order.index(f)])
                total += game(row, before | {f}) - game(row, before)
            assert phi[i, f] == pytest.approx(total / 6, abs=1e-9)


def test_out_of_fold_never_sees_its_fold(counts):
    """Labels of one fold turned upside down leave its own scores as they were, and change the others'."""
    how = {"k": 2, "rounds": 2, "rate": 0.5, "depth": 3, "min_instances": 5}
    scored, models = boost.out_of_fold(counts, "id", **how)
    assert scored.count() == 400 and len(models) == 2
    other = counts.withColumn("ksi_target", F.when(boost.fold_of("id", 2) == 0, 9 - F.col("ksi_target")).otherwise(F.col("ksi_target")))
    j = scored.join(boost.out_of_fold(other, "id", **how)[0].withColumnRenamed("score", "again").drop("fold"), "id")
    gap = {r["fold"]: r["gap"] for r in j.groupBy("fold").agg(F.max(F.abs(F.col("again") - F.col("score"))).alias("gap")).collect()}
    assert gap[0] < 1e-9 < 0.1 < gap[1]


def plain_boost(x, y, rounds, rate, depth, least, categories=()):
    """The same boosting, one row at a time and every split tried, on bins of a few values."""
    f = np.full(len(y), math.log(y.mean()))
    for _ in range(rounds):
        step = np.zeros(len(y))

        def grow(at, level):
            mu = np.exp(f[at])
            g, h = (y[at] - mu).sum(), mu.sum()
            best = (1e-9, None)
            if level < depth:
                for i in range(x.shape[1]):
                    values = sorted(set(x[:, i]))
                    if i in categories:
                        values.sort(key=lambda v: (y[at][x[at, i] == v] - mu[x[at, i] == v]).sum() / mu[x[at, i] == v].sum() if (x[at, i] == v).any() else math.inf)
                    for cut in range(1, len(values)):
                        left = np.isin(x[at, i], values[:cut])
                        if min(left.sum(), (~left).sum()) >= least:
                            gl, hl = (y[at] - mu)[left].sum(), mu[left].sum()
                            gain = gl**2 / hl + (g - gl) ** 2 / (h - hl) - g**2 / h
                            if gain > best[0] + 1e-9:
                                best = (gain, at[left], at[~left])
            if best[1] is None:
                step[at] = g / h
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(np.arange(len(y)), 0)
        f = f + rate * step
    return np.exp(f)


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_boosting_against_every_split_tried(spark, monkeypatch, block):
    """One partition of blocks, and several whose sums meet in a shuffle; scores rewritten on the way."""
    monkeypatch.setattr(learner, "BLOCK_ROWS", min(block, 100))
    monkeypatch.setattr(learner, "PART_CELLS", block)
    r = np.random.default_rng(5)
    x = np.stack([r.integers(0, 6, 300), r.integers(0, 4, 300), r.integers(0, 5, 300)], axis=1)
    y = r.poisson(np.exp(0.3 * x[:, 0] - 0.4 * (x[:, 1] == 2) + 0.2 * (x[:, 2] % 2)))
    rows = [(i, float(a), float(b), "abcde"[c], int(n)) for i, ((a, b, c), n) in enumerate(zip(x.tolist(), y.tolist()))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, ksi_target int")
    got = learner.fit(df, "id", "ksi_target", ["a", "b", "c"], [F.lit(True)], rounds=4, rate=0.3, depth=3, min_instances=8, cut_every=2)
    want = plain_boost(x, y.astype(float), 4, 0.3, 3, 8, {2})
    raw = {s["key"]: s["raw"][0] for s in got.scores.collect()}
    assert [math.exp(raw[i]) for i in range(300)] == pytest.approx(want.tolist(), rel=1e-9)
    again = {s["id"]: s["f"] for s in df.select("id", got.models[0].raw(df).alias("f")).collect()}
    assert again == pytest.approx(raw)


def test_models_of_one_fit_do_not_touch_each_other(counts):
    """Each of three models of one fit scores like a fit of its own on the same rows and inputs."""
    wide = counts.select("id", "ksi_target", *[vector_to_array("features")[i].alias(f"i{i}") for i in range(3)])
    members, uses = [F.lit(True), F.col("i0") > 0.3, F.col("i1") > 0.5], [["i0", "i1", "i2"], ["i0", "i2"], ["i1"]]
    how = {"rounds": 3, "rate": 0.5, "depth": 3, "min_instances": 5}
    raw = {r["key"]: r["raw"] for r in learner.fit(wide, "id", "ksi_target", ["i0", "i1", "i2"], members, uses, **how).scores.collect()}
    for m, (member, use) in enumerate(zip(members, uses)):
        # an all-rows companion keeps the bins the same
        alone = learner.fit(wide, "id", "ksi_target", ["i0", "i1", "i2"], [F.lit(True), member], [["i0"], use], **how).scores.collect()
        assert {r["key"]: r["raw"][1] for r in alone} == pytest.approx({k: v[m] for k, v in raw.items()})


def test_missing_and_unseen_inputs(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 7), None if i % 4 == 0 else "ab"[i % 2], i % 3) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, a double, t string, ksi_target int")
    m = boost.fit_poisson_gbt(df, inputs=["a", "t"], rounds=2, min_instances=2)
    new = spark.createDataFrame([(1, None, "never seen"), (2, 3.0, None), (3, float("nan"), "a")], "id long, a double, t string")
    score = {r["id"]: r["score"] for r in m.predict(new).collect()}
    assert all(v > 0 for v in score.values()) and score[1] == pytest.approx(score[2])
    with pytest.raises(ValueError):
        boost.fit_poisson_gbt(df.limit(0), inputs=["a"])


def test_scores_are_not_clipped(spark):
    df = spark.createDataFrame([(float(i % 2), 40_000 if i % 2 else 0) for i in range(60)], "a double, ksi_target int")
    v = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    m = boost.fit_poisson_gbt(v, rounds=30, rate=0.5, depth=1, min_instances=1, cut_every=4)
    assert m.predict(v).where("a = 1").agg(F.min("score")).first()[0] == pytest.approx(40_000, rel=0.01)


def test_rolling_history(spark):
    """Against a plain loop; the first three years only serve as history."""
    r = random.Random(4)
    rows = [(i, r.choice("st"), dt.date(r.randint(2001, 2007), 6, 1), r.randint(0, 2), r.randint(0, 23), r.choice([30, 60])) for i in range(80)]
    names = ["collision_id", "segment_id", "occurred_on", "ksi", "hour", "speed_limit"]
    other = {"n_fatal": 0, "n_serious": 1, "n_slight": 2, "n_casualties": 3, "n_vehicles": 2, "road_type": "a", "junction_type": "none", "is_urban": True, "lighting": "daylight", "lon": 0.0, "lat": 51.0, "chainage": 1.0, "stretch_m": 9.0}
    df = spark.createDataFrame(rows, names).withColumns({k: F.lit(v) for k, v in other.items()})
    got = {x["collision_id"]: x for x in severity.severity_rows(df).collect()}
    assert set(got) == {x[0] for x in rows if x[2].year >= min(y[2].year for y in rows) + 3}
    for x in rows:
        if x[0] in got:
            before = [y for y in rows if y[1] == x[1] and x[2].year - 3 <= y[2].year < x[2].year]
            assert (got[x[0]]["f_crashes"], got[x[0]]["f_ksi"]) == ((len(before), sum(y[3] for y in before)) if before else (None, None))
            if before:
                assert got[x[0]]["f_speed_mean"] == pytest.approx(sum(y[5] for y in before) / len(before))
    assert severity.severity_rows(df, years=(2005, 2005)).count() == sum(x[2].year == 2005 for x in rows)
    assert severity.severity_rows(df.limit(0)).count() == 0


def test_severity_models(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, int(r.random() < (0.7 if (s := r.choice([20, 70])) == 70 else 0.3)), s, r.choice("ab"), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "collision_id long, severe int, speed_limit int, road_type string, casualty_age_mean double")
    assert severity.input_columns(df, True) == ["speed_limit", "road_type"]
    rep = {x["model"]: x for x in severity.severity_report(df, k=3, rounds=3, depth=3).collect()}
    assert rep["deployable"]["inputs"] == 2 and rep["explanatory"]["inputs"] == 3
    assert 0.6 < rep["deployable"]["auc"] < 0.85
    kinds = {x["model"]: x["auc"] for x in severity.compare_models(df, ["speed_limit", "road_type"], k=3, rounds=3, depth=3, steps=30).collect()}
    m = severity.fit_severity(df, ["speed_limit", "road_type"], rounds=3, depth=3)
    m.save(str(tmp_path / "m"))
    again = severity.SeverityModel.load(spark, str(tmp_path / "m"))
    a, b = ({x["collision_id"]: x["score"] for x in y.score(df).collect()} for y in (m, again))
    assert a == pytest.approx(b) and len(a) == 300
    assert {x["feature"]: x["rank"] for x in factor_ranking(again.contributions(df)).collect()} == {"speed_limit": 1, "road_type": 2}
    assert set(kinds) == {"boosting", "svm", "neural_net"} and all(v > 0.55 for v in kinds.values())


@pytest.mark.parametrize("alone", [True, False])
def test_svm_and_net_equal_sparks_own(spark, monkeypatch, alone):
    """All folds of both kinds descend side by side, and end where Spark's classifiers do, in one task or in passes."""
    r = random.Random(4)
    rows = []
    for i in range(700):
        speed, road, x = r.choice([20, 30, 60, None]), r.choice(["a", "b", "c", None]), r.gauss(0, 1)
        rows.append((i, int(r.random() < 1 / (1 + math.exp(-x - (road == "a") - ((speed or 30) - 40) / 20))), speed, road, x, 3, r.random() < 0.5, i % 2))
    df = spark.createDataFrame(rows, "collision_id long, severe int, speed int, road string, x double, same int, town boolean, fold int").coalesce(1)
    inputs, passes, real = ["speed", "road", "x", "same", "town"], [], margins.side_by_side
    monkeypatch.setattr(margins, "ALONE_CELLS", 1 << 22 if alone else 0)
    monkeypatch.setattr(margins, "side_by_side", lambda fits, ask: real(fits, lambda asked: passes.append(len(asked)) or ask(asked)))
    got = {x["collision_id"]: x for x in margins.held_out(df, "collision_id", "severe", inputs, ["svm", "neural_net"], 2, 12).collect()}
    assert len(got) == 700 and all(got[x[0]]["severe"] == x[1] for x in rows)
    # one pass serves every model; a net's search may take a few more looks than steps
    assert alone or (passes[0] == 4 and len(passes) < 40)
    for i in range(2):
        train, fitted = assemble(df.where(F.col("fold") != i), inputs, ["collision_id", "severe"])
        scaler = StandardScaler(inputCol="features", outputCol="s", withMean=True, withStd=True).fit(train)
        test = scaler.transform(apply_assembly(fitted, df.where(F.col("fold") == i), inputs, ["collision_id"]))
        shared = {"featuresCol": "s", "labelCol": "severe", "maxIter": 12}
        for kind, made in (("svm", LinearSVC(regParam=0.01, **shared)), ("neural_net", MultilayerPerceptronClassifier(layers=[5, 32, 16, 2], seed=7, **shared))):
            for x in made.fit(scaler.transform(train)).transform(test).select("collision_id", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("v")).collect():
                assert got[x["collision_id"]][kind] == pytest.approx(x["v"], abs=1e-8)


def test_linear_floor(spark):
    """Against Newton steps in numpy; nulls count as the mean, and a fold's own labels do not matter."""
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2)) * [3, 0.5] + [10, -2]
    y = r.poisson(np.exp(0.2 * (x[:, 0] - 10) - 0.5 * (x[:, 1] + 2)))
    df = spark.createDataFrame([(f"s{i}", float(a), float(b), int(n)) for i, ((a, b), n) in enumerate(zip(x.tolist(), y.tolist()))], "id string, a double, b double, ksi_target int")
    m = linear.fit_linear(df, "ksi_target", ["a", "b"], [F.lit(True), F.col("a") > 10], steps=6)
    for model, rows in zip(m, (np.full(500, True), x[:, 0] > 10)):
        X, beta = np.column_stack([np.ones(rows.sum()), x[rows]]), np.array([math.log(y[rows].mean()), 0, 0])
        for _ in range(6):
            mu = np.exp(X @ beta)
            beta = np.linalg.solve(X.T @ (mu[:, None] * X), X.T @ (mu * (X @ beta) + y[rows] - mu))
        got = df.orderBy(F.substring("id", 2, 9).cast("int")).select(model.score().alias("s")).toPandas()["s"]
        assert got.tolist() == pytest.approx(np.exp(np.column_stack([np.ones(500), x]) @ beta).tolist(), rel=1e-6)
    null = df.limit(1).select(F.lit(None).cast("double").alias("a"), "b").withColumn("b", F.lit(float(x[:, 1].mean())))
    assert null.select(m[0].score()).first()[0] == pytest.approx(math.exp(m[0].beta[0]), rel=1e-6)
    with pytest.raises(ValueError):
        linear.fit_linear(df.limit(0), "ksi_target", ["a"], [F.lit(True)])


def test_partitions_of_a_fit_are_bounded_by_the_cores(spark, monkeypatch):
    """Each partition's sums are exchanged in every pass, so shuffle partitions or rows must not raise their number."""
    monkeypatch.setattr(learner, "PART_CELLS", 1)
    monkeypatch.setattr(learner, "BLOCK_ROWS", 64)
    monkeypatch.setattr(learner, "DEAL_ROWS", 100)
    rows = spark.range(3000).select(F.col("id").alias("key"), F.lit(1.0).alias("y"), F.lit(1).cast("long").alias("member"), (F.col("id") % 7).cast("double").alias("x0"))
    held, parts = learner._blocks(rows, 3000, 3000, [learner.Input("a", edges=[2.0, 4.0])], [0.0], learner.Scratch(spark, "bounded"))
    assert held.rdd.getNumPartitions() <= parts == learner.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert held.agg(F.sum("n")).first()[0] == 3000
    held.unpersist()


def test_files_of_blocks_end_their_groups_by_size(spark):
    """A writer looked at a file's size after a hundred rows only, and held so many blocks, as did each reader."""
    n = 20_000

    def made(frames):
        for i in (i for f in frames for i in f["id"]):
            yield pd.DataFrame([(n, bytes(n), bytes(8), bytes(8), np.random.default_rng(i).normal(size=n).tobytes(), [i])], columns=["n", "x", "y", "member", "f", "keys"])

    some = spark.range(0, 300, 1, 1).mapInPandas(made, "n int, x binary, y binary, member binary, f binary, keys array<long>")
    s, before = learner.Scratch(spark, "groups"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    learner._advance(some, 1, 1, [[]], [np.arange(1)], s).unpersist()
    [file] = glob.glob(f"{s.folder}/*-blocks/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 300 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) < 150
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_only_its_own_rows_are_scored_and_no_loss_below_the_first_level(monkeypatch):
    asked = []
    monkeypatch.setitem(learner.VALUES, "poisson", lambda y, f: asked.append(len(y)) or f)
    real, routed = learner.Tree.route, []
    monkeypatch.setattr(learner.Tree, "route", lambda *a: routed.append(len(a[3])) or real(*a))
    block = {"n": 4, "x": bytes([0, 1, 1, 0]), "y": np.arange(4.0).tobytes(), "member": np.array([1, 0, 1, 0]).tobytes(), "f": np.zeros(4).tobytes()}
    for level in (0, 1):
        tree = learner.Tree(2, 2)
        tree.input[0], tree.left[0, 0] = 0, True
        learner._sums(block, learner._Plan("poisson", 2, 1, [np.array([0])], np.zeros(1, bool), [[(0.1, tree)]], [tree], level), {})
    assert asked == [2] and routed == [2] * 4


def test_routes_and_sums_against_plain_loops():
    rng = np.random.default_rng(3)
    x, y, f = rng.integers(0, 6, (500, 4)).astype(np.uint8), rng.random(500), rng.normal(size=(500, 1))
    tree = learner.Tree(2, 6)
    tree.input[[0, 2]], tree.left[0, [0, 3]], tree.left[2, [1, 2, 5]] = [1, 3], True, True
    want = []
    for row in x:
        k = 0
        while tree.input[k] >= 0:
            k = 2 * k + 2 - int(tree.left[k, row[tree.input[k]]])
        want.append(k)
    assert tree.route(x, 2).tolist() == want
    member = rng.integers(0, 2, 500)
    block = {"n": 500, "x": x.tobytes(), "y": y.tobytes(), "f": f.tobytes(), "member": member.astype(np.int64).tobytes()}
    held, use = {}, np.array([0, 3])
    learner._sums(block, learner._Plan("poisson", 6, 1, [use], np.zeros(4, bool), [[]], [tree], 2), held)
    sums = {}
    for i in np.flatnonzero(member):
        if want[i] >= 3:
            s = sums.setdefault((0, want[i]), np.zeros((2, 6, 3)))
            for j, c in enumerate(use):
                s[j, x[i, c]] += (1, y[i] - math.exp(f[i, 0]), math.exp(f[i, 0]))
    assert held.keys() == sums.keys()
    assert all(np.allclose(held[k], sums[k]) for k in sums)
