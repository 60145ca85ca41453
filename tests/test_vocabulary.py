import random
from collections import Counter

from pyspark.sql import functions as F

from kerbline.models import severity, vocabulary as voc

COLUMNS = {"type": "vehicle_type", "impact": "point_of_impact", "no": "vehicle_no"}


def vehicles(n=400):
    r = random.Random(8)
    rows = []
    for i in range(n):
        for k in range(r.randint(0, 4)):
            rows.append((i, k, r.choice(["car", "van", None]), r.choice(["front", "back", "left"])))
    return rows


def brute(rows):
    out = Counter()
    for i, k, t, p in rows:
        named = [("type", t), ("impact", p), ("no", k)]
        known = [(a, v) for a, v in named if v is not None]
        for x, (a, v) in enumerate(known):
            out[i, f"v.{a}={v}"] += 1
            for b, w in known[x + 1 :]:
                out[i, f"v.{a}={v}&{b}={w}"] += 1
    return out


def test_terms_vocabulary_and_sparse_counts(spark):
    rows = vehicles()
    child = spark.createDataFrame(rows, "collision_id long, vehicle_no int, vehicle_type string, point_of_impact string")
    counted = voc.terms(child, COLUMNS, "v").cache()
    want = brute(rows)
    assert {(r.collision_id, r.term): r.n for r in counted.collect()} == want
    # a term of one fold only is no input of the models that are tested on it
    crashes = spark.range(400).select(F.col("id").alias("collision_id"))
    folds = {r.collision_id: r.f for r in crashes.select("collision_id", voc.fold_of("collision_id", 5).alias("f")).collect()}
    odd = spark.createDataFrame([(i, "v.type=tram", 1) for i, f in folds.items() if f == 3][:25], "collision_id long, term string, n long")
    learned = voc.learn(counted.unionByName(odd), crashes, least=20).cache()
    got = {(r.fold, r.term): r.crashes for r in learned.collect()}
    tally = Counter()
    for i, term in [*want, *[(r.collision_id, r.term) for r in odd.collect()]]:
        for f in (-1, *range(5)):
            tally[f, term] += folds[i] != f
    assert got == {k: n for k, n in tally.items() if n >= 20}
    assert (3, "v.type=tram") not in got and (2, "v.type=tram") in got
    vocabulary = voc.of_fold(learned, 3)
    vectors = voc.sparse(counted, vocabulary)
    names = {r.position: r.term for r in vocabulary.collect()}
    assert sorted(names) == list(range(len(names))) and [names[i] for i in sorted(names)] == sorted(names.values())
    back = {(r.collision_id, names[i]): n for r in vectors.collect() for i, n in zip(r.indices, r.counts, strict=True)}
    assert back == {k: n for k, n in want.items() if k[1] in names.values()}
    # dense inputs, and a model fitted on them
    inputs = voc.inputs(vocabulary)
    base = crashes.withColumn("severe", (F.col("collision_id") % 3 == 0).cast("int"))
    wide = voc.with_inputs(base, vectors, inputs)
    totals = wide.agg(*[F.sum(f"`{n}`").alias(f"s{i}") for i, n in enumerate(inputs)]).first()
    assert [totals[i] for i in range(len(inputs))] == [sum(n for (_, t), n in want.items() if t == names[i]) for i in range(len(inputs))]
    model = severity.fit_severity(wide, inputs, rounds=2, depth=2)
    assert model.score(wide).count() == 400


def test_vocabulary_of_nothing(spark):
    child = spark.createDataFrame(vehicles(3), "collision_id long, vehicle_no int, vehicle_type string, point_of_impact string")
    counted = voc.terms(child.where("false"), COLUMNS, "v")
    learned = voc.learn(counted, child.select("collision_id"))
    assert learned.count() == 0 and voc.inputs(voc.of_fold(learned)) == []
    assert voc.with_inputs(child, voc.sparse(counted, voc.of_fold(learned)), []).count() == child.count()


def test_tasks_are_sized_by_rows(spark, monkeypatch):
    """Grouping is dealt by the number of rows, not by bytes read or a fixed number of tasks, and counts stay the same."""
    child = spark.createDataFrame([(i % 90, f"t{i % 4}", i % 3) for i in range(600)], "collision_id long, kind string, no int")
    columns = {"kind": "kind", "no": "no"}
    want = sorted(voc.terms(child, columns, "v").collect())
    monkeypatch.setattr(voc, "TASK_ROWS", 100)
    terms = voc.terms(child, columns, "v")
    assert terms.rdd.getNumPartitions() == 18  # 600 rows of two terms and a pair
    assert sorted(terms.collect()) == want
    counted = spark.createDataFrame(want, "collision_id long, term string, n long")
    v = spark.createDataFrame([("v.kind=t1", 0), ("v.no=2", 1)], "term string, position int")
    sparse = voc.sparse(counted, v)
    assert sparse.rdd.getNumPartitions() == -(-len(want) // 100)
    held = {}
    for key, term, n in want:
        if term in ("v.kind=t1", "v.no=2"):
            held.setdefault(key, []).append((int(term == "v.no=2"), n))
    assert {r["collision_id"]: list(zip(r["indices"], r["counts"])) for r in sparse.collect()} == {k: sorted(v) for k, v in held.items()}
