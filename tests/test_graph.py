import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kerbline.operators import chainage as ch, spanning as sp
from kerbline.operators.segments import assign_segments, extend_places, place_positions
from kerbline.scratch import job, scratch_root, table
from tests.brute import kruskal, tree_chainage

SCHEMA = "collision_id long, road_number string, lon double, lat double"


def cloud(seed, n=150):
    """Two roads with dense spots, curves, a far second piece and a few repeated places."""
    r = random.Random(seed)
    pts = {}
    for i in range(n):
        road = r.choice(["A1", "A1", "A2"])
        kind = r.random()
        if kind < 0.35:  # a dense spot a few metres wide
            lon, lat = -1.0 + r.gauss(0, 2e-5), 52.0 + r.gauss(0, 2e-5)
        elif kind < 0.6:  # two parallel carriageways 3 km apart
            lon, lat = -1.0 + r.choice([0.0, 0.045]), 52.0 + r.uniform(0, 0.08)
        elif kind < 0.8:  # scattered
            lon, lat = -1.0 + r.uniform(-0.2, 0.2), 52.0 + r.uniform(-0.1, 0.1)
        else:  # far away
            lon, lat = -3.0 + r.uniform(0, 0.05), 56.9 + r.uniform(0, 0.05)
        pts[i + 1] = (road, lon, lat)
    return pts


def frame(spark, pts):
    return spark.createDataFrame([(i, *p) for i, p in pts.items()], SCHEMA)


def settings(monkeypatch, open_pairs, first_max, per_component=6.0):
    monkeypatch.setattr(sp, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(sp, "CELL_MAX", first_max)
    monkeypatch.setattr(sp, "PAIRS_PER_COMPONENT", per_component)
    monkeypatch.setattr(sp, "FEW_PAIRS", 400)


@pytest.mark.parametrize(
    "seed,open_pairs,first_max",
    [(1, 1024, 48), (2, 6, 8)],
)
def test_forest_and_chainage_match_brute_force(spark, monkeypatch, seed, open_pairs, first_max):
    settings(monkeypatch, open_pairs, first_max)
    pts = cloud(seed)
    edges, labelled = sp.spanning_forest(sp.positions(frame(spark, pts)), 5000.0)
    want, comp = kruskal(pts, 5000.0)
    assert {(r["a"], r["b"]) for r in edges.collect()} == want
    got = {r["pos_id"]: r["comp"] for r in labelled.collect()}
    assert len(got) == len(pts)
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups(got) == groups(comp)

    monkeypatch.setattr(ch, "CHUNK_ROWS", 16)  # several chunks per stretch
    placed = ch.chainage(labelled, edges)
    want_m = tree_chainage(pts, want)
    got_m = {r["pos_id"]: r["chainage"] for r in placed.collect()}
    assert set(got_m) == set(want_m)
    assert max(abs(got_m[k] - want_m[k]) for k in want_m) < 1e-6


@pytest.mark.parametrize("seed,n,open_pairs,first_max", [(3, 140, 1024, 48), (4, 60, 6, 8)])
def test_extended_forest_is_that_of_all_places(spark, monkeypatch, seed, n, open_pairs, first_max):
    """Three roads, one of them without new places; the new ones also bridge old stretches and repeat old places."""
    settings(monkeypatch, open_pairs, first_max)
    pts = cloud(seed, n)
    pts.update({1000 + i: ("A3", -2.0 + 0.01 * i, 53.0) for i in range(5)})
    added = {i: p for i, p in pts.items() if 0.7 * n < i < 1000}
    old = {i: p for i, p in pts.items() if i not in added}
    added.update({2000 + i: old[i] for i in sorted(old)[:6]} | {2010: old[1000]})
    placed, edges = place_positions(frame(spark, old))
    kept = sp.with_road(edges, placed)
    compared = []
    real = sp.near_pairs
    monkeypatch.setattr(sp, "near_pairs", lambda *a: compared.extend(real(*a).collect()) or real(*a))
    places, all_edges = extend_places(placed, kept, frame(spark, added))
    monkeypatch.setattr(sp, "near_pairs", real)
    want, _ = kruskal(pts, 5000.0)
    assert {(r["a"], r["b"]) for r in all_edges.collect()} == want
    whole, _ = place_positions(frame(spark, {**pts, **{i: p for i, p in added.items() if i >= 2000}}))
    columns = ["pos_id", "road_number", "run", "block", "n_here", "segment_id"]
    assert sorted(places.select(*columns).collect()) == sorted(whole.select(*columns).collect())
    a, b = ({r["pos_id"]: r["chainage"] for r in d.collect()} for d in (places, whole))
    assert max(abs(a[k] - b[k]) for k in b) < 1e-6
    # no two old places are compared, and the road without a new place is not looked at
    assert compared and all((r["a"] in added or r["b"] in added) and r["road_number"] != "A3" for r in compared)


def test_extension_without_new_places(spark):
    pts = {1: ("A1", -1.0, 52.0), 2: ("A1", -1.0, 52.003)}
    placed, edges = place_positions(frame(spark, pts))
    again, kept = extend_places(placed, sp.with_road(edges, placed), frame(spark, {9: pts[2]}))
    assert {r["pos_id"]: r["n_here"] for r in again.collect()} == {1: 1, 2: 2} and kept.count() == 1
    first, made = extend_places(placed.where("false"), sp.with_road(edges, placed).where("false"), frame(spark, pts))
    assert first.count() == 2 and made.count() == 1
    none, _ = extend_places(placed, sp.with_road(edges, placed), frame(spark, pts).where("false"))
    assert none.count() == 2


def test_hot_spot_is_not_multiplied_out(spark, monkeypatch):
    """Two dense spots of one road 3 km apart: the pair of blocks is narrowed down, not opened."""
    settings(monkeypatch, 64, 16)
    r = random.Random(5)
    pts = {i: ("A1", -1.0 + (0.044 if i % 2 else 0.0) + r.gauss(0, 1e-4), 52.0 + r.gauss(0, 1e-4)) for i in range(1, 401)}
    opened = []
    real = sp._links

    def spy(p):
        opened.append(p.count())
        return real(p)

    monkeypatch.setattr(sp, "_links", spy)
    edges, _ = sp.spanning_forest(sp.positions(frame(spark, pts)), 5000.0)
    assert {(x["a"], x["b"]) for x in edges.collect()} == kruskal(pts, 5000.0)[0]
    assert sum(opened) < 400 * 400 / 4


def test_two_pieces_543_km_apart(spark):
    pts = {1: ("A503", -0.1, 51.5), 2: ("A503", -0.1, 51.501), 3: ("A503", -0.1, 51.502),
           4: ("A503", -3.0, 56.0), 5: ("A503", -3.0, 56.001), 6: ("A503", -3.0, 56.002)}
    placed, edges = place_positions(frame(spark, pts))
    rows = {r["pos_id"]: r for r in placed.collect()}
    assert {rows[i]["run"] for i in (1, 2, 3)} == {1}
    assert {rows[i]["run"] for i in (4, 5, 6)} == {2}
    assert edges.count() == 4


def test_t_junction(spark):
    """A 4 km bar with a 1 km branch in its middle: chainage of the branch goes on from the junction."""
    d = 1 / 111.195
    pts = {i: ("A9", 0.0, 52.0 + (i - 1) * d) for i in range(1, 6)}
    pts[6] = ("A9", 0.5 * d / 0.6152, 52.0 + 2 * d)
    pts[7] = ("A9", 1.0 * d / 0.6152, 52.0 + 2 * d)
    placed, _ = place_positions(frame(spark, pts))
    m = {r["pos_id"]: r["chainage"] for r in placed.collect()}
    assert [round(m[i], -1) for i in range(1, 6)] == [0, 1000, 2000, 3000, 4000]
    assert round(m[6], -2) == 2500 and round(m[7], -2) == 3000


def test_block_edges(spark):
    """0, 499.9995, 500 and 1000 m: the millimetre decides."""
    k = 180 / 3.141592653589793 / 6371008.8
    pts = {i + 1: ("A7", -2.0, 51.0 + m * k) for i, m in enumerate([0.0, 499.9995, 500.0, 1000.0])}
    placed, _ = place_positions(frame(spark, pts))
    assert {r["pos_id"]: r["block"] for r in placed.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_repeated_places_and_every_crash_assigned(spark):
    rows = [(1, "A1", -1.0, 52.0), (2, "A1", -1.0, 52.0), (3, "A1", -1.0, 52.0), (4, "A1", -1.0, 52.003), (5, "A1", -1.0, 52.003)]
    c = spark.createDataFrame(rows, SCHEMA)
    placed, edges = place_positions(c)
    assert placed.count() == 2 and edges.count() == 1
    assert placed.agg(F.sum("n_here")).first()[0] == 5
    assert assign_segments(c, placed).count() == 5


def test_empty_and_single(spark):
    placed, edges = place_positions(frame(spark, {1: ("A1", -1.0, 52.0)}))
    r = placed.first()
    assert edges.count() == 0 and r["chainage"] == 0.0 and r["segment_id"] == "A1_run1_km0.0"
    placed, edges = place_positions(frame(spark, {1: ("A1", -1.0, 52.0)}).where("false"))
    assert placed.count() == 0 and edges.count() == 0


def test_a_job_removes_its_scratch_tables(spark, tmp_path):
    root = Path(scratch_root(spark))
    before = set(root.iterdir()) if root.exists() else set()
    with job(spark):
        place_positions(frame(spark, {1: ("A1", -1.0, 52.0), 2: ("A1", -1.0, 52.003)}))[0].write.parquet(f"{tmp_path}/placed")
        assert set(root.iterdir()) - before
    assert set(root.iterdir()) == before
    assert spark.read.parquet(f"{tmp_path}/placed").count() == 2
    with pytest.raises(ValueError), job(spark):
        table(spark.range(3))
        raise ValueError
    assert set(root.iterdir()) == before


def test_walk_is_linked_up_in_parts(spark, monkeypatch):
    """A path of 300 places and a branching road in parts of 40 steps: only ends of chains are ranked, and chainage is the same."""
    r = random.Random(9)
    ids = r.sample(range(1, 1000), 380)
    pts = {ids[i]: ("A1", -1.0, 50.0 + 0.001 * i) for i in range(300)}
    pts |= {ids[300 + i]: ("A2", -1.5 + r.uniform(0, 0.1), 52.0 + r.uniform(0, 0.1)) for i in range(80)}
    edges, labelled = sp.spanning_forest(sp.positions(frame(spark, pts)), 5000.0)
    whole = {x["pos_id"]: (x["run"], x["chainage"]) for x in ch.chainage(labelled, edges).collect()}
    ranked, real = [], ch.Scratch.keep

    def keep(self, df, tag="t", **metrics):
        out = real(self, df, tag, **metrics)
        ranked.extend([out[1]["rows"]] if tag == "jump" else [])
        return out

    monkeypatch.setattr(ch.Scratch, "keep", keep)
    monkeypatch.setattr(ch, "PART_STEPS", 40)
    got = {x["pos_id"]: (x["run"], x["chainage"]) for x in ch.chainage(labelled, edges).collect()}
    assert got == whole
    want = tree_chainage(pts, kruskal(pts, 5000.0)[0])
    assert max(abs(got[k][1] - want[k]) for k in want) < 1e-6
    steps = 2 * edges.count()
    assert 19 < max(ranked) < steps / 2 and max(ranked) == min(ranked)  # about twenty parts, with at least a chain each


def test_widest_radius_that_fits(spark, monkeypatch):
    """The radius is the same whatever the number of radii tried side by side, and fine cells are not counted if a wide one fits."""
    settings(monkeypatch, 1024, 8)
    pts = sp.positions(frame(spark, cloud(6))).withColumn("comp", F.col("pos_id"))
    grid = sp.Grid(57.1)
    found = []
    for n in (1, 5, 12):
        monkeypatch.setattr(sp, "RADII_PER_JOB", n)
        found.append([sp.next_radius(pts, grid, r, 5000.0) for r in (0.0, 0.002)])
    assert found[0] == found[1] == found[2] and found[0][0] == found[0][1] < 5000.0
    # a radius of the first job fits: one aggregation, of the five widest
    sparse = sp.positions(frame(spark, {i: ("A1", -1.0, 50.0 + 0.02 * i) for i in range(1, 30)})).withColumn("comp", F.col("pos_id"))
    cells, real = [], sp.Grid.cell
    monkeypatch.setattr(sp, "RADII_PER_JOB", 5)
    monkeypatch.setattr(sp.Grid, "cell", lambda self, side: cells.append(side) or real(self, side))
    assert sp.next_radius(sparse, grid, 0.0, 5000.0) == 5000.0
    assert cells == [5000.0 / sp.SPLIT**4]
