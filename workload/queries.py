"""One query per operator. Every query runs over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_m, lonlat, polyline_m
from kerbline.functions.ids import json_row, parse_segment_id
from kerbline.functions.scale import PUBLISHED_CUTOFFS, tier
from kerbline.models import boost, linear, severity, vocabulary as voc
from kerbline.models.shap import factor_ranking, shap_table, shap_values
from kerbline.operators import crashes, evaluate, filters, quality, ranks, routes as rt, segments as sg, sketches, text_index
from kerbline.operators.near import near_pairs
from kerbline.operators.spanning import with_road
from kerbline.plans import answers
from kerbline.plans.build import rank_segments, score_segments
from kerbline.schemas import CATEGORICAL, FEATURE_NAMES
from kerbline.scratch import Scratch
from kerbline.sources.tables import read_box, write_curve, write_top_json
from workload import tables as t
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- input checks -----------------------------------------------------------------------------


@query
def completeness(spark, sf):
    return quality.completeness(t.collision(spark, sf), t.from_orders(spark, sf, views.MANIFEST), "collision")


@query
def file_audit(spark, sf):
    """A CSV file of crashes for each year, of which one breaks off within its last line and one has a line too short."""
    lines = spark.sql(views.CSV_LINES, orders=t.source(spark, sf, "orders"))
    return quality.audit_files(lines, "collision_id long, occurred_on date, hour int, road string", header=False)


@query
def completeness_children(spark, sf):
    """Vehicles and casualties, against three and four rows for each collision that the manifest expects."""
    c, m = t.collision(spark, sf), t.from_orders(spark, sf, views.MANIFEST)
    want = lambda kind, n: m.select(F.lit(kind).alias("kind"), "year", (F.col("expected_rows") * n).alias("expected_rows"))
    vehicles = quality.completeness(t.vehicle(spark, sf), want("vehicle", 3), "vehicle", c)
    return vehicles.unionByName(quality.completeness(t.casualty(spark, sf), want("casualty", 4), "casualty", c))


@query
def rejected(spark, sf):
    c, k = t.collision_with_unnumbered(spark, sf), F.col("collision_id") % 20
    lon, lat = F.when(k == 1, F.col("lat")).when(k != 0, F.col("lon")), F.when(k == 1, F.col("lon")).when(k == 2, F.lit(0.0)).otherwise(F.col("lat"))
    return quality.rejected(c.select("road_number", lon.alias("lon"), lat.alias("lat")))


@query
def orphans(spark, sf):
    numbered = filters.numbered_roads(t.collision_with_unnumbered(spark, sf))
    return quality.orphans(t.casualty(spark, sf), numbered).select("collision_id", "casualty_no", "severity")


@query
def coord_guard(spark, sf):
    c = t.collision(spark, sf)
    k = F.col("collision_id") % 20
    # a pair as it may arrive: missing, exchanged, or somewhere else
    pair = F.array(F.when(k == 1, F.col("lat")).when(k != 0, F.col("lon")), F.when(k == 1, F.col("lon")).when(k == 2, F.lit(0.0)).otherwise(F.col("lat")))
    p = c.select("collision_id", lonlat(pair).alias("p")).select("collision_id", "p.lon", "p.lat")
    return filters.flag_coordinates(p).groupBy("coord_status").agg(F.count(F.lit(1)).alias("n"), F.min("collision_id").alias("first_id"))


@query
def leak_guard(spark, sf):
    return quality.leak_report(t.collision(spark, sf), views.FEATURE_YEARS, views.TARGET_YEARS)


@query
def severity_map(spark, sf):
    h = quality.harmonise_severity(t.collision(spark, sf), t.from_orders(spark, sf, views.SEVERITY_MAP))
    g = h.groupBy("severity_raw", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("severity_weight").alias("weight"))
    return rounded(g, weight=3)


@query
def severity_drift(spark, sf):
    return rounded(quality.severity_drift(t.collision(spark, sf), "severity_raw"), share=6, change=6)


# --- filters ----------------------------------------------------------------------------------


@query
def numbered_roads(spark, sf):
    return filters.numbered_roads(t.collision_with_unnumbered(spark, sf)).select("collision_id", "road_number")


@query
def year_window(spark, sf):
    w = filters.in_years(t.collision(spark, sf), *views.FEATURE_YEARS)
    return w.select("collision_id", F.year("occurred_on").alias("year"), "road_number")


@query
def evidenced(spark, sf):
    return filters.evidenced(t.segments(spark, sf)).select("segment_id", "n_crashes")


@query
def bbox(spark, sf):
    return filters.in_bbox(t.segments(spark, sf), "-3.55,50.02,-2.05,50.11").select("segment_id", "n_crashes")


@query
def bbox_curve(spark, sf):
    """The same box from a curve-ordered store."""
    path = f"{Scratch(spark, 'curve').folder}/store"
    write_curve(t.segments(spark, sf), path)
    return read_box(spark, path, (-3.55, 50.02, -2.05, 50.11)).select("segment_id", "n_crashes")


@query
def min_score(spark, sf):
    return filters.min_score(t.segments(spark, sf), 1.5).select("segment_id", "score")


@query
def rank_search(spark, sf):
    return filters.search(t.segments(spark, sf), "a12_RUN2").select("segment_id", "n_crashes")


@query
def search_index(spark, sf):
    """The same search through an inverted index of trigrams."""
    s = t.segments(spark, sf)
    path = f"{Scratch(spark, 'trigrams').folder}/index"
    text_index.write_index(s, "segment_id", ["segment_id", "road_number"], path)
    return text_index.search_index(spark, path, s, "segment_id", ["segment_id", "road_number"], "a12_RUN2").select("segment_id", "n_crashes")


@query
def explore(spark, sf):
    e = filters.explore(t.tiered(spark, sf), tiers=["Severe", "Critical"], roads=["A3", "A7", "A21", "A38"], speeds=[20, 40, 70])
    return e.select("segment_id", "tier", "f_speed_mode")


# --- crashes ----------------------------------------------------------------------------------


@query
def ksi(spark, sf):
    return crashes.ksi_per_collision(t.casualty(spark, sf))


@query
def crash_join(spark, sf):
    c = crashes.join_crash(t.collision(spark, sf), t.vehicle(spark, sf), t.casualty(spark, sf))
    return c.select("collision_id", "road_number", "n_casualties", "n_fatal", "n_serious", "n_slight", "ksi", "n_vehicles")


# --- stretches and segments -------------------------------------------------------------------


@query
def haversine(spark, sf):
    ends = spark.sql(views.for_spark(views.ROUTE_ENDS), customer=t.source(spark, sf, "customer"))
    d = haversine_m("lon", "lat0", F.col("lon") + 0.05, "lat1")
    return ends.select("request_id", "candidate", F.round(d, 3).alias("distance_m"))


@query
def near_pairs_within_10m(spark, sf):
    p = near_pairs(t.placed(spark, sf).positions, 10.0)
    return p.select("a", "b", F.round("w", 3).alias("distance_m"))


@query
def stretches(spark, sf):
    p = t.placed(spark, sf).positions
    g = p.groupBy("road_number", "run").agg(F.count(F.lit(1)).alias("positions"), F.max("stretch_m").alias("stretch_m"))
    return rounded(g, stretch_m=2)


@query
def mst_weight(spark, sf):
    p = t.placed(spark, sf)
    e = p.edges.join(p.positions.select(F.col("pos_id").alias("a"), "road_number", "run"), "a")
    return rounded(e.groupBy("road_number", "run").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("total_m")), total_m=2)


@query
def mst_extended(spark, sf):
    """The forest of all crashes, grown from that of the crashes before 1998."""
    c = filters.numbered_roads(t.collision(spark, sf))
    positions, edges = sg.place_positions(c.where("year(occurred_on) < 1998"))
    places, edges = sg.extend_places(positions, with_road(edges, positions), c.where("year(occurred_on) >= 1998"))
    e = edges.drop("road_number").join(places.select(F.col("pos_id").alias("a"), "road_number", "run"), "a")
    return rounded(e.groupBy("road_number", "run").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("total_m")), total_m=2)


@query
def chainage(spark, sf):
    return t.placed(spark, sf).positions.select("pos_id", "road_number", "run", F.round("chainage", 2).alias("chainage"))


@query
def blocks(spark, sf):
    p = t.placed(spark, sf).positions
    return p.groupBy("road_number", "run", "block").agg(F.count(F.lit(1)).alias("positions"), F.sum("n_here").alias("crashes"))


@query
def segment_ids(spark, sf):
    s = t.segments(spark, sf).select("segment_id", parse_segment_id(F.col("segment_id")).alias("p"))
    return s.select("segment_id", "p.road_number", "p.run", "p.km")


@query
def assign(spark, sf):
    return t.placed(spark, sf).crashes.select("collision_id", "segment_id")


@query
def n_crashes(spark, sf):
    return rounded(sg.n_crashes(t.placed(spark, sf).crashes).select("segment_id", "n_crashes", "lon", "lat"), lon=7, lat=7)


def _family(spark, sf, aggs, *modes: str) -> DataFrame:
    w = sg.in_window(t.placed(spark, sf).crashes, views.FEATURE_YEARS)
    out = w.groupBy("segment_id").agg(*aggs)
    return out.join(sg.dominant(w, *modes), "segment_id", "left") if modes else out


@query
def f_history(spark, sf):
    return rounded(_family(spark, sf, sg.f_history(views.FEATURE_YEARS)), f_casualties_per_crash=6, f_vehicles_per_crash=6)


@query
def f_speed(spark, sf):
    return rounded(_family(spark, sf, sg.f_speed(), "f_speed_mode"), f_speed_mean=6)


@query
def f_category(spark, sf):
    return rounded(_family(spark, sf, sg.f_road_junction(), "f_road_type", "f_junction_type"), f_junction_share=6)


@query
def f_environment(spark, sf):
    return rounded(_family(spark, sf, sg.f_environment()), f_urban_share=6, f_unlit_share=6)


@query
def f_night(spark, sf):
    return rounded(_family(spark, sf, sg.f_night()), f_night_share=6)


@query
def f_location(spark, sf):
    return rounded(_family(spark, sf, sg.f_location()), f_lon=7, f_lat=7, f_extent_m=2)


@query
def f_position(spark, sf):
    return rounded(_family(spark, sf, sg.f_position()), f_position_share=6, f_stretch_m=2)


@query
def target(spark, sf):
    return sg.segment_target(t.placed(spark, sf).crashes, views.TARGET_YEARS)


@query
def features_target(spark, sf):
    c = t.placed(spark, sf).crashes
    j = sg.features_target(sg.features(c, views.FEATURE_YEARS), sg.segment_target(c, views.TARGET_YEARS))
    return rounded(j.select("segment_id", "f_crashes", "f_ksi", "f_speed_mode", "f_night_share", "ksi_target"), f_night_share=6)


@query
def segment_build(spark, sf):
    cols = ["segment_id", "road_number", "run", "km", "n_crashes", *FEATURE_NAMES, "ksi_target"]
    digits = {"f_casualties_per_crash": 6, "f_vehicles_per_crash": 6, "f_speed_mean": 6, "f_junction_share": 6, "f_urban_share": 6,
              "f_unlit_share": 6, "f_night_share": 6, "f_lon": 7, "f_lat": 7, "f_extent_m": 2, "f_position_share": 6, "f_stretch_m": 2}
    return rounded(t.segments(spark, sf).select(*cols), **digits)


# --- ranks, tiers, distributions --------------------------------------------------------------


@query
def top_segments(spark, sf):
    return ranks.top_segments(filters.evidenced(t.segments(spark, sf))).select("segment_id", "n_crashes", "score")


@query
def rankings(spark, sf):
    return ranks.rankings(t.segments(spark, sf)).select("segment_id", "n_crashes", "score")


@query
def rankings_by(spark, sf):
    by = ranks.rankings_by(t.segments(spark, sf), "ksi_target", ascending=False)
    return by.select("segment_id", "ksi_target")


@query
def top_json_rows(spark, sf):
    s = t.segments(spark, sf).select("segment_id", "n_crashes", "score")
    path = f"{Scratch(spark, 'top').folder}/top.json"
    write_top_json(s, path, 500)
    return spark.read.schema("segment_id string, n_crashes long, score double").json(path)


@query
def json_rows(spark, sf):
    return t.segments(spark, sf).select("segment_id", json_row("segment_id", "n_crashes", "ksi_target").alias("body"))


@query
def ranked(spark, sf):
    return ranks.ranked(t.segments(spark, sf)).select("rank", "segment_id", "score")


@query
def cutoffs(spark, sf):
    c = ranks.tier_cutoffs(t.segments(spark, sf))
    row = tuple(c) if c else (None,) * 4
    return rounded(spark.createDataFrame([row], "elevated double, severe double, critical double, top double"), elevated=6, severe=6, critical=6)


@query
def tiers(spark, sf):
    published = tier("score", PUBLISHED_CUTOFFS).alias("published_tier")
    return t.tiered(spark, sf).select("segment_id", "tier", published)


@query
def tier_colours(spark, sf):
    return t.tiered(spark, sf).groupBy("tier", "tier_colour").agg(F.count(F.lit(1)).alias("n"))


@query
def display(spark, sf):
    return t.tiered(spark, sf).select("segment_id", "score", "display")


@query
def tier_dist(spark, sf):
    return rounded(ranks.tier_distribution(filters.evidenced(t.tiered(spark, sf))), share=6)


@query
def speed_breakdown(spark, sf):
    return rounded(ranks.speed_breakdown(filters.evidenced(t.segments(spark, sf))), mean_score=6)


@query
def road_quantiles(spark, sf):
    """Score quantiles of each road and of all, from one sketch a stretch, merged; with their exact ranks' check."""
    s = t.segments(spark, sf)
    parts = sketches.sketches(s, ["road_number", "run"])
    every = sketches.merged(parts, []).select(F.lit("all").alias("road_number"), "n", "sketch")
    made = sketches.merged(parts, ["road_number"]).unionByName(every)
    both = s.select(F.explode(F.array("road_number", F.lit("all"))).alias("road_number"), "score")
    return sketches.rank_check(both, made, ["road_number"], [0.5, 0.8, 0.95]).select("road_number", "share", "n", "within")


@query
def headline(spark, sf):
    return rounded(ranks.headline(t.segments(spark, sf)), share_under=6)


@query
def heat_grid(spark, sf):
    return ranks.heat_grid(t.segments(spark, sf), 0.07)


@query
def density_pyramid(spark, sf):
    return ranks.density_pyramid(t.segments(spark, sf), 0.07)


@query
def capture(spark, sf):
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    return rounded(ranks.capture(known, "score", "ksi_target"), captured=6)


@query
def capture_compare(spark, sf):
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    return rounded(ranks.capture_compare(known, "score", "f_crashes", "ksi_target"), model=6, baseline=6, gain=6)


@query
def gains(spark, sf):
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    return rounded(ranks.gains(known, "score", "ksi_target"), captured=6)


@query
def capture_interval(spark, sf):
    """The gain of score over crash count in 200 bootstrap replicates."""
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    out = ranks.capture_interval(known, "segment_id", "score", "f_crashes", "ksi_target")
    return rounded(out, mean_gain=6, low=6, high=6, share_gaining=6)


@query
def list_segments(spark, sf):
    out = answers.list_segments(t.segments(spark, sf), "-3.55,50.0,-0.95,53.1", 1.5, 6, 200)
    return out.select("segment_id", "n_crashes", "score")


@query
def segment_lookup(spark, sf):
    s = t.segments(spark, sf)
    return answers.segment_detail(s, "A23_run1_km0.5", ranks.tier_cutoffs(s)).select("segment_id", "n_crashes", "score", "tier", "display")


# --- routes -----------------------------------------------------------------------------------


@query
def route_length(spark, sf):
    return t.routes(spark, sf).select("request_id", "candidate", F.round(polyline_m("path"), 3).alias("length_m"))


@query
def corridor(spark, sf):
    m = rt.match_routes(t.routes(spark, sf), t.segments(spark, sf))
    return rounded(m.select("request_id", "candidate", "segment_id", "distance_m"), distance_m=3)


@query
def route_order(spark, sf):
    m = rt.travel_order(rt.match_routes(t.routes(spark, sf), t.segments(spark, sf)))
    return m.select("request_id", "candidate", "place", "segment_id")


@query
def route_totals(spark, sf):
    r = t.routes(spark, sf)
    out = rt.route_totals(r, rt.match_routes(r, t.segments(spark, sf)))
    return out.select("request_id", "candidate", "expected_ksi", "blackspot_count", "worst_segment_id", F.size("blackspots").alias("listed"))


@query
def candidates(spark, sf):
    return rt.limit_candidates(t.routes(spark, sf, odd_cases=True)).select("request_id", "candidate")


@query
def route_status(spark, sf):
    return rt.route_status(t.routes(spark, sf, odd_cases=True)).select("request_id", "candidate", "status")


@query
def route_labels(spark, sf):
    r = t.routes(spark, sf)
    return rt.label_routes(rt.route_totals(r, rt.match_routes(r, t.segments(spark, sf)))).select("request_id", "candidate", "label")


@query
def coverage(spark, sf):
    c = rt.coverage(t.routes(spark, sf), t.segments(spark, sf))
    return c.select("request_id", "candidate", "samples", "covered", F.col("coverage_warning").isNotNull().alias("warned"))


@query
def route_risk(spark, sf):
    out = answers.route_risk(t.routes(spark, sf, odd_cases=True), t.segments(spark, sf))
    return out.select(
        "request_id", "candidate", "status", "label", F.round("distance_m", 2).alias("distance_m"), F.round("duration_s", 2).alias("duration_s"),
        "expected_ksi", "blackspot_count", "worst_segment_id",
        F.array_join(F.transform("blackspots", lambda b: b["segment_id"]), ",").alias("in_order"),
        F.col("coverage_warning").isNotNull().alias("warned"),
    )


# --- models -----------------------------------------------------------------------------------


@query
def folds(spark, sf):
    return evaluate.with_fold(t.segments(spark, sf), "segment_id").select("segment_id", "fold")


@query
def balance(spark, sf):
    c = t.placed(spark, sf).crashes.select("collision_id", (F.col("ksi") > 0).cast("int").alias("severe"))
    return evaluate.balance(c, "severe", "collision_id")


@query
def roc_auc(spark, sf):
    s = t.segments(spark, sf).select("n_crashes", (F.col("ksi_target") > 0).cast("int").alias("label"))
    return rounded(evaluate.roc_auc(s, "n_crashes", "label"), auc=6)


@query
def factor_rank(spark, sf):
    return rounded(factor_ranking(t.from_orders(spark, sf, views.CONTRIBUTION)), weight=6, share=6)


def _known(spark, sf) -> DataFrame:
    return t.segments(spark, sf).where(F.col("f_crashes") > 0).select("segment_id", "ksi_target", *FEATURE_NAMES)


@query
def poisson_fit(spark, sf):
    rows, model, _ = _explained(spark, sf)
    return boost.dispersion_check(model.predict(rows), "ksi_target", "score")


_scored: dict[tuple[str, str], DataFrame] = {}


def _scored_segments(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _scored:
        s = score_segments(t.segments(spark, sf).drop("score"))
        _scored[key] = Scratch(spark, "scored").table(s)
    return _scored[key]


@query
def scored(spark, sf):
    return rank_segments(_scored_segments(spark, sf)).select("segment_id", "n_crashes", "score", "tier", "display", "rank")


@query
def scored_check(spark, sf):
    """What must hold whatever the fit: who gets a score, and that ranks are a permutation."""
    r = rank_segments(_scored_segments(spark, sf))
    return r.agg(
        F.count(F.lit(1)).alias("segments"), F.count("score").alias("scored"), F.count_if(F.col("score") <= 0).alias("not_positive"),
        F.countDistinct("rank").alias("ranks"), F.max("rank").alias("last_rank"),
    )


_fitted: dict[tuple[str, str], tuple] = {}


def _explained(spark, sf):
    """The known segments, the count model on all of them and its contributions, fitted once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        s = Scratch(spark, "explained")
        rows = s.table(_known(spark, sf))
        model = boost.fit_poisson_gbt(rows, inputs=FEATURE_NAMES)
        _fitted[key] = rows, model, s.table(shap_values(model, rows, "segment_id"))
    return _fitted[key]


@query
def shap_factors(spark, sf):
    return factor_ranking(shap_table(_explained(spark, sf)[2], "segment_id", FEATURE_NAMES))


@query
def shap_check(spark, sf):
    """Contributions and base add up to the raw score of every segment."""
    rows, model, values = _explained(spark, sf)
    raw = rows.select("segment_id", model.raw(rows).alias("_raw"))
    total = F.aggregate("contributions", F.col("base") + model.base, lambda acc, v: acc + v)
    gap = F.abs(total - F.col("_raw"))
    return values.join(raw, "segment_id").agg(F.count(F.lit(1)).alias("segments"), (F.max(gap) < 1e-9).alias("additive"))


@query
def poisson_check(spark, sf):
    """Fitted counts agree with the observed total."""
    rows, model, _ = _explained(spark, sf)
    d = boost.dispersion_check(model.predict(rows), "ksi_target", "score")
    return d.select("segments", F.col("observed").cast("long").alias("observed"), (F.abs(F.col("expected") / F.col("observed") - 1) < 0.15).alias("total_agrees"))


def _two_valued(spark, sf) -> DataFrame:
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    return known.select("segment_id", "ksi_target", (F.col("f_crashes") >= 3).cast("double").alias("many"))


def _one_step(spark, sf) -> tuple[DataFrame, boost.PoissonModel]:
    """One round on one input of two values: the tree's leaves are the means of two groups."""
    rows = Scratch(spark, "two-valued").table(_two_valued(spark, sf))
    return rows, boost.fit_poisson_gbt(rows, inputs=["many"], rounds=1, rate=0.5, depth=1, min_instances=1)


@query
def poisson_step(spark, sf):
    rows, model = _one_step(spark, sf)
    return rounded(model.predict(rows).select("segment_id", "score"), score=6)


def _few_values(spark, sf) -> DataFrame:
    known = t.segments(spark, sf).where(F.col("f_crashes") > 0)
    return known.select("segment_id", "ksi_target", F.least("f_crashes", F.lit(6)).cast("double").alias("a"), F.least("f_ksi", F.lit(4)).cast("double").alias("b"))


@query
def poisson_trees(spark, sf):
    """Three rounds of trees of depth two on two inputs of a few values."""
    rows = Scratch(spark, "few-values").table(_few_values(spark, sf))
    model = boost.fit_poisson_gbt(rows, inputs=["a", "b"], rounds=3, rate=0.5, depth=2, min_instances=20)
    return rounded(model.predict(rows).select("segment_id", "score"), score=6)


@query
def poisson_floor(spark, sf):
    """The linear floor on the same inputs, after four steps."""
    rows = Scratch(spark, "few-values").table(_few_values(spark, sf))
    model = linear.fit_linear(rows, "ksi_target", ["a", "b"], [F.lit(True)], steps=4)[0]
    return rounded(rows.select("segment_id", model.score().alias("score")), score=6)


@query
def floor_capture(spark, sf):
    """Out-of-fold capture of trees, linear floor and crash count side by side, with the trees' interval over the floor."""
    s = _scored_segments(spark, sf)
    numbers = [c for c in FEATURE_NAMES if c not in CATEGORICAL]
    both = linear.linear_out_of_fold(s, "segment_id", numbers, known=F.col("f_crashes") > 0)
    known = Scratch(spark, "floor").table(both.where(F.col("f_crashes") > 0).select("segment_id", "score", "floor", "f_crashes", "ksi_target"))
    parts = [ranks.capture(known, c, "ksi_target").select(F.lit(n).alias("model"), "segments", "taken", "captured") for n, c in (("trees", "score"), ("linear", "floor"), ("crash count", "f_crashes"))]
    gain = ranks.capture_interval(known, "segment_id", "score", "floor", "ksi_target").select(F.lit("trees").alias("model"), "low", "high")
    return parts[0].union(parts[1]).union(parts[2]).join(gain, "model", "left")


@query
def shap_step(spark, sf):
    rows, model = _one_step(spark, sf)
    values = shap_values(model, rows, "segment_id")
    return rounded(values.select("segment_id", F.abs("base").alias("base"), F.get("contributions", F.lit(0)).alias("value")), base=6, value=6)


@query
def vocabulary(spark, sf):
    """Inputs that the models of each fold learn from vehicles and casualties, with the crashes that hold them."""
    counted = severity_terms(spark, sf)
    learned = Scratch(spark, "vocabulary").table(voc.learn(counted, t.collision(spark, sf)))
    held = voc.sparse(counted, voc.of_fold(learned)).select(F.explode(F.arrays_zip("indices", "counts")).alias("e"))
    sums = held.groupBy(F.col("e.indices").alias("position")).agg(F.sum("e.counts").alias("total"))
    deployed = voc.of_fold(learned).join(sums, "position").select("term", "total")
    return learned.join(deployed, "term", "left").select("fold", "term", "crashes", "total")


def severity_terms(spark, sf) -> DataFrame:
    """Categories and pairs of vehicles, and of casualties by age and number."""
    vehicle = {"type": "vehicle_type", "impact": "point_of_impact", "no": "vehicle_no"}
    casualty = {"no": "casualty_no", "age": "age", "band": F.floor(F.col("age") / 10)}
    s = Scratch(spark, "terms")
    vehicles, casualties = s.table(t.vehicle(spark, sf), "vehicle"), s.table(t.casualty(spark, sf), "casualty")
    return s.table(voc.terms(vehicles, vehicle, "vehicle").unionByName(voc.terms(casualties, casualty, "casualty")))


_severity: dict[tuple[str, str], DataFrame] = {}


def _severity_rows(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _severity:
        after = severity.after_crash_columns(t.vehicle(spark, sf), t.casualty(spark, sf), views.VEHICLE_TYPES, views.IMPACTS)
        p = t.placed(spark, sf)
        _severity[key] = Scratch(spark, "severity").table(severity.severity_rows(p.crashes, after))
    return _severity[key]


@query
def severity_model(spark, sf):
    return _severity_report(spark, sf)


@query
def model_compare(spark, sf):
    return severity.compare_models(_severity_rows(spark, sf), severity.DEPLOYABLE)


@query
def ablation(spark, sf):
    return severity.ablate(_severity_rows(spark, sf), severity.PLACE, severity.TIME, severity.HISTORY)


@query
def protocol(spark, sf):
    return severity.protocol_experiment(_severity_rows(spark, sf), severity.DEPLOYABLE)


@query
def severity_inputs(spark, sf):
    """Label and rolling history of every crash that the severity models see."""
    rows = _severity_rows(spark, sf).select("collision_id", "severe", "casualty_count", "vehicle_count", *severity.HISTORY)
    return rounded(rows, **{c: 6 for c in ("f_casualties_per_crash", "f_vehicles_per_crash", "f_speed_mean", "f_urban_share", "f_unlit_share", "f_night_share")})


_report: dict[tuple[str, str], DataFrame] = {}


def _severity_report(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _report:
        _report[key] = severity.severity_report(_severity_rows(spark, sf))
    return _report[key]


@query
def severity_factors(spark, sf):
    """Factors of the deployable severity model, by its own SHAP values over all its crashes."""
    rows = _severity_rows(spark, sf)
    model = severity.fit_severity(rows, severity.DEPLOYABLE)
    return factor_ranking(model.contributions(rows))


@query
def model_capture(spark, sf):
    """The headline claim: later casualties on the segments that out-of-fold scores rank first, against the count."""
    known = _scored_segments(spark, sf).where(F.col("f_crashes") > 0)
    return ranks.capture_compare(known, "score", "f_crashes", "ksi_target")


@query
def model_gains(spark, sf):
    return ranks.gains(_scored_segments(spark, sf).where(F.col("f_crashes") > 0), "score", "ksi_target")


@query
def stats(spark, sf):
    s = rank_segments(_scored_segments(spark, sf))
    return answers.stats_summary(s, model_capture(spark, sf), shap_factors(spark, sf), _severity_report(spark, sf))
