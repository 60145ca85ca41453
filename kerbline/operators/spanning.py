"""Minimum spanning forest of crash positions, per road number, as DataFrame joins.

Two positions of a road are linked when they are at most ``gap_m`` apart; the forest is the exact
minimum spanning forest of that graph. The graph itself is never written out. The work goes in
rising radii: once every link up to radius r is settled, the positions form components that lie
more than r apart, and only the shortest link between each two components can still matter.

At each radius, positions are grouped into blocks (grid cell x component). The grid has cells of
one radius, so partners sit in the 3 x 3 neighbouring cells. A pair of blocks is opened into
positions only when the product of their sizes is small; a larger pair is split into finer
blocks, and block pairs whose boxes are farther apart than the best known upper bound for their two
components are dropped. A dense cell is therefore narrowed down, never multiplied out.

Links are ordered by (length, smaller id, larger id), so the forest is unique and every run agrees.

New positions extend a forest without redoing it (``extend_forest``). A link between two old positions that
the old forest left out closes a cycle in which it is the longest link; it stays out, as the cycle is still there.
So the new forest is that of the old forest's links and the links that touch a new position: roads
without one are passed on as they are, and on the others no two old positions are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import METRES_PER_DEGREE, haversine_m
from kerbline.operators.near import Grid, forward_cells, near_pairs
from kerbline.scratch import Scratch

SPLIT = 4  # step between candidate radii and between successive block sides
OPEN_PAIRS = 1024  # block pairs with at most this many position pairs are opened
CELL_MAX = 48  # most components a cell may hold at the chosen radius
PAIRS_PER_COMPONENT = 12.0  # and most pairs of components within cells, per component listed
FEW_PAIRS = 20_000  # a total that needs no closer look
MIN_RADIUS_M = 0.001
RADII_PER_JOB = 5  # radii that are tried side by side, the widest first
BLOCK = ["comp", "fresh"]  # what a block's positions have in common beside their cell
HOPS = 6  # steps towards the root per job
COORD_DECIMALS = 9  # positions equal to 0.1 mm are one position


def with_position(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Whole-number position keys, so that equal places join on integers."""
    scale = 10**COORD_DECIMALS
    return df.withColumn("px", F.round(F.col(lon) * scale).cast("long")).withColumn("py", F.round(F.col(lat) * scale).cast("long"))


def positions(crashes: DataFrame) -> DataFrame:
    """One row per (road, place); the id is the smallest crash id there."""
    return (
        with_position(crashes)
        .groupBy("road_number", "px", "py")
        .agg(
            F.min("collision_id").alias("pos_id"),
            F.min("lon").alias("lon"),
            F.min("lat").alias("lat"),
            F.count(F.lit(1)).alias("n_here"),
        )
    )


def next_radius(pts: DataFrame, grid: Grid, current: float, gap_m: float) -> float:
    """Largest radius at which no cell, and not the total, gives too many pairs of components.

    At the start every position is a component of its own. Later ones are few, so the radius can
    often jump straight to the widest one.
    """
    radii = [gap_m]
    while radii[-1] / SPLIT > max(current * 1.001, MIN_RADIUS_M):
        radii.append(radii[-1] / SPLIT)
    if len(radii) == 1:
        return gap_m
    # the widest radii first, a few a job: their cells are few, and so are the counts that meet in the shuffle
    for at in range(0, len(radii), RADII_PER_JOB):
        some = radii[at : at + RADII_PER_JOB]
        cx, cy = grid.cell(some[-1])
        up = [f"struct({i} as i, floor(cx / {SPLIT**k}) as x, floor(cy / {SPLIT**k}) as y)" for i, k in enumerate(range(len(some) - 1, -1, -1))]
        each = F.explode(F.expr(f"array({', '.join(up)})")).alias("c")
        if not current:  # every position is its own component: counts of the finest cells add up
            cells = pts.groupBy("road_number", cx, cy).agg(F.count(F.lit(1)).alias("m")).select("road_number", "m", each).groupBy("road_number", "c").agg(F.sum("m").alias("m"))
        else:  # cells are nested: components are listed per finest cell, then rolled up
            listed = pts.select("road_number", cx, cy, "comp").distinct().select("road_number", "comp", each).distinct()
            cells = listed.groupBy("road_number", "c").agg(F.count(F.lit(1)).alias("m"))
        stats = cells.groupBy(F.col("c.i").alias("i")).agg(F.max("m").alias("top"), F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
        fits = [r["i"] for r in stats.collect() if r["top"] <= CELL_MAX and r["pairs"] <= max(FEW_PAIRS, PAIRS_PER_COMPONENT * r["n"])]
        if fits:
            return some[min(fits)]
    return radii[-1]


_BOX = ["lo_lon", "hi_lon", "lo_lat", "hi_lat", "cos_lo", "cos_hi"]


def _summary() -> list[Column]:
    """Size, one member and tight box of a block, with the range of cosines over the box.

    The cosines are worked out here, once per block, because the bounds that use them become join
    conditions, which are evaluated for every pair.
    """
    lo, hi = F.min("lat"), F.max("lat")
    far, near = F.greatest(F.abs(lo), F.abs(hi)), F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return [
        F.count(F.lit(1)).alias("n"), F.min("pos_id").alias("one"),
        F.min("lon").alias("lo_lon"), F.max("lon").alias("hi_lon"), lo.alias("lo_lat"), hi.alias("hi_lat"),
        F.cos(F.radians(far)).alias("cos_lo"), F.cos(F.radians(near)).alias("cos_hi"),
    ]


def _blocks(pts: DataFrame, grid: Grid, side_m: float) -> DataFrame:
    cx, cy = grid.cell(side_m)
    return pts.groupBy("road_number", cx, cy, *BLOCK).agg(*_summary())


def _side(name: str, extra: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{c}_{name}") for c in ["cx", "cy", *BLOCK, "n", "one", *_BOX, *extra]]


def _bounds(p: DataFrame) -> DataFrame:
    """Lower and upper bounds on the distance between any position of box a and any of box b."""
    near = "greatest(0D, lo_{0}_a - hi_{0}_b, lo_{0}_b - hi_{0}_a) * {1}"
    far = "(greatest(hi_{0}_a, hi_{0}_b) - least(lo_{0}_a, lo_{0}_b)) * {1}"
    # over the latitudes between two boxes the cosine can exceed both only across the equator
    top = "if(least(lo_lat_a, lo_lat_b) <= 0 and greatest(hi_lat_a, hi_lat_b) >= 0, 1D, greatest(cos_hi_a, cos_hi_b))"
    low = "least(cos_lo_a, cos_lo_b)"
    k = METRES_PER_DEGREE
    p = p.withColumns({
        "near_x": F.expr(near.format("lon", low)) * k, "near_y": F.expr(near.format("lat", "1D")) * k,
        "far_x": F.expr(far.format("lon", top)) * k, "far_y": F.expr(far.format("lat", "1D")) * k,
    })
    return p.withColumns({
        "lower": F.expr("sqrt(near_x * near_x + near_y * near_y) * 0.999D - 1e-6D"),
        "upper": F.expr("sqrt(far_x * far_x + far_y * far_y) * 1.001D + 1e-6D"),
    }).drop("near_x", "near_y", "far_x", "far_y")


def _prune(p: DataFrame) -> DataFrame:
    """Drop block pairs that cannot hold the shortest link of their two components."""
    best = p.groupBy(F.least("comp_a", "comp_b").alias("_p"), F.greatest("comp_a", "comp_b").alias("_q")).agg(F.min("upper").alias("best"))
    cond = (F.least(p["comp_a"], p["comp_b"]) == best["_p"]) & (F.greatest(p["comp_a"], p["comp_b"]) == best["_q"])
    return p.join(best, cond).where(F.col("lower") <= F.col("best")).drop("_p", "_q", "lower", "upper")


def _block_pairs(blocks: DataFrame) -> DataFrame:
    a = forward_cells(blocks.select("road_number", *_side("a", [])), "cx_a", "cy_a", "cx_b", "cy_b")
    b = blocks.select("road_number", *_side("b", []))
    other = F.when(F.col("own"), F.col("comp_a") < F.col("comp_b")).otherwise(F.col("comp_a") != F.col("comp_b"))
    return a.join(b, ["road_number", "cx_b", "cy_b"]).where(other & (F.col("fresh_a") | F.col("fresh_b"))).drop("own")


def _links(p: DataFrame) -> DataFrame:
    """Links of position pairs; ``p`` has ida, lona, lata, idb, lonb, latb and components."""
    return p.select(
        F.least("comp_a", "comp_b").alias("ca"),
        F.greatest("comp_a", "comp_b").alias("cb"),
        F.struct(
            haversine_m("lona", "lata", "lonb", "latb").alias("w"), F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")
        ).alias("link"),
    )


def _known_links(pts: DataFrame, known: DataFrame, settled: float, radius: float) -> DataFrame:
    """Links of an older forest that are longer than ``settled`` and at most ``radius``, with their components."""
    due = known.where((F.round("w", 3) > settled) & (F.round("w", 3) <= radius)).select("w", "a", "b")
    for e in ("a", "b"):
        due = due.join(pts.select(F.col("pos_id").alias(e), F.col("comp").alias(f"c{e}")), e)
    return due.where(F.col("ca") != F.col("cb")).select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "w", "a", "b")


def _first_links(pts: DataFrame, grid: Grid, radius: float, s: Scratch, known: DataFrame | None) -> tuple[DataFrame, int]:
    """At the start every position is its own component and the cells are small: links are pairs."""
    links = near_pairs(pts, radius, grid, "fresh").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b")
    if known is not None:
        links = links.unionByName(_known_links(pts, known, -1.0, radius))
    kept, m = s.keep(links, "links")
    return kept, m["rows"]


def _candidates(pts: DataFrame, grid: Grid, radius: float, s: Scratch) -> tuple[DataFrame, int]:
    """One link per pair of components at most ``radius`` apart: the shortest that touches a fresh position."""
    size = F.col("n_a") * F.col("n_b")
    sizes = {"heavy": F.count_if(size > OPEN_PAIRS), "opened": F.count_if((size > 1) & (size <= OPEN_PAIRS))}
    met = s.table(_bounds(_block_pairs(_blocks(pts, grid, radius))).where(F.col("lower") <= radius), "met")
    pairs, m = s.keep(_prune(met), "pairs", **sizes)
    s.drop(met)
    if not m["rows"]:
        s.drop(pairs)
        return pairs, 0
    found, used = [], [pairs]
    side = radius
    while True:
        single = pairs.where(size == 1).select(
            "comp_a", "comp_b",
            F.col("one_a").alias("ida"), F.col("lo_lon_a").alias("lona"), F.col("lo_lat_a").alias("lata"),
            F.col("one_b").alias("idb"), F.col("lo_lon_b").alias("lonb"), F.col("lo_lat_b").alias("latb"),
        )
        found.append(_links(single))
        if m["opened"]:
            cx, cy = grid.cell(side)
            member = pts.select("road_number", cx, cy, *BLOCK, "pos_id", "lon", "lat")
            light = pairs.where((size > 1) & (size <= OPEN_PAIRS)).select("road_number", *[f"{c}_{e}" for e in "ab" for c in ("cx", "cy", *BLOCK)])
            for e in ("a", "b"):
                side_pts = member.select(
                    "road_number",
                    *[F.col(c).alias(f"{c}_{e}") for c in ("cx", "cy", *BLOCK)],
                    F.col("pos_id").alias(f"id{e}"), F.col("lon").alias(f"lon{e}"), F.col("lat").alias(f"lat{e}"),
                )
                light = light.join(side_pts, ["road_number", *[f"{c}_{e}" for c in ("cx", "cy", *BLOCK)]])
            found.append(_links(light))
        if not m["heavy"]:
            break
        # split each heavy pair into finer blocks and keep only the block pairs that can still win
        heavy = pairs.where(size > OPEN_PAIRS)
        fine_side = side / SPLIT
        cx, cy = grid.cell(side)
        fx, fy = grid.cell(fine_side)
        parts = (
            pts.select("road_number", cx, cy, *BLOCK, "pos_id", "lon", "lat", fx.alias("fx"), fy.alias("fy"))
            .groupBy("road_number", "cx", "cy", *BLOCK, "fx", "fy")
            .agg(*_summary())
        )
        p = heavy.select("road_number", *[f"{c}_{e}" for e in "ab" for c in ("cx", "cy", *BLOCK)], "best")
        for e in ("a", "b"):
            q = parts.select(
                "road_number",
                *[F.col(c).alias(f"{c}_{e}") for c in ("cx", "cy", *BLOCK, "n", "one", *_BOX)],
                F.col("fx").alias(f"fx_{e}"), F.col("fy").alias(f"fy_{e}"),
            )
            p = p.join(q, ["road_number", *[f"{c}_{e}" for c in ("cx", "cy", *BLOCK)]])
        for e in ("a", "b"):
            p = p.drop(f"cx_{e}", f"cy_{e}").withColumnRenamed(f"fx_{e}", f"cx_{e}").withColumnRenamed(f"fy_{e}", f"cy_{e}")
        side = fine_side
        met = s.table(_bounds(p).where((F.col("lower") <= radius) & (F.col("lower") <= F.col("best"))).drop("best"), "met")
        pairs, m = s.keep(_prune(met), "pairs", **sizes)
        s.drop(met)
        used.append(pairs)
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    # the radius is checked on the shortest link only, not inside the joins for every pair
    links = (
        links.groupBy("ca", "cb")
        .agg(F.min("link").alias("link"))
        .where(F.round("link.w", 3) <= radius)
        .select("ca", "cb", "link.w", "link.a", "link.b")
    )
    kept, lm = s.keep(links, "links")
    s.drop(*used)
    return kept, lm["rows"]


def _merge(links: DataFrame, n: int, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """Boruvka rounds over component links, until none is left: the chosen links, and component -> merged component."""
    chosen, mapping = [], None
    while n:
        ends = links.select(F.col("ca").alias("c"), F.struct("w", "a", "b", F.col("cb").alias("o")).alias("m")).unionByName(
            links.select(F.col("cb").alias("c"), F.struct("w", "a", "b", F.col("ca").alias("o")).alias("m"))
        )
        best = s.table(ends.groupBy("c").agg(F.min("m").alias("m")).select("c", F.col("m.o").alias("up"), "m.w", "m.a", "m.b"), "best")
        chosen.append(best.select("w", "a", "b"))
        # the smaller of two components that chose each other is the root of its tree
        other = best.select(F.col("c").alias("up"), F.col("up").alias("up2"))
        mutual = (F.col("up2") == F.col("c")) & (F.col("c") < F.col("up"))
        parent = s.table(best.select("c", "up").join(other, "up").select("c", F.when(mutual, F.col("c")).otherwise(F.col("up")).alias("up")), "parent")
        while True:
            # several steps up per job; each job shortens the way to the root HOPS + 1 times
            step = parent.select("c", F.col("up").alias("h0"))
            for i in range(HOPS):
                step = step.join(parent.select(F.col("c").alias(f"h{i}"), F.col("up").alias(f"h{i + 1}")), f"h{i}")
                step = step.select("c", *[f"h{k}" for k in (i, i + 1)])
            last = F.col(f"h{HOPS}")
            step = step.select("c", last.alias("up"), (last != F.col(f"h{HOPS - 1}")).alias("moved"))
            nxt, m = s.keep(step, "parent", moved=F.count_if("moved"))
            s.drop(parent)
            parent = nxt
            if not m["moved"]:
                break
        parent = parent.select("c", "up")
        if mapping is None:
            mapping = parent
        else:
            # written every round, so that the plan does not grow with the rounds
            nxt = parent.select(F.col("c").alias("up"), F.col("up").alias("top"))
            longer = s.table(mapping.join(nxt, "up", "left").select("c", F.coalesce("top", "up").alias("up")), "mapping")
            s.drop(mapping)
            mapping = longer
        na, nb = parent.select(F.col("c").alias("ca"), F.col("up").alias("na")), parent.select(F.col("c").alias("cb"), F.col("up").alias("nb"))
        rest = (
            links.join(na, "ca").join(nb, "cb").where(F.col("na") != F.col("nb"))
            .groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb"))
            .agg(F.min(F.struct("w", "a", "b")).alias("m"))
            .select("ca", "cb", "m.w", "m.a", "m.b")
        )
        nxt, m = s.keep(rest, "links")
        s.drop(links)
        links, n = nxt, m["rows"]
    forest = chosen[0]
    for c in chosen[1:]:
        forest = forest.unionByName(c)
    return forest.distinct(), mapping


def spanning_forest(pts: DataFrame, gap_m: float = 5000.0, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(edges, labelled)``: edges (a, b, w) of the forest, and the positions with ``comp``.

    ``comp`` is the id of one position of the stretch. With ``known``, the edges of a forest of those positions
    whose column ``fresh`` is false, only links that touch the other positions are looked for.
    """
    spark = pts.sparkSession
    s = Scratch(spark, "forest")
    columns = [c for c in pts.columns if c not in ("comp", "fresh")]
    fresh = F.lit(True) if known is None else F.col("fresh")
    cur, m = s.keep(pts.select(*columns, F.col("pos_id").alias("comp"), fresh.alias("fresh")), "pts", top=F.max(F.abs("lat")))
    grid = Grid(float(m["top"] or 0.0))
    radius, settled, started, edges = 0.0, 0.0, False, []
    while radius < gap_m:
        settled, radius = radius, next_radius(cur, grid, radius, gap_m)
        if not started:
            links, n = _first_links(cur, grid, radius, s, known)
        else:
            links, n = _candidates(cur, grid, radius, s)
            if known is not None:
                due = _known_links(cur, known, settled, radius)
                both = links.unionByName(due) if n else due
                both = both.groupBy("ca", "cb").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("ca", "cb", "m.w", "m.a", "m.b")
                found, m = s.keep(both, "links")
                s.drop(links if n else None)
                links, n = found, m["rows"]
        started = True
        if n:
            forest, mapping = _merge(links, n, s)
            edges.append(forest)
            up = mapping.select(F.col("c").alias("comp"), F.col("up").alias("top"))
            nxt = s.table(cur.join(up, "comp", "left").select(*columns, F.coalesce("top", "comp").alias("comp"), "fresh"), "pts")
            s.drop(cur)
            cur = nxt
    labelled = cur.drop("fresh")
    if not edges:
        empty = pts.select(F.lit(0.0).alias("w"), F.col("pos_id").alias("a"), F.col("pos_id").alias("b")).limit(0)
        return empty, labelled
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return s.table(out.select("a", "b", "w"), "edges"), labelled


def with_road(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """Edges with their road, the form in which a forest is kept for later extension."""
    return edges.join(labelled.select(F.col("pos_id").alias("a"), "road_number"), "a").select("road_number", "a", "b", "w")


def extended_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and ``new`` positions as one table with ``fresh``, true for places that ``old`` has not.

    A place that both have keeps its id and coordinates and adds up its crashes.
    """
    place = ["road_number", "px", "py"]
    more = new.select(*place, F.col("n_here").alias("more"))
    kept = old.join(more, place, "left").select(*place, "pos_id", "lon", "lat", (F.col("n_here") + F.coalesce("more", F.lit(0))).alias("n_here"), F.lit(False).alias("fresh"))
    added = new.join(old.select(*place), place, "left_anti")
    return kept.unionByName(added.select(*place, "pos_id", "lon", "lat", "n_here", F.lit(True).alias("fresh")))


def extend_forest(old: DataFrame, edges: DataFrame, new: DataFrame, gap_m: float = 5000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, labelled, roads)`` after positions were added; ``roads`` are those that have a new place.

    ``old`` has ``comp`` (or ``run``, a stretch number, which is not read), ``edges`` come from ``with_road``, ``new`` from
    ``positions`` of the added crashes, whose ids are not among the old ones. The forest equals that of all
    positions at once. ``labelled`` holds the positions of ``roads`` only: the others' labels and edges stay.
    No new place: the edges are the old ones and ``labelled`` is empty.
    """
    s = Scratch(old.sparkSession, "extended")
    place = ["road_number", "px", "py"]
    # a year's new places are few beside all places, and their roads fewer: Spark broadcasts them if they are small
    roads, m = s.keep(new.join(old.select(*place), place, "left_anti").select("road_number").distinct(), "roads")
    if not m["rows"]:
        return edges, old.where("false").select(*place, "pos_id", "lon", "lat", "n_here", F.col("pos_id").alias("comp")), roads
    pts = extended_positions(old.join(roads, "road_number", "left_semi"), new.join(roads, "road_number", "left_semi"))
    known = s.table(edges.join(roads, "road_number", "left_semi"), "known")
    found, labelled = spanning_forest(pts, gap_m, known)
    return s.table(edges.join(roads, "road_number", "left_anti").unionByName(with_road(found, labelled)), "edges"), labelled, roads
