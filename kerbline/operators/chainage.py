"""Distance along each stretch, from its spanning tree.

Every tree is walked once around (each edge down and up again). The walk is a linked list; steps that
lie near each other are dealt to one task, which links them up to chains. The place of every chain in
the walk comes from list ranking, where each chain repeatedly skips over those its successors already
skipped, and gives the place of its steps. Depths are then running sums along the walk, and the distance from
any chosen position is a running minimum (the depth of the meeting point), so three scans give the
longest path and the chainage from one of its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.curve import curve_key
from kerbline.operators.running import CHUNK_ROWS, running
from kerbline.scratch import Scratch

#: Steps that one task links up to chains, about.
PART_STEPS = 1 << 18


def _linked(f: pd.DataFrame) -> pd.DataFrame:
    """Steps of one task with the step (nu -> nv) that comes after their chain and the number ``k`` of steps up to there;
    ``first`` if no other step of the task leads to them. A walk's last step is followed by itself."""
    here = np.arange(len(f))
    own = f[["u", "v"]].assign(at=here).drop_duplicates(["u", "v"])
    to = f[["nu", "nv"]].merge(own, "left", left_on=["nu", "nv"], right_on=["u", "v"])["at"].fillna(-1).to_numpy(np.int64)
    to[to == here] = -1
    first = np.ones(len(f), bool)
    first[to[to >= 0]] = False
    last, k = here.copy(), np.ones(len(f), np.int64)
    while (on := np.flatnonzero(to >= 0)).size:
        skip = to[on]
        k[on], last[on], to[on] = k[on] + k[skip], last[skip], to[skip]
    end = f.iloc[last].reset_index(drop=True)
    ends = (end["u"] == end["nu"]) & (end["v"] == end["nv"])
    return pd.DataFrame({"u": f["u"], "v": f["v"], "nu": end["nu"], "nv": end["nv"], "k": k, "first": first, "ends": ends})


def _chains(nxt: DataFrame, s: Scratch) -> DataFrame:
    """``_linked`` of all steps, dealt by stretch and place in parts of even size, however they cluster."""
    steps, m = s.keep(nxt, "steps")
    parts = max(1, -(-m["rows"] // PART_STEPS))
    dealt = steps.repartitionByRange(parts, "comp", "place", "lat", "u", "v") if parts > 1 else steps.coalesce(1)
    kind = steps.schema["u"].dataType.simpleString()

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            yield _linked(pd.concat(held, ignore_index=True))

    schema = f"u {kind}, v {kind}, nu {kind}, nv {kind}, k long, first boolean, ends boolean"
    return s.table(dealt.select("u", "v", "nu", "nv").mapInPandas(link, schema), "chains")


def _walk(edges: DataFrame, pts: DataFrame, roots: DataFrame, s: Scratch) -> DataFrame:
    """Steps (u -> v) with comp, w and place ``pos`` from 1 in the walk of their stretch."""
    comp = pts.select(F.col("pos_id").alias("a"), "comp", curve_key("lon", "lat").alias("place"), "lat")
    e = edges.join(comp, "a")
    steps = e.select("comp", F.col("a").alias("u"), F.col("b").alias("v"), "w", "place", "lat").unionByName(
        e.select("comp", F.col("b").alias("u"), F.col("a").alias("v"), "w", "place", "lat")
    )
    # a position has at most six tree neighbours, so the window over it is small
    around = Window.partitionBy("u").orderBy("v")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = steps.select(
        "comp", "u", "v", "place", "lat",
        F.coalesce(F.lag("v").over(around), F.last("v").over(whole)).alias("from"),
        (F.row_number().over(around) == 1).alias("first"),
    )
    # arriving at u from ``from``, the walk goes on with (u -> v); it ends before the root's first step
    root = roots.select(F.col("root").alias("u"), F.lit(True).alias("is_root"))
    turn = turn.join(root, "u", "left")
    ends = F.coalesce(F.col("is_root"), F.lit(False)) & F.col("first")
    nxt = turn.select(
        F.col("from").alias("u"), F.col("u").alias("v"), F.when(~ends, F.col("u")).otherwise(F.col("from")).alias("nu"),
        F.when(~ends, F.col("v")).otherwise(F.col("u")).alias("nv"), "comp", "place", "lat",
    )
    chains = _chains(nxt, s)
    heads = chains.where("first").select("u", "v", *[F.when(~F.col("ends"), F.col(c)).alias(c) for c in ("nu", "nv")], "k")
    jump, m = s.keep(heads, "jump", open=F.count("nu"))
    while m["open"]:
        # three hops over the same table per job: every chain then skips four times as far; finished ones only
        # serve as goals, and those that finish on the way are dealt by their own position, not by the missing one
        cur = jump.where(F.col("nu").isNotNull())
        for i in range(3):
            hop = jump.select(F.col("u").alias("to_u"), F.col("v").alias("to_v"), F.col("nu").alias("hu"), F.col("nv").alias("hv"), F.col("k").alias("hk"))
            cur = cur.join(hop, (F.coalesce("nu", "u") == F.col("to_u")) & (F.col("nv") == F.col("to_v")), "left").select(
                "u", "v", F.col("hu").alias("nu"), F.col("hv").alias("nv"), (F.col("k") + F.coalesce("hk", F.lit(0))).alias("k")
            )
        done, m = s.keep(cur.unionByName(jump.where(F.col("nu").isNull())), "jump", open=F.count("nu"))
        s.drop(jump)
        jump = done
    # a chain that ends the walk has nothing after it; its steps are dealt by their own position
    after = jump.select(F.col("u").alias("to_u"), F.col("v").alias("to_v"), F.col("k").alias("rest"))
    goal = [F.when(F.col("ends"), F.col(c)).otherwise(F.col(f"n{c}")) == F.col(f"to_{c}") for c in "uv"]
    rest = F.when(~F.col("ends"), F.col("rest"))
    places = chains.join(after, goal[0] & goal[1], "left").select("u", "v", (F.col("k") + F.coalesce(rest, F.lit(0))).alias("k"))
    steps = steps.select("comp", "u", "v", "w").join(places, ["u", "v"])
    total = steps.groupBy("comp").agg(F.max("k").alias("total"))
    return steps.join(total, "comp").select("comp", "u", "v", "w", (F.col("total") - F.col("k") + 1).alias("pos"))


def _farthest(t: DataFrame, dist: str, name: str) -> DataFrame:
    """Per stretch the position farthest by ``dist``; ties go to the smallest (lat, lon, id)."""
    key = F.struct((-F.round(dist, 6)).alias("d"), "lat", "lon", F.col("head").alias("id"), "pos", "depth")
    return t.where("down").groupBy("comp").agg(F.min(key).alias(name))


def _distance_from(t: DataFrame, start: DataFrame, name: str, out: str) -> DataFrame:
    """Add the tree distance of every step's head from ``start`` (comp, name: struct)."""
    j = t.join(start.select("comp", F.col(f"{name}.pos").alias("_p"), F.col(f"{name}.depth").alias("_d")), "comp")
    j = j.withColumn("_after", F.col("pos") >= F.col("_p")).withColumn("_far", F.abs(F.col("pos") - F.col("_p")))
    j = j.withColumn("_chunk", F.floor(F.col("_far") / CHUNK_ROWS))
    j = running(j, ["comp", "_after"], "_chunk", ["_far"], {"_low": ("min", "depth")})
    meet = F.least("_low", "_d")
    return j.select(*t.columns, (F.col("_d") + F.col("depth") - 2 * meet).alias(out))


def chainage(pts: DataFrame, edges: DataFrame) -> DataFrame:
    """``pts`` (with comp) plus ``run``, ``chainage`` and ``stretch_m``.

    Chainage is the tree distance from one end of the longest path; of its two ends the one with the
    smaller (lat, lon, id). Runs are numbered from 1 within a road by smallest (lat, lon, id).
    """
    s = Scratch(pts.sparkSession, "chainage")
    first = pts.groupBy("road_number", "comp").agg(F.min(F.struct("lat", "lon", F.col("pos_id").alias("id"))).alias("lowest"))
    roots = s.table(first.select("road_number", "comp", "lowest", F.col("lowest.id").alias("root")), "roots")
    walk = s.table(_walk(edges, pts, roots, s), "walk")
    back = walk.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("pos").alias("back"))
    walk = walk.join(back, ["u", "v"]).select(
        "comp", F.col("v").alias("head"), "pos", (F.col("pos") < F.col("back")).alias("down"),
        F.when(F.col("pos") < F.col("back"), F.col("w")).otherwise(-F.col("w")).alias("step"),
    )
    start = roots.select("comp", F.col("root").alias("head"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("down"), F.lit(0.0).alias("step"))
    t = walk.unionByName(start).withColumn("_chunk", F.floor(F.col("pos") / CHUNK_ROWS))
    t = running(t, ["comp"], "_chunk", ["pos"], {"depth": ("sum", "step")}).drop("_chunk", "step")
    t = t.join(pts.select(F.col("pos_id").alias("head"), "lat", "lon"), "head")
    t = s.table(t, "depth")
    u = s.table(_farthest(t, "depth", "u"), "u")
    v = s.table(_farthest(_distance_from(t, u, "u", "dist"), "dist", "v"), "v")
    origin = u.join(v, "comp").select("comp", F.least(F.struct("u.lat", "u.lon", "u.id", "u.pos", "u.depth"), F.struct("v.lat", "v.lon", "v.id", "v.pos", "v.depth")).alias("o"), (-F.col("v.d")).alias("stretch_m"))
    origin = s.table(origin, "origin")
    dist = _distance_from(t, origin, "o", "chainage").where("down").select(F.col("head").alias("pos_id"), F.greatest(F.lit(0.0), "chainage").alias("chainage"))
    # stretches of one road lie gap_m apart on the ground, which bounds their number
    number = F.row_number().over(Window.partitionBy("road_number").orderBy("lowest"))
    runs = roots.select("comp", number.cast("int").alias("run")).join(origin.select("comp", "stretch_m"), "comp")
    out = pts.join(dist, "pos_id").join(runs, "comp")
    return s.table(out.select("road_number", "px", "py", "pos_id", "lon", "lat", "n_here", "comp", "run", "chainage", "stretch_m"), "chainage")
