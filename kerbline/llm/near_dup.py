"""Near-duplicate documents by an LSH forest.

Each document's set of word shingles gets a MinHash signature. ``TREES`` trees sort the documents by differently
ordered signatures; documents that share a tree's first ``BASE`` values form a region. Small regions are opened
whole. Crowded ones are descended: they split at the longest prefix their documents share, so depth adapts to each
region, until the parts are small. On the way down, documents next to each other in sorted order (longest common
prefixes) become candidates, and so does each document with its region's hubs, the documents nearest to the
region's commonest values: in a group of thousands of edited copies of one text, copies hardly resemble each other
but do resemble the text they come from. Copies with an edit in common meet by the uncommon values they share. The
number of candidates per document and tree is thus bounded.

Candidates are confirmed on full shingle sets, and confirmed links joined into connected components. Equal sets are
merged beforehand, so copies cost nothing after the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import partitions
from kerbline.llm.components import components
from kerbline.llm.text_hash import batches, mixed, shingle_hashes
from kerbline.scratch import Scratch

TREES, BASE, VALUES = 16, 3, 128
#: A region of so many documents is opened whole; a crowded one has so many hubs.
OPEN, HUBS = 24, 4
#: A tree's order begins so many values further on than the last one's; it groups by the values of three steps,
#: so that each value is looked at in three trees.
STEP = VALUES // TREES
GROUPED = 3 * STEP
#: Candidates agree in so many signature values at least: so many standard deviations below the mean of a pair just at
#: the threshold, of which one in a hundred thousand agrees in fewer.
SCREEN_SD = 4.25
#: Documents per block in the exact comparison, and rows that a task descends at once.
BLOCK, BUFFER = 48, 1 << 15
#: A cut region gets further hubs while its last ones settled, besides themselves, more than one of so many members.
AGAIN = 16

TRIANGLE = [np.triu_indices(n, 1) for n in range(OPEN + 1)]
_SEEDS = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:VALUES].astype(np.uint32), _SEEDS[VALUES:].astype(np.uint32) | np.uint32(1)

SIGNED = "doc_id long, n_shingles long, set_key binary, region long, keys array<long>, signature binary"


def _signed(width: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids, texts = table.column(0), ["" if t is None else t for t in table.column(1).to_pylist()]
            for a, b in batches(texts):
                h, of = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts[a:b]], width, lower=True)
                ends = np.searchsorted(of, np.arange(b - a + 1))
                sizes, set_keys = np.zeros(b - a, np.int64), []
                for k in range(b - a):
                    s = np.unique(h[ends[k] : ends[k + 1]])
                    sizes[k] = len(s)
                    set_keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = np.zeros((b - a, VALUES), np.uint32)
                some = np.flatnonzero(sizes)
                if len(some):
                    h32 = (h >> np.uint64(32)).astype(np.uint32)
                    for v in range(VALUES):
                        low[some, v] = np.minimum.reduceat((h32 ^ _XOR[v]) * _MUL[v], ends[some])
                keys = np.zeros((b - a, TREES), np.uint64)
                for t in range(TREES):
                    for d in range(BASE):
                        keys[:, t] = mixed(keys[:, t] + low[:, t * BASE + d].astype(np.uint64) + np.uint64(d * TREES + t))
                values = low.astype(">u2")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(sizes), pa.array(set_keys, pa.binary()), pa.array(mixed(low[:, 0].astype(np.uint64)).view(np.int64)),
                     pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "region", "keys", "signature"],
                )

    return run


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Set size, digest of the set, tree keys and signature of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_signed(width), SIGNED)


def _crowd(values: np.ndarray, grouped: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hubs, the rows that agree most with each position's commonest value; and, for the first ``grouped``
    positions, groups of few rows that share another value, so that copies which have an edit in common meet
    although hundreds resemble them as much."""
    agree, groups = np.zeros(len(values), np.int64), []
    for v in range(values.shape[1]):
        order = np.argsort(values[:, v], kind="stable")
        c = values[order, v]
        starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        sizes = np.diff(np.append(starts, len(c)))
        commonest = sizes.argmax()
        agree += values[:, v] == c[starts[commonest]]
        if v < grouped:
            groups += [order[x : x + n] for x, n in zip(starts.tolist(), sizes.tolist(), strict=True) if 1 < n <= OPEN and n < sizes[commonest]]
    return np.argsort(-agree, kind="stable")[:HUBS], groups


def _region_pairs(values: np.ndarray) -> np.ndarray:
    """Candidate pairs (row numbers) of one region, whose rows are sorted by ``values``."""
    common = (values[1:] != values[:-1])
    common = np.where(common.any(axis=1), common.argmax(axis=1), values.shape[1])
    out, todo = [], [(0, len(values), 1 << 62)]
    while todo:
        a, b, hubs_at = todo.pop()
        n = b - a
        if n < 2:
            continue
        if n <= OPEN:
            i, j = TRIANGLE[n]
            out.append(np.stack((i + a, j + a)))
            continue
        if 2 * n <= hubs_at:  # at the top, and whenever the region has halved since
            hubs, groups = _crowd(values[a:b], GROUPED if n == len(values) else 0)
            hubs_at = n
            for hub in hubs + a:
                out.append(np.stack((np.full(n, hub), np.arange(a, b))))
            for g in groups:
                i, j = TRIANGLE[len(g)]
                out.append(np.stack((g[i] + a, g[j] + a)))
            out.append(np.stack((np.arange(a, b - 1), np.arange(a + 1, b))))
        gaps = common[a : b - 1]
        least = gaps.min()
        if least == values.shape[1]:  # equal signatures: the hubs have met them all
            continue
        edges = np.concatenate(([a], np.flatnonzero(gaps == least) + a + 1, [b]))
        todo += [(x, y, hubs_at) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def _alike(ids: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> pd.DataFrame:
    """The distinct pairs of rows ``i`` and ``j`` that agree in at least so many values, as ids ``a < b``."""
    alike = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        alike[part] = (values[i[part]] == values[j[part]]).sum(axis=1) >= least
    a, b = np.minimum(ids[i], ids[j])[alike], np.maximum(ids[i], ids[j])[alike]
    u = np.unique(np.stack((a, b), axis=1)[a != b], axis=0)
    return pd.DataFrame({"a": u[:, 0], "b": u[:, 1]})


def _values(orders) -> np.ndarray:
    return np.frombuffer(b"".join(orders), ">u2").reshape(-1, VALUES)


def _runs(regions: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], regions[1:] != regions[:-1], [True])))


FOUND = "a long, b long, tree int, key long, at int, after int, order binary"


def _descend(least: int, buffer: int):
    """Candidate pairs ``a, b`` of the regions in a task's sorted run of one or more trees' rows.

    Regions that do not lie whole in one chunk are named besides (``tree, key``), and the rows next to the
    task's ends in them are handed on (``a`` with ``order``, to the end ``at``, ``after`` or before it): an end may be that of several
    tasks, where tasks have few rows.
    """

    def pairs(ids: np.ndarray, regions: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        cuts = _runs(regions) if len(regions) else []
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                found.append(_region_pairs(values[a:b]) + a)
        i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return table(_alike(ids, values, i, j, least))

    def table(df: pd.DataFrame) -> pd.DataFrame:
        for c, t in (("a", "Int64"), ("b", "Int64"), ("tree", "Int32"), ("key", "Int64"), ("at", "Int32"), ("after", "Int32")):
            df[c] = df[c].astype(t) if c in df else pd.array([None] * len(df), t)
        df["order"] = df["order"] if "order" in df else None
        return df[["a", "b", "tree", "key", "at", "after", "order"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        ids, regions, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, VALUES), np.dtype(">u2"))
        split, met, size, region, first, head, tail = set(), 0, 0, None, None, [], []
        for f in frames:
            if not len(f):
                continue
            keys = f["key"].to_numpy()
            cuts = _runs(keys)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = (int(f["tree"].iat[x]), int(keys[x]))
                if here != region:
                    if met < size:
                        split.add(region)
                    region, met, size, tail = here, 0, int(f["n"].iat[x]), []
                    first = first or here
                met += y - x
                rows = lambda p, q: list(zip(f["doc_id"].iloc[p:q].tolist(), f["order"].iloc[p:q], strict=True))
                if here == first and len(head) < OPEN - 1:
                    head += rows(x, min(y, x + OPEN - 1 - len(head)))
                tail = (tail + rows(max(x, y - OPEN + 1), y))[1 - OPEN :]
            ids = np.concatenate((ids, f["doc_id"].to_numpy()))
            regions = np.concatenate((regions, keys))
            values = np.concatenate((values, _values(f["order"])))
            if len(ids) < buffer:
                continue
            start = int(np.flatnonzero(np.concatenate(([True], regions[1:] != regions[:-1])))[-1])
            if start == 0:  # one region larger than the buffer
                yield pairs(ids, regions, values)
                split.add(region)
                keep = np.arange(max(0, len(ids) - OPEN + 1), len(ids))
            else:
                yield pairs(ids[:start], regions[:start], values[:start])
                keep = np.arange(start, len(ids))
            ids, regions, values = ids[keep], regions[keep], values[keep]
        yield pairs(ids, regions, values)
        if met < size:
            split.add(region)
        yield table(pd.DataFrame(sorted(split), columns=["tree", "key"]))
        ends = [(*first, task - 1 - k, 1, i, o) for d, (i, o) in enumerate(head) for k in range(OPEN - 1 - d) if first in split]
        ends += [(*region, task + k, 0, i, o) for d, (i, o) in enumerate(reversed(tail)) for k in range(OPEN - 1 - d) if region in split]
        yield table(pd.DataFrame(ends, columns=["tree", "key", "at", "after", "a", "order"]))

    return run


def _together(least: int):
    """Candidate pairs among the few rows that a region has left."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.drop_duplicates(["tree", "key", "a"]).groupby(["tree", "key"]):
            i, j = np.triu_indices(len(g), 1)
            out.append(_alike(g["a"].to_numpy(np.int64), _values(g["order"]), i, j, least))
        return pd.concat(out)

    return run


def _over_cuts(least: int):
    """Candidate pairs over the end of a task: of the rows next to it, those that a part of ``OPEN`` rows could hold."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        for _, g in f.groupby(["tree", "key"]):
            g = g.sort_values(["after", "order", "a"])
            g = pd.concat((g[g["after"] == 0][1 - OPEN :], g[g["after"] == 1][: OPEN - 1]))
            n = int((g["after"] == 0).sum())
            i, j = np.triu_indices(len(g), 1)
            over = (i < n) & (j >= n) & (j - i < OPEN)
            out.append(_alike(g["a"].to_numpy(np.int64), _values(g["order"]), i[over], j[over], least))
        return pd.concat(out)

    return run


def _tallies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``tree, key, position, found, times``: how often each value occurs at each position of a region."""
    for f in frames:
        out = []
        for (tree, key), g in f.groupby(["tree", "key"]):
            values = _values(g["order"])
            for v in range(VALUES):
                found, times = np.unique(values[:, v], return_counts=True)
                out.append((tree, key, v, found.astype("<u2").tobytes(), times.astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["tree", "key", "position", "found", "times"])


def _commonest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``tree, key, position, value``: adds up tallies sorted by region and position, and takes the commonest."""
    at, total = None, np.zeros(1 << 16, np.int64)
    for f in frames:
        out = []
        for tree, key, v, found, times in zip(*(f[c] for c in ("tree", "key", "position", "found", "times")), strict=True):
            if (tree, key, v) != at:
                if at:
                    out.append((*at, int(total.argmax())))
                at = (tree, key, v)
                total[:] = 0
            total[np.frombuffer(found, "<u2")] += np.frombuffer(times, "<u4")
        yield pd.DataFrame(out, columns=["tree", "key", "position", "value"])
    yield pd.DataFrame([(*at, int(total.argmax()))] if at else [], columns=["tree", "key", "position", "value"])


def _nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``tree, key, agree, doc_id, order``: of each batch, the rows of a region that agree most with its commonest values."""
    for f in frames:
        out = [pd.DataFrame(columns=["tree", "key", "agree", "doc_id", "order"])]
        for _, g in f.groupby(["tree", "key"]):
            agree = (_values(g["order"]) == np.array(g["common"].iat[0])).sum(axis=1)
            best = g.assign(agree=agree).sort_values(["agree", "doc_id"], ascending=[False, True])[:HUBS]
            out.append(best[["tree", "key", "agree", "doc_id", "order"]])
        yield pd.concat(out)


def _with_hubs(least: int):
    """Per member of a region: its pairs ``a, b`` with the region's hubs; or the member itself where it has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [pd.DataFrame(columns=["tree", "key", "order", "doc_id", "a", "b"])]
            for _, g in f.groupby(["tree", "key"]):
                ids, values, met = g["doc_id"].to_numpy(), _values(g["order"]), np.zeros(len(g), bool)
                for hub in g["hubs"].iat[0]:
                    near = (values == _values([hub["order"]])).sum(axis=1) >= least
                    met |= near
                    x = ids[near & (ids != hub["doc_id"])]
                    out.append(g[near & (ids != hub["doc_id"])][["tree", "key"]].assign(a=np.minimum(x, hub["doc_id"]), b=np.maximum(x, hub["doc_id"])))
                out.append(g[~met][["tree", "key", "order", "doc_id"]])
            t = pd.concat(out)
            yield t.astype({"tree": "int32", "key": "int64", "doc_id": "Int64", "a": "Int64", "b": "Int64"}).assign(order=t["order"].where(t["order"].notna(), None))

    return run


def _hub_pairs(members: DataFrame, split: DataFrame, least: int, scratch: Scratch) -> DataFrame | None:
    """Candidate pairs of the hubs of split regions with all their members, wherever those were dealt.

    Hubs are found for the whole region: commonest value per position over all members, then the members that
    agree most with those. What resembles none of them goes through another round, for the region's next group,
    as long as a round settles more than one member in ``AGAIN``; when few are left, they are opened whole.
    """
    rest, found = scratch.keep(members.join(split, ["tree", "key"]).select("tree", "key", "order", "doc_id"), "split")
    out = None
    while found["rows"]:
        tallies = rest.mapInPandas(_tallies, "tree int, key long, position int, found binary, times binary")
        sums = tallies.repartition(partitions(rest), "tree", "key", "position").sortWithinPartitions("tree", "key", "position").mapInPandas(_commonest, "tree int, key long, position int, value int")
        common = sums.groupBy("tree", "key").agg(F.sort_array(F.collect_list(F.struct("position", "value")))["value"].alias("common"))
        common = scratch.table(common, "common")
        near = rest.join(common, ["tree", "key"]).mapInPandas(_nearest, "tree int, key long, agree long, doc_id long, order binary")
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "key").orderBy(F.desc("agree"), "doc_id"))).where(F.col("rank") <= HUBS)
        hubs = scratch.table(best.groupBy("tree", "key").agg(F.collect_list(F.struct("doc_id", "order")).alias("hubs")), "hubs")
        met = scratch.table(rest.join(hubs, ["tree", "key"]).mapInPandas(_with_hubs(least), "tree int, key long, order binary, doc_id long, a long, b long"), "met")
        pairs = met.where("a is not null").select("a", "b")
        out = pairs if out is None else out.union(pairs)
        before = rest.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("before"))
        left = met.where("a is null").groupBy("tree", "key").agg(F.count(F.lit(1)).alias("left"))
        left = scratch.table(left.join(before, ["tree", "key"]), "left")
        lone = met.where("a is null").select("tree", "key", F.col("doc_id").alias("a"), "order")
        few = lone.join(left.where(F.col("left").between(2, OPEN)).select("tree", "key"), ["tree", "key"])
        out = out.union(few.groupBy("tree", "key").applyInPandas(_together(least), "a long, b long"))
        again = left.where(F.expr(f"left > {OPEN} and (before - left - {HUBS}) * {AGAIN} > before")).select("tree", "key")
        rest, found = scratch.keep(lone.withColumnRenamed("a", "doc_id").join(again, ["tree", "key"]), "rest")
    return out


def candidates(sets: DataFrame, threshold: float, scratch: Scratch, buffer: int = BUFFER) -> DataFrame:
    """Distinct candidate pairs ``a < b`` from ``doc_id, keys, signature``.

    Only documents that share a region travel with their signatures. Rows are dealt by ranges of the sorted
    order, so a region of any size spreads over as many tasks as it needs; small ones stay whole. Where a
    crowded region is cut, all its members meet the hubs of the whole region, and the rows next to the cut each other.
    """
    keys = sets.select("doc_id", F.posexplode("keys").alias("tree", "key"))
    shared = keys.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(shared, ["tree", "key"]).join(sets.select("doc_id", "signature"), "doc_id")
    order = F.expr(f"concat(substring(signature, tree * {2 * STEP} + 1), substring(signature, 1, tree * {2 * STEP}))")
    members = members.select("tree", "key", order.alias("order"), "doc_id", "n")
    crowded = lambda c: F.when(F.col("n") > OPEN, F.col(c))
    dealt = members.repartitionByRange(partitions(sets), "tree", "key", crowded("order"), crowded("doc_id")).sortWithinPartitions("tree", "key", "order", "doc_id")
    least = int(np.floor(VALUES * threshold - SCREEN_SD * np.sqrt(VALUES * threshold * (1 - threshold))))
    found = scratch.table(dealt.mapInPandas(_descend(least, buffer), FOUND), "found")
    pairs = found.where("b is not null").select("a", "b")
    split, some = scratch.keep(found.where("a is null").select("tree", "key").distinct(), "cuts")
    if some["rows"]:
        ends = found.where("at is not null").select("at", "after", "tree", "key", "a", "order")
        pairs = pairs.union(ends.groupBy("at").applyInPandas(_over_cuts(least), "a long, b long"))
        pairs = pairs.union(_hub_pairs(members, split, least, scratch))
    return scratch.table(pairs.distinct(), "candidates")


def _confirm(width: int, percent: int):
    def links(cell: list[tuple[int, np.ndarray, list[int]]]) -> list[tuple[int, int]]:
        sets: dict[int, list[np.ndarray]] = {}
        for i, s, _ in cell:
            sets.setdefault(i, []).append(s)
        group = {i: i for i in sets}

        def top(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        out = []
        for a, b in sorted({(i, j) for i, _, others in cell for j in others}):
            if b in sets and top(a) != top(b) and any(_linked(x, y, percent) for x in sets[a] for y in sets[b]):
                group[top(a)] = top(b)
                out.append((a, b))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, at, found = [], None, []
        for f in frames:
            texts = [t or "" for t in f["text"]]
            for x, y in batches(texts):
                h, of = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts[x:y]], width, lower=True)
                ends = np.searchsorted(of, np.arange(y - x + 1))
                for k in range(x, y):
                    if f["cell"].iat[k] != at:
                        found += links(cell)
                        cell, at = [], f["cell"].iat[k]
                    cell.append((int(f["doc_id"].iat[k]), np.unique(h[ends[k - x] : ends[k - x + 1]]), [int(j) for j in f["others"].iat[k]]))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
                found = []
        found += links(cell)
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = n + m - len(np.unique(np.concatenate((x, y))))
    return 100 * both >= percent * (n + m - both)


def confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The candidate pairs that hold on full sets, less those that other pairs of the same task imply.

    Pairs are grouped into cells of two blocks of about ``BLOCK`` documents, and each document's text goes once
    to each cell it has pairs in. Documents of one block mostly share their first signature value, so the few
    copies of an ordinary document meet in one cell.
    """
    crowd = sets.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = sets.select("doc_id", "region").join(crowd, "region").select("doc_id", F.xxhash64("region", F.pmod(F.xxhash64("doc_id"), "parts")).alias("block"))
    p = pairs.join(blocks.select(F.col("doc_id").alias("a"), F.col("block").alias("x")), "a").join(blocks.select(F.col("doc_id").alias("b"), F.col("block").alias("y")), "b")
    p = scratch.table(p.select("a", "b", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("cell")), "cells")
    asking = p.groupBy("cell", F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("others"))
    asked = p.select("cell", F.col("b").alias("doc_id"), F.array().cast("array<long>").alias("others")).distinct()
    needed = asking.union(asked).groupBy("cell", "doc_id").agg(F.flatten(F.collect_list("others")).alias("others"))
    # one plan at every size: a small side would be broadcast on small inputs only
    shipped = docs.select("doc_id", "text").join(needed.hint("merge"), "doc_id").select("cell", "doc_id", "others", "text")
    dealt = shipped.repartition(partitions(docs), "cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(_confirm(width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document (doc_id, text).

    Documents are linked when the intersection of their shingle sets is at least ``percent`` per cent of the
    union; ``component_id`` is the smallest id a document reaches over links, and ``kept`` marks that document.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat an id are one
    document: they share its component and are kept or not together. Rows without an id are linked with nothing
    and kept, with a null component. Other columns are not read. No rows: an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    every = scratch.table(signed(docs, width), "signed")
    least = every.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "region", "keys", "signature")).alias("m"))
    sets = scratch.table(least.select("set_key", "m.*"), "sets")
    pairs = candidates(sets, percent / 100, scratch)
    links = scratch.table(confirmed(docs, sets, pairs, width, percent, scratch), "links")
    # rows that repeat an id with another text tie that text's class to the id's
    same = every.where("set_key is not null").select("doc_id", "set_key").join(sets.select("set_key", F.col("doc_id").alias("first")), "set_key")
    twice = same.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b").select("a", "b")
    grouped = components(links.union(twice), scratch)
    first = sets.select("set_key", F.col("doc_id").alias("first")).join(grouped, F.col("first") == F.col("node"), "left").select("set_key", F.coalesce("label", "first").alias("low"))
    j = every.select("doc_id", "n_shingles", "set_key").join(first, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return j.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group, with all its columns."""
    found = near_duplicates(docs, width, percent, scratch)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone"), "left_anti")
