"""Boosted trees for many models at once: folds, input sets and the full fit share every pass over the rows.

Inputs are binned once into at most ``max_bins`` bins, one byte each, and kept with label, memberships and raw scores
in blocks of rows. A pass routes each row through the trees grown since the scores were last written, sums count,
gradient and curvature by (model, node, input, bin) where the rows are, adds the partial sums of all partitions, and
picks each node's best split there. Only those choices reach the driver: at most ``2 ** depth`` small rows a model. One
pass grows one level of the current tree of every model, so the number of jobs is rounds times depth, whatever the
number of models and rows.

A step is a Newton step: with gradient sums G and curvature sums H a leaf is worth ``G / H`` and a split gains
``GL²/HL + GR²/HR - G²/H``. For counts, G = sum(y) - sum(mu) and H = sum(mu); for classes, G = sum(y - p) and
H = sum(p (1 - p)).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.models.shap import Condition, Leaf
from kerbline.scratch import LARGE_ROWS, Scratch, small_batches

#: Rows in one block, and the most models of one fit (their memberships are bits of a long).
BLOCK_ROWS, MAX_MODELS = 1 << 14, 62
#: Cells (rows times inputs of all models) whose sums are one task's work.
PART_CELLS = 1 << 22
#: Partitions of blocks for each core of the cluster: a pass exchanges the sums of every partition, so their number
#: must not grow with the rows. Most rows that one task deals and sorts when it packs them.
PARTS_PER_CORE, DEAL_ROWS = 2, 1 << 19
#: With several partitions, scores are rewritten after so many rounds at most: a pass routes all rows through the trees since.
CUT_SPREAD = 4
#: While fitting, a count's mean is kept within these; scores are not clipped.
MIN_MEAN, MAX_MEAN = 1e-6, 1e6
#: A split must gain this share of the node's curvature at least: less is rounding.
LEAST_GAIN = 1e-12


# --- inputs and bins --------------------------------------------------------------------------


@dataclass
class Input:
    """How one input becomes a bin. Numbers: how many ``edges`` lie below; null is the median. Categories: the place
    in ``values``, the last bin for all others and null."""

    name: str
    category: bool = False
    edges: list[float] = field(default_factory=list)
    median: float = 0.0
    values: list[str] = field(default_factory=list)

    def bins(self, column: pd.Series) -> np.ndarray:
        if self.category:
            return column.map({v: i for i, v in enumerate(self.values)}).fillna(len(self.values)).to_numpy(np.uint8)
        x = column.to_numpy(np.float64, na_value=np.nan)
        return np.searchsorted(np.array(self.edges), np.where(np.isnan(x), self.median, x)).astype(np.uint8)


def spread(df: DataFrame, inputs: list[str] | None) -> tuple[list[Column], list[str], list[bool]]:
    """Columns, names and kinds of the inputs: named columns, or the entries of the vector ``features``."""
    if inputs is not None:
        types = {f.name: f.dataType for f in df.schema.fields}
        text = [isinstance(types[c], T.StringType) for c in inputs]
        return [F.col(c) if t else F.col(c).cast("double") for c, t in zip(inputs, text, strict=True)], list(inputs), text
    attrs = [a for kind in df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).items() for a in [(x["idx"], x.get("name", str(x["idx"])), kind[0]) for x in kind[1]]]
    names = {i: (n, kind == "nominal") for i, n, kind in attrs}
    width = len(names) or len(df.select(vector_to_array("features")).first()[0])
    array = vector_to_array("features")
    cols = [array[i].cast("string") if names.get(i, ("", False))[1] else array[i] for i in range(width)]
    return cols, [names.get(i, (str(i), False))[0] for i in range(width)], [names.get(i, ("", False))[1] for i in range(width)]


def learn_inputs(rows: DataFrame, names: list[str], category: list[bool], max_bins: int) -> list[Input]:
    """Bin edges at quantiles of the numbers, the most frequent values of the categories; columns are x0, x1, ..."""
    out = [Input(n, c) for n, c in zip(names, category, strict=True)]
    probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)], F.lit(1.0))
    numbers = [i for i, c in enumerate(category) if not c]
    if numbers:
        found = rows.agg(*[F.percentile_approx(f"x{i}", probs, 10_000).alias(f"x{i}") for i in numbers]).first()
        for i in numbers:
            q = found[f"x{i}"]
            if q:
                out[i].edges = sorted(set(q))[:-1]
                out[i].median = q[max_bins // 2 - 1]
    texts = [i for i, c in enumerate(category) if c]
    if texts:
        pairs = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in texts]))).where("v IS NOT NULL")
        counted = pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))).where(F.col("r") < max_bins)
        for r in sorted(top.collect(), key=lambda r: (r["i"], r["r"])):
            out[r["i"]].values.append(r["v"])
    return out


def binned(frame: pd.DataFrame, inputs: list[Input]) -> np.ndarray:
    """A row of bins for each row of columns x0, x1, ..."""
    out = np.zeros((len(frame), len(inputs)), np.uint8)
    for i, p in enumerate(inputs):
        out[:, i] = p.bins(frame[f"x{i}"])
    return out


# --- trees ------------------------------------------------------------------------------------


class Tree:
    """A binary tree with node k's children at 2k + 1 and 2k + 2; ``left[k, bin]`` says where a bin of its input goes."""

    def __init__(self, depth: int, bins: int):
        n = 2 ** (depth + 1) - 1
        self.input, self.left = np.full(n, -1, np.int32), np.zeros((n, bins), bool)
        self.value, self.count = np.zeros(n), np.zeros(n)

    def route(self, x: np.ndarray, depth: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The node each row of bins, or each of ``rows``, has reached after ``depth`` levels."""
        rows = np.arange(len(x)) if rows is None else rows
        node = np.zeros(len(rows), np.int64)
        if not depth or not len(rows):
            return node
        bins, flat, row = self.left.shape[1], x.ravel(), rows * x.shape[1]
        # where each bin of a node's input leads, as one flat table
        ends, at = self.input < 0, np.arange(len(self.input))
        column, goes = np.where(ends, 0, self.input).astype(np.int64), np.where(ends[:, None], at[:, None], 2 * at[:, None] + 2 - self.left).ravel()
        for _ in range(depth):
            node = goes.take(node * bins + flat.take(row + column.take(node)))
        return node

    def depth(self) -> int:
        return int(math.log2(len(self.input) + 1)) - 1

    def leaves(self, inputs: list[Input], weight: float) -> list[Leaf]:
        """Leaves with their paths, as conditions on bins."""
        out, stack = [], [(0, {})]
        while stack:
            k, path = stack.pop()
            f = int(self.input[k])
            if f < 0:
                out.append(Leaf(weight * float(self.value[k]), path))
                continue
            before, share = path.get(f, (Condition(), 1.0))
            goes = np.flatnonzero(self.left[k])
            if inputs[f].category:
                allowed = before.categories if before.categories is not None else frozenset(map(float, range(self.left.shape[1])))
                sides = Condition(categories=allowed & frozenset(map(float, goes))), Condition(categories=allowed - frozenset(map(float, goes)))
            else:
                cut = float(goes[-1])
                sides = Condition(before.low, min(before.high, cut)), Condition(max(before.low, cut), before.high)
            for child, condition in zip((2 * k + 1, 2 * k + 2), sides, strict=True):
                stack.append((child, {**path, f: (condition, share * float(self.count[child] / self.count[k]))}))
        return out

    def as_dict(self) -> dict:
        return {"input": self.input.tolist(), "left": ["".join("01"[int(b)] for b in row) if f >= 0 else "" for row, f in zip(self.left, self.input, strict=True)], "value": self.value.tolist(), "count": self.count.tolist()}

    @classmethod
    def from_dict(cls, d: dict, bins: int) -> Tree:
        out = cls(int(math.log2(len(d["input"]) + 1)) - 1, bins)
        out.input, out.value, out.count = np.array(d["input"], np.int32), np.array(d["value"]), np.array(d["count"])
        for k, row in enumerate(d["left"]):
            if row:
                out.left[k] = [c == "1" for c in row]
        return out


@dataclass
class Ensemble:
    """One fitted model: scores any table that has its inputs, explains itself, saves as JSON."""

    base: float
    rate: float
    inputs: list[Input]
    trees: list[Tree]
    losses: list[float]
    named: bool = True

    def columns(self, df: DataFrame) -> list[Column]:
        return spread(df, [p.name for p in self.inputs] if self.named else None)[0]

    def inputs_of(self, df: DataFrame, key: str) -> DataFrame:
        """``key`` and the model's inputs as x0, x1, ..., for ``bins``."""
        return df.select(key, *[c.alias(f"x{i}") for i, c in enumerate(self.columns(df))])

    def bins(self, frame: pd.DataFrame) -> np.ndarray:
        return binned(frame, self.inputs)

    def raw_of(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:
            total += self.rate * t.value[t.route(x, t.depth())]
        return total

    def raw(self, df: DataFrame) -> Column:
        """The raw score (log mean, log odds) as a column of ``df``."""
        cols, names = self.columns(df), [f"x{i}" for i in range(len(self.inputs))]

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for p in parts:
                p.columns = names
                yield pd.Series(self.raw_of(self.bins(p)))

        return score(F.struct(*[c.alias(x) for c, x in zip(cols, names, strict=True)]))

    def leaves(self) -> list[Leaf]:
        return [leaf for t in self.trees for leaf in t.leaves(self.inputs, self.rate)]

    def dumps(self) -> str:
        return json.dumps({"base": self.base, "rate": self.rate, "named": self.named, "losses": self.losses, "inputs": [asdict(p) for p in self.inputs],
            "bins": self.trees[0].left.shape[1] if self.trees else 1, "trees": [t.as_dict() for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> Ensemble:
        d = json.loads(text)
        return cls(d["base"], d["rate"], [Input(**p) for p in d["inputs"]], [Tree.from_dict(t, d["bins"]) for t in d["trees"]], d["losses"], d["named"])

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        return cls.loads(spark.read.text(path).first()[0])


# --- losses -----------------------------------------------------------------------------------


def _mean(f):
    return np.clip(np.exp(np.clip(f, -50, 50)), MIN_MEAN, MAX_MEAN)


def _poisson(y, f):
    mu = _mean(f)
    return y - mu, mu


def _logistic(y, f):
    p = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
    return y - p, np.maximum(p * (1 - p), 1e-12)


#: Gradient and curvature of each loss, and the loss itself, which only a tree's first level asks for.
LOSSES = {"poisson": _poisson, "logistic": _logistic}
VALUES = {"poisson": lambda y, f: _mean(f) - y * f, "logistic": lambda y, f: np.logaddexp(0, f) - y * f}


def _base(loss: str, mean: float) -> float:
    if loss == "poisson":
        return math.log(max(mean, MIN_MEAN))
    p = min(max(mean, MIN_MEAN), 1 - MIN_MEAN)
    return math.log(p / (1 - p))


# --- one pass ---------------------------------------------------------------------------------


@dataclass
class _Plan:
    """What a pass needs besides the blocks; small, and sent with the tasks."""

    loss: str
    bins: int
    min_instances: int
    uses: list[np.ndarray]  # inputs of each model
    category: np.ndarray
    done: list[list[tuple[float, Tree]]]  # per model: trees since the scores were written
    growing: list[Tree]
    level: int


def _written(block, models: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's bins, and its scores as they were last written."""
    return np.frombuffer(block["x"], np.uint8).reshape(block["n"], -1), np.frombuffer(block["f"], np.float64).reshape(block["n"], models)


def _scores(block, models: int, plan: _Plan) -> np.ndarray:
    x, f = _written(block, models)
    f = f.copy()
    for m in range(models):
        for rate, t in plan.done[m]:
            f[:, m] += rate * t.value[t.route(x, t.depth())]
    return f


def _sums(block, plan: _Plan, held: dict) -> None:
    """Adds a block's sums to ``held``: (model, node) -> [input in use, bin, (count, gradient, curvature)] and the loss."""
    models = len(plan.uses)
    x, f = _written(block, models)
    y, member = np.frombuffer(block["y"], np.float64), np.frombuffer(block["member"], np.int64)
    columns = np.ascontiguousarray(x.T)
    first, width = 2**plan.level - 1, 2**plan.level
    for m, use in enumerate(plan.uses):
        mine = np.flatnonzero(member >> m & 1)
        if not len(mine):
            continue
        # only the rows that the model learns from are routed and scored
        node = plan.growing[m].route(x, plan.level, mine) - first
        score = f[mine, m]
        for rate, t in plan.done[m]:
            score += rate * t.value[t.route(x, t.depth(), mine)]
        g, h = LOSSES[plan.loss](y[mine], score)
        if plan.level == 0:
            held[m, -1] = held.get((m, -1), 0.0) + np.array([len(mine), VALUES[plan.loss](y[mine], score).sum(), 0.0])
        at = node >= 0  # nodes that ended higher up stay there
        if not at.all():
            mine, node, g, h = mine[at], node[at], g[at], h[at]
        # one input after the other: its cells stay in the processor's cache
        sums, start = np.empty((width, len(use), plan.bins, 3)), node * plan.bins
        for i, c in enumerate(use):
            cell = start + columns[c].take(mine)
            for k, w in enumerate((None, g, h)):
                sums[:, i, :, k] = np.bincount(cell, w, width * plan.bins).reshape(width, plan.bins)
        for k in np.unique(node):
            held[m, int(k) + first] = held.get((m, int(k) + first), 0.0) + sums[k]


def _choices(m: int, nodes: list[int], sums: np.ndarray, plan: _Plan) -> list[tuple]:
    """The best split of each node by its sums [node, input, bin, (n, G, H)]; ties go to the first input, then to the
    lowest bin. Categories are first put in order of their own step."""
    use, total = plan.uses[m], sums[:, 0].sum(axis=1) if sums.shape[1] else np.zeros((len(nodes), 3))
    order = np.broadcast_to(np.arange(sums.shape[2]), sums.shape[:3]).copy()
    text = np.flatnonzero(plan.category[use])
    if len(text):
        n, g, h = np.moveaxis(sums[:, text], -1, 0)
        order[:, text] = np.argsort(np.where(n > 0, g / np.maximum(h, 1e-300), np.inf), axis=-1, kind="stable")
        sums = np.take_along_axis(sums, order[..., None], axis=2)
    left = np.cumsum(sums, axis=2)
    whole = total[:, None, None]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 2] + right[..., 1] ** 2 / right[..., 2] - whole[..., 1] ** 2 / whole[..., 2]
    least = max(1, plan.min_instances)
    gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least) & np.isfinite(gain), gain, -np.inf).reshape(len(nodes), -1)
    out = []
    for at, node in enumerate(nodes):
        best = (-1, [], [])
        if gain.shape[1] and gain[at, k := int(gain[at].argmax())] > max(1.0, abs(total[at, 2])) * LEAST_GAIN:
            i, b = divmod(k, sums.shape[2])
            best = (int(use[i]), order[at, i, : b + 1].tolist(), left[at, i, b].tolist())
        out.append((m, node, *map(float, total[at]), *best))
    return out


def _decided(held: dict, plan: _Plan) -> list[tuple]:
    """Choices from the sums of (model, node), and the loss of each model as that of node -1."""
    out = [(m, -1, float(s[0]), float(s[1]), 0.0, -1, [], []) for (m, node), s in held.items() if node < 0]
    for m in range(len(plan.uses)):
        nodes = sorted(node for k, node in held if k == m and node >= 0)
        if nodes:
            out += _choices(m, nodes, np.stack([held[m, k] for k in nodes]), plan)
    return out


def _grow(growing: list[Tree], choices: list) -> bool:
    """Puts the choices of one level into the trees; false if none is a split."""
    split = False
    for m, k, n, g, h, i, goes, side in choices:
        if k < 0:
            continue
        t = growing[m]
        t.value[k], t.count[k] = g / max(h, 1e-300), n
        if i >= 0:
            split = True
            t.input[k] = i
            t.left[k, goes] = True
            for child, (cn, cg, ch) in ((2 * k + 1, side), (2 * k + 2, (n - side[0], g - side[1], h - side[2]))):
                t.value[child], t.count[child] = cg / max(ch, 1e-300), cn
    return split


_CHOICE = "m int, node int, n double, g double, h double, input int, goes array<int>, side array<double>"
_PARTIAL = "m int, node int, sums binary"


def _choice_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["level", "m", "node", "n", "g", "h", "input", "goes", "side"])


def _pass(blocks: DataFrame, parts: int, plan: _Plan, depth: int) -> list[list]:
    """The choices of the next level. One partition of blocks needs no exchange, so there the task goes on to the
    levels below at once, with the same sums and choices; the result has one list for each level."""
    blocks = blocks.drop("keys")
    if parts == 1:

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = [b for f in frames for b in f.to_dict("records")]
            for plan.level in range(plan.level, max(depth, 1)):
                held: dict = {}
                for b in mine:
                    _sums(b, plan, held)
                choices = _decided(held, plan)
                yield _choice_frame([(plan.level, *c) for c in choices])
                if not _grow(plan.growing, choices):
                    break

        found = blocks.mapInPandas(whole, f"level int, {_CHOICE}").collect()
        return [[tuple(r)[1:] for r in found if r["level"] == k] for k in sorted({r["level"] for r in found})]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for b in f.to_dict("records"):
                _sums(b, plan, held)
        yield pd.DataFrame([(*k, s.tobytes()) for k, s in held.items()], columns=["m", "node", "sums"])

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        m, node = int(f["m"].iloc[0]), int(f["node"].iloc[0])
        sums = sum(np.frombuffer(s, np.float64) for s in f["sums"])
        return _choice_frame([(plan.level, *c) for c in _decided({(m, node): sums if node < 0 else sums.reshape(len(plan.uses[m]), plan.bins, 3)}, plan)]).drop(columns="level")

    return [[tuple(r) for r in blocks.mapInPandas(add, _PARTIAL).groupBy("m", "node").applyInPandas(pick, _CHOICE).collect()]]


# --- the fit ----------------------------------------------------------------------------------


@dataclass
class Fit:
    """Fitted models and the raw scores that all of them give to all rows."""

    models: list[Ensemble]
    scores: DataFrame  # key, raw array<double>


def fit(
    df: DataFrame, key: str, label: str, inputs: list[str] | None, members: list[Column], uses: list[list[str]] | None = None, loss: str = "poisson",
    rounds: int = 200, rate: float = 0.05, depth: int = 5, min_instances: int = 20, cut_every: int = 10, max_bins: int = 64,
) -> Fit:
    """Fits one model for each of ``members``, a condition on the rows it learns from.

    ``uses``: the inputs of each model, all by default. Bins come from the rows that any model learns from, and from
    their inputs alone. Rows that no model learns from are scored like the others. A null label counts as 0.
    """
    if not 0 < len(members) <= MAX_MODELS:
        raise ValueError(f"between 1 and {MAX_MODELS} models")
    if not 2 <= max_bins <= 256:
        raise ValueError("a bin is one byte")
    s, models = Scratch(df.sparkSession, "learner"), len(members)
    cols, names, category = spread(df, inputs)
    bit = sum((F.when(c, F.lit(1 << m)).otherwise(F.lit(0)).cast("long") for m, c in enumerate(members)), F.lit(0).cast("long"))
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    rows = s.table(df.select(F.col(key).alias("key"), y.alias("y"), bit.alias("member"), *[c.alias(f"x{i}") for i, c in enumerate(cols)]), "rows")
    mine = [F.col("member").bitwiseAND(F.lit(1 << m)) != 0 for m in range(models)]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(c, F.col("y"))).alias(f"m{m}") for m, c in enumerate(mine)]).first()
    means = [stats[f"m{m}"] for m in range(models)]
    if any(v is None for v in means):
        raise ValueError("no rows to fit")
    learned = learn_inputs(rows.where("member <> 0"), names, category, max_bins)
    width = max(len(p.edges) + 1 if not p.category else len(p.values) + 1 for p in learned) if learned else 1
    base = [_base(loss, v) for v in means]
    index = {n: i for i, n in enumerate(names)}
    used = [np.array([index[n] for n in u], np.int64) for u in uses] if uses else [np.arange(len(names))] * models
    blocks, parts = _blocks(rows, stats["n"], stats["n"] * sum(map(len, used)), learned, base, s)
    trees: list[list[Tree]] = [[] for _ in members]
    losses: list[list[float]] = [[] for _ in members]
    recent: list[list[tuple[float, Tree]]] = [[] for _ in members]

    def pass_(growing: list[Tree], level: int, to: int) -> list[list]:
        with small_batches(df.sparkSession):
            found = _pass(blocks, parts, _Plan(loss, width, min_instances, used, np.array(category, bool), recent, growing, level), to)
        for c in found[0]:
            if c[1] < 0:
                losses[c[0]].append(c[3] / c[2])
        return found

    for r in range(rounds):
        if r and r % (cut_every if parts == 1 else min(cut_every, CUT_SPREAD)) == 0:
            blocks = _advance(blocks, parts, models, recent, used, s)
            recent = [[] for _ in members]
        growing, level = [Tree(depth, width) for _ in members], 0
        while level < depth:
            found = pass_(growing, level, depth)
            if not [_grow(growing, choices) for choices in found][-1]:
                break
            level += len(found)
        for m, t in enumerate(growing):
            trees[m].append(t)
            recent[m].append((rate, t))
    pass_([Tree(1, width) for _ in members], 0, 1)  # the loss after the last round
    scores = _score_table(blocks, models, recent, used, df.schema[key].dataType.simpleString(), s)
    blocks.unpersist()
    return Fit([Ensemble(base[m], rate, learned, trees[m], losses[m], inputs is not None) for m in range(models)], scores)


_BLOCK = "n int, x binary, y binary, member binary, f binary"


def _blocks(rows: DataFrame, n: int, cells: int, learned: list[Input], base: list[float], s: Scratch) -> tuple[DataFrame, int]:
    """Blocks of rows with their bins, dealt over as many partitions as their sums take work, and the number that a pass
    reads: no more than the cluster's cores can use, however many rows there are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(max(-(-n // BLOCK_ROWS), -(-cells // PART_CELLS)) if cells > PART_CELLS else 1, PARTS_PER_CORE * cores))
    key = f"{rows.schema['key'].dataType.simpleString()}"

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, w = binned(f, learned).tobytes(), len(learned)
            yield f[["key", "y", "member"]].assign(x=[x[a : a + w] for a in range(0, len(f) * w, w)] if w else b"")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK_ROWS):
                p = f.iloc[a : a + BLOCK_ROWS]
                score = np.tile(np.array(base), (len(p), 1))
                yield pd.DataFrame([(len(p), b"".join(p["x"]), p["y"].to_numpy(np.float64).tobytes(), p["member"].to_numpy(np.int64).tobytes(), score.tobytes(), p["key"].tolist())],
                    columns=["n", "x", "y", "member", "f", "keys"])

    # dealt by a hash of the key: the same rows meet in every run, whatever the source's files. A row moves as its bins
    bins = rows.mapInPandas(small, f"key {key}, y double, member long, x binary")
    dealt = bins.repartition(max(parts, -(-n // DEAL_ROWS)), F.xxhash64("key")) if parts > 1 else bins.coalesce(1)
    table = s.table(dealt.sortWithinPartitions("key").mapInPandas(pack, f"{_BLOCK}, keys array<{key}>"), "blocks", **LARGE_ROWS)
    return _held(table, parts), parts


def _held(table: DataFrame, parts: int) -> DataFrame:
    """Blocks in memory or on local disk; a lost executor's are read again from the written table."""
    return table.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)


def _advance(blocks: DataFrame, parts: int, models: int, recent: list, used: list, s: Scratch) -> DataFrame:
    """The blocks with the scores brought up to date, written anew."""
    plan = _Plan("", 0, 0, used, np.zeros(0, bool), recent, [], 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.copy()
            f["f"] = [_scores(b, models, plan).tobytes() for b in f.to_dict("records")]
            yield f

    with small_batches(s.spark):
        table = s.table(blocks.mapInPandas(run, blocks.schema), "blocks", **LARGE_ROWS)
    blocks.unpersist()
    return _held(table, parts)


def _score_table(blocks: DataFrame, models: int, recent: list, used: list, key: str, s: Scratch) -> DataFrame:
    plan = _Plan("", 0, 0, used, np.zeros(0, bool), recent, [], 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f.to_dict("records"):
                yield pd.DataFrame({"key": list(b["keys"]), "raw": list(_scores(b, models, plan))})

    with small_batches(s.spark):
        return s.table(blocks.mapInPandas(run, f"key {key}, raw array<double>"), "scores")
