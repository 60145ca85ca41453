"""Crash severity classifiers and the experiments around them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.ids import fold_of, is_night
from kerbline.models import margins
from kerbline.models.learner import Ensemble, fit
from kerbline.models.shap import shap_table, shap_values
from kerbline.operators.evaluate import balance, roc_auc
from kerbline.operators.filters import in_years
from kerbline.operators.quality import deployable_columns
from kerbline.operators.segments import f_environment, f_night, f_speed, f_totals
from kerbline.scratch import table

KEY = "collision_id"

# 24 inputs known before a crash: the place, the time, and the segment's history in earlier years
PLACE = ["speed_limit", "road_type", "junction_type", "is_urban", "lighting", "lon", "lat", "chainage", "stretch_m"]
TIME = ["hour", "is_night", "weekday", "month"]
HISTORY = [
    "f_crashes", "f_ksi", "f_fatal", "f_serious", "f_slight", "f_casualties_per_crash", "f_vehicles_per_crash",
    "f_speed_mean", "f_urban_share", "f_unlit_share", "f_night_share",
]
DEPLOYABLE = PLACE + TIME + HISTORY


def value_counts(child: DataFrame, column: str, values: list[str], prefix: str):
    """Per-collision count aggregates of each known value of a child column."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]


def after_crash_columns(vehicle: DataFrame, casualty: DataFrame, vehicle_types: list[str], impacts: list[str], age_step: int = 10) -> DataFrame:
    """Facts that exist only once a crash has happened: people, ages, vehicles, points of impact."""
    steps = range(0, 100, age_step)  # the last band is open
    ages = [F.count_if((F.col("age") >= a) & ((F.col("age") < a + age_step) | F.lit(a == steps[-1]))).alias(f"casualty_age_{a}") for a in steps]
    c = casualty.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("casualty_count"), F.min("age").alias("casualty_age_min"),
        F.max("age").alias("casualty_age_max"), F.avg("age").alias("casualty_age_mean"), *ages,
    )
    both = [
        F.count_if((F.col("vehicle_type") == t) & (F.col("point_of_impact") == p)).alias(f"vehicle_{t}_{p}") for t in vehicle_types for p in impacts
    ]
    v = vehicle.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("vehicle_count"), *value_counts(vehicle, "vehicle_type", vehicle_types, "vehicle_type_"),
        *value_counts(vehicle, "point_of_impact", impacts, "point_of_impact_"), *both,
    )
    return c.join(v, KEY, "full")


def rolling_history(assigned: DataFrame, span: int = 3) -> DataFrame:
    """``segment_id, year`` and the history inputs, from the segment's crashes in the ``span`` years before.

    A crash counts in each of the ``span`` years after it; the counts combine before their shuffle.
    """
    later = assigned.withColumn("_in", F.lit(1)).withColumn("year", F.explode(F.sequence(F.year("occurred_on") + 1, F.year("occurred_on") + span)))
    return later.groupBy("segment_id", "year").agg(*f_totals(), *f_speed(), *f_environment(), *f_night()).select("segment_id", "year", *HISTORY)


def severity_rows(assigned: DataFrame, after: DataFrame | None = None, years: tuple[int, int] | None = None, span: int = 3) -> DataFrame:
    """Crashes with label ``severe`` and inputs: of ``years``, or of every year before which ``span`` years are
    recorded, so that the history inputs mean the same for all.

    A crash's history ends with the year before it, so no crash contributes to its own inputs. A segment without
    a crash in those years has null history.
    """
    if years is None:
        first, last = assigned.agg(F.year(F.min("occurred_on")), F.year(F.max("occurred_on"))).first()
        years = (first + span, last) if first is not None else (2000, 2000)  # no rows, whatever the years
    c = in_years(assigned, *years).select(
        KEY, "segment_id", F.year("occurred_on").alias("year"), (F.col("ksi") > 0).cast("int").alias("severe"), "hour", is_night("hour").alias("is_night"),
        F.dayofweek("occurred_on").alias("weekday"), F.month("occurred_on").alias("month"), *PLACE,
    )
    out = c.join(rolling_history(assigned, span), ["segment_id", "year"], "left").drop("segment_id", "year")
    return out.join(after, KEY, "left") if after is not None else out


def input_columns(df: DataFrame, deployable: bool) -> list[str]:
    cols = [c for c in df.columns if c not in (KEY, "severe", "fold")]
    return deployable_columns(cols) if deployable else cols


@dataclass
class SeverityModel:
    """Boosted classifier that scores a raw table: its inputs are binned as they come."""

    trees: Ensemble

    @property
    def inputs(self) -> list[str]:
        return [p.name for p in self.trees.inputs]

    def score(self, df: DataFrame) -> DataFrame:
        """``collision_id, score`` (log odds) of rows with the inputs."""
        return df.select(KEY, self.trees.raw(df).alias("score"))

    def contributions(self, df: DataFrame) -> DataFrame:
        """SHAP values in long form (collision_id, feature, value), for ``factor_ranking``."""
        return shap_table(shap_values(self.trees, df, KEY), KEY, self.inputs)

    def save(self, path: str) -> None:
        self.trees.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SeverityModel:
        return cls(Ensemble.load(spark, path))


#: Learning rate and least rows of a leaf of the boosted classifiers.
BOOST = {"loss": "logistic", "rate": 0.1, "min_instances": 20}


def fit_severity(df: DataFrame, inputs: list[str], rounds: int = 20, depth: int = 5) -> SeverityModel:
    """The boosted model, fitted on all rows."""
    return SeverityModel(fit(df, KEY, "severe", inputs, [F.lit(True)], rounds=rounds, depth=depth, **BOOST).models[0])


def boosted(rows: DataFrame, input_sets: list[list[str]], k: int, rounds: int, depth: int) -> DataFrame:
    """``collision_id, severe, raw``: for each input set the score of a model that never saw the row's fold.

    ``rows`` has ``fold``. All sets and folds grow in the same passes.
    """
    every = list(dict.fromkeys(c for inputs in input_sets for c in inputs))
    members = [F.col("fold") != i for _ in input_sets for i in range(k)]
    uses = [inputs for inputs in input_sets for _ in range(k)]
    f = fit(rows, KEY, "severe", every, members, uses, rounds=rounds, depth=depth, **BOOST)
    own = F.array(*[F.get("raw", F.lit(v * k) + F.col("fold")) for v in range(len(input_sets))])
    return table(f.scores.withColumnRenamed("key", KEY).join(rows.select(KEY, "severe", "fold"), KEY).select(KEY, "severe", own.alias("raw")), "boosted")


def _folded(df: DataFrame, inputs: list[str], k: int) -> DataFrame:
    return table(df.select(KEY, "severe", *inputs).withColumn("fold", fold_of(KEY, k)), "rows")


def _aucs(df: DataFrame, input_sets: list[list[str]], k: int, rounds: int, depth: int) -> list[float | None]:
    """Held-out ROC-AUC of each input set."""
    every = list(dict.fromkeys(c for inputs in input_sets for c in inputs))
    scored = boosted(_folded(df, every, k), input_sets, k, rounds, depth)
    return [_auc(scored.select("severe", F.get("raw", F.lit(v)).alias("score"))) for v in range(len(input_sets))]


def held_out(df: DataFrame, inputs: list[str], kind: str, k: int = 5, steps: int = 100) -> DataFrame:
    """Scores of every row by a linear SVM or a neural net that saw neither its fold nor, in preparing the inputs, any
    of its rows. ``steps``: the most iterations of their optimizers."""
    scored = margins.held_out(_folded(df, inputs, k), KEY, "severe", inputs, [kind], k, steps)
    return scored.withColumnRenamed(kind, "score")


def _auc(df: DataFrame) -> float | None:
    return roc_auc(df, "score", "severe").first()["auc"]


def severity_report(df: DataFrame, k: int = 5, rounds: int = 20, depth: int = 5) -> DataFrame:
    """Deployable against explanatory inputs: number of inputs and held-out ROC-AUC."""
    sets = [input_columns(df, deployable) for deployable in (True, False)]
    found = _aucs(df, sets, k, rounds, depth)
    out = [(name, len(inputs), name == "deployable", auc) for name, inputs, auc in zip(("deployable", "explanatory"), sets, found, strict=True)]
    return df.sparkSession.createDataFrame(out, "model string, inputs int, deployable boolean, auc double")


def compare_models(df: DataFrame, inputs: list[str], k: int = 5, rounds: int = 20, depth: int = 5, steps: int = 100) -> DataFrame:
    """Held-out ROC-AUC of boosted trees, a linear SVM and a neural net; the last two descend side by side."""
    folded, kinds = _folded(df, inputs, k), ["svm", "neural_net"]
    trees = boosted(folded, [inputs], k, rounds, depth).select("severe", F.get("raw", F.lit(0)).alias("score"))
    others = margins.held_out(folded, KEY, "severe", inputs, kinds, k, steps)
    out = [("boosting", _auc(trees))] + [(kind, _auc(others.select("severe", F.col(kind).alias("score")))) for kind in kinds]
    return df.sparkSession.createDataFrame(out, "model string, auc double")


def ablate(df: DataFrame, base: list[str], group_a: list[str], group_b: list[str], k: int = 5, rounds: int = 20, depth: int = 5) -> DataFrame:
    """All four combinations of two input groups on top of ``base``, grown side by side."""
    cases = [(a, b) for a in (False, True) for b in (False, True)]
    sets = [base + (group_a if a else []) + (group_b if b else []) for a, b in cases]
    out = [(a, b, len(inputs), auc) for (a, b), inputs, auc in zip(cases, sets, _aucs(df, sets, k, rounds, depth), strict=True)]
    return df.sparkSession.createDataFrame(out, "with_a boolean, with_b boolean, inputs int, auc double")


def protocol_experiment(df: DataFrame, inputs: list[str], k: int = 5, rounds: int = 20, depth: int = 5) -> DataFrame:
    """The same model, with classes balanced before or only after the split; every fold is scored.

    Both protocols grow in the same passes: a row's memberships say which of the models learn from it.
    """
    rows = _folded(df, inputs, k)
    small = rows.select(KEY, "severe", "fold")
    drawn = [balance(small, "severe", KEY)] + [balance(small.where(F.col("fold") != i), "severe", KEY) for i in range(k)]
    bits = reduce(DataFrame.unionByName, [d.select(KEY, F.lit(1 << i).cast("long").alias("bit")) for i, d in enumerate(drawn)])
    bits = bits.groupBy(KEY).agg(F.sum("bit").alias("bits"))
    rows = table(rows.join(bits, KEY, "left").fillna(0, ["bits"]), "drawn")
    has = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    f = fit(rows, KEY, "severe", inputs, [has(0) & (F.col("fold") != i) for i in range(k)] + [has(1 + i) for i in range(k)], rounds=rounds, depth=depth, **BOOST)
    scores = table(f.scores.withColumnRenamed("key", KEY).join(rows.select(KEY, "severe", "fold", "bits"), KEY), "scored")
    out = []
    for name, at, kept in (("balance_then_split", 0, has(0)), ("split_then_balance", k, F.lit(True))):
        scored = scores.where(kept).select("severe", F.get("raw", F.lit(at) + F.col("fold")).alias("score"))
        said, true = F.col("score") > 0, F.col("severe") == 1
        m = scored.agg(
            F.count(F.lit(1)).alias("n"), (2.0 * F.count_if(said & true) / F.nullif(F.count_if(said) + F.count_if(true), F.lit(0).cast("long"))).alias("f1")
        ).first()
        out.append((name, m["n"], m["f1"], _auc(scored)))
    return df.sparkSession.createDataFrame(out, "protocol string, test_rows long, f1 double, auc double")
