"""Inputs learned from child tables: one for each category, and each pair of categories of a row, that is frequent enough.

Two passes. The first counts, for all folds in one aggregation, in how many crashes a term occurs; what the
crashes outside a fold hold often enough is the vocabulary of the models that never see that fold. The second turns a
crash's children into sparse counts over a vocabulary. A vocabulary is kept as a table beside its model, so that a
later crash meets the same inputs, and terms that training never saw are left out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.ids import fold_of

KEY = "collision_id"
#: Most rows, on average, that one task groups by crash.
TASK_ROWS = 1 << 20


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt by crash over as many tasks as grouping ``rows`` rows needs.

    Sized by the bytes that they read, narrow rows would fill a task with many times its memory in groups, and it
    would spill. Callers count a table once more for it; a written table knows its count.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), KEY)


def terms(child: DataFrame, columns: dict[str, str | Column], prefix: str) -> DataFrame:
    """``collision_id, term, n``: how many of a crash's child rows have a category, or a pair of categories.

    ``columns`` are named categories. A null category makes no term, alone or in a pair.
    """
    columns = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
    held = {name: F.col(f"c_{name}") for name in columns}
    single = [F.concat(F.lit(f"{prefix}.{name}="), c.cast("string")) for name, c in held.items()]
    named = dict(zip(columns, single, strict=True))
    pairs = [F.concat(named[a], F.lit("&"), F.lit(f"{b}="), held[b].cast("string")) for a, b in combinations(columns, 2)]
    rows = child.select(KEY, *[c.alias(f"c_{name}") for name, c in columns.items()])
    rows = _dealt(rows, child.count() * (len(single) + len(pairs)))
    found = rows.select(KEY, F.explode(F.array(*single, *pairs)).alias("term")).where("term IS NOT NULL")
    return found.groupBy(KEY, "term").agg(F.count(F.lit(1)).alias("n"))


def learn(counted: DataFrame, crashes: DataFrame, k: int = 5, least: int = 20) -> DataFrame:
    """``fold, term, crashes, position``: for each fold the terms that at least ``least`` crashes outside it hold.

    ``crashes`` (collision_id) are those that may be learned from. ``position`` counts from 0 in the order of the
    terms. Terms combine on the map side before their shuffle; a term's count per fold stays in one row, so the folds cost no
    further pass. A fold -1 holds the vocabulary of all crashes, for the deployed model.
    """
    seen = counted.join(crashes.select(KEY).distinct(), KEY, "left_semi").withColumn("fold", fold_of(KEY, k))
    inside = [F.count_if(F.col("fold") == i).alias(f"_{i}") for i in range(k)]
    per_term = seen.groupBy("term").agg(F.count(F.lit(1)).alias("every"), *inside)
    outside = [F.struct(F.lit(i).alias("fold"), (F.col("every") - F.col(f"_{i}")).alias("crashes")) for i in range(k)]
    outside.append(F.struct(F.lit(-1).alias("fold"), F.col("every").alias("crashes")))
    kept = per_term.select("term", F.inline(F.array(*outside))).where(F.col("crashes") >= least)
    # a row per frequent category from here on: their number is that of the categories, not of the crashes
    order = F.transform(F.sort_array(F.collect_list(F.struct("term", "crashes"))), lambda t, i: F.struct(t["term"].alias("term"), t["crashes"].alias("crashes"), i.alias("position")))
    return kept.groupBy("fold").agg(order.alias("t")).select("fold", F.inline("t")).select("fold", "term", "crashes", "position")


def of_fold(vocabulary: DataFrame, fold: int = -1) -> DataFrame:
    return vocabulary.where(F.col("fold") == fold).select("term", "position")


def sparse(counted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``collision_id, indices, counts``: the terms of a crash that ``vocabulary`` (term, position) has, by position.

    A crash with none of them has no row.
    """
    met = counted.join(vocabulary, "term").select(KEY, "position", "n")
    v = _dealt(met, counted.count()).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("position", "n"))).alias("v"))
    return v.select(KEY, F.col("v.position").alias("indices"), F.col("v.n").alias("counts"))


def inputs(vocabulary: DataFrame) -> list[str]:
    """Names of the inputs by position: terms as column names."""
    rows = vocabulary.select("term", "position").collect()
    return [r["term"].replace(".", "_") for r in sorted(rows, key=lambda r: r["position"])]


def with_inputs(rows: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` and one count for each name; 0 for terms a crash does not have. The learner bins them, one byte each."""
    at = F.map_from_arrays("indices", "counts")
    met = rows.join(vectors.select(KEY, at.alias("_at")), KEY, "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("_at")[F.lit(i)], F.lit(0)).cast("double").alias(n) for i, n in enumerate(names)])


def save(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("errorifexists").parquet(path)
