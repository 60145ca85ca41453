"""Search for a part of a name through an inverted index of trigrams.

The index has a row for each (trigram, row key), sorted by trigram, so that a filter by trigram reads few row groups.
A term's rows are those that all its trigrams list; they are read by key and looked at again, as a row may hold all
trigrams without the term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text; none for null or shorter texts."""
    t = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(t) - GRAM + 1)
    return F.when(F.length(t) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(GRAM)))))


def write_index(df: DataFrame, key: str, columns: list[str], path: str, files: int = 8) -> None:
    """Index of the trigrams of ``columns``; ``key`` identifies a row."""
    grams = df.select(key, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[trigrams(F.col(c)) for c in columns]))))).alias("gram"))
    # a frequent trigram may fill several files: the key splits its list
    grams.repartitionByRange(files, "gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(path)


def holds(columns: list[str], term: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(F.lit(term.lower())) for c in columns], F.lit(False))


def search_index(spark: SparkSession, path: str, df: DataFrame, key: str, columns: list[str], term: str) -> DataFrame:
    """The rows of ``df`` in which one of ``columns`` holds ``term``, whatever its case.

    Terms of fewer than three characters have no trigram and are looked for in all rows. An empty term is in every
    text that is not null.
    """
    low = term.lower()
    if len(low) < GRAM:
        return df.where(holds(columns, term))
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    lists = spark.read.parquet(path).where(F.col("gram").isin(grams))
    keys = lists.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select(key)
    return df.join(keys, key, "left_semi").where(holds(columns, term))
