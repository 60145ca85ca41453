"""The three crash record files (collision, vehicle, casualty)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.schemas import KINDS


def read_crash_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read one kind with its fixed schema; unreadable rows keep their text in ``_corrupt``.

    A header that names other columns, or the same in another order, is an error and not misread by position.
    """
    schema = T.StructType([*KINDS[kind].fields, T.StructField("_corrupt", T.StringType())])
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    )


def store_by_year(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year, so year windows skip whole folders.

    Rows go to each year's folder from wherever they are: repartitioning by year would send a year
    with most of the rows to one task.
    """
    df.withColumn("year", F.year("occurred_on")).write.mode("overwrite").partitionBy("year").parquet(path)


def read_store(spark: SparkSession, path: str, kind: str, years: tuple[int, int] | None = None) -> DataFrame:
    schema = KINDS[kind]
    if kind == "collision":
        schema = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    df = spark.read.schema(schema).parquet(path)
    return df.where(F.col("year").between(*years)) if years else df
