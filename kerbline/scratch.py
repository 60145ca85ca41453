"""Cutting lineage by writing a table to the shared scratch folder and reading it back.

Iterative jobs (spanning forest, list ranking, boosting) must cut their plans between rounds.
A table on shared storage survives the loss of any executor and gives the next round a fresh,
small plan with true size statistics.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tables of large rows: a file's pages and groups end by their size, not after a hundred rows, which a writer and
#: each reader would hold at once.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}

#: Bytes that a task in Python is sent at once from such tables.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

_local_root: dict[str, str] = {}
_folders: list[str] = []  # of all scratch tables this driver wrote and has not removed


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="kerbline-", dir="/tmp")
    return _local_root[app]


class Scratch:
    """A private sub-folder of the scratch root, with tables that can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _folders.append(self.folder)
        self._n = 0

    def table(self, df: DataFrame, tag: str = "t", **options: str) -> DataFrame:
        """Write ``df`` and read it back; ``options`` are the writer's."""
        path = f"{self.folder}/{self._n:04d}-{tag}"
        self._n += 1
        df.write.options(**options).mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def keep(self, df: DataFrame, tag: str = "t", **metrics: Column) -> tuple[DataFrame, dict]:
        """``table`` plus the row count and other aggregates of the written table."""
        back = self.table(df, tag)
        found = back.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).first()
        return back, found.asDict()

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables this object wrote, once nothing reads them any more."""
        for t in tables:
            path = getattr(t, "_scratch_path", None) if t is not None else None
            if path and path.startswith(self.folder):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, also after a failure, the scratch tables that were written inside it.

    Results are DataFrames that still read those tables, so whatever is to outlast the job is written inside
    it. Jobs may be nested, but not run side by side in threads: the first to end would remove the other's tables.
    """
    start = len(_folders)
    try:
        yield
    finally:
        done = _folders[start:]
        del _folders[start:]
        for folder in done:
            _delete(spark, folder)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries run inside it send large rows to Python a few at a time: a batch is held by Spark and by its worker."""
    before = spark.conf.get(_BATCH[0], None)
    spark.conf.set(*_BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH[0]) if before is None else spark.conf.set(_BATCH[0], before)


def table(df: DataFrame, tag: str = "t") -> DataFrame:
    """One-off: write ``df`` to its own scratch folder and read it back."""
    return Scratch(df.sparkSession, tag).table(df, tag)
