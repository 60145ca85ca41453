"""Segment, route, summary and metadata tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import curve
from kerbline.operators.ranks import top_segments
from kerbline.schemas import ROUTE, SEGMENT


def read_segments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(SEGMENT)
    if fmt == "csv":
        return reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return reader.parquet(path)


def write_segments(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Ranked segments. Sorted by place, so that a box query reads few row groups."""
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in SEGMENT.fields])
    if fmt == "csv":
        out.orderBy("rank").write.mode("overwrite").option("header", True).csv(path)
    else:
        out.orderBy("lat", "lon", "segment_id").write.mode("overwrite").parquet(path)


def write_top_json(df: DataFrame, path: str, n: int = 500) -> None:
    top_segments(df, n).write.mode("overwrite").json(path)


def write_metadata(df: DataFrame, params: dict[str, object], path: str) -> None:
    """Run parameters and row counts, one JSON row."""
    meta = df.agg(F.count(F.lit(1)).alias("segments"), F.sum("n_crashes").alias("collisions"), F.max("score").alias("top_score"))
    fixed = F.create_map(*[F.lit(str(x)) for kv in sorted(params.items()) for x in kv])
    meta.withColumn("parameters", fixed).withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(path)


def publish(df: DataFrame, table: str | None = None, *, jdbc_url: str | None = None, properties: dict | None = None) -> None:
    """Replace the published segments; running it again gives the same table.

    A JDBC target is truncated, not dropped, so its indexes and grants stay.
    """
    if jdbc_url is None:
        df.write.mode("overwrite").format("parquet").saveAsTable(table)
    else:
        df.write.mode("overwrite").option("truncate", True).jdbc(jdbc_url, table, properties=properties or {})


def read_routes(spark: SparkSession, path: str, fmt: str = "json", pairs: bool = False) -> DataFrame:
    """Candidate routes. ``pairs``: points are ``[lon, lat]`` arrays, as clients send them, instead of structs; a point
    that is not two numbers becomes null, which the route checks refuse."""
    schema = ROUTE
    if pairs:
        schema = T.StructType([T.StructField(f.name, T.ArrayType(T.ArrayType(T.DoubleType())), True) if f.name == "path" else f for f in ROUTE.fields])
    reader = spark.read.schema(schema)
    df = reader.json(path) if fmt == "json" else reader.parquet(path)
    if not pairs:
        return df
    point = lambda p: F.when(F.size(p) == 2, F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return df.withColumn("path", F.transform("path", point))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


# --- curve-ordered store ----------------------------------------------------------------------


def write_curve(df: DataFrame, path: str, files: int = 16, row_group_bytes: int = 1 << 20) -> None:
    """Rows with ``lon, lat`` in order of the curve, ``_key`` beside them: each file and row group is a small area.

    Rows without a place have no key, come first and are in no box.
    """
    keyed = df.withColumn("_key", curve.curve_key("lon", "lat"))
    keyed.repartitionByRange(files, F.asc_nulls_first("_key")).sortWithinPartitions(F.asc_nulls_first("_key")).write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def read_box(spark: SparkSession, path: str, box: curve.Box) -> DataFrame:
    """Rows of a curve-ordered store within a box (west, south, east, north), ends included."""
    west, south, east, north = box
    near = spark.read.parquet(path).where(curve.in_ranges("_key", curve.box_ranges(box)))
    return near.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).drop("_key")


def read_near(spark: SparkSession, path: str, points: list[tuple[float, float]], margin_m: float) -> DataFrame:
    """Rows that may lie within a margin of a path: the candidates of a corridor, by a few ranges of keys."""
    boxes = curve.path_boxes(points, margin_m)
    ranges = curve.joined([r for b in boxes for r in curve.box_ranges(b, 8)], 64)
    return spark.read.parquet(path).where(curve.in_ranges("_key", ranges)).drop("_key")


# --- versions ---------------------------------------------------------------------------------


class Versions:
    """Published snapshots under one folder, of which a pointer file names the current one.

    A snapshot is written to a folder of its own, named after its content, read back and compared with what was to be
    published; only then is the pointer replaced, by one rename. Readers therefore see the old or the new snapshot and
    never a part of one, and a load that fails changes nothing for them. Publishing the same rows again finds their
    snapshot there. ``keep`` older snapshots stay, for readers that are still at work and for ``rollback``.
    """

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def fingerprint(df: DataFrame) -> tuple[int, str]:
        """Rows and an order-free checksum of all columns."""
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        halves = [F.sum(F.shiftrightunsigned(h, n).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")) for n in (0, 32)]
        r = df.agg(F.count(F.lit(1)).alias("n"), *[c.cast("string").alias(f"h{i}") for i, c in enumerate(halves)]).first()
        return r["n"], f"{r['n']}-{r['h0'] or 0}-{r['h1'] or 0}"

    def history(self) -> list[str]:
        """Names of the snapshots that were current, the present one last."""
        p = self._path(f"{self.folder}/{self.POINTER}")
        if not self._fs.exists(p):
            return []
        return self.spark.read.text(f"{self.folder}/{self.POINTER}").first()[0].split(",")

    def _point(self, names: list[str]) -> None:
        fresh = self._path(f"{self.folder}/.{self.POINTER}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(",".join(names).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        replace = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        replace[0] = hadoop.Options.Rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(f"{self.folder}/{self.POINTER}")), replace)

    def publish(self, df: DataFrame) -> str:
        """Make ``df`` the current snapshot and return its name; nothing changes if anything fails before the switch."""
        staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        written = self.spark.read.parquet(staged)
        n, name = self.fingerprint(written)
        place = self._path(f"{self.folder}/v-{name}")
        if (n, name) != self.fingerprint(df):
            raise RuntimeError(f"{self.folder}: the rows written are not the rows given")
        if self._fs.exists(place):
            self._fs.delete(self._path(staged), True)
        elif not self._fs.rename(self._path(staged), place):
            raise RuntimeError(f"{self.folder}: the snapshot could not be put in place")
        before = [v for v in self.history() if v != name]
        self._point([*before[-self.keep :], name])
        for old in before[: -self.keep]:
            self._fs.delete(self._path(f"{self.folder}/v-{old}"), True)
        return name

    def read(self) -> DataFrame:
        names = self.history()
        if not names:
            raise FileNotFoundError(f"nothing published in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v-{names[-1]}")

    def rollback(self) -> str:
        """Make the snapshot before the current one current again."""
        names = self.history()
        if len(names) < 2:
            raise ValueError("no earlier snapshot")
        self._point(names[:-1])
        return names[-2]
