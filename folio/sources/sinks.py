"""Sinks: record tables, stage dumps, reports and benchmark series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.evaluate import mean_of_means
from folio.operators.store import upsert


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


class Table:
    """A Parquet table of versions: a write makes a new one and then moves the pointer, so
    readers see the old rows or the new ones, never a part. One writer at a time; old versions stay
    for those who still read them until ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _pointer(self) -> int:
        if not _exists(self.spark, f"{self.path}/current"):
            return 0
        rows = self.spark.read.text(f"{self.path}/current").collect()
        return max(int(r[0]) for r in rows) if rows else 0

    def read(self) -> DataFrame | None:
        now = self._pointer()
        return self.spark.read.parquet(f"{self.path}/v{now}") if now else None

    def replace(self, rows: DataFrame) -> None:
        after = self._pointer() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{after}")
        self.spark.createDataFrame([(str(after),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")

    def put(self, rows: DataFrame, keep: str = "result") -> None:
        """B2: upsert; a record without a result doesn't clear the one stored."""
        old = self.read()
        self.replace(rows if old is None else upsert(old, rows.select(*old.columns), self.key, keep))

    def drop(self, ids: DataFrame) -> None:
        """B4."""
        old = self.read()
        if old is not None:
            self.replace(old.join(ids.select(self.key), self.key, "left_anti"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions (1 at least) and give the number deleted."""
        last = self._pointer() - max(keep, 1)
        fs, p = _at(self.spark, self.path)
        found = [f.getPath() for f in fs.listStatus(p)] if last > 0 else []
        old = [f for f in found if f.getName()[:1] == "v" and f.getName()[1:].isdigit() and int(f.getName()[1:]) <= last]
        return sum(fs.delete(f, True) for f in old)


def save_result(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records with what a listing shows of their results: (id, view) joined and flattened."""
    v = results.select(
        "id",
        F.col("view.doc_type").alias("doc_type"),
        F.col("view.recognised").alias("recognised"),
        F.coalesce(F.size("view.fields"), F.lit(0)).alias("field_count"),
        F.col("view.canvas.width").alias("canvas_w"),
        F.col("view.canvas.height").alias("canvas_h"),
    )
    return records.drop(*[c for c in v.columns if c != "id"]).join(v, "id", "left")


def stage_dump(stages: list[tuple[str, DataFrame]], path: str, upto: str | None = None) -> list[str]:
    """Each stage's rows under its place and name, up to a stage and with it; gives the stages written."""
    done = []
    for i, (name, df) in enumerate(stages):
        df.write.mode("overwrite").parquet(f"{path}/{i:02d}-{name}")
        done.append(name)
        if name == upto:
            break
    return done


def append_benchmark(spark: SparkSession, path: str, new: DataFrame, key: str, value: str) -> DataFrame:
    """A benchmark series with a run added: means of the old row and the new, as CSV."""
    old = spark.read.option("header", True).schema(f"{key} string, {value} double").csv(path) if _exists(spark, path) else None
    rows = new.select(F.col(key).cast("string").alias(key), F.col(value).cast("double").alias(value))
    # Small by contract, one row for each type: gathered before what it is read from is overwritten.
    made = (mean_of_means(old, rows, key, value) if old is not None else mean_of_means(rows, rows, key, value)).toArrow()
    out = spark.createDataFrame(made)
    # Written whole beside the old series, then moved in its place: a run that fails leaves the old one.
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    out.coalesce(1).write.option("header", True).csv(beside)
    fs, p = _at(spark, path)
    fs.delete(p, True)
    if not fs.rename(_at(spark, beside)[1], p):
        raise OSError(f"cannot move {beside} to {path}")
    return out


def report(summary: DataFrame, path: str) -> None:
    """A conformance report as JSON lines, nulls included."""
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(path)
