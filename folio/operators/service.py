"""Compositions that a client sees: rows, status, progress and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text
from folio.operators import store

#: Keys of a listing's row.
ROW = ["id", "filename", "status", "doc_type", "doc_conf", "recognised", "processing_ms", "created_at"]


def rows(log: DataFrame) -> DataFrame:
    """A listing's rows: no result blob, times as text, positions for what is queued."""
    shown = log.select(*ROW).withColumn("created_at", text.iso_utc(F.col("created_at")))
    return shown.join(store.queue_positions(log), "id", "left")


def status(log: DataFrame) -> DataFrame:
    """The status page's one row: counts of the four statuses, totals and the mean time."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in store.STATUSES]
    one = log.agg(*counts)
    return one.join(store.stats(log))


def waiting_time(queued: DataFrame, mean_s: Column) -> DataFrame:
    """Seconds until a queued record's turn: those before it and itself, by the mean duration."""
    return queued.withColumn("eta", F.bround((F.col("position") + 1) * mean_s, 3))


def colours(labels: DataFrame, n: int = 8) -> DataFrame:
    """A colour number for each of a document's labels: its place among them, modulo n."""
    distinct = labels.select("doc_id", "label").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("label")) - 1
    return distinct.withColumn("colour", (place % n).cast("long"))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's value wins. Nulls count as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def with_default(keys: DataFrame, default: DataFrame) -> DataFrame:
    """Stored keys and the default one, the default first, then by creation."""
    both = default.withColumn("is_default", F.lit(True)).unionByName(keys.withColumn("is_default", F.lit(False)))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.col("is_default").desc(), "created_at", "id")).cast("long"))


def folder_size(files: DataFrame) -> DataFrame:
    """bytes of a binaryFile scan; only the lengths are read."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def width_steps(width: Column, stride: int, bases: list[tuple[int, int]]) -> Column:
    """Steps of a word's width: its residue's base steps, and one for each stride beyond the base
    width; at least 1. ``bases`` has (width, steps) for each residue."""
    out = F.lit(1)
    for residue, (w, steps) in enumerate(bases):
        out = F.when(width % stride == residue, F.lit(steps) + F.floor((width - w) / stride)).otherwise(out)
    return F.greatest(out, F.lit(1)).cast("int")
