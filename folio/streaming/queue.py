"""The job queue as a stream: claiming, retrying, running means and bounded logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files of one table in a folder as a stream; the schema is that of what lies there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def outcome(jobs: DataFrame, max_retries: int) -> DataFrame:
    """L2, L3: what becomes of claimed jobs (id, retry_count, error, transient): done, queued again or failed."""
    again = F.col("transient") & (F.col("retry_count") < max_retries)
    status = F.when(F.col("error").isNull(), "done").when(again, "queued").otherwise("failed")
    return jobs.withColumn("status", status).withColumn("retry_count", F.col("retry_count") + (status == "queued").cast("int"))


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Each micro-batch of queued jobs is worked off and written under its batch number.

    A batch that is run again after a crash overwrites what it had written, so a job's outcome is
    seen once. Without ``seconds`` all that is there is worked off and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def running_means(stream: DataFrame, key: str, value: str, seed: float = 0.6, keep: float = 0.7, least: float = 0.05) -> DataFrame:
    """The exponential mean of each key's durations as a stream's state; one row for each key and batch."""
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("ema", T.DoubleType()), T.StructField("n", T.LongType())])
    state = T.StructType([T.StructField("ema", T.DoubleType()), T.StructField("n", T.LongType())])

    def update(k: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = s.get if s.exists else (seed, 0)
        for pdf in batches:
            for v in pdf.sort_values("ts")[value]:
                ema, n = ema * keep + max(v, least) * (1 - keep), n + 1
        s.update((ema, n))
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)


def status_counts(stream: DataFrame, status: str = "status") -> DataFrame:
    """F1 over a stream: rows of each status so far."""
    return stream.groupBy(status).agg(F.count("*").alias("n"))


def frames_per_second(stream: DataFrame, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Frames of each whole second. Extension: a window with a watermark stands for a counter
    that is reset whenever a second has gone by."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("second")).agg(F.count("*").alias("frames"))
