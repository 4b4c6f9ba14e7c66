"""Evaluation: predictions against ground truth, timings and benchmark means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text

#: Key of an external label, the field it means, and how the two are compared.
EXTERNAL_FIELDS = [
    ("surname", "Last_name_ru", "text"),
    ("name", "First_name_ru", "text"),
    ("middle_name", "Middle_name_ru", "text"),
    ("birth_date", "Birth_date", "number"),
    ("birth_place", "Birth_place_ru", "text"),
    ("gender", "Sex_ru", "gender"),
    ("issue_date", "Issue_date", "number"),
    ("issued_by", "Issue_organization_ru", "text"),
    ("subdivision", "Issue_organisation_code", "number"),
    ("number", "Licence_number", "number"),
]


def paired(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Every truth row with its prediction, empty where there is none."""
    joined = truth.join(predicted, keys, "left")
    return joined.withColumn("predicted", F.coalesce("predicted", F.lit("")))


def scored(pairs: DataFrame, kind: str = "strict") -> DataFrame:
    """Error rate and quality of each row with a truth to compare with."""
    cer = text.cer(F.col("predicted"), F.col("truth"), kind)
    out = pairs.withColumn("cer", cer).where("cer is not null")
    return out.withColumn("quality", text.field_quality(F.col("predicted"), F.col("truth"), kind))


def accuracy(scored_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, exact ones, mean error rate and share of exact rows, overall or by columns."""
    n, exact = F.count("*"), F.count_if(F.col("cer") == 0)
    grouped = scored_rows.groupBy(*by) if by else scored_rows
    return grouped.agg(
        n.alias("n"),
        exact.alias("exact"),
        F.bround(F.coalesce(F.avg("cer"), F.lit(0.0)), 6).alias("mean_cer"),
        F.bround(F.when(n > 0, exact / n).otherwise(0.0), 6).alias("exact_rate"),
    )


def external_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, key, value) rows to fields and kinds; unlabelled ones ('-') and unknown keys go."""
    spark = labels.sparkSession
    names = spark.createDataFrame(EXTERNAL_FIELDS, "key string, field string, kind string")
    return labels.where(F.col("value") != "-").join(F.broadcast(names), "key").select("doc_id", "field", "kind", "value")


def stage_means(timings: DataFrame) -> DataFrame:
    """mean time of each stage by base type, and its share of the type's mean total."""
    means = timings.groupBy("base", "stage").agg(F.avg("ms").alias("mean_ms"), F.count("*").alias("n"))
    total = F.sum("mean_ms").over(Window.partitionBy("base"))
    return means.select("base", "stage", "n", F.bround("mean_ms", 4).alias("mean_ms"), F.bround(F.col("mean_ms") / total, 6).alias("share"))


def timing_totals(timings: DataFrame, key: str = "doc_id") -> DataFrame:
    """a document's total: members that ran concurrently count as the longest of them, once."""
    alone = F.coalesce(F.sum(F.when(~F.col("concurrent"), F.col("ms"))), F.lit(0))
    group = F.coalesce(F.max(F.when(F.col("concurrent"), F.col("ms"))), F.lit(0))
    return timings.groupBy(key).agg((alone + group).alias("total_ms"))


def mean_of_means(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """A new benchmark row averaged with the old of its key: a mean of means, to 3 places."""
    both = old.select(key, value).unionByName(new.select(key, value))
    return both.groupBy(key).agg(F.bround(F.avg(value), 3).alias(value))


def slowest(timings: DataFrame, key: str, k: int = 4) -> DataFrame:
    """The k slowest stages of each key but the total, ties by name."""
    order = Window.partitionBy(key).orderBy(F.col("ms").desc(), "stage")
    ranked = timings.where(F.col("stage") != "total").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k)


def moving_average(durations: DataFrame, key: str, value: str, order: list[str], seed: float = 0.6, keep: float = 0.7, least: float = 0.05) -> DataFrame:
    """(key, ema, n): exponential mean of each key's durations in order, from a seed, each at least ``least``.

    A run of n values turns a mean m into m * keep^n + s, and runs compose. So rows are dealt by ranges of
    (key, order), each range gives its runs' n and s, and only these are folded: a key with a third of all rows is
    spread over many tasks. Null durations are passed over; a null key is a key; ``keep`` of 0 leaves the last
    value, of 1 the seed.
    """
    rows = durations.where(F.col(value).isNotNull()).repartitionByRange(F.col(key), *[F.col(c) for c in order])
    rows = rows.withColumn("__range", F.spark_partition_id())
    later = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*[F.col(c).desc() for c in order])) - 1
    term = F.greatest(F.col(value), F.lit(least)) * (1 - keep) * F.pow(F.lit(float(keep)), "__later")
    runs = rows.withColumn("__later", later).groupBy(key, "__range").agg(F.count("*").alias("n"), F.sum(term).alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("__range", "n", "s")))
    fold = F.aggregate(parts, F.lit(float(seed)), lambda m, x: m * F.pow(F.lit(float(keep)), x["n"]) + x["s"])
    return runs.groupBy(key).agg(F.bround(fold, 9).alias("ema"), F.sum("n").alias("n"))


def matched(found: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Each true box's best overlap with the found ones of its group, and whether it is enough."""
    from folio.functions.geometry import iou

    f, t = found.alias("f"), truth.alias("t")
    on = [F.col(f"f.{k}") == F.col(f"t.{k}") for k in keys]
    overlap = iou([F.col(f"f.{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"t.{c}") for c in ("x1", "y1", "x2", "y2")])
    best = t.join(f, on, "left").groupBy(*[F.col(f"t.{k}") for k in keys], F.col("t.idx")).agg(F.coalesce(F.max(overlap), F.lit(0.0)).alias("best"))
    return best.withColumn("hit", F.col("best") >= least)


def any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def engine_table(results: DataFrame, engines: list[str]) -> DataFrame:
    """(doc_id, engine, field, text) as one row for each field that any engine read, a column for each engine."""
    return results.groupBy("doc_id", "field").pivot("engine", engines).agg(F.max("text"))


def suspicious_by_engine(results: DataFrame, engines: list[str]) -> DataFrame:
    """(engine, suspicious, fields): of all fields that any engine read, how many each read suspiciously or not."""
    table = engine_table(results, engines)
    counts = [F.struct(F.lit(e).alias("engine"), F.count_if(text.suspicious(F.col(e))).alias("suspicious"), F.count("*").alias("fields")) for e in engines]
    return table.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def concurrent_members(timings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stages that ran beside others in each document, as a set in order."""
    return timings.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("concurrent"), F.col("stage")))).alias("members"))
