"""Sources: sample trees, ground truth, labels, record stores, tables and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sample images' endings.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".PNG", ".JPG")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def sample_images(spark: SparkSession, root: str) -> DataFrame:
    """(doctype, stem, path, length, content) of the images below a tree of type folders.

    Only path and length are read unless the content is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.where(F.regexp_extract("path", r"(\.[^.]+)$", 1).isin(*IMAGE_ENDINGS))
    return found.select(_folder(F.col("path")).alias("doctype"), _stem(F.col("path")).alias("stem"), "path", "length", "content")


def ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """(doctype, stem, field, truth) of JSON files with free keys; what isn't an object of texts
    gives one row with a null field; empty truths can't be evaluated and stay out."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parsed = text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    rows = parsed.select("path", F.explode_outer("m").alias("field", "truth"))
    kept = rows.where(F.col("field").isNull() | (F.coalesce("truth", F.lit("")) != ""))
    return kept.select(_folder(F.col("path")).alias("doctype"), _stem(F.col("path")).alias("stem"), "field", "truth")


def external_labels(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, key, value, confidence) of text files that hold {key: [value, confidence]}."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    parsed = text.select(_stem(F.col("_metadata.file_path")).alias("doc_id"), F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = parsed.select("doc_id", F.explode("m").alias("key", "pair"))
    return rows.select("doc_id", "key", F.get("pair", 0).alias("value"), F.get("pair", 1).try_cast("double").alias("confidence"))


def yolo_labels(spark: SparkSession, root: str) -> DataFrame:
    """(stem, cls, cx, cy, w, h) of label lines, in shares of the image; other lines are passed over."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(_stem(F.col("_metadata.file_path")).alias("stem"), parts.alias("p")).where(F.size("p") == 5)
    numbers = [F.get("p", i).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)]
    return rows.select("stem", F.get("p", 0).try_cast("int").alias("cls"), *numbers).where("cls is not null and h is not null")


def record_store(spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The records of a folder of JSON files, and what is corrupt, as text; it never fails a read."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", with_bad, options).alias("r"))
    good = parsed.where("r._corrupt is null").select(*[F.col(f"r.{f.name}") for f in schema.fields])
    return good, parsed.where("r._corrupt is not null").select("path", F.col("r._corrupt").alias("text"))


def sql_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A10: a table over JDBC, read in ``parts`` ranges of a key where it is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def results_of(results: DataFrame, ids: DataFrame) -> DataFrame:
    """The large results of some records only."""
    return results.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi") if ids.isLocal() else results.join(ids.select("id").distinct(), "id", "left_semi")


def centroids(spark: SparkSession, path: str) -> list[tuple[str, list[float], float]]:
    """The centroid table (label, center, max_distance), small by contract, in the file's order."""
    rows = spark.read.parquet(path).select("label", "center", "max_distance").collect()
    return [(r["label"], [float(x) for x in r["center"]], float(r["max_distance"])) for r in rows]


def alphabet(table: dict[str, dict[str, str]], engine: str) -> list[str]:
    """The characters an engine may give; an unknown engine is an error."""
    if engine not in table:
        raise KeyError(f"no alphabet for {engine}")
    return list(dict.fromkeys(table[engine]["letters"] + table[engine]["specials"]))


def seed(spark: SparkSession, manifest: str, store: DataFrame) -> DataFrame:
    """The manifest's records, if the store is empty; else none."""
    rows = spark.read.option("multiLine", True).json(manifest)
    return rows if store.isEmpty() else rows.limit(0)


def cases(spark: SparkSession, manifest: str, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases by slug, those that hold a text, and as many as asked for."""
    rows = spark.read.option("multiLine", True).json(manifest)
    if search:
        rows = rows.where(F.lower("slug").contains(search.lower()))
    rows = rows.orderBy("slug")
    return rows.limit(limit) if limit is not None else rows


def cycles(files: DataFrame, n: int) -> DataFrame:
    """Each file n times, numbered."""
    return files.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
