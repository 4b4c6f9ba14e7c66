"""Conformance: what differs between golden and actual records, within stated tolerances."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Leaves that are coordinates, scores or identifiers, and each profile's tolerances.
COORDINATES = ["x1", "y1", "x2", "y2", "cx", "cy", "w", "h"]
SCORES = ["conf", "doc_conf", "DocConf", "p_handwritten"]
DISCRETE = ["cls", "width", "height", "field_count", "retry_count", "size_bytes", "id"]
PROFILES = {"cpu": (1e-3, 1e-3, 1e-3), "gpu": (1e-2, 1.0, 1e-2)}
BOX_COLUMNS = ["x1", "y1", "x2", "y2", "conf", "cls", "label"]
#: Paths held to nullness only, since times and devices differ in every run.
IGNORED = [
    r"(^|\.)timings(\.|$)",
    r"(^|\.)device$",
    r"(^|\.)ocr_device$",
    r"(^|\.)providers(\[|$)",
    r"(^|\.)processing_ms$",
    r"(^|\.)(created|started|finished)_at$",
]
#: One step of a quantised value differs by a little more than the step in binary.
NUDGE = 1 + 2.0**-40


def leaf(path: Column) -> Column:
    """The name of what stands at a path; a position in a box row is named by its column."""
    position = F.regexp_extract(path, r"^(?:fields\.bbox\[\d+\]|words\.[^.]+\.bbox\[\d+\]\[\d+\])\[(\d+)\]$", 1)
    names = F.array(*[F.lit(c) for c in BOX_COLUMNS])
    index = position.try_cast("int")
    by_position = F.when(index < len(BOX_COLUMNS), F.get(names, index))
    tail = F.regexp_extract(path, r"([^.]*)$", 1)
    return F.coalesce(by_position, F.regexp_replace(tail, r"\[.*$", ""))


def tolerance(name: Column, profile: str) -> Column:
    """What a leaf may differ by; identifiers by nothing."""
    default, coordinate, score = PROFILES[profile]
    return (
        F.when(name.isin(DISCRETE), 0.0).when(name.isin(COORDINATES), coordinate).when(name.isin(SCORES), score).otherwise(default)
    )


def flatten(value: object, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, type, text) of every leaf and every container of a parsed JSON value."""
    if isinstance(value, dict):
        yield path or "$", "object", str(len(value))
        for k, v in value.items():
            yield from flatten(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        yield path or "$", "array", str(len(value))
        for i, v in enumerate(value):
            yield from flatten(v, f"{path}[{i}]")
    elif value is None:
        yield path, "null", None
    elif isinstance(value, bool):
        yield path, "bool", str(value).lower()
    elif isinstance(value, int | float):
        yield path, "number", repr(value)
    else:
        yield path, "string", str(value)


def leaves(records: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, path, kind, value) of the records' JSON, a batch at a time; malformed ones give one row of
    kind ``invalid``, a null one a single null."""
    kinds = T.StructType([records.schema[key], *[T.StructField(c, T.StringType()) for c in ("path", "kind", "value")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(flatten(json.loads(text))) if text is not None else [("$", "null", None)]
                except ValueError:
                    found = [("$", "invalid", text)]
                at += [i] * len(found)
                rows += found
            cols = [pa.array([r[c] for r in rows], pa.string()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=[key, "path", "kind", "value"])

    return records.select(key, json_col).mapInArrow(run, kinds)


def differences(golden: DataFrame, actual: DataFrame, keys: list[str], profile: str = "cpu", ignored: list[str] | None = None) -> DataFrame:
    """What differs between two tables of (keys, path, kind, value) leaves.

    missing and extra paths; kinds that differ; array lengths; numbers beyond their tolerance; other
    values that aren't equal. Paths that match ``ignored`` (IGNORED, if not given) are held to nullness
    only. Below a container that is missing, or of another kind or length, nothing more is told.
    A path stands once in a record. One exchange, by record, serves the comparison and the containers.
    """
    side = lambda df, mine, other: df.select(
        *keys, "path", F.col("kind").alias(f"{mine}k"), F.col("value").alias(f"{mine}v"), F.lit(None).cast("string").alias(f"{other}k"), F.lit(None).cast("string").alias(f"{other}v")
    )
    rows = side(golden, "g", "a").unionByName(side(actual, "a", "g")).repartition(*keys)
    both = rows.groupBy(*keys, "path").agg(*[F.max(c).alias(c) for c in ("gk", "gv", "ak", "av")])
    name = leaf(F.col("path"))
    gap = F.abs(F.col("gv").try_cast("double") - F.col("av").try_cast("double"))
    far = gap > tolerance(name, profile) * NUDGE
    lenient = F.lit(False)
    for pattern in IGNORED if ignored is None else ignored:
        lenient = lenient | F.col("path").rlike(pattern)
    null_differs = (F.col("gk") == "null") != (F.col("ak") == "null")
    kind = (
        F.when(F.col("ak").isNull(), "missing")
        .when(F.col("gk").isNull(), "extra")
        .when(lenient, F.when(null_differs, "type"))
        .when(F.col("gk") != F.col("ak"), "type")
        .when((F.col("gk") == "array") & (F.col("gv") != F.col("av")), "length")
        .when(F.col("gk") == "object", None)
        .when(F.col("gk") == "number", F.when(far, "value"))
        .when(~F.col("gv").eqNullSafe(F.col("av")), "value")
    )
    found = both.withColumn("diff", kind).where("diff is not null")
    # A container's own difference stands for all below it.
    container = F.col("gk").isin("array", "object") | F.col("ak").isin("array", "object")
    whole = F.when(F.col("diff").isin("type", "length", "missing", "extra") & F.coalesce(container, F.lit(False)), F.col("path"))
    found = found.withColumn("__tops", F.collect_set(whole).over(Window.partitionBy(*keys)))
    below = lambda t: ((t == "$") & (F.col("path") != "$")) | F.col("path").startswith(F.concat(t, F.lit("."))) | F.col("path").startswith(F.concat(t, F.lit("[")))
    return found.where(~F.exists("__tops", below)).select(*keys, "path", F.col("diff").alias("kind"))


def perturbed(records: DataFrame, path: str, by: float) -> DataFrame:
    """Leaves with the number at a path moved, to prove that a comparison can fail."""
    hit = (F.col("path") == path) & (F.col("kind") == "number")
    return records.withColumn("value", F.when(hit, (F.col("value").try_cast("double") + by).cast("string")).otherwise(F.col("value")))


def stage_index(spark: SparkSession, root: str) -> DataFrame:
    """(case, ord, stage, payload) of stage files ``<case>/stages/<stage>.json`` below a tree, in the order of
    their names; the payload is text, read only where it is asked for."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    path = F.col("_metadata.file_path")
    parts = text.select(F.regexp_extract(path, r"([^/]+)/stages/[^/]+$", 1).alias("case"), F.regexp_extract(path, r"/stages/([^/]+)\.json$", 1).alias("stage"), F.col("value").alias("payload"))
    place = F.row_number().over(Window.partitionBy("case").orderBy("stage"))
    return parts.where("stage <> ''").select("case", place.cast("long").alias("ord"), "stage", "payload")


def same_weights(golden: Column, installed: Column) -> Column:
    """May results be graded? Not if both sets of weights are known and differ."""
    unknown = F.coalesce(golden, F.lit("")).isin("") | F.coalesce(installed, F.lit("")).isin("")
    return unknown | F.coalesce(golden == installed, F.lit(False))


def array_differences(golden: DataFrame, actual: DataFrame, key: str, column: str, tol: float) -> DataFrame:
    """Of each pair of arrays: length, elements beyond tolerance and the largest gap; nulls and NaN
    agree with each other only."""
    joined = golden.select(key, F.col(column).alias("g")).join(actual.select(key, F.col(column).alias("a")), key)
    none = lambda x: x.isNull() | F.isnan(x)
    gaps = F.zip_with("g", "a", lambda g, a: F.when(none(g) & none(a), 0.0).when(none(g) | none(a), float("inf")).otherwise(F.abs(g - a)))
    out = joined.withColumn("gaps", F.transform(gaps, lambda x: x.cast("double")))
    return out.select(
        key,
        (F.size("g") == F.size("a")).alias("same_length"),
        F.size(F.filter("gaps", lambda x: x > tol * NUDGE)).cast("long").alias("beyond"),
        F.bround(F.array_max("gaps"), 6).alias("largest"),
    )


def image_difference(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, golden, actual) pixels: share within 1, mean and largest gap, and the verdict."""
    gap = F.abs(F.col("golden").cast("long") - F.col("actual").cast("long"))
    out = pixels.groupBy(*keys).agg(
        F.bround(F.avg((gap <= 1).cast("double")), 6).alias("close"), F.bround(F.avg(gap), 6).alias("mean_gap"), F.max(gap).alias("largest")
    )
    return out.withColumn("ok", (F.col("close") >= 0.995) & (F.col("mean_gap") < 0.5) & (F.col("largest") <= 3))


def contour_difference(golden: Column, actual: Column, profile: str = "cpu") -> Column:
    """P5: struct of the checks on two outlines: area, centroid and Hausdorff distance."""
    from folio.functions.geometry import hausdorff, polygon_area, polygon_centroid

    centre_px, reach_px = (2.0, 8.0) if profile == "gpu" else (1e-3, 1.0)
    ga, aa = polygon_area(golden), polygon_area(actual)
    gc, ac = polygon_centroid(golden), polygon_centroid(actual)
    shift, reach = F.hypot(gc["x"] - ac["x"], gc["y"] - ac["y"]), hausdorff(golden, actual)
    return F.struct(
        (F.abs(ga - aa) <= 1e-3 * F.greatest(ga, F.lit(1.0))).alias("area_ok"), (shift <= centre_px).alias("centroid_ok"), (reach <= reach_px).alias("reach_ok")
    )


def case_summary(stages: DataFrame) -> DataFrame:
    """Of (case, ord, stage, status): stages by verdict and the first that fails."""
    failing = F.min(F.when(F.col("status") == "FAIL", F.struct("ord", "stage")))
    return stages.groupBy("case").agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        failing["stage"].alias("first_divergence"),
    )


def unclaimed(golden: DataFrame, claimed: DataFrame, key: str = "stage") -> DataFrame:
    """Golden stages that an implementation doesn't claim."""
    return golden.join(claimed.select(key).distinct(), key, "left_anti")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha) tables: what was added, removed or changed."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    kind = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(F.col("o.sha") != F.col("n.sha"), "changed")
    return both.select(F.coalesce("o.path", "n.path").alias("path"), kind.alias("kind")).where("kind is not null")


def vacuous(payload: Column) -> Column:
    """Why a golden payload (JSON text) proves nothing, null if it does: null, empty, or an object of nulls only."""
    v = F.try_parse_json(payload)
    kind = F.schema_of_variant(v)
    empty = F.regexp_replace(payload, r"\s", "")
    name = F.when(empty == "{}", "dict").when(empty == "[]", "list").when(empty == '""', "str")
    # Of an object of nulls the schema names no other type.
    bare = F.regexp_replace(kind, r"^OBJECT<(.*)>$", "$1")
    nulls = kind.startswith("OBJECT<") & ~F.regexp_replace(bare, r"(^|, )[^,]*?: VOID", "").rlike(r"\S")
    return (
        F.when(payload.isNull() | (empty == "null"), "golden is null")
        .when(name.isNotNull(), F.concat(F.lit("golden is an empty "), name))
        .when(F.coalesce(nulls, F.lit(False)), "every value in the golden is null")
    )


def digest_verdict(golden_sha: Column, actual_sha: Column, golden_shape: Column, actual_shape: Column, pixels_ok: Column | None = None) -> Column:
    """Another shape fails; equal digests pass; else the pixels decide where there are any (null: none), else a warning."""
    pixels = pixels_ok if pixels_ok is not None else F.lit(None).cast("boolean")
    return (
        F.when(~golden_shape.eqNullSafe(actual_shape), "FAIL")
        .when(golden_sha == actual_sha, "pass")
        .when(pixels.isNull(), "shape-only")
        .otherwise(F.when(pixels, "pass").otherwise("FAIL"))
    )


def last_entries(logs: DataFrame, n: int, least: str | None = None, search: str | None = None) -> DataFrame:
    """The last n log entries of at least a severity whose message holds a text, newest first."""
    levels = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
    if least:
        logs = logs.where(F.array_position(F.array(*map(F.lit, levels)), F.col("level")) > levels.index(least))
    if search:
        logs = logs.where(F.lower("message").contains(search.lower()))
    top = logs.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(max(0, min(n, 2000)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("ts").desc(), F.col("id").desc())).cast("long"))
