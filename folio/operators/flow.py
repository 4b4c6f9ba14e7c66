"""The recognition flow as one plan: what is decided about a document, from the rows its models give.

Every model is a function of a DataFrame of pages (doc_id and whatever it reads) that gives rows by
doc_id, so each runs over all documents that get there, as joins and not as a loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import classify, options
from folio.session import materialize

NONE = "NONE"
Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Models:
    """K7-K15 by what they give: ``types`` (doc_id, doc_type, conf, angle), ``borders`` the cropped pages of
    documents with segments, taking the column ``max_pages``, ``quality`` (doc_id, glare, blur, print_conf, lcd),
    ``fields`` and ``lines`` boxes, ``words`` texts (doc_id, field, text)."""

    types: Model
    borders: Model
    quality: Model
    fields: Model
    lines: Model
    words: Model


def type_and_angle(vectors: DataFrame, centroids: list[tuple[str, list[float], float]], angles: DataFrame, limit: float = 0.6) -> DataFrame:
    """K7: (doc_id, doc_type, conf, angle): the nearest centroid's type, and the likeliest of four quarter turns."""
    found = classify.nearest_centroid(vectors.withColumnRenamed("doc_id", "vec_id"), centroids, 1.0).withColumnRenamed("vec_id", "doc_id")
    turn = classify.argmax_label(F.col("scores"), F.array(*[F.lit(a) for a in (0, 90, 180, 270)]))
    found = found.join(angles.select("doc_id", turn.alias("angle")), "doc_id", "left")
    return found.select("doc_id", F.col("label").alias("doc_type"), text.type_confidence(F.col("distance"), F.lit(limit)).alias("conf"), "angle")


def recovered(first: DataFrame, second: DataFrame) -> DataFrame:
    """Types (doc_id, doc_type, conf, angle), those that were NONE read again from the cropped page.

    ``max_pages`` is 2 for what has turned out to be a passport, whose second page the first crop has lost.
    """
    again = second.select("doc_id", F.col("doc_type").alias("t2"), F.col("conf").alias("c2"), F.col("angle").alias("a2"))
    joined = first.join(again, "doc_id", "left")
    use = (F.col("doc_type") == NONE) & F.col("t2").isNotNull()
    pick = lambda new, old: F.when(use, F.col(new)).otherwise(F.col(old)).alias(old)
    spread = use & F.lower("t2").contains("intpassport")
    return joined.select("doc_id", pick("t2", "doc_type"), pick("c2", "conf"), pick("a2", "angle"), use.alias("recovered"), F.when(spread, 2).otherwise(1).alias("max_pages"))


def without_address(types: DataFrame, lines: DataFrame) -> DataFrame:
    """A type with address lines of which none was found was taken for what it isn't: NONE, confidence 0."""
    have = lines.select("doc_id").distinct().withColumn("__lines", F.lit(True))
    joined = types.join(have, "doc_id", "left")
    wrong = options.rule_of(F.col("doc_type")).isin(options.WITH_ADDRESS) & F.col("__lines").isNull()
    wrong = F.coalesce(wrong, F.lit(False))
    return joined.withColumn("conf", F.when(wrong, 0.0).otherwise(F.col("conf"))).withColumn("doc_type", F.when(wrong, NONE).otherwise(F.col("doc_type"))).drop("__lines")


def spoof_verdicts(print_conf: Column, lcd: Column) -> tuple[Column, Column]:
    """A print is FAKE below 0.9; a screen is what its model says. Null where nothing was measured."""
    printed = F.when(print_conf.isNotNull(), classify.binary_label(print_conf, 0.9, "FAKE", "REAL"))
    return printed, lcd


def recognise(pages: DataFrame, models: Models, low_quality: bool = True, least_conf: float = 0.5) -> DataFrame:
    """(doc_id, doc_type, conf, angle, recovered, max_pages, glare, blur, print_spoofing, lcd_spoofing, n_fields, ocr, stopped).

    ``stopped`` tells where a document left the flow: ``type``, ``quality``, ``address``, or null. A document that is
    NONE, whether at first or because an address page shows no lines, has neither fields nor texts; one of too low
    quality keeps its verdicts, unless ``low_quality`` lets it pass. Documents without rows of a model go on with
    nulls; repeated ids are the caller's to avoid. What the models give is kept in the shared folder, so each runs
    once over the documents that get there.
    """
    first = materialize(models.types(pages), "types")
    unknown = pages.join(first.where(F.col("doc_type") == NONE).select("doc_id"), "doc_id", "left_semi")
    types = materialize(recovered(first, models.types(models.borders(unknown.withColumn("max_pages", F.lit(1))))), "types")
    known = pages.join(types.where(F.col("doc_type") != NONE).select("doc_id", "max_pages"), "doc_id")
    printed, lcd = spoof_verdicts(F.col("print_conf"), F.col("lcd"))
    quality = models.quality(known).select("doc_id", "glare", "blur", printed.alias("print_spoofing"), lcd.alias("lcd_spoofing"))
    judged = types.join(quality, "doc_id", "left").withColumn("stopped", F.when(F.col("doc_type") == NONE, "type"))
    if not low_quality:
        poor = F.col("stopped").isNull() & ~classify.good_enough(F.col("glare"), F.col("blur"), F.col("conf"), least_conf)
        judged = judged.withColumn("stopped", F.when(poor, "quality").otherwise(F.col("stopped")))
    judged = materialize(judged, "judged")
    cropped = materialize(models.borders(known.join(judged.where("stopped is null").select("doc_id"), "doc_id", "left_semi")), "cropped")
    going = without_address(judged.where("stopped is null"), models.lines(cropped))
    going = materialize(going.withColumn("stopped", F.when(F.col("doc_type") == NONE, "address")), "going")
    cropped = cropped.join(going.where("stopped is null").select("doc_id"), "doc_id", "left_semi")
    counted = models.fields(cropped).groupBy("doc_id").agg(F.count("*").alias("n_fields"))
    texts = models.words(cropped).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "text")))).alias("ocr"))
    out = judged.where("stopped is not null").unionByName(going)
    return out.join(counted, "doc_id", "left").join(texts, "doc_id", "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))
