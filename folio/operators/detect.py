"""Detections: thresholds, suppression, duplicates, reading order and numbering of boxes.

A box is a row (doc_id, det_idx, x1, y1, x2, y2, conf, label); ``doc_id`` names the group that
belongs together, one page, which bounds what a task holds at once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.functions.geometry import iou

CORNERS = ("x1", "y1", "x2", "y2")
#: Fields of which a page has one.
UNIQUE_FIELDS = ["Licence_number"]


def confident(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes above the threshold, not at it."""
    return boxes.where(F.col("conf") > threshold)


def overlaps(boxes: DataFrame, same_label: bool = True) -> DataFrame:
    """Overlap of every two boxes of a page, the lower index first."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.det_idx") < F.col("b.det_idx"))
    if same_label:
        on &= F.col("a.label") == F.col("b.label")
    pair = iou([F.col(f"a.{c}") for c in CORNERS], [F.col(f"b.{c}") for c in CORNERS])
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_id"), F.col("a.det_idx").alias("i"), F.col("b.det_idx").alias("j"), pair.alias("iou"))


def suppress(boxes: DataFrame, threshold: float, by_label: bool = True, own: dict[str, float] | None = None) -> DataFrame:
    """The boxes that greedy suppression keeps: the most confident first (ties: the first), others
    only if their overlap with every kept one is below the kept one's threshold; ``own`` overrides the
    threshold of single labels. A zero-area box's overlap is no number, so any kept one suppresses it.

    A page's boxes, by label or across labels, are folded as one array; pages without a rival box pay for
    nothing more than the grouping.
    """
    keys = ["doc_id", "label"] if by_label else ["doc_id"]
    limit = F.lit(float(threshold))
    for label, value in (own or {}).items():
        limit = F.when(F.col("label") == label, float(value)).otherwise(limit)
    row = F.struct((-F.coalesce(F.col("conf").cast("double"), F.lit(float("-inf")))).alias("__at"), "det_idx", limit.alias("__limit"), F.struct(*boxes.columns).alias("__row"))
    items = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__items"))

    def stays(kept: Column, x: Column) -> Column:
        overlap = lambda k: iou([k["__row"][c] for c in CORNERS], [x["__row"][c] for c in CORNERS])
        return F.forall(kept, lambda k: F.coalesce(overlap(k) < k["__limit"], F.lit(False)))

    fold = F.aggregate(F.slice("__items", 2, F.size("__items")), F.slice("__items", 1, 1), lambda kept, x: F.when(stays(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    kept = F.when(F.size("__items") == 1, F.col("__items")).otherwise(fold)
    return items.select(F.explode(kept).alias("__kept")).select("__kept.__row.*")


def dedup_fields(boxes: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Of a page's boxes of a unique field the most confident stays, the first among equals."""
    unique = unique or UNIQUE_FIELDS
    best = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.col("conf").desc(), "det_idx"))
    return boxes.withColumn("__rank", best).where(~F.col("label").isin(unique) | (F.col("__rank") == 1)).drop("__rank")


def best_per_label(boxes: DataFrame) -> DataFrame:
    """boxes with ``owns_text``: the most confident of its label, the first among equals."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.col("conf").desc_nulls_last(), "det_idx"))
    return boxes.withColumn("owns_text", rank == 1)


def numbered(boxes: DataFrame) -> DataFrame:
    """Ids b0, b1 .. in the page's order."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("det_idx")) - 1
    return boxes.withColumn("box_id", F.concat(F.lit("b"), at.cast("string")))


def by_position(boxes: DataFrame) -> DataFrame:
    """Rank in order of y, then x."""
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("y1", "x1", "det_idx")).cast("long"))


def by_bands(boxes: DataFrame, height: float = 10.0) -> DataFrame:
    """Rank by bands of the centre's height, then its x."""
    cy, cx = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    order = Window.partitionBy("doc_id").orderBy(F.bround(cy / height, 0), cx, "det_idx")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long"))


def by_middle(boxes: DataFrame) -> DataFrame:
    """Rank by the middle's height, stable."""
    order = Window.partitionBy("doc_id").orderBy(F.col("y1") + F.col("y2"), "det_idx")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long"))


def reading_order(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rank of the boxes of each group in reading order: by the height of their middles, boxes join the
    first line whose running mean middle and height they are near; lines top-down, boxes left to right."""
    keys = keys or ["doc_id"]
    middle = (F.col("y1") + F.col("y2")).cast("double") / 2
    row = F.struct(middle.alias("m"), "det_idx", (F.col("y2") - F.col("y1")).cast("double").alias("h"), F.struct(*boxes.columns).alias("row"))
    items = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__items"))
    none = F.struct(F.array().cast("array<struct<y: double, h: double, n: double>>").alias("lines"), F.array().cast("array<int>").alias("home"))

    def step(state: Column, x: Column) -> Column:
        near = F.transform(state["lines"], lambda line: F.abs(x["m"] - line["y"]) < F.lit(0.5) * F.greatest(x["h"], line["h"]))
        at = F.array_position(near, True).cast("int")
        mean = lambda line, c, v: (line[c] * line["n"] + v) / (line["n"] + 1)
        joined = F.transform(
            state["lines"],
            lambda line, i: F.when(i == at - 1, F.struct(mean(line, "y", x["m"]).alias("y"), mean(line, "h", x["h"]).alias("h"), (line["n"] + 1).alias("n"))).otherwise(line),
        )
        new = F.concat(state["lines"], F.array(F.struct(x["m"].alias("y"), x["h"].alias("h"), F.lit(1.0).alias("n"))))
        home = F.when(at > 0, at).otherwise(F.size(state["lines"]) + 1)
        return F.struct(F.when(at > 0, joined).otherwise(new).alias("lines"), F.concat(state["home"], F.array(home)).alias("home"))

    home = F.aggregate("__items", none, step, lambda state: state["home"])
    placed = items.withColumn("__home", home)
    read = F.array_sort(F.transform("__items", lambda x, i: F.struct(F.get("__home", i).alias("line"), x["row"]["x1"].alias("x"), i.alias("at"), x["row"].alias("row"))))
    out = placed.select(F.posexplode(read).alias("__rank", "__box"))
    return out.select("__box.row.*", (F.col("__rank") + 1).cast("long").alias("rank"))


def second_pages(segments: DataFrame, share: float = 0.6, most: int = 2) -> DataFrame:
    """A document's largest segments, at most ``most``, each of at least a share of the largest."""
    area = Window.partitionBy("doc_id")
    ranked = segments.withColumn("largest", F.max("area").over(area))
    ranked = ranked.withColumn("rank", F.row_number().over(area.orderBy(F.col("area").desc(), "det_idx")))
    return ranked.where((F.col("rank") <= most) & (F.col("area") >= F.col("largest") * share)).drop("largest", "rank")


def per_page(f: Callable[[pa.Table], pa.Table], boxes: DataFrame, schema: T.StructType | str) -> DataFrame:
    """M1: any operator on a page's rows as an Arrow table."""
    return boxes.groupBy("doc_id").applyInArrow(f, schema)
