"""Classification of embeddings and patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centroids that a batch of rows is compared with at once.
LOT = 4096
#: Bytes of centroid values that may be broadcast.
CENTROID_BYTES = 256 << 20
NONE = "NONE"


def nearest_centroid(vectors: DataFrame, centroids: list[tuple[str, list[float], float]], radius: float, metric: str = "cosine") -> DataFrame:
    """Label of the nearest centroid within ``radius`` (inclusive) and below its own limit
    (exclusive), else NONE; with its index and distance. Ties go to the first centroid.

    ``vectors`` has vec_id and embedding. The centroids are a small table by contract, one for each
    class; they go to the executors at once, are compared in lots of LOT, and each row is read once.
    More than CENTROID_BYTES of them are refused.
    """
    if sum(len(v) for _, v, _ in centroids) * 8 > CENTROID_BYTES:
        raise ValueError(f"centroids exceed {CENTROID_BYTES} bytes")
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<idx: int, distance: double>")
    def nearest(x: pd.Series) -> pd.DataFrame:
        m = np.array(x.tolist(), float).reshape(len(x), -1)
        best, at = np.full(len(m), np.inf), np.full(len(m), -1)
        for start in range(0, len(sent.value), LOT):
            c = np.array([v for _, v, _ in sent.value[start : start + LOT]], float)
            if metric == "cosine":
                d = 1 - (m / np.linalg.norm(m, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
            else:
                d = np.sqrt(np.maximum((m**2).sum(1)[:, None] - 2 * m @ c.T + (c**2).sum(1)[None, :], 0))
            d = np.round(d, 9)
            j = d.argmin(axis=1)
            near = d[np.arange(len(m)), j]
            closer = near < best
            best, at = np.where(closer, near, best), np.where(closer, j + start, at)
        return pd.DataFrame({"idx": at.astype(np.int32), "distance": best})

    known = vectors.where(F.col("embedding").isNotNull()).select("vec_id", nearest("embedding").alias("n")).select("vec_id", "n.idx", "n.distance")
    names = spark.createDataFrame([(i, n, float(t)) for i, (n, _, t) in enumerate(centroids)], "idx int, name string, max_distance double")
    joined = known.join(F.broadcast(names), "idx", "left")
    hit = (F.col("distance") <= radius) & (F.col("distance") < F.col("max_distance"))
    return joined.select("vec_id", F.when(hit, F.col("name")).otherwise(NONE).alias("label"), "distance")


def binary_label(p: Column, threshold: float, low: str, high: str) -> Column:
    """The first label below the threshold, else the second."""
    return F.when(p < threshold, low).otherwise(high)


def glare_level(patches: DataFrame, label: str = "GLARE", threshold: float = 0.85) -> DataFrame:
    """Share of a document's patches that glare; bad if there is any."""
    glares = (F.col("cls") == label) & (F.col("conf") > threshold)
    level = F.bround(F.avg(glares.cast("double")), 6)
    return patches.groupBy("doc_id").agg(level.alias("level")).withColumn("verdict", F.when(F.col("level") > 0, "bad").otherwise("good"))


#: What a patch of each class counts; others don't.
BLUR_WEIGHTS = {"NonBlur": 1.0, "Blur5": 0.5, "Blur10": 0.0}


def blur_level(patches: DataFrame) -> DataFrame:
    """1 - the mean weight of the patches of known classes, 1 without any; good above 0.9."""
    weight = F.lit(None).cast("double")
    for name, w in BLUR_WEIGHTS.items():
        weight = F.when(F.col("cls") == name, w).otherwise(weight)
    level = F.coalesce(F.bround(1 - F.avg(weight), 6), F.lit(1.0))
    return patches.groupBy("doc_id").agg(level.alias("level")).withColumn("verdict", F.when(F.col("level") > 0.9, "good").otherwise("bad"))


def good_enough(glare: Column, blur: Column, conf: Column, least: float) -> Column:
    """Neither glare nor blur is bad, and the type is confident; a missing verdict passes."""
    bad = (F.coalesce(glare, F.lit("good")) == "bad") | (F.coalesce(blur, F.lit("good")) == "bad")
    return ~bad & ~F.coalesce(conf < least, F.lit(False))


def quality_gate(quality: DataFrame, least: float) -> DataFrame:
    """The rows that are good enough."""
    return quality.where(good_enough(F.col("glare"), F.col("blur"), F.col("doc_conf"), least))


def argmax_label(scores: Column, labels: Column) -> Column:
    """H5: label of the highest score, the first on ties."""
    return F.element_at(labels, F.array_position(scores, F.array_max(scores)).cast("int"))
