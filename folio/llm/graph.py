"""Connected components by alternating star contractions, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours get its smallest neighbour (itself included)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the smallest of these; edges run from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``, the component being its smallest node.

    Self-links and repeated or reversed edges don't matter; rows with a null end are passed over; no
    edges give no rows. Each round is written to the shared folder, the one before is then deleted,
    and it ends when every edge leads to a root, after about log2 of the longest chain rounds.
    """
    spark = edges.sparkSession
    u, v = F.col(left), F.col(right)
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v")
    now, path = materialize(e.distinct(), "star")
    state = None
    while True:
        nxt = _small_star(_large_star(now).distinct()).distinct()
        nxt, new_path = materialize(nxt, "star")
        seen = nxt.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = nxt, new_path
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
