"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

Every node of the tree holds *tickets*: one for the weight it was built with and one for each later
increase. At a level a row draws an exponential variate ``-ln(u) / weight`` for each ticket and the
smallest wins, so a node wins in proportion to its weight. A new shard adds one ticket, of its own
weight, to each node on its path; a row moves only if that ticket wins at the top, and the ticket
leads straight to the new shard. Movement is thus confined to the subtree whose weight changed, and
one more shard takes rows only into itself.

Law: ``key`` (doc_id and shard count decide).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Tree:
    """``base[r][k][s]`` is the weight of a shard; ``added`` holds (region, rack, weight) of later ones."""

    base: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[tuple[int, int, float], ...] = field(default=())

    @classmethod
    def regular(cls, regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
        return cls(tuple(tuple(tuple(1.0 for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def grow(self, region: int | None = None, rack: int = 0, weight: float = 1.0) -> Tree:
        """The tree with one more shard, by default in the region after the last addition's."""
        region = len(self.added) % len(self.base) if region is None else region
        return Tree(self.base, (*self.added, (region, rack, weight)))

    @property
    def n_base(self) -> int:
        return sum(len(k) for r in self.base for k in r)

    @property
    def n_shards(self) -> int:
        return self.n_base + len(self.added)


def uniform(key: Column, node: str) -> Column:
    """A uniform variate in (0, 1) from the key and a node's name: 52 bits of MD5."""
    digest = F.md5(F.concat(key, F.lit("|" + node)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _argmin(draws: list[tuple[Column, int]]) -> Column:
    return F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("to")) for d, i in draws]))["to"]


def place(df: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """Add the shard number ``out``: regular shards are numbered in tree order, added ones after them."""
    names = [f"__{out}_{x}" for x in ("key", "region", "rack")]
    draw = lambda node, w: -F.log(uniform(F.col(names[0]), node)) / F.lit(float(w))
    df = df.withColumn(names[0], key)
    # Tickets of additions draw at the top only: their winner's way down is fixed.
    top = [(draw(f"r{r}", sum(map(sum, racks))), r) for r, racks in enumerate(tree.base)]
    top += [(draw(f"a{i}", w), len(tree.base) + i) for i, (_, _, w) in enumerate(tree.added)]
    df = df.withColumn(names[1], _argmin(top))
    rack = F.lit(None).cast("int")
    for r, racks in enumerate(tree.base):
        rack = F.when(F.col(names[1]) == r, _argmin([(draw(f"r{r}k{k}", sum(s)), k) for k, s in enumerate(racks)])).otherwise(rack)
    df = df.withColumn(names[2], rack)
    shard, at = F.col(names[1]) - len(tree.base) + tree.n_base, 0
    for r, racks in enumerate(tree.base):
        for k, shards in enumerate(racks):
            here = (F.col(names[1]) == r) & (F.col(names[2]) == k)
            shard = F.when(here, _argmin([(draw(f"r{r}k{k}s{s}", w), at + s) for s, w in enumerate(shards)])).otherwise(shard)
            at += len(shards)
    return df.withColumn(out, shard.cast("int")).drop(*names)


def slots(df: DataFrame, shard: str, key: Column, order: list[str], buckets: int) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, without one task for each shard.

    A shard's rows stand in the order of a hash of their key, then ``order``; that hash cuts each
    shard into ``buckets`` ranges, within which rows are ranked. The ranges' sizes, ``shards *
    buckets`` rows however large the table is, give the offsets, so slots don't depend on ``buckets``.
    """
    b = df.withColumn("__u", uniform(key, "slot"))
    b = b.withColumn("__bucket", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = b.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    run = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__bucket", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy("__u", *order))
    ranked = b.withColumn("__rank", rank.cast("long") - 1)
    joined = ranked.join(starts, [shard, "__bucket"])
    return joined.withColumn("slot", F.col("__start") + F.col("__rank")).drop("__u", "__bucket", "__start", "__rank")


def assign(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of all rows: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows with a null id all go where the key '' leads; repeated rows go together and get slots of
    their own; a null text has size 1 and the checksum of an empty one. An empty table gives none.
    Only id, size and checksum are shuffled, never the texts.
    """
    tree = tree or Tree.regular()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = place(place(rows, key, tree, "shard"), key, tree.grow(), "grown_shard")
    spark = docs.sparkSession
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = slots(rows, "shard", key, ["doc_id", "text_crc32", "size"], buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

