"""Images as DataFrames: sources, transformations and pluggable models.

An image is Spark's image struct: origin, height, width, nChannels, mode and data, blue first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.image import kernels

Kernel = Callable[[np.ndarray], np.ndarray | None]
IMAGE = "struct<height: int, width: int, channels: int, data: binary>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A1, A3: decoded images with their path; what can't be decoded has error true."""
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    return images.select(
        F.col("image.origin").alias("path"),
        F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).alias("image"),
        (F.col("image.height") < 0).alias("error"),
    )


def array(m: dict | None) -> np.ndarray | None:
    if not m or m["height"] is None or m["height"] <= 0 or m["data"] is None or len(m["data"]) < m["height"] * m["width"] * m["channels"]:
        return None
    return np.frombuffer(m["data"], np.uint8)[: m["height"] * m["width"] * m["channels"]].reshape(m["height"], m["width"], m["channels"])


def struct(x: np.ndarray | None) -> dict | None:
    if x is None:
        return None
    x = x[..., None] if x.ndim == 2 else x
    return {"height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "data": np.ascontiguousarray(x, np.uint8).tobytes()}


_ARROW = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])


def apply(images: DataFrame, kernel: Kernel, column: str = "image", out: str | None = None) -> DataFrame:
    """A kernel on every image, in Arrow batches of at most 16 images at once; null stays null."""
    out = out or column
    base = images if out == column else images.drop(out)
    names, at = base.columns, base.columns.index(column)
    fields = [f for f in base.schema.fields if f.name != out] + [T.StructField(out, T._parse_datatype_string(IMAGE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                b = batch.slice(i, 16)
                made = [struct(None if (x := array(m)) is None else kernel(x)) for m in b.column(at).to_pylist()]
                kept = [n for n in names if n != out]
                yield pa.RecordBatch.from_arrays([*[b.column(names.index(n)) for n in kept], pa.array(made, _ARROW)], names=[*kept, out])

    return base.mapInArrow(run, T.StructType(fields))


def shrink(images: DataFrame, longest: int = 1500) -> DataFrame:
    """J1."""
    return apply(images, lambda x: kernels.shrink(x, longest))


def upright(images: DataFrame, quarter_turns: int) -> DataFrame:
    """J2."""
    return apply(images, lambda x: np.rot90(x, quarter_turns))


def thumbnails(images: DataFrame, width: int = 96) -> DataFrame:
    """B7."""
    return apply(images, lambda x: kernels.thumbnail(x, width), out="thumbnail")


def deskew(images: DataFrame, limit: float = 10.0, least: float = 2.0, scale: float = 0.4) -> DataFrame:
    """J13."""
    return apply(images, lambda x: kernels.deskewed(x, limit, least, scale)[0])


def swap_channels(images: DataFrame) -> DataFrame:
    """Red first to blue first, or back."""
    return apply(images, lambda x: x[..., ::-1])


def digests(images: DataFrame, column: str = "image") -> DataFrame:
    """SHA-256 of the pixels, with type and shape."""
    m = F.col(column)
    shape = F.concat_ws("x", m["height"].cast("string"), m["width"].cast("string"), m["channels"].cast("string"))
    return images.withColumn("sha256", F.sha2(m["data"], 256)).withColumn("dtype", F.lit("uint8")).withColumn("shape", shape)


def crops(images: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A patch for each box (key, det_idx, x1, y1, x2, y2) of an image; empty patches go."""
    joined = boxes.join(images.select(key, "image"), key)
    names = [key, "det_idx", "patch"]
    key_type = joined.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                rows = batch.slice(i, 16).to_pylist()
                made = [(r[key], r["det_idx"], None if (x := array(r["image"])) is None else kernels.crop(x, (r["x1"], r["y1"], r["x2"], r["y2"]))) for r in rows]
                made = [m for m in made if m[2] is not None and m[2].size]
                yield pa.RecordBatch.from_pylist([dict(zip(names, (a, b, struct(c)), strict=True)) for a, b, c in made], pa.schema([(key, batch.schema.field(key).type), ("det_idx", batch.schema.field("det_idx").type), ("patch", _ARROW)]))

    fields = [T.StructField(key, key_type), T.StructField("det_idx", joined.schema["det_idx"].dataType), T.StructField("patch", T._parse_datatype_string(IMAGE))]
    return joined.mapInArrow(run, T.StructType(fields))


def tiles(images: DataFrame, key: str = "doc_id", across: int = 7, down: int = 4, size: int = 128) -> DataFrame:
    """Corners of the quality windows of each image: an even grid, column by column."""

    def corners(side: Column, n: int) -> Column:
        room = F.greatest(side - size, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * room / max(1, n - 1), 0).cast("int"))

    h, w = F.col("image.height"), F.col("image.width")
    grid = F.flatten(F.transform(corners(w, across), lambda x: F.transform(corners(h, down), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return images.where((h > 0) & (w > 0)).select(key, F.posexplode(grid).alias("tile", "at")).select(key, "tile", "at.x", "at.y")


class Registry:
    """K1-K4, M1, M2: models by name. A builder makes a function of a batch of images, once for each
    Python worker, so weights are loaded where they run and never pickled."""

    def __init__(self) -> None:
        self.builders: dict[str, tuple[Callable[[], Callable[[list[np.ndarray | None]], list]], str]] = {}

    def register(self, name: str, builder: Callable[[], Callable[[list[np.ndarray | None]], list]], returns: str) -> None:
        """``returns`` is the type of what the function gives for an image."""
        if name in self.builders:
            raise ValueError(f"model {name} is registered twice")
        self.builders[name] = (builder, returns)

    def predict(self, images: DataFrame, name: str, column: str = "image") -> DataFrame:
        """Adds a column called as the model; an image that isn't one is given to it as None."""
        if name not in self.builders:
            raise KeyError(f"no model {name}")
        builder, returns = self.builders[name]
        names, at = images.columns, images.columns.index(column)
        schema = T.StructType([*images.schema.fields, T.StructField(name, T._parse_datatype_string(returns))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            model = builder()
            kind = to_arrow_type(schema[name].dataType)
            for batch in batches:
                for i in range(0, len(batch), 16):
                    b = batch.slice(i, 16)
                    got = model([array(m) for m in b.column(at).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*names, name])

        return images.mapInArrow(run, schema)
