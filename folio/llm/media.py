"""Media copies by local descriptors: cropped, edited or repeated images fall into one class.

Harris corners on a pyramid of scales, an orientation from the patch's intensity centroid, and 256
rotated binary tests make a point. The tests are picked from a pool so that, on textures drawn here,
they are balanced and little correlated: then few unrelated points share a word. Points meet in Hamming
tables, one for each of TABLES words of their descriptor; images that share SHARED buckets by points
alike in the bits that follow are compared in full, and linked if their matches agree on one scale,
rotation and shift.

An image is a struct (height, width, channels, data) of unsigned bytes, row by row, as Spark's image
source gives; several channels are averaged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import kernel as K
from folio.llm.graph import components
from folio.llm.store import discard, materialize

#: Strongest points of a level for each 96 x 96 pixels, and at most; of these so many enter the tables.
POINTS, MOST, KEYED = 32, 512, 12
#: Radius that the tests reach; angles told apart; tests, and the pool they are picked from.
REACH, ANGLES, TESTS, POOL = 12, 32, 256, 1024
WORDS = TESTS // 32
#: Levels of an octave; images with a longer side than LARGEST are first averaged down to it.
OCTAVE, LARGEST = 3, 1024
#: Hamming tables, each of a 32-bit word; in how many of the 64 bits after it points of a bucket may differ; and how
#: many buckets two images must share in this way.
TABLES, LOOSE, SHARED = 3, 10, 2
#: Bits in which matching points may differ; matches that must agree, in pixels; members of a side of a bucket.
DIFFER, AGREE, NEAR, SIDE = 60, 6, 4.0, 2048


def _turned(spread: np.ndarray) -> np.ndarray:
    """[angle, test, end, (y, x)] offsets of the binary tests, rotated."""
    a = 2 * np.pi * np.arange(ANGLES) / ANGLES
    y, x = spread[..., 0], spread[..., 1]
    turned = [np.stack([y * np.cos(t) + x * np.sin(t), x * np.cos(t) - y * np.sin(t)], axis=-1) for t in a]
    return np.rint(np.array(turned)).astype(np.int8)


def _uniform(n: int, start: int = 1) -> np.ndarray:
    return (K.mix(np.arange(start, start + n, dtype=K.U64)) >> K.U64(40)).astype(float) / 2**24


def _textures() -> np.ndarray:
    """Noise blurred to four grains."""
    u = _uniform(24 * 160 * 160, 7).reshape(24, 160, 160) - 0.5
    blurred = [_box(_box(u[i : i + 1], 1 + i % 4), 1) for i in range(24)]
    return np.clip(np.concatenate([x / x.std() * 45 + 128 for x in blurred]), 0, 255)


@lru_cache(maxsize=1)
def patterns() -> np.ndarray:
    """The rotated offsets of the picked tests, word after word; the same wherever they are made."""
    spread = (_uniform(4 * POOL * 3).reshape(3, POOL, 2, 2).sum(axis=0) - 1.5) / 1.5 * (REACH - 1)
    spread /= np.maximum(1.0, np.hypot(spread[..., 0], spread[..., 1]) / (REACH - 1))[..., None]
    seen = np.concatenate([bits for _, bits in points(_textures(), _turned(spread))])
    bits = np.unpackbits(seen.view(np.uint8).reshape(len(seen), -1), axis=1).astype(float)
    mean, std = bits.mean(axis=0), bits.std(axis=0)
    z = (bits - mean) / np.maximum(std, 1e-6)
    alike = np.rint(np.abs(z.T @ z / len(z)) * 1e6) / 1e6
    balanced = np.lexsort((np.arange(POOL), np.rint(np.abs(mean - 0.5) * 1e6)))
    picked: list[int] = []
    for limit in np.arange(0.1, 1.01, 0.02):
        picked = []
        for k in balanced.tolist():
            if std[k] > 0 and (not picked or alike[k, picked].max() <= limit):
                picked.append(k)
        if len(picked) >= TESTS:
            break
    words: list[list[int]] = [[] for _ in range(WORDS)]
    for k in picked[:TESTS]:
        free = [w for w in words if len(w) < 32]
        min(free, key=lambda w: (sum(alike[k, j] ** 2 for j in w), len(w))).append(k)
    return _turned(spread[[k for w in words for k in w]])


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1)^2 pixels, edges repeated."""
    n = 2 * r + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(n, None), slice(None, -n)
        x = (c[tuple(hi)] - c[tuple(lo)]) / n
    return x


def _scaled(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resize of a stack of images."""
    ys = np.clip((np.arange(h) + 0.5) * x.shape[1] / h - 0.5, 0, x.shape[1] - 1)
    xs = np.clip((np.arange(w) + 0.5) * x.shape[2] / w - 0.5, 0, x.shape[2] - 1)
    y0, x0 = np.minimum(ys.astype(int), x.shape[1] - 2), np.minimum(xs.astype(int), x.shape[2] - 2)
    fy, fx = (ys - y0)[None, :, None], (xs - x0)[None, None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x0 + 1] * fx
    low = x[:, y0 + 1][:, :, x0] * (1 - fx) + x[:, y0 + 1][:, :, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def points(stack: np.ndarray, tests: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image of a stack [n, h, w]: (x, y, scale, angle) rows in its own pixels, and descriptors [.., 8].

    The points of a level stand together, the strongest first.
    """
    tests = patterns() if tests is None else tests
    n, height, width = stack.shape
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    scale, base = 1.0, stack.astype(np.float64)
    margin = REACH + 1
    while True:
        h, w = round(height / scale), round(width / scale)
        if min(h, w) < 2 * margin + 6:
            break
        level = base if scale == 1 else _scaled(_box(base, max(1, round(scale / 2))), h, w)
        smooth = _box(level, 1)
        dy, dx = np.gradient(smooth, axis=(1, 2))
        yy, xx, xy = _box(dy * dy, 2), _box(dx * dx, 2), _box(dx * dy, 2)
        corner = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        inner = corner[:, margin:-margin, margin:-margin]
        top = inner.copy()
        for axis in (1, 2):
            best = top.copy()
            for s in (-2, -1, 1, 2):
                moved = np.roll(top, s, axis=axis)
                best = np.maximum(best, moved)
            top = best
        strong = np.where((inner >= top) & (inner > 1.0), inner, 0)
        flat = strong.reshape(n, -1)
        many = min(max(POINTS, round(POINTS * h * w / 9216)), MOST, flat.shape[1])
        at = np.sort(np.argpartition(-flat, many - 1, axis=1)[:, :many], axis=1)
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(flat, at, axis=1), axis=1, kind="stable"), axis=1)
        image, k = np.nonzero(np.take_along_axis(flat, at, axis=1) > 0)
        cell = at[image, k]
        y, x = cell // inner.shape[2] + margin, cell % inner.shape[2] + margin
        r = np.arange(-7, 8)
        disc = (r[:, None] ** 2 + r[None, :] ** 2 <= 49).astype(float)
        patch = smooth[image[:, None, None], y[:, None, None] + r[None, :, None], x[:, None, None] + r[None, None, :]] * disc
        angle = np.arctan2((patch * r[None, :, None]).sum(axis=(1, 2)), (patch * r[None, None, :]).sum(axis=(1, 2)))
        turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        p = tests[turn].astype(np.int64)
        a = smooth[image[:, None], y[:, None] + p[:, :, 0, 0], x[:, None] + p[:, :, 0, 1]]
        b = smooth[image[:, None], y[:, None] + p[:, :, 1, 0], x[:, None] + p[:, :, 1, 1]]
        bits = np.packbits(a < b, axis=1).view(np.uint32)
        where = np.stack([(x + 0.5) * width / w, (y + 0.5) * height / h, np.full(len(x), scale), angle], axis=1)
        cuts = np.searchsorted(image, np.arange(n + 1))
        for i in range(n):
            if cuts[i] < cuts[i + 1]:
                found[i].append((where[cuts[i] : cuts[i + 1]], bits[cuts[i] : cuts[i + 1]]))
        scale *= 2 ** (1 / OCTAVE)
    none = (np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32))
    return [tuple(map(np.concatenate, zip(*f, strict=True))) if f else none for f in found]


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Most mutual best matches of two images' points that one similarity transform explains."""
    (pa_, da), (pb, db) = a, b
    if not len(da) or not len(db):
        return 0
    apart = np.bitwise_count(da[:, None, :] ^ db[None, :, :]).sum(axis=2)
    j = apart.argmin(axis=1)
    i = np.arange(len(da))
    ok = (apart[i, j] <= DIFFER) & (apart.argmin(axis=0)[j] == i)
    p, q = pa_[i[ok]], pb[j[ok]]
    if not len(p):
        return 0
    # Each match proposes a transform; which has most matches near where it sends them?
    ratio, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    c, s = ratio * np.cos(turn), ratio * np.sin(turn)
    dx, dy = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
    x = q[:, None, 0] + c[:, None] * dx - s[:, None] * dy
    y = q[:, None, 1] + s[:, None] * dx + c[:, None] * dy
    off = np.hypot(x - q[None, :, 0], y - q[None, :, 1])
    near = off <= NEAR * np.maximum(1, ratio)[:, None]
    return int(near.sum(axis=1).max())


def gray(height: int, width: int, channels: int, data: bytes | None) -> np.ndarray | None:
    """The image as one plane of at most LARGEST pixels a side, or None if it isn't one."""
    if not data or height <= 0 or width <= 0 or channels <= 0 or len(data) < height * width * channels:
        return None
    flat = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    k = -(-max(height, width) // LARGEST)
    if k == 1:
        return flat[:, :, 0] if channels == 1 else flat.mean(axis=2)
    # Means of k x k pixels, a band of rows at a time; an edge that fills no cell is left out, unless it is all there is.
    rows, cols = max(1, height // k), max(1, width // k)
    tall, wide = min(k, height), min(k, width)
    bands = [flat[r * k : r * k + tall, : cols * wide].mean(axis=(0, 2)).reshape(cols, wide).mean(axis=1) for r in range(rows)]
    return np.array(bands)


def _pixels(m: dict) -> int:
    """A hash of all pixels as they are, and of their shape."""
    size = (m["height"], m["width"], m["channels"])
    raw = bytes(m["data"])[: size[0] * size[1] * size[2]] + repr(size).encode()
    out = K.U64(len(raw))
    for i in range(0, len(raw), 1 << 20):
        out = K.mix(out ^ K.mix(K.prefix_hash(np.frombuffer(raw[i : i + (1 << 20)], np.uint8), lower=False)[-1:]))
    return int(K.as_long(out)[0])


def _described(tests: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            K.lean()
            ids, images = batch.column(0), batch.column(1)
            out: list[tuple] = [(None, b"", b"")] * len(images)
            by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

            def done(some: list[tuple[int, np.ndarray]], out: list[tuple] = out) -> None:
                for (i, _), (where, bits) in zip(some, points(np.stack([x for _, x in some]), tests), strict=True):
                    out[i] = (out[i][0], where.astype("<f2").tobytes(), bits.tobytes())
                some.clear()

            for i in range(len(images)):
                m = images[i].as_py()
                x = gray(m["height"] or 0, m["width"] or 0, m["channels"] or 0, m["data"]) if m else None
                if x is not None:
                    out[i] = (_pixels(m), b"", b"")
                    some = by_size.setdefault(x.shape, [])
                    some.append((i, x))
                    if len(some) * x.size >= 200_000:
                        done(some)
            for some in by_size.values():
                if some:
                    done(some)
            cols = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            tags = pa.array(np.frombuffer(os.urandom(8 * len(out)), np.int64))
            yield pa.RecordBatch.from_arrays([ids, tags, *cols], names=["id", "tag", "node", "where", "bits"])

    return run


def keys(where: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of an image's KEYED strongest points of each level, each once, and the 64 bits after the word."""
    scale = np.frombuffer(where, "<f2").reshape(-1, 4)[:, 2]
    first = np.flatnonzero(np.diff(scale, prepend=0) != 0)
    many = np.diff(np.append(first, len(scale)))
    rank = np.arange(len(scale)) - np.repeat(first, many)
    d = np.frombuffer(bits, np.uint32).reshape(-1, WORDS)[rank < np.repeat(np.maximum(KEYED, many * KEYED // POINTS), many)]
    d = d.astype(K.U64)
    at = [WORDS * t // TABLES for t in range(TABLES)]
    word = np.concatenate([d[:, w] | K.U64(t << 32) for t, w in enumerate(at)])
    more = np.concatenate([d[:, (w + 1) % WORDS] << K.U64(32) | d[:, (w + 2) % WORDS] for w in at])
    word, at = np.unique(word, return_index=True)
    return word, more[at]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
        ids = batch.column(0).to_numpy()
        rows = [keys(w, b) for w, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        cols = [np.repeat(ids, [len(k) for k, _ in rows])]
        cols += [K.as_long(np.concatenate([r[c] for r in rows] or [np.zeros(0, K.U64)])) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "key", "more"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups (key, lo, hi) of sorted batches, and where each group starts."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
        if len(new):
            yield [c[: new[-1]] for c in now], np.concatenate([[0], new])
            now = [c[new[-1] :] for c in now]
        rest = now
    if rest is not None and len(rest[0]):
        yield rest, np.array([0, len(rest[0])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket in different components, alike in the bits after the word: a row for each bucket they share."""
    for (_, lo, hi, side, ids, more, component), starts in _segments(batches):
        found = [np.zeros((0, 2), np.int64)]
        more, n = more.view(K.U64), np.diff(starts)

        def keep(i: np.ndarray, j: np.ndarray, found=found, lo=lo, hi=hi, side=side, ids=ids, more=more, component=component) -> None:  # noqa: ANN001
            ok = (component[i] != component[j]) & (np.bitwise_count(more[i] ^ more[j]) <= LOOSE)
            # Between two sides only pairs of one with the other: those within a side meet in its own group.
            ok &= (lo[i] == hi[i]) | (side[i] != side[j])
            a, b = ids[i[ok]], ids[j[ok]]
            found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1))

        small = n <= 64
        # All pairs of the small groups at once, block by block; of a large one row by row.
        row = np.repeat(np.arange(len(n)), n)
        later = np.where(small[row], starts[1:][row] - np.arange(len(row)) - 1, 0)
        for x, y in K.blocks(np.concatenate([[0], np.cumsum(later)]), 1 << 20):
            i = np.repeat(np.arange(x, y), later[x:y])
            keep(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[x:y]) - later[x:y], later[x:y]))
        for g in np.flatnonzero(~small).tolist():
            for i in range(starts[g], starts[g + 1] - 1):
                j = np.arange(i + 1, starts[g + 1])
                keep(np.full(len(j), i), j)
        pairs = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "to"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(where: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(where, "<f2").reshape(-1, 4).astype(float), np.frombuffer(bits, np.uint32).reshape(-1, WORDS)

    for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
        c = [x.to_pylist() for x in batch.columns]
        n = [agreeing(read(a, b), read(x, y)) for a, b, x, y in zip(*c[2:], strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "to"]).filter(pa.array([v >= AGREE for v in n], pa.bool_()))


def _linked(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs whose images agree. Pairs are few, so points are fetched for each end apart and meet by pair."""
    one = ends.join(pairs.select("id", "to"), "id")
    other = ends.select(F.col("id").alias("to"), F.col("where").alias("w"), F.col("bits").alias("b")).join(pairs.select("id", "to"), "to")
    both = one.join(other, ["id", "to"])
    return both.select("id", "to", "where", "bits", "w", "b").mapInArrow(_compared, "id long, to long")


def copies(images: DataFrame, id_col: str, image: Column) -> DataFrame:
    """(id_col, n_points, class_id, kept): one row for each image, in classes of copies.

    ``image`` is a struct (height, width, channels, data). Images of equal pixels are one class
    without comparison. Two others are linked if they share SHARED buckets by points alike in LOOSE of
    the bits that follow, and AGREE or more of their matches agree; class_id is the smallest id that
    links lead to. What isn't an image, and what has a null id, stands alone; an image without corners
    is linked to equal ones only. A side above LARGEST pixels is averaged down before corners are sought,
    so large images cost bounded memory. Rows are told apart by their pixels, not by their ids: a
    repeated id has the class of each of its images, the same in every run. No rows give no rows; other
    columns are not read.

    1. One pass describes each image; equal pixels become one node.
    2. A bucket's members are held against its smallest node, each against the one that most of its buckets name.
    3. Members of different components meet in the buckets, SIDE by SIDE; of these pairs first the
       likeliest between every two components are compared, then those that are still apart.
    """
    spark = images.sparkSession
    rows = images.select(F.col(id_col).cast("long").alias("id"), image.alias("image"))
    schema = "id long, tag long, node long, where binary, bits binary"
    described, _ = materialize(rows.mapInArrow(_described(patterns()), schema), "media")
    # One row of each node, picked by the random tag it was given when it was written.
    usable = described.where("id is not null and node is not null")
    classes, classes_path = materialize(usable.groupBy("node").agg(F.min("tag").alias("tag"), F.min("id").alias("rep")), "media-classes")
    ends = usable.where(F.octet_length("bits") > 0).join(classes.select("node", "tag"), ["node", "tag"], "left_semi")
    ends = ends.select(F.col("node").alias("id"), "where", "bits")

    banded = ends.mapInArrow(_banded, "id long, key long, more long")
    heads = banded.groupBy("key").agg(F.min(F.struct("id", "more")).alias("head"), F.count("*").alias("n")).where("n > 1")
    near = (F.col("id") != F.col("head.id")) & (F.bit_count(F.col("more").bitwiseXOR(F.col("head.more"))) <= LOOSE)
    shared = banded.join(heads.hint("merge"), "key").select("key", "id", "more", "n", F.when(near, F.col("head.id")).alias("to"))
    shared, shared_path = materialize(shared, "media-shared")
    named = shared.where("to is not null").groupBy("id", "to").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
    best = named.groupBy("id").agg(F.max_by("to", F.struct("c", "to")).alias("to"))
    best, best_path = materialize(best, "media-pairs")
    links, links_path = materialize(_linked(best, ends), "media-links")
    found = components(links, "id", "to").select(F.col("node").alias("id"), "component")

    member = shared.select("key", "id", "more", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sides = F.ceil(F.col("n") / SIDE).cast("int")
    member = member.withColumn("side", F.pmod(F.xxhash64("id"), sides.cast("long")).cast("int"))
    # Each member meets its own side and all others of its bucket.
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    member = member.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "more", "component")
    member = member.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = member.mapInArrow(_across, "id long, to long").groupBy("id", "to").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
    pairs, pairs_path = materialize(pairs, "media-pairs")

    def apart(found: DataFrame) -> DataFrame:
        """The pairs in different components, which are a and b."""
        x = pairs.join(found.withColumnRenamed("component", "a"), "id", "left")
        x = x.join(found.select(F.col("id").alias("to"), F.col("component").alias("b")), "to", "left")
        x = x.withColumn("a", F.coalesce("a", "id")).withColumn("b", F.coalesce("b", "to")).where("a <> b")
        return x.select("id", "to", "c", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    paths = [classes_path, shared_path, best_path, links_path, pairs_path]
    for likeliest in (True, False):
        tried = apart(found)
        if likeliest:
            tried = tried.groupBy("a", "b").agg(F.max(F.struct("c", "id", "to")).alias("m")).select("m.id", "m.to")
        tried, tried_path = materialize(tried.select("id", "to"), "media-pairs")
        more, more_path = materialize(_linked(tried, ends), "media-links")
        paths += [tried_path, more_path]
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links, "id", "to").select(F.col("node").alias("id"), "component")
    labels = classes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = labels.join(labels.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "least")
    labels, _ = materialize(labels, "media-labels")
    for path in paths:
        discard(spark, path)
    out = described.select("id", "node", (F.octet_length("bits") / (4 * WORDS)).cast("long").alias("n_points")).join(labels, "node", "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    out = out.select(F.col("id").alias(id_col), "n_points", class_id.alias("class_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))


DRAWN = 96


@lru_cache(maxsize=1)
def _fields(size: int) -> np.ndarray:
    """One band-limited random field for each component of a vector."""
    u = _uniform(size * DRAWN * DRAWN) - 0.5
    x = _box(_box(u.reshape(size, DRAWN, DRAWN), 2), 1)
    return (x / x.std()).reshape(size, -1)


def draw(vectors: np.ndarray) -> np.ndarray:
    """Gray images [n, DRAWN, DRAWN] of vectors: alike vectors give alike images."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    field = vectors / np.where(norm > 0, norm, 1) @ _fields(vectors.shape[1])
    return np.clip(np.rint(128 + 45 * field), 0, 255).astype(np.uint8).reshape(-1, DRAWN, DRAWN)


def drawn(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, image) with an image of each vector; a null one, or one with nulls, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.slice(i, 256)
                rows: list[dict | None] = []
                for v in b.column(1).to_pylist():
                    whole = v and all(x is not None and np.isfinite(x) for x in v)
                    rows.append({"height": DRAWN, "width": DRAWN, "channels": 1, "data": draw(np.array([v]))[0].tobytes()} if whole else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "image"])

    some = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("vector"))
    return some.mapInArrow(run, f"{id_col} long, image struct<height: int, width: int, channels: int, data: binary>")
