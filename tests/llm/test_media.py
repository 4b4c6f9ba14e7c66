"""Media copies: planted edits, brute force over all pairs, odd rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import media

IMAGE = "image struct<height: int, width: int, channels: int, data: binary>"


def row(i, x):
    return (i, (x.shape[0], x.shape[1], 1, np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()))


def resized(x, f):
    k = int(x.shape[0] * f)
    return media._scaled(x[None].astype(float), k, k)[0]


def cropped(x, f):
    k = round(x.shape[0] * f)
    at = (x.shape[0] - k) // 3
    return x[at : at + k, at : at + k]


RNG = np.random.default_rng(5)
EDITS = {
    "crop 75 %": lambda x: cropped(x, 0.75),
    "crop 60 %": lambda x: cropped(x, 0.6),
    "noise": lambda x: x + RNG.normal(0, 6, x.shape),
    "contrast": lambda x: (x.astype(float) - 128) * 0.7 + 140,
    "turn": np.rot90,
    "scale 0.8": lambda x: resized(x, 0.8),
    "scale 1.25": lambda x: resized(x, 1.25),
    "scale 0.65": lambda x: resized(x, 0.65),  # between two levels
}


def test_planted_edits(spark):
    n = 40
    base = media.draw(np.random.default_rng(8).normal(size=(n, 64)))
    rows = [row(i, x) for i, x in enumerate(base)]
    rows += [row(1000 * (e + 1) + i, edit(x)) for e, edit in enumerate(EDITS.values()) for i, x in enumerate(base)]
    df = spark.createDataFrame(rows, f"i long, {IMAGE}")
    got = {r.i: r.class_id for r in media.copies(df, "i", F.col("image")).collect()}
    assert all(got[i] == i for i in range(n))  # no two pictures are one
    recall = {name: np.mean([got[1000 * (e + 1) + i] == i for i in range(n)]) for e, name in enumerate(EDITS)}
    print(recall)
    assert all(share >= (0.3 if name == "scale 0.65" else 0.9) for name, share in recall.items())
    assert all(c % 1000 == i % 1000 for i, c in got.items())  # nothing false


def test_same_links_as_all_pairs(spark, monkeypatch):
    """The classes are those that comparing every two images gives, in one side and on several."""
    base = media.draw(np.random.default_rng(9).normal(size=(9, 64)))
    images = {i: np.rint(x).astype(np.uint8) for i, x in enumerate(base)}
    images |= {20 + i: np.clip(np.rint(x + RNG.normal(0, 3, x.shape)), 0, 255).astype(np.uint8) for i, x in enumerate(base[:4])}
    images |= {40 + i: np.ascontiguousarray(cropped(x, 0.75)) for i, x in enumerate(base[:6])}
    seen = {i: media.points(x[None])[0] for i, x in images.items()}
    home = {i: i for i in images}
    for a, b in itertools.combinations(sorted(images), 2):
        if media.agreeing(seen[a], seen[b]) >= media.AGREE:
            old, new = max(home[a], home[b]), min(home[a], home[b])
            home = {i: new if c == old else c for i, c in home.items()}
    df = spark.createDataFrame([row(i, x) for i, x in images.items()], f"i long, {IMAGE}")
    for side in (media.SIDE, 1):
        monkeypatch.setattr(media, "SIDE", side)
        assert {r.i: r.class_id for r in media.copies(df, "i", F.col("image")).collect()} == home


@pytest.mark.parametrize("size", [5, 90])
def test_buckets_headed_by_strangers(size):
    """Alike members of a bucket meet whoever else is in it."""
    rng = np.random.default_rng(7)
    more = rng.integers(0, 1 << 62, size)
    more[-1] = more[-2]
    n = np.arange(size)
    cols = [np.zeros(size, int), np.zeros(size, int), np.zeros(size, int), np.zeros(size, int), n, more, n]
    names = "key lo hi side id more component".split()
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in cols], names=names) for i in range(0, size, 7)]
    pairs = [tuple(p.values()) for b in media._across(iter(batches)) for p in b.to_pylist()]
    want = [(b, a) for a, b in itertools.combinations(range(size), 2) if int(more[a] ^ more[b]).bit_count() <= media.LOOSE]
    assert sorted(pairs) == sorted(want) and (size - 1, size - 2) in pairs


def test_odd_images(spark):
    big = np.kron(media.draw(np.random.default_rng(3).normal(size=(4, 64))).reshape(2, 192, 96).transpose(1, 0, 2).reshape(192, 192), np.ones((8, 12), np.uint8))
    assert media.gray(*big.shape, 1, big.tobytes()).shape == (512, 768)
    flat = np.full((64, 64), 9, np.uint8)
    x, y = media.draw(np.random.default_rng(4).normal(size=(2, 64)))
    rows = [row(1, big), row(2, big[: 192 * 8, 200:]), row(3, flat), row(4, flat), row(5, x), row(5, x), row(6, x), row(7, y), row(7, x), row(None, x)]
    rows += [(8, None), (9, (5, 5, 1, b"short")), (10, (0, 4, 1, b"")), (11, (4, 4, 1, bytes(16))), (12, (1, 5000, 1, bytes(5000))), (13, (None, 4, 1, None))]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"i long, {IMAGE}, id long, digest string, component long")
    got = media.copies(df, "i", F.col("image"))
    assert got.columns == ["i", "n_points", "class_id", "kept"]
    runs = [sorted(map(tuple, media.copies(d, "i", F.col("image")).collect()), key=str) for d in (df, df.repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    by = {r[0]: r[2] for r in runs[0]}
    assert by[2] == 1 and by[4] == 3 and by[6] == 5 and {r[2] for r in runs[0] if r[0] == 7} == {5, 7} and by[None] is None and all(by[i] == i for i in (8, 9, 10, 11, 12, 13))
    assert media.copies(df.limit(0), "i", F.col("image")).count() == 0
    assert media.drawn(spark.createDataFrame([(1, None), (2, [1.0, None]), (None, [0.0, 0.0])], "v long, e array<float>"), "v", "e").where("image is null").count() == 2
