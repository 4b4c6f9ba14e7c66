"""Operators on hand-made rows: values of the published rules, and odd cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import geometry, mrz, text
from folio.image import frames, kernels
from folio.operators import classify, conform, decode, detect, evaluate, store
from folio.sources import files, sinks
from folio.streaming import queue


def value(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) or v is None else 'long'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(c.alias("v")).first().v


EXTERNAL = "P<RUSIVANOV<<PETR<<<<<<<<<<<<<<<<<<<<<<<<<<<\n" + "7515919237RUS" + "8001019M" + "2910027" + "<" * 14 + "<" + "0"


@pytest.mark.parametrize(("payload", "digit"), [("751591923", 0), ("<" * 14, 0), ("AB", 3), ("75159192!", None)])
def test_check_digit(spark, payload, digit):
    assert value(spark, mrz.check_digit(F.col("p")), p=payload) == digit


def test_zone_errors(spark):
    assert value(spark, mrz.validate(F.col("z")).error, z="one line") == "expected 2 lines"
    assert value(spark, mrz.validate(F.col("z")).error, z="a\nB") == "line 2 malformed (len=1)"
    assert value(spark, mrz.validate(F.col("z")).ok, z=None) is False
    v = value(spark, mrz.validate(F.col("z")), z=EXTERNAL)
    assert v.lines == 2 and v.error is None and v.expiry_date in ("ok", "failed") and v.personal_number == "not_applicable"


def test_zone_dates(spark):
    assert value(spark, mrz.date(F.col("d"), True, 2026), d="291002") == "02.10.2029"
    assert value(spark, mrz.date(F.col("d"), False, 2026), d="291002") == "02.10.1929"
    assert value(spark, mrz.date(F.col("d"), False, 2026), d="991399") is None


@pytest.mark.parametrize(("raw", "fixed"), [("O1-O2-2OO3", "01.02.2003"), ("31.02.2011", "31.02.2011"), ("15 ОКТЯБРЯ 2020 Г.", "15 ОКТЯБРЯ 2020 Г."), ("1-2", "1.2")])
def test_fix_date(spark, raw, fixed):
    assert value(spark, text.fix_date(F.col("r")), r=raw) == fixed


def test_field_corrections(spark):
    assert value(spark, text.sex_en(F.col("r")), r=".m.") == "M" and value(spark, text.sex_en(F.col("r")), r="") == "F"
    assert value(spark, text.sex_ru(F.col("r")), r="муж") == "М" and value(spark, text.driver_class(F.col("r")), r="B, C1 x") == "BC1"
    assert value(spark, text.strip_dots(F.col("r")), r="..A.") == "A."
    assert value(spark, text.clean_ruler(F.col("r")), r="28., ИЮЛЯ 2010 . II-МЮ") == "28 ИЮЛЯ 2010 II-МЮ"
    assert value(spark, text.clean_ruler(F.col("r")), r='Г. ИРКУТСК, "" ОБЛ') == "Г. ИРКУТСК, ОБЛ"


@pytest.mark.parametrize(("token", "is_number"), [("12", True), ("12A", True), ("1AB", False), ("", False), (None, False), ("д5", True)])
def test_number_token(spark, token, is_number):
    assert value(spark, text.is_number_token(F.col("t")), t=token) is is_number


def test_numbers_and_names(spark):
    assert [value(spark, text.number(F.col("x")), x=x) for x in (0.123456789, 0.93123, 0.4812345, math.inf)] == [0.1235, 0.9312, 0.4812, None]
    assert value(spark, text.safe_filename(F.col("n")), n="c:\\a\\b?.png") == "b.png" and value(spark, text.safe_filename(F.col("n")), n="<>") == "upload"
    assert value(spark, text.doc_base(F.col("t")), t="INTPASSPORT_2011") == "INTPASSPORT" and value(spark, text.doc_era(F.col("t")), t="NONE") is None
    assert [value(spark, text.ladder(F.col("x"), [64, 128, 256]), x=x) for x in (1, 65, 256, 257, 385)] == [64, 128, 256, 384, 512]


def test_error_rate(spark):
    assert value(spark, text.cer(F.col("p"), F.col("t")), p="ШАЛ", t="ШАЛЬ") == 0.25
    assert value(spark, text.cer(F.col("p"), F.col("t")), p="x", t="  ") is None
    assert value(spark, text.cer(F.col("p"), F.col("t"), "number"), p="1 2.3", t="123") == 0.0


def test_decoding(spark):
    steps = [[0, 9, 1], [0, 9, 1], [9, 1, 1], [1, 0, 9]]
    m = spark.createDataFrame([([[float(x) for x in s] for s in steps],)], "m array<array<double>>")
    assert m.select(decode.ctc_text(F.col("m"), "AB").alias("v")).first().v == "AB"
    assert m.select(decode.ctc_text(F.col("m"), "AB", allowed=[2]).alias("v")).first().v == "BB"


def test_join_words(spark):
    rows = [(1, "Birth_date", i, w) for i, w in enumerate(["22", "06", "2010"])] + [(2, "Issue_date", i, w) for i, w in enumerate(["15", "ОКТЯБРЯ", "2020"])]
    rows += [(3, "MRZ", 0, "A<"), (3, "MRZ", 1, ""), (3, "MRZ", 2, "B<"), (4, "Name", 1, "b"), (4, "Name", 0, None)]
    got = {r.doc_id: r.text for r in decode.join_words(spark.createDataFrame(rows, "doc_id long, field string, pos int, word string")).collect()}
    assert got == {1: "22.06.2010", 2: "15 ОКТЯБРЯ 2020", 3: "A<\nB<", 4: "b"}


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, det_idx int, x1 int, y1 int, x2 int, y2 int, conf double, label string")


def test_suppression(spark):
    b = boxes(spark, [(1, 0, 0, 0, 10, 10, 0.5, "a"), (1, 1, 1, 1, 11, 11, 0.9, "a"), (1, 2, 1, 1, 11, 11, 0.8, "b"), (1, 3, 50, 50, 50, 60, 0.7, "a"), (2, 0, 0, 0, 9, 9, 0.1, "a")])
    kept = lambda d: sorted((r.doc_id, r.det_idx) for r in d.collect())
    assert kept(detect.suppress(b, 0.2)) == [(1, 1), (1, 2), (1, 3), (2, 0)]
    assert kept(detect.suppress(b, 0.2, by_label=False)) == [(1, 1), (1, 3), (2, 0)]
    assert kept(detect.suppress(b, 0.2, own={"a": 0.9})) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert kept(detect.dedup_fields(boxes(spark, [(1, 0, 0, 0, 1, 1, 0.6, "Licence_number"), (1, 1, 0, 0, 1, 1, 0.9, "Licence_number")]))) == [(1, 1)]


def test_reading_order(spark):
    rows = [(50, 1, 60, 11), (0, 0, 10, 10), (0, 20, 10, 30), (30, 22, 40, 32)]
    out = detect.reading_order(boxes(spark, [(1, i, *r, 0.5, "a") for i, r in enumerate(rows)]))
    assert [r.det_idx for r in out.orderBy("rank").collect()] == [1, 0, 2, 3]


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(p, i, *xy, xy[0] + 12, xy[1] + 12, float(c), "a") for p in range(4) for i, (xy, c) in enumerate(zip(rng.integers(0, 40, (25, 2)).tolist(), rng.random(25).round(1), strict=True))]

    def over(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return max(w, 0) * max(h, 0) / (288 - max(w, 0) * max(h, 0))

    want = []
    for p in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], r[1])):
            if all(over(k, r) < 0.3 for k in kept):
                kept.append(r)
        want += [(p, r[1]) for r in kept]
    out = detect.suppress(boxes(spark, rows), 0.3)
    assert out.columns == boxes(spark, rows).columns and sorted((r.doc_id, r.det_idx) for r in out.collect()) == sorted(want)


def test_nearest_centroid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.1]), (4, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.label for r in classify.nearest_centroid(v, [("a", [1.0, 0.0], 0.5), ("b", [1.0, 1.0], 0.2)], 1.0).collect()}
    assert got == {1: "a", 2: "NONE", 3: "NONE"}


def test_centroids_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(classify, "CENTROID_BYTES", 15)
    with pytest.raises(ValueError):
        classify.nearest_centroid(spark.createDataFrame([], "vec_id long, embedding array<double>"), [("a", [1.0, 0.0], 0.5)], 1.0)


def test_quality_levels(spark):
    p = spark.createDataFrame([(1, "GLARE", 0.9), (1, "CLEAR", 0.9), (2, "GLARE", 0.85), (3, "NonBlur", 1.0), (3, "Blur5", 1.0), (4, "x", 1.0)], "doc_id long, cls string, conf double")
    glare = {r.doc_id: (r.level, r.verdict) for r in classify.glare_level(p).collect()}
    assert glare[1] == (0.5, "bad") and glare[2] == (0.0, "good")
    blur = {r.doc_id: (r.level, r.verdict) for r in classify.blur_level(p).collect()}
    assert blur[3] == (0.25, "bad") and blur[4] == (1.0, "good")


def test_json_differences(spark):
    g = {"a": 1, "b": [1, 2], "boxes": [{"x1": 10, "conf": 0.904, "cls": 3}], "s": "x", "n": None, "only": 1}
    a = {"a": "1", "b": [1], "boxes": [{"x1": 11, "conf": 0.903, "cls": 4}], "s": "y", "n": None, "new": {"k": 1}}
    leaves = lambda v: conform.leaves(spark.createDataFrame([(1, json.dumps(v))], "id long, j string"), "id", "j")
    found = lambda profile, **k: {(r.path, r.kind) for r in conform.differences(leaves(g), leaves(a), ["id"], profile, **k).collect()}
    want = {("a", "type"), ("b", "length"), ("boxes[0].cls", "value"), ("s", "value"), ("only", "missing"), ("new", "extra")}
    assert found("gpu") == want and found("cpu") == want | {("boxes[0].x1", "value")}
    assert ("s", "value") not in found("cpu", ignored=["^s$"])
    assert {r.kind for r in conform.leaves(spark.createDataFrame([(1, "{")], "id long, j string"), "id", "j").collect()} == {"invalid"}


def test_leaf_names(spark):
    assert [value(spark, conform.leaf(F.col("p")), p=p) for p in ("boxes[3].x1", "fields.bbox[11][2]", "words.Name.bbox[0][1][4]", "ocr", "list[3]")] == ["x1", "x2", "conf", "ocr", "list"]


@pytest.mark.parametrize("descending", [True, False])
def test_pages_after_a_row(spark, descending):
    rows = [(i, "done", None if i % 4 == 0 else float(i % 3)) for i in range(23)]
    log = spark.createDataFrame(rows, "id long, status string, doc_conf double")
    value, last, got = float("inf") if descending else float("-inf"), 1 << 40, []
    while True:
        found = store.page_after(log, store.Listing(sort_by="doc_conf", descending=descending, page_size=5), value, last).collect()
        if not found:
            break
        got += [r.id for r in found]
        value, last = found[-1].doc_conf, found[-1].id
    whole = store.page(log, store.Listing(sort_by="doc_conf", descending=descending, page_size=100)).orderBy("rank")
    assert got == [r.id for r in whole.collect()] and len(got) == 23


def test_store_rules(spark):
    with pytest.raises(ValueError):
        store.page(spark.range(1), store.Listing(page_size=0))
    log = spark.createDataFrame([(1, "queued", 5), (2, "queued", 5), (3, "queued", 9), (4, "done", 1)], "id long, status string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    assert dict(store.queue_positions(log).collect()) == {1: 0, 2: 0, 3: 2}
    spread = [(i, "queued", t) for i, t in enumerate([7200, 10, 7200, 3599, 3600, None, 90_000, 10])]
    late = spark.createDataFrame(spread, "id long, status string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    times = [t for _, _, t in spread]
    assert dict(store.queue_positions(late).collect()) == {i: sum(u < t for u in times if u is not None) for i, t in enumerate(times) if t is not None}
    assert store.next_queued(log).first().id == 1
    none = log.where("false")
    assert dict(store.count_by_status(none).collect()) == dict.fromkeys(store.STATUSES, 0)


def test_timing_totals(spark):
    t = spark.createDataFrame([(1, 500, False), (1, 250, True), (1, 200, True)], "doc_id long, ms long, concurrent boolean")
    assert evaluate.timing_totals(t).first().total_ms == 750


def test_image_kernels():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert kernels.resized_shape(2999, 1777, 1500) == (1499, 888)
    assert kernels.shrink(x, 100) is x and kernels.shrink(x, 30).shape == (20, 30, 3)
    framed, ratio, left, top = kernels.letterbox(x, 64, 64)
    assert framed.shape == (64, 64, 3) and abs(ratio - 64 / 60) < 1e-9 and left == 0 and top == 10
    assert kernels.word_tensor(np.zeros((0, 5, 3), np.uint8)).shape == (1, 3, 32, 16) and kernels.word_tensor(x).shape == (1, 3, 32, 48)
    assert kernels.thumbnail(np.full((50, 200, 3), 7, np.uint8)).shape == (24, 96, 3)
    box = np.array([10, 10, 8, 4, 0.0])
    assert abs(kernels.oriented_iou(box, box) - 1) < 1e-9 and kernels.oriented_iou(box, box + [20, 0, 0, 0, 0]) == 0
    assert abs(kernels.oriented_iou(box, box + [4, 0, 0, 0, 0]) - 1 / 3) < 1e-9
    assert kernels.suppress_oriented(np.array([box, box, box + [9, 0, 0, 0, 0]]), np.array([0.1, 0.9, 0.5]), 0.5) == [1, 2]
    assert len(kernels.tiles(900, 1200)) == 28


def test_outlines():
    m = np.zeros((20, 30), np.uint8)
    m[5:15, 8:25] = 255
    m[0, 0] = 255
    o = kernels.longest_outline(m)
    assert len(o) == 2 * (10 + 17) - 4 and o[:, 0].min() == 8 and o[:, 1].max() == 14
    q = kernels.quad(o)
    assert np.allclose(q, [(8, 5), (24, 5), (24, 14), (8, 14)])
    image = np.zeros((20, 30, 3), np.uint8)
    image[5:15, 8:25] = 200
    assert (kernels.rectified(image, q) == 200).all()
    assert kernels.expanded(q, 0.1, 20, 30).min() >= 0 and kernels.area(q) == 16 * 9
    assert kernels.stitched([image, image], np.array([[0, 0], [0, 9]])).shape == (40, 30, 3)
    both = kernels.masks(np.array([[9.0]]), np.ones((1, 10, 10)), np.array([[0, 0, 5, 5]]), (20, 20), 1.0, 0, 0)
    assert both.shape == (1, 20, 20) and (both[0, :5, :5] == 255).all() and both.sum() == 25 * 255


def test_deskew():
    page = np.full((120, 120), 255.0)
    page[20:100:10, 15:105] = 0
    page[21:100:10, 15:105] = 0
    assert abs(kernels.skew(kernels.rotated(page, 4.0)) + 4) < 1.1 and kernels.skew(page) == pytest.approx(0, abs=0.6)
    image, angle = kernels.deskewed(page.astype(np.uint8), scale=1.0)
    assert abs(angle) < 2 and (image == page).all()


def png(x):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + r.tobytes() for r in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_frames(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (12, 20, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"no image")
    images = frames.read(spark, str(tmp_path)).withColumn("doc_id", F.col("error").cast("long"))
    rows = {r.error: r for r in frames.digests(frames.swap_channels(images)).collect()}
    assert bytes(rows[False].image.data) == x.tobytes() and rows[True].image is None
    assert [r.image.height for r in frames.upright(images.where("not error"), 1).collect()] == [20]
    assert frames.thumbnails(frames.shrink(images, 10)).where("thumbnail.width = 96").count() == 1
    b = spark.createDataFrame([(0, 0, 2, 3, 8, 9), (0, 1, 5, 5, 5, 9)], "doc_id long, det_idx int, x1 int, y1 int, x2 int, y2 int")
    assert [(r.patch.height, r.patch.width) for r in frames.crops(images, b).collect()] == [(6, 6)]
    assert frames.tiles(images).count() == 28
    models = frames.Registry()
    models.register("mean", lambda: lambda batch: [None if i is None else float(i.mean()) for i in batch], "double")
    got = {r.error: r["mean"] for r in models.predict(images, "mean").collect()}
    assert got[True] is None and got[False] == pytest.approx(x.mean())
    with pytest.raises(KeyError):
        models.predict(images, "other")


def test_sources(spark, tmp_path):
    d = tmp_path / "DL_2011"
    d.mkdir()
    (d / "one.json").write_text(json.dumps({"Name": "A", "Empty": ""}))
    (d / "bad.json").write_text("{")
    (d / "one.JPG").write_bytes(b"\xff\xd8\xff")
    (d / "one.txt").write_text("0 0.5 0.5 0.1 0.2\nnot a label\n")
    rows = {(r.doctype, r.stem, r.field, r.truth) for r in files.ground_truth(spark, str(tmp_path)).collect()}
    assert rows == {("DL_2011", "one", "Name", "A"), ("DL_2011", "bad", None, None)}
    assert [(r.doctype, r.stem, r.length) for r in files.sample_images(spark, str(tmp_path)).collect()] == [("DL_2011", "one", 3)]
    assert [(r.cls, r.h) for r in files.yolo_labels(spark, str(tmp_path)).collect()] == [(0, 0.2)]
    from pyspark.sql import types as T

    good, bad = files.record_store(spark, str(tmp_path), T.StructType([T.StructField("Name", T.StringType())]))
    assert [r.Name for r in good.collect()] == ["A"] and bad.count() == 1
    with pytest.raises(KeyError):
        files.alphabet({}, "x")


def test_table_sink(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.put(spark.createDataFrame([(1, "queued", None), (2, "done", "r2")], "id long, status string, result string"))
    t.put(spark.createDataFrame([(2, "failed", None), (3, "done", "r3")], "id long, status string, result string"))
    assert {tuple(r) for r in t.read().collect()} == {(1, "queued", None), (2, "failed", "r2"), (3, "done", "r3")}
    t.drop(spark.createDataFrame([(1,)], "id long"))
    assert t.read().count() == 2
    t.replace(t.read())
    assert (t.vacuum(), t.vacuum(), t.vacuum(0), t.read().count()) == (2, 0, 1, 2)
    series = str(tmp_path / "bench")
    sinks.append_benchmark(spark, series, spark.createDataFrame([("a", 1.0)], "k string, v double"), "k", "v")
    assert sinks.append_benchmark(spark, series, spark.createDataFrame([("a", 2.0)], "k string, v double"), "k", "v").first().v == 1.5
    assert sinks.stage_dump([("x", spark.range(1)), ("y", spark.range(2)), ("z", spark.range(3))], str(tmp_path / "d"), "y") == ["x", "y"]


def test_queue_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    jobs = spark.createDataFrame([(1, 0, None, False), (2, 0, "CUDA", True), (3, 2, "CUDA", True), (4, 0, "bad", False)], "id long, retry_count int, error string, transient boolean")
    jobs.write.parquet(str(folder))
    stream = spark.readStream.schema(jobs.schema).parquet(str(folder))
    queue.drain(stream, lambda d: queue.outcome(d, 2), str(out), str(tmp_path / "c")).awaitTermination()
    got = {r.id: (r.status, r.retry_count) for r in spark.read.parquet(str(out)).collect()}
    assert got == {1: ("done", 0), 2: ("queued", 1), 3: ("failed", 2), 4: ("failed", 0)}


def test_running_means(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.01), ("b", 1, 2.0)], "stage string, ts long, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = queue.running_means(stream, "stage", "v").writeStream.format("memory").queryName("means").outputMode("update")
    q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.stage: (round(r.ema, 6), r.n) for r in spark.table("means").collect()}
    batch = {r.stage: round(r.ema, 6) for r in evaluate.moving_average(rows, "stage", "v", ["ts"]).collect()}
    assert got == {k: (v, 2 if k == "a" else 1) for k, v in batch.items()} and batch["b"] == round(0.6 * 0.7 + 2 * 0.3, 6)


def test_geometry(spark):
    p = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((9, 8), (1, 2), (8, 1), (2, 9))])
    got = spark.range(1).select(geometry.ordered_corners(p).alias("v")).first().v
    assert [(q.x, q.y) for q in got] == [(1, 2), (8, 1), (9, 8), (2, 9)]
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(x)).alias("y")) for x in range(3)])
    row = spark.range(1).select(geometry.polygon_area(line).alias("a"), geometry.polygon_centroid(line).alias("c"), geometry.hausdorff(line, F.slice(line, 1, 0)).alias("h")).first()
    assert row.a == 0 and row.c.x == 1 and math.isinf(row.h)


def test_moving_average_of_a_long_history(spark):
    rows = [(1, i, float(i % 7)) for i in range(500)]
    want = 0.6
    for _, _, v in rows:
        want = want * 0.7 + max(v, 0.05) * 0.3
    rows += [(2, 0, None), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "k long, at long, v double").repartition(7)
    got = {r.k: (r.ema, r.n) for r in evaluate.moving_average(df, "k", "v", ["at"]).collect()}
    assert got == {1: (pytest.approx(want, abs=1e-9), 500), None: (pytest.approx(0.72), 1)}
    ends = [evaluate.moving_average(df.where("k = 1"), "k", "v", ["at"], keep=k).first().ema for k in (0.0, 1.0)]
    assert ends == [pytest.approx(2.0), pytest.approx(0.6)]
    assert evaluate.moving_average(df.limit(0), "k", "v", ["at"]).count() == 0


def test_reading_order_of_pages(spark):
    rng = np.random.default_rng(4)
    rows = [(p, i, *xy, xy[0] + 10, xy[1] + 12, 0.5, "a") for p in range(5) for i, xy in enumerate(rng.integers(0, 60, (9, 2)).tolist())]
    got = {(r.doc_id, r.det_idx): r.rank for r in detect.reading_order(boxes(spark, rows)).collect()}
    for p in range(5):
        mine = [r for r in rows if r[0] == p]
        lines = []
        for r in sorted(mine, key=lambda r: (r[3] + r[5]) / 2):
            y = (r[3] + r[5]) / 2
            for line in lines:
                if abs(y - sum((q[3] + q[5]) / 2 for q in line) / len(line)) < 6:
                    line.append(r)
                    break
            else:
                lines.append([r])
        order = [r[1] for line in lines for r in sorted(line, key=lambda r: r[2])]
        assert [got[p, i] for i in order] == list(range(1, 10))
