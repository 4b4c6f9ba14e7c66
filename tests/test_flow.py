"""The recognition flow, record changes, keys, settings and checks beyond what the queries' SQL covers."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import mrz, text
from folio.operators import conform, flow, store
from folio.session import shared_dir


def test_address_pages_without_lines_are_rejected(spark):
    types = spark.createDataFrame([(1, "INTPASSPORTADDR_ALL", 0.9), (2, "INTPASSPORTADDR_ALL", 0.9), (3, "DL_2020", 0.8), (4, None, None)], "doc_id long, doc_type string, conf double")
    lines = spark.createDataFrame([(1,), (1,)], "doc_id long")
    got = {r.doc_id: (r.doc_type, r.conf) for r in flow.without_address(types, lines).collect()}
    assert got == {1: ("INTPASSPORTADDR_ALL", 0.9), 2: ("NONE", 0.0), 3: ("DL_2020", 0.8), 4: (None, None)}


def test_unknown_types_are_read_again(spark):
    first = spark.createDataFrame([(1, "NONE", 0.0, 0), (2, "NONE", 0.0, 0), (3, "DL_2020", 0.9, 90), (4, "NONE", 0.1, 0)], "doc_id long, doc_type string, conf double, angle int")
    second = spark.createDataFrame([(1, "INTPASSPORT_2011", 0.98, 180), (2, "NONE", 0.0, 0), (3, "SNILS_1996", 0.9, 0)], "doc_id long, doc_type string, conf double, angle int")
    got = {r.doc_id: (r.doc_type, r.angle, r.recovered, r.max_pages) for r in flow.recovered(first, second).collect()}
    assert got == {1: ("INTPASSPORT_2011", 180, True, 2), 2: ("NONE", 0, True, 1), 3: ("DL_2020", 90, False, 1), 4: ("NONE", 0, False, 1)}


def test_type_and_angle(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "doc_id long, embedding array<double>")
    scores = spark.createDataFrame([(1, [0.1, 0.7, 0.1, 0.1]), (2, [0.2, 0.4, 0.4, 0.0])], "doc_id long, scores array<double>")
    got = {r.doc_id: (r.doc_type, r.conf, r.angle) for r in flow.type_and_angle(v, [("a", [1.0, 0.0], 0.6), ("b", [0.0, 1.0], 0.6)], scores).collect()}
    assert got[1] == ("a", 1.0, 90) and got[2][0] == "NONE" and got[2][2] == 90


def test_created_records_are_numbered_on(spark):
    log = spark.createDataFrame([(7, "a", 1)], "id long, filename string, created_at long")
    new = spark.createDataFrame([(f"n{i:03d}", i) for i in range(100)], "filename string, created_at long").repartition(5)
    got = {r.filename: r.id for r in store.create(log, new).collect()}
    assert got == {"a": 7, **{f"n{i:03d}": 8 + i for i in range(100)}}
    assert store.create(log.limit(0), new).agg(F.min("id"), F.max("id")).first() == (1, 100)
    assert store.create(log, new.limit(0)).count() == 1


def test_vacuous_payloads(spark):
    rows = [(1, None), (2, " null "), (3, "{ }"), (4, '{"a": null, "b": null}'), (5, '{"a": null, "b": {"c": 1}}'), (6, '{"a": {"b": null}}'), (7, "0"), (8, "not json")]
    got = {r.i: r.why for r in spark.createDataFrame(rows, "i int, p string").select("i", conform.vacuous(F.col("p")).alias("why")).collect()}
    assert got[1] == got[2] == "golden is null" and got[3] == "golden is an empty dict" and got[4] == "every value in the golden is null"
    assert got[5] is None and got[6] is None and got[7] is None and got[8] is None


def test_stage_index(spark, tmp_path):
    for case in ("one", "two"):
        (tmp_path / case / "stages").mkdir(parents=True)
        for name in ("words", "join"):
            (tmp_path / case / "stages" / f"{name}.json").write_text('{"a": 1}')
        (tmp_path / case / "case.json").write_text("{}")
    got = [(r.case, r.ord, r.stage, r.payload) for r in conform.stage_index(spark, str(tmp_path)).orderBy("case", "ord").collect()]
    assert got == [(c, o, s, '{"a": 1}') for c in ("one", "two") for o, s in ((1, "join"), (2, "words"))]


def test_checks_of_dates_and_zones(spark):
    rows = [("01.02.1990", "01.02.2010"), ("31.02.1990", "01.02.2010"), ("01.02.2010", "01.02.1990"), (None, None), ("01.02.1990", None)]
    df = spark.createDataFrame(rows, "b string, i string")
    today = F.lit(datetime.date(2024, 1, 1))
    got = [tuple(r.v) for r in df.select(text.date_checks(F.col("b"), F.col("i"), today, 14).alias("v")).collect()]
    assert got[0] == ("ok", "ok", "ok") and got[1][0] == "failed" and got[2] == ("ok", "failed", "failed")
    assert got[3] == ("not_applicable",) * 3 and got[4] == ("ok", "not_applicable", "not_applicable")
    zones = spark.createDataFrame([(None,), (" \n ",), ("a\nb",)], "z string")
    assert [r.v is None for r in zones.select(mrz.entry(F.col("z")).alias("v")).collect()] == [True, True, False]
    snils = spark.createDataFrame([("112-233-445 95",), ("112-233-445-95",), ("112-233-445 96",), ("000-000-001 77",), ("12",), (None,)], "s string")
    assert [r.v for r in snils.select(text.snils_verdict(F.col("s")).alias("v")).collect()] == ["ok", "ok", "failed", "ok", "malformed", None]
    assert spark.range(1).select(text.plain_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))).alias("j")).first().j == '{"a":1,"b":null}'


def test_clusters_need_a_shared_folder():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("Context", (), {"master": master, "getConf": staticmethod(dict)})

    with pytest.raises(RuntimeError):
        shared_dir(Session("spark://host:7077"))
    assert shared_dir(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local) and shared_dir(local).startswith("file://")


def test_frames_of_quality_tiles(spark):
    from folio.image import frames, kernels

    rows = [(i, (int(h), int(w))) for i, (h, w) in enumerate(np.random.default_rng(2).integers(1, 900, (20, 2)))]
    df = spark.createDataFrame([*rows, (99, (0, 5)), (98, None)], "doc_id long, image struct<height: int, width: int>")
    got = {}
    for r in frames.tiles(df).collect():
        got.setdefault(r.doc_id, {})[r.tile] = (r.x, r.y)
    assert got == {i: dict(enumerate(kernels.tiles(h, w))) for i, (h, w) in rows}
