"""Language identification and toxicity on tables without rows, without labels and with odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folio.llm import langid, toxicity


def test_languages_of_odd_and_no_rows(spark, odd, none):
    model = langid.fit(odd, F.lit(True))
    assert model.languages == ["de", "en"]
    assert langid.predict(none, model).count() == 0
    got = langid.predict(odd, model)
    assert set(odd.columns) - {"score"} < set(got.columns) and got.count() == odd.count()
    rows = [(r.doc_id, r.lang_pred, r.score) for r in got.collect()]
    assert all(p == "und" and s == 0 for i, p, s in rows if i in (3, 4, 5)) and all(0 <= s <= 1 for _, _, s in rows)
    assert len({(p, s) for i, p, s in rows if i == 7}) == 1
    blank = langid.fit(none, F.lit(True))
    assert blank.languages == [] and {r.lang_pred for r in langid.predict(odd, blank).collect()} == {"und"}


def test_toxicity_of_odd_and_no_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        model = toxicity.fit(docs, marks, F.lit(True))
        assert toxicity.score(none, model).count() == 0
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1


def test_calibration_rises():
    rng = np.random.default_rng(1)
    raw = rng.random(200).round(2)
    x, y = toxicity.calibrate(raw, (rng.random(200) < raw).astype(int))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] <= y[-1] < 1
