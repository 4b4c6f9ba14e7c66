"""Decontamination: retrieval and overlap against brute force, short parts, large indexes, odd rows."""

from __future__ import annotations

import math
import random
import re
import resource
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folio.llm import decontam
from folio.llm import kernel as K

S = decontam.Settings()


def plain(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, s=S):
    """(text, item) -> (passages, score, question, answer), from word lists and no index."""
    items = [(i, t, plain(t)) for i, t in items if plain(t)]
    n, df = len(items), Counter(w for _, _, ws in items for w in set(ws))
    mean = sum(len(ws) for _, _, ws in items) / n
    longest = max(len(ws) for _, _, ws in items)

    def bm25(query, ws):
        tf = Counter(ws)
        return sum(
            math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (s.k1 + 1) / (tf[w] + s.k1 * (1 - s.b + s.b * len(ws) / mean))
            for w in query if w in tf
        )

    def runs(ws, k):
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}

    def share(part, passage):
        mine = runs(part, min(3, len(part))) if part else set()
        return len(mine & runs(passage, min(3, len(part)))) / len(mine) if mine else 1.0

    found = {}
    for d, text in texts:
        ws = plain(text)
        for at in range(max(1, -(-len(ws) // longest) - 1)):
            passage = ws[at * longest : (at + 2) * longest]
            for i, t, iw in items:
                score = bm25(set(passage), iw)
                if score >= s.threshold * bm25(set(iw), iw) - 1e-9 and score > 0:
                    q, a = (plain(x) for x in decontam.parts(t))
                    q, a = share(q if len(q) > 2 else iw, passage), share(a, passage)
                    if q >= s.overlap and a >= s.overlap:
                        k, b, bq, ba = found.get((d, i), (0, 0, 0, 0))
                        found[d, i] = (k + 1, max(b, score), max(bq, q), max(ba, a))
    return found


def corpus(rng, n_items, n_texts):
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(4000)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(say(rng.choice([1, 2, 3, 4, 9, 20, 45])))) for i in range(n_items)]
    items += [(n_items + i, " ".join(say(12)) + "? " + " ".join(say(rng.choice([1, 2, 5])))) for i in range(n_items // 2)]
    texts = []
    for d in range(n_texts):
        words = say(rng.choice([0, 5, 60, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            held = rng.choice(items)[1].split()
            if rng.random() < 0.5 and len(held) > 8:
                held[rng.randrange(len(held))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = held
        texts.append((d, " ".join(words)))
    return texts, items


def test_same_as_brute_force(spark):
    texts, items = corpus(random.Random(4), 120, 60)
    for s in (S, decontam.Settings(block=3, threshold=0.3, overlap=0.4), decontam.Settings(threshold=0.9, block=64)):
        docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.passages, r.score, r.question, r.answer) for r in decontam.matches(docs, bench, s).collect()}
        want = brute(texts, items, s)
        assert len(want) > 30 and got.keys() == want.keys()
        for k in want:
            assert np.allclose(got[k], want[k])
        held = {d for d, _ in want}
        assert {r.doc_id for r in decontam.clean(docs, bench, s).collect()} == {d for d, _ in texts} - held


def test_short_parts(spark):
    items = [
        (1, "What is the capital city of France? Paris"), (2, "Which letter comes right after a?\nAnswer: B"), (3, "blue whale"),
        (4, "who wrote hamlet? William Shakespeare"), (5, "Photosynthesis"), (6, "one two three\nA: 2"),
    ]
    texts = [(i, f"some words before it {t} and others behind") for i, t in items]
    texts += [(7, "What is the capital city of France? London"), (8, "who wrote hamlet? Shakespeare William"), (9, "the whale is blue")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(1, 7)}


def test_many_items_in_bounded_memory():
    """50,000 items: a small index, and blocks that are never read."""
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(60_000)]
    rows = rng.zipf(1.2, (50_000, 40)) % 60_000
    items = [(i, " ".join(vocabulary[k] for k in r)) for i, r in enumerate(rows.tolist())]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = decontam.build(items, S)
    held = [11, 4_000, 49_999]
    text = " ".join(items[i][1] for i in held).encode()
    buf = np.frombuffer(text, np.uint8)
    h, first = K.word_hashes(buf, np.array([0, len(buf)]), plain=True)
    assert {int(index.ids[i]) for _, i in decontam.search(index, h, first, S)} >= set(held)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1000
    term = np.unique(np.searchsorted(index.terms, h))
    read = decontam.retrieve(index, np.zeros(len(term), np.int64), term)[3]
    postings = sum(int((t.posts[t.first[term + 1]] - t.posts[t.first[term]]).sum()) for t in index.tiers)
    assert 0 < read < 0.5 * postings


def test_odd_rows(spark, odd, none):
    items = [(1, None), (2, ""), (3, " ?! "), (None, "lorem ipsum lorem ipsum lorem"), (4, "lorem ipsum lorem ipsum"), (4, "lorem ipsum lorem ipsum"), (5, "word"), (6, "中文 текст")]
    bench = spark.createDataFrame([(*r, 1, 0.5) for r in items], "item_id long, text string, doc_id long, score double")
    got = decontam.matches(odd, bench)
    assert got.columns == ["doc_id", "item_id", "passages", "score", "question", "answer"]
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(6, 5), (8, 4), (8, 4), (9, 6)]
    empty = bench.limit(0)
    assert decontam.matches(odd, empty).count() == 0 and decontam.matches(none, bench).count() == 0
    assert decontam.clean(odd, empty).count() == odd.count() and decontam.clean(none, bench).count() == 0
    left = decontam.clean(odd, bench)
    assert left.columns == odd.columns and left.where(F.col("doc_id").isin(6, 8, 9)).count() == 0
    assert left.count() == odd.count() - 3
    one_at_a_time = decontam.matches(odd, bench, decontam.Settings(words=1))
    assert {(r.doc_id, r.item_id) for r in one_at_a_time.collect()} == {(6, 5), (8, 4), (9, 6)}
