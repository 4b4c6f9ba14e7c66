"""The training-data operators against brute force, and on odd rows and empty tables."""

from __future__ import annotations

import binascii
import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, ctw, graph, langid, minhash, shard, suffix, toxicity
from folio.llm.queries import id_remainder

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# --- 1 ---------------------------------------------------------------------------------------


def test_shards_are_gapless_and_grow_into_the_new_one(spark, docs):
    rows = shard.assign(docs).collect()
    assert len(rows) == docs.count() and all(r.law == "key" and 0 <= r.shard < 16 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == binascii.crc32(texts[r.doc_id].encode()) for r in rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)


def test_slots_do_not_depend_on_buckets(spark, docs):
    tree = shard.Tree.regular()
    key = F.col("doc_id").cast("string")
    placed = shard.place(docs.select("doc_id"), key, tree, "shard")
    a, b = (dict(shard.slots(placed, "shard", key, ["doc_id"], n).select("doc_id", "slot").collect()) for n in (3, 40))
    assert a == b


def test_weights_rule_the_shares(spark):
    tree = shard.Tree((((3.0, 1.0),), ((2.0, 2.0),)))
    n = dict(shard.place(spark.range(8000), F.col("id").cast("string"), tree, "s").groupBy("s").count().collect())
    assert [round(n[i] / 1000) for i in range(4)] == [3, 1, 2, 2]
    grown = tree.grow(weight=4.0)
    moved = shard.place(shard.place(spark.range(8000), F.col("id").cast("string"), tree, "s"), F.col("id").cast("string"), grown, "g")
    assert moved.where("g <> s and g <> 4").count() == 0 and abs(moved.where("g = 4").count() / 8000 - 1 / 3) < 0.03


# --- 2 ---------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, odd, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for df in (odd, docs):
        coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
        got = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
        assert len(got) == df.count()
        for r in got:
            want = enc.encode_ordinary(r.text or "")
            assert r.token_ids == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- 3 ---------------------------------------------------------------------------------------


# --- 6 ---------------------------------------------------------------------------------------


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("side", "side_bytes"), [(1024, 32 << 20), (3, 32 << 20), (1024, 600)])
def test_near_duplicates(spark, docs, side, side_bytes, monkeypatch):
    monkeypatch.setattr(minhash, "SIDE", side)
    monkeypatch.setattr(minhash, "SIDE_BYTES", side_bytes)
    base = [f"w{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]
    # A family of edits, some of which only chains connect.
    for k in range(40):
        w = list(base)
        for j in range(k % 11):
            w[(7 * j + 3 * k) % 60] = f"x{k}_{j}"
        rows.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got[2][1:] == (1, False) and got[3] == (0, 3, True) and got[5] == (0, 5, True) and got[6] == (1, 6, True)
    assert got[None][1:] == (None, True) and got[7][1:] == (7, True)
    assert minhash.near_duplicates(none).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5)], "a long, b long")
    got = dict(graph.components(chain, "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 7 ---------------------------------------------------------------------------------------


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        mark, end = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[max(p, end) : p + length] = b"\1" * (p + length - max(p, end))
                end = p + length
            else:
                seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[i] = (len(b), sum(mark), sum(mark[p] and not (p and mark[p - 1]) for p in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot"), [(1000, 100_000), (7, 100_000), (7, 12), (30, 2)])
def test_repeats(spark, docs, block, hot, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_ROWS", block)
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(80).collect())
    line = "a line that many documents share, and which is longer than a hundred bytes, so that it goes from all but one of them. "
    rows += [(20_000 + i, f"{i} starts so; {line}{'z' * (i * 9)} ends so {i}") for i in range(30)] + [(30_000, "ab" * 300), (30_001, "é" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, with_text=False).collect()}
    assert got == removed(rows)


def test_repeats_of_odd_rows(odd, none):
    out = suffix.remove_repeats(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [r.text for r in rows if r.doc_id == 4] == [""]
    assert next(r for r in rows if r.doc_id == 8).n_removed > 40_000
    assert suffix.remove_repeats(none).count() == 0


def test_merge_never_reorders():
    rng = np.random.default_rng(7)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(1, 12)).tolist()) for _ in range(rng.integers(0, 30))) for _ in range(6)]
    coded = [suffix.front_code(r) for r in runs]
    for r, c in zip(runs, coded, strict=True):
        assert [s for s, _ in suffix.front_decode(*c)] == r
    merged = list(suffix.merge_runs([((s, h, None) for s, h in suffix.front_decode(*c)) for c in coded]))
    assert [m[0] for m in merged] == sorted(s for r in runs for s in r)
    for (a, _, _), (b, h, _) in zip(merged, merged[1:], strict=False):
        assert h == suffix.common_prefix(a, b)


# --- 8 ---------------------------------------------------------------------------------------


def test_languages(spark, docs):
    model = langid.fit(docs, id_remainder(5) != 0)
    got = langid.predict(docs, model).collect()
    held = [r for r in got if binascii.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    letters = [int(k) for k in model.keys[0]]
    for context in model.contexts[3][:: max(1, len(model.contexts[3]) // 20)]:
        keys = np.array([int(context) << 16 | c for c in [*letters, 0x4E00]], np.uint64)
        assert np.allclose(np.exp(langid._lookup(model, 4, keys)).sum(axis=0), 1, atol=1e-4)


def test_languages_of_odd_rows(odd, none, spark):
    model = langid.fit(odd, F.lit(True))
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[3].score == 0
    assert rows[1].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predict(odd, langid.fit(none, F.lit(True))).where("lang_pred = 'und'").count() == odd.count()


# --- 9 ---------------------------------------------------------------------------------------


def labelled(spark):
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        w = list(rng.choice(words, 30)) + (list(rng.choice(["vile", "scum", "fool"], 3)) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    labels += [(5, None), (None, 1), (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, id_remainder(3) != 1)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if binascii.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.predicted == (r.doc_id % 4 == 0) and r.predicted == (r.score >= 0.7) for r in held)
    assert all(r.evidence and r.evidence[0].toxic == 1 for r in held if r.predicted)
    odd_rows = toxicity.score(odd, model).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.score < 0.7 for r in odd_rows)
    empty = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert toxicity.score(docs, empty).where("score <> 0").count() == 0


def test_toxicity_of_few_labels_searches_every_word(spark):
    texts = [(i, "vile scum" if i < 8 else "kind words") for i in range(16)] + [(20, "such scum"), (21, "more words"), (22, "no match here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), toxicity.Settings(calibration=0))
    got = {r.doc_id: {e.toxic for e in r.evidence} for r in toxicity.score(docs, model).collect()}
    assert (got[20], got[21], got[22]) == ({1}, {0}, set())


def test_nearest_is_exact(spark):
    docs, labels = labelled(spark)
    m = toxicity.fit(docs, labels, F.lit(True), toxicity.Settings(least_chi2=0.0, neighbours=5, block=8))
    rng, n = np.random.default_rng(1), m.bounds.shape[1]
    full = np.zeros((len(m.ids), len(m.vocabulary)))
    for t in range(len(m.vocabulary)):
        at = slice(m.starts[t, 0], m.starts[t, n])
        full[m.example[at], t] = m.weight[at]
    for _ in range(100):
        terms = np.sort(rng.choice(len(m.vocabulary), 6, False))
        w = rng.random(6)
        s = full[:, terms] @ w
        want = [i for i in np.lexsort((m.ids, -np.round(s, 12)))[:5] if s[i] > 0]
        assert toxicity.nearest(m, terms, w)[0].tolist() == want


# --- 10 --------------------------------------------------------------------------------------


def test_unigram_baseline(docs):
    got = {r.doc_id: r for r in ctw.score(docs, id_remainder(5) != 1).collect()}
    words = {r.doc_id: [*tokens(r.text), None] for r in docs.collect()}
    counts = collections.Counter()
    for i, w in words.items():
        if binascii.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in words.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0


def brute_ctw(codes):
    """Predictive bits of a code by recursion over the trees, straight from the definition."""
    depth, seen, children = ctw.DEPTH, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    context = lambda c: tuple(c >> 8 * k & 255 for k in range(depth, 0, -1))

    def steps(c):
        node = 1
        for s in range(7, -1, -1):
            bit = (c & 255) >> s & 1
            yield node, bit
            node = 2 * node + bit

    for c in codes:
        for node, bit in steps(c):
            for k in range(depth + 1):
                seen[node, context(c)[depth - k :]][bit] += 1
    for node, ctx in list(seen):
        if ctx:
            children[node, ctx[1:]].add(ctx)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_p(node, ctx):
        own = log_kt(*seen[node, ctx])
        return own if len(ctx) == depth else np.logaddexp(own, sum(log_p(node, k) for k in children[node, ctx])) - math.log(2)

    def predict(node, ctx, k=0):
        a, b = seen[node, ctx[depth - k :]]
        own = (b + 0.5) / (a + b + 1)
        if k == depth or (node, ctx[depth - k - 1 :]) not in seen:
            return own
        below = sum(log_p(node, x) for x in children[node, ctx[depth - k :]])
        share = 1 / (1 + math.exp(max(-700, min(700, below - log_kt(a, b)))))
        return share * own + (1 - share) * predict(node, ctx, k + 1)

    def bits(c):
        return -sum(math.log2(p if bit else 1 - p) for node, bit in steps(c) for p in [predict(node, context(c))])

    return bits


def test_context_trees():
    text = b"the cat sat on the mat; the dog sat on the log; the end of it."
    codes, first = ctw.codes_of(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert first.tolist() == [0, len(text) + 1] and (codes[: len(text) + 1] == codes[len(text) + 1 :]).all()
    codes = codes[: len(text) + 1]
    u, n = np.unique(codes, return_counts=True)
    levels = ctw.grow(u, n)
    top = ctw.crown(levels[0].node, levels[0].zeros, levels[0].ones, levels[0].log_p)
    bits = brute_ctw(codes.tolist())
    some = np.concatenate([codes[::9], codes[::11] ^ np.uint64(3 << 24), [np.uint64(0x010203040541)]])
    assert np.allclose(ctw.code_lengths(some, levels, top), [bits(int(c)) for c in some], atol=1e-3)
    every = (codes[20] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert abs(np.exp2(-ctw.code_lengths(every, levels, top).astype(float)).sum() - 1) < 1e-4
    assert (ctw.unsqueeze(ctw.squeeze(u)) == u).all()


def test_scores_of_odd_rows(odd, none):
    rows = ctw.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count()
    empty = next(r for r in rows if r.doc_id == 3)
    assert empty.n_tokens == 1 and empty.n_known == 1
    assert ctw.score(none, F.lit(True)).count() == 0
    assert all(math.isfinite(r.score) for r in ctw.score(odd, F.lit(False)).collect())


@pytest.mark.parametrize("f", [lambda d: shard.assign(d), lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN)])
def test_odd_and_empty_tables(odd, none, f):
    assert f(odd).count() == odd.count() and f(none).count() == 0
