"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts gives the examples and the vocabulary; a term weighs more the more
it is associated with the label, and none is left out for a weak association. Every text is a query:
the bound of a block of examples is the sum of its terms' block maxima; the blocks of the highest
bounds are scored first, then those of the others that can reach the k-th best, so the neighbours are
exactly the nearest. Their votes, weighted by cosine, go
through a calibration fitted on other labelled texts of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import kernel as K


#: Blocks of the highest bounds that are scored first.
FIRST = 16
#: Chi-square that a term without association counts as, and the power of the weight by association.
LEAST, SHARPNESS = 0.1, 2


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: labelled texts of each class, of those to calibrate on, and terms kept.

    A term whose chi-square is ``least_chi2`` has a quarter of its TF-IDF weight; none is dropped for it.
    """

    examples: int = 2000
    calibration: int = 2000
    terms: int = 20_000
    least_chi2: float = 24.0
    neighbours: int = 15
    block: int = 64
    threshold: float = 0.7


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    bounds: np.ndarray  # [term, block] highest weight
    starts: np.ndarray  # [term, block + 1] into the postings
    example: np.ndarray  # postings: example, weight
    weight: np.ndarray
    ids: np.ndarray  # of the examples, and their labels
    toxic: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]  # raw vote -> probability
    settings: Settings


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's terms, words and their first five bytes, with repeats; and the row of each."""
    starts, ends, first = K.words(buf, offsets, plain=True)
    if not len(starts):
        return np.zeros(0, K.U64), np.zeros(0, np.int64)
    prefix = K.prefix_hash(buf)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    long_ = ends - starts > 5
    stem = K.mix(K.span_hash(prefix, starts[long_], starts[long_] + 5) ^ K.U64(0x51ED270B))
    return np.concatenate([K.span_hash(prefix, starts, ends), stem]), np.concatenate([row, row[long_]])


def _by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with counts, ordered by row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = K.text_buffer(batch.column(2))
        for i, j in K.blocks(offsets):
            row, h, n = _by_row(*_terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            cols = [batch.column(0)[i:j], batch.column(1)[i:j]]
            cols += [K.binary_column([h[a:b].tobytes() for a, b in pairs]), K.binary_column([n[a:b].astype("<i4").tobytes() for a, b in pairs])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "toxic", "terms", "n"])


def _weights(row: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    w = (1 + np.log(n)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=rows))
    return w / norm[row]


def _known(row: np.ndarray, h: np.ndarray, n: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(vocabulary):
        return row[:0], np.zeros(0, np.int64), n[:0]
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    ok = vocabulary[at] == h
    return row[ok], at[ok], n[ok]


def build(ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> Model:
    """Vocabulary and index of examples given as (row, term, count)."""
    u, term = np.unique(h, return_inverse=True)
    rows, pos = len(ids), int(toxic.sum())
    a = np.bincount(term, toxic[row], minlength=len(u))
    df = np.bincount(term, minlength=len(u)).astype(float)
    b, c, d = df - a, pos - a, rows - pos - (df - a)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Corrected for continuity, as most terms are rare.
        apart = np.maximum(np.abs(a * d - b * c) - rows / 2, 0)
        chi2 = np.nan_to_num(rows * apart**2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    keep = np.sort(np.lexsort((u, -df, -chi2))[: s.terms])
    # No term is left out for a weak association: it only weighs less, so any word in common is searched.
    chi2 = chi2[keep] + LEAST
    vocabulary = u[keep]
    idf = (np.log((1 + rows) / (1 + df[keep])) + 1) * (chi2 / (chi2 + s.least_chi2)) ** SHARPNESS
    row, term, n = _known(row, h, n, vocabulary)
    w = _weights(row, term, n, idf, rows)
    # Examples alike stand together, which makes the blocks' maxima tight: by their heaviest term.
    top = np.full(rows, len(vocabulary))
    order = np.lexsort((term, -w, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    top[row[first]] = term[first]
    rank = np.empty(rows, np.int64)
    rank[np.lexsort((ids, top))] = np.arange(rows)
    example = rank[row]
    blocks = -(-rows // s.block) if rows else 0
    order = np.lexsort((example, term))
    term, example, w = term[order], example[order], w[order]
    bounds = np.zeros((len(vocabulary), blocks))
    np.maximum.at(bounds, (term, example // s.block), w)
    cell = term * (blocks + 1) + example // s.block
    starts = np.searchsorted(cell, np.arange(len(vocabulary) * (blocks + 1))).reshape(len(vocabulary), blocks + 1)
    back = np.argsort(rank)
    return Model(vocabulary, idf, bounds, starts.astype(np.int32), example.astype(np.int32), w, ids[back], toxic[back], (np.array([0.0]), np.array([0.0])), s)


def nearest(m: Model, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The examples of highest positive cosine to a query, best first (ties: lower id), and the cosines."""
    k = m.settings.neighbours
    bound = w @ m.bounds[terms]
    left = np.argsort(-bound, kind="stable")
    left = left[bound[left] > 0]
    starts = m.starts[terms]
    best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
    # The blocks of highest bounds give the k-th best that all others must reach; those that may are scored at once.
    for some in (left[:FIRST], left[FIRST:]):
        if len(best_s) == k:
            some = some[bound[some] >= best_s[-1] - 1e-12]
        if not len(some):
            break
        lo = starts[:, some]
        n = (starts[:, some + 1] - lo).ravel()
        flat = np.repeat(lo.ravel() - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        score = np.bincount(m.example[flat], np.repeat(np.repeat(w, len(some)), n) * m.weight[flat], minlength=len(m.ids))
        got = np.flatnonzero(score > (max(best_s[-1] - 1e-9, 0) if len(best_s) == k else 0))
        if len(got) > 4 * k:
            got = got[score[got] >= np.partition(score[got], len(got) - k)[len(got) - k] - 1e-9]
        best_i, best_s = np.concatenate([best_i, got]), np.concatenate([best_s, score[got]])
        order = np.lexsort((m.ids[best_i], -np.round(best_s, 12)))[:k]
        best_i, best_s = best_i[order], best_s[order]
    return best_i, best_s


def vote(m: Model, near: np.ndarray, cosine: np.ndarray) -> float:
    """Distance-weighted share of toxic neighbours; a text near nothing has 0."""
    if not len(near):
        return 0.0
    w = cosine**2
    return float((w * m.toxic[near]).sum() / w.sum() * cosine.max() ** 0.25)


def calibrate(raw: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators, each pool shrunk by a twentieth of a row of either label."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # [positives, rows, sum of raw]
    for x, y in zip(raw[order].tolist(), toxic[order].tolist(), strict=True):
        pools.append([y, 1, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    x = np.array([p[2] / p[1] for p in pools])
    y = np.maximum.accumulate([(p[0] + 0.05) / (p[1] + 0.1) for p in pools])
    return x, y


def fit(docs: DataFrame, labels: DataFrame, use: Column, settings: Settings = Settings(), id_col: str = "doc_id") -> Model:
    """Fit on at most ``2 * examples + calibration`` labelled rows for which ``use`` holds.

    Rows are taken in the order of a hash of their id; null labels and ids are passed over, and
    other labels than 1 count as 0; of the rows of one id one is taken. A quarter of the hashes calibrates: without
    labelled rows, or none of that quarter, every score is 0. Texts count whole, null ones as empty.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & use)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.withColumn("__order", F.xxhash64("id"))
    calibration = F.pmod(F.col("__order"), F.lit(4)) == 0
    part = lambda c, n: known.where(c).orderBy("__order", "id").limit(n)
    some = part(calibration, settings.calibration).withColumn("kind", F.lit(2))
    for y in (0, 1):
        some = some.unionByName(part(~calibration & (F.col("toxic") == y), settings.examples).withColumn("kind", F.lit(y)))
    some = some.select("id", (F.col("toxic") + F.when(F.col("kind") == 2, 2).otherwise(0)).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(some), "id").select("id", "toxic", "text")
    got = rows.mapInArrow(_features, "id long, toxic int, terms binary, n binary").toArrow().to_pylist()
    # Of an id's rows one is taken, the same in every run.
    got = {r["id"]: r for r in sorted(got, key=lambda r: (r["id"], r["terms"], r["n"]), reverse=True)}
    got = [got[i] for i in sorted(got)]

    def flat(some: list[dict]) -> tuple[np.ndarray, ...]:
        h = [np.frombuffer(r["terms"], K.U64) for r in some]
        row = np.repeat(np.arange(len(some)), [len(x) for x in h])
        n = [np.frombuffer(r["n"], "<i4") for r in some]
        ids, y = np.array([r["id"] for r in some], np.int64), np.array([r["toxic"] & 1 for r in some], np.int64)
        return ids, y, row, np.concatenate(h or [np.zeros(0, K.U64)]), np.concatenate(n or [np.zeros(0, np.int32)])

    m = build(*flat([r for r in got if r["toxic"] < 2]), settings)
    ids, y, row, h, n = flat([r for r in got if r["toxic"] >= 2])
    if len(ids):
        raw = np.array([v for v, _, _ in _votes(m, row, h, n, len(ids))])
        m.knots = calibrate(raw, y)
    return m


def _votes(m: Model, row: np.ndarray, h: np.ndarray, n: np.ndarray, rows: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    row, term, n = _known(row, h, n, m.vocabulary)
    w = _weights(row, term, n, m.idf, rows)
    cuts = np.searchsorted(row, np.arange(rows + 1)).tolist()
    nothing = (0.0, np.zeros(0, np.int64), np.zeros(0))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            out.append(nothing)
            continue
        near, cosine = nearest(m, term[a:b], w[a:b])
        out.append((vote(m, near, cosine), near, cosine))
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", evidence: bool = True) -> DataFrame:
    """Add ``score``, ``predicted`` and, with ``evidence``, the nearest examples as (id, toxic, cosine).

    A null, empty or termless text gets the score of texts near no example. Columns of ``docs`` of
    these names are replaced; repeated rows score alike. No shuffle: the index, bounded by the
    settings, is sent to all executors.
    """
    base = docs.drop("score", "predicted", "evidence")
    names, at = base.columns, base.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    near_type = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    fields = [*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    names = [*names, "score", "predicted", *["evidence"] * evidence]
    near_arrow = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            buf, offsets = K.text_buffer(batch.column(at))
            for i, j in K.blocks(offsets):
                h, row = _terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(m.vocabulary):
                    near_ = np.searchsorted(m.vocabulary, h)
                    near_[near_ == len(m.vocabulary)] = 0
                    ok = m.vocabulary[near_] == h
                    h, row = h[ok], row[ok]
                votes = _votes(m, *_by_row(h, row), j - i)
                p = np.interp([v for v, _, _ in votes], *m.knots)
                cols = [c[i:j] for c in batch.columns]
                cols += [pa.array(p), pa.array((p >= m.settings.threshold).astype(np.int32))]
                if evidence:
                    found = [
                        [{"id": x, "toxic": y, "cosine": z} for x, y, z in zip(m.ids[n].tolist(), m.toxic[n].tolist(), c.tolist(), strict=True)]
                        for _, n, c in votes
                    ]
                    cols.append(pa.array(found, near_arrow))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return base.mapInArrow(run, T.StructType(fields + [T.StructField("evidence", near_type)] * evidence))
