"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model for each language, over lower-cased letters with everything else folded into one space.
All languages share the sorted arrays of n-gram keys, so a position costs one search whatever their
number; a text gets the language of the lowest cross-entropy per character. A temperature and
rejection limits are fitted on training texts that the counts don't hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from folio.llm import kernel as K

SPACE = 32
#: Characters of a text that count as evidence in its confidence.
CERTAIN = 400


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: texts of each language to count and to calibrate on. ``order`` is at most 4."""

    order: int = 4
    texts: int = 600
    calibration: int = 150
    reject_deviations: float = 6.0


@dataclass
class Model:
    languages: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)  # for order 1 .. n: sorted n-grams
    logp: list[np.ndarray] = field(default_factory=list)  # [n-gram, language]
    contexts: list[np.ndarray] = field(default_factory=list)  # for order 2 .. n: sorted contexts
    logb: list[np.ndarray] = field(default_factory=list)  # [context, language]: weight of the lower order
    unseen: float = 0.0
    temperature: float = 1.0
    limits: np.ndarray | None = None  # highest cross-entropy accepted, by language


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or a mark; and what it counts as, in 16 bits.

    Letters beyond the first plane share the 6,400 codes of the private area, some hundred to a code.
    """
    import sys
    import unicodedata

    is_letter = np.zeros(0x110000, bool)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha() or c > 0x2FF and unicodedata.category(ch)[0] == "M":
            is_letter[c] = True
    is_letter[0xD800:0xE000] = False
    code = np.arange(0x110000, dtype=np.uint32)
    code[0x10000:] = 0xE000 + code[0x10000:] % 0x1900  # rare planes share the private area's codes
    return is_letter, code.astype(np.uint16)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each text within spaces; its bounds; and its number of letters."""
    is_letter, code = _letters()
    joined = "\n".join(texts).lower() if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Lower-casing keeps "\n" but may change lengths; texts' own line ends are found by counting them.
    ends = np.flatnonzero(points == 10)
    if len(ends) != len(texts) - 1:
        own = np.cumsum([t.count("\n") + 1 for t in texts]) - 1
        ends = ends[own[:-1]]
    bounds = np.concatenate([[0], ends + 1, [len(points) + 1]])
    letter = is_letter[points]
    folded = np.where(letter, code[points], np.uint16(SPACE))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first stays
    keep[ends] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    starts = at[bounds[:-1]]
    stops = at[np.minimum(bounds[1:] - 1, len(points))]
    n_letters = np.concatenate([[0], np.cumsum(letter)])
    counts = n_letters[np.minimum(bounds[1:] - 1, len(points))] - n_letters[bounds[:-1]]
    return folded[keep], np.stack([starts, stops]), counts


def _grams(chars: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of orders 1 .. n ending at each character of the texts, and the text of each character.

    A key packs its characters in 16 bits each, the last one lowest; a text starts after spaces and
    ends with one.
    """
    lens = bounds[1] - bounds[0] + 1
    total = int(lens.sum())
    row = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    at = np.arange(total) - first[row]
    src = bounds[0][row] + at
    inside = at < lens[row] - 1
    c = np.full(total, SPACE, K.U64)
    c[inside] = chars[src[inside]]
    keys = [c]
    prev = c
    for n in range(1, order):
        shifted = np.full(total, SPACE, K.U64)
        shifted[n:] = c[:-n] if n < total else shifted[:0]
        shifted[at < n] = SPACE
        prev = prev | shifted << K.U64(16 * n)
        keys.append(prev)
    return keys, row


def _counted(order: int):  # noqa: ANN202
    """Counts of the highest order's n-grams by language, and nothing else of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs.tolist())):
                some = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                chars, bounds, _ = characters(some)
                keys, _ = _grams(chars, bounds, order)
                u, n = np.unique(keys[-1], return_counts=True)
                cols = [pa.array([lang] * len(u)), pa.array(K.as_long(u)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])

    return run


def build(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Kneser-Ney models from the highest order's counts; lower orders count what may stand before."""
    m = Model(languages, order)
    tables: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    for lang in languages:
        keys, n = counts[lang]
        tables[order - 1][lang] = (keys, n.astype(float))
        for k in range(order - 1, 0, -1):
            keys, n = np.unique(keys & K.U64((1 << 16 * k) - 1), return_counts=True)
            tables[k - 1][lang] = (keys, n.astype(float))
    alphabet = len(np.unique(np.concatenate([t[0] for t in tables[0].values()] or [np.zeros(0, K.U64)]))) + 1
    m.unseen = -np.log(alphabet)
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([t[0] for t in tables[k - 1].values()] or [np.zeros(0, K.U64)]))
        context_of = keys >> K.U64(16)
        contexts, ctx = np.unique(context_of, return_inverse=True)
        if k == 1:
            lower = np.full((len(keys), len(languages)), 1 / alphabet)
        else:
            lower = np.exp(_lookup(m, k - 1, keys & K.U64((1 << 16 * (k - 1)) - 1)))
        p = np.empty((len(keys), len(languages)))
        back = np.ones((len(contexts), len(languages)))
        for i, lang in enumerate(languages):
            own, n = tables[k - 1][lang]
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, own)] = n
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(ctx, c, minlength=len(contexts))
            kinds = np.bincount(ctx, c > 0, minlength=len(contexts))
            with np.errstate(invalid="ignore", divide="ignore"):
                back[:, i] = np.where(total > 0, d * kinds / total, 1.0)
                p[:, i] = np.where(total[ctx] > 0, np.maximum(c - d, 0) / total[ctx], 0) + back[ctx, i] * lower[:, i]
        m.keys.append(keys)
        m.logp.append(np.log(p).astype(np.float32))
        m.contexts.append(contexts)
        m.logb.append(np.log(back).astype(np.float32))
    return m


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_, keys)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == keys


def _lookup(m: Model, k: int, keys: np.ndarray) -> np.ndarray:
    """log P of the last character of order-k keys, for every language."""
    at, ok = _find(m.keys[k - 1], keys)
    out = np.empty((len(keys), len(m.languages)), np.float32)
    out[ok] = m.logp[k - 1][at[ok]]
    rest = np.flatnonzero(~ok)
    if len(rest):
        seen = np.zeros((len(rest), len(m.languages)), np.float32)
        at, ok = _find(m.contexts[k - 1], keys[rest] >> K.U64(16))
        seen[ok] = m.logb[k - 1][at[ok]]
        below = _lookup(m, k - 1, keys[rest] & K.U64((1 << 16 * (k - 1)) - 1)) if k > 1 else m.unseen
        out[rest] = seen + below
    return out


def entropies(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy in nats per character by language, characters, and letters of each text."""
    out = np.zeros((len(texts), len(m.languages)))
    length, letters = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
    sizes = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for i, j in K.blocks(sizes, 1 << 19):
        chars, bounds, letters[i:j] = characters(texts[i:j])
        keys, row = _grams(chars, bounds, m.order)
        n = bounds[1] - bounds[0] + 1
        logp = _lookup(m, m.order, keys[-1])
        first = np.cumsum(n) - n
        out[i:j] = -np.add.reduceat(logp, first, axis=0, dtype=np.float64) / n[:, None]
        length[i:j] = n
    return out, length, letters


def decide(m: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, cross-entropy in bits and rejection of each text.

    The confidence takes a text's mean entropy as the evidence of CERTAIN characters at most: neighbouring
    characters aren't independent, and beyond that every text would be certain. The language is that of the whole text.
    """
    if not m.languages:
        n = len(texts)
        return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    ce, n, letters = entropies(m, texts)
    best = np.argmin(ce, axis=1)
    z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(n, CERTAIN)[:, None] * m.temperature
    score = 1 / np.exp(z).sum(axis=1)
    least = ce[np.arange(len(texts)), best]
    rejected = least > m.limits[best] if m.limits is not None else np.zeros(len(texts), bool)
    none = letters == 0
    score[none], rejected[none] = 0.0, True
    langs = [("und" if x else m.languages[b]) for x, b in zip(none.tolist(), best.tolist(), strict=True)]
    return langs, score, np.where(none, 0.0, least / np.log(2)), rejected


def fit(docs: DataFrame, use: Column, settings: Settings = Settings(), id_col: str = "doc_id") -> Model:
    """Fit on at most ``texts + calibration`` whole texts of each language for which ``use`` holds.

    Rows are taken in the order of a hash of their id; those with a null id, text or lang are passed
    over, repeated rows of an id count each. Only ids, n-gram counts and the calibration texts' entropies come to
    the driver: what is broadcast is bounded by ``texts`` whole texts for each language there is.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & F.col("text").isNotNull() & use)
    spark, most = docs.sparkSession, settings.texts + settings.calibration
    # A language's share of the hashes that holds enough of its rows, twice over; no language's rows meet in one task.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pylist()
    shares = [(r["lang"], min(1.0, (2 * most + 200) / r["n"])) for r in sizes]
    if not shares:
        return Model([], settings.order)
    order = F.xxhash64("id")
    ids = known.select(F.col(id_col).alias("id"), "lang").join(F.broadcast(spark.createDataFrame(shares, "lang string, __share double")), "lang")
    ids = ids.where(order / F.lit(2.0**64) + 0.5 < F.col("__share")).select("lang", order.alias("at"), "id").distinct().toArrow().to_pylist()
    picked, rank = [], Counter()
    for r in sorted(ids, key=lambda r: (r["lang"], r["at"], r["id"])):
        rank[r["lang"]] += 1
        if rank[r["lang"]] <= most:
            picked.append((r["id"], r["lang"], rank[r["lang"]] % 5 == 0))
    ids = spark.createDataFrame(picked, StructType([StructField("id", docs.schema[id_col].dataType), StructField("lang", StringType()), StructField("cal", BooleanType())]))
    some = docs.select(F.col(id_col).alias("id"), "lang", "text").join(F.broadcast(ids), ["id", "lang"])
    counted = some.where(~F.col("cal")).select("lang", "text").mapInArrow(_counted(settings.order), "lang string, gram long, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, grams, n = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n"))
    languages = sorted(set(langs.tolist()))
    counts = {}
    for lang in languages:
        mine = langs == lang
        keys = grams[mine].astype(np.int64).view(K.U64)
        order = np.argsort(keys)
        counts[lang] = (keys[order], n[mine][order])
    m = build(languages, counts, settings.order)
    sent = spark.sparkContext.broadcast(m)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ce, n, letters = entropies(sent.value, [t or "" for t in batch.column(1).to_pylist()])
            ok = letters > 0
            cols = [batch.column(0).filter(pa.array(ok)), pa.array(ce[ok].tolist(), pa.list_(pa.float64())), pa.array(n[ok])]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "ce", "n"])

    cal = some.where("cal").select("lang", "text").mapInArrow(measured, "lang string, ce array<double>, n long").toArrow().to_pylist()
    cal = [r for r in cal if r["lang"] in counts]
    if cal:
        ce, n = np.array([r["ce"] for r in cal]), np.array([r["n"] for r in cal])
        y = np.array([languages.index(r["lang"]) for r in cal])
        z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(n, CERTAIN)[:, None]
        at = np.arange(len(y))
        grid = [2.0**x for x in range(-8, 2)]
        m.temperature = min(grid, key=lambda t: -np.mean(t * z[at, y] - np.log(np.exp(t * z).sum(axis=1))))
        m.limits = np.full(len(languages), np.inf)
        for i in range(len(languages)):
            own = ce[y == i, i]
            if len(own) > 4:
                m.limits[i] = own.mean() + settings.reject_deviations * max(own.std(), 0.02)
    return m


def predict(docs: DataFrame, model: Model, reject: bool = False, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``bits`` per character and ``rejected``.

    A null text or one without letters is ``und`` with score 0; with ``reject`` so is a text whose
    cross-entropy is above its language's limit. Ties go to the language first in the alphabet.
    Columns of ``docs`` of these names are replaced; the text is the only column read. No shuffle.
    """
    added = ["lang_pred", "score", "bits", "rejected"]
    base = docs.drop(*added)
    names, at = [*base.columns, *added], base.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    fields = [*base.schema.fields, *[T.StructField(c, t) for c, t in zip(added, kinds, strict=True)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                b = batch.slice(i, 1000)
                langs, score, bits, rejected = decide(sent.value, [t or "" for t in b.column(at).to_pylist()])
                if reject:
                    langs = ["und" if x else y for x, y in zip(rejected.tolist(), langs, strict=True)]
                cols = [*b.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return base.mapInArrow(run, T.StructType(fields))
