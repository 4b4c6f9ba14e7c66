"""Benchmark decontamination: training passages query a BM25 index of test items.

The items are the indexed documents, every training passage (a window of words) is a query. The
inverted index is block-max: items stand in blocks, postings in cells (term, block), each with its
highest weight. Search is WAND by blocks: terms whose highest weights together can't reach the lowest
threshold open no block; a block whose cells' maxima can't reach its own is skipped unread; what is
left is scored exactly, so all (passage, item) pairs at or above the threshold are retrieved. Each is
then verified: the passage must hold enough of the item's question and of its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import kernel as K


@dataclass(frozen=True)
class Settings:
    """``threshold`` is a share of an item's score against itself; ``overlap`` of its word triples."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    overlap: float = 0.6
    block: int = 16
    #: Words of the items of one index, some 50 bytes each: bounds what the driver builds and broadcasts. More items
    #: are indexed apart, and each index is one pass over the texts; an item beyond it stands alone.
    words: int = 2_000_000


@dataclass
class Tier:
    """Blocks of items whose thresholds are within a factor of two."""

    cells: np.ndarray  # term * blocks + block, sorted
    first: np.ndarray  # [term + 1] into the cells
    most: np.ndarray  # highest weight of a cell
    posts: np.ndarray  # [cell + 1] into the postings
    item: np.ndarray
    weight: np.ndarray
    top: np.ndarray  # [term] highest weight of all cells
    least: np.ndarray  # [block] lowest threshold
    items: np.ndarray  # [block + 1] first item


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    tiers: list[Tier]
    least: np.ndarray  # threshold of each item
    ids: np.ndarray
    question: list[np.ndarray]  # sorted hashes of the word triples
    answer: list[np.ndarray]
    window: int
    short: tuple[int, ...]  # lengths, of one or two words, that parts have


def _triples(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of three words; fewer words make one run."""
    return _runs(h, min(len(h), 3))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, three at most; a run of fewer than three has its length in its hash."""
    if n < 3:
        second = h[1:] * K.U64(0x9E3779B97F4A7C15) if n == 2 else K.U64(0)
        return K.mix(h[: len(h) - n + 1] + second + K.U64(n)) if len(h) >= n > 0 else h[:0]
    return K.mix(h[:-2] + h[1:-1] * K.U64(0x9E3779B97F4A7C15) + h[2:] * K.U64(0xC2B2AE3D27D4EB4F))


def _held(h: np.ndarray, short: tuple[int, ...]) -> np.ndarray:
    """Sorted hashes of a passage's word triples, and of its shorter runs where an item's part is as short."""
    return np.unique(np.concatenate([_triples(h), *[_runs(h, n) for n in short]]))


def parts(text: str) -> tuple[str, str]:
    """An item's question and answer: cut after the last '?', else at an answer mark, else in the middle."""
    for mark in ("\nAnswer:", "\nA:", "Answer:"):
        if mark in text:
            q, _, a = text.partition(mark)
            return q, a
    q, found, a = text.rpartition("?")
    if found and a.strip():
        return q + found, a
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def build(items: list[tuple[int, str]], s: Settings) -> Index:
    """Index of (id, text) items; items without words are left out, repeated ids stay apart.

    A question of one or two words says little: such an item's question is the whole item.
    """
    hashed = []
    for i, text in items:
        buf = np.frombuffer(text.encode(), np.uint8)
        h, _ = K.word_hashes(buf, np.array([0, len(buf)]), plain=True)
        if len(h):
            q, a = (np.frombuffer(x.encode(), np.uint8) for x in parts(text))
            hq, ha = (K.word_hashes(x, np.array([0, len(x)]), plain=True)[0] for x in (q, a))
            hq = hq if len(hq) > 2 else h
            hashed.append((i, h, np.unique(_triples(hq)), np.unique(_triples(ha)), {len(hq), len(ha)} & {1, 2}))
    n = len(hashed)
    lens = np.array([len(x[1]) for x in hashed], np.int64)
    item = np.repeat(np.arange(n), lens)
    terms, term = np.unique(np.concatenate([x[1] for x in hashed] or [np.zeros(0, K.U64)]), return_inverse=True)
    cell, tf = np.unique(term * max(n, 1) + item, return_counts=True)
    term, item = cell // max(n, 1), cell % max(n, 1)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * lens[item] / lens.mean())) if n else np.zeros(0)
    least = s.threshold * np.bincount(item, weight, minlength=n)
    # Items alike in threshold stand together, so a block's lowest is near its others'.
    order = np.lexsort((np.arange(n), least))
    place = np.argsort(order)
    hashed, least, item = [hashed[i] for i in order], least[order], place[item]
    band = np.floor(np.log2(np.maximum(least, 1e-12)))
    edges = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), n]
    tiers = [_tier(term, item, weight, least, len(terms), lo, hi, s.block) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if lo < hi]
    return Index(
        terms, tiers, least, np.array([x[0] for x in hashed], np.int64), [x[2] for x in hashed], [x[3] for x in hashed],
        int(lens.max()) if n else 1, tuple(sorted(set().union(*[x[4] for x in hashed]))),
    )


def _tier(
    term: np.ndarray, item: np.ndarray, weight: np.ndarray, least: np.ndarray, terms: int, lo: int, hi: int, size: int
) -> Tier:
    """The postings of items ``lo`` to ``hi`` in cells."""
    mine = (item >= lo) & (item < hi)
    term, item, weight = term[mine], item[mine], weight[mine]
    blocks = -(-(hi - lo) // size)
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    cell = term * blocks + (item - lo) // size
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    most, cells = np.maximum.reduceat(weight, starts), cell[starts]
    top = np.zeros(terms)
    np.maximum.at(top, term, weight)
    items = np.minimum(lo + np.arange(blocks + 1) * size, hi)
    first = np.searchsorted(cells, np.arange(terms + 1) * blocks)
    return Tier(cells, first, most, np.append(starts, len(cell)), item, weight, top, least[items[:-1]], items)


def _runs_of(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each run, ``many`` of each."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def retrieve(index: Index, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(window, item, score) of all pairs at or above the item's threshold, and the number of postings read.

    Queries are (window, term) rows, each once, in the order of windows.
    """
    out, read = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    begins = np.flatnonzero(np.diff(window, prepend=-1)) if len(window) else np.zeros(0, np.int64)
    # As many windows at once as bound the cells that are opened; one window alone may need more.
    work = np.append(begins, len(window)) if not index.tiers else np.concatenate(
        [[0], np.cumsum(np.add.reduceat(sum(t.first[term + 1] - t.first[term] for t in index.tiers) + 1, begins))] if len(begins) else [[0]]
    )
    ends = np.append(begins, len(window))
    for i, j in K.blocks(work, 1 << 19):
        for tier in index.tiers:
            w, item, score, n = _opened(tier, window[ends[i] : ends[j]], term[ends[i] : ends[j]])
            good = score >= index.least[item] - 1e-9
            out.append((w[good], item[good], score[good]))
            read += n
    return *(np.concatenate(x) for x in zip(*out, strict=True)), read


def _opened(t: Tier, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(window, item, score) of the items of the blocks of a tier that bounds can't rule out."""
    blocks, lowest = len(t.least), t.least[0] - 1e-9
    top = t.top[term]
    window, term, top = window[top > 0], term[top > 0], top[top > 0]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
    if not len(window):
        return none
    # Weakest terms first: as long as they together stay below every threshold, they open no block.
    order = np.lexsort((top, window))
    window, term, top = window[order], term[order], top[order]
    begins = np.flatnonzero(np.diff(window, prepend=-1))
    row = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(window))))
    total = np.cumsum(top)
    total -= np.append(0.0, total)[begins][row]
    opens = total >= lowest
    if not opens.any():
        return none
    weak = np.bincount(row[~opens], top[~opens], minlength=len(begins))
    lo, many = t.first[term[opens]], np.diff(t.first)[term[opens]]
    cell = _runs_of(lo, many)
    key = np.repeat(row[opens], many) * blocks + t.cells[cell] % blocks
    keys, at = np.unique(key, return_inverse=True)
    bound = np.bincount(at, t.most[cell], minlength=len(keys))
    may = bound + weak[keys // blocks] >= t.least[keys % blocks] - 1e-9
    keys = keys[may]
    if not len(keys):
        return none
    # What is left, against the cells of all terms of its window.
    ends = np.append(begins, len(window))
    mine = keys // blocks
    many = ends[mine + 1] - ends[mine]
    asked = term[_runs_of(ends[mine], many)] * blocks + np.repeat(keys % blocks, many)
    owner = np.repeat(np.arange(len(keys)), many)
    cell = np.minimum(np.searchsorted(t.cells, asked), len(t.cells) - 1)
    has = t.cells[cell] == asked
    cell, owner = cell[has], owner[has]
    open_ = np.bincount(owner, t.most[cell], minlength=len(keys)) >= t.least[keys % blocks] - 1e-9
    cell, owner = cell[open_[owner]], owner[open_[owner]]
    size = int(np.diff(t.items).max())
    many = t.posts[cell + 1] - t.posts[cell]
    post = _runs_of(t.posts[cell], many)
    spot = np.repeat(owner, many) * size + t.item[post] - t.items[np.repeat(keys[owner] % blocks, many)]
    score = np.bincount(spot, t.weight[post], minlength=len(keys) * size)
    hit = np.flatnonzero(score > 0)
    k = hit // size
    return window[begins][mine[k]], t.items[keys[k] % blocks] + hit % size, score[hit], len(post)


def _share(part: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(part, held, assume_unique=True).mean()) if len(part) else 1.0


def search(
    index: Index, h: np.ndarray, first: np.ndarray, s: Settings
) -> dict[tuple[int, int], tuple[int, float, float, float]]:
    """Items that passages of texts (word hashes, first word of each) hold.

    (text, item) -> (passages, score, question, answer). Passages are windows of two longest items,
    moved on by one, so every item stands whole in one. A query's terms count once in a passage.
    """
    found: dict[tuple[int, int], tuple[int, float, float, float]] = {}
    if not len(index.terms) or not len(h):
        return found
    at = np.searchsorted(index.terms, h)
    at[at == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[at] == h)
    if not len(hit):
        return found
    step, words = index.window, np.diff(first)
    term, row = at[hit], np.searchsorted(first, hit, "right") - 1
    # Window w of a text starts at word w * step; a word lies in windows w and w - 1.
    windows = np.maximum(-(-words // step) - 1, 1)
    base = np.concatenate([[0], np.cumsum(windows)])
    pos = hit - first[row]
    w = pos // step
    order = np.lexsort((hit, term, row))
    same = (row[order][1:] == row[order][:-1]) & (term[order][1:] == term[order][:-1])
    before = np.full(len(hit), -1)
    before[order[1:][same]] = pos[order[:-1][same]]
    late = (before < w * step) & (w < windows[row])
    early = (before < (w - 1) * step) & (w > 0)
    window = np.concatenate([(base[row] + w)[late], (base[row] + w - 1)[early]])
    in_window = np.concatenate([term[late], term[early]])
    order = np.argsort(window, kind="stable")
    window, in_window = window[order], in_window[order]
    held: dict[int, np.ndarray] = {}
    for at_, i, score in zip(*(x.tolist() for x in retrieve(index, window, in_window)[:3]), strict=True):
        text = int(np.searchsorted(base, at_, "right")) - 1
        if at_ not in held:
            start = int(first[text] + (at_ - base[text]) * step)
            held[at_] = _held(h[start : min(start + 2 * step, int(first[text + 1]))], index.short)
        q, a = _share(index.question[i], held[at_]), _share(index.answer[i], held[at_])
        if q >= s.overlap and a >= s.overlap:
            n, best, bq, ba = found.get((text, i), (0, 0.0, 0.0, 0.0))
            found[text, i] = (n + 1, max(best, score), max(bq, q), max(ba, a))
    return found


_OUT = "passages long, item_id long, score double, question double, answer double"


def matches(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, passages, score, question, answer) of every item that a text holds.

    ``score`` is the highest BM25 score of its verified passages, ``question`` and ``answer`` the
    highest shares of the item's word triples. Words are lower-cased and without ASCII punctuation.
    Null, empty and wordless texts match nothing, nor do items with a null id or text or without words; no items or no
    texts give no rows. Repeated rows match each on its own, repeated items each under its id; equal scores are all
    kept. Texts of any length are searched whole, window by window; columns of other names are not read. No shuffle:
    a text is read once for each index of at most ``settings.words`` words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for sent in _indexes(docs, benchmark, settings):
        part = rows.mapInArrow(_searched(sent, settings), f"doc_id long, {_OUT}")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "item_id", "passages", "score", "question", "answer")


def _indexes(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> list:
    """Broadcast indexes of all items, each of ``settings.words`` words or so."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")))).first()[0] or 0
    lots, out = max(1, -(-words // settings.words)), []
    for lot in range(lots):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot) if lots > 1 else items
        got = sorted((r["item_id"], r["text"]) for r in some.toArrow().to_pylist())
        out.append(docs.sparkSession.sparkContext.broadcast(build(got, settings)))
    return out


def _searched(sent, s: Settings):  # noqa: ANN001, ANN202
    names = ["doc_id", *[x.split()[0] for x in _OUT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            buf, offsets = K.text_buffer(batch.column(1))
            for i, j in K.blocks(offsets):
                h, first = K.word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], plain=True)
                at, rows = [], []
                for (k, item), (n, score, q, a) in search(index, h, first, s).items():
                    at.append(i + k)
                    rows.append((n, int(index.ids[item]), score, q, a))
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their other columns are. No shuffle.

    Rows with a null, empty or wordless text stay, as all do where there are no items; repeated rows stay or go together.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    for sent in _indexes(docs, benchmark, settings):
        docs = docs.mapInArrow(_kept(sent, settings, names, at), docs.schema)
    return docs


def _kept(sent, s: Settings, names: list[str], at: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.text_buffer(batch.column(at))
            keep = np.ones(len(batch), bool)
            for i, j in K.blocks(offsets):
                h, first = K.word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], plain=True)
                keep[[i + k for k, _ in search(sent.value, h, first, s)]] = False
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(keep))

    return run
