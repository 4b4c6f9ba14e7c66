"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A byte is eight binary decisions, and each of the 255 nodes of that decision tree has a context tree
of its own over the bytes before, ``DEPTH`` of them. Every node of a context tree has a
Krichevsky-Trofimov estimate; the weighted probability of a node mixes, half and half, its own
estimate with the product of its children's, so all depths take part, each as far as the training
bytes bear it out. The counts are exact, cover all training texts and are never gathered in one
place: nodes of two bytes and deeper live in PARTS parts, by their last two bytes; only the nodes
above, 65,536 contexts of 255 decisions at most, come to the driver. Blocks of documents ask the
parts for the code lengths of the contexts they hold, each once however often a block holds it.

Beside it goes a word unigram baseline, whose exact counts of all training words stay distributed
in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import kernel as K
from folio.llm.store import discard, materialize

DEPTH = 5
#: Depth above which nodes are shared by all parts.
TOP = 2
PARTS = 256
#: Starts and ends a text; UTF-8 has no such byte.
EDGE = 0xFF
#: Documents of a block, and blocks that one group of a part answers.
BLOCK_ROWS, GROUP_BLOCKS = 1500, 1000


def codes_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH bytes before, byte) of every byte and end of the rows in one word, the byte lowest;
    and each row's first code. A text is preceded by edges and followed by one."""
    n = np.diff(offsets)
    rows, size = len(n), int(offsets[-1] - offsets[0])
    gap = DEPTH + 1
    padded = np.full(size + gap * rows, EDGE, K.U64)
    firsts = offsets[:-1] - offsets[0] + gap * np.arange(rows)
    inner = np.arange(size) + np.repeat(gap * np.arange(rows) + DEPTH, n)
    padded[inner] = buf[offsets[0] : offsets[-1]]
    at = np.arange(size + rows) + np.repeat(DEPTH * np.arange(1, rows + 1), n + 1)
    code = np.zeros(len(at), K.U64)
    for d in range(DEPTH, -1, -1):
        code = code << K.U64(8) | padded[at - d]
    return code, firsts - DEPTH * np.arange(rows)


def part_of(codes: np.ndarray) -> np.ndarray:
    """The part that holds a code's contexts."""
    return (K.mix(codes >> K.U64(8) & K.U64(0xFFFF)) >> K.U64(56)).astype(np.int64) % PARTS


def squeeze(x: np.ndarray) -> bytes:
    """Sorted integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="lz4", asbytes=True)


def unsqueeze(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="lz4", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total counts."""
    if not keys:
        return np.zeros(0, K.U64), np.zeros(0, np.int64)
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat)
    flat, n = flat[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return flat[at], np.add.reduceat(n, at) if len(at) else n


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the training rows' codes by part, from time to time and at the end."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        u, n = summed(keys, counts)
        keys.clear()
        counts.clear()
        part = part_of(u)
        order = np.argsort(part, kind="stable")
        u, n, part = u[order], n[order], part[order]
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(u)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        cols = [pa.array([int(part[a]) for a, _ in spans], pa.int64())]
        cols += [K.binary_column([squeeze(x[a:b]) for a, b in spans]) for x in (u, n)]
        return pa.RecordBatch.from_arrays(cols, names=["part", "codes", "n"])

    pending = 0
    for batch in batches:
        batch = batch.filter(batch.column(1))
        buf, offsets = K.text_buffer(batch.column(0))
        for i, j in K.blocks(offsets):
            u, n = np.unique(codes_of(buf, offsets[i : j + 1])[0], return_counts=True)
            keys.append(u)
            counts.append(n)
            pending += len(u)
            if pending > 3_000_000:
                both = summed(keys, counts)
                keys[:], counts[:] = [both[0]], [both[1]]
                pending = len(both[0])
                if pending > 1_500_000:
                    yield flush()
                    pending = 0
    if keys:
        yield flush()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma by Stirling's series from x + 8 on, for x > 0."""
    shift, y = np.ones_like(x), x.copy()
    for _ in range(8):
        shift *= y
        y += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one next."""
    return (ones + 0.5) / (zeros + ones + 1)


def own_share(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its children's product."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


@dataclass
class Level:
    """Nodes of one depth: context and decision in one word, sorted."""

    node: np.ndarray
    own: np.ndarray  # probability of a one by the node's estimate
    share: np.ndarray  # weight of that estimate
    log_p: np.ndarray  # ln of the weighted probability of all that the node has seen
    zeros: np.ndarray
    ones: np.ndarray


def _decisions(codes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node words of depth ``depth`` and the bits taken there, from the byte's highest bit on."""
    context = codes >> K.U64(8) & K.U64((1 << 8 * depth) - 1)
    byte = codes & K.U64(0xFF)
    for s in range(7, -1, -1):
        yield context << K.U64(8) | K.U64(1 << 7 - s) | byte >> K.U64(s + 1), (byte >> K.U64(s) & K.U64(1)).astype(bool)


def grow(codes: np.ndarray, n: np.ndarray, top: int = TOP) -> list[Level]:
    """The levels from ``top`` to DEPTH of the trees that these counts make."""
    levels: list[Level] = []
    for depth in range(DEPTH, top - 1, -1):
        words, zeros, ones = [], [], []
        for word, bit in _decisions(codes, depth):
            words.append(word)
            zeros.append(np.where(bit, 0, n))
            ones.append(np.where(bit, n, 0))
        node, index = np.unique(np.concatenate(words), return_inverse=True)
        z = np.bincount(index, np.concatenate(zeros), minlength=len(node))
        o = np.bincount(index, np.concatenate(ones), minlength=len(node))
        own = log_kt(z, o)
        if levels:
            below = levels[-1]
            up = (below.node >> K.U64(8) & K.U64((1 << 8 * depth) - 1)) << K.U64(8) | below.node & K.U64(0xFF)
            children = np.bincount(np.searchsorted(node, up), below.log_p, minlength=len(node))
            share, log_p = own_share(own, children), np.logaddexp(own, children) - math.log(2)
        else:
            share, log_p = np.ones(len(node)), own
        levels.append(Level(node, kt(z, o), share, log_p, z, o))
    return levels[::-1]


@dataclass
class Crown:
    """What depths 0 and 1 make of a prediction from below, by last byte and decision."""

    alone: np.ndarray  # [256, 256] probability of a one where nothing deeper was seen
    base: np.ndarray  # else it is base + factor * the prediction from below
    factor: np.ndarray


def crown(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_p: np.ndarray) -> Crown:
    """Depths 0 and 1 over all the nodes of depth TOP = 2."""
    last, decision = (node >> K.U64(8) & K.U64(0xFF)).astype(np.int64), (node & K.U64(0xFF)).astype(np.int64)
    at = last * 256 + decision
    z1, o1, below1 = (np.bincount(at, x, minlength=1 << 16).reshape(256, 256) for x in (zeros, ones, log_p))
    kt1 = log_kt(z1, o1)
    share1 = own_share(kt1, below1)
    weighted = np.logaddexp(kt1, below1) - math.log(2)
    z0, o0 = z1.sum(axis=0), o1.sum(axis=0)
    share0 = own_share(log_kt(z0, o0), weighted.sum(axis=0))
    seen1 = z1 + o1 > 0
    own0, own1 = kt(z0, o0)[None, :], kt(z1, o1)
    # A node never seen adds nothing: the prediction stays that of the deepest node seen.
    alone = np.where(seen1, share0 * own0 + (1 - share0) * own1, own0)
    return Crown(alone, share0 * own0 + (1 - share0) * share1 * own1, (1 - share0) * (1 - share1))


def code_lengths(codes: np.ndarray, levels: list[Level], top: Crown) -> np.ndarray:
    """Bits of the byte of each code, in float32."""
    out = np.zeros(len(codes))
    walks = [_decisions(codes, depth) for depth in range(TOP, DEPTH + 1)]
    last = (codes >> K.U64(8) & K.U64(0xFF)).astype(np.int64)
    for steps in zip(*walks, strict=True):
        p, deeper = np.zeros(len(codes)), np.zeros(len(codes), bool)
        for level, (word, bit) in zip(levels[::-1], steps[::-1], strict=True):
            at = np.searchsorted(level.node, word)
            at[at == len(level.node)] = 0
            seen = level.node[at] == word if len(level.node) else deeper
            own = level.own[at] if len(level.node) else p
            share = np.where(deeper, level.share[at] if len(level.node) else 0, 1)
            p = np.where(seen, share * own + (1 - share) * p, 0)
            deeper = seen
        decision = (steps[0][0] & K.U64(0xFF)).astype(np.int64)
        one = np.where(deeper, top.base[last, decision] + top.factor[last, decision] * p, top.alone[last, decision])
        out -= np.log2(np.where(bit, one, 1 - one))
    return out.astype(np.float32)


def _planted(table: pa.Table) -> pa.Table:
    """A part's counts, and what its nodes of depth TOP tell the ones above."""
    K.lean()
    u, n = summed([unsqueeze(x) for x in table.column("codes").to_pylist()], [unsqueeze(x).astype(np.int64) for x in table.column("n").to_pylist()])
    level = grow(u, n)[0]
    cols = {"part": pa.array([table.column("part")[0].as_py()], pa.int64())}
    cols |= {"codes": K.binary_column([squeeze(u)]), "n": K.binary_column([squeeze(n)])}
    for c in ("node", "zeros", "ones", "log_p"):
        x = getattr(level, c)
        cols[c] = K.binary_column([(x if c == "node" else x.astype("<f8")).tobytes()])
    return pa.table(cols)


def fit(docs: DataFrame, use: Column, text_col: str = "text") -> tuple[DataFrame, str, Crown]:
    """Counts (part, codes, n) of all rows for which ``use`` holds, their place in the shared folder, and the crown."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(use, F.lit(False)).alias("use"))
    gathered = rows.mapInArrow(_gathered, "part long, codes binary, n binary").repartition("part")
    schema = "part long, codes binary, n binary, node binary, zeros binary, ones binary, log_p binary"
    trees, path = materialize(gathered.groupBy("part").applyInArrow(K.trimmed(_planted), schema), "trees")
    got = trees.select("node", "zeros", "ones", "log_p").toArrow().to_pylist()
    node = np.concatenate([np.frombuffer(r["node"], K.U64) for r in got] or [np.zeros(0, K.U64)])
    rest = [np.concatenate([np.frombuffer(r[c], "<f8") for r in got] or [np.zeros(0)]) for c in ("zeros", "ones", "log_p")]
    return trees.select("part", "codes", "n"), path, crown(node, *rest)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table.column("text").combine_chunks()
    return K.text_buffer(pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col)


def _block_codes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A block's distinct codes."""
    some = [K.distinct(codes_of(buf, offsets[i : j + 1])[0]) for i, j in K.blocks(offsets)]
    return K.distinct(np.concatenate(some)) if some else np.zeros(0, K.U64)


def _block_words(buf: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct words and their counts in its training rows."""
    keys, counts = [], []
    for i, j in K.blocks(offsets):
        h, first = K.word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        u, index = np.unique(h, return_inverse=True)
        keys.append(u)
        counts.append(np.bincount(index, np.repeat(use[i:j], np.diff(first)), minlength=len(u)).astype(np.int64))
    return summed(keys, counts)


def _spans(part: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return part[first].tolist(), list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))


_ASKED = "kind int, part long, __block long, lot long, keys binary, n binary"


def _requests(bits: int) -> Callable[[pa.Table], pa.Table]:
    """What a block asks: kind 0, its words by hash range; kind 1, its codes by part."""

    def run(table: pa.Table) -> pa.Table:
        buf, offsets = _texts(table)
        use = np.array(table.column("use").to_pylist(), bool)
        block = table.column("__block")[0].as_py()
        words, n = _block_words(buf, offsets, use)
        part, spans = _spans((words >> K.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64))
        rows = [(0, p, block, 0, words[a:b].tobytes(), pack(n[a:b])) for p, (a, b) in zip(part, spans, strict=True)]
        codes = _block_codes(buf, offsets)
        where = part_of(codes)
        order = np.argsort(where, kind="stable")
        codes, (part, spans) = codes[order], _spans(where[order])
        rows += [(1, p, block, block // GROUP_BLOCKS, squeeze(codes[a:b]), None) for p, (a, b) in zip(part, spans, strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _ASKED.split(", ")]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def pack(n: np.ndarray) -> bytes:
    """Counts in the smallest of four widths, told by the first byte."""
    top = int(n.max()) if len(n) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w - 1)
    return bytes([width]) + n.astype(f"<i{width}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


_TOLD = "kind int, part long, __block long, values binary, tokens long, distinct long"


def _counted(table: pa.Table) -> pa.Table:
    """Counts of each request's words over all requests, and the range's totals with the first answer."""
    K.lean()
    asked = [np.frombuffer(x, K.U64) for x in table.column("keys").to_pylist()]
    counts = [unpack(x) for x in table.column("n").to_pylist()]
    u, total = summed(asked, counts)
    out = [pack(total[np.searchsorted(u, x)]) for x in asked]
    rest = [0] * (len(out) - 1)
    cols = {c: table.column(c) for c in ("kind", "part", "__block")}
    cols["values"] = K.binary_column(out)
    cols["tokens"] = pa.array([int(total.sum()), *rest], pa.int64())
    cols["distinct"] = pa.array([int((total > 0).sum()), *rest], pa.int64())
    return pa.table(cols)


def _measured(sent) -> Callable[[pa.Table, pa.Table], pa.Table]:  # noqa: ANN001
    """Code lengths of each request's codes by the part's trees."""

    def run(asked: pa.Table, trees: pa.Table) -> pa.Table:
        K.lean()
        codes, n = (unsqueeze(trees.column(c)[0].as_py()) if len(trees) else np.zeros(0, K.U64) for c in ("codes", "n"))
        levels = grow(codes, n.astype(np.int64))
        known = code_lengths(codes, levels, sent.value)
        out = []
        for raw in asked.column("keys").to_pylist():
            x = unsqueeze(raw)
            at = np.searchsorted(codes, x)
            at[at == len(codes)] = 0
            ok = codes[at] == x if len(codes) else np.zeros(len(x), bool)
            got = np.zeros(len(x), np.float32)
            got[ok] = known[at[ok]]
            if not ok.all():
                got[~ok] = code_lengths(x[~ok], levels, sent.value)
            out.append(got.tobytes())
        zero = pa.array(np.zeros(len(out), np.int64))
        cols = {c: asked.column(c) for c in ("kind", "part", "__block")}
        return pa.table(cols | {"values": K.binary_column(out), "tokens": zero, "distinct": zero})

    return run


_OUT = "id long, use boolean, n_tokens long, n_known long, log_counts double, bits double, n_bytes long, tokens long, distinct long"


def _scores(ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's rows with what its answers say, and one row that carries their totals (n_tokens -1)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        n = len(table)
        buf, offsets = _texts(table)
        got = sorted(answers.select(["kind", "part", "values"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        words = _block_words(buf, offsets, np.zeros(n, bool))[0]
        counts = np.concatenate([unpack(r["values"]) for r in got if not r["kind"]] or [np.zeros(0, np.int64)])
        codes = _block_codes(buf, offsets)
        lengths = np.zeros(len(codes), np.float32)
        told = [np.frombuffer(r["values"], np.float32) for r in got if r["kind"]]
        lengths[np.argsort(part_of(codes), kind="stable")] = np.concatenate(told or [np.zeros(0, np.float32)])
        tokens, known, logs, bits = (np.zeros(n, t) for t in (np.int64, np.int64, float, float))
        log_end = math.log10(ends + 0.5)
        of_word, of_code = pd.Index(words).get_indexer, pd.Index(codes).get_indexer
        for i, j in K.blocks(offsets):
            h, first = K.word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            row = np.repeat(np.arange(j - i), np.diff(first))
            c = counts[of_word(h)] if len(h) else np.zeros(0, np.int64)
            tokens[i:j] = np.diff(first) + 1
            known[i:j] = np.bincount(row, c > 0, minlength=j - i) + (ends > 0)
            logs[i:j] = np.bincount(row, np.log10(c + 0.5), minlength=j - i) + log_end
            mine, at = codes_of(buf, offsets[i : j + 1])
            bits[i:j] = np.add.reduceat(lengths[of_code(mine)].astype(np.float64), at)
        zero = np.zeros(n, np.int64)
        names = [x.split()[0] for x in _OUT.split(", ")]
        cols = [table.column("id"), table.column("use"), *map(pa.array, (tokens, known, logs, bits, np.diff(offsets), zero, zero))]
        sums = [sum(answers.column(c).to_pylist()) for c in ("tokens", "distinct")]
        carrier = [[None], [None], [-1], [0], [0.0], [0.0], [0], *[[s] for s in sums]]
        totals = [pa.array(v, c.type) for v, c in zip(carrier, cols, strict=True)]
        return pa.concat_tables([pa.table(cols, names=names), pa.table(totals, names=names)])

    return run


def score(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows' whole texts, learnt from those for which ``use`` holds.

    Returns doc_id, in_training, n_tokens (lower-cased words and one end), n_known (of these, with a
    training count), train_tokens, base_score (log10 of the unigram baseline), score (the model's
    log10 probability of the text and its end) and bits_per_byte (of both). A null or empty text is
    one end. Repeated rows score alike, a null id stays null; an empty table gives no rows.

    Documents are dealt into blocks of about BLOCK_ROWS by a hash of their id, or of their text
    where that is null; the exchange that deals them is planned once and read twice.
    """
    spark = docs.sparkSession
    trees, trees_path, top = fit(docs, use, text_col)
    sent = spark.sparkContext.broadcast(top)
    rows, ends = docs.agg(F.count("*"), F.coalesce(F.sum(F.when(use, 1)), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    bits = max(0, (blocks // 2).bit_length() - 1)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(use, F.lit(False)).alias("use"),
    )
    key = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    keyed = keyed.withColumn("__block", F.pmod(key, F.lit(blocks))).repartition("__block")
    asked, asked_path = materialize(keyed.groupBy("__block").applyInArrow(K.trimmed(_requests(bits)), _ASKED), "asked")
    counted = asked.where("kind = 0").groupBy("part").applyInArrow(K.trimmed(_counted), _TOLD)
    lots = -(-blocks // GROUP_BLOCKS)
    spread = trees.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)).cast("array<bigint>")))
    measured = asked.where("kind = 1").groupBy("part", "lot").cogroup(spread.groupBy("part", "lot")).applyInArrow(K.trimmed(_measured(sent)), _TOLD)
    answers = counted.unionByName(measured)
    scored = keyed.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(K.trimmed(_scores(ends)), _OUT)
    scored, _ = materialize(scored, "scores")
    discard(spark, asked_path)
    discard(spark, trees_path)
    tokens, distinct = scored.where("n_tokens < 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(tokens + 0.5 * (distinct + 1)))
    return scored.where("n_tokens >= 0").select(
        F.col("id").alias("doc_id"),
        F.col("use").alias("in_training"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
