"""Removal of repeated byte strings with sorted suffix runs and a common-prefix-aware merge.

Suffixes are sorted where the text itself says so: of every ``length``-byte window the k-gram with
the smallest hash is an anchor (leftmost on ties), so equal windows, wherever they stand, share one
anchor at one offset. Suffixes start at the anchors whose k-gram occurs twice or more. Each block of
documents sorts its suffixes into runs, cut by sampled splitters and front-coded for the exchange;
a range's runs meet in a loser tree that keeps, for every waiting suffix, the prefix known to be
common with the last winner and compares from there on only. Neighbours with a common prefix of the
k-gram or more are then extended to the left. The result is exact: it is that of sorting the suffixes
of every byte.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import kernel as K

#: Documents of a block, and k-grams sampled for the splitters: at most this many, of this many documents or so.
BLOCK_ROWS, SAMPLE, SAMPLE_DOCS = 1000, 400_000, 4000
#: Suffixes of one k-gram that may meet in one task; of more, windows are compared by digest, wherever they fall.
HOT = 100_000
_RUN = "range int, doc long, ord int, lcp binary, tail_n binary, tail binary, left_n binary, left binary, docs binary, ords binary, at binary"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def gram(length: int) -> int:
    return max(4, length * 6 // 25)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows' anchors in the rows' bytes, and the hashes of their k-grams."""
    k = gram(length)
    w, n = length - k + 1, len(buf)
    ok = np.zeros(n + 1, np.int8)
    has = np.diff(offsets) >= length
    ok[offsets[:-1][has]] += 1
    ok[offsets[1:][has] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    prefix = K.prefix_hash(buf, lower=False)
    h = K.mix((prefix[k:] - prefix[:-k]) * K.powers_for(len(prefix))[1][: n - k + 1])
    value = (h >> K.U64(32)).astype(np.uint32)
    at = np.arange(len(value), dtype=np.int32)
    # Leftmost minimum of each w values, doubling the width.
    step = 1
    while step < w:
        move = min(step, w - step)
        a, b = value[:-move], value[move:]
        less = b < a
        at = np.where(less, at[move:], at[:-move])
        value = np.where(less, b, a)
        step += move
    mark = np.zeros(n, bool)
    mark[at[starts]] = True
    found = np.flatnonzero(mark)
    return found, h[found]


def _rows(table: pa.Table, text_col: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block."""
    col = table.column(text_col).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    buf, offsets = K.text_buffer(col)
    return table.column("__key").to_pylist(), buf, offsets


def _ordered(table: pa.Table, text_col: str) -> pa.Table:
    """A block in the order of (key, text): repeated keys are told apart by their rank in it."""
    return table.sort_by([("__key", "ascending"), (text_col, "ascending")])


def _ordinals(keys: list[int]) -> list[int]:
    out: list[int] = []
    for i, k in enumerate(keys):
        out.append(out[-1] + 1 if i and keys[i - 1] == k else 0)
    return out


def _block_anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in K.blocks(offsets):
        lo = offsets[i]
        at, h = anchors(buf[lo : offsets[j]], offsets[i : j + 1] - lo, length)
        yield i, j, at + lo, h


def _requests(length: int, bits: int, text_col: str) -> Callable[[pa.Table], pa.Table]:
    """A block's distinct k-gram hashes, by hash range; ``many`` says how often it holds each, and ``more`` of those
    that say 255 how often indeed."""

    def run(table: pa.Table) -> pa.Table:
        _, buf, offsets = _rows(table, text_col)
        all_ = [h for _, _, _, h in _block_anchors(buf, offsets, length)]
        u, n = np.unique(np.concatenate(all_) if all_ else np.zeros(0, K.U64), return_counts=True)
        part = (u >> K.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        cuts = [*first.tolist(), len(u)]
        many = np.minimum(n, 255).astype(np.uint8)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        block = table.column("__block")[0].as_py()
        return pa.table(
            {
                "part": pa.array(part[first], pa.int64()),
                "__block": pa.array([block] * len(spans), pa.int64()),
                "hashes": K.binary_column([u[a:b].tobytes() for a, b in spans]),
                "many": K.binary_column([many[a:b].tobytes() for a, b in spans]),
                "more": K.binary_column([n[a:b][many[a:b] == 255].astype("<i8").tobytes() for a, b in spans]),
            }
        )

    return run


def _answers(most: int) -> Callable[[pa.Table], pa.Table]:
    """Of each request, the hashes that occur twice or more anywhere, and which occur more than ``most`` times."""

    def run(table: pa.Table) -> pa.Table:
        K.lean()
        blocks = table.column("__block").to_pylist()
        asked = [np.frombuffer(x, K.U64) for x in table.column("hashes").to_pylist()]
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("many").to_pylist()]).astype(np.int64)
        many[many == 255] = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("more").to_pylist()])
        _, index = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(index, many)[index]
        out, at = [], 0
        for b, x in zip(blocks, asked, strict=True):
            n = total[at : at + len(x)]
            at += len(x)
            if (n > 1).any():
                out.append((b, x[n > 1].tobytes(), (n[n > 1] > most).tobytes()))
        cols = {"__block": pa.array([r[0] for r in out], pa.int64())}
        return pa.table(cols | {c: K.binary_column([r[i] for r in out]) for i, c in enumerate(("hashes", "hot"), 1)})

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(sorted_: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common prefix with the one before, length of the rest, and the rests."""
    lcp, tails, before = bytearray(), [], b""
    for s in sorted_:
        h = common_prefix(before, s)
        lcp.append(h)
        tails.append(s[h:])
        before = s
    return bytes(lcp), bytes(map(len, tails)), b"".join(tails)


def front_decode(lcp: bytes, tail_n: bytes, tail: bytes) -> Iterator[tuple[bytes, int]]:
    """(suffix, prefix in common with the one before) of a front-coded run."""
    before, at = b"", 0
    for h, n in zip(lcp, tail_n, strict=True):
        before = before[:h] + tail[at : at + n]
        at += n
        yield before, h


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted (suffix, lcp to the one before, payload) runs; lcp of the output likewise.

    A loser tree: every waiting suffix knows its common prefix with the last winner, so two of them
    with different known prefixes are ordered without looking at a byte, and others are compared
    from the known prefix on.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    heads: list[tuple[bytes, int, object] | None] = [next(r, None) for r in runs] + [None] * (size - n)
    keys = [x[0] if x else None for x in heads]
    lcps = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = lcps[a], lcps[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        h = common_prefix(x, y, p)
        if h == len(x) and (h < len(y) or a < b) or h < len(x) and h < len(y) and x[h] < y[h]:
            lcps[b] = h
            return a, b
        lcps[a] = h
        return b, a

    winners = list(range(size))
    width = size
    while width > 1:
        width >>= 1
        after = []
        for i in range(width):
            win, lose = play(winners[2 * i], winners[2 * i + 1])
            losers[width + i] = lose
            after.append(win)
        winners = after
    w = winners[0]
    while (head := heads[w]) is not None:
        yield head[0], lcps[w], head[2]
        heads[w] = new = next(runs[w], None) if w < n else None
        keys[w], lcps[w] = (new[0], new[1]) if new else (None, 0)
        node = (w + size) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1


def _runs(length: int, splitters: list[bytes], text_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's sorted, front-coded suffix runs, and the spans its own documents already repeat."""
    k = gram(length)
    left = length - k

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _RUN_NAMES}
        if len(answers) and len(table):
            table = _ordered(table, text_col)
            keys, buf, offsets = _rows(table, text_col)
            ords = _ordinals(keys)
            twice = np.concatenate([np.frombuffer(x, K.U64) for x in answers.column("hashes").to_pylist()])
            hot = np.concatenate([np.frombuffer(x, bool) for x in answers.column("hot").to_pylist()])
            by_hash = np.argsort(twice)
            twice, hot = twice[by_hash], hot[by_hash]
            windows: dict[bytes, tuple[int, int, int]] = {}
            raw = buf.tobytes()
            seen: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
            spans = Spans()
            for _, _, at, h in _block_anchors(buf, offsets, length):
                i = np.searchsorted(twice, h)
                i[i == len(twice)] = 0
                known = twice[i] == h
                for r, p in _window_starts(at[known & hot[i]], offsets, length, left):
                    digest = hashlib.blake2b(raw[p : p + length], digest_size=16).digest()
                    mine = (keys[r], ords[r], p - int(offsets[r]))
                    if windows.setdefault(digest, mine) is not mine:
                        spans.add(mine[:2], mine[2], mine[2] + length)
                at = at[known & ~hot[i]]
                row = np.searchsorted(offsets, at, "right") - 1
                los, his = offsets[row].tolist(), offsets[row + 1].tolist()
                for a, r, lo, hi in zip(at.tolist(), row.tolist(), los, his, strict=True):
                    context = raw[max(lo, a - left) : a], raw[a : min(hi, a + length)]
                    mine = (keys[r], ords[r], a - lo)
                    if seen.setdefault(context, mine) is not mine and len(context[0]) + len(context[1]) >= length:
                        spans.add(mine[:2], mine[2] - len(context[0]), mine[2] + len(context[1]))
            order = sorted(seen.items(), key=lambda x: x[0][1])
            where = [bisect_right(splitters, c[1][:k]) for c, _ in order]
            i = 0
            while i < len(order):
                j = bisect_right(where, where[i])
                lcp, tail_n, tail = front_code([c[1] for c, _ in order[i:j]])
                lefts = [c[0] for c, _ in order[i:j]]
                whose = [x for _, x in order[i:j]]
                row_ = [where[i], None, None, lcp, tail_n, tail, bytes(map(len, lefts)), b"".join(lefts)]
                row_ += [np.array([x[t] for x in whose], d).tobytes() for t, d in ((0, "<i8"), (1, "<i4"), (2, "<i4"))]
                for c, v in zip(_RUN_NAMES, row_, strict=True):
                    out[c].append(v)
                i = j
            # Windows of hot k-grams meet by their digests.
            buckets: dict[int, list[bytes]] = {}
            for digest in windows:
                buckets.setdefault(int.from_bytes(digest[:4], "little") % (len(splitters) + 1), []).append(digest)
            for n, digests in buckets.items():
                whose = [windows[d] for d in digests]
                row_ = [n, None, None, None, None, b"".join(digests), None, None]
                row_ += [np.array([x[t] for x in whose], d).tobytes() for t, d in ((0, "<i8"), (1, "<i4"), (2, "<i4"))]
                for c, v in zip(_RUN_NAMES, row_, strict=True):
                    out[c].append(v)
            # Spans found here pass through some range's merge as they are.
            for n, ((doc, ord_), found) in enumerate(spans.merged()):
                row_ = [n % (len(splitters) + 1), doc, ord_, None, None, None, None, None, None, None]
                for c, v in zip(_RUN_NAMES, [*row_, np.array(found, "<i4").tobytes()], strict=True):
                    out[c].append(v)
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8]
        return pa.table({c: pa.array(out[c], t) for c, t in zip(_RUN_NAMES, kinds, strict=True)})

    return run


def _window_starts(at: np.ndarray, offsets: np.ndarray, length: int, left: int) -> Iterator[tuple[int, int]]:
    """(row, start) of every window that one of these anchors may stand for, in order."""
    if not len(at):
        return
    row = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - left, offsets[row]), np.minimum(at, offsets[row + 1] - length)
    n = np.maximum(hi - lo + 1, 0)
    starts = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    starts = np.unique(starts)
    yield from zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), strict=True)


class Spans:
    """Byte spans by document, united when they are read."""

    def __init__(self) -> None:
        self.by: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, doc: tuple[int, int], start: int, end: int) -> None:
        found = self.by.setdefault(doc, [])
        if found and found[-1][0] <= start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))

    def merged(self) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
        for doc, found in self.by.items():
            yield doc, unite(found)


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Group:
    """Suffixes of one k-gram: of equal contexts only the first is kept, whatever their number."""

    def __init__(self, length: int, k: int, spans: Spans) -> None:
        self.length, self.k, self.spans = length, k, spans
        self.first: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}

    def add(self, right: bytes, left: bytes, whose: tuple[int, int, int]) -> None:
        had = self.first.setdefault((left, right), whose)
        if had is not whose:
            late = max(had, whose)
            self.first[left, right] = min(had, whose)
            if len(left) + len(right) >= self.length:
                self.spans.add(late[:2], late[2] - len(left), late[2] + len(right))

    def close(self) -> None:
        _resolve(self.first, self.length, self.k, self.spans)
        self.first = {}


def _resolve(first: dict[tuple[bytes, bytes], tuple[int, int, int]], length: int, k: int, spans: Spans) -> None:
    """Spans of distinct contexts around one k-gram: what of each also starts earlier."""
    if len(first) < 2:
        return
    order = sorted((whose, left, right) for (left, right), whose in first.items())
    if len(order) <= 8:
        back = [x[1][::-1] for x in order]
        for j in range(1, len(order)):
            whose, _, right = order[j]
            for i in range(j):
                r = common_prefix(order[i][2], right, k)
                if r + len(back[j]) >= length:
                    s = common_prefix(back[i], back[j])
                    if r + s >= length:
                        spans.add(whose[:2], whose[2] - s, whose[2] + r)
        return
    for o in range(length - k + 1):
        seen: set[bytes] = set()
        for whose, left, right in order:
            if len(left) >= o and len(right) >= length - o:
                window = left[len(left) - o :] + right[: length - o]
                if window in seen:
                    spans.add(whose[:2], whose[2] - o, whose[2] - o + length)
                else:
                    seen.add(window)


def _merge(length: int) -> Callable[[pa.Table], pa.Table]:
    k = gram(length)

    def stream(row: dict) -> Iterator[tuple[bytes, int, object]]:
        docs, ords, at = (np.frombuffer(row[c], d).tolist() for c, d in (("docs", "<i8"), ("ords", "<i4"), ("at", "<i4")))
        lefts, p = row["left"], 0
        coded = front_decode(row["lcp"], row["tail_n"], row["tail"])
        for (s, h), n, *whose in zip(coded, row["left_n"], docs, ords, at, strict=True):
            yield s, h, (lefts[p : p + n], tuple(whose))
            p += n

    def run(table: pa.Table) -> pa.Table:
        K.lean()
        spans, runs, hot = Spans(), [], []
        for batch in table.to_batches(max_chunksize=256):
            for row in batch.to_pylist():
                if row["lcp"] is not None:
                    runs.append(stream(row))
                elif row["doc"] is not None:
                    for a, b in np.frombuffer(row["at"], "<i4").reshape(-1, 2).tolist():
                        spans.add((row["doc"], row["ord"]), a, b)
                else:
                    hot.append(row)
        group = Group(length, k, spans)
        for s, h, (left, whose) in merge_runs(runs) if runs else ():
            if h < k:
                group.close()
            group.add(s, left, whose)
        group.close()
        if hot:
            digest = np.concatenate([np.frombuffer(r["tail"], K.U64).reshape(-1, 2) for r in hot])
            doc, ord_, at = (np.concatenate([np.frombuffer(r[c], d) for r in hot]) for c, d in (("docs", "<i8"), ("ords", "<i4"), ("at", "<i4")))
            order = np.lexsort((at, ord_, doc, digest[:, 1], digest[:, 0]))
            again = order[1:][(digest[order[1:]] == digest[order[:-1]]).all(axis=1)]
            for d, o, p in zip(doc[again].tolist(), ord_[again].tolist(), at[again].tolist(), strict=True):
                spans.add((d, o), p, p + length)
        flat = [(d, o, np.array(f, "<i4").tobytes()) for (d, o), f in spans.merged()]
        kinds = (("__key", pa.int64()), ("ord", pa.int32()), ("spans", pa.binary()))
        return pa.table({c: pa.array([x[i] for x in flat], t) for i, (c, t) in enumerate(kinds)})

    return run


def _cut(names: list[str], text_col: str, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The block's documents without their spans."""

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        table = _ordered(table, text_col)
        keys, buf, offsets = _rows(table, text_col)
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for key, ord_, found in zip(*(spans.column(c).to_pylist() for c in ("__key", "ord", "spans")), strict=True):
            by.setdefault((key, ord_), []).extend(map(tuple, np.frombuffer(found, "<i4").reshape(-1, 2).tolist()))
        raw, texts, digests = buf.tobytes(), [], []
        had = table.column(text_col).to_pylist() if with_text else []
        for i, doc in enumerate(zip(keys, _ordinals(keys), strict=True)):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            cuts = unite(by.get(doc, []))
            kept, at = [], lo
            for a, b in cuts:
                kept.append(raw[at : lo + a])
                at = lo + b
            kept.append(raw[at:hi])
            left = b"".join(kept)
            digests.append((hi - lo, hi - lo - len(left), len(cuts), hashlib.sha256(left).hexdigest()))
            if with_text:
                texts.append(left.decode("utf-8", "ignore") if cuts else had[i])
        out = {c: table.column(c) for c in names}
        if with_text:
            out[text_col] = pa.array(texts, pa.string())
        for i, (c, t) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))):
            out[c] = pa.array([x[i] for x in digests], t)
        return pa.table(out)

    return run


def _sampled(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = gram(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.text_buffer(batch.column(0))
            for _, _, at, h in _block_anchors(buf, offsets, length):
                some = at[(h & K.U64(7)) == 0]
                yield pa.RecordBatch.from_arrays([K.binary_column([buf[a : a + k].tobytes() for a in some.tolist()])], names=["gram"])

    return run


def splitters(texts: DataFrame, rows: int, ranges: int, length: int) -> list[bytes]:
    """``ranges - 1`` cuts of the anchors' k-grams, from a bounded sample; they don't change the result."""
    some = texts if rows <= SAMPLE_DOCS else texts.sample(SAMPLE_DOCS / rows, seed=7)
    grams = sorted({bytes(r[0]) for r in some.mapInArrow(_sampled(length), "gram binary").limit(SAMPLE).collect()})
    return sorted({grams[len(grams) * i // ranges] for i in range(1, ranges)}) if grams else []


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """``docs`` without every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller id, or the same document and an earlier start; texts are UTF-8 bytes,
    judged as they come in, and matches never cross documents. Adds n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256 (of the remaining bytes); with ``with_text`` the other
    columns stay and the text becomes the remaining bytes, without characters cut in two.
    A null text is empty and stays null; a null id counts as the largest; rows of one id are ordered
    by text, equal ones in any order. Columns of the names added, or starting with ``__``, are replaced.
    ``length`` is at most 255, since runs are coded by the byte.
    """
    if not 4 <= length <= 255:
        raise ValueError("length must be from 4 to 255")
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "__key", "__block"]
    docs = docs.drop(*added) if with_text else docs.select(id_col, text_col)
    names = docs.columns
    rows = docs.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    bits = max(0, (blocks // 2).bit_length() - 1)
    cuts = splitters(docs.select(text_col), rows, min(max(2, blocks // 2), SAMPLE // 8), length)
    # Lots keep blocks of documents together through all steps; the exchange by block is planned once and reused.
    of_block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("long")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.withColumn("__key", key).withColumn("__block", of_block(F.col("__key"))).repartition("__block")
    asked = keyed.groupBy("__block").applyInArrow(
        K.trimmed(_requests(length, bits, text_col)), "part long, __block long, hashes binary, many binary, more binary"
    )
    answers = asked.groupBy("part").applyInArrow(K.trimmed(_answers(HOT)), "__block long, hashes binary, hot binary")
    runs = keyed.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(K.trimmed(_runs(length, cuts, text_col)), _RUN)
    spans = runs.groupBy("range").applyInArrow(K.trimmed(_merge(length)), "__key long, ord int, spans binary")
    spans = spans.withColumn("__block", of_block(F.col("__key")))
    if not with_text:
        names = [id_col]
    fields = [*docs.select(*names).schema.fields, *[T.StructField(c, T.LongType()) for c in added[:3]], T.StructField(added[3], T.StringType())]
    return keyed.groupBy("__block").cogroup(spans.groupBy("__block")).applyInArrow(
        K.trimmed(_cut(names, text_col, with_text)), T.StructType(fields)
    )
