"""Vectorised text kernels on Arrow buffers: words, shingles and rolling hashes with numpy.

All hashes are 64-bit. Byte strings get a polynomial hash over a table of random words, from one
cumulative sum, so that a word or any fixed window costs a few vector operations and no Python
object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; bounds the temporaries to about 100 bytes for each of these.
BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=1)
def lean() -> None:
    """Make this worker give large freed arrays back to the system, where the C library can."""
    import ctypes
    import sys

    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 4 << 20)  # blocks from this size on are mapped, and unmapped when freed
            libc.mallopt(-1, 8 << 20)  # free memory kept at the top of the heap
            libc.mallopt(-8, 1)  # one arena: a worker has one busy thread
    pa.set_memory_pool(pa.system_memory_pool())


@lru_cache(maxsize=1)
def _trimmer():  # noqa: ANN202
    import ctypes
    import sys

    libc = ctypes.CDLL(None) if sys.platform == "linux" else None
    return libc.malloc_trim if libc is not None and hasattr(libc, "malloc_trim") else lambda _: 0


def trimmed(f):  # noqa: ANN001, ANN201
    """A group function after which freed memory goes back to the system: workers are reused."""

    def run(*tables: pa.Table) -> pa.Table:
        lean()
        out = f(*tables)
        _trimmer()(0)
        return out

    # Spark tells functions with a key from those without by their number of parameters.
    two = f.__code__.co_argcount == 2
    return (lambda a, b: run(a, b)) if two else (lambda a: run(a))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 257, dtype=U64) * U64(_P))
    low = raw.copy()
    low[65:91] = raw[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    letter = np.arange(256, dtype=np.uint8)
    letter[65:91] += 32
    return raw, low, space, letter, ~space


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below ``n``, rounded up to a power of two."""
    return _powers(_P, n), _powers(_P_INV, n)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    return powers(size) if size <= 1 << 21 else (_powers(_P, n), _powers(_P_INV, n))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    lean()
    if pa.types.is_string_view(col.type) or pa.types.is_binary_view(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    _, offsets, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    o = o.astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """Bytes of words without ASCII punctuation: ASCII letters and digits and all of non-ASCII characters."""
    out = np.zeros(256, bool)
    out[128:] = True
    out[48:58] = out[65:91] = out[97:123] = True
    return out


def words(buf: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the first word of each row (n + 1).

    ``plain`` words have no ASCII punctuation or control characters either.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = (_alnum() if plain else _tables()[4])[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[(inner > 0)] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def prefix_hash(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    """n + 1 prefix sums of byte value times power of the base."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_tables()[1 if lower else 0][buf] * powers_for(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    return mix((prefix[ends] - prefix[starts]) * powers_for(len(prefix))[1][starts])


def word_hashes(
    buf: np.ndarray, offsets: np.ndarray, lower: bool = True, plain: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word of each row (n + 1)."""
    starts, ends, first = words(buf, offsets, plain)
    if not len(starts):
        return np.zeros(0, U64), first
    return span_hash(prefix_hash(buf, lower), starts, ends), first


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, with repeats; a row of fewer words gets one."""
    q = _powers(_P_INV ^ 0x5851F42D4C957F2C | 1, k)
    counts = np.diff(first)
    if len(h) >= k:
        all_ = np.zeros(len(h) - k + 1, U64)
        for t in range(k):
            all_ += h[t : len(all_) + t] * q[t]
        all_ = mix(all_)
    else:
        all_ = np.zeros(0, U64)
    out_n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(int(out_first[-1]), U64)
    long_ = np.flatnonzero(counts >= k)
    if len(long_):
        n = out_n[long_]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(out_first[:-1][long_], n) + at] = all_[np.repeat(first[:-1][long_], n) + at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = h[first[i] : first[i + 1]]
        out[out_first[i]] = mix((w * q[: len(w)]).sum(dtype=U64).reshape(1) + U64(len(w) * 0xA24BAED4963EE407 % (1 << 64)))[0]
    return out, out_first


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: by sorting, which is much faster here than numpy's hashing."""
    s = np.sort(x)
    if len(s) < 2:
        return s
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def list_column(flat: np.ndarray, width: int) -> pa.Array:
    """A list<int64> column of fixed width from a flat array."""
    n = len(flat) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))
