"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

The model proto is serialised here, field by field, with nothing trained: token ``id`` becomes the
piece of its bytes, each mapped to one printable character, with score ``-rank``; the normaliser is
the identity. sentencepiece then merges the adjacent pair whose union has the best score, leftmost
first, which is the order of ranks. Each match of the pre-token pattern is encoded apart. Decoding
looks up each id's piece and maps its characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct pre-tokens whose ids a worker keeps; it forgets all of them when it has this many.
MEMORY = 200_000


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """One printable character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return tuple(chr(b if b in plain else next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def _negative(n: int) -> bytes:
    return _varint(n & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank table, with one unknown piece after the last rank."""
    letters = byte_letters()
    by_id = sorted((r, t) for t, r in ranks.items())
    if [r for r, _ in by_id] != list(range(len(by_id))):
        raise ValueError("ranks must be gapless from 0")
    out = bytearray()
    for r, t in by_id:
        piece = "".join(letters[b] for b in t).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(r))) + _field(3, 0, _varint(1)))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(by_id) + 1))
    trainer += _field(40, 0, _varint(len(by_id))) + b"".join(_field(n, 0, _negative(-1)) for n in (41, 42, 43))
    out += _field(2, 2, trainer)
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(3, 2, normaliser))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Codec:
    """Encodes and decodes with the model of ``ranks``; ``pattern`` splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.table = {b: c for b, c in enumerate(letters)} | {0xFF: "\n"}
        back = {c: b for b, c in enumerate(letters)}
        size = self.model.get_piece_size() - 1
        self.unknown = size
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(size)]
        # A pre-token that is a token itself gets its id, as in the rank format's own encoder.
        self.memory: dict[str, bytes] = {}
        self.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}

    def _learn(self, missing: list[str]) -> None:
        """Encode pre-tokens in one call, with an unknown character between them: nothing merges across it."""
        todo = []
        for t in missing:
            if (found := self.whole.get(t.encode())) is not None:
                self.memory[t] = found
            else:
                todo.append(t)
        for i in range(0, len(todo), 2048):
            some = todo[i : i + 2048]
            coded = b"\xff".join([t.encode() for t in some]).decode("latin-1").translate(self.table)
            ids = np.array(self.model.encode(coded), "<u4")
            cuts = np.flatnonzero(ids == self.unknown)
            flat, starts, ends = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), 4 * len(ids)]
            if len(starts) != len(some):
                raise ValueError("the model and the pre-tokens don't agree")
            self.memory.update(zip(some, [flat[x:y] for x, y in zip(starts, ends, strict=True)], strict=True))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, out, memory = self.split(text), [], self.memory
        for i in range(0, len(parts), 1 << 16):
            some = parts[i : i + (1 << 16)]
            if len(memory) > MEMORY:
                memory.clear()
            if missing := [t for t in set(some) if t not in memory]:
                self._learn(missing)
            out.append(b"".join(map(memory.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        get, flat = self.bytes_of.__getitem__, np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(get, flat[i : i + (1 << 18)].tolist())) for i in range(0, len(flat), 1 << 18))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each process."""
    if (key := (path, pattern)) not in _CODECS:
        _CODECS[key] = Codec(read_ranks(path), pattern)
    return _CODECS[key]


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True, shipped: bool = False
) -> DataFrame:
    """Add ``token_ids`` (array of ints, if ``with_ids``) and the digests ``n_tokens``, ``ids_sha256``
    and ``decoded_sha256`` of every whole text, the last from decoding the ids.

    ``path`` is the rank file on the executors, or the name of one sent with ``SparkContext.addFile``
    if ``shipped``. A null or empty text has no tokens. Columns of ``docs`` of the names added are
    replaced; other columns, repeated rows and their order within a task stay. No shuffle.
    """
    added = ["token_ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    base = docs.drop(*added)
    types = {"token_ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    out = T.StructType([*base.schema.fields, *[T.StructField(c, types.get(c, T.StringType())) for c in added]])
    names, at = [*base.columns, *added], base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(SparkFiles.get(path) if shipped else path, pattern)
        for batch in batches:
            coded = [c.encode(t) if t else b"" for t in (x.as_py() for x in batch.column(at))]
            cols = [*batch.columns]
            if with_ids:
                flat = np.frombuffer(b"".join(coded), "<i4")
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])])
                cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)))
            cols.append(pa.array([len(x) // 4 for x in coded], pa.int64()))
            cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded]))
            cols.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in coded]))
            yield pa.RecordBatch.from_arrays(cols, names=names)
        c.memory.clear()  # the worker is reused

    return base.mapInArrow(run, out)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes of the ids; a null or empty list gives none. Other columns stay."""
    base = df.drop(out_col)
    names, at = [*base.columns, out_col], base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            got = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out_col, T.BinaryType())]))
