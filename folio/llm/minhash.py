"""Near-duplicate groups by min-max hashing of word shingles.

Each permutation is evaluated once for a shingle and gives two signature values, its minimum and its
maximum; bands of minima and bands of maxima find candidates. Candidates are confirmed on the full
shingle sets, so the links found are exact; at the similarity asked for, the chance that a link
between different texts is missed is below 3e-6 (BANDS, ROWS) and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import kernel as K
from folio.llm.graph import components
from folio.llm.store import discard, materialize

#: Half of the bands hold minima, half maxima, each of ROWS permutations: 1 - (1 - 0.75^5)^48 = 1 - 2.3e-6.
BANDS, ROWS = 48, 5
#: Four bits of each signature value, in WORDS longs, and how many of the BANDS * ROWS values must
#: agree for a pair to be confirmed: 4.5 deviations below the mean at 0.75, which a link misses once in 3e5.
WORDS, AGREE = BANDS * ROWS // 16, 154
#: Members of a side of a bucket that meet at once in the second round, and the sharper sketch there:
#: permutations, and values of twice as many that must agree, 4.5 deviations below the mean at 0.75.
SIDE, SHARPER, SHARPER_AGREE = 1024, 512, 706
#: Bytes of text of a side, on average: buckets of long texts are cut into more sides.
SIDE_BYTES = 32 << 20


def _permutations(start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(start + 1, start + n + 1, dtype=K.U64) * K.U64(0xA0761D6478BD642F))
    return (x >> K.U64(32)).astype(np.uint32) | np.uint32(1), (x & K.U64(0xFFFFFFFF)).astype(np.uint32)


def signatures(s: np.ndarray, first: np.ndarray, start: int = 0, half: int = BANDS * ROWS // 2) -> np.ndarray:
    """Minima, then maxima, of ``half`` permutations over each row's shingles; rows must not be empty."""
    a, b = _permutations(start, half)
    n = len(first) - 1
    out = np.empty((2 * half, n), np.uint32)
    # Rows are taken in slices that stay in the processor's cache.
    for i, j in K.blocks(first, 1 << 15):
        h = (s[first[i] : first[j]] >> K.U64(32)).astype(np.uint32)
        at = (first[i:j] - first[i]).astype(np.int64)
        v = np.empty_like(h)
        for p in range(half):
            np.multiply(h, a[p], out=v)
            np.add(v, b[p], out=v)
            out[p, i:j] = np.minimum.reduceat(v, at)
            out[half + p, i:j] = np.maximum.reduceat(v, at)
    return out


def _sketch(ids: pa.Array, nodes: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """One row for each text: set size, digest of the set, band keys and sketch bits."""
    h, first = K.word_hashes(buf, offsets)
    s, first = K.shingle_hashes(h, first)
    n = len(offsets) - 1
    sizes, digest = np.zeros(n, np.int64), np.zeros((n, 2), K.U64)
    full = np.flatnonzero(np.diff(first))
    for i in full:
        u = K.distinct(s[first[i] : first[i + 1]])
        sizes[i] = len(u)
        digest[i] = u.sum(dtype=K.U64), np.bitwise_xor.reduce(K.mix(u ^ K.U64(0x5DEECE66D)))
    keys = np.zeros((n, BANDS), K.U64)
    bits = np.zeros((n, WORDS), K.U64)
    if len(full):
        sig = signatures(s, np.append(first[full], first[-1]))
        for band in range(BANDS):
            k = np.full(len(full), K.U64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), K.U64)
            for v in sig[band * ROWS : (band + 1) * ROWS]:
                k = K.mix(k ^ v)
            keys[full, band] = k
        for i, v in enumerate(sig):
            bits[full, i // 16] |= (K.mix(v.astype(K.U64)) & K.U64(15)) << K.U64(4 * (i % 16))
    cols = [ids, nodes, pa.array(sizes), *[pa.array(K.as_long(digest[:, i])) for i in (0, 1)]]
    cols += [K.list_column(K.as_long(x).ravel(), x.shape[1]) for x in (keys, bits)]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "id", "n_shingles", "d0", "d1", "bands", "bits"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = K.text_buffer(batch.column(2))
        for i, j in K.blocks(offsets):
            yield _sketch(batch.column(0)[i:j], batch.column(1)[i:j], buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _sets(col: pa.Array) -> list[np.ndarray]:
    buf, offsets = K.text_buffer(col)
    out: list[np.ndarray] = []
    for i, j in K.blocks(offsets):
        h, first = K.word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        s, first = K.shingle_hashes(h, first)
        out += [K.distinct(s[first[k] : first[k + 1]]) for k in range(j - i)]
    return out


def _confirm(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                keep = []
                for x, y in zip(_sets(b.column(2)), _sets(b.column(3)), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common) > 0)
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["id", "to"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sharper(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each value of a longer signature of the sets."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = signatures(np.concatenate(sets), first, start=1 << 20, half=SHARPER)
    return np.ascontiguousarray((sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).T)


def _across(percent: int):  # noqa: ANN202
    """Links between members of different components in one bucket, or between two sides of it.

    Every pair is held against its sketches; one that may be linked goes on in the first band the two
    share only, then against a sharper sketch, then against the full sets. Pairs that links found
    here already connect are passed over, so the components come out whole.
    """

    def run(table: pa.Table) -> pa.Table:
        K.lean()
        ids, component, sizes, side = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles", "side"))
        bits = np.array(table.column("bits").to_pylist(), np.int64).view(K.U64)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        band = int((bands[0] == table.column("key")[0].as_py()).argmax())
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        nibbles, found = K.U64(0x1111111111111111), [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left), 64):
            mine = left[at : at + 64]
            x = bits[mine][:, None, :] ^ bits[right][None, :, :]
            x |= x >> K.U64(1)
            x |= x >> K.U64(2)
            equal = BANDS * ROWS - np.bitwise_count(x & nibbles).sum(axis=2, dtype=np.int64)
            n, m = sizes[mine][:, None], sizes[right][None, :]
            ok = (equal >= AGREE) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            ok &= component[mine][:, None] != component[right][None, :]
            if lo == hi:
                ok &= mine[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            pair = np.stack([mine[i], right[j]], axis=1)
            found.append(pair[(bands[pair[:, 0]] == bands[pair[:, 1]]).argmax(axis=1) == band])
        pairs = np.concatenate(found)
        used, flat = np.unique(pairs, return_inverse=True)
        pairs = flat.reshape(-1, 2)
        out: list[tuple[int, int]] = []
        if len(pairs):
            sets = _sets(table.column("__text").combine_chunks().take(pa.array(used)))
            if len(pairs) > 4 * len(used):
                sharp = _sharper(sets)
                agree = np.concatenate(
                    [(sharp[p[:, 0]] == sharp[p[:, 1]]).sum(axis=1) for p in np.array_split(pairs, 1 + len(pairs) // 4096)]
                )
                pairs = pairs[agree >= SHARPER_AGREE]
            home = {c: c for c in component[used].tolist()}

            def root(c: int) -> int:
                while home[c] != c:
                    home[c] = c = home[home[c]]
                return c

            for i, j in pairs.tolist():
                a, b = root(int(component[used[i]])), root(int(component[used[j]]))
                if a != b:
                    x, y = sets[i], sets[j]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common) > 0:
                        home[max(a, b)] = min(a, b)
                        out.append((int(ids[used[i]]), int(ids[used[j]])))
        return pa.table({"id": pa.array([o[0] for o in out], pa.int64()), "to": pa.array([o[1] for o in out], pa.int64())})

    return run


def _alike(a: str, b: str, percent: int) -> Column:
    """Could two sketches be of sets this similar? By set sizes, exactly, and by signature bits."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    equal = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        for shift in (1, 2):  # the lowest bit of each four becomes: they differ
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        equal = equal + (16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (equal >= AGREE)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, to) whose full shingle sets are similar enough; reads only their texts."""
    a = pairs.join(texts.withColumnRenamed("__text", "__a"), "id")
    b = a.join(texts.select(F.col("id").alias("to"), F.col("__text").alias("__b")), "to")
    return b.select("id", "to", "__a", "__b").mapInArrow(_confirm(percent), "id long, to long")


def node_of(id_col: str, text_col: str) -> Column:
    """A number for a row's id and text: rows are told apart by both, as ids may repeat with other texts."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node) for every row of ``docs``.

    Texts with 100 * |A & B| >= percent * |A | B| over their distinct 5-word shingles are linked;
    a component's id is its smallest doc_id. A null, empty or wordless text has an empty set and
    stands alone, as does a row with a null id (component_id null, kept). Repeated rows get a row each; rows that
    share an id but not the text are told apart by ``node`` and may be in different components. No rows give no rows;
    other columns are not read. Percentages below 75 lower the recall stated above.

    1. One pass makes sketches, kept in the shared folder. Texts with equal sets become one class.
    2. Each band bucket links its members to its smallest one; candidates are confirmed on full sets.
    3. Buckets that still hold several components compare the members of different ones, side by side,
       a side being at most about SIDE members and SIDE_BYTES of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), node_of(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("__text"))
    schema = "doc long, id long, n_shingles long, d0 long, d1 long, bands array<long>, bits array<long>"
    sketches, _ = materialize(rows.mapInArrow(_sketches, schema), "sketches")
    usable = sketches.where("doc is not null and n_shingles > 0")
    classes = usable.groupBy("d0", "d1", "n_shingles").agg(F.min("id").alias("rep"), F.min("doc").alias("least"))
    # A class is equal sets, so any of its members gives its sketch; rows of one node are equal.
    # Joins with whole tables are merged at every size: none of their sides has a bound.
    reps = classes.select(F.col("rep").alias("id")).hint("merge")
    picked = usable.join(reps, "id", "left_semi").dropDuplicates(["id"])
    banded, banded_path = materialize(picked.select("id", F.explode("bands").alias("key")), "bands")
    heads = banded.groupBy("key").agg(F.min("id").alias("to"), F.count("*").alias("n")).where("n > 1")
    shared, shared_path = materialize(banded.join(heads.hint("merge"), "key"), "shared")
    discard(spark, banded_path)
    # Only those that share a bucket go on, with sketch and text.
    ids = shared.select("id").distinct().hint("merge")
    texts = rows.where("doc is not null").select("id", "__text").join(ids, "id", "left_semi").dropDuplicates(["id"])
    sketch = usable.select("id", "n_shingles", "bits", "bands").join(ids, "id", "left_semi").dropDuplicates(["id"])
    texts = texts.withColumn("n_bytes", F.octet_length("__text").cast("long"))
    known, known_path = materialize(sketch.join(texts.hint("merge"), "id"), "known")
    pairs = shared.where("id <> to").select("id", "to").distinct()
    slim = known.select("id", F.struct("n_shingles", "bits").alias("x"))
    pairs = pairs.join(slim, "id").join(slim.select(F.col("id").alias("to"), F.col("x").alias("y")), "to")
    tried, tried_path = materialize(pairs.where(_alike("x", "y", percent)).select("id", "to").distinct(), "tried")
    links, links_path = materialize(_verified(tried, known.select("id", "__text"), percent), "links")
    found = components(links, "id", "to").withColumnRenamed("node", "id")

    # Second round: members of a bucket that the first left in different components. Buckets of two
    # need no second look: the first round tried their only pair.
    member = shared.where("n > 2").join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    member, member_path = materialize(member.join(mixed.select("key"), "key"), "members")
    weight = member.join(known.select("id", "n_bytes").hint("merge"), "id").groupBy("key").agg(F.sum("n_bytes").alias("bytes"))
    full = member.join(known, "id").join(weight.hint("merge"), "key")
    sides = F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("bytes") / SIDE_BYTES)).cast("int")
    side = F.pmod(F.xxhash64("id"), sides.cast("long")).cast("int")
    # Each member meets its own side and all others of its bucket.
    full = full.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    full = full.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    again, again_path = materialize(full.groupBy("key", "lo", "hi").applyInArrow(K.trimmed(_across(percent)), "id long, to long"), "links")
    if not again.isEmpty():
        found = components(links.unionByName(again), "id", "to").withColumnRenamed("node", "id")
    for path in (shared_path, known_path, tried_path, links_path, member_path, again_path):
        discard(spark, path)

    # The smallest document of each component; of what links nothing, of each class.
    linked = classes.select(F.col("rep").alias("id"), "least").join(found.hint("merge"), "id")
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    linked, linked_path = materialize(linked.join(least.hint("merge"), "component").select("id", "first"), "labels")
    labels = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    labels = labels.select("d0", "d1", "n_shingles", F.coalesce("first", "least").alias("component"))
    out = sketches.select("doc", "id", "n_shingles", "d0", "d1").join(labels, ["d0", "d1", "n_shingles"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    out = out.select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").alias("node"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "node")
