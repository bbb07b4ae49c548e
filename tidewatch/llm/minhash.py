"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles (lower-cased, split at white space; a
text with fewer words is one shingle): weight = count in the text * idf, where
idf = 1 + ln((1 + N) / (1 + df)) / ln(2 + N) lies between 1 and 2. Document frequencies are exact counts
over all documents: each block of documents sends its distinct shingles with their counts, packed, to parts
by shingle, where they are added up; frequencies above 1 go back to their blocks. Parts and blocks hold a
bounded number of bytes of text, and no table of shingles is broadcast.

1. Improved consistent weighted sampling (Ioffe 2010) gives 64 samples a document; two documents
   agree in a sample with the probability of their weighted Jaccard similarity (sum of minima over
   sum of maxima). Equal texts are one document from here on.
2. The samples are banded (16 bands of 4). In each bucket everyone is paired with the bucket's leader,
   its most central document (the one whose buckets hold the most members: in a group of edited copies
   that is the least edited one); those it does not match meet the most central of the rest, for some
   rounds. A pair whose samples promise ``near`` or more is verified on the texts' exact weights;
   ``similarity`` or more is a link.
3. Classes are the connected components of the links (large-star and small-star steps).
4. Documents that are still in another class than their bucket's leader meet all the bucket's members
   of other classes, and the components are taken again. So every pair of a bucket is either tested or
   already in one class. In a bucket of at most ``small`` members they meet in a join. A larger bucket is
   dealt into tiles of about ``tile`` by ``tile`` texts, in which a pair is left out only if an upper
   bound of its similarity is too low: the weights summed in 256 bins by shingle hash have a sum of
   minima that is never smaller than that of the weights themselves.

Pairs meet in joins on bucket and text keys, whose hot keys AQE splits, and in tiles; no group is collected.

Null texts and texts without a word are in no bucket: their class is their own id. Equal texts are one
class even if ids repeat. class_id is the smallest id of the class; rows with a null id have the class
of their text, which is null if no row has an id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .common import stored

WORDS, SIMILARITY, NEAR = 5, 0.8, 0.55
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
LEADER_ROUNDS = 3
SMALL = 64
TILE, BINS = 512, 256
#: Bytes of text of a block, and of a part of the shingles.
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
_SLOTS = 1 << 20
_POOL = 1 << 13
U = np.uint64


@dataclass(frozen=True)
class Frequencies:
    """Number of documents; for texts without counts of their own, a count-min sketch of document frequencies."""

    documents: int
    sketch: np.ndarray | None = None  # (2, _SLOTS)

    def idf(self, shingle: np.ndarray, df: np.ndarray | None = None) -> np.ndarray:
        if df is None:
            a, b = _slots(shingle)
            df = np.minimum(self.sketch[0][a], self.sketch[1][b])
        return 1 + np.log((1 + self.documents) / (1 + np.minimum(df, self.documents))) / math.log(2 + self.documents)


def _slots(shingle: np.ndarray):
    return (shingle & U(_SLOTS - 1)).astype(np.int64), ((shingle >> U(20)) & U(_SLOTS - 1)).astype(np.int64)


def weighted(data: np.ndarray, offs: np.ndarray, size: int = WORDS):
    """(row, 44-bit shingle, count), by row and shingle, of a run of texts."""
    row, h = V.shingles(V.words(data, offs), size)
    key = np.sort((row.astype(np.uint64) << U(44)) | (h >> U(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> U(44)).astype(np.int64), key & U((1 << 44) - 1), count


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers, compressed."""
    v = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    v = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(v.T).view("<u8").reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


@F.arrow_udf(T.LongType())
def block_of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Block number of a row, from the byte lengths of a partition's texts in reading order."""
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    for lengths in it:
        size = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = done + np.cumsum(size) - size
        done += int(size.sum())
        yield pa.array((part << 40) | (before // BLOCK_BYTES), pa.int64())


COUNTS = "part long, block long, shingles binary, counts binary"


def _count_shingles(parts: int):
    """mapInArrow function over (block, text): a block's distinct shingles and their document counts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def flush():
            if held:
                sh, n = np.unique(np.concatenate(held), return_counts=True)
                part = (sh % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
                own = np.split(order, cuts[1:])
                yield pa.record_batch([pa.array(part[order[cuts]]), pa.array(np.full(len(cuts), block)),
                                       pa.array([_pack_sorted(sh[x]) for x in own], pa.binary()),
                                       pa.array([_pack(n[x]) for x in own], pa.binary())], ["part", "block", "shingles", "counts"])

        for b in batches:
            blocks = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi > lo and blocks[lo] != block:
                    yield from flush()
                    block, held = int(blocks[lo]), []
                for _, data, offs in V.slices(b.column(1).slice(lo, hi - lo)):
                    sh = weighted(data, offs)[1]
                    if len(sh):
                        held.append(sh)
        yield from flush()

    return run


def _add_counts(key: tuple, t: pa.Table) -> pa.Table:
    """Grouped function over a part: each block's shingles that are in more than one document, with their number."""
    lists = [_unpack_sorted(x) for x in t["shingles"].to_pylist()]
    counts = np.concatenate([_unpack(x) for x in t["counts"].to_pylist()])
    _, at = np.unique(np.concatenate(lists), return_inverse=True)
    df = np.bincount(at, counts).astype(np.int64)[at]
    out, lo = [], 0
    for block, sh in zip(t["block"].to_pylist(), lists):
        mine = df[lo:lo + len(sh)]
        lo += len(sh)
        if (mine > 1).any():
            out.append((key[0].as_py(), block, _pack_sorted(sh[mine > 1]), _pack(mine[mine > 1])))
    cols = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["part", "block", "shingles", "counts"])


def document_frequencies(docs: DataFrame) -> tuple[Frequencies, DataFrame]:
    """Number of documents with a word, and (block, shingles, counts) of the shingles in more than one document,
    from (block, text) rows."""
    size = docs.agg(F.count_if(F.col("text").rlike(r"[^ \t-\r]")).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size["b"] or 0) // PART_BYTES)
    counts = docs.select("block", F.lower("text").alias("text")).mapInArrow(_count_shingles(parts), COUNTS)
    return Frequencies(size["n"]), counts.groupBy("part").applyInArrow(_add_counts, COUNTS).select("block", "shingles", "counts")


_DRAWS: dict[int, tuple] = {}


def _draws(seed: int = 1234):
    """Random variates of the sampling, in pools of fixed size: a shingle takes its gamma, beta and
    scale rows from different bits of its hash, every sample has its own column."""
    if seed not in _DRAWS:
        rng = np.random.Generator(np.random.PCG64(seed))
        r = rng.gamma(2.0, 1.0, (_POOL, SAMPLES)).astype(np.float32).clip(1e-4)
        c = np.log(rng.gamma(2.0, 1.0, (_POOL, SAMPLES)).clip(1e-12)).astype(np.float32)
        beta = rng.random((_POOL, SAMPLES), np.float32)
        _DRAWS[seed] = r, 1 / r, c, beta
    return _DRAWS[seed]


def samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, block: int = 1024):
    """(rows that have shingles, their 64 samples as numbers). For each sample, of all shingles the one
    with the smallest ln a = ln c - r * (t - beta + 1), t = floor(ln w / r + beta), wins; the sample
    is (shingle, t)."""
    r_, inv_, c_, beta_ = _draws()
    h = V.mix(shingle)
    ia, ib, ic = (((h >> U(s)) & U(_POOL - 1)).astype(np.int64) for s in (0, 13, 26))
    lw = np.log(weight).astype(np.float32)[:, None]
    owners, first = np.unique(row, return_index=True)
    at = np.repeat(np.arange(len(owners)), np.diff(np.append(first, len(row))))
    # (order-keeping bits of ln a, place) in one number, so that one minimum finds value and winner
    low = np.full((len(owners), SAMPLES), np.iinfo(np.int64).max)
    for lo in range(0, len(row), block):
        s = slice(lo, min(len(row), lo + block))
        a = ia[s]
        beta = beta_[ib[s]]
        la = lw[s] * inv_[a]
        la += beta
        np.floor(la, out=la)
        la -= beta
        la += 1
        la *= r_[a]
        np.subtract(c_[ic[s]], la, out=la)
        bits = la.view(np.int32)
        bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)
        key = bits.astype(np.int64)
        key <<= 32
        key += np.arange(s.start, s.stop)[:, None]
        own = at[s]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows = own[cut]
        low[rows] = np.minimum(low[rows], np.minimum.reduceat(key, cut, axis=0))
    win = low & 0xFFFFFFFF
    col = np.arange(SAMPLES)[None, :]
    t = np.floor(lw[win, 0] * inv_[ia[win], col] + beta_[ib[win], col]).astype(np.int64)
    return owners, V.mix(shingle[win] ^ (t.view(np.uint64) * U(0x9E3779B97F4A7C15)))


SIGNED = "doc_id long, k binary, bands array<long>, samples binary, df binary"


def _sign(freq: Frequencies):
    """Grouped function over a block, (doc_id, k, text) and the frequencies of its shingles: bands, samples and the
    frequencies in the order of :func:`weighted`; null for a text without words."""

    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        shingles = np.concatenate([none, *map(_unpack_sorted, known["shingles"].to_pylist())])
        counts = np.concatenate([none, *map(_unpack, known["counts"].to_pylist())])
        order = np.argsort(shingles, kind="stable")
        # a last entry that no shingle equals
        shingles, counts = np.append(shingles[order], U((1 << 64) - 1)), np.append(counts[order], U(1))
        salt = V.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        n = docs.num_rows
        out: list = [[None] * n for _ in range(3)]
        for first, data, offs in V.slices(docs["text"]):
            row, sh, count = weighted(data, offs)
            if not len(row):
                continue
            at = np.searchsorted(shingles, sh)
            df = np.where(shingles[at] == sh, counts[at], U(1))
            owners, got = samples(row, sh, count * freq.idf(sh, df))
            part = got.reshape(len(owners), BANDS, ROWS)
            bands = salt[None, :].repeat(len(owners), 0)
            for k in range(ROWS):
                bands = V.mix(bands * U(0x9E3779B97F4A7C15) + part[:, :, k])
            low, each = (got & U(0xFFFF)).astype("<u2"), df.astype("<u4")
            ends = np.searchsorted(row, owners, "right").tolist()
            for k, (r, lo, hi) in enumerate(zip(owners.tolist(), [0, *ends], ends)):
                for c, x in zip(out, (bands[k].view(np.int64).tolist(), low[k].tobytes(), each[lo:hi].tobytes())):
                    c[first + r] = x
        return pa.table({"doc_id": docs["doc_id"], "k": docs["k"], "bands": pa.array(out[0], pa.list_(pa.int64())),
                         "samples": pa.array(out[1], pa.binary()), "df": pa.array(out[2], pa.binary())})

    return run


@F.arrow_udf(T.DoubleType())
def promised(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal samples."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, SAMPLES) for c in (a, b))
    return pa.array((x == y).mean(1) if len(x) else np.zeros(0))


def weighted_jaccard(freq: Frequencies, a: pa.Array, b: pa.Array, dfs: tuple[pa.Array, pa.Array] | None = None) -> np.ndarray:
    """Weighted Jaccard similarity of text pairs, exact with the document frequencies of each text's shingles."""
    out = np.zeros(len(a))
    size = np.cumsum(_lengths(a) + _lengths(b))
    lo = 0
    while lo < len(a):
        # about a megabyte of text at a time, one pair at least
        n = max(1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 20), "right")) - lo)
        both = pa.concat_arrays([x.slice(lo, n).cast(pa.large_string()) for x in (a, b)])
        keys, weights = [], []
        for _, data, offs in V.slices(both, 1 << 62):
            row, sh, count = weighted(data, offs)
            w = count * freq.idf(sh, None if dfs is None else _frequencies(pa.chunked_array([x.slice(lo, n) for x in dfs])))
            for side in (row < n, row >= n):
                keys.append(((row[side] % n).astype(np.uint64) << U(44)) | sh[side])
                weights.append(w[side])
        _, i, j = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
        pair = (keys[0][i] >> U(44)).astype(np.int64)
        least = np.bincount(pair, np.minimum(weights[0][i], weights[1][j]), n)
        total = sum(np.bincount((k >> U(44)).astype(np.int64), w, n) for k, w in zip(keys, weights))
        out[lo:lo + n] = least / np.maximum(total - least, 1e-12)
        lo += n
    return out


def _frequencies(dfs) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in dfs.to_pylist()), "<u4").astype(np.int64)


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def similarity_column(freq: Frequencies, a: Column, b: Column, df_a: Column, df_b: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def similar(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y, dx, dy in it:
            yield pa.array(weighted_jaccard(freq, x, y, (dx, dy)))

    return similar(F.lower(a), F.lower(b), df_a, df_b)


BINNED = T.StructType([T.StructField("bins", T.BinaryType()), T.StructField("total", T.DoubleType())])


def binned(freq: Frequencies, texts: pa.Array, dfs: pa.Array | None = None) -> list[tuple[bytes, float]]:
    """(weights summed in ``BINS`` bins by shingle hash, rounded up to 16-bit floats; sum of weights) of each text."""
    out = []
    for first, data, offs in V.slices(texts):
        row, sh, count = weighted(data, offs)
        n = len(offs) - 1
        w = count * freq.idf(sh, None if dfs is None else _frequencies(dfs.slice(first, n)))
        sums = np.bincount(row * BINS + (V.mix(sh) % U(BINS)).astype(np.int64), w, n * BINS)
        with np.errstate(over="ignore"):  # infinity is a bound, too
            up = sums.astype(np.float16)
        up = np.where(up < sums, np.nextafter(up, np.float16(np.inf)), up).reshape(n, BINS)
        out += zip((x.tobytes() for x in up), np.bincount(row, w, n).tolist())
    return out


def binned_column(freq: Frequencies, text: Column, df: Column) -> Column:
    @F.arrow_udf(BINNED)
    def sums(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for x, d in it:
            yield pa.array([{"bins": b, "total": t} for b, t in binned(freq, x, d)], to_arrow_type(BINNED))

    return sums(F.lower(text), df)


def _tile_pairs(similarity: float):
    """Grouped function over a tile, (odd, k, root, bins, total): the pairs (a, b) of its odd texts with its
    other texts of other classes whose similarity may reach ``similarity``."""

    def run(t: pa.Table) -> pa.Table:
        keys, odd = t["k"].to_pylist(), t["odd"].to_numpy()
        _, root = np.unique(np.array([r.hex() for r in t["root"].to_pylist()]), return_inverse=True)
        bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.float16).reshape(-1, BINS).astype(np.float32)
        total = t["total"].to_numpy()
        rest = np.flatnonzero(~odd)
        a, b = [], []
        for i in np.flatnonzero(odd).tolist():
            other = rest[root[rest] != root[i]]
            most = np.minimum(bins[other], bins[i]).sum(1, dtype=np.float64)
            # a ten-thousandth for rounding
            for j in other[most >= (similarity - 1e-4) * (total[other] + total[i] - most)].tolist():
                x, y = sorted((keys[i], keys[j]))
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def tiled_pairs(large: DataFrame, sums: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b) from (bucket, k, root, main, n) and (k, bins, total): all pairs of a bucket's texts outside the class
    ``main`` with its texts of other classes, less those that the bins rule out. A bucket is dealt by text key into
    n / tile parts, and each two parts meet in a group of their own."""
    parts = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("k"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    given = large.withColumn("mine", mine).withColumn("other", other)
    cols = ["k", "root"]
    odd = given.filter("root <> main").select("bucket", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("odd"), *cols)
    every = given.select("bucket", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("odd"), *cols)
    return odd.unionByName(every).join(sums, "k").groupBy("bucket", "i", "j").applyInArrow(
        _tile_pairs(similarity), "a binary, b binary").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(k, root) of every linked key: alternating large-star and small-star steps (Kiveris et al. 2014),
    each stored, until every key points to a root. A star's leaves are rows, never a collected list. Steps halve the
    depth, so ``most_rounds`` is beyond any graph; reaching it is an error."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    for _ in range(most_rounds):
        # stars: a key points to one other, and what it points to points nowhere
        pointing = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        ends = edges.select("b").distinct()
        if pointing.filter("n > 1").select("a").unionByName(pointing.join(ends, F.col("a") == F.col("b"), "left_semi").select("a")).isEmpty():
            break
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # an edge gives at most one: repeats are dropped once, at the end
        large = near.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m", "a")
        edges = stored(small.select(F.col("a"), F.col("m").alias("b")).unionByName(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "cc")
    else:
        raise RuntimeError(f"classes unfinished after {most_rounds} rounds")
    return edges.select(F.col("a").alias("k"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("k"), F.col("b").alias("root")).distinct())


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


class _Verifier:
    """Tests (a, b) key pairs once each, on whole texts."""

    def __init__(self, freq: Frequencies, texts: DataFrame, similarity: float, near: float):
        self.freq, self.texts, self.similarity, self.near = freq, texts, similarity, near

    def links(self, pairs: DataFrame, signs: DataFrame, name: str) -> DataFrame:
        """The pairs whose samples promise ``near`` and whose texts are similar."""
        sa = signs.select(F.col("k").alias("a"), F.col("samples").alias("x"))
        sb = signs.select(F.col("k").alias("b"), F.col("samples").alias("y"))
        hopeful = pairs.join(sa, "a").join(sb, "b").filter(promised(F.col("x"), F.col("y")) >= self.near).select("a", "b")
        return self.similar(hopeful, name)

    def similar(self, pairs: DataFrame, name: str) -> DataFrame:
        ta = self.texts.select(F.col("k").alias("a"), F.col("text").alias("x"), F.col("df").alias("dx"))
        tb = self.texts.select(F.col("k").alias("b"), F.col("text").alias("y"), F.col("df").alias("dy"))
        # b first: pairs that come from ``links`` lie by b already
        tested = pairs.join(tb, "b").join(ta, "a").select(
            "a", "b", similarity_column(self.freq, *map(F.col, ("x", "y", "dx", "dy"))).alias("similarity"))
        return stored(tested.filter(F.col("similarity") >= self.similarity), name)


def _odd_pairs(rooted: DataFrame, name: str, small: int) -> tuple[DataFrame, DataFrame]:
    """From (bucket, k, c, root): the pairs (a, b) of the texts outside their leader's class with the
    bucket's members of other classes, in buckets of at most ``small`` texts, and the (bucket, k, root, main, n)
    of the larger mixed buckets."""
    main = rooted.groupBy("bucket").agg(F.max_by("root", F.struct("c", "k")).alias("main"), F.min("root").alias("r0"),
                                        F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 <> r1")
    mixed = stored(rooted.join(main.select("bucket", "main", "n"), "bucket"), name)
    near = mixed.filter(F.col("n") <= small)
    odd = near.filter("root <> main").select("bucket", F.col("k").alias("ka"), F.col("root").alias("ra"))
    # neither side repeats a class's inner pairs; the smaller side is that of the odd ones out
    met = near.select("bucket", F.col("k").alias("kb"), F.col("root").alias("rb")).join(odd, "bucket").filter("ra <> rb")
    return (met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct(),
            mixed.filter(F.col("n") > small).select("bucket", "k", "root", "main", "n"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           similarity: float = SIMILARITY, near: float = NEAR, rounds: int = LEADER_ROUNDS,
                           small: int = SMALL, tile: int = TILE) -> DataFrame:
    """One row a document: doc_id, text_key, class_id, class_key (text key of the class's first document)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = stored(src.select("doc_id", text_key(F.col("text")).alias("k"), "text", block_of(F.octet_length("text")).alias("block")), "near-docs")
    freq, known = document_frequencies(src)
    signed = stored(src.select("block", "doc_id", "k", F.lower("text").alias("text")).groupBy("block").cogroup(
        known.groupBy("block")).applyInArrow(_sign(freq), SIGNED), "near-signs")
    # one row a text: the copy with the smallest id stands for it
    one = stored(signed.filter("bands is not null").groupBy("k").agg(F.min("doc_id").alias("doc_id"), *(
        F.first(c).alias(c) for c in ("bands", "samples", "df"))), "near-texts")
    spread = one.select("k", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared_buckets = stored(spread.join(full, "bucket"), "near-shared")
    wanted = shared_buckets.groupBy("k").agg(F.sum("n").alias("c"))  # centrality: members of a text's buckets
    members = stored(shared_buckets.select("bucket", "k").join(wanted, "k").select("bucket", "k", "c"), "near-buckets")
    signs = stored(one.join(wanted, "k", "left_semi"), "near-wanted")
    # by (k, id) and not by k alone, so that the copies of one text spread over tasks and only one stays
    texts = stored(src.alias("d").join(
        signs.select("k", "doc_id").alias("w"), F.expr("d.k = w.k and d.doc_id <=> w.doc_id"), "left_semi")
        .dropDuplicates(["k", "doc_id"]).select("k", "text").join(signs.select("k", "df"), "k"), "near-chosen")
    verifier = _Verifier(freq, texts, similarity, near)

    links, tested, active = [], [], members
    for r in range(rounds):
        lead = active.groupBy("bucket").agg(F.max_by("k", F.struct("c", "k")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        led = stored(active.join(lead, "bucket").filter("k <> lead").select("bucket", "k", "c", "lead"), f"near-led{r}")
        pairs = led.select(F.least("lead", "k").alias("a"), F.greatest("lead", "k").alias("b")).distinct()
        if tested:
            pairs = pairs.join(_union(tested), ["a", "b"], "left_anti")
        pairs = stored(pairs, f"near-pairs{r}")
        if pairs.isEmpty():
            break
        tested.append(pairs)
        links.append(verifier.links(pairs, signs, f"near-links{r}").select("a", "b"))
        found = _union(links)
        linked = found.select(F.col("a").alias("lead"), F.col("b").alias("k")).unionByName(
            found.select(F.col("b").alias("lead"), F.col("a").alias("k")))
        active = led.join(linked, ["lead", "k"], "left_anti").select("bucket", "k", "c")
    roots = one.select("k", F.col("k").alias("root")).limit(0)
    if links:
        roots = stored(components(_union(links)), "near-roots")
        rooted = members.join(roots, "k", "left").select("bucket", "k", "c", F.coalesce("root", "k").alias("root"))
        rest, large = _odd_pairs(rooted, "near-mixed", small)
        rest = stored(rest.join(_union(tested), ["a", "b"], "left_anti"), "near-rest")
        more = []
        if not rest.isEmpty():
            more.append(verifier.links(rest, signs, "near-more").select("a", "b"))
        if not large.isEmpty():
            sums = texts.join(large.select("k").distinct(), "k", "left_semi").select("k", binned_column(freq, F.col("text"), F.col("df")).alias("s"))
            sums = stored(sums.select("k", "s.bins", "s.total"), "near-bins")
            tiles = stored(tiled_pairs(large, sums, similarity, tile).join(_union(tested), ["a", "b"], "left_anti"), "near-tiles")
            more.append(verifier.similar(tiles, "near-tiled").select("a", "b"))
        if more and not _union(more).isEmpty():
            roots = stored(components(_union(links + more)), "near-roots")
    ids = one.select("k", "doc_id").join(roots, "k", "left").select("k", "doc_id", F.coalesce("root", "k").alias("root"))
    # ids before no ids
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("f"))
    named = ids.join(first, "root").select("k", F.col("f.doc_id").alias("class_id"), F.col("f.k").alias("class_key"))
    has = F.col("bands").isNotNull()
    return signed.select("doc_id", F.col("k").alias("text_key"), has.alias("has")).join(
        named, F.col("text_key") == F.col("k"), "left").select(
        "doc_id", "text_key", F.when(F.col("has"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("has"), F.col("class_key")).otherwise(F.col("text_key")).alias("class_key"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the smallest id
    stays, once, with the columns it had. Documents without a word all stay, equal rows once."""
    classes = near_duplicate_classes(docs, id_col, text_col)
    kept = classes.filter("doc_id <=> class_id and text_key = class_key").select("doc_id", "text_key").distinct()
    names = docs.columns
    d = [f"_d{i}" for i in range(len(names))]
    plain = docs.toDF(*d)
    plain = plain.withColumn("_k", text_key(F.col(d[names.index(text_col)]))).withColumn(
        "_i", F.col(d[names.index(id_col)]).cast("long"))
    mine = plain.alias("p").join(kept.alias("w"), F.expr("p._k = w.text_key and p._i <=> w.doc_id"), "left_semi")
    return mine.dropDuplicates(["_k", "_i"]).select(*d).toDF(*names)
