"""Packing documents into sequences by cutting-stock column generation.

1. Every document is tokenised once, ended by id 0 and cut into pieces of ``size`` ids and a rest.
   Full pieces are sequences of their own.
2. The rests' lengths are counted (a histogram of at most ``size - 1`` rows). On it, a linear
   program over patterns (multisets of lengths that fit one sequence) minimises the padded ids. Its
   columns are generated: a knapsack dynamic program over the dual prices finds the pattern with the
   best reduced cost, until the bound on what is still to gain is under ``gap``.
3. The patterns' uses are rounded down. The rests of each length are ranked (a distributed range
   exchange and prefix sums, so that a hot length is spread) and take the places that the patterns
   have for their length, by rank.
4. What rounding leaves (less than one sequence a pattern, so bounded by ``size``) is laid end to end
   and cut every ``size`` ids; the last stretch is cut into powers of two, which need no padding.

Null and empty texts are documents of one id (the ending 0). Repeated rows and ids are packed as
rows of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored
from .wordcode import byte_coder

SIZE = 1024
GAP = 0.0005
ROUNDS = 300
_PIECES = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _cut_all(path: str, size: int):
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for b in batches:
            for lo, ids, bounds in coder.batches(b.column(2)):
                docs, keys = b.column(0).slice(lo, len(bounds) - 1).to_pylist(), b.column(1).slice(lo, len(bounds) - 1).to_pylist()
                raw, cuts, rows = memoryview(ids.astype("<u4").tobytes()), bounds.tolist(), []
                for doc, key, begin, end in zip(docs, keys, cuts, cuts[1:]):
                    whole = bytes(raw[4 * begin:4 * end]) + b"\0\0\0\0"
                    n = end - begin + 1
                    for at in range(0, n, size):
                        part = whole[4 * at:4 * (at + size)]
                        rows.append((doc, key, at, len(part) // 4, zlib.crc32(part), n))
                yield _batch(rows, names)

    return run


def _cut_some(path: str):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for b in batches:
            rows, docs, every = [], b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, ids, bounds in coder.batches(b.column(1)):
                raw, ends = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                for doc, cuts, begin, end in zip(docs[lo:], every[lo:], ends, ends[1:]):
                    whole = bytes(raw[4 * begin:4 * end]) + b"\0\0\0\0"
                    for c in cuts:
                        part = whole[4 * c["start"]:4 * (c["start"] + c["length"])]
                        rows.append((doc, c["start"], c["length"], zlib.crc32(part), len(whole) // 4, c["sequence_id"], c["offset"]))
            if rows:
                yield _batch(rows, names)

    return run


def padded(total: int, size: int) -> int:
    """Ids that a sequence of ``total`` ids takes: ``size``, or itself if a power of two."""
    return total if total & (total - 1) == 0 else size


def price(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best value of each exact total, and the last length in it. ``values[l]`` is the
    price of length l (-inf: none)."""
    best, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    best[0] = 0.0
    for t in range(1, size + 1):
        gains = best[t - 1::-1][:t] + values[1:t + 1]
        k = int(gains.argmax())
        best[t], last[t] = gains[k], k + 1
    return best, last


def start_basis(histogram: dict[int, int], size: int) -> tuple[list[dict[int, int]], list[int]]:
    """A first basis of the linear program: the longest length that is left is filled up with the
    longest that still fit, and the pattern is used until one of its lengths is used up. Ordered by when
    lengths run out the patterns form a triangular matrix; a length that runs out together with another
    gets a pattern of its own, used 0 times. Returns the patterns and the length that each used up."""
    left = {k: float(v) for k, v in sorted(histogram.items())}
    cols: list[dict[int, int]] = []
    ends: list[int] = []
    while left:
        lengths = list(left)
        col, room = {lengths[-1]: 1}, size - lengths[-1]
        while (k := bisect.bisect_right(lengths, room)) > 0:
            length = lengths[k - 1]
            n = room // length if left[length] >= 2 else 1
            col[length] = col.get(length, 0) + n
            room -= n * length
        if room and 2 * room > lengths[0]:  # not full: the fullest mixture, by knapsack
            values = np.full(size + 1, -np.inf)
            values[lengths] = np.array(lengths, float) + np.array(lengths, float) ** 2 * 1e-7
            best, last = price(values, size)
            space = size - lengths[-1]
            t = int(np.flatnonzero(best[:space + 1] > -np.inf)[-1])
            col = {lengths[-1]: 1}
            while t:
                col[int(last[t])] = col.get(int(last[t]), 0) + 1
                t -= int(last[t])
        n = min(left[k] / v for k, v in col.items())
        gone = [k for k, v in col.items() if left[k] - n * v <= 1e-9 * max(1.0, histogram[k])]
        for k, v in col.items():
            left[k] -= n * v
        for i, k in enumerate(gone):
            del left[k]
            cols.append({k: size // k} if i else col)
            ends.append(k)
    return cols, ends


def patterns(histogram: dict[int, int], size: int = SIZE, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[float, dict[int, int]]]:
    """Column generation: (uses, {length: copies}) with uses > 0, covering the histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    m = len(lengths)
    if not m:
        return []
    row = {int(x): i for i, x in enumerate(lengths)}
    need = np.array([histogram[int(x)] for x in lengths], float)
    weight = np.array([padded(t, size) if t else size for t in range(size + 1)], float) / size
    cols, ends = start_basis(histogram, size)
    cost = np.array([weight[sum(k * v for k, v in c.items())] for c in cols])
    holders: dict[int, list[tuple[int, int]]] = {int(k): [] for k in lengths}
    inverse = np.zeros((m, m))
    for j, (c, end) in enumerate(zip(cols, ends)):  # forward substitution along the triangle
        inverse[j, row[end]] = 1.0
        for i, k in holders[end]:
            inverse[j] -= k * inverse[i]
        inverse[j] /= c[end]
        for length, k in c.items():
            holders[length].append((j, k))
    x = np.maximum(np.einsum("ij,j->i", inverse, need), 0.0)

    def enter(col: dict[int, int], c: float, sign: float = 1.0) -> bool:
        nonlocal x, inverse
        a = np.zeros(m)
        for length, k in col.items():
            a[row[length]] = sign * k
        d = np.einsum("ij,j->i", inverse, a)
        up = d > 1e-9
        if not up.any():
            return False
        ratio = np.where(up, x / np.where(up, d, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        x = np.maximum(x - step * d, 0.0)
        x[out] = step
        cols[out], cost[out] = (col if sign > 0 else {}), c
        return True

    for _ in range(rounds):
        dual = np.einsum("i,ij->j", cost, inverse)
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # covering more than needed pays: a surplus column enters
            enter({int(lengths[worst]): 1}, 0.0, -1.0)
            continue
        values = np.full(size + 1, -np.inf)
        values[lengths] = dual
        best, last = price(values, size)
        gain = best - weight
        if (best[1:] / weight[1:]).max() <= 1 + gap:  # Farley's bound
            break
        for t in np.argsort(-gain[1:])[:4] + 1:
            col, left = {}, int(t)
            while left:
                length = int(last[left])
                col[length] = col.get(length, 0) + 1
                left -= length
            dual = np.einsum("i,ij->j", cost, inverse)
            if sum(dual[row[k]] * v for k, v in col.items()) > weight[t] + 1e-9:
                enter(col, weight[t])
    return [(float(u), c) for u, c in zip(x, cols) if u > 1e-9 and c]


def rounded(histogram: dict[int, int], found: list[tuple[float, dict[int, int]]]) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Whole uses of each pattern, never more places than documents, and the documents left over."""
    left, out = dict(histogram), []
    for uses, col in sorted(found, key=lambda p: (-p[0], sorted(p[1].items()))):
        k = min([int(uses + 1e-6), *(left[x] // n for x, n in col.items())])
        if k > 0:
            out.append((k, col))
            for x, n in col.items():
                left[x] -= k * n
    return out, left


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    pieces = stored(src.mapInArrow(_cut_all(path, size), _PIECES).withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in
                 pieces.filter(F.col("length") < size).groupBy("length").count().collect()}  # under ``size`` rows
    uses, left = rounded(histogram, patterns(histogram, size))
    places, sequence, given = [], 0, dict.fromkeys(histogram, 0)
    for k, col in uses:
        offset = 0
        for length, copies in sorted(col.items(), reverse=True):
            places.append((length, given[length], given[length] + k * copies, sequence, copies, offset))
            given[length] += k * copies
            offset += length * copies
        sequence += k
    table = F.broadcast(spark.createDataFrame(
        places, "length long, lo long, hi long, first long, copies long, begin long"))  # a few rows a pattern
    ranked = positions(pieces.filter(F.col("length") < size), "length", ["rid"], "length", "pack-ranks")
    ranked = stored(ranked.select("doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "rid", "_rank").alias("r").join(
        table.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")),
        "left").select("doc_id", "text_key", "start", F.col("r.length").alias("length"), "ids_crc32", "doc_tokens", "rid",
                       (F.col("first") + F.floor((F.col("_rank") - F.col("lo")) / F.col("copies"))).alias("sequence_id"),
                       (F.col("begin") + (F.col("_rank") - F.col("lo")) % F.col("copies") * F.col("r.length")).alias("offset")),
        "pack-ranked")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = ranked.filter("sequence_id is not null").select(*names)
    # bounded: rounding leaves under one use of each pattern
    over = ranked.filter("sequence_id is null").select("doc_id", "text_key", "start", "length", "rid").orderBy("rid").collect()
    cuts, sequence = _lay(over, size, sequence)
    whole = pieces.filter(F.col("length") == size).select(
        *names[:5], (F.col("rid") + sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed.unionByName(whole)
    if not cuts:
        return out
    kind = "doc_id long, text_key long, cuts array<struct<start long, length long, sequence_id long, offset long>>"
    wanted = F.broadcast(spark.createDataFrame(cuts, kind).alias("w"))
    chosen = src.alias("s").join(wanted.select("doc_id", "text_key").distinct().alias("k"),
                                 F.expr("s.doc_id <=> k.doc_id and s.text_key = k.text_key"), "left_semi")
    chosen = chosen.dropDuplicates(["doc_id", "text_key"]).alias("s").join(
        wanted, F.expr("s.doc_id <=> w.doc_id and s.text_key = w.text_key")).select("s.doc_id", "s.text", "w.cuts")
    again = chosen.mapInArrow(_cut_some(path), ", ".join(f"{x} long" for x in names))
    return out.unionByName(again)


def _lay(over: list, size: int, sequence: int) -> tuple[list[tuple], int]:
    """Lay the left-over rests end to end and cut them: ((doc_id, text_key, cuts), ...), next sequence."""
    total = sum(r["length"] for r in over)
    limits = [size] * (total // size)
    limits += [1 << k for k in reversed(range(size.bit_length())) if total % size >> k & 1]
    out, k, used = [], 0, 0
    for r in over:
        start, length, mine = r["start"], r["length"], []
        while length:
            take = min(length, limits[k] - used)
            mine.append((start, take, sequence + k, used))
            start, length, used = start + take, length - take, used + take
            if used == limits[k]:
                k, used = k + 1, 0
        out.append((r["doc_id"], r["text_key"], mine))
    return out, sequence + len(limits)
