"""Best-fit packing of whole documents, improved by local search.

1. Every document is tokenised once and ended by ``end_id``. Only documents of more than ``size`` ids are
   cut: into pieces of ``size``, the first of which may be shorter. Full pieces fill a sequence each.
2. The other pieces' lengths are counted: a histogram of under ``size`` rows, whatever the corpus.
3. ``best_fit`` fills bins by decreasing length, each piece into the fullest bin that holds it. Bins with
   equal contents are one *class* with a count, so that the work depends on ``size`` and not on the
   number of documents; a length adds at most two classes.
4. ``swap_search`` exchanges between underfull classes: a piece moves, or is exchanged one for one, two
   for one or one for two, out of the emptier bin into the fuller one. Each exchange increases the sum of
   squared fills and is made in as many bins at once as both classes have. It ends when the number of bins
   is that of the ids divided by ``size``, when no exchange is left, or after ``MOVES`` exchanges.
5. The pieces of each length are ranked (range exchange and prefix sums, so a hot length is spread) and
   take the places that the classes have for their length, by rank. The table of places has at most one
   row a length and class, so its size is bounded by ``size`` too.

Null and empty texts are documents of one id. Repeated rows and ids, null ids too, are packed as rows of
their own; equal lengths take places in the order of the stored rows. An empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored
from .wordcode import byte_coder

SIZE = 1024
END_ID = 2
#: Exchanges of the search; what it leaves is a valid packing.
MOVES = 20_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bin contents: (length, copies) pairs, longest first.
Pattern = tuple[tuple[int, int], ...]


def _cut(path: str, size: int, end_id: int):
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for b in batches:
            for lo, ids, bounds in coder.batches(b.column(1)):
                docs = b.column(0).slice(lo, len(bounds) - 1).to_pylist()
                raw, cuts, rows = memoryview(ids.astype("<u4").tobytes()), bounds.tolist(), []
                for doc, first, last in zip(docs, cuts, cuts[1:]):
                    whole = bytes(raw[4 * first:4 * last]) + end
                    n = last - first + 1
                    at = 0
                    for k in range(-(-n // size)):
                        length = n % size or size if k == 0 else size
                        rows.append((doc, k, at, length, zlib.crc32(whole[4 * at:4 * (at + length)])))
                        at += length
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _with(pattern: Pattern, change: dict[int, int]) -> Pattern:
    """The pattern with copies of lengths added (or taken away)."""
    have = Counter(dict(pattern))
    for length, k in change.items():
        have[length] += k
    return tuple(sorted(((x, k) for x, k in have.items() if k), reverse=True))


def _fill(pattern: Pattern) -> int:
    return sum(x * k for x, k in pattern)


def best_fit(histogram: dict[int, int], size: int) -> Counter:
    """Best fit by decreasing length: bins of each pattern."""
    free: dict[int, Counter] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in free if r >= length):
            k = room // length
            for pattern, bins in sorted(free[room].items()):
                for copies, times in ((k, min(bins, left // k)), (left % k, 1)):
                    if copies and times and 0 < copies * times <= left and free[room][pattern] >= times:
                        free[room][pattern] -= times
                        free.setdefault(room - copies * length, Counter())[_with(pattern, {length: copies})] += times
                        left -= copies * times
                free[room] = +free[room]
                if not left:
                    break
            if not free[room]:
                del free[room]
            if not left:
                break
        k = size // length
        for copies, times in ((k, left // k), (left % k, 1)):
            if copies and times:
                free.setdefault(size - copies * length, Counter())[((length, copies),)] += times
    return sum(free.values(), Counter())


class _Sums:
    """What can leave a bin: totals of one and of two of its pieces, ascending, and which pieces."""

    def __init__(self, pattern: Pattern):
        one = {x: (x,) for x, _ in pattern}
        two: dict[int, tuple[int, ...]] = {}
        for i, (x, k) in enumerate(pattern):
            for y, _ in (pattern[i:] if k > 1 else pattern[i + 1:]):
                two.setdefault(x + y, (x, y))
        self.one, self.two = np.array(sorted(one), np.int64), np.array(sorted(two), np.int64)
        self.single, self.pair = one, two


def _best(a: _Sums, b: _Sums, gap: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The largest net move into a bin with ``gap`` places left: (ids, pieces out of a, pieces out of b)."""
    best = (0, (), ())
    fits = a.one[a.one <= gap]
    if len(fits):
        best = (int(fits[-1]), a.single[int(fits[-1])], ())
    for out, names, back, said in ((a.one, a.single, b.one, b.single), (a.two, a.pair, b.one, b.single), (a.one, a.single, b.two, b.pair)):
        if best[0] == gap or not len(out) or not len(back):
            continue
        at = np.searchsorted(back, out - gap)  # the least that may come back for each that leaves
        ok = at < len(back)
        net = np.where(ok, out - back[np.minimum(at, len(back) - 1)], 0)
        k = int(net.argmax())
        if net[k] > best[0]:
            best = (int(net[k]), names[int(out[k])], said[int(back[at[k]])])
    return best


def swap_search(bins: Counter, size: int, moves: int = MOVES) -> Counter:
    """Exchanges between underfull bins until none increases the sum of squared fills."""
    bins = Counter(bins)
    least = -(-sum(_fill(p) * n for p, n in bins.items()) // size)
    sums: dict[Pattern, _Sums] = {}
    stuck: set[tuple[Pattern, Pattern]] = set()

    def of(p: Pattern) -> _Sums:
        if p not in sums:
            sums[p] = _Sums(p)
        return sums[p]

    for _ in range(moves):
        if bins.total() <= least:
            break
        under = sorted((p for p in bins if _fill(p) < size), key=lambda p: (_fill(p), p))
        found = None
        for i, a in enumerate(under):
            gains = []
            for b in under[i:]:
                if (a, b) in stuck or (a == b and bins[a] < 2):
                    continue
                net, out, back = _best(of(a), of(b), size - _fill(b))
                if net:
                    gains.append((net * (net + _fill(b) - _fill(a)), b, out, back))
                else:
                    stuck.add((a, b))
            if gains:
                found = (a, *max(gains, key=lambda g: (g[0], g[1]))[1:])
                break
        if found is None:
            break
        a, b, out, back = found
        times = bins[a] // 2 if a == b else min(bins[a], bins[b])
        change = Counter(back)
        change.subtract(out)
        for p, sign in ((a, 1), (b, -1)):
            bins[p] -= times
            new = _with(p, {x: sign * k for x, k in change.items()})
            if new:
                bins[new] += times
        bins = +bins
    return bins


def best_fit_sequences(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(src.mapInArrow(_cut(path, size, end_id), _PIECES).withColumn("rid", F.monotonically_increasing_id()), "fit-pieces")
    rests = pieces.filter(F.col("length") < size)
    histogram = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}  # under ``size`` rows
    places, sequence, given = [], 0, dict.fromkeys(histogram, 0)
    for pattern, n in sorted(swap_search(best_fit(histogram, size), size).items(), reverse=True):
        offset = 0
        for length, copies in pattern:
            places.append((length, given[length], given[length] + n * copies, sequence, copies, offset))
            given[length] += n * copies
            offset += length * copies
        sequence += n
    table = F.broadcast(spark.createDataFrame(
        places, "length long, lo long, hi long, first long, copies long, begin long").alias("p"))  # one row a class and length
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = positions(rests, "length", ["rid"], "length", "fit-ranks").alias("r")
    at = F.col("_rank") - F.col("lo")
    placed = ranked.join(table, (F.col("r.length") == F.col("p.length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))) \
        .select(*[F.col(f"r.{x}").alias(x) for x in names],
                (F.col("first") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
                (F.col("begin") + at % F.col("copies") * F.col("r.length")).alias("offset"))
    whole = pieces.filter(F.col("length") == size).select(
        *names, (F.col("rid") + sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
