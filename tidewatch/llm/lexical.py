"""Ranked lexical search, reversed: documents stream past an index of the items.

1. Items are read in blocks of at most ``BLOCK_CHARS`` characters (a longer item is a block of its own).
   A block's inverted index (term: items that hold it, with repeats) is broadcast; its size is bounded
   by the block, whatever the number of items or documents.
2. One pass over the documents counts each one's terms and stores a row a document: its length and the
   counts of the block's terms in it. From these rows come N, L and the block's document frequencies.
3. A second pass streams the stored counts through the index. A task keeps a heap of ``top`` rows an
   item; a document enters only if it reaches the heap's last score. Heaps are merged in two steps,
   first in ``SALTS`` parts an item, so that no task gets every task's heap of an item.

Terms are maximal runs of characters other than ASCII non-alphanumerics, with A-Z lower-cased. Weights and
lengths are whole numbers as the formulas in ``weights`` and ``norms`` say. Scores over 0 only; equal
scores by ascending id, null ids last. Null and empty texts have no terms: such documents count nowhere and
such items have no rows. Each row is a document or item of its own, repeated ids too. Other columns are
ignored. No items or no documents give an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .wordcode import chunks, per_text, spread

TOP = 20
BLOCK_CHARS = 4_000_000
SALTS = 64
#: Index hits and scores that a task holds at a time.
HITS = 2_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RESULT = "item_row long, item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(_FOLD).decode().split(" ") if text else []


@dataclass
class Index:
    """A block's items: ids, sorted distinct terms, and each term's (item, repeats) rows."""

    first: int
    ids: list
    terms: pa.Array
    starts: np.ndarray
    counts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray

    @staticmethod
    def of(first: int, rows: list[tuple]) -> Index:
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(rows):
            for term, k in Counter(t for t in terms_of(text) if t).items():
                held.setdefault(term, []).append((i, k))
        terms = sorted(held)
        counts = np.array([len(held[t]) for t in terms], np.int64)
        flat = np.array([p for t in terms for p in held[t]], np.int64).reshape(-1, 2)
        return Index(first, [r[0] for r in rows], pa.array(terms, pa.string()), np.cumsum(counts) - counts, counts,
                     flat[:, 0], flat[:, 1])


def blocks(items: DataFrame, most: int) -> Iterator[Index]:
    """Indexes of the items' rows, a bounded number of characters at a time."""
    rows, size, first = [], 0, 0
    for r in items.toLocalIterator():
        n = len(r[1] or "") + 1
        if rows and size + n > most:
            yield Index.of(first, rows)
            first, rows, size = first + len(rows), [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield Index.of(first, rows)


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + 25 * lengths * n_docs // n_terms


def _fold(texts: pa.Array) -> pa.Array:
    """Lower-cased, with every character outside terms as a space."""
    texts = texts.cast(pa.string())
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    valid, offsets, data = texts.buffers()
    return pa.Array.from_buffers(pa.string(), len(texts), [valid, offsets, pa.py_buffer(data.to_pybytes().translate(_FOLD))], offset=texts.offset)


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for b in batches:
            for lo, some in chunks(_fold(b.column(1))):
                lists = pc.split_pattern(pc.fill_null(some, ""), " ")
                bounds = lists.offsets.to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                words = lists.flatten()
                n = per_text(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), bounds)
                code = pc.index_in(words, value_set=terms)
                hit = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
                doc = np.repeat(np.arange(len(some)), np.diff(bounds))[hit]
                cell, tf = np.unique(doc * max(1, len(terms)) + code.take(pa.array(hit)).to_numpy(zero_copy_only=False), return_counts=True)
                packed = memoryview(np.stack([cell % max(1, len(terms)), tf], 1).astype("<u4").tobytes())
                cuts = (8 * np.searchsorted(cell, np.arange(len(some) + 1) * max(1, len(terms)))).tolist()
                out = pa.record_batch([b.column(0).slice(lo, len(some)), pa.array(n),
                                       pa.array([bytes(packed[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "n", "terms"])
                yield out.filter(pc.greater(out.column(1), 0))

    return run


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, bounds of each document's)."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    pairs = np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], np.concatenate([[0], np.cumsum(sizes)])


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared.value.terms), np.int64)
        for b in batches:
            held += np.bincount(_unpack(b.column(0))[0], minlength=len(held))
        code = np.flatnonzero(held)
        yield pa.record_batch([pa.array(code), pa.array(held[code])], ["code", "df"])

    return run


class Heaps:
    """The ``top`` best (score, document) of each item."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.item, self.score, self.doc, self.null = (np.array([], np.int64) for _ in range(4))

    def offer(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores``: a row a document, a column an item."""
        d, i = np.nonzero(scores >= self.least)
        if not len(d):
            return
        item, score = np.concatenate([self.item, i]), np.concatenate([self.score, scores[d, i]])
        doc, null = np.concatenate([self.doc, doc[d]]), np.concatenate([self.null, null[d]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        order, last = order[keep], place == self.top - 1
        self.item, self.score, self.doc, self.null = item[keep], score[order], doc[order], null[order]
        full = item[last]
        self.least[full] = self.score[np.searchsorted(self.item, full) + self.top - 1]


def _scored(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, n_docs, n_terms = shared.value
        width = len(index.ids)
        heaps = Heaps(width, top)
        most = int(np.bincount(index.items, index.repeats, width).max()) if len(index.items) else 0
        exact = most * int(weight.max(initial=0)) * 10 ** 6 < 2 ** 53  # sums of doubles are whole
        for b in batches:
            code, tf, bounds = _unpack(b.column(2))
            m = norms(b.column(1).to_numpy(zero_copy_only=False), n_docs, n_terms)
            ids = b.column(0)
            doc, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            hits = np.concatenate([[0], np.cumsum(index.counts[code])])[bounds]
            lo = 0
            while lo < len(m):
                hi = max(lo + 1, min(int(np.searchsorted(hits, hits[lo] + HITS, "right")) - 1, lo + max(1, HITS // width)))
                x, y = bounds[lo], bounds[hi]
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
                c, t = code[x:y], tf[x:y]
                value = weight[c] * (10 ** 9 * t // (1000 * t + 12 * m[lo:hi][owner]))
                at = spread(index.starts[c], index.counts[c])
                each = np.repeat(np.arange(y - x), index.counts[c])
                cell = owner[each] * width + index.items[at]
                gain = value[each] * index.repeats[at]
                if exact:
                    scores = np.bincount(cell, gain, (hi - lo) * width).astype(np.int64)
                else:
                    scores = np.zeros((hi - lo) * width, np.int64)
                    np.add.at(scores, cell, gain)
                heaps.offer(scores.reshape(hi - lo, width), doc[lo:hi], null[lo:hi])
                lo = hi
        names = np.array([i is None for i in index.ids]), np.array([i or 0 for i in index.ids], np.int64)
        yield pa.record_batch([pa.array(heaps.item + index.first), pa.array(names[1][heaps.item], mask=names[0][heaps.item]),
                               pa.array(heaps.doc, mask=heaps.null > 0), pa.array(heaps.score)],
                              [x.split()[0] for x in _RESULT.split(", ")])

    return run


def _merged(rows: DataFrame, top: int) -> DataFrame:
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_row", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(*best))).filter(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    out = None
    for index in blocks(asked, block_chars):
        shared = spark.sparkContext.broadcast(index)
        rows = stored(src.mapInArrow(_counted(shared), "doc_id long, n long, terms binary"), "rank-counts")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        frequency = np.zeros(len(index.terms), np.int64)
        for r in rows.select("terms").mapInArrow(_frequencies(shared), "code long, df long").groupBy("code").agg(
                F.sum("df").alias("df")).collect():  # a row a term of the block
            frequency[r["code"]] = r["df"]
        scoring = spark.sparkContext.broadcast((index, weights(total["n"], frequency), total["n"], total["l"]))
        found = _merged(rows.mapInArrow(_scored(scoring, top), _RESULT), top)
        out = found if out is None else out.unionByName(stored(found, "rank-block"))
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
