"""Alignment of two tokenizers' tokens, and counts of the id pairs that end together.

Both tokenizers encode space + text: a byte-level BPE (A) and a piece BPE that adds the space itself
(B). A token is a byte range. Groups are the connected components of the overlap graph between A and
B tokens, labelled by pointer jumping: every token points to the overlapping token of the other side
that reaches farthest right (a B token that an A token ends with points to itself), and successors are
doubled until all pointers rest on their component's terminal token. This runs over all new distinct
units of a chunk at once (see ``wordcode``): both tokenizers break where units do, so units never share
a group. A link is an A and a B token whose ranges end together.

1. One pass aligns every text and stores a row a document: its counts, the digest of its groups and its
   links as packed id pairs.
2. Links are counted by id pair over the corpus, summed within a task before they are shuffled. Of two
   tokens that end together one's bytes end the other's, so there are at most as many pairs as both
   vocabularies have bytes (times the ids that share the same bytes): ``pair_bound``. The counts are
   broadcast only under that bound.
3. A second pass over the stored rows looks up each document's links.

Null and empty texts, and texts that A or B does not give back byte for byte, have no tokens: zero counts
and an empty ``groups``. Repeated rows and ids give a row each, null ids too. Links of equal count
are all best. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .wordcode import LONG_UNIT, UnitTable, byte_ranks, byte_unit_ids, chunks, per_text, split_units, spread

#: Distinct units kept by a worker; a row holds ids, groups and links.
KEPT_UNITS = 250_000
#: Text bytes aligned at a time, and stored rows counted or looked up at a time.
CHUNK_BYTES = 2_000_000
STEP_ROWS = 1_000
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary"
_NONE = np.array([], np.int64)


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    sp = _pieces(path)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(sp.get_piece_size())]


def byte_tokens(path: str) -> list[bytes]:
    ranks = byte_ranks(path)
    if ranks is None:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """The most id pairs that can end together."""
    same = max([*Counter(a).values(), *Counter(b).values()])
    return same * (sum(map(len, a)) + sum(map(len, b)))


def piece_unit_ids(path: str, step: int = 20_000):
    """Encoder of units by a piece BPE: (ids, ids of each unit). A unit that begins with a space takes the one that
    the model adds; the others lose it again. Units without inner spaces are encoded many in one call."""
    sp = _pieces(path)
    tokens = piece_bytes(path)
    if any(b" " in t.lstrip(b" ") or b"\n" in t[1:] for t in tokens):
        raise ValueError("a piece crosses a space or line end")
    begins = np.array([t.startswith(b" ") for t in tokens])
    lines = np.array([t == b"\n" for t in tokens])
    space = "[ ▁\n]"

    def encode(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        short = pc.less(pc.binary_length(units), LONG_UNIT)
        kinds = np.zeros(len(units), np.int8)
        for kind, lead in ((1, " "), (2, "\n")):
            simple = pc.and_(short, pc.match_substring_regex(units, f"^{lead}{space.replace('[', '[^')}+$"))
            kinds[simple.to_numpy(zero_copy_only=False)] = kind
        lengths, found = np.zeros(len(units), np.int64), []
        for kind, marks in ((1, begins), (2, lines)):
            where = np.flatnonzero(kinds == kind)
            for lo in range(0, len(where), step):
                at = where[lo:lo + step]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), units.take(pa.array(at))), "")[0].as_py()
                ids = np.array(sp.encode(joined[1:] if kind == 1 else joined), np.uint32)
                ids = ids if kind == 1 else ids[1:]
                cuts = np.flatnonzero(marks[ids])
                if len(cuts) != len(at):
                    raise ValueError("a unit holds a space or line end")
                sizes = np.diff(np.append(cuts, len(ids)))
                lengths[at] = sizes
                found.append((at, ids, sizes))
        for i in np.flatnonzero(kinds == 0).tolist():
            unit = units[i].as_py()
            ids = sp.encode(unit[1:]) if unit.startswith(" ") else sp.encode(unit)[1:]
            lengths[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.uint32), np.array([len(ids)])))
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        for at, ids, sizes in found:
            out[spread(starts[at], sizes)] = ids
        return out, lengths

    return encode


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal token (a B token's number) of each A and of each B token, by pointer jumping. Both sides'
    ranges lie side by side from 0 to the same last end."""
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a)  # the B token that holds an A token's last byte
    over_a = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    following = np.concatenate([n + over_b, np.where(ends_a[over_a] > ends_b, over_a, own) if n else own])
    while True:
        jumped = following[following]
        if np.array_equal(jumped, following):
            return following[:n] - n, following[n:] - n
        following = jumped


class Aligner:
    """Unit table with the number of A and B tokens and of groups, the groups as text and the links."""

    A, B, GROUPS, OK, TEXT, LINKS = range(6)

    def __init__(self, path_a: str, path_b: str, limit: int = KEPT_UNITS):
        self.encode_a, self.encode_b = byte_unit_ids(path_a, special=False), piece_unit_ids(path_b)
        self.sides = []
        for tokens in (byte_tokens(path_a), piece_bytes(path_b)):
            sizes = np.array([len(t) for t in tokens], np.int64)
            self.sides.append((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes,
                               pa.array([str(i) for i in range(len(tokens))])))
        self.table = UnitTable(self._learn, limit)

    def _same(self, side: int, ids: np.ndarray, counts: np.ndarray, units: pa.Array) -> np.ndarray:
        """Whether each unit's tokens join to its bytes."""
        data, starts, sizes, _ = self.sides[side]
        before = np.concatenate([[0], np.cumsum(sizes[ids])])
        last = np.cumsum(counts)
        got = before[last] - before[last - counts]
        want = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        ok = got == want
        joined = data[spread(starts[ids], sizes[ids])]
        raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), "")[0].as_py().encode(), np.uint8)
        if not ok.all():
            raw = raw[spread((np.cumsum(want) - want)[ok], want[ok])]
            joined = joined[spread(before[last - counts][ok], got[ok])]
        wrong = np.flatnonzero(raw != joined)
        if len(wrong):
            ok[np.flatnonzero(ok)[np.searchsorted(np.cumsum(want[ok]), wrong, "right")]] = False
        return ok

    def _learn(self, units: pa.Array) -> list:
        n = len(units)
        if not n:
            zero = pa.array([], pa.int64())
            return [zero, zero, zero, pa.array([], pa.bool_()), pa.array([], pa.string()), (np.array([], np.uint64), _NONE)]
        ids, counts = [None, None], [None, None]
        ok = np.ones(n, bool)
        for side, encode in enumerate((self.encode_a, self.encode_b)):
            ids[side], counts[side] = encode(units)
            ok &= self._same(side, ids[side], counts[side], units)
        if not ok.all():
            for side in (0, 1):
                ids[side] = ids[side][np.repeat(ok, counts[side])]
                counts[side] = np.where(ok, counts[side], 0)
        ends = [np.cumsum(self.sides[side][2][ids[side]]) for side in (0, 1)]
        to_a, to_b = terminals(*ends)
        last = np.flatnonzero(to_b == np.arange(len(to_b)))  # a group each
        # tokens of a group lie side by side
        strings = []
        for side, to in ((0, to_a), (1, to_b)):
            offsets = np.searchsorted(to, np.append(last, len(to_b))).astype(np.int32)
            strings.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.sides[side][3].take(pa.array(ids[side]))), ","))
        groups = pc.binary_join_element_wise(*strings, "|")
        ended = np.concatenate([[0], np.cumsum(counts[1])])
        group_bounds = np.searchsorted(last, ended)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(group_bounds.astype(np.int32)), groups), ";")
        at = np.searchsorted(ends[1], ends[0])
        linked = np.flatnonzero(ends[1][at] == ends[0]) if len(at) else _NONE
        keys = ids[0][linked].astype(np.uint64) << np.uint64(32) | ids[1][at[linked]].astype(np.uint64)
        link_counts = np.diff(np.searchsorted(linked, np.concatenate([[0], np.cumsum(counts[0])])))
        return [pa.array(counts[0]), pa.array(counts[1]), pa.array(np.diff(group_bounds).astype(np.int64)), pa.array(ok), text,
                (keys, link_counts)]

    def batch(self, docs: pa.Array, texts: pa.Array, groups: bool) -> Iterator[pa.RecordBatch]:
        for lo, some in chunks(texts, CHUNK_BYTES):
            units, bounds = split_units(some, lead=" ")
            rows = self.table.rows(units)
            column = [c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) and i != self.TEXT else c
                      for i, c in enumerate(self.table.columns)]
            bad = per_text((~column[self.OK][rows]).astype(np.int64), bounds) > 0
            if bad.any():
                keep = np.repeat(~bad, np.diff(bounds))
                rows = rows[keep]
                bounds = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(bounds)))])
            keys, link_counts = self.table.gather(self.LINKS, rows)
            n_links = per_text(link_counts, bounds)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), column[self.TEXT].take(pa.array(rows))), ";")
            cuts = (8 * np.concatenate([[0], np.cumsum(n_links)])).tolist()
            packed = memoryview(keys.astype("<u8").tobytes())
            told = joined.to_pylist()
            yield pa.record_batch([
                docs.slice(lo, len(some)), *[pa.array(per_text(column[i][rows], bounds)) for i in (self.A, self.B, self.GROUPS)],
                pa.array(n_links), pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]),
                joined if groups else pa.nulls(len(told), pa.string()),
                pa.array([bytes(packed[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())],
                [x.split()[0] for x in _ROWS.split(", ")])


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _align(path_a: str, path_b: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for b in batches:
            yield from aligner.batch(b.column(0), b.column(1), groups)

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), STEP_ROWS):
            yield b.slice(lo, STEP_ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links by id pair; the table is bounded as the pairs are."""
    keys, times = np.array([], np.uint64), _NONE
    for b in _steps(batches):
        raw = np.frombuffer(b"".join(x or b"" for x in b.column(0).to_pylist()), "<u8")
        new, n = np.unique(raw, return_counts=True)
        every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, n]), len(every)).astype(np.int64)
        keys = every
    yield pa.record_batch([pa.array((keys >> np.uint64(32)).astype(np.int64)),
                           pa.array((keys & np.uint64(0xffffffff)).astype(np.int64)), pa.array(times)], ["a", "b", "n"])


def _look_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for b in _steps(batches):
            packed = [x or b"" for x in b.column(7).to_pylist()]
            sizes = np.array([len(x) // 8 for x in packed], np.int64)
            at = np.searchsorted(keys, np.frombuffer(b"".join(packed), "<u8"))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.record_batch([*b.columns[:7], pa.array(per_text(best[at].astype(np.int64), bounds)),
                                   pa.array(per_text(counts[at], bounds))],
                                  ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs). Rows: one a document with doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (the text
    ``a1,a2|b1;a3|b2,b3`` if asked for, else null), n_best and count_sum. Pairs: a, b and n, its links in the corpus."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = stored(src.mapInArrow(_align(path_a, path_b, groups), _ROWS), "align-rows")
    pairs = stored(aligned.select("links").mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")),
                   "align-pairs")
    bound = pair_bound(byte_tokens(path_a), piece_bytes(path_b))
    if pairs.count() > bound:
        raise ValueError(f"more than {bound} id pairs")
    table = pairs.toArrow()
    a, b, n = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
    most = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(most, b, n)
    keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], n[order], (n == most[b])[order]))
    kind = _ROWS.replace("links binary", "n_best long, count_sum long")
    return aligned.mapInArrow(_look_up(shared), kind), pairs
