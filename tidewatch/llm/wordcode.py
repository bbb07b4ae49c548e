"""Tokenizers applied to a batch's distinct words.

A text is cut into *units*: before each space or line end that stands alone between two characters
that are no white space. The byte-level BPE begins a token at each such place, and no piece of the
piece BPE crosses it, so the ids of a text are its units' ids in order. Distinct units are found and
kept in Arrow tables; each is encoded once while it is kept. Whatever a unit holds, it goes whole to
the library where the short way is not proven: inner white space, very long runs, special tokens.

``UnitTable`` keeps one row a unit with any number of ragged or plain columns that ``learn`` returns.
It is emptied when it is over ``limit`` rows, which bounds a worker's memory whatever the corpus.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Units kept by a worker.
KEPT_UNITS = 600_000
#: Longer units go to the library: the rank table's merging is quadratic in a run's length.
LONG_UNIT = 1_000
_SPACES = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"^[{_SPACES}]|[{_SPACES}]$|[{_SPACES}][{_SPACES}]|[\x{{00}}\x{{1c}}-\x{{1f}}\x{{85}}]"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) with at most ``most`` bytes, or one text, each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def split_units(texts: pa.Array, lead: str = "", whole: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """Units of ``lead`` + text, in order, with the white space before them, and the bounds of each text's
    units. Null and empty texts have none. Texts that match ``whole`` are one unit."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, _ODD if whole is None else f"{_ODD}|{whole}")
    plain = pc.if_else(odd, pa.scalar("", pa.string()), texts)
    if lead:
        plain = pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(pa.scalar(lead), plain, pa.scalar("")))
    marked = pc.replace_substring(pc.replace_substring(plain, "\n", "\x00\n"), " ", "\x00 ")
    if lead == " ":
        marked = pc.utf8_slice_codeunits(marked, 1)  # no cut before the leading space
    lists = pc.split_pattern(marked, "\x00")
    counts = np.diff(lists.offsets.to_numpy())
    counts[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = 0
    values = lists.flatten()
    values = values.filter(pc.not_equal(values, ""))
    if pc.any(odd).as_py():
        said = re.compile(whole) if whole else None
        parts, at, done = [], 0, 0
        starts = np.concatenate([[0], np.cumsum(counts)])
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = lead + texts[i].as_py()
            units = [text] if said is not None and said.search(text) else _CUT.split(text)
            parts += [values.slice(done, int(starts[i]) - done), pa.array(units, pa.string())]
            done = int(starts[i])
            counts[i] = len(units)
        values = pa.concat_arrays([*parts, values.slice(done)])
    return values, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class UnitTable:
    """Rows of distinct units. ``learn(units)`` gives, for new units, a list of columns: (values, lengths)
    for a ragged one, or an Arrow array with an element a unit."""

    def __init__(self, learn: Callable[[pa.Array], list], limit: int = KEPT_UNITS):
        self.learn, self.limit = learn, limit
        self.units = pa.array([], pa.string())
        self.columns: list = []

    def rows(self, units: pa.Array) -> np.ndarray:
        """The row of each unit; rows hold until the next call."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary
        if len(self.units) + len(distinct) > self.limit:
            self.units, self.columns = pa.array([], pa.string()), []
        if len(self.units):
            row = pc.index_in(distinct, value_set=self.units)
            new = distinct.filter(pc.is_null(row))
            row = row.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            new, row = distinct, np.full(len(distinct), -1, np.int64)
        if len(new) or not self.columns:
            row[row < 0] = np.arange(len(self.units), len(self.units) + len(new))
            self._add(new)
        return row[coded.indices.to_numpy(zero_copy_only=False)]

    def _add(self, new: pa.Array) -> None:
        self.units = pa.concat_arrays([self.units, new])
        learned = self.learn(new)
        if not self.columns:
            self.columns = [c if isinstance(c, pa.Array) else (c[0], np.concatenate([[0], np.cumsum(c[1])]).astype(np.int64))
                            for c in learned]
            return
        for i, (old, c) in enumerate(zip(self.columns, learned, strict=True)):
            if isinstance(c, pa.Array):
                self.columns[i] = pa.concat_arrays([old, c])
            else:
                self.columns[i] = (np.concatenate([old[0], c[0]]),
                                   np.concatenate([old[1], old[1][-1] + np.cumsum(c[1])]))

    def gather(self, column: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A ragged column's values for these rows, one after the other, and each row's length."""
        values, offsets = self.columns[column]
        lengths = offsets[rows + 1] - offsets[rows]
        return values[spread(offsets[rows], lengths)], lengths


def per_text(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` (one a unit) for each text."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[bounds[1:]] - total[bounds[:-1]]


@functools.lru_cache(maxsize=4)
def _library(path: str, special: bool):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = not special
    return t


@functools.lru_cache(maxsize=2)
def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The byte-level BPE as bytes by rank; None if the file's ids are not in the order of its merges or its
    splitting differs from the byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if (spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex")
            or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or merged != sorted(merged)):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    import tiktoken

    ranks = byte_ranks(path)
    if ranks is None:
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


def byte_unit_ids(path: str, special: bool = True, step: int = 50_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encoder of units by a byte-level BPE file: (ids, ids of each unit). Units with one white space, before
    them, are encoded many in one call, parted by line ends, each of which is a token of its own."""
    def encode(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        library, fast = _library(path, special), _fast(path)
        n = len(units)
        lengths, found = np.zeros(n, np.int64), []
        kinds = np.zeros(n, np.int8)
        specials = [a.content for a in library.get_added_tokens_decoder().values()] if special else []
        if fast is not None and n:
            simple = pc.and_(pc.match_substring_regex(units, rf"^[ \n]?[^{_SPACES}]+$"), pc.less(pc.binary_length(units), LONG_UNIT))
            if specials:
                simple = pc.and_(simple, pc.invert(pc.match_substring_regex(units, "|".join(map(re.escape, specials)))))
            simple = simple.to_numpy(zero_copy_only=False)
            spaced = pc.starts_with(units, " ").to_numpy(zero_copy_only=False)
            lined = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
            kinds = np.where(simple, np.where(spaced, 1, np.where(lined, 2, 3)), 0)
        for kind in (1, 2, 3):
            where = np.flatnonzero(kinds == kind)
            for lo in range(0, len(where), step):
                at = where[lo:lo + step]
                words = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), units.take(pa.array(at)))
                joined = pc.binary_join(words, "" if kind == 2 else "\n")[0].as_py()
                if kind != 2:
                    joined = "\n" + joined
                ids = np.array(fast[0].encode_ordinary(joined), np.uint32)
                cuts = np.flatnonzero(ids == fast[1])
                if len(cuts) != len(at):
                    raise ValueError("a unit holds a line end")
                sizes = np.diff(np.append(cuts, len(ids)))
                if kind != 2:
                    ids, sizes = np.delete(ids, cuts), sizes - 1
                lengths[at] = sizes
                found.append((at, ids, sizes))
        other = np.flatnonzero(kinds == 0)
        for lo in range(0, len(other), 1000):
            at = other[lo:lo + 1000]
            got = [e.ids for e in library.encode_batch(units.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(g) for g in got], np.int64)
            lengths[at] = sizes
            found.append((at, np.array([i for g in got for i in g], np.uint32), sizes))
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        for at, ids, sizes in found:
            out[spread(starts[at], sizes)] = ids
        return out, lengths

    return encode


class ByteCoder:
    """Ids of whole texts by a byte-level BPE file, as the library gives them without template tokens."""

    def __init__(self, path: str, special: bool = True, limit: int = KEPT_UNITS):
        encode = byte_unit_ids(path, special)
        self.table = UnitTable(lambda units: [encode(units)], limit)
        names = [a.content for a in _library(path, special).get_added_tokens_decoder().values()] if special else []
        self.whole = "|".join(map(re.escape, names)) or None

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the chunk's texts, bounds of each text's ids)."""
        for lo, some in chunks(texts):
            units, bounds = split_units(some, whole=self.whole)
            ids, lengths = self.table.gather(0, self.table.rows(units))
            yield lo, ids, np.concatenate([[0], np.cumsum(per_text(lengths, bounds))])


@functools.lru_cache(maxsize=2)
def byte_coder(path: str, special: bool = True) -> ByteCoder:
    """The worker's coder of a file; its table serves all tasks that the worker runs."""
    return ByteCoder(path, special)
