"""BPE encoding and decoding through a distinct-word table.

1. Each scan task splits its texts into blocks of whole documents and lists each block's distinct words.
2. The (block, at, word) rows are dealt and sorted by word, so that every distinct word of the corpus
   is encoded exactly once; the ids go back to their blocks.
3. A second pass over the same scan sends each block's positions (word numbers, packed) to meet them:
   each document's ids are read off by position. Decoding looks ids up in the vocabulary's id-to-piece
   table, whose size is fixed by the tokenizer file, and puts the pieces side by side.

Blocks are bounded by ``block_chars`` (a longer document is a block of its own), so no group grows with
the corpus; a frequent word has one row a block. The scan is read twice and nothing is stored between.

Splitting: special-token strings are cut out of the raw text first, as the library does; the rest
is normalised and cut at white space, which no token of this tokenizer crosses.
Null and empty texts give no ids and an empty decoded text. Repeated rows and repeated ids give
one result row each. Null ids pass through.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


BLOCK_CHARS = 32_000_000
#: Outside this range the library's own normaliser and splitter are called.
_PLAIN_LAST = "\u024f"
_NOT_PLAIN = re.compile(f"[^\\x00-{_PLAIN_LAST}]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=2)
def _specials(path: str) -> tuple[dict, re.Pattern | None]:
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    ids = {a["content"]: a["id"] for a in added}
    longest_first = sorted(ids, key=len, reverse=True)
    return ids, re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if ids else None


def normal_words(text: str, path: str) -> list[str]:
    """White-space words of the normalised text; special tokens stand as words of their own,
    marked by a leading NUL-free tag ``\\x00``."""
    _, cut = _specials(path)
    if cut is not None and "<|" in text and cut.search(text):
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += ["\x00" + part] if i % 2 else _split(part, path)
        return out
    return _split(text, path)


def _split(text: str, path: str) -> list[str]:
    if text.isascii():
        # str.split() also cuts at \x1c-\x1f, which are no white space for the tokenizer
        return text.lower().split() if not re.search("[\x00\x1c-\x1f]", text) else _cut(text.lower())
    if _NOT_PLAIN.search(text) or "İ" in text:
        text = _tokenizer(path).normalizer.normalize_str(text)
    else:
        text = unicodedata.normalize("NFC", text).lower()
    return _cut(text)


def _cut(text: str) -> list[str]:
    return ["\x00" + w if w[:1] == "\x00" else w for w in _SPACE.split(text) if w]


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, compressed."""
    v = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(v.T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    v = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(v.T).view("<u4").reshape(-1)


def _blocks(path: str, block_chars: int, want: str):
    """mapInArrow function over (doc_id, text). Blocks are the same in every run over the same scan.

    want="words": rows (block, at, word) of each block's distinct words, at = order of appearance;
    want="positions": a row (block, ids, lens, ranks, spots) a block: documents, their word counts, and
    their words as numbers that are small for frequent words; ``ranks`` gives the number of each ``at``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def flush():
            block = (part << 24) | made
            if want == "words":
                listed = list(seen)
                for lo in range(0, len(listed), 100_000):
                    ws = pa.array(listed[lo:lo + 100_000], pa.string())
                    yield pa.record_batch([pa.array(np.full(len(ws), block)), pa.array(np.arange(lo, lo + len(ws), dtype=np.int32)),
                                           ws], ["block", "at", "word"])
                return
            flat = np.concatenate(spots)
            rank = np.empty(len(seen), np.uint32)
            rank[np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")] = np.arange(len(seen), dtype=np.uint32)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                   *[pa.array([_pack(np.asarray(x, np.uint32))], pa.binary()) for x in (lens, rank, rank[flat])]],
                                  ["block", "ids", "lens", "ranks", "spots"])

        ids, lens, spots, seen, chars = [], [], [], {}, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = normal_words(text.as_py() or "", path)
                for w in words:
                    if w not in seen:
                        seen[w] = len(seen)
                if want == "positions":
                    spots.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                ids.append(doc)
                lens.append(len(words))
                chars += sum(map(len, words)) + len(words)
                if chars >= block_chars:
                    yield from flush()
                    ids, lens, spots, seen, chars, made = [], [], [], {}, 0, made + 1
        if ids:
            yield from flush()

    return run


_WORDS = "block long, at int, word string"
_POSITIONS = "block long, ids array<long>, lens binary, ranks binary, spots binary"


def _encode_words(path: str):
    """mapInArrow function over rows sorted by word: (block, at, word) -> (block, at, lens, codes), packed:
    the places, byte counts and ids of some words of a block. Each distinct word is encoded once; ids are
    little-endian numbers of ``_width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, (special, _), kind = _tokenizer(path), _specials(path), _width(path)
        last: tuple = (None, b"")
        for b in batches:
            words = b.column(2).to_pylist()
            known = dict([last])
            new = [w for w in dict.fromkeys(words) if w not in known]
            plain = [w for w in new if w[:1] != "\x00" or w[:2] == "\x00\x00"]
            for w, e in zip(plain, tok.encode_batch([w[1:] if w[:1] == "\x00" else w for w in plain], add_special_tokens=False)):
                known[w] = np.array(e.ids, kind).tobytes()
            for w in new:
                if w not in known:
                    known[w] = np.array([special[w[1:]]], kind).tobytes()
            if words:
                last = (words[-1], known[words[-1]])
            # the batch's rows of a block as one row
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = [known[w] for w in words]
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            rows = [(int(block[own[0]]), at[own].astype("<i4").tobytes(),
                     np.array([len(codes[i]) for i in own.tolist()], "<u4").tobytes(), b"".join([codes[i] for i in own.tolist()]))
                    for own in np.split(order, cuts[1:]) if len(own)]
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["block", "at", "lens", "codes"])

    return run


def _width(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """Id-to-piece table."""
    tok = _tokenizer(path)
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]


def _assemble(path: str, with_ids: bool):
    """Grouped function over a block: ids back by position, pieces by id, digests by document."""

    def run(key: tuple, mains: pa.Table, coded: pa.Table) -> pa.Table:
        piece, kind = _pieces(path), _width(path)
        doc_ids = mains["ids"][0].as_py()
        lens, rank, spots = (_unpack(mains[c][0].as_py()) for c in ("lens", "ranks", "spots"))
        n = len(rank)
        raw: list = [b""] * n
        for at, long, codes in zip(*(coded[c].to_pylist() for c in ("at", "lens", "codes"))):
            end = np.cumsum(np.frombuffer(long, "<u4").astype(np.int64)).tolist()
            last = 0
            for i, e in zip(rank[np.frombuffer(at, "<i4")].tolist(), end):
                raw[i] = codes[last:e]
                last = e
        size = np.dtype(kind).itemsize
        count = np.array([len(c) // size for c in raw], np.int64)
        text_ids, text_pieces = [""] * n, [""] * n
        numbers = [str(i) for i in range(len(piece))]
        for i, c in enumerate(raw):
            v = np.frombuffer(c, kind).tolist()
            text_ids[i] = " ".join([numbers[x] for x in v])
            text_pieces[i] = " ".join([piece[x] for x in v])
        out, done = {"n": [], "i": [], "h": [], "d": []}, 0
        some_empty = bool((count == 0).any())
        for k in lens.tolist():
            mine = spots[done:done + k]
            done += k
            if some_empty:
                mine = mine[count[mine] > 0]
            own = mine.tolist()
            out["n"].append(int(count[mine].sum()) if k else 0)
            out["h"].append(hashlib.sha256(" ".join([text_ids[j] for j in own]).encode()).hexdigest())
            out["d"].append(hashlib.sha256(" ".join([text_pieces[j] for j in own]).encode()).hexdigest())
            out["i"].append(np.frombuffer(b"".join([raw[j] for j in own]), kind).astype("<u4").tobytes() if with_ids else None)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(out["n"], pa.int64()),
                         "ids": pa.array(out["i"], pa.binary()), "ids_sha256": out["h"], "decoded_sha256": out["d"]})

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids (little-endian 32-bit, if ``with_ids``),
    ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded text)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = src.mapInArrow(_blocks(path, block_chars, "words"), _WORDS).repartition(n, "word").sortWithinPartitions("word")
    coded = table.mapInArrow(_encode_words(path), "block long, at binary, lens binary, codes binary")
    mains = src.mapInArrow(_blocks(path, block_chars, "positions"), _POSITIONS)
    return mains.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(path, with_ids), ENCODED)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists (array of int): doc_id, decoded. Each id is joined with the id-to-piece
    table (the vocabulary, bounded by the tokenizer file) and pieces are put in position order.
    Null and empty lists give an empty text; an id without a piece adds none."""
    spark = encoded.sparkSession
    vocab = _pieces(path)
    pieces = F.broadcast(spark.createDataFrame(list(enumerate(vocab)), "id int, piece string"))
    rows = encoded.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("doc_id"),
                          F.col(ids_col).alias("ids"))
    flat = rows.select("r", "doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(pieces, "id", "left")
    return (flat.groupBy("r", "doc_id")
            .agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("x"))
            .select("doc_id", F.array_join(F.col("x.piece"), " ").alias("decoded")))
