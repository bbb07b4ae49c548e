"""Language proportions of a document by mixture inference over n-gram likelihoods.

Fit (:func:`fit_languages`): byte trigrams of lower-cased words, counted per language over a
bounded sample of labelled rows, smoothed with a Dirichlet prior.

Score (:func:`language_columns`): a word's likelihood under a language is the product of its
trigrams'. Expectation-maximisation over the words of the whole text estimates the proportions.
Starting from all languages, the one with the smallest proportion is taken out again and again; of
the nested sets, that with the best penalised likelihood (log-likelihood less ``penalty`` * size *
ln(words) / 2) is kept, and the prediction is the language with the largest proportion in it (ties:
first by name), its proportion the score.

Null texts and texts without a letter are ``und`` with score 0 and no proportions. A text with
letters always gets a learned language. With no labelled row, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V

#: Bounded training sample: at most about so many rows of each language.
SAMPLE_ROWS = 3_000
#: Hashed trigram slots (a fixed model size).
SLOTS = 1 << 16

MIXTURE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("languages", T.ArrayType(T.StringType())),
                        T.StructField("shares", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    logp: np.ndarray  # (SLOTS, languages)
    penalty: float = 2.0


def grams(data: np.ndarray, offs: np.ndarray):
    """Words (white space apart) and, per word, the slots of the trigrams over ``<word>``."""
    w = V.words(data, offs)
    n = w.end - w.start
    first = np.cumsum(n) - n
    pos = np.repeat(w.start - first, n) + np.arange(int(n.sum()))
    mid = data[pos].astype(np.uint32)
    prev, nxt = np.zeros_like(mid), np.zeros_like(mid)
    if len(mid):
        prev[1:], nxt[:-1] = mid[:-1], mid[1:]
        prev[first] = 1
        nxt[first + n - 1] = 1
    slot = (prev * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + nxt * np.uint32(0xC2B2AE3D))
    slot ^= slot >> np.uint32(15)
    return w, first, (slot * np.uint32(0x27D4EB2F) >> np.uint32(16)) & np.uint32(SLOTS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for row, data, offs in V.slices(b.column(0)):
            w, first, slot = grams(data, offs)
            owner = np.repeat(w.row, w.end - w.start)
            for name in sorted(set(langs[row:row + w.rows])):
                mine = np.flatnonzero(langs[row:row + w.rows] == name)
                count = np.bincount(slot[np.isin(owner, mine)], minlength=SLOTS)
                at = np.flatnonzero(count)
                if len(at):
                    yield pa.record_batch([pa.array([name] * len(at)), pa.array(at), pa.array(count[at])],
                                          ["lang", "slot", "n"])


def fit_languages(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows; null languages and texts are left out. The driver gets
    at most ``SLOTS`` counts a language."""
    rows = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col("lang") == name) & (share < int(1_000_000 * min(1.0, sample_rows / n))))
    got = (rows.filter(keep).select(F.lower("text").alias("text"), "lang")
           .mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    names = tuple(sorted(set(got["lang"].to_pylist())))
    count = np.zeros((SLOTS, len(names)))
    at = {x: i for i, x in enumerate(names)}
    count[np.array(got["slot"], np.int64), [at[x] for x in got["lang"].to_pylist()]] = np.array(got["n"], float)
    prior = count.sum(1, keepdims=True) / max(1.0, count.sum()) * 50 + 0.01
    return LanguageModel(names, np.log((count + prior) / (count + prior).sum(0)).astype(np.float32))


def _em(e: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int):
    """EM rounds for all texts at once: ``e`` is (languages, words), ``share`` (languages, texts); zero
    stays zero. Returns the shares and the log-likelihoods under them."""
    for _ in range(rounds):
        r = e * share[:, row]
        r /= r.sum(0)
        share = np.add.reduceat(r, first, axis=1) / n
    return share, np.add.reduceat(np.log((e * share[:, row]).sum(0)), first)


def mixtures(m: LanguageModel, texts: pa.Array) -> list[dict | None]:
    """Chosen languages and proportions for each text; None for one without words."""
    out: list = [None] * len(texts)
    if not m.names:
        return out
    tables = np.ascontiguousarray(m.logp.T)
    for row0, data, offs in V.slices(texts, 1 << 20):
        w, gfirst, slot = grams(data, offs)
        if not len(w.row):
            continue
        lw = np.stack([np.add.reduceat(t[slot], gfirst) for t in tables])
        lw -= lw.max(0)
        owners, first = np.unique(w.row, return_index=True)
        n = np.diff(np.append(first, len(w.row))).astype(float)
        row = np.repeat(np.arange(len(owners)), n.astype(int))
        # a floor keeps single odd words from ruling a language out
        e = np.exp(np.maximum(lw, np.float32(-20.0))) + np.float32(1e-9)
        share, like = _em(e, row, first, n, np.full((len(m.names), len(owners)), 1 / len(m.names), np.float32), 5)
        best_share = share
        best = like - m.penalty * (share > 0).sum(0) * np.log(n + 1) / 2
        for _ in range(len(m.names) - 1):
            low = np.where(share > 0, share, np.inf).argmin(0)
            drop = np.flatnonzero((share > 0).sum(0) > 1)
            share = share.copy()
            share[low[drop], drop] = 0
            share, like = _em(e, row, first, n, (share / share.sum(0)).astype(np.float32), 2)
            value = like - m.penalty * (share > 0).sum(0) * np.log(n + 1) / 2
            better = value >= best
            best = np.where(better, value, best)
            best_share = np.where(better, share, best_share)
        for k, r in enumerate(owners.tolist()):
            p = best_share[:, k]
            on = np.flatnonzero(p > 0)
            on = on[np.argsort(-p[on], kind="stable")]
            out[row0 + r] = {"lang_pred": m.names[on[0]], "score": float(min(1.0, p[on[0]])),
                             "languages": [m.names[i] for i in on], "shares": [float(x) for x in p[on]]}
    return out


def mixture_column(m: LanguageModel, text: Column) -> Column:
    """Struct (lang_pred, score, languages, shares) of a text column."""

    @F.arrow_udf(MIXTURE)
    def mixed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for texts in it:
            yield pa.array(mixtures(m, texts), to_arrow_type(MIXTURE))

    none = F.lit(None).cast(MIXTURE)
    found = mixed(F.when(text.rlike(r"\p{L}"), F.lower(text)))
    return F.coalesce(F.when(text.rlike(r"\p{L}"), found), none)


def languages_of(docs: DataFrame, m: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages, shares of every whole text."""
    t = F.col("text")
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", mixture_column(m, t).alias("m"))
    return got.select("doc_id", F.coalesce("m.lang_pred", F.lit("und")).alias("lang_pred"),
                      F.coalesce("m.score", F.lit(0.0)).alias("score"), "m.languages", "m.shares")
