"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Fit (:func:`fit_toxicity`). Document frequencies of tokens, and of token beginnings for rare
forms, are counted per class over labelled rows. A token's score is the log-odds between the
classes under a Dirichlet prior proportional to its overall frequency (Monroe et al. 2008), kept
where its z-value is significant; every other token scores ``-drift``, so that a clean text's
expected score is negative. The extreme-value parameters lambda and K (Karlin and Altschul 1990)
come from the clean rows: lambda solves E[exp(lambda * score)] = 1, K fits the median of their
maximum segment scores.

Score (:func:`toxicity_scores`). The Ruzzo-Tompa scan finds all maximal scoring segments of a
whole text in linear time. A segment of score S in a text of n tokens has the normalised score
lambda * S - ln(K * n), and E-value exp(-that). Segments with E <= ``significance`` are the
toxic passages; their normalised scores are summed and a two-parameter logistic curve, fitted on
the training rows, turns the sum into the score.

Null, empty and token-free texts have no segment: sum 0, the lowest score. Repeated rows get
equal scores. With no labelled row of either class, every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V

#: Bounded training sample: at most about so many labelled rows of each class.
SAMPLE_ROWS = 12_000
#: Scored tokens kept in the model (about 16 bytes each), by |z|.
MODEL_TOKENS = 40_000
#: Token beginnings (in bytes) that stand in for tokens that are not in the model.
PREFIXES = (5, 6, 7)
_TAG = (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A), np.uint64(0x3C3C3C3C3C3C3C3C))


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    log_k: float
    slope: float
    shift: float
    significance: float = 0.05


def token_features(data: np.ndarray, offs: np.ndarray) -> tuple[V.Words, list[np.ndarray]]:
    """Tokens of lower-cased texts and their feature hashes: the token, then its beginnings."""
    w = V.words(data, offs, V.NOT_TOKEN)
    return w, [w.hashes()] + [w.hashes(k) ^ tag for k, tag in zip(PREFIXES, _TAG[1:])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (feature, toxic, docs): documents that hold each feature, per batch."""
    for b in batches:
        label = np.array(b.column(1).to_pylist(), np.int64)
        for row, data, offs in V.slices(b.column(0)):
            w, feats = token_features(data, offs)
            for f in feats:
                order = np.lexsort((w.row, f))
                fs, rs = f[order], w.row[order]
                new = np.ones(len(fs), bool)
                new[1:] = (fs[1:] != fs[:-1]) | (rs[1:] != rs[:-1])
                fs, ls = fs[new], label[row:][rs[new]]
                for c in (0, 1):
                    u, n = np.unique(fs[ls == c], return_counts=True)
                    if len(u):
                        yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(np.full(len(u), c)), pa.array(n)],
                                              ["feature", "toxic", "docs"])


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float, prior: float = 20.0):
    """Log-odds with a Dirichlet prior, and z, of features held by ``pos`` and ``neg`` documents."""
    share = (pos + neg) / (n_pos + n_neg)
    a = prior * share + 0.05
    hit, miss = pos + a, neg + a * n_neg / n_pos
    odds = np.log(hit / (n_pos + prior)) - np.log(miss / (n_neg + prior * n_neg / n_pos))
    return odds, odds / np.sqrt(1 / hit + 1 / miss)


def _token_scores(keys: np.ndarray, scores: np.ndarray, drift: float, feats: list[np.ndarray]) -> np.ndarray:
    """Score of each token: that of the token itself if known, else of its longest known beginning."""
    out = np.full(len(feats[0]), -drift)
    if not len(keys):
        return out
    open_ = np.ones(len(out), bool)
    for f in (feats[0], *feats[:0:-1]):
        at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        hit = open_ & (keys[at] == f)
        out[hit] = scores[at[hit]]
        open_ &= ~hit
    return out


def maximal_segments(scores) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, start, end)`` in one linear scan (Ruzzo, Tompa 1999).

    Runs that cannot begin or extend a segment profitably are never revisited: each candidate
    keeps the running total before and after it, and a link to the nearest earlier candidate
    with a smaller total before it.
    """
    total, found = 0.0, []  # each: start, end, total before, total after, index of that candidate
    for i, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        start, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, end, before, total, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(x[3] - x[2], x[0], x[1]) for x in found]


def _row_segments(w: V.Words, s: np.ndarray, drift: float):
    """(row, n tokens, segments) of the rows that hold a token with a positive score. Stretches
    of equal negative scores enter the scan as one sum."""
    n = np.bincount(w.row, minlength=w.rows)
    first = np.cumsum(n) - n
    special = np.flatnonzero(s != -drift)
    rows = w.row[special]
    for r in np.unique(rows[s[special] > 0]):
        lo, hi = np.searchsorted(rows, r), np.searchsorted(rows, r, "right")
        items, last = [], 0
        for at in special[lo:hi].tolist():
            i = at - int(first[r])
            if i > last:
                items.append((last, -drift * (i - last)))
            items.append((i, float(s[at])))
            last = i + 1
        yield int(r), int(n[r]), maximal_segments(items)


def _sums(m: ToxicityModel, texts: pa.Array) -> np.ndarray:
    """Sum of the significant segments' normalised scores, for each text."""
    out = np.zeros(len(texts))
    for row, data, offs in V.slices(texts):
        w, feats = token_features(data, offs)
        for r, n, segs in _row_segments(w, _token_scores(m.keys, m.scores, m.drift, feats), m.drift):
            norm = [m.lam * x - m.log_k - math.log(n) for x, _, _ in segs]
            out[row + r] = sum(x + 1 for x in norm if math.exp(-min(x, 50)) <= m.significance)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int = 7) -> DataFrame:
    """(text, toxic) of about ``sample_rows`` rows of each class at most, chosen by id hash."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for c, n in sizes.items():
        keep = keep | ((F.col("toxic") == c) & (share < int(1_000_000 * min(1.0, sample_rows / n))))
    chosen = marked.filter(keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit_toxicity(sample: DataFrame, drift: float = 1.0, least_z: float = 2.5,
                 model_tokens: int = MODEL_TOKENS) -> ToxicityModel:
    """Fit on (text, toxic) rows. The counting runs in Spark; the driver gets the ``model_tokens``
    most significant features and one (tokens, best, toxic) row per sampled text."""
    from .common import stored

    rows = stored(sample.select(F.lower("text").alias("text"), "toxic"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 0.0, 0.0, -50.0)
    if not n_pos or not n_neg:
        return empty
    counts = (rows.mapInArrow(_count, "feature long, toxic long, docs long").groupBy("feature")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("pos"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("neg")))
    odds = _odds_column(n_pos, n_neg)
    top = (counts.filter("pos + neg >= 4").select("feature", odds["odds"].alias("odds"), odds["z"].alias("z"))
           .filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "feature").limit(model_tokens).toArrow())
    keys = np.array(top["feature"], np.int64).view(np.uint64)
    score = np.array(top["odds"], float) - drift
    order = np.argsort(keys)
    keys, score = keys[order], score[order]

    grid = np.linspace(0.2, 4.0, 77)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, top_, rise = np.zeros(len(b), np.int64), np.zeros(len(b)), np.zeros((len(b), len(grid)))
            for row, data, offs in V.slices(b.column(0)):
                w, feats = token_features(data, offs)
                s = _token_scores(keys, score, drift, feats)
                own = slice(row, row + w.rows)
                n[own] = np.bincount(w.row, minlength=w.rows)
                for k, lam in enumerate(grid):
                    rise[own, k] = np.bincount(w.row, np.exp(lam * s), minlength=w.rows)
                for r, _, segs in _row_segments(w, s, drift):
                    top_[row + r] = max((x for x, _, _ in segs), default=0.0)
            yield pa.record_batch([pa.array(n), pa.array(top_), pa.array(list(rise), pa.list_(pa.float64())), b.column(1)],
                                  ["n", "best", "rise", "toxic"])

    fitted = rows.mapInArrow(best, "n long, best double, rise array<double>, toxic int").toArrow()
    n, top_ = np.array(fitted["n"], float), np.array(fitted["best"], float)
    none = np.array(fitted["toxic"]) == 0
    # lambda: the positive root of E[exp(lambda * score)] = 1 over the clean rows' tokens
    mean = np.array([r for r, c in zip(fitted["rise"].to_pylist(), none) if c]).sum(0) / max(1.0, n[none].sum())
    lam = float(grid[np.flatnonzero(mean < 1)[-1]]) if (mean < 1).any() else float(grid[0])
    hit = none & (n > 0) & (top_ > 0)
    # K: the mean of the Gumbel law is (ln(K n) + 0.5772) / lambda. Labels are noisy: the median row
    # (Gumbel median: 0.3665 above the location) resists the few mislabelled ones
    log_k = float(np.clip(np.median(lam * top_[hit] - np.log(n[hit])) - 0.3665, -12.0, 0.0)) if hit.sum() >= 5 else -3.0
    m = ToxicityModel(keys, score, drift, lam, log_k, 1.0, 0.0)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([pa.array(_sums(m, b.column(0))), b.column(1)], ["x", "toxic"])

    xs = rows.mapInArrow(sums, "x double, toxic int").toArrow()
    slope, shift = logistic(np.array(xs["x"], float), np.array(xs["toxic"]) == 1)
    return ToxicityModel(keys, score, drift, lam, log_k, slope, shift)


def _odds_column(n_pos: int, n_neg: int, prior: float = 20.0) -> dict[str, Column]:
    share = (F.col("pos") + F.col("neg")) / F.lit(float(n_pos + n_neg))
    a = share * prior + 0.05
    hit, miss = F.col("pos") + a, F.col("neg") + a * (n_neg / n_pos)
    odds = F.log(hit / (n_pos + prior)) - F.log(miss / (n_neg + prior * n_neg / n_pos))
    return {"odds": odds, "z": odds / F.sqrt(1 / hit + 1 / miss)}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic curve by Newton steps with a weak ridge; classes weigh the same."""
    z = np.log1p(np.maximum(x, 0))
    wt = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    a = np.stack([z, np.ones_like(z)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        g = a.T @ (wt * (p - y)) + 0.5 * b
        h = (a * (wt * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score_column(m: ToxicityModel, text: Column) -> Column:
    """Toxicity score (0 to 1) of a text column."""

    @F.arrow_udf(T.DoubleType())
    def scored(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            z = m.slope * np.log1p(_sums(m, texts)) + m.shift
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scored(F.lower(text))


def passages_column(m: ToxicityModel, text: Column) -> Column:
    """Significant toxic passages of a text: array of (first token, end token, e_value)."""
    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("e_value", T.DoubleType())]))

    @F.arrow_udf(kind)
    def found(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for texts in it:
            out: list = [[] for _ in range(len(texts))]
            for row, data, offs in V.slices(texts):
                w, feats = token_features(data, offs)
                for r, n, segs in _row_segments(w, _token_scores(m.keys, m.scores, m.drift, feats), m.drift):
                    for x, a, b in segs:
                        e = math.exp(min(50.0, m.log_k + math.log(n) - m.lam * x))
                        if e <= m.significance:
                            out[row + r].append({"first": a, "end": b, "e_value": e})
            yield pa.array(out, to_arrow_type(kind))

    return found(F.lower(text))


def toxicity_scores(docs: DataFrame, m: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", score_column(m, F.col("text")).alias("score"))
