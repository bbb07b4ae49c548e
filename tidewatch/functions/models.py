"""Model slots (U1-U3, D7, D8): Arrow-batched iterator Pandas UDFs.

A *factory* is a zero-argument callable returning a model; it is called once per Python
worker (cached in this module) before the batch loop, like the lazy singletons of the
original. Without a factory the built-in column expressions are used (U3 fallback):
the lexicon scorer for sentiment and hashed token features for embeddings.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .sentiment import model_sentiment_default
from .text import _c, is_blank, tokens, truncate

_CACHE: dict[str, object] = {}


def cached_model(name: str, factory: Callable[[], object]):
    """One model instance per worker process."""
    m = _CACHE.get(name)
    if m is None:
        m = factory()
        _CACHE[name] = m
    return m


def model_sentiment(text, factory: Callable[[], Callable[[list[str]], list[str]]] | None = None,
                    name: str = "sentiment", max_chars: int | None = None) -> Column:
    """Blank -> NEUTRAL, else the model label of the text, or of its first ``max_chars`` characters (the
    original gave its model 512, ``dims.MODEL_TEXT_CHARS``).

    ``factory()`` returns ``f(list[str]) -> list[str]`` of labels (e.g. POSITIVE/NEGATIVE).
    """
    if factory is None:
        return model_sentiment_default(text)

    @F.pandas_udf("string")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached_model(name, factory)
        for s in batches:
            blank = s.isna() | s.fillna("").str.strip().eq("")
            out = pd.Series(["NEUTRAL"] * len(s), index=s.index, dtype=object)
            todo = s[~blank]
            if len(todo):
                out[~blank] = list(model([t[:max_chars] for t in todo]))
            yield out

    return _score(_c(text))


def hashed_token_ids(text, dim: int) -> Column:
    """Feature index of each token: the first 16 bits of its MD5, modulo ``dim``, computed in the JVM."""
    return F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % F.lit(dim))


def hashed_vectors(ids: list, dim: int) -> np.ndarray:
    """L2-normalised feature counts of many rows at once."""
    sizes = np.array([0 if i is None else len(i) for i in ids], np.int64)
    flat = np.concatenate([np.asarray(i, np.int64) for i in ids if i is not None] or [np.zeros(0, np.int64)])
    cells = np.repeat(np.arange(len(ids)), sizes) * dim + flat
    v = np.bincount(cells, minlength=len(ids) * dim).reshape(len(ids), dim).astype(np.float64)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def embed(text, dim: int = 64, factory: Callable[[], Callable[[list[str]], list]] | None = None,
          name: str = "embedder") -> Column:
    """Blank -> [], else a dense float vector; a text without tokens has no vector either.

    Default model: L2-normalised counts of hashed token features (the hashing runs in the
    JVM, the counting in NumPy over a whole Arrow batch). With a factory, ``model(list[str])``
    returns one vector per text.
    """
    if factory is None:
        @F.pandas_udf("array<float>")
        def _hash_vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                got = hashed_vectors(s.tolist(), dim)
                yield pd.Series([v if v.any() else v[:0] for v in got], index=s.index)

        vec = _hash_vec(hashed_token_ids(text, dim))
        return F.when(is_blank(text), F.array().cast("array<float>")).otherwise(vec)

    @F.pandas_udf("array<float>")
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached_model(name, factory)
        for s in batches:
            blank = s.isna() | s.fillna("").str.strip().eq("")
            vals = [np.zeros(0, dtype=np.float32)] * len(s)
            idx = [i for i, b in enumerate(blank) if not b]
            if idx:
                enc = model([s.iloc[i] for i in idx])
                for i, v in zip(idx, enc):
                    vals[i] = np.asarray(v, dtype=np.float32)
            yield pd.Series(vals, index=s.index)

    return _encode(_c(text))


def model_entities_json(text, factory: Callable[[], Callable[[list[str]], list[dict]]] | None = None,
                        name: str = "ner", max_chars: int | None = None) -> Column:
    """D9 model slot: JSON of label -> mentions, from the whole text or its first ``max_chars`` characters (the
    original gave its tagger 1000, ``dims.NER_TEXT_CHARS``). The model gets all texts of an Arrow batch at
    once. Without a factory the dictionary matcher is used."""
    from .entities import entities_map
    if factory is None:
        return F.to_json(entities_map(text))
    import json

    @F.pandas_udf("string")
    def _ner(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached_model(name, factory)
        for s in batches:
            blank = (s.isna() | s.fillna("").str.strip().eq("")).to_numpy()
            found = iter(model(s[~blank].tolist()) if (~blank).any() else [])
            yield pd.Series(["{}" if b else json.dumps({k: v for k, v in next(found).items() if k in dims.ENTITY_LABELS},
                                                       ensure_ascii=False) for b in blank], index=s.index)

    return _ner(_c(text) if max_chars is None else truncate(_c(text), max_chars))
