"""Whole-record enrichment (D16 backend path, D17 consumer path).

Both are ``DataFrame -> DataFrame`` and used by the batch and the streaming jobs alike.
Costly intermediate columns (text, tokens, keyword hits) are materialised once in their own
projection and then referenced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import entities as N
from ..functions import models as M
from ..functions import sentiment as S
from ..functions import text as X
from .geo import geocode
from .setops import ingested_at


def enrich_event(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """clean_text, word_count, entities (struct), event_cluster, keywords (top 5),
    sentiment (lower case), confidence_score."""
    text = F.col(text_col) if text_col else X.enrich_text_of(df)
    out = (df.withColumn("__text", text).withColumn("clean_text", X.tokens("__text"))
           .withColumn("__found", N.entity_mentions(F.col("__text"))))
    out = X.with_cluster(out, F.col("__text"))
    ents = N.entities_map(F.col("__text"), F.col("__found"))
    return (out.withColumn("word_count", X.word_count("clean_text"))
            .withColumn("entities_struct", N.entities_struct(ents))
            .withColumn("keywords", X.keywords_inline("clean_text"))
            .withColumn("sentiment_lc", S.sentiment_label(F.col("__text")))
            .withColumn("confidence_score", F.lit(dims.CONFIDENCE_SCORE))
            .drop("__text", "__found"))


def enrich_batch(df: DataFrame, raw_col: str = "_raw_text", sentiment_factory=None,
                 embed_factory=None, ner_factory=None, ingest_time=None) -> DataFrame:
    """Model sentiment, embeddings, entities JSON, noun keywords, ingested_at,
    geocode fallback, raw text dropped (B5)."""
    raw = F.col(raw_col)
    out = (df.withColumn("sentiment", M.model_sentiment(raw, sentiment_factory))
           .withColumn("embeddings", M.embed(raw, factory=embed_factory))
           .withColumn("entities", M.model_entities_json(raw, ner_factory))
           .withColumn("keywords", F.to_json(N.keywords_distinct(raw)))
           .withColumn("ingested_at", ingest_time if ingest_time is not None else F.current_timestamp()))
    for c in ("lat", "lng"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumn("__ents", X.decode_entities("entities"))
    return geocode(out, "__ents").drop("__ents", raw_col)


def consume(df: DataFrame) -> DataFrame:
    """The consumer's chain on decoded messages: D17, and the event time from the message's text (three spellings; junk
    gives NULL). The ingestion time is the flush after the event."""
    timed = df.withColumn("event_time", F.col("timestamp").try_cast("timestamp").cast("timestamp_ntz"))
    return enrich_batch(timed, ingest_time=ingested_at(F.col("event_time")))
