"""Unions (I1, I2) and the live feed the dashboard reads (I3, history then live, is the
streaming ``streaming.pipeline.backfill_live``).

``live_feed`` = processed events UNION alert rows, each with ``seq``: the arrival order.
Events arrive in ``event_id`` order; a batch's alerts arrive right after its last event
(seq = 2*event_id for events, 2*(last id of the batch)+1 for alerts), so "newest" and
"first seen" are well defined across both kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X

def _group(word: str, idx, n: int):
    """A category name derived from the user id."""
    return F.concat(F.lit(word), F.pmod(idx, F.lit(n)).cast("string"))


#: Columns of the union of the four feeds, in the order of their first occurrence.
UNION_TYPES = {"event_id": "long", "title": "string", "description": "string", "source_type": "string", "category": "string",
               "location": "string", "lat": "double", "lng": "double", "timestamp": "string", "_raw_text": "string",
               "disaster_type": "string", "severity": "string", "symbol": "string", "price_change": "double", "user": "string",
               "wiki": "string", "server_name": "string", "comment": "string", "length_old": "long", "length_new": "long",
               "type": "string", "namespace": "int"}


def shape_columns(source: str) -> dict:
    """The columns of one of the four differently shaped feeds, from the derived feed's."""
    uid, ts = F.col("user_id"), F.col("event_time")
    base = "yyyy-MM-dd'T'HH:mm:ss"
    edit = F.concat(F.lit("Edit "), F.col("event_id").cast("string"))
    common = {"event_id": F.col("event_id"), "title": F.col("title"), "source_type": F.lit(source)}
    placed = {"location": F.col("place"), "lat": F.col("lat"), "lng": F.col("lng")}
    if source == "news":
        return common | placed | {
            "description": F.col("description"), "category": _group("category ", uid, 5),
            "timestamp": F.date_format(ts, base + ".SSSSSS'+00:00'"), "_raw_text": X.raw_text(F.col("title"), F.col("description"))}
    if source == "gdacs":
        return common | placed | {
            "description": F.col("description"), "disaster_type": _group("type ", uid, 3), "severity": _group("level ", uid, 4),
            "timestamp": F.date_format(ts, base + ".SSSSSS"), "_raw_text": X.raw_text(F.col("title"), F.col("description"))}
    if source == "financial":
        return common | placed | {
            "symbol": _group("S", uid, 5), "price_change": F.col("value") - F.lit(50.0),
            "timestamp": F.date_format(ts, base + ".SSSSSS'Z'"), "_raw_text": X.raw_text(F.col("title"), F.lit(""))}
    return common | {
        "user": F.concat(F.lit("User"), uid.cast("string")), "wiki": F.lit("enwiki"), "server_name": F.lit("en.wikipedia.org"),
        "comment": edit, "timestamp": F.date_format(ts, base + "'Z'"), "length_old": F.floor("value").cast("long"),
        "length_new": (F.floor("value") + 10).cast("long"), "type": F.lit("edit"), "namespace": F.lit(0),
        "_raw_text": X.raw_text(F.col("title"), edit)}


def feed_shapes(feed: DataFrame) -> dict[str, DataFrame]:
    """The four differently shaped source feeds as frames of their own (as four topics would give them)."""
    return {s: feed.where(F.col("source_type") == s).select(*[c.alias(n) for n, c in shape_columns(s).items()])
            for s in dims.FEED_SOURCES}


def union_feeds(shapes: dict[str, DataFrame]) -> DataFrame:
    """One frame from differently shaped feeds (missing columns -> NULL)."""
    out = None
    for name in dims.FEED_SOURCES:
        df = shapes[name]
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*UNION_TYPES)


def union_shapes(feed: DataFrame) -> DataFrame:
    """I1 where the four shapes come from one table: the same rows as ``union_feeds(feed_shapes(feed))`` from one scan;
    each column is its source's expression."""
    columns = {s: shape_columns(s) for s in dims.FEED_SOURCES}
    out = []
    for name, kind in UNION_TYPES.items():
        value = None
        for source, shape in columns.items():
            if name in shape:
                here = F.col("source_type") == source
                value = F.when(here, shape[name]) if value is None else value.when(here, shape[name])
        out.append(value.cast(kind).alias(name))
    return feed.where(F.col("source_type").isin(*dims.FEED_SOURCES)).select(*out)


def ingested_at(ts: Column) -> Column:
    """When a stored event was ingested. Derived data has no wall clock: a batch is flushed at most ``FLUSH_SECONDS``
    after an event, and that is the time stored."""
    return ts + F.expr(f"INTERVAL {dims.FLUSH_SECONDS} SECONDS")


def processed_view(feed: DataFrame) -> DataFrame:
    """Feed rows as stored processed events (+ cluster, seq)."""
    out = X.with_cluster(feed, X.enrich_text(F.col("title"), F.col("description")))
    return out.select(
        (F.col("event_id") * 2).alias("seq"), "event_id", "event_time", "source_type", "title", "description",
        "sentiment", "event_cluster", "entities", "lat", "lng", F.lit(None).cast("boolean").alias("is_anomaly"),
        ingested_at(F.col("event_time")).alias("ingested_at"))


def alerts_view(alerts: DataFrame, batch_size: int = 10) -> DataFrame:
    """Alert rows in the live-feed shape."""
    return alerts.select(
        ((F.col("batch") * batch_size + (batch_size - 1)) * 2 + 1).alias("seq"),
        F.lit(None).cast("long").alias("event_id"), F.col("detected_at").alias("event_time"),
        "source_type", "title", "description", "sentiment", "event_cluster",
        F.lit(None).cast("string").alias("entities"), "lat", "lng", "is_anomaly",
        ingested_at(F.col("detected_at")).alias("ingested_at"))


def live_feed(feed: DataFrame, alerts: DataFrame) -> DataFrame:
    """Processed events and alerts in one frame (``unionByName``)."""
    return processed_view(feed).unionByName(alerts_view(alerts))
