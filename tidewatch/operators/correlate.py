"""Cross-stream correlation and burst alerts.

Batch semantics: a *batch* is a group of consecutive arrivals (the reference flushed every
10 records). Per (batch, entity) we count the events that mention the entity (once per
event) and collect the set of sources. A running count per entity, reset whenever an alert
fires, flags bursts; an entity seen from more than one source in a batch is a cross-stream
correlation. Alerts become ``meta_events`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..plans.scan import DEFAULT_FANOUT, Monoid, final_states, ordered_scan
from ..sources.feed import batch_of, with_entity_map


def event_entities(feed: DataFrame, ents_col: str = "ents") -> DataFrame:
    """(event_id, entity) with each entity once per event; labels flattened."""
    if ents_col not in feed.columns:
        feed = with_entity_map(feed, out=ents_col)
    vals = F.transform(F.map_values(F.col(ents_col)), lambda v: F.coalesce(v, F.array().cast("array<string>")))
    return (feed.select("event_id", F.explode_outer(F.array_distinct(F.flatten(vals))).alias("entity"))
            .where(F.col("entity").isNotNull()))


def entity_sources(feed: DataFrame, batch: Column | None = None) -> DataFrame:
    """Per (batch, entity): events mentioning it, sorted source set, source count.

    Missing source -> 'unknown'. ``groupBy(batch, entity)`` gets a map-side partial
    aggregate; a hot entity is spread over its many batches.
    """
    batch = batch if batch is not None else batch_of("event_id")
    f = with_entity_map(feed) if "ents" not in feed.columns else feed
    vals = F.transform(F.map_values(F.col("ents")), lambda v: F.coalesce(v, F.array().cast("array<string>")))
    rows = (f.select(batch.alias("batch"), "event_id", "event_time",
                     F.coalesce(F.col("source_type"), F.lit("unknown")).alias("source"),
                     F.explode_outer(F.array_distinct(F.flatten(vals))).alias("entity"))
            .where(F.col("entity").isNotNull()))
    return (rows.groupBy("batch", "entity")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.array_sort(F.collect_set("source")).alias("sources"),
                 F.max("event_time").alias("last_time"))
            .withColumn("n_sources", F.size("sources").cast("long")))


def cross_stream(agg: DataFrame) -> DataFrame:
    """(batch, entity) rows seen from more than one source."""
    return agg.where(F.col("n_sources") > 1)


def burst_monoid(threshold: int) -> Monoid:
    """Counter with reset as a finite state machine over states 0..threshold.

    Summary = transition table ``t`` (array of threshold+1 ints): state s -> t[s].
    One batch (count c, sources ns): fires iff ns > 1 or s + c > threshold; next state is
    0 if it fires, else s + c (which is then <= threshold).
    """
    T_ = int(threshold)
    ident = F.sequence(F.lit(0), F.lit(T_)).cast("array<int>")

    def nxt(s, it):
        return F.when((it["ns"] > 1) | (s + it["c"] > T_), F.lit(0)).otherwise(s + it["c"]).cast("int")

    return Monoid(
        identity=ident,
        leaf=lambda it: F.transform(ident, lambda s: nxt(s, it)),
        compose=lambda a, b: F.transform(a, lambda s: F.element_at(b, s + 1)).cast("array<int>"),
        apply=lambda t, s: F.element_at(t, s + 1),
        fold=lambda a, it: F.transform(a, lambda s: nxt(s, it)).cast("array<int>"),
        advance=lambda s, it: nxt(s, it),
    )


def _burst_items(agg: DataFrame) -> DataFrame:
    return agg.select("entity", "batch", F.col("n_events").cast("int").alias("c"),
                      F.col("n_sources").cast("int").alias("ns"), "sources", "last_time")


def burst_alerts(agg: DataFrame, threshold: int = dims.BURST_THRESHOLD, *, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """(entity, batch, score, n_sources, sources, is_cross, is_burst, last_time).

    score is the running count including this batch, before the reset.
    """
    items = _burst_items(agg)
    m = burst_monoid(threshold)

    def fires(it, st):
        return (it["ns"] > 1) | (st + it["c"] > threshold)

    def emit(it, st):
        score = (st + it["c"]).cast("long")
        return F.struct(it["o"].alias("batch"), score.alias("score"),
                        it["ns"].cast("long").alias("n_sources"), it["sources"].alias("sources"),
                        (it["ns"] > 1).alias("is_cross"), (score > threshold).alias("is_burst"),
                        it["last_time"].alias("last_time"))

    return ordered_scan(items, ["entity"], "batch", ["c", "ns", "sources", "last_time"], m,
                        F.lit(0), emit, fires, fanout=fanout)


def burst_counter_state(agg: DataFrame, threshold: int = dims.BURST_THRESHOLD, *, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Running count left per entity after all batches (entity, run)."""
    items = _burst_items(agg)
    return final_states(items, ["entity"], "batch", ["c", "ns"], burst_monoid(threshold), F.lit(0),
                        fanout=fanout).withColumnRenamed("state", "run")


def alert_rows(alerts: DataFrame) -> DataFrame:
    """E5 + C2 + D18: alert documents. Coordinates from the fixed gazetteer (literal map)."""
    # FIXED VALUES: title and description texts of an alert
    gaz = dims.gazetteer_map_col()
    srcs = F.array_join(F.col("sources"), ", ")
    return alerts.select(
        "batch", "entity", "score", "n_sources",
        F.format_string("META-EVENT DETECTED: '%s'", F.col("entity")).alias("title"),
        F.format_string("Entity '%s' exhibited anomalous behavior. Sources involved: %s. Burst score: %d",
                        F.col("entity"), srcs, F.col("score")).alias("description"),
        F.lit(dims.ALERT_SOURCE).alias("source_type"),
        F.when(F.array_contains("sources", "gdacs"), "NEGATIVE").otherwise("NEUTRAL").alias("sentiment"),
        F.lit(dims.ALERT_CLUSTER).alias("event_cluster"),
        F.col("last_time").alias("detected_at"),
        F.lit(True).alias("is_anomaly"),
        F.try_element_at(gaz, F.col("entity"))["lat"].alias("lat"),
        F.try_element_at(gaz, F.col("entity"))["lng"].alias("lng"))


def meta_events(feed: DataFrame, threshold: int = dims.BURST_THRESHOLD, batch: Column | None = None,
                *, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Feed -> alert rows (the flagship query)."""
    return alert_rows(burst_alerts(entity_sources(feed, batch), threshold, fanout=fanout))


def mark_events(feed: DataFrame, alerts: DataFrame, batch: Column | None = None) -> DataFrame:
    """(event_id, is_anomaly, is_burst) of the events that an alert is about: one of the event's entities raised an
    alert (a burst alert) in the event's batch. An equi-join on (batch, entity); alerts are unique in it."""
    batch = batch if batch is not None else batch_of("event_id")
    mentions = event_entities(feed).withColumn("batch", batch)
    hits = mentions.join(alerts.select("batch", "entity", "is_burst"), ["batch", "entity"])
    return hits.groupBy("event_id").agg(F.lit(True).alias("is_anomaly"), F.bool_or("is_burst").alias("is_burst"))
