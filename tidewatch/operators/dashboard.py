"""Dashboard aggregates (E6-E18) over the live feed.

All counts are single-pass aggregations (partial + final hash aggregate). Top-k reports sort
only the aggregated groups. Ties are broken by first arrival (``seq``), which the original
got from insertion order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..functions import text as X
from ..plans.store import written
from ..plans.scan import DEFAULT_FANOUT, Monoid, ordered_scan
from ..sources.feed import with_entity_map


_BEGIN = dt.datetime(1970, 1, 1)


def total_events(live: DataFrame) -> DataFrame:
    """E6."""
    return live.agg(F.count(F.lit(1)).alias("total_events"))


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(ts: Column) -> Column:
    """Epoch microseconds of a wall-clock (timestamp_ntz) value, read as UTC whatever the
    session time zone."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), ts.cast("timestamp_ntz"))


def events_per_min(live: DataFrame, time_col: str = "event_time") -> DataFrame:
    """round(n / max(minutes, 1)), minutes = event-time span (half rounds up)."""
    a = live.agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))
    minutes = (_micros(F.col("hi")) - _micros(F.col("lo"))) / F.lit(60_000_000.0)
    return a.select(F.col("n").alias("total_events"),
                    F.floor(F.col("n") / F.greatest(minutes, F.lit(1.0)) + F.lit(0.5)).cast("long").alias("events_per_min"))


def slot_of(ts: Column, slot_seconds: int) -> Column:
    """Slot number of a timestamp (epoch-aligned slots)."""
    return F.floor(_micros(ts) / F.lit(slot_seconds * 1_000_000)).cast("long")


def slot_start(slot: Column, slot_seconds: int) -> Column:
    """Start of a slot as a UTC wall-clock timestamp (timestamp_ntz)."""
    return F.timestamp_add("SECOND", slot * F.lit(slot_seconds), _epoch_ntz())


def newest_time(df: DataFrame, time_col: str = "event_time"):
    """The largest time, read first, so that filters by it reach the files as literals."""
    return df.agg(F.max(time_col)).first()[0]


def velocity(live: DataFrame, slot_seconds: int = 1, n_slots: int = 60, time_col: str = "event_time") -> DataFrame:
    """Events per slot for the last ``n_slots`` slots ending at the newest one,
    zero-filled. The newest time is read first; the counts are one aggregation over the
    rows in range (a literal bound on the time), joined to the ``n_slots``-row slot list."""
    spark = live.sparkSession
    hi = live.select(slot_of(F.lit(newest_time(live, time_col)).cast("timestamp_ntz"), slot_seconds).alias("s")).limit(1).first()
    if hi is None or hi["s"] is None:
        return spark.createDataFrame([], "slot_index long, slot_start timestamp_ntz, n long")
    first = int(hi["s"]) - (n_slots - 1)
    slots = spark.range(n_slots).select(F.col("id").alias("slot_index"), (F.col("id") + first).alias("slot"))
    begin = _BEGIN + dt.timedelta(seconds=first * slot_seconds)
    counts = (live.where(F.col(time_col) >= F.lit(begin).cast("timestamp_ntz"))
              .groupBy(slot_of(F.col(time_col), slot_seconds).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    return (slots.join(counts, "slot", "left")
            .select("slot_index", slot_start(F.col("slot"), slot_seconds).alias("slot_start"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def throughput_now(vel: DataFrame) -> DataFrame:
    """The previous full slot's count (0 after a gap), read at the newest slot."""
    w = Window.orderBy("slot_index")  # the 60-row slot list only
    last = vel.agg(F.max("slot_index").alias("mx"))
    return (vel.withColumn("prev", F.lag("n", 1, 0).over(w))
            .join(last, F.col("slot_index") == F.col("mx"))
            .select("slot_start", F.col("prev").cast("long").alias("throughput")))


def top_clusters(live: DataFrame, k: int = 5) -> DataFrame:
    """Top clusters by count (ties: first seen), label with first letter upper."""
    c = F.coalesce(F.nullif(F.col("event_cluster"), F.lit("")), F.lit(dims.DEFAULT_CLUSTER))
    g = live.groupBy(c.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return (g.orderBy(F.desc("n"), F.asc("first_seq")).limit(k)
            .select("cluster", X.capitalize_first(F.col("cluster")).alias("label"), "n"))


def _fixed_counts(spark_df: DataFrame, key: Column, labels: list[str], name: str) -> DataFrame:
    counts = spark_df.select(key.alias(name)).where(F.col(name).isin(*labels)).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"))
    lab = spark_df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{name} string, ord int")
    return (F.broadcast(lab).join(counts, name, "left")
            .select(name, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def sentiment_counts(live: DataFrame) -> DataFrame:
    """Lower-cased, default neutral, the three labels only (zeros kept)."""
    s = F.lower(F.coalesce(F.nullif(F.col("sentiment"), F.lit("")), F.lit("neutral")))
    return _fixed_counts(live, s, dims.SENTIMENT_LABELS, "sentiment")


def source_counts(live: DataFrame) -> DataFrame:
    """The four feed sources, missing source counted as wikipedia, others dropped."""
    s = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("wikipedia"))
    return _fixed_counts(live, s, dims.FEED_SOURCES, "source_type")


def _mentions(live: DataFrame, labels: list[str]) -> DataFrame:
    f = with_entity_map(live) if "ents" not in live.columns else live
    return (f.select("seq", "is_anomaly", F.posexplode_outer(X.entities_of(F.col("ents"), labels)).alias("pos", "entity"))
            .where(F.col("pos").isNotNull()))


def top_entities(live: DataFrame, k: int = 20) -> DataFrame:
    """Every mention in GPE, LOC, ORG, PERSON (EVENT left out, repeats counted)."""
    m = _mentions(live, ["GPE", "LOC", "ORG", "PERSON"])
    g = m.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    return g.orderBy(F.desc("n"), F.asc("first")).limit(k).select("entity", "n")


def threat_level(anomalies: Column) -> Column:
    return F.when(anomalies > 5, "EXTREME").when(anomalies > 1, "ELEVATED").otherwise("NORMAL")


def hotspots(live: DataFrame, k: int = 5) -> DataFrame:
    """Per GPE/LOC mention count and anomaly count, top k, threat level."""
    m = _mentions(live, ["GPE", "LOC"])
    g = m.groupBy("entity").agg(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("anomalies"),
                                F.min(F.struct("seq", "pos")).alias("first"))
    return (g.orderBy(F.desc("n"), F.asc("first")).limit(k)
            .select(F.col("entity").alias("place"), "n", F.col("anomalies").cast("long").alias("anomalies"),
                    threat_level(F.col("anomalies")).alias("threat")))


# ---- E15 mood line -------------------------------------------------------------------

BIG = 1 << 40


def clamp_monoid() -> Monoid:
    """x -> min(hi, max(lo, x + a)) as (a, lo, hi); composition stays in this form."""
    def cl(x, lo, hi):
        return F.least(hi, F.greatest(lo, x))

    def compose(f, g):
        return F.struct((f["a"] + g["a"]).alias("a"),
                        cl(f["lo"] + g["a"], g["lo"], g["hi"]).alias("lo"),
                        cl(f["hi"] + g["a"], g["lo"], g["hi"]).alias("hi"))

    ident = F.struct(F.lit(0).cast("long").alias("a"), F.lit(-BIG).cast("long").alias("lo"),
                     F.lit(BIG).cast("long").alias("hi"))
    return Monoid(identity=ident, leaf=lambda it: it["f"], compose=compose,
                  apply=lambda f, x: cl(x + f["a"], f["lo"], f["hi"]))


def _event_step(sent: Column) -> Column:
    """One event's effect: +1 positive, -1 negative, clamp for any of the three labels,
    identity for other labels."""
    lim = dims.MOOD_CLAMP
    s = F.lower(F.coalesce(F.nullif(sent, F.lit("")), F.lit("neutral")))
    a = F.when(s == "positive", 1).when(s == "negative", -1).otherwise(0).cast("long")
    known = s.isin(*dims.SENTIMENT_LABELS)
    return F.struct(F.when(known, a).otherwise(F.lit(0).cast("long")).alias("a"),
                    F.when(known, F.lit(-lim)).otherwise(F.lit(-BIG)).cast("long").alias("lo"),
                    F.when(known, F.lit(lim)).otherwise(F.lit(BIG)).cast("long").alias("hi"))


def mood_index(live: DataFrame, slot_seconds: int = 1, time_col: str = "event_time",
               fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Mood value at the end of every slot from the first to the last (empty slots
    carry the value). Per slot, events fold in arrival order into one clamp triple; the
    slots are then scanned in order with the parallel scan (no single-task sort)."""
    m = clamp_monoid()
    ev = live.select(slot_of(F.col(time_col), slot_seconds).alias("slot"), "seq",
                     _event_step(F.col("sentiment")).alias("f"))
    ev = written(ev, "mood-events")
    # one scalar job: slot range and the widest per-slot seq span (sets the reduce depth)
    bounds = (ev.groupBy("slot").agg((F.max("seq") - F.min("seq")).alias("w"))
              .agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.max("w").alias("span")).first())
    if bounds["lo"] is None:
        return live.sparkSession.createDataFrame([], "slot_start timestamp_ntz, mood long")
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    # per-slot summary: composed in seq order; a slot's events are reduced by the same
    # hierarchical ascent, so a hot slot is spread over many groups.
    per_slot = _reduce_in_order(ev, "slot", "seq", m, fanout, span=int(bounds["span"] or 0))
    spark: SparkSession = live.sparkSession
    slots = spark.range(lo, hi + 1).withColumnRenamed("id", "slot")
    items = (slots.join(per_slot, "slot", "left")
             .select(F.lit(0).alias("k"), (F.col("slot") - lo).alias("idx"), "slot",
                     F.coalesce(F.col("f"), m.identity).alias("f")))
    out = ordered_scan(items, ["k"], "idx", ["slot", "f"], m, F.lit(0).cast("long"),
                       emit=lambda it, st: F.struct(it["slot"].alias("slot"),
                                                    m.apply(it["f"], st).cast("long").alias("mood")),
                       fanout=fanout)
    return out.select(slot_start(F.col("slot"), slot_seconds).alias("slot_start"), "mood")


def _reduce_in_order(ev: DataFrame, key: str, order: str, m: Monoid, fanout: int,
                     span: int | None = None) -> DataFrame:
    """Compose per-row summaries ``f`` per key in ``order`` with bounded groups.

    The depth L comes from the widest ``order`` span of any key (one aggregate job): a key
    whose span is below C**L overlaps at most two level-L groups, so after the ascent a
    final per-key compose sees at most two items, however hot the key.
    """
    from ..plans.scan import ascend, levels_for
    if span is None:
        span = ev.groupBy(key).agg((F.max(order) - F.min(order)).alias("w")).agg(F.max("w")).first()[0] or 0
    levels = levels_for(int(span), fanout)
    top = ascend(ev.select(key, order, "f"), [key], order, ["f"], m, fanout, levels)[-1]
    g = f"g{levels}"
    stype = top.schema["s"].dataType
    return (top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(g).alias("o"), F.col("s")))).alias("parts"))
            .select(key, F.aggregate("parts", m.identity.cast(stype),
                                     lambda acc, it: m.compose(acc, it["s"]).cast(stype)).alias("f")))


def keyword_counts(kw_long: DataFrame, source_col: str = "source") -> DataFrame:
    """E16 (re-aimed): keyword x source counts with per-keyword and grand totals."""
    return (kw_long.rollup("keyword", source_col).agg(F.count(F.lit(1)).alias("n"))
            .select("keyword", F.col(source_col).alias("source"), "n"))


def batch_stats(feed: DataFrame, batch: Column, time_col: str = "event_time") -> DataFrame:
    """E17 (batch form): per batch size, event-time span and events per second."""
    g = feed.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"))
    span = (_micros(F.col("last_time")) - _micros(F.col("first_time"))) / F.lit(1e6)
    return g.select("batch", "n_events", "first_time", "last_time", span.alias("span_sec"),
                    F.when(span > 0, F.col("n_events") / span).alias("events_per_sec"))


def is_alert(df_cols=None) -> Column:
    """Anomaly or system alert."""
    return F.coalesce(F.col("is_anomaly"), F.lit(False)) | (F.coalesce(F.col("source_type"), F.lit("")) == dims.ALERT_SOURCE)


def unread_alerts(live: DataFrame, cleared_at: str, time_col: str = "event_time") -> DataFrame:
    """Alerts newer than the last clear."""
    return live.where(is_alert() & (F.col(time_col) > F.lit(cleared_at).cast("timestamp_ntz"))) \
               .agg(F.count(F.lit(1)).alias("unread"))
