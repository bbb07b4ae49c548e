"""Feed views: display defaults, filters, search, access paths, recent pages.

Filters are plain predicates (pushed to the Parquet scan where they touch stored columns);
"newest n" pages are ``orderBy(...).limit(n)``, which Spark plans as a per-partition top-k
(``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from .dashboard import is_alert, newest_time


def newest_order():
    """Newest first: arrival order, then title (alerts of one batch share a seq)."""
    return [F.desc("seq"), F.desc("title")]


def event_defaults(live: DataFrame) -> DataFrame:
    """Display defaults (JS ``||`` also replaces '')."""
    def d(c, v):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    body = F.coalesce(*[F.nullif(X.opt_col(live, c), F.lit("")) for c in ("description", "comment", "content")],
                      F.lit(""))
    time = F.coalesce(X.opt_col(live, "ingested_at").cast("timestamp_ntz"), F.col("event_time"))
    return live.select(
        "seq", d("title", "Untitled Event").alias("title"), body.alias("body"),
        d("source_type", "wikipedia").alias("chart_source"), F.coalesce(F.col("source_type"), F.lit("unknown")).alias("corr_source"),
        d("event_cluster", dims.DEFAULT_CLUSTER).alias("cluster"),
        F.lower(d("sentiment", "neutral")).alias("sentiment"), time.alias("shown_time"))


def feed_filter(df: DataFrame, source: str = "all") -> DataFrame:
    """B8: 'all', or the source, and system alerts always pass."""
    if source == "all":
        return df
    return df.where((F.col("source_type") == source) | (F.col("source_type") == dims.ALERT_SOURCE))


def search_text(df: DataFrame) -> Column:
    return F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "),
                            F.coalesce(F.col("description"), F.lit("")), F.lit(" "),
                            F.coalesce(F.col("entities"), F.lit(""))))


def feed_search(df: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring search over title, description and entity text."""
    if not term:
        return df
    return df.where(F.instr(search_text(df), F.lower(F.lit(term))) > 0)


def alert_filter(df: DataFrame) -> DataFrame:
    """B10."""
    return df.where(is_alert())


def ticker_filter(df: DataFrame) -> DataFrame:
    """Anomaly or NEGATIVE (case-sensitive); level critical for anomalies."""
    an = F.coalesce(F.col("is_anomaly"), F.lit(False))
    return (df.where(an | (F.coalesce(F.col("sentiment"), F.lit("")) == "NEGATIVE"))
            .withColumn("level", F.when(an, "critical").otherwise("normal")))


def map_points(df: DataFrame) -> DataFrame:
    """Rows with both coordinates; colour and radius."""
    an = F.coalesce(F.col("is_anomaly"), F.lit(False))
    return (df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
            .select("seq", "lat", "lng", "title", "source_type",
                    F.when(an, "#ef4444").when(F.col("source_type") == "news", "#3b82f6").otherwise("#8b5cf6").alias("color"),
                    F.when(an, 8).otherwise(4).alias("radius")))


def by_source_recent(df: DataFrame, source: str) -> DataFrame:
    """B13 (source_type, timestamp desc). A table in folders by source is pruned to that folder."""
    if "source" in df.columns:
        df = df.where(F.col("source") == source)
    return df.where(F.col("source_type") == source).orderBy(F.desc("event_time"), F.desc("event_id"))


def by_cluster_confidence(df: DataFrame, cluster: str) -> DataFrame:
    """B13 (event_cluster, confidence_score desc)."""
    return df.where(F.col("event_cluster") == cluster).orderBy(F.desc("confidence_score"), F.desc("event_id"))


def by_sentiment_recent(df: DataFrame, sentiment: str) -> DataFrame:
    """B13 (sentiment, timestamp desc)."""
    return df.where(F.col("sentiment") == sentiment).orderBy(F.desc("event_time"), F.desc("event_id"))


def time_range(df: DataFrame, lo: str, hi: str, col: str = "event_time", date_col: str = "event_date") -> DataFrame:
    """B13 range on time: lo <= t < hi (literal bounds reach the Parquet scan). A table in folders by date is
    pruned to the dates between."""
    out = df.where((F.col(col) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(col) < F.lit(hi).cast("timestamp_ntz")))
    if date_col in df.columns:
        out = out.where((F.col(date_col) >= F.lit(lo).cast("timestamp_ntz").cast("date"))
                        & (F.col(date_col) <= F.lit(hi).cast("timestamp_ntz").cast("date")))
    return out


def by_ids(df: DataFrame, ids: list[int], id_col: str = "event_id") -> DataFrame:
    """B13 equality on the id."""
    return df.where(F.col(id_col).isin(*ids))


def token_search(df: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """B14 (re-aimed text index): rows having any of the terms among their tokens.
    ``arrays_overlap`` with a literal term list: per row, no explode, no join."""
    return df.where(F.arrays_overlap(X.tokens(F.col(text_col)), dims.lit_str_array(terms)))


def _newer_than(df: DataFrame, col: str, interval: str) -> Column:
    """Within ``interval`` of the newest row, which is read first: the bound reaches the files as a literal."""
    hi = newest_time(df, col)
    return F.lit(hi).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")


def retention(df: DataFrame, keep: str, col: str = "event_time", date_col: str = "event_date") -> DataFrame:
    """Keep rows newer than max(t) - interval. A table in folders by date is pruned to the dates kept."""
    bound = _newer_than(df, col, keep)
    out = df.where(F.col(col) >= bound)
    return out.where(F.col(date_col) >= bound.cast("date")) if date_col in df.columns else out


def newest(df: DataFrame, n: int, order=None) -> DataFrame:
    """Newest n rows, newest first."""
    return df.orderBy(*(order or newest_order())).limit(n)


def active_markers(df: DataFrame, seconds: int = 120, col: str = "event_time") -> DataFrame:
    """map points seen within ``seconds`` of the newest row."""
    return df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()
                    & (F.col(col) > _newer_than(df, col, f"{int(seconds)} SECONDS")))


def embedding_xy(emb: DataFrame, n: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """first two dimensions of the last n vectors (rows without a vector dropped)."""
    v = F.col(vec_col)
    return (emb.where(v.isNotNull() & (F.size(v) >= 2))
            .orderBy(F.desc(id_col)).limit(n)
            .select(id_col, v[0].cast("double").alias("x"), v[1].cast("double").alias("y")))
