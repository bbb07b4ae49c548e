"""Event feeds derived from the provided ``events`` table.

The provided tables hold no news / disaster / market / edit records, so the multi-source feed
the operators work on is derived from ``events`` by a fixed rule (FIXTURES.md §5): the
event type picks the source, ``props.k`` picks a place and a headline phrase, and the
entity JSON names the place (GPE) and an organisation (ORG). Everything is a projection plus
two lookups in fixed 24- and 10-row tables, so the derivation is a single narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from .tables import spread_by_id, table

# FIXED VALUES: headline phrases of the derived feed, indexed by k % 10.
FEED_PHRASES = ["Earthquake tremor", "Flood warning", "Wildfire blaze", "Election vote",
                "Military attack", "Vaccine outbreak", "Stocks market", "Machine learning",
                "Protest march", "Carbon climate"]

# FIXED VALUES: event_type -> source_type (signup has no source).
SOURCE_OF_TYPE = {"click": "news", "error": "gdacs", "purchase": "financial", "view": "wikipedia"}

ENTITY_MAP_TYPE = "map<string,array<string>>"


def _lookup(values: list, idx: Column) -> Column:
    """values[idx] for a literal list; NULL when idx is outside it."""
    return F.when(idx >= 0, F.try_element_at(F.array(*[F.lit(v) for v in values]), idx + F.lit(1)))


def event_source(event_type: Column) -> Column:
    c = F.lit(None).cast("string")
    expr = None
    for t, s in SOURCE_OF_TYPE.items():
        expr = (F.when(event_type == t, s) if expr is None else expr.when(event_type == t, s))
    return expr.otherwise(c)


def derived_feed(events: DataFrame) -> DataFrame:
    """events -> feed(event_id, event_time, source_type, value, place, title, description,
    lat, lng, sentiment, entities, user_id)."""
    k = F.col("k")
    e0 = events.select(
        "event_id", "ts", "user_id", "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        event_source(F.col("event_type")).alias("source_type"))
    places = [p for p, _, _ in dims.GAZETTEER]
    lats = [la for _, la, _ in dims.GAZETTEER]
    lngs = [lo for _, _, lo in dims.GAZETTEER]
    gi = k % 30
    known = _lookup(places, gi)
    place = F.coalesce(known, F.concat(F.lit("Zone"), k.cast("string")))
    phrase = _lookup(FEED_PHRASES, k % 10)
    with_coords = (k % 3 == 0)
    feed = (e0.withColumn("place", place).withColumn("phrase", phrase)
            .where(F.col("phrase").isNotNull())
            .select(
                "event_id",
                F.col("ts").alias("event_time"),
                "source_type",
                "value",
                "place",
                F.concat(F.col("phrase"), F.lit(" near "), F.col("place")).alias("title"),
                F.when(F.col("source_type") == "financial", F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("Report "), k.cast("string"), F.lit(" on "),
                                     F.lower(F.col("phrase")), F.lit(".")))
                 .alias("description"),
                F.when(with_coords, _lookup(lats, gi)).cast("double").alias("lat"),
                F.when(with_coords, _lookup(lngs, gi)).cast("double").alias("lng"),
                F.when(k % 5 == 0, "POSITIVE").when(k % 5 == 1, "NEGATIVE").otherwise("NEUTRAL")
                 .alias("sentiment"),
                F.concat(F.lit('{"GPE": ["'), F.col("place"), F.lit('"], "ORG": ["Org'),
                         (F.col("user_id") % 20).cast("string"), F.lit('"]}')).alias("entities"),
                "user_id"))
    return feed


_FEEDS: dict[tuple[str, str], DataFrame] = {}


#: Consecutive ids that stay together when the events are dealt over tasks: whole arrival batches.
RUN_IDS = 100


def load_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived feed over ``events`` (the plan is built once per session and folder). Runs of ids are dealt over
    tasks, rows without an id by their time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    df = _FEEDS.get(key)
    if df is None:
        df = derived_feed(spread_by_id(table(spark, sf_dir, "events"), "event_id", "ts", RUN_IDS))
        _FEEDS[key] = df
    return df


def dealt_feed(spark: SparkSession, sf_dir: str, by: Column, tasks: int) -> DataFrame:
    """The derived feed with the rows of equal ``by`` (of the ids) in one task. The events are dealt before the feed is derived,
    since its rows are several times larger."""
    return derived_feed(table(spark, sf_dir, "events").repartition(tasks, by))


def with_entity_map(feed: DataFrame, col: str = "entities", out: str = "ents") -> DataFrame:
    """Decode the entity JSON (label -> list); malformed JSON gives NULL."""
    return feed.withColumn(out, F.from_json(F.col(col), ENTITY_MAP_TYPE))


def batch_of(id_col: str = "event_id", batch_size: int = 10) -> Column:
    """Oracle batch number: ``event_id div batch_size`` (the reference flushed every 10)."""
    return F.expr(f"`{id_col}` div {int(batch_size)}")
