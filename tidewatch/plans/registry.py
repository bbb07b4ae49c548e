"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Each query reads the provided tables (or the feed Spark derives from them) in full.
Parameters (search term, source filter, slot length, ...) are fixed here and mirrored in
the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import entities as N
from ..functions import models as M
from ..functions import sentiment as S
from ..functions import text as X
from ..operators import correlate as C
from ..operators import dashboard as D
from ..operators import enrich as EN
from ..operators import geo as G
from ..operators import graph as GR
from ..operators import setops as U
from ..operators import views as V
from ..sources import edits as ED
from ..sources import sinks as SK
from ..sources.feed import batch_of, dealt_feed, load_feed, with_entity_map
from ..sources.tables import spread_by_id, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

from .params import PARAMS
from . import textindex as TI
from .store import stored, stored_path, write_by_date


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def _max_batch(spark, sf_dir, batch_size=10):
    """Largest batch number, read from the event ids (sets the files per trigger of the streams)."""
    return int(table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // batch_size


def _alerts(spark, sf_dir):
    return C.meta_events(load_feed(spark, sf_dir))


def _stored_processed(spark, sf_dir):
    """processed_events as stored (feed + cluster), written once per session."""
    return stored(spark, sf_dir, "processed_events", lambda: U.processed_view(load_feed(spark, sf_dir)))


def _stored_alerts(spark, sf_dir):
    """meta_events as stored, written once per session."""
    return stored(spark, sf_dir, "meta_events", lambda: _alerts(spark, sf_dir))


def _live(spark, sf_dir):
    """I2 over the stored collections."""
    return _stored_processed(spark, sf_dir).unionByName(U.alerts_view(_stored_alerts(spark, sf_dir)))


#: Rows of ``documents`` that a task gets: whole texts, so fewer than of events.
DOC_ROWS = 5_000


def _docs(spark, sf_dir):
    return spread_by_id(table(spark, sf_dir, "documents"), "doc_id", "text", 1_000, DOC_ROWS)


# ---- sources / sinks ---------------------------------------------------------------------

@register("src_json_events")
def q_src_json_events(spark, sf_dir):
    """A1: the feed as JSON files, read through the JSON source."""
    feed = load_feed(spark, sf_dir)
    return _through_files(spark, feed, "src-json")


@register("sink_json_roundtrip")
def q_sink_json_roundtrip(spark, sf_dir):
    """A2: the union of the feeds into the JSON sink's files, and back."""
    return _through_files(spark, U.union_shapes(load_feed(spark, sf_dir)), "sink-json")


def _through_files(spark, df, name):
    path = _stream_dir(spark, name)
    SK.write_json_topic(df, path)
    return spark.read.schema(df.schema).options(**SK.JSON_OPTIONS).json(path)


@register("sse_decode")
def q_sse_decode(spark, sf_dir):
    return ED.decode_sse(ED.sse_lines(table(spark, sf_dir, "events"))).select(
        "line_no", "title", "wiki", "bot", "user", "comment", "namespace",
        F.col("meta.dt").alias("dt"), F.col("length.old").alias("length_old"), F.col("length.new").alias("length_new"))


@register("edit_filter")
def q_edit_filter(spark, sf_dir):
    e = ED.decode_sse(ED.sse_lines(table(spark, sf_dir, "events")))
    return ED.edit_filter(e).select("line_no", "title", "wiki", "bot")


@register("edit_projection")
def q_edit_projection(spark, sf_dir):
    e = ED.decode_sse(ED.sse_lines(table(spark, sf_dir, "events")))
    return ED.edit_projection(ED.edit_filter(e))


@register("poll_since")
def q_poll_since(spark, sf_dir):
    feed = load_feed(spark, sf_dir)
    last = SK.newest_id(feed) - PARAMS["poll_back"]
    return SK.poll_since(feed, last).select("event_id", "event_time", "title")


@register("table_counts")
def q_table_counts(spark, sf_dir):
    return SK.table_counts(spark, {
        "processed_events": _stored_processed(spark, sf_dir),
        "events": table(spark, sf_dir, "events"),
        "documents": table(spark, sf_dir, "documents"),
        "meta_events": _stored_alerts(spark, sf_dir),
    })


# ---- feed shaping, filters, predicates -------------------------------------------------------

@register("union_feeds")
def q_union_feeds(spark, sf_dir):
    u = U.union_shapes(load_feed(spark, sf_dir))
    return u.withColumn("event_time", F.col("timestamp").try_cast("timestamp"))


@register("raw_text")
def q_raw_text(spark, sf_dir):
    return U.union_shapes(load_feed(spark, sf_dir)).select("event_id", "_raw_text")


@register("enrich_text")
def q_enrich_text(spark, sf_dir):
    u = U.union_shapes(load_feed(spark, sf_dir))
    return u.select("event_id", X.enrich_text_of(u).alias("text"))


@register("confidence_const")
def q_confidence_const(spark, sf_dir):
    return _by_date(spark, sf_dir).select("event_id", "ingested_at", "confidence_score")


@register("event_defaults")
def q_event_defaults(spark, sf_dir):
    """B7 over the live feed with fields left out or empty by rule, so that every default is reached."""
    seq = F.col("seq")

    def gap(name, n):
        return F.when(seq % n == 0, F.lit("")).when(seq % n == 2, F.lit(None).cast("string")).otherwise(F.col(name)).alias(name)
    return V.event_defaults(_live(spark, sf_dir).select(
        "seq", gap("title", 22), gap("description", 26), gap("source_type", 14), gap("event_cluster", 10), gap("sentiment", 34),
        "event_time", F.when(seq % 6 != 0, F.col("ingested_at")).alias("ingested_at")))


@register("feed_filter")
def q_feed_filter(spark, sf_dir):
    return V.feed_filter(_live(spark, sf_dir), PARAMS["feed_source"]).select("seq", "source_type", "title")


@register("feed_search")
def q_feed_search(spark, sf_dir):
    return V.feed_search(_live(spark, sf_dir), PARAMS["search_term"]).select("seq", "title")


@register("alert_filter")
def q_alert_filter(spark, sf_dir):
    return V.alert_filter(_live(spark, sf_dir)).select("seq", "title", "sentiment")


@register("ticker_filter")
def q_ticker_filter(spark, sf_dir):
    return V.ticker_filter(_live(spark, sf_dir)).select("seq", "title", "level")


@register("map_points")
def q_map_points(spark, sf_dir):
    return V.map_points(_live(spark, sf_dir))


def _by_date(spark, sf_dir):
    """processed_events in folders by date and source."""
    path = stored_path(spark, sf_dir, "processed_by_date", "events", lambda at: write_by_date(
        _stored_processed(spark, sf_dir).withColumn("confidence_score", F.lit(dims.CONFIDENCE_SCORE)), at, ("event_id", "title")))
    return spark.read.parquet(path)


@register("by_source_recent")
def q_by_source_recent(spark, sf_dir):
    return V.by_source_recent(_by_date(spark, sf_dir), PARAMS["source"]).select("event_id", "event_time", "title")


@register("by_cluster_confidence")
def q_by_cluster_confidence(spark, sf_dir):
    return V.by_cluster_confidence(_by_date(spark, sf_dir), PARAMS["cluster"]).select(
        "event_id", "event_cluster", "confidence_score")


@register("by_sentiment_recent")
def q_by_sentiment_recent(spark, sf_dir):
    return V.by_sentiment_recent(_by_date(spark, sf_dir), PARAMS["sentiment"]).select("event_id", "event_time")


@register("time_range")
def q_time_range(spark, sf_dir):
    return V.time_range(_by_date(spark, sf_dir), PARAMS["range_lo"], PARAMS["range_hi"]).select(
        "event_id", "event_time", "source_type")


@register("event_lookup")
def q_event_lookup(spark, sf_dir):
    """B13, equality on the id: the Bloom filters skip the files that don't hold it."""
    return V.by_ids(_by_date(spark, sf_dir), PARAMS["lookup_ids"]).select("event_id", "event_time", "title", "event_cluster")


@register("token_search")
def q_token_search(spark, sf_dir):
    return V.token_search(_docs(spark, sf_dir), "text", PARAMS["token_terms"]).select("doc_id")


@register("retention")
def q_retention(spark, sf_dir):
    return V.retention(_by_date(spark, sf_dir), PARAMS["retention"]).select("event_id", "event_time")


def _text_index(spark, sf_dir):
    path = stored_path(spark, sf_dir, "text_index", "documents", lambda at: TI.write_index(_docs(spark, sf_dir), at, "doc_id", "text"))
    return TI.read_index(spark, path)


@register("index_search_any")
def q_index_search_any(spark, sf_dir):
    """Any of the terms, through the text index."""
    return TI.search_any(_text_index(spark, sf_dir), PARAMS["token_terms"]).select(F.col("id").alias("doc_id"))


@register("index_search_all")
def q_index_search_all(spark, sf_dir):
    """All of the terms."""
    return TI.search_all(_text_index(spark, sf_dir), PARAMS["common_terms"]).select(F.col("id").alias("doc_id"))


# ---- joins / geocoding ----------------------------------------------------------------------

@register("geocode")
def q_geocode(spark, sf_dir):
    f = with_entity_map(load_feed(spark, sf_dir))
    return G.geocode(f).select("event_id", "lat", "lng")


# ---- text functions ------------------------------------------------------------------------

@register("tokens")
def q_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.tokens("text").alias("tokens"))


@register("word_count")
def q_word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.word_count(X.tokens("text")).alias("word_count"))


@register("keywords_topn")
def q_keywords_topn(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.tokens("text").alias("toks"))
    return X.keywords_long(d, "doc_id", "toks")


@register("keywords_conversations")
def q_keywords_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.tokens("text").alias("toks"))
    return X.keywords_long(c, ["conv_id", "turn"], "toks")


@register("classify")
def q_classify(spark, sf_dir):
    f = load_feed(spark, sf_dir)
    return X.with_cluster(f, X.enrich_text(F.col("title"), F.col("description"))).select("event_id", "event_cluster")


@register("classify_docs")
def q_classify_docs(spark, sf_dir):
    return X.with_cluster(_docs(spark, sf_dir), F.col("text")).select("doc_id", "event_cluster")


@register("sentiment_lexicon")
def q_sentiment_lexicon(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", S.lexicon_sum(F.col("text")).alias("s"))
    return d.select("doc_id", F.round(S.normalised(F.col("s")), 6).alias("compound"),
                    S.label_of_sum(F.col("text"), F.col("s")).alias("sentiment"))


@register("sentiment_bucket_old")
def q_sentiment_bucket_old(spark, sf_dir):
    """An event whose entity burst in its batch is a burst, before any score. The text is the title and description with
    a word of the lexicon, picked by the id, so that every bucket occurs."""
    f = load_feed(spark, sf_dir)
    words = dims.lit_str_array([w for w, _ in dims.SENTIMENT_LEXICON])
    word = F.element_at(words, (F.col("event_id") % len(dims.SENTIMENT_LEXICON) + 1).cast("int"))
    marks = C.mark_events(f, C.burst_alerts(C.entity_sources(f))).select("event_id", "is_burst")
    scored = f.select("event_id", S.compound(X.enrich_text(F.col("title"), F.col("description"), word)).alias("score"))
    return scored.join(marks, "event_id", "left").select("event_id", S.old_bucket(F.col("score"), F.col("is_burst")).alias("bucket"))


@register("sentiment_model")
def q_sentiment_model(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", M.model_sentiment(F.col("text")).alias("sentiment"))


@register("embed_hash")
def q_embed_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", M.embed(F.col("text")).alias("embedding"))


@register("entities_dict")
def q_entities_dict(spark, sf_dir):
    """D9 over titles followed by two names of the dictionary, picked by the id, so that every label occurs."""
    f = load_feed(spark, sf_dir)
    names = dims.lit_str_array([s for s, _ in dims.ENTITY_DICTIONARY])
    n = len(dims.ENTITY_DICTIONARY)
    m = N.entities_map(X.enrich_text(F.col("title"), F.col("description"), F.element_at(names, (F.col("event_id") % n + 1).cast("int")),
                                     F.element_at(names, (F.col("event_id") * 7 % n + 1).cast("int"))))
    return (f.select("event_id", F.posexplode_outer(m).alias("label_order", "label", "mentions"))
            .where(F.col("label_order").isNotNull())
            .select("event_id", "label", F.col("label_order").cast("long").alias("label_order"), "mentions"))


@register("entities_struct")
def q_entities_struct(spark, sf_dir):
    f = with_entity_map(load_feed(spark, sf_dir))
    return f.select("event_id", N.entities_struct(F.col("ents")).alias("s")).select("event_id", "s.*")


@register("keywords_distinct")
def q_keywords_distinct(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", N.keywords_distinct(F.col("text")).alias("keywords"))


@register("blank_guard")
def q_blank_guard(spark, sf_dir):
    """D12 over the documents and the titles of the edit stream, some of which are blank."""
    d = _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    e = ED.decode_sse(ED.sse_lines(table(spark, sf_dir, "events"))).select(
        F.lit("edit").alias("kind"), F.col("line_no").alias("id"), F.col("title").alias("text"))
    return d.unionByName(e).select(
        "kind", "id", X.is_blank(F.col("text")).alias("is_blank"),
        F.length(X.truncate(F.col("text"), dims.MODEL_TEXT_CHARS)).cast("long").alias("n512"),
        F.length(X.truncate(F.col("text"), dims.NER_TEXT_CHARS)).cast("long").alias("n1000"))


def _feed_bad_json(spark, sf_dir):
    f = load_feed(spark, sf_dir)
    bad = F.col("event_id") % 17 == 0
    return f.withColumn("entities", F.when(bad, F.substring("entities", 1, 12)).otherwise(F.col("entities")))


@register("entities_decode")
def q_entities_decode(spark, sf_dir):
    m = X.decode_entities("entities")
    return _feed_bad_json(spark, sf_dir).select(
        "event_id", m.isNotNull().alias("valid"),
        F.try_element_at(m, F.lit("GPE")).alias("gpe"), F.try_element_at(m, F.lit("ORG")).alias("org"))


@register("event_entities")
def q_event_entities(spark, sf_dir):
    return C.event_entities(load_feed(spark, sf_dir))


@register("entities_encode")
def q_entities_encode(spark, sf_dir):
    f = with_entity_map(load_feed(spark, sf_dir))
    return f.select("event_id", X.encode_json(F.col("ents")).alias("entities_json"))


@register("enrich_event")
def q_enrich_event(spark, sf_dir):
    e = EN.enrich_event(load_feed(spark, sf_dir))
    return e.select("event_id", "clean_text", "word_count", "event_cluster", "keywords",
                    F.col("sentiment_lc").alias("nlp_sentiment"), "confidence_score",
                    F.col("entities_struct.locations").alias("locations"))


@register("enrich_batch")
def q_enrich_batch(spark, sf_dir):
    """The whole consumer enrichment; the ingestion time is derived from the event's, not the wall clock."""
    u = U.union_shapes(load_feed(spark, sf_dir)).withColumn("event_time", F.col("timestamp").try_cast("timestamp"))
    done = EN.enrich_batch(u, ingest_time=U.ingested_at(F.col("event_time").cast("timestamp_ntz")))
    return done.select("event_id", "source_type", "sentiment", "embeddings", "keywords", "lat", "lng", "ingested_at",
                       F.lit("_raw_text" in done.columns).alias("has_raw_text"))


# ---- correlation and aggregates -----------------------------------------------------------

@register("entity_sources")
def q_entity_sources(spark, sf_dir):
    return C.entity_sources(load_feed(spark, sf_dir)).drop("last_time")


@register("cross_stream")
def q_cross_stream(spark, sf_dir):
    return C.cross_stream(C.entity_sources(load_feed(spark, sf_dir))).drop("last_time")


@register("burst_counter")
def q_burst_counter(spark, sf_dir):
    a = C.burst_alerts(C.entity_sources(load_feed(spark, sf_dir)))
    return a.select("entity", "batch", "score", "is_cross", "is_burst")


@register("burst_state")
def q_burst_state(spark, sf_dir):
    return C.burst_counter_state(C.entity_sources(load_feed(spark, sf_dir)))


@register("meta_events")
def q_meta_events(spark, sf_dir):
    return _alerts(spark, sf_dir)


@register("cross_stream_window")
def q_cross_stream_window(spark, sf_dir):
    """H4 batch form: correlation per 10-minute event-time window instead of per batch."""
    f = load_feed(spark, sf_dir)
    a = C.entity_sources(f, batch=D.slot_of(F.col("event_time"), 600))
    return C.cross_stream(a).select(D.slot_start(F.col("batch"), 600).alias("window_start"),
                                    "entity", "n_events", "sources", "n_sources")


@register("total_events")
def q_total_events(spark, sf_dir):
    return D.total_events(_live(spark, sf_dir))


@register("events_per_min")
def q_events_per_min(spark, sf_dir):
    return D.events_per_min(_live(spark, sf_dir))


@register("velocity")
def q_velocity(spark, sf_dir):
    return D.velocity(_live(spark, sf_dir), PARAMS["slot_seconds"], PARAMS["n_slots"])


@register("throughput_now")
def q_throughput_now(spark, sf_dir):
    return D.throughput_now(D.velocity(_live(spark, sf_dir), PARAMS["slot_seconds"], PARAMS["n_slots"]))


@register("top_clusters")
def q_top_clusters(spark, sf_dir):
    return D.top_clusters(_live(spark, sf_dir))


@register("sentiment_counts")
def q_sentiment_counts(spark, sf_dir):
    return D.sentiment_counts(_live(spark, sf_dir))


@register("source_counts")
def q_source_counts(spark, sf_dir):
    return D.source_counts(_live(spark, sf_dir))


@register("top_entities")
def q_top_entities(spark, sf_dir):
    return D.top_entities(_live(spark, sf_dir))


@register("hotspots")
def q_hotspots(spark, sf_dir):
    return D.hotspots(_live(spark, sf_dir))


def _marked(spark, sf_dir):
    """The processed events, flagged where an alert of their batch names one of their entities."""
    f = load_feed(spark, sf_dir)
    marks = C.mark_events(f, C.burst_alerts(C.entity_sources(f))).select("event_id", "is_anomaly")
    return _stored_processed(spark, sf_dir).drop("is_anomaly").join(marks, "event_id", "left")


@register("hotspots_marked")
def q_hotspots_marked(spark, sf_dir):
    """E14 over the last days' marked events and more places, so that all threat levels occur."""
    return D.hotspots(V.retention(_marked(spark, sf_dir), PARAMS["hotspot_span"]), PARAMS["hotspot_places"])


@register("mood_index")
def q_mood_index(spark, sf_dir):
    return D.mood_index(_live(spark, sf_dir), PARAMS["slot_seconds"])


@register("keyword_counts")
def q_keyword_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", X.tokens("text").alias("toks"))
    return D.keyword_counts(X.keywords_long(d, "doc_id", "toks", carry=("source",)))


@register("batch_stats")
def q_batch_stats(spark, sf_dir):
    return D.batch_stats(load_feed(spark, sf_dir), batch_of("event_id"))


@register("unread_alerts")
def q_unread_alerts(spark, sf_dir):
    return D.unread_alerts(_live(spark, sf_dir), PARAMS["cleared_at"])


# ---- pages, top-k -----------------------------------------------------------------------

@register("recent_events")
def q_recent_events(spark, sf_dir):
    return V.newest(_stored_processed(spark, sf_dir), 50, [F.desc("ingested_at"), F.desc("event_id")]).select(
        "event_id", "ingested_at", "title")


@register("feed_page")
def q_feed_page(spark, sf_dir):
    live = V.feed_search(V.feed_filter(_live(spark, sf_dir), PARAMS["feed_source"]), PARAMS["search_term"])
    return V.newest(live, 50).select("seq", "title", "source_type")


@register("history_buffer")
def q_history_buffer(spark, sf_dir):
    return V.newest(_live(spark, sf_dir), 1000).select("seq", "title")


@register("alerts_recent")
def q_alerts_recent(spark, sf_dir):
    return V.newest(V.alert_filter(_live(spark, sf_dir)), 51).select("seq", "title")


@register("ticker")
def q_ticker(spark, sf_dir):
    return V.newest(V.ticker_filter(_live(spark, sf_dir)), 20).select("seq", "title", "level")


@register("active_markers")
def q_active_markers(spark, sf_dir):
    return V.active_markers(_live(spark, sf_dir), PARAMS["marker_seconds"]).select("seq", "lat", "lng", "title")


@register("embedding_xy")
def q_embedding_xy(spark, sf_dir):
    return V.embedding_xy(table(spark, sf_dir, "embeddings"))


# ---- graph, unions ------------------------------------------------------------------------

@register("entity_edges")
def q_entity_edges(spark, sf_dir):
    return GR.entity_edges(_live(spark, sf_dir)).select("src", "dst", F.col("pos").cast("long").alias("pos"))


@register("entity_nodes")
def q_entity_nodes(spark, sf_dir):
    return GR.entity_nodes(GR.entity_edges(_live(spark, sf_dir)))


@register("entity_nodes_marked")
def q_entity_nodes_marked(spark, sf_dir):
    """G2 over the marked events: anomaly nodes occur."""
    return GR.entity_nodes(GR.entity_edges(_marked(spark, sf_dir)))


@register("live_feed")
def q_live_feed(spark, sf_dir):
    return _live(spark, sf_dir).select("seq", "event_id", "event_time", "source_type", "title", "is_anomaly")


#: Stored tables that queries share, for timing them apart.
STORES = {"processed_events": _stored_processed, "meta_events": _stored_alerts, "processed_by_date": _by_date, "text_index": _text_index}


# ---- streaming jobs checked against the batch result (S=B) ------------------------------

def _stream_dir(spark, name):
    import uuid
    from ..session import shared_path
    return shared_path(spark, "streams", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:8]}")


FEED_COLS = ["event_id", "event_time", "source_type", "value", "place", "title", "description",
             "lat", "lng", "sentiment", "entities", "user_id"]


def _feed_files(spark, sf_dir, root, rows_per_file=None, chunk=None):
    import os
    from ..streaming import pipeline as P
    src = os.path.join(root, "src")
    P.write_feed_files(load_feed(spark, sf_dir).select(*FEED_COLS), src, rows_per_file, chunk=chunk)
    return src


def _epoch_rows(spark, sf_dir):
    """Ids a file in the stream queries: four files, or ten rows a file at least, and no multiple of a batch."""
    return max(10, -(-(_max_batch(spark, sf_dir, 1) + 1) // 4)) // 10 * 10 + 3


#: Ids a file of a stream at most: a file is written by one task, so a large epoch has several, read together.
FILE_IDS = 50_000


def _dealt_feed(spark, sf_dir):
    """(feed, ids a file, files an epoch) of epochs of about ``_epoch_rows`` ids, with a file's rows in one task. Files are in
    the order of the ids."""
    per = _epoch_rows(spark, sf_dir)
    files = -(-per // FILE_IDS)
    ids = -(-per // files)
    return dealt_feed(spark, sf_dir, F.expr(f"event_id div {ids}"), max(16, 10 * files)), ids, files


AVAILABLE = {"availableNow": True}


def _fanout(spark, sf_dir):
    """Folder of processed_events and meta_events, written by one stream of four or five epochs; run once for the two
    queries that read it."""
    import os
    from ..streaming import pipeline as P

    def run(root):
        src = os.path.join(root, "src")
        feed, ids, files = _dealt_feed(spark, sf_dir)
        P.write_feed_files(feed.select(*FEED_COLS), src, ids, dealt=True)
        P.run_available_now(P.start_fanout(P.file_events(spark, src, max_files_per_trigger=files), root, os.path.join(root, "ckpt"), AVAILABLE))
        P.finish_fanout(spark, root, spark.read.parquet(os.path.join(root, "burst_progress")).agg(F.max("epoch")).first()[0])
    return stored_path(spark, sf_dir, "fanout", "events", run)


@register("sink_fanout")
def q_sink_fanout(spark, sf_dir):
    """A4/H1/H2: the feed as a file stream through the per-epoch fan-out sink, events side."""
    import os
    return spark.read.parquet(os.path.join(_fanout(spark, sf_dir), "processed_events")).select(*FEED_COLS)


@register("sink_fanout_alerts")
def q_sink_fanout_alerts(spark, sf_dir):
    """A4: the alerts side of the same sink."""
    import os
    return spark.read.parquet(os.path.join(_fanout(spark, sf_dir), "meta_events")).drop("epoch")


@register("tail_inserts")
def q_tail_inserts(spark, sf_dir):
    """A5: a live tail (file stream) of the append-only processed table, into a sink."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "tail")
    src = _feed_files(spark, sf_dir, root)
    P.run_available_now(P.start_processed(P.file_events(spark, src), root, os.path.join(root, "ckpt1"), AVAILABLE))
    table_path = os.path.join(root, "processed_events")
    schema = spark.read.parquet(table_path).drop("epoch").schema
    out = os.path.join(root, "tail")
    P.run_available_now(P.parquet_sink(P.tail_table(spark, table_path, schema), out, os.path.join(root, "ckpt2")))
    return spark.read.parquet(out).select(*FEED_COLS)


@register("alerts_stream")
def q_alerts_stream(spark, sf_dir):
    """The keyed counter with state and timers. The first third of the events is a history whose batch fold
    gives the initial counters; the rest is streamed a file an epoch."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "alerts")
    feed = load_feed(spark, sf_dir).select(*FEED_COLS)
    last = _max_batch(spark, sf_dir)
    cut = last // 3 * 10
    past, new = feed.where(F.col("event_id") < cut), feed.where(F.col("event_id") >= cut)
    C.burst_counter_state(C.entity_sources(past)).select("entity", F.col("run").cast("long").alias("run")) \
        .write.parquet(os.path.join(root, "counters"))
    src = os.path.join(root, "src")
    P.write_feed_files(new, src, _epoch_rows(spark, sf_dir))
    P.write_heartbeat(spark, src, (last + 10) * 10)
    P.run_available_now(P.start_alerts(P.file_events(spark, src, max_files_per_trigger=1), root, os.path.join(root, "ckpt"), AVAILABLE,
                                       delay=1, history=os.path.join(root, "counters")))
    return C.meta_events(past).unionByName(spark.read.parquet(os.path.join(root, "meta_events")).drop("epoch", "ingested_at"))


def _consumer(spark, sf_dir):
    """The consumer's whole chain as one stream: JSON messages of four shapes, decoded, enriched (sentiment, vectors,
    entities found in the text, keywords, coordinates), correlated on the entities found, two tables."""
    import os
    from ..streaming import pipeline as P

    def run(root):
        src = os.path.join(root, "src")
        feed, ids, files = _dealt_feed(spark, sf_dir)
        union = U.union_shapes(feed)
        P.write_feed_files(union, src, ids, dealt=True)
        P.run_available_now(P.start_fanout(P.file_events(spark, src, union.schema, max_files_per_trigger=files), root,
                                           os.path.join(root, "ckpt"), AVAILABLE, transform=EN.consume))
        P.finish_fanout(spark, root, spark.read.parquet(os.path.join(root, "burst_progress")).agg(F.max("epoch")).first()[0])
    return stored_path(spark, sf_dir, "consumer", "events", run)


@register("consumer_processed")
def q_consumer_processed(spark, sf_dir):
    """D17 in the stream: the enriched events as stored."""
    import os
    return spark.read.parquet(os.path.join(_consumer(spark, sf_dir), "processed_events")).select(
        "event_id", "source_type", "sentiment", "embeddings", "keywords", "lat", "lng", "event_time")


@register("consumer_alerts")
def q_consumer_alerts(spark, sf_dir):
    """E1-E5 in the stream, on the entities that the enrichment found."""
    import os
    return spark.read.parquet(os.path.join(_consumer(spark, sf_dir), "meta_events")).drop("epoch")


@register("cross_stream_live")
def q_cross_stream_live(spark, sf_dir):
    """H4: event-time windows that the watermark closes, as a stream."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "windows")
    src = _feed_files(spark, sf_dir, root, _epoch_rows(spark, sf_dir))
    P.write_heartbeat(spark, src, 0)
    out = os.path.join(root, "out")
    found = P.windowed_cross_stream(P.file_events(spark, src, max_files_per_trigger=1))
    P.run_available_now(P.parquet_sink(found, out, os.path.join(root, "ckpt")))
    return spark.read.parquet(out)


@register("late_rows")
def q_late_rows(spark, sf_dir):
    """H4 side output: every 97th event arrives two files late; those whose window is closed by then are listed."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "late")
    per = _epoch_rows(spark, sf_dir)
    src = _feed_files(spark, sf_dir, root, chunk=F.expr(f"event_id div {per} + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END"))
    P.run_available_now(P.start_late_rows(P.file_events(spark, src, max_files_per_trigger=1), root, os.path.join(root, "ckpt"), AVAILABLE))
    return spark.read.parquet(os.path.join(root, "late_rows")).select("event_id", "event_time", "source_type")


def _slot_stream(spark, sf_dir, name, slots, chunk=None):
    """A stream of slots over the feed's files and a heartbeat at the end of the last slot and the delay."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, name)
    src = _feed_files(spark, sf_dir, root, _epoch_rows(spark, sf_dir), chunk)
    seconds, delay = PARAMS["slot_seconds"], PARAMS["slot_delay"]
    hi = load_feed(spark, sf_dir).agg(D.slot_start(D.slot_of(F.max("event_time"), seconds) + 1 + -(-delay // seconds), seconds)).first()[0]
    P.write_heartbeat(spark, src, 0, str(hi))
    out = os.path.join(root, "out")
    P.run_available_now(P.parquet_sink(slots(P.file_events(spark, src, max_files_per_trigger=1), seconds, delay), out,
                                       os.path.join(root, "ckpt")))
    return spark.read.parquet(out)


@register("velocity_stream")
def q_velocity_stream(spark, sf_dir):
    """E8 as a stream: every slot's count, empty slots too, emitted when the watermark passes the slot."""
    from ..streaming import pipeline as P
    return _slot_stream(spark, sf_dir, "velocity", P.slot_counts)


@register("mood_stream")
def q_mood_stream(spark, sf_dir):
    """E15 as a stream over the processed events; every 31st event comes a file late, within the delay."""
    from ..streaming import pipeline as P
    per = max(10, _epoch_rows(spark, sf_dir) // 2)
    late = F.expr(f"event_id div {per} + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END")
    return _slot_stream(spark, sf_dir, "mood", P.mood_line, late)


@register("bounded_epochs")
def q_bounded_epochs(spark, sf_dir):
    """Epochs of a bounded number of rows, and the progress table's rows an epoch beside the sink's."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "epochs")
    bound = _epoch_rows(spark, sf_dir)
    src = _feed_files(spark, sf_dir, root, bound)
    progress = P.recorded(spark, os.path.join(root, "progress"), lambda: P.start_processed(
        P.file_events(spark, src, max_files_per_trigger=1), root, os.path.join(root, "ckpt"), AVAILABLE))
    sink = spark.read.parquet(os.path.join(root, "processed_events")).groupBy(F.col("epoch").cast("long").alias("epoch")).agg(
        F.count(F.lit(1)).alias("n_sink"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return (progress.where("n_rows > 0").join(sink, "epoch", "full")
            .select((F.col("first_id") - F.col("first_id") % bound).alias("from_id"), "first_id", "last_id", "n_rows", "n_sink",
                    (F.col("n_rows") <= bound).alias("within"), F.expr("sources[0].end_offset is not null").alias("has_offsets")))


@register("backfill_live")
def q_backfill_live(spark, sf_dir):
    """History, then the live stream from the recorded position on; the live files overlap the history and
    deliver every 13th event twice."""
    import os
    from ..streaming import pipeline as P
    root = _stream_dir(spark, "backfill")
    feed = load_feed(spark, sf_dir).select(*FEED_COLS)
    n = _max_batch(spark, sf_dir, 1) + 1
    position = P.hand_over(feed.where(F.col("event_id") < int(n * 0.6)), root)
    live = feed.where(F.col("event_id") >= int(n * 0.4))
    src = os.path.join(root, "src")
    P.write_feed_files(live.unionByName(live.where("event_id % 13 = 0")), src, _epoch_rows(spark, sf_dir))
    out = P.live_after(P.file_events(spark, src, max_files_per_trigger=1), position)
    P.run_available_now(P.parquet_sink(out.select(*FEED_COLS), os.path.join(root, "live"), os.path.join(root, "ckpt")))
    return P.read_epoch(spark, root, "history", 0).select(*FEED_COLS).unionByName(
        spark.read.parquet(os.path.join(root, "live")).select(*FEED_COLS))
