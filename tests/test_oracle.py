"""Registered queries against their DuckDB oracle SQL, plus the entry-point contract.

By default a core subset runs at sf0.001; set TIDEWATCH_ALL_ORACLE=1 to run every key
(``python -m tidewatch.plans.check`` does the same at sf0.01).
"""

import os

import pytest

import __spark_entry__ as E
from tidewatch.plans.check import duck_connect, rows_of
from tidewatch.plans.registry import QUERIES

from .conftest import SF_CHECK, SF_SMALL

CORE = ["meta_events", "burst_counter", "burst_state", "entity_sources", "geocode", "tokens", "keywords_topn",
        "classify", "classify_docs", "enrich_event", "sse_decode", "edit_projection", "union_feeds", "top_entities",
        "hotspots", "velocity", "mood_index", "entity_edges", "feed_page", "keyword_counts", "entities_dict",
        "sentiment_lexicon", "src_json_events", "event_lookup", "index_search_any", "index_search_all", "hotspots_marked",
        "entity_nodes_marked", "sentiment_bucket_old", "event_defaults", "blank_guard", "embed_hash", "enrich_batch",
        "entities_encode", "recent_events", "retention", "time_range", "sentiment_model", "active_markers"]
#: Streams over the whole feed, equal to the batch result.
STREAMS = ["sink_fanout", "sink_fanout_alerts", "alerts_stream", "consumer_processed", "consumer_alerts", "cross_stream_live",
           "late_rows", "velocity_stream", "mood_stream", "bounded_epochs", "backfill_live"]
KEYS = sorted(QUERIES) if os.environ.get("TIDEWATCH_ALL_ORACLE") else CORE


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


def test_every_query_has_oracle_or_is_rows_only():
    assert set(QUERIES) == set(QUERIES) & set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    scols, srows = rows_of(sdf.columns, sdf.collect())
    sql = E.oracle_sql().get(key)
    if sql is None:
        return
    res = duck.execute(sql)
    dcols, drows = rows_of([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows


@pytest.mark.parametrize("key", ["sink_json_roundtrip", *STREAMS])
def test_sinks_match_oracle(spark, duck, key):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        test_query_matches_oracle(spark, duck, key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_branch_has_rows():
    """The rows that the queries are compared on reach each branch (at sf0.01, where the driver compares them)."""
    duck = duck_connect(SF_CHECK)

    def values(key, column):
        return {r[0] for r in duck.execute(f"select distinct {column} from ({E.oracle_sql()[key]})").fetchall()}
    assert values("hotspots_marked", "threat") == {"EXTREME", "ELEVATED", "NORMAL"}
    assert values("sentiment_bucket_old", "bucket") == {"burst", "positive", "negative", "neutral"}
    assert values("entity_nodes_marked", "color") == {"#ef4444", "#10b981", None}
    assert values("blank_guard", "is_blank") == {True, False}
    assert values("entities_dict", "label") == {"GPE", "LOC", "ORG", "EVENT"}  # the dictionary names no persons
    assert {"Untitled Event"} < values("event_defaults", "title") and "" in values("event_defaults", "body")
    assert values("event_defaults", "corr_source") >= {"unknown", "news", "system_alert"}
    assert values("event_defaults", "chart_source") >= {"wikipedia", "news"} and "general" in values("event_defaults", "cluster")
    for key in ("active_markers", "late_rows", "index_search_all", "event_lookup", "consumer_alerts"):
        assert duck.execute(f"select count(*) from ({E.oracle_sql()[key]})").fetchone()[0] > 0


@pytest.mark.parametrize("key, scans", [("sentiment_model", 1), ("sentiment_lexicon", 1), ("enrich_event", 1)])
def test_the_lexicon_is_scanned_once_a_row(spark, key, scans):
    from tidewatch.functions.sentiment import lexicon_pattern
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(lexicon_pattern()) == scans


@pytest.mark.parametrize("key", ["union_feeds", "raw_text", "enrich_text"])
def test_unions_scan_their_table_once(spark, key):
    assert E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


@pytest.mark.parametrize("key", ["retention", "active_markers", "velocity"])
def test_time_bounds_reach_the_files(spark, key):
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan[plan.index("PushedFilters"):]


@pytest.mark.parametrize("key", ["src_json_events", "sink_json_roundtrip"])
def test_json_queries_scan_json_files(spark, key):
    assert "FileScan json" in E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["batch", "entity", "score", "n_sources"]
    assert df.count() >= 0


def test_embedding_is_unit_length(spark):
    rows = E.queries()["embed_hash"](spark, SF_SMALL).limit(20).collect()
    for r in rows:
        v = r["embedding"]
        if v:
            assert len(v) == 64
            assert abs(sum(x * x for x in v) - 1.0) < 1e-4
