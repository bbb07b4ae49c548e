"""Literal goldens for rule edges (FIXTURES.md §6)."""

from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions import entities as N
from tidewatch.functions import sentiment as S
from tidewatch.functions import text as X
from tidewatch.operators import correlate as C
from tidewatch.operators import dashboard as D
from tidewatch.operators import geo as G
from tidewatch.sources import edits as ED


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"t {typ}").select(col(F.col("t")).alias("r")).first()["r"]


def test_cluster_rules(spark):
    assert one(spark, X.classify, "market attack and war") == "war"
    assert one(spark, X.classify, "attack on the market") == "terrorism"
    assert one(spark, X.classify, "zzz") == "general"
    assert one(spark, X.classify, None) == "general"
    assert one(spark, X.classify, "") == "general"
    assert one(spark, X.classify, "ai software war") == "war"


def test_tokens_and_keywords(spark):
    assert one(spark, X.tokens, "São Paulo: 3 big quakes, the AI") == ["paulo", "big", "quakes"]
    assert one(spark, X.tokens, None) == []
    assert one(spark, lambda c: X.keywords_inline(X.tokens(c)), "beta alpha beta alpha gamma") == ["beta", "alpha", "gamma"]
    df = spark.createDataFrame([(1, "beta alpha beta alpha gamma")], "id long, t string")
    kw = X.keywords_array(df.select("id", X.tokens("t").alias("toks")), "id", "toks").first()["keywords"]
    assert kw == ["beta", "alpha", "gamma"]


def test_word_count_and_enrich_text(spark):
    df = spark.createDataFrame([("A title", "", None, "c")], "title string, description string, content string, comment string")
    assert df.select(X.enrich_text_of(df).alias("t")).first()["t"] == "A title c"
    assert one(spark, lambda c: X.word_count(X.tokens(c)), "one two three four") == 4


def test_blank_guard(spark):
    assert one(spark, X.is_blank, "   \t\n") is True
    assert one(spark, X.is_blank, "　 ") is True
    assert one(spark, X.is_blank, " x ") is False
    assert one(spark, X.is_blank, None) is True


def test_sentiment_thresholds(spark):
    for score, want in [(0.05, "positive"), (0.049, "neutral"), (-0.05, "negative")]:
        assert one(spark, S.label_of, score, "double") == want
    rows = spark.createDataFrame([(0.2, False), (0.21, False), (-0.2, False), (0.9, True)], "s double, b boolean")
    got = [r[0] for r in rows.select(S.old_bucket(F.col("s"), F.col("b"))).collect()]
    assert got == ["neutral", "positive", "neutral", "burst"]


def test_threat_levels(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (6,)], "a int")
    assert [r[0] for r in df.select(D.threat_level(F.col("a"))).collect()] == ["NORMAL", "ELEVATED", "ELEVATED", "EXTREME"]


def test_capitalize_first(spark):
    assert one(spark, X.capitalize_first, "aI general") == "AI general"


def _events(spark, rows):
    """rows: (event_id, source_type, entities_json)"""
    return spark.createDataFrame(
        [(i, s, e) for i, s, e in rows], "event_id long, source_type string, entities string"
    ).withColumn("event_time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))


def test_burst_golden(spark):
    # 20 single-source "Apple" events, one per batch -> one alert with score 11, 9 left.
    feed = _events(spark, [(i * 10, "financial", '{"ORG": ["Apple"]}') for i in range(20)])
    agg = C.entity_sources(feed)
    alerts = C.burst_alerts(agg).collect()
    assert [(a["entity"], a["score"], a["is_burst"], a["is_cross"]) for a in alerts] == [("Apple", 11, True, False)]
    st = C.burst_counter_state(agg).first()
    assert st["run"] == 9


def test_no_alert_at_ten(spark):
    feed = _events(spark, [(i * 10, "news", '{"ORG": ["Apple"]}') for i in range(10)])
    assert C.burst_alerts(C.entity_sources(feed)).count() == 0


def test_cross_stream_golden(spark):
    feed = _events(spark, [(0, "news", '{"GPE": ["Paris"]}'), (1, "gdacs", '{"GPE": ["Paris"]}')])
    agg = C.entity_sources(feed)
    rows = C.alert_rows(C.burst_alerts(agg)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["sentiment"] == "NEGATIVE" and r["score"] == 2 and r["lat"] == 48.8566
    assert r["description"] == ("Entity 'Paris' exhibited anomalous behavior. Sources involved: gdacs, news. "
                                "Burst score: 2")
    assert C.burst_counter_state(agg).first()["run"] == 0


def test_geocode_goldens(spark):
    df = spark.createDataFrame(
        [(1, 10.0, None, '{"GPE": ["Zone1", "Paris"], "LOC": ["London"]}'),
         (2, 1.0, 2.0, '{"GPE": ["Paris"]}'),
         (3, None, None, '{"LOC": ["London"], "GPE": ["Nowhere"]}'),
         (4, None, None, "{bad json")],
        "id int, lat double, lng double, entities string").withColumn("ents", X.decode_entities("entities"))
    got = {r["id"]: (r["lat"], r["lng"]) for r in G.geocode(df).collect()}
    assert got[1] == (48.8566, 2.3522)
    assert got[2] == (1.0, 2.0)
    assert got[3] == (51.5074, -0.1278)
    assert got[4] == (None, None)


def test_edit_filter_golden(spark):
    lines = spark.createDataFrame([
        (1, 'data: {"title": "A", "wiki": "enwiki"}'),
        (2, 'data: {"title": "B", "wiki": "enwiki", "bot": true}'),
        (3, 'data: {"title": "Talk:X", "wiki": "enwiki", "bot": false}'),
        (4, 'data: {"title": "talk:x", "wiki": "enwiki", "bot": false}'),
        (5, 'data: {"title": "   ", "wiki": "enwiki"}'),
        (6, 'data: {bad'), (7, ""), (8, "event: message"),
    ], "line_no long, value string")
    dec = ED.decode_sse(lines)
    assert sorted(r["line_no"] for r in dec.collect()) == [1, 2, 3, 4, 5]
    kept = sorted(r["line_no"] for r in ED.edit_filter(dec).collect())
    assert kept == [1, 4]
    proj = ED.edit_projection(ED.edit_filter(dec)).where("line_no = 1").first()
    assert proj["comment"] == "" and proj["_raw_text"] == "A " and proj["source_type"] == "wikipedia"


def test_mood_clamp_golden(spark):
    rows = [(i, "POSITIVE") for i in range(12)] + [(12 + i, "NEGATIVE") for i in range(3)]
    live = spark.createDataFrame(rows, "seq long, sentiment string").withColumn(
        "event_time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    out = D.mood_index(live, slot_seconds=1).collect()
    assert [r["mood"] for r in out] == [7]


def test_mood_carries_into_empty_slots(spark):
    live = spark.createDataFrame(
        [(0, "positive", "2024-01-01 00:00:00"), (1, "positive", "2024-01-01 00:00:00"),
         (2, "negative", "2024-01-01 00:00:03"), (3, "other", "2024-01-01 00:00:04")],
        "seq long, sentiment string, t string").withColumn("event_time", F.to_timestamp_ntz("t"))
    out = sorted((r["slot_start"], r["mood"]) for r in D.mood_index(live, slot_seconds=1).collect())
    assert [m for _, m in out] == [2, 2, 2, 1, 1]


def test_entities_dictionary(spark):
    m = one(spark, lambda c: F.to_json(N.entities_map(c)), "Apple opened in London and Paris, then London again")
    assert m == '{"ORG":["Apple"],"GPE":["London","Paris","London"]}'
    s = spark.createDataFrame([("Apple in London and Paris",)], "t string").select(
        N.entities_struct(N.entities_map(F.col("t"))).alias("s")).first()["s"]
    assert s["locations"] == ["London", "Paris"] and s["orgs"] == ["Apple"] and s["countries"] == s["locations"]
    assert one(spark, lambda c: F.to_json(N.entities_map(c)), "   ") == "{}"


def test_classify_finds_overlapping_keywords_in_one_pass(spark):
    """Keywords that overlap or begin with one another all count, as by plain containment."""
    import random
    kws, rnd = dims.cluster_keywords(), random.Random(3)
    words = [k for _, k, _ in kws]
    texts = [rnd.choice(["", " ", "x"]).join(rnd.choice(words)[:rnd.choice([2, 9, 30])] for _ in range(rnd.randint(0, 12))) for _ in range(400)]

    def plain(t):
        found = [(p, c) for p, k, c in kws if k in t]
        return max(found, key=lambda f: (sum(c == f[1] for _, c in found), -f[0]))[1] if found else "general"
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.classify("t").alias("c"))
    assert {r["i"]: r["c"] for r in out.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
