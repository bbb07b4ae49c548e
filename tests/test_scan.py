"""The parallel ordered scan equals a sequential fold, for any fan-out and key skew."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import correlate as C
from tidewatch.operators import dashboard as D
from tidewatch.plans.scan import levels_for


def brute_alerts(steps, threshold=10):
    """steps: {entity: [(batch, c, ns)]} -> set of (entity, batch, score), final runs."""
    out, final = set(), {}
    for e, seq in steps.items():
        run = 0
        for b, c, ns in sorted(seq):
            run += c
            if ns > 1 or run > threshold:
                out.add((e, b, run))
                run = 0
        final[e] = run
    return out, final


def make_steps(seed):
    rnd = random.Random(seed)
    steps = {}
    # one hot entity with most of the batches, a few small ones
    steps["hot"] = [(b, rnd.randint(1, 6), 2 if rnd.random() < 0.03 else 1) for b in range(0, 3000)]
    for e in range(5):
        bs = sorted(rnd.sample(range(3000), 40))
        steps[f"e{e}"] = [(b, rnd.randint(1, 4), rnd.choice([1, 1, 1, 2])) for b in bs]
    return steps


def agg_df(spark, steps):
    rows = []
    for e, seq in steps.items():
        for b, c, ns in seq:
            rows.append((b, e, c, ["s%d" % i for i in range(ns)], ns))
    return (spark.createDataFrame(rows, "batch long, entity string, n_events long, sources array<string>, n_sources long")
            .withColumn("last_time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))


def test_levels_for():
    assert levels_for(0, 1024) == 1
    assert levels_for(1023, 1024) == 1
    assert levels_for(1024, 1024) == 2
    assert levels_for(10**12, 1024) == 4


def test_burst_scan_matches_fold(spark):
    steps = make_steps(7)
    want, final = brute_alerts(steps)
    agg = agg_df(spark, steps)
    for fanout in (1024, 16, 3):
        got = {(r["entity"], r["batch"], r["score"]) for r in C.burst_alerts(agg, fanout=fanout).collect()}
        assert got == want, fanout
        st = {r["entity"]: r["run"] for r in C.burst_counter_state(agg, fanout=fanout).collect()}
        assert st == final


def test_burst_scan_threshold_parameter(spark):
    steps = make_steps(11)
    want, _ = brute_alerts(steps, threshold=4)
    agg = agg_df(spark, steps)
    got = {(r["entity"], r["batch"], r["score"]) for r in C.burst_alerts(agg, threshold=4, fanout=8).collect()}
    assert got == want


def test_mood_scan_matches_fold(spark):
    rnd = random.Random(3)
    rows, t0 = [], 1_704_067_200
    sec = 0
    for i in range(2000):
        sec += rnd.choice([0, 0, 0, 1, 2, 7])
        rows.append((i, rnd.choice(["POSITIVE", "NEGATIVE", "NEUTRAL", "positive", "other"]), t0 + sec))
    live = spark.createDataFrame(rows, "seq long, sentiment string, s long").withColumn(
        "event_time", F.timestamp_seconds("s").cast("timestamp_ntz"))
    # sequential fold per second, carried into empty seconds
    by_sec = {}
    x = 0
    for i, lab, s in rows:
        lab = lab.lower()
        if lab in ("positive", "negative", "neutral"):
            x = max(-10, min(10, x + (1 if lab == "positive" else -1 if lab == "negative" else 0)))
        by_sec[s] = x
    want, last = [], 0
    for s in range(rows[0][2], rows[-1][2] + 1):
        last = by_sec.get(s, last)
        want.append(last)
    for fanout in (1024, 5):
        got = [r["mood"] for r in D.mood_index(live, slot_seconds=1, fanout=fanout).orderBy("slot_start").collect()]
        assert got == want
        assert all(-10 <= v <= 10 for v in got)


def test_items_are_dealt_to_their_groups_once(spark):
    """The levels and the descent read the stored first level, not the items again."""
    items = spark.createDataFrame([("a", i, 1, 1, ["news"], None) for i in range(30)] + [(None, 3, 1, 2, ["gdacs", "news"], None)],
                                  "entity string, batch long, n_events int, n_sources long, sources array<string>, last_time timestamp_ntz")
    out = C.burst_alerts(items, 5, fanout=3)
    assert out.inputFiles() and all("scan-level" in f for f in out.inputFiles())
    got = [(r["entity"], r["batch"], r["score"]) for r in out.collect()]
    assert sorted(x for x in got if x[0]) == [("a", 6 * i + 5, 6) for i in range(5)]
