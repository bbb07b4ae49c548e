"""Streaming equals batch (S=B) on the same input, and survives a restart."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import correlate as C
from tidewatch.sources.feed import load_feed
from tidewatch.sources.sinks import to_json_lines
from tidewatch.streaming import pipeline as P
from tidewatch.streaming import state as ST

from .conftest import SF_SMALL

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept by partition: a few are quicker to commit."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


N_EVENTS = 300  # 30 batches of 10 events: one file each, one file per trigger


def write_batches(spark, feed, folder, lo, hi):
    """One JSON-lines file per batch of 10 events, with increasing modification times."""
    os.makedirs(os.path.join(folder, "chunk=0"), exist_ok=True)
    rows = [r["value"] for r in to_json_lines(feed.where(F.col("event_id").between(lo * 10, hi * 10 - 1))
                                              .orderBy("event_id")).collect()]
    t0 = time.time() - 10_000
    for b in range(lo, hi):
        part = [r for r in rows if json.loads(r)["event_id"] // 10 == b]
        p = os.path.join(folder, "chunk=0", f"batch-{b:05d}.json")
        with open(p, "w") as f:
            f.write("\n".join(part) + "\n")
        os.utime(p, (t0 + b, t0 + b))


def batch_alerts(spark, feed, n_batches):
    sub = feed.where(F.col("event_id") < n_batches * 10)
    return {(r["entity"], r["batch"], r["score"], r["sentiment"]) for r in C.meta_events(sub).collect()}


def run_alerts(spark, src, out, ckpt, per_trigger=1, **options):
    stream = P.file_events(spark, src, max_files_per_trigger=per_trigger)
    P.run_available_now(P.start_alerts(stream, out, ckpt, trigger={"availableNow": True}, **options))


def read_alerts(spark, out):
    df = spark.read.parquet(os.path.join(out, "meta_events"))
    return sorted((r["entity"], r["batch"], r["score"], r["sentiment"]) for r in df.collect())


def last_epoch(spark, out):
    return spark.read.parquet(os.path.join(out, "burst_progress")).agg(F.max("epoch")).first()[0]


def test_alerts_equal_batch_and_survive_a_restart(spark, scratch):
    feed = load_feed(spark, SF_SMALL)
    src, out, ckpt = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    half = N_EVENTS // 20
    write_batches(spark, feed, src, 0, half)
    run_alerts(spark, src, out, ckpt, delay=1)
    # the last batch is open until the watermark passes it
    assert set(read_alerts(spark, out)) == {a for a in batch_alerts(spark, feed, half) if a[1] < half - 1}
    # restart on the same checkpoint with more files: state carries over
    write_batches(spark, feed, src, half, N_EVENTS // 10)
    P.write_heartbeat(spark, src, N_EVENTS + 500)
    run_alerts(spark, src, out, ckpt, delay=1)
    got = read_alerts(spark, out)
    assert len(got) == len(set(got)) and set(got) == batch_alerts(spark, feed, N_EVENTS // 10)


@pytest.mark.parametrize("rows_per_file, per_trigger", [(7, 2), (64, 1)])
def test_alerts_with_any_file_size(spark, scratch, rows_per_file, per_trigger):
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed, src, 40 if rows_per_file == 7 else rows_per_file)
    P.write_heartbeat(spark, src, N_EVENTS + 500)
    run_alerts(spark, src, out, os.path.join(scratch, "c"), per_trigger, delay=1)
    assert set(read_alerts(spark, out)) == batch_alerts(spark, feed, N_EVENTS // 10)


def test_alerts_with_files_out_of_order_within_the_delay(spark, scratch):
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    # files 1 0 3 2 5 4 ..: rows come up to two files (of 2.5 batches) late
    P.write_feed_files(feed, src, chunk=F.expr("(event_id div 25) + CASE WHEN (event_id div 25) % 2 = 0 THEN 1 ELSE -1 END"))
    P.write_heartbeat(spark, src, N_EVENTS + 500)
    run_alerts(spark, src, out, os.path.join(scratch, "c"), delay=6)
    assert set(read_alerts(spark, out)) == batch_alerts(spark, feed, N_EVENTS // 10)


def test_alerts_with_a_history_as_initial_state(spark, scratch):
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS)
    src, out, counters = (os.path.join(scratch, x) for x in ("src", "out", "counters"))
    past = feed.where(F.col("event_id") < 100)
    C.burst_counter_state(C.entity_sources(past)).select("entity", F.col("run").cast("long").alias("run")).write.parquet(counters)
    P.write_feed_files(feed.where(F.col("event_id") >= 100), src, 33)
    P.write_heartbeat(spark, src, N_EVENTS + 500)
    run_alerts(spark, src, out, os.path.join(scratch, "c"), delay=1, history=counters)
    every = batch_alerts(spark, feed, N_EVENTS // 10)
    assert set(read_alerts(spark, out)) == {a for a in every if a[1] >= 10}
    assert {a for a in every if a[1] >= 10} != batch_alerts(spark, feed.where(F.col("event_id") >= 100), N_EVENTS // 10)


def entity_feed(spark, rows):
    """(event_id, entity, source) rows as a feed."""
    return spark.createDataFrame(rows, "event_id long, entity string, source_type string").select(
        "event_id", F.timestamp_seconds("event_id").cast("timestamp_ntz").alias("event_time"), "source_type",
        F.when(F.col("entity").isNotNull(), F.to_json(F.create_map(F.lit("ORG"), F.array("entity")))).alias("entities"))


def test_idle_entities_lose_their_state(spark, scratch):
    """An entity at 9 that is idle for 20 batches starts again at 0."""
    rows = [(i, "Acme" if i < 9 or 400 <= i < 409 else None, "news") for i in range(420)]
    feed = entity_feed(spark, rows)
    for idle, n in ((None, 1), (20, 0), (60, 1)):
        base = os.path.join(scratch, str(idle))
        src = os.path.join(base, "src")
        P.write_feed_files(feed, src, 50)
        P.write_heartbeat(spark, src, 5000)
        run_alerts(spark, src, os.path.join(base, "out"), os.path.join(base, "c"), delay=1, idle=idle)
        assert len(read_alerts(spark, os.path.join(base, "out"))) == n


def test_the_load_pattern_bursts(spark, scratch):
    """One entity in every event of two sources: an alert each batch; of one source: each time the count passes 10."""
    for sources, want in ((("financial", "news"), 10), (("news",), 5)):
        base = os.path.join(scratch, str(len(sources)))
        src = os.path.join(base, "src")
        P.write_feed_files(entity_feed(spark, [(i, "Apple", sources[i % len(sources)]) for i in range(100)]), src, 15)
        P.write_heartbeat(spark, src, 5000)
        run_alerts(spark, src, os.path.join(base, "out"), os.path.join(base, "c"), delay=1)
        assert len(read_alerts(spark, os.path.join(base, "out"))) == want


def test_a_hot_entity_sends_a_row_a_batch_and_task(spark):
    feed = entity_feed(spark, [(i, "Hot", "news" if i % 2 else "gdacs") for i in range(5000)] + [(5000 + i, None, "news") for i in range(50)])
    got = ST.combined(ST.entity_rows(feed.coalesce(1))).collect()
    hot = [r for r in got if r["entity"] == "Hot"]
    assert len(hot) == 500 and all(r["n"] == 10 and sorted(r["sources"]) == ["gdacs", "news"] for r in hot)
    assert [(r["batch"], r["n"]) for r in got if r["entity"] is None] == [(504, 0)]


def test_processed_sink_and_tail(spark, scratch):
    feed = load_feed(spark, SF_SMALL)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    write_batches(spark, feed, src, 0, 5)
    q = P.start_processed(P.file_events(spark, src, max_files_per_trigger=1), out, os.path.join(scratch, "c1"),
                          trigger={"availableNow": True})
    q.awaitTermination(300)
    table = os.path.join(out, "processed_events")
    got = spark.read.parquet(table)
    assert got.count() == 50 and got.select("epoch").distinct().count() == 5
    # A5: tail of the append-only table
    tail = P.tail_table(spark, table, got.drop("epoch").schema)
    q2 = tail.writeStream.format("memory").queryName("tail_t").trigger(availableNow=True).start()
    q2.awaitTermination(300)
    assert spark.sql("select count(*) from tail_t").first()[0] == 50


@pytest.mark.parametrize("rows_per_file", [10, 64])
def test_fanout_carries_open_batches_over_epochs(spark, scratch, rows_per_file):
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    cut = 5 * rows_per_file
    for part in (feed.where(F.col("event_id") < cut), feed.where(F.col("event_id") >= cut)):  # two runs, one checkpoint
        P.write_feed_files(part, os.path.join(src, f"part={part.agg(F.min('event_id')).first()[0]}"), rows_per_file)
        P.run_available_now(P.start_fanout(P.file_events(spark, src, max_files_per_trigger=1), out, os.path.join(scratch, "c"),
                                           {"availableNow": True}))
    P.finish_fanout(spark, out, last_epoch(spark, out))
    assert set(read_alerts(spark, out)) == batch_alerts(spark, feed, N_EVENTS // 10)
    processed = spark.read.parquet(os.path.join(out, "processed_events"))
    assert sorted(r[0] for r in processed.select("event_id").collect()) == list(range(N_EVENTS))
    sizes = {r["epoch"]: r["n_rows"] for r in spark.read.parquet(os.path.join(out, "burst_progress")).collect()}
    assert sizes == {r["epoch"]: r["count"] for r in processed.groupBy("epoch").count().collect()}


def test_fanout_lists_rows_of_closed_batches(spark, scratch):
    feed = entity_feed(spark, [(i, "Acme", "news") for i in range(60)])
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed, src, chunk=F.expr("CASE WHEN event_id IN (3, 4, 17) THEN 9 ELSE event_id div 20 END"))
    P.run_available_now(P.start_fanout(P.file_events(spark, src, max_files_per_trigger=1), out, os.path.join(scratch, "c"),
                                       {"availableNow": True}))
    P.finish_fanout(spark, out, last_epoch(spark, out))
    late = spark.read.parquet(os.path.join(out, "late_events"))
    assert sorted(r["event_id"] for r in late.collect()) == [3, 4, 17]
    assert spark.read.parquet(os.path.join(out, "processed_events")).count() == 60
    rest = feed.where(~F.col("event_id").isin(3, 4, 17))
    assert set(read_alerts(spark, out)) == {(r["entity"], r["batch"], r["score"], r["sentiment"]) for r in C.meta_events(rest).collect()}


def test_fanout_needs_the_epoch_before(spark, scratch):
    feed = entity_feed(spark, [(i, "Acme", "news") for i in range(60)])
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        P._fold_epoch(feed, scratch, 3, 10, 10)


def windows(feed):
    from tidewatch.operators import dashboard as D
    a = C.cross_stream(C.entity_sources(feed, batch=D.slot_of(F.col("event_time"), 600)))
    return {(r["w"], r["entity"], r["n_events"], tuple(r["sources"])) for r in
            a.select(D.slot_start(F.col("batch"), 600).alias("w"), "entity", "n_events", "sources").collect()}


def test_windows_close_and_late_rows_are_listed(spark, scratch):
    """Every 7th event comes five files late. The stream equals the batch result over the rows in time, and rows in time
    and late rows together are the feed."""
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS).withColumn(
        "event_time", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id * 20)"))
    src, out, late = (os.path.join(scratch, x) for x in ("src", "out", "late"))
    P.write_feed_files(feed, src, chunk=F.expr("event_id div 30 + CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END"))
    P.write_heartbeat(spark, src, N_EVENTS + 500)
    P.run_available_now(P.start_late_rows(P.file_events(spark, src, max_files_per_trigger=1), late, os.path.join(scratch, "c1"),
                                          {"availableNow": True}))
    dropped = {r["event_id"] for r in spark.read.parquet(os.path.join(late, "late_rows")).collect()}
    assert dropped and all(i % 7 == 0 for i in dropped)
    counts = spark.read.parquet(os.path.join(late, "late_counts")).agg(F.sum("n_late")).first()[0]
    assert counts == len(dropped)
    found = P.windowed_cross_stream(P.file_events(spark, src, max_files_per_trigger=1))
    P.run_available_now(P.parquet_sink(found, out, os.path.join(scratch, "c2")))
    got = [(r["window_start"], r["entity"], r["n_events"], tuple(r["sources"])) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got))
    assert set(got) == windows(feed.where(~F.col("event_id").isin(*dropped)))


def test_history_then_live_by_position(spark, scratch):
    """Overlap is cut by position, repeats by the watermark, whose state does not grow with the stream."""
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < N_EVENTS)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    position = P.hand_over(feed.where(F.col("event_id") < 120), out)
    assert position == 119 and P.hand_over(feed, out) == 119  # recorded once
    live = feed.where(F.col("event_id") >= 60)
    P.write_feed_files(live.unionByName(live.where("event_id % 3 = 0")), src, 20)
    progress = P.recorded(spark, os.path.join(scratch, "progress"), lambda: P.parquet_sink(
        P.live_after(P.file_events(spark, src, max_files_per_trigger=1), position), os.path.join(out, "live"), os.path.join(scratch, "c")))
    ids = [r[0] for r in P.read_epoch(spark, out, "history", 0).select("event_id").unionByName(
        spark.read.parquet(os.path.join(out, "live")).select("event_id")).collect()]
    assert sorted(ids) == list(range(N_EVENTS))
    state = [r["state_rows"] for r in progress.orderBy("epoch").collect()]
    assert 0 < max(state) < 60 and state[-1] <= max(state)


def test_epochs_hold_ten_rows_at_most_and_progress_agrees(spark, scratch):
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < 95)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed, src, 10)
    progress = P.recorded(spark, os.path.join(scratch, "progress"), lambda: P.start_processed(
        P.file_events(spark, src, max_files_per_trigger=1), out, os.path.join(scratch, "c"), {"availableNow": True}))
    sink = {r["epoch"]: r["count"] for r in spark.read.parquet(os.path.join(out, "processed_events")).groupBy("epoch").count().collect()}
    assert {r["epoch"]: r["n_rows"] for r in progress.where("n_rows > 0").collect()} == sink
    assert sum(sink.values()) == 95 and max(sink.values()) == 10 and len(sink) == 10
    ends = [r["sources"][0]["end_offset"] for r in progress.where("n_rows > 0").orderBy("epoch").collect()]
    assert ends == [json.dumps({"logOffset": i}).replace(" ", "") for i in range(10)]


def test_processing_time_trigger(spark, scratch):
    """Rows that are there go out with the trigger, ten an epoch, and the tail is not lost on stop."""
    feed = load_feed(spark, SF_SMALL).where(F.col("event_id") < 25)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed, src, 10)
    q = P.start_processed(P.file_events(spark, src, max_files_per_trigger=1), out, os.path.join(scratch, "c"), {"processingTime": "1 second"})
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(os.path.join(out, "processed_events")).groupBy("epoch").count().orderBy("epoch").collect()
    assert [r["count"] for r in got] == [10, 10, 5]


def test_slot_counts_fill_gaps(spark, scratch):
    feed = entity_feed(spark, [(i, "x", "news") for i in [*range(0, 20), *range(100, 130), 300]])
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed, src, 15)
    P.write_heartbeat(spark, src, 0, "1970-01-01 00:05:10")
    P.run_available_now(P.parquet_sink(P.slot_counts(P.file_events(spark, src, max_files_per_trigger=1), 10), out, os.path.join(scratch, "c")))
    got = [(int(r["slot_start"].timestamp()), r["n"]) for r in spark.read.parquet(out).orderBy("slot_start").collect()]
    want = [0] * 31
    for i in [*range(0, 20), *range(100, 130), 300]:
        want[i // 10] += 1
    assert [n for _, n in got] == want


def test_clamp_triples_compose():
    import random
    rnd = random.Random(3)
    for _ in range(300):
        cells = "".join(rnd.choice("+++---0x.") for _ in range(rnd.randrange(60)))
        for x in (-10, -3, 0, 7, 10):
            want = x
            for c in cells:
                if c in "+-0":
                    want = min(10, max(-10, want + {"+": 1, "-": -1, "0": 0}[c]))
            f = ST.clamp_triple(cells)
            assert (x if f is None else min(f[2], max(f[1], x + f[0]))) == want


def test_mood_line_with_late_events(spark, scratch):
    """Events come up to a file late and twice; the line is that of all events in order."""
    labels = ["POSITIVE", "NEGATIVE", "POSITIVE", "", None, "odd", "NEUTRAL", "POSITIVE"]
    rows = [(i, i * 3, labels[(i * i + i // 7) % 8]) for i in range(300) if not 100 <= i < 130]
    feed = spark.createDataFrame(rows, "event_id long, t long, sentiment string").select(
        "event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("event_time"), "sentiment")
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    P.write_feed_files(feed.unionByName(feed.where("event_id % 50 = 7")), src,
                       chunk=F.expr("event_id div 40 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"))
    P.write_heartbeat(spark, src, 0, "1970-01-01 00:19:00")
    P.run_available_now(P.parquet_sink(P.mood_line(P.file_events(spark, src, max_files_per_trigger=1), 10, 240), out, os.path.join(scratch, "c")))
    got = [(int(r["slot_start"].timestamp()), r["mood"]) for r in spark.read.parquet(out).orderBy("slot_start").collect()]
    want, mood, last = [], 0, 0
    for slot in range(90):
        for i, t, label in rows:
            if t // 10 == slot:
                step = {"positive": 1, "negative": -1, "neutral": 0}.get((label or "neutral").lower())
                if step is not None:
                    mood = min(10, max(-10, mood + step))
        want.append(mood)
    assert [m for _, m in got] == want
