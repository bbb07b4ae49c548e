"""Sources and sinks: JSON round trip, SSE decode, polling, counts/clear, idempotent epochs."""

import os

from pyspark.sql import functions as F

from tidewatch.operators import setops as U
from tidewatch.sources import sinks as SK
from tidewatch.sources.feed import load_feed
from tidewatch.sources.tables import spread_by_id

from .conftest import SF_SMALL


def test_json_roundtrip_keeps_rows(spark):
    feed = load_feed(spark, SF_SMALL)
    back = SK.from_json_lines(SK.to_json_lines(feed), feed.schema)
    assert back.exceptAll(feed).count() == 0 and feed.exceptAll(back).count() == 0


def test_union_feeds_shapes(spark):
    shapes = U.feed_shapes(load_feed(spark, SF_SMALL))
    u = U.union_feeds(shapes)
    cols = set(u.columns)
    assert {"description", "symbol", "comment", "disaster_type", "category"} <= cols
    n = sum(df.count() for df in shapes.values())
    assert u.count() == n
    # all three timestamp spellings parse
    assert u.where(F.col("timestamp").try_cast("timestamp").isNull()).count() == 0


def test_union_from_one_scan_equals_the_union_of_feeds(spark):
    feed = load_feed(spark, SF_SMALL)
    four, one = U.union_feeds(U.feed_shapes(feed)), U.union_shapes(feed)
    assert four.columns == one.columns and [d for _, d in four.dtypes] == [d for _, d in one.dtypes]
    assert four.exceptAll(one).count() == 0 and one.exceptAll(four).count() == 0


def test_poll_since(spark):
    feed = load_feed(spark, SF_SMALL)
    assert SK.poll_since(feed, None).count() == 0
    last = SK.newest_id(feed)
    assert SK.poll_since(feed, last).count() == 0
    ids = [r["event_id"] for r in SK.poll_since(feed, last - 5).collect()]
    assert ids == sorted(ids) and len(ids) == 5


def test_epoch_writes_are_idempotent_and_clear(spark, scratch):
    feed = load_feed(spark, SF_SMALL).limit(30)
    w = SK.fanout_writer(scratch)
    w(feed, 0)
    w(feed, 0)  # replay of the same epoch overwrites
    w(feed, 1)
    path = os.path.join(scratch, "processed_events")
    assert spark.read.parquet(path).count() == 60
    counts = {r["table_name"]: r["n"] for r in SK.table_counts(spark, {"p": spark.read.parquet(path)}).collect()}
    assert counts == {"p": 60}
    assert SK.clear_table(spark, os.path.join(path, "epoch=0")) == 30
    assert spark.read.parquet(os.path.join(path, "epoch=0")).count() == 0


def test_a_file_of_one_row_group_is_dealt_over_tasks(spark, scratch):
    """Costly projections do not wait for the one task that reads a row group."""
    rows = [(i if i % 10 else None, i) for i in range(400)]
    spark.createDataFrame(rows, "id long, v long").coalesce(1).write.parquet(f"{scratch}/t")
    t = spark.read.parquet(f"{scratch}/t")
    out = spread_by_id(t, "id", "v", 10, rows=50)
    sizes = [n for n in out.rdd.glom().map(len).collect()]
    assert len(sizes) == 8 and max(sizes) < 200
    key = str
    assert sorted(map(tuple, out.collect()), key=key) == sorted(rows, key=key)
    assert all(len({p for p, i in found if i // 10 == run}) == 1 for found in [
        [(r["p"], r["id"]) for r in out.where("id is not null").withColumn("p", F.spark_partition_id()).collect()]] for run in range(40))
    assert spread_by_id(t, "id", "v", 10, rows=400) is t


def test_large_epochs_have_several_files(spark, scratch, monkeypatch):
    """A file is written by one task, so it has a bounded number of ids; the epochs' results do not change."""
    from tidewatch.plans import registry as R
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS ts, id % 37 AS user_id,
                        element_at(array('click', 'error', 'purchase', 'view', 'signup'), cast(id % 5 + 1 AS int)) AS event_type,
                        id * 0.5D AS value, concat('{"k":', id * 7 % 60, '}') AS props FROM range(400)""") \
        .coalesce(1).write.parquet(f"{scratch}/events.parquet")
    monkeypatch.setattr(R, "FILE_IDS", 40)
    feed = sorted(map(str, load_feed(spark, scratch).select(*R.FEED_COLS).collect()))
    assert sorted(map(str, R.QUERIES["sink_fanout"](spark, scratch).collect())) == feed
    assert len(spark.read.text(f"{R._fanout(spark, scratch)}/src").inputFiles()) >= 10
    alerts = R.QUERIES["meta_events"](spark, scratch)
    found = R.QUERIES["sink_fanout_alerts"](spark, scratch).select(*alerts.columns)
    assert found.count() and sorted(map(str, found.collect())) == sorted(map(str, alerts.collect()))
