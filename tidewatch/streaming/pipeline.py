"""Structured Streaming jobs.

Sources: a Kafka topic in production (``kafka_events``; the connector jar is not bundled
here) or a folder of JSON files (``file_events``, used by the tests). Both give the feed
schema through ``from_json``. Every sink writes per epoch to a folder keyed by the epoch id,
so a micro-batch replayed after a failure overwrites its own output: with the checkpoint
this is effectively-once per table.
"""

from __future__ import annotations

import re
import time
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import dims
from ..operators import correlate as C
from ..plans.store import written
from ..sources.sinks import JSON_OPTIONS, fanout_writer, read_epoch, write_epoch
from .state import SEED_BATCH, seed_rows, streaming_alerts

FEED_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("source_type", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("place", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()), T.StructField("sentiment", T.StringType()),
    T.StructField("entities", T.StringType()), T.StructField("user_id", T.LongType()),
])


def file_events(spark: SparkSession, path: str, schema=FEED_SCHEMA, max_files_per_trigger: int | None = None,
                fmt: str = "json") -> DataFrame:
    """A1 (file form): JSON-lines (or Parquet) files appearing in ``path``."""
    r = spark.readStream.schema(schema).options(**JSON_OPTIONS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.format(fmt).load(path)


def kafka_events(spark: SparkSession, bootstrap: str, topic: str, schema=FEED_SCHEMA,
                 starting_offsets: str = "latest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """A1: JSON messages of a Kafka topic (starts at latest, like the original consumer).
    Needs the spark-sql-kafka connector on the classpath."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", int(max_offsets_per_trigger))
    return (r.load().select(F.from_json(F.col("value").cast("string"), schema, JSON_OPTIONS).alias("r"))
            .select("r.*"))


def _trigger(w, trigger: dict | None):
    return w.trigger(**trigger) if trigger else w


def start_processed(stream: DataFrame, out_root: str, checkpoint: str, trigger: dict | None = None,
                    transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """A4 (events side) + H1/H2: every event to processed_events/epoch=<id>."""
    def write(df: DataFrame, epoch_id: int):
        write_epoch(transform(df) if transform else df, out_root, "processed_events", epoch_id)
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def start_fanout(stream: DataFrame, out_root: str, checkpoint: str, trigger: dict | None = None,
                 threshold: int = dims.BURST_THRESHOLD, transform: Callable[[DataFrame], DataFrame] | None = None,
                 batch_size: int = 10) -> StreamingQuery:
    """A4 (both sides): every event to processed_events and the alerts to meta_events, in one ``foreachBatch`` over the
    micro-batch, which is computed once. ``transform`` (an enrichment) is applied first, and both sides see its rows.

    Arrival batches that may go on in the next epoch are kept back: an epoch folds the batches before its newest one
    and stores that one's (entity, batch) sums in burst_pending, the counters in burst_state and its position in
    burst_progress, all by epoch, so a replayed epoch starts from the same tables. Rows of a batch that an earlier
    epoch has closed are not folded but listed in late_events. ``finish_fanout`` folds what the last epoch kept back."""
    def write(df: DataFrame, epoch_id: int):
        rows = (transform(df) if transform else df).persist()
        try:
            fanout_writer(out_root, lambda d, e: _fold_epoch(d, out_root, e, threshold, batch_size))(rows, epoch_id)
        finally:
            rows.unpersist()
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def _fold_epoch(rows: DataFrame, out_root: str, epoch: int, threshold: int, batch_size: int) -> DataFrame:
    """An epoch's alerts; writes its state tables. The epoch before must have written its own."""
    spark = rows.sparkSession
    number = F.expr(f"event_id div {int(batch_size)}")
    before = read_epoch(spark, out_root, "burst_progress", epoch - 1).first() if epoch > 0 else None
    closed = before["newest"] if before else None
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(number).alias("newest"), F.min("event_id").alias("first_id"),
                    F.max("event_id").alias("last_id")).first()
    known = [b for b in (closed, seen["newest"]) if b is not None]
    newest = max(known) if known else None
    late = number < F.lit(closed) if closed is not None else F.lit(False)
    write_epoch(rows.where(late), out_root, "late_events", epoch)
    agg = C.entity_sources(rows.where(~F.coalesce(late, F.lit(False))), batch=number).drop("n_sources")
    if closed is not None:
        # only the batch kept back meets rows of both epochs; the others are summed already
        goes_on = F.col("batch") == F.lit(closed)
        both = agg.where(goes_on).unionByName(read_epoch(spark, out_root, "burst_pending", epoch - 1)).groupBy("batch", "entity").agg(
            F.sum("n_events").alias("n_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
            F.max("last_time").alias("last_time"))
        agg = agg.where(~goes_on).unionByName(both)
    agg = written(agg, "fanout-batches")
    open_ = F.col("batch") == F.lit(newest)
    write_epoch(agg.where(open_), out_root, "burst_pending", epoch)
    write_epoch(spark.createDataFrame([(newest, seen["n"], seen["first_id"], seen["last_id"])],
                                      "newest long, n_rows long, first_id long, last_id long"), out_root, "burst_progress", epoch)
    return _folded(spark, agg.where(~open_), out_root, epoch, threshold)


def _folded(spark: SparkSession, agg: DataFrame, out_root: str, epoch: int, threshold: int) -> DataFrame:
    """Alerts of closed batches after the counters of the epoch before; writes the epoch's counters."""
    agg = agg.withColumn("n_sources", F.size("sources").cast("long"))
    if epoch > 0:
        left = read_epoch(spark, out_root, "burst_state", epoch - 1)
        agg = agg.unionByName(left.where("run > 0").select(
            F.lit(SEED_BATCH).cast("long").alias("batch"), "entity", F.col("run").cast("long").alias("n_events"),
            F.array().cast("array<string>").alias("sources"), F.lit(None).cast("timestamp_ntz").alias("last_time"),
            F.lit(0).cast("long").alias("n_sources")))
    alerts = written(C.burst_alerts(agg, threshold), "fanout-alerts")
    # a counter is what its entity has had since its last alert
    last = alerts.groupBy("entity").agg(F.max("batch").alias("last"))
    run = agg.join(last, "entity", "left").where(F.col("last").isNull() | (F.col("batch") > F.col("last"))) \
             .groupBy("entity").agg(F.sum("n_events").alias("run"))
    write_epoch(run, out_root, "burst_state", epoch)
    return C.alert_rows(alerts)


def finish_fanout(spark: SparkSession, out_root: str, last_epoch: int, threshold: int = dims.BURST_THRESHOLD) -> None:
    """At the end of a stream: fold the batch that its last epoch kept back."""
    kept = read_epoch(spark, out_root, "burst_pending", last_epoch)
    write_epoch(_folded(spark, kept, out_root, last_epoch + 1, threshold), out_root, "meta_events", last_epoch + 1)


def start_alerts(stream: DataFrame, out_root: str, checkpoint: str, trigger: dict | None = None,
                 threshold: int = dims.BURST_THRESHOLD, delay: int = 0, idle: int | None = None,
                 history: str | None = None) -> StreamingQuery:
    """A4 (alerts side) + H3: stateful counter; alerts of each epoch to meta_events. ``history``: a folder of the
    counters (entity, run) that a batch fold of earlier events left, the operator's initial state."""
    seed = None
    if history is not None:
        seed = seed_rows(stream.sparkSession.readStream.schema("entity string, run long").parquet(history))
    alerts = streaming_alerts(stream, threshold, delay, idle, seed).withColumn("ingested_at", F.current_timestamp())

    def write(df: DataFrame, epoch_id: int):
        write_epoch(df, out_root, "meta_events", epoch_id)
    w = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def windowed_cross_stream(stream: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """H4: entities seen from several sources within an event-time window. The watermark
    bounds the state and closes the windows; rows of a closed window are dropped (``start_late_rows`` lists them)."""
    from .state import entity_rows
    # the watermark sees every event, also those without entities, which the filter below drops
    timed = stream.withColumn("ts", F.col("event_time").cast("timestamp")).withWatermark("ts", delay)
    agg = (entity_rows(timed, carry=("ts",))
           .groupBy(F.window("ts", window).alias("w"), "entity")
           .agg(F.count("entity").alias("n_events"), F.collect_set("source").alias("srcs")))
    return (agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "entity", "n_events",
                       F.array_sort("srcs").alias("sources"), F.size("srcs").cast("long").alias("n_sources"))
            .where((F.col("n_sources") > 1) & F.col("entity").isNotNull()))


def slot_counts(stream: DataFrame, slot_seconds: int, delay_seconds: int = 0) -> DataFrame:
    """E8/E9 as a stream: slot_start and n of every slot, empty ones too; the newest full slot's n is the throughput."""
    from ..operators.dashboard import slot_start
    from .state import slot_counts as slots
    return slots(stream, slot_seconds, delay_seconds).select(slot_start(F.col("slot"), slot_seconds).alias("slot_start"), "n")


def mood_line(stream: DataFrame, slot_seconds: int, delay_seconds: int = 0) -> DataFrame:
    """E15 as a stream: slot_start and the mood at the end of every slot."""
    from ..operators.dashboard import slot_start
    from .state import mood_line as line
    return line(stream, slot_seconds, delay_seconds).select(slot_start(F.col("slot"), slot_seconds).alias("slot_start"), "mood")


def start_late_rows(stream: DataFrame, out_root: str, checkpoint: str, trigger: dict | None = None,
                    window: str = "10 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """H4 side output: the rows that ``windowed_cross_stream`` drops when it reads the same files in the same epochs.
    Spark admits an epoch's rows by the watermark of the epoch before, which knows the epochs before that one: a row is
    late if its window ended at or before their newest event time less ``delay``. That time is stored by epoch. Rows
    and their number an epoch go to late_rows and late_counts."""
    def write(df: DataFrame, epoch_id: int):
        spark = df.sparkSession
        df = df.persist()
        try:
            newest, before = [read_epoch(spark, out_root, "event_marks", e).first()["mark"] if e >= 0 else None
                              for e in (epoch_id - 1, epoch_id - 2)]
            here = df.agg(F.max("event_time").alias("mark")).first()["mark"]
            marks = [m for m in (newest, here) if m is not None]
            late = df.limit(0)
            if before is not None:
                end = F.window(F.col("event_time").cast("timestamp"), window)["end"]
                late = df.withColumn("__end", end).where(
                    F.col("__end") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")).drop("__end")
            write_epoch(late, out_root, "late_rows", epoch_id)
            n = read_epoch(spark, out_root, "late_rows", epoch_id).count()
            write_epoch(spark.createDataFrame([(epoch_id, n)], "epoch_id long, n_late long"), out_root, "late_counts", epoch_id)
            write_epoch(spark.createDataFrame([(max(marks) if marks else None,)], "mark timestamp_ntz"), out_root, "event_marks", epoch_id)
        finally:
            df.unpersist()
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def tail_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A5: live tail of an append-only Parquet table (new files only)."""
    return spark.readStream.schema(schema).parquet(path)


def hand_over(history: DataFrame, out_root: str, key: str = "event_id") -> int | None:
    """I3, first half: the history goes to the view once, and the position where it ends (its largest key) is recorded
    beside it. A second call finds the record and writes nothing."""
    spark = history.sparkSession
    try:
        return read_epoch(spark, out_root, "handover", 0).first()["position"]
    except AnalysisException:
        pass
    write_epoch(history, out_root, "history", 0)
    position = read_epoch(spark, out_root, "history", 0).agg(F.max(key)).first()[0]
    write_epoch(spark.createDataFrame([(position,)], "position long"), out_root, "handover", 0)
    return position


def live_after(live: DataFrame, position: int | None, key: str = "event_id", time_col: str = "event_time",
               delay: str = "10 minutes") -> DataFrame:
    """I3, second half: the live stream from the recorded position on. Overlap with the history is cut by position and
    needs no state; an event that the live side itself delivers twice within ``delay`` is emitted once, and the
    watermark lets go of older keys (the original showed overlaps twice and lost what came in between)."""
    new = live if position is None else live.where(F.col(key) > F.lit(position))
    return (new.withColumn("__ts", F.col(time_col).cast("timestamp")).withWatermark("__ts", delay)
            .dropDuplicatesWithinWatermark([key]).drop("__ts"))


PROGRESS_SCHEMA = ("query string, epoch long, n_rows long, rows_per_second double, state_rows long, late_rows long, "
                   "sources array<struct<source:string,start_offset:string,end_offset:string>>")


class ProgressTable(StreamingQueryListener):
    """Every micro-batch's rows, rate, state size and offset ranges as rows of a table. Rows are kept until there
    are ``every``, so the driver holds a bounded number; ``flush`` writes the rest."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every, self.rows = spark, path, every, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0),
                          sum(o.numRowsTotal for o in p.stateOperators), sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
                          [(x.description, str(x.startOffset), str(x.endOffset)) for x in p.sources]))
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def recorded(spark: SparkSession, path: str, run: Callable[[], StreamingQuery]) -> DataFrame:
    """Run a query to its end with a progress table at ``path``; the table. The last progress reports arrive
    after the query's end, on the listeners' thread: the run waits for the last one."""
    log = ProgressTable(spark, path)
    spark.streams.addListener(log)
    try:
        query = run()
        run_available_now(query)
        last = query.lastProgress
        for _ in range(200):
            if last is None or any(r[0] == str(query.id) and r[1] >= last["batchId"] for r in list(log.rows)):
                break
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(log)
    log.flush()
    return spark.read.schema(PROGRESS_SCHEMA).parquet(path)


def stamp_files(spark: SparkSession, path: str, order: Callable[[str], int]) -> None:
    """Give the files under ``path`` modification times in ``order`` (of their path below it), a second apart: a file
    stream reads them in that order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = fs.listFiles(fs_path, True), []
    while found.hasNext():
        name = found.next().getPath()
        if not name.getName().startswith(("_", ".")):
            files.append((order(name.toString()), name.toString(), name))
    start = int(time.time()) - len(files) - 10
    for i, (_, _, name) in enumerate(sorted(files, key=lambda f: f[:2])):
        fs.setTimes(name, (start + i) * 1000, -1)


#: File number of a heartbeat.
LAST_CHUNK = 2_000_000_000


def write_feed_files(feed: DataFrame, path: str, rows_per_file: int | None = None, file_bytes: int = 32_000_000,
                     chunk: Column | None = None, dealt: bool = False) -> None:
    """Lay a batch feed out as JSON-lines files (gzip), the shape a file-stream source consumes, in the order of the events. A
    file holds the events of ``rows_per_file`` consecutive ids, or as many as make about ``file_bytes`` (from the rows'
    mean length); ``chunk`` gives each row's file number instead. ``dealt``: a file's rows lie in one task already."""
    spark = feed.sparkSession
    lines = feed.select("event_id", F.to_json(F.struct(*feed.columns), JSON_OPTIONS).alias("value"),
                        *([] if chunk is None else [chunk.alias("chunk")]))
    if chunk is None:
        if rows_per_file is None:
            mean = lines.agg(F.avg(F.length("value") + 1)).first()[0]
            rows_per_file = max(1, int(file_bytes / (mean or file_bytes)))
        lines = lines.withColumn("chunk", F.expr(f"event_id div {int(rows_per_file)}"))
    lines = lines.select("chunk", "value")
    (lines if dealt else lines.repartition("chunk")).write.mode("overwrite").partitionBy("chunk").text(path, compression="gzip")
    stamp_files(spark, path, lambda name: int(re.search(r"chunk=(-?\d+)", name).group(1)) if re.search(r"chunk=-?\d", name) else -1)


def write_heartbeat(spark: SparkSession, path: str, event_id: int, event_time: str = "9999-01-01 00:00:00") -> None:
    """A file with one event without entities, after those of ``write_feed_files``: it closes the batches and windows before it."""
    row = spark.createDataFrame([(event_id,)], "event_id long").select(
        "event_id", F.lit(event_time).cast("timestamp_ntz").alias("event_time"))
    row.select(F.to_json(F.struct("event_id", "event_time"), JSON_OPTIONS).alias("value")).coalesce(1).write.mode("append").text(f"{path}/chunk={LAST_CHUNK}")


def run_available_now(query: StreamingQuery, timeout_s: int = 3600) -> None:
    """Wait for an ``availableNow`` query and surface its failure, if any."""
    query.awaitTermination(timeout_s)
    err = query.exception()
    if err is not None:
        raise RuntimeError(f"streaming query failed: {err}")


def parquet_sink(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only Parquet sink (exactly-once through the sink's commit log)."""
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
