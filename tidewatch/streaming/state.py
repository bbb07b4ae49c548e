"""Keyed counter with reset (H3/E3-E5) as a stateful streaming operator with event-time timers.

Arrival batches are numbered (``event_id div 10``), and that number, as a time, is the event time of
the stream: ``BATCH_SECONDS`` a batch. Three steps:

1. Each task combines its rows to one row an (entity, batch): events, sources, last time. A hot
   entity sends a row a batch and task, whatever its number of events.
2. ``applyInPandasWithState`` keyed by entity keeps the running count and the batches that the
   watermark has not closed yet. A timer fires when the watermark passes the earliest of them; closed
   batches are folded in order. So the size and the order of files make no difference as long as a row
   is at most ``delay`` batches late; later rows are dropped by the watermark and counted by Spark.
3. An entity without open batches that is idle for ``idle`` batches loses its state (None: never, as the
   original kept its counters for ever).

Counters of a history enter as rows of batch -1 (``seed_rows``). The last batches of a stream close
when the watermark passes them: any later event does it, or a ``heartbeat`` (an event without entities).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import dims
from ..operators.correlate import alert_rows

ALERT_SCHEMA = ("entity string, batch long, score long, n_sources long, sources array<string>, "
                "is_cross boolean, is_burst boolean, last_time timestamp_ntz")
#: run: count since the last alert; last: newest batch seen; pending: open batches as JSON
#: (batch -> events, sources, last time in microseconds).
STATE_SCHEMA = "run long, last long, pending string"
COMBINED_SCHEMA = "entity string, batch long, n long, sources array<string>, last_time timestamp_ntz"
BATCH_SECONDS = 1
SEED_BATCH = -1


def batch_time(batch: Column) -> Column:
    """A batch's event time (the seed's batch is at second 1)."""
    return F.timestamp_seconds((batch + F.lit(1 - SEED_BATCH)) * BATCH_SECONDS)


def _batch_ms(batch: int) -> int:
    return (batch + 1 - SEED_BATCH) * BATCH_SECONDS * 1000


def entity_rows(stream: DataFrame, batch_col: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(entity, source, batch, event_time, n) rows: each entity once per event. Events without entities give
    a row with a null entity, which only moves the watermark. ``carry``: further columns."""
    ents = F.from_json(F.col("entities"), "map<string,array<string>>")
    vals = F.transform(F.map_values(ents), lambda v: F.coalesce(v, F.array().cast("array<string>")))
    batch = batch_col if batch_col is not None else F.expr("event_id div 10")
    return stream.select(F.explode_outer(F.array_distinct(F.flatten(vals))).alias("entity"),
                         F.coalesce(F.col("source_type"), F.lit("unknown")).alias("source"),
                         batch.alias("batch"), F.col("event_time").cast("timestamp_ntz").alias("event_time"),
                         F.lit(1).cast("long").alias("n"), *carry).where(F.col("batch").isNotNull())


def seed_rows(counters: DataFrame) -> DataFrame:
    """(entity, run) of a history, as rows of the batch before the first."""
    return counters.where("run > 0").select(
        "entity", F.lit(None).cast("string").alias("source"), F.lit(SEED_BATCH).cast("long").alias("batch"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"), F.col("run").cast("long").alias("n"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an (entity, batch) of an Arrow batch; null entities keep their newest batch only."""
    kind = pa.schema([("entity", pa.string()), ("batch", pa.int64()), ("n", pa.int64()), ("sources", pa.list_(pa.string())),
                      ("last_time", pa.timestamp("us"))])
    for b in batches:
        t = pa.Table.from_batches([b])
        named = t.filter(pc.is_valid(t["entity"]))
        g = named.group_by(["entity", "batch"]).aggregate([("n", "sum"), ("source", "distinct"), ("event_time", "max")])
        out = pa.table([g["entity"].cast(pa.string()), g["batch"], g["n_sum"], g["source_distinct"].cast(kind[3].type),
                        g["event_time_max"].cast(pa.timestamp("us"))], schema=kind)
        beat = pc.max(t.filter(pc.is_null(t["entity"]))["batch"])
        if beat.is_valid:
            out = pa.concat_tables([out, pa.Table.from_pylist([{"entity": None, "batch": beat.as_py(), "n": 0, "sources": []}], schema=kind)])
        yield from out.to_batches()


def combined(rows: DataFrame) -> DataFrame:
    """Step 1 on a batch or streaming frame of ``entity_rows``."""
    return rows.mapInArrow(_combine, COMBINED_SCHEMA)


def counter_fn(threshold: int = dims.BURST_THRESHOLD, idle: int | None = None):
    """The keyed step: merge rows into the open batches, fold those that the watermark has closed."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        (entity,) = key
        if entity is None:
            return
        run, last, pending = 0, SEED_BATCH, {}
        if state.exists:
            run, last, text = state.get
            pending = {int(b): v for b, v in json.loads(text).items()}
        if not state.hasTimedOut:
            for pdf in pdfs:
                times = pdf["last_time"].astype("datetime64[us]")
                for b, n, sources, at, no_time in zip(pdf["batch"], pdf["n"], pdf["sources"], times.astype("int64"), times.isna()):
                    had = pending.get(int(b), [0, [], None])
                    at = None if no_time else int(at)
                    pending[int(b)] = [had[0] + int(n), sorted({*had[1], *(s for s in sources if s is not None)}),
                                       at if had[2] is None else had[2] if at is None else max(at, had[2])]
                    last = max(last, int(b))
        mark = state.getCurrentWatermarkMs()
        alerts = []
        for b in sorted(b for b in pending if _batch_ms(b) <= mark):
            n, sources, at = pending.pop(b)
            run += n
            if len(sources) > 1 or run > threshold:
                alerts.append((entity, b, run, len(sources), sources, len(sources) > 1, run > threshold, at))
                run = 0
        if pending:
            state.update((run, last, json.dumps(pending)))
            state.setTimeoutTimestamp(_batch_ms(min(pending)) - 1)
        elif idle is not None and _batch_ms(last + idle) <= mark or run == 0:
            state.remove()
        else:
            state.update((run, last, "{}"))
            if idle is not None:
                state.setTimeoutTimestamp(_batch_ms(last + idle) - 1)
        if alerts:
            out = pd.DataFrame(alerts, columns=["entity", "batch", "score", "n_sources", "sources", "is_cross", "is_burst", "last_time"])
            out["last_time"] = pd.to_datetime(out["last_time"], unit="us")
            yield out
    return fn


def streaming_alerts(stream: DataFrame, threshold: int = dims.BURST_THRESHOLD, delay: int = 0, idle: int | None = None,
                     seed: DataFrame | None = None) -> DataFrame:
    """Streaming feed -> alert rows (same columns as the batch ``meta_events``). ``delay``: batches that a row may
    be late; ``seed``: a stream of ``seed_rows``."""
    rows = entity_rows(stream)
    rows = rows if seed is None else rows.unionByName(seed)
    keyed = combined(rows).withColumn("btime", batch_time(F.col("batch"))).withWatermark("btime", f"{delay * BATCH_SECONDS} seconds")
    out = keyed.groupBy("entity").applyInPandasWithState(
        counter_fn(threshold, idle), ALERT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return alert_rows(out)


SLOT_STATE = "next long, pending string"
SLOT_SCHEMA = "slot long, n long"


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g = pa.Table.from_batches([b]).group_by(["slot"]).aggregate([("n", "sum")])
        yield from pa.table([pa.array([0] * len(g), pa.int32()), g["slot"], g["n_sum"]], ["k", "slot", "n"]).to_batches()


def slot_fn(slot_ms: int):
    """Counts of open slots, emitted in order with the empty slots between them when the watermark passes their end."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        following, pending = None, {}
        if state.exists:
            following, text = state.get
            pending = {int(s): n for s, n in json.loads(text).items()}
        if not state.hasTimedOut:
            for pdf in pdfs:
                for s, n in zip(pdf["slot"], pdf["n"]):
                    if following is None or s >= following:
                        pending[int(s)] = pending.get(int(s), 0) + int(n)
        mark = state.getCurrentWatermarkMs()
        closed = [s for s in pending if (s + 1) * slot_ms <= mark]
        out = []
        if closed or following is not None:
            end = max(mark // slot_ms, following or 0)
            begin = following if following is not None else min(closed)
            out = [(s, pending.pop(s, 0)) for s in range(begin, end)]
            following = end
        state.update((following, json.dumps(pending)))
        if pending:
            state.setTimeoutTimestamp((min(pending) + 1) * slot_ms - 1)
        if out:
            yield pd.DataFrame(out, columns=["slot", "n"])
    return fn


def slot_counts(stream: DataFrame, slot_seconds: int, delay_seconds: int, time_col: str = "event_time") -> DataFrame:
    """E8 as a stream: (slot, n) of every slot from the first on. Tasks send one row a slot to the one key, so what it
    gets is bounded by slots, not by events. A row's time is its slot's end and the watermark a slot later than the
    delay: a slot closes when a row comes that begins ``delay_seconds`` after its end, and rows after that are dropped."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    rows = stream.where(F.col(time_col).isNotNull()).select(F.floor(micros / (slot_seconds * 1_000_000)).cast("long").alias("slot"),
                                                            F.lit(1).cast("long").alias("n"))
    counted = rows.mapInArrow(_count_slots, "k int, slot long, n long").withColumn(
        "ts", F.timestamp_seconds((F.col("slot") + 1) * slot_seconds)).withWatermark("ts", f"{slot_seconds + delay_seconds} seconds")
    return counted.groupBy("k").applyInPandasWithState(slot_fn(slot_seconds * 1000), SLOT_SCHEMA, SLOT_STATE, "append",
                                                       GroupStateTimeout.EventTimeTimeout)


# ---- E15, the mood line -----------------------------------------------------------------

MOOD_STATE = "next long, mood long, pending string"
MOOD_SCHEMA = "slot long, mood long"
#: Consecutive events of a slot that a task sends as one row: a step each, or, if it has them all, their composition.
BLOCK = 64
NO_EVENT, UNKNOWN, STEPS = ".", "x", {"positive": "+", "negative": "-", "neutral": "0"}
_DELTA = {"+": 1, "-": -1, "0": 0}


def clamp_triple(cells: str, limit: int = dims.MOOD_CLAMP) -> list[int] | None:
    """Steps in order as x -> min(hi, max(lo, x + a)); None if no step does anything."""
    out = None
    for c in cells:
        if c in _DELTA:
            d = _DELTA[c]
            out = [d, -limit, limit] if out is None else [out[0] + d, *(min(limit, max(-limit, x + d)) for x in out[1:])]
    return out


def _mood_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        slot, seq = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        step = np.frombuffer("".join(b.column(2).to_pylist()).encode(), np.uint8)
        pairs, row = np.unique(np.stack([slot, seq // BLOCK]), axis=1, return_inverse=True)
        cells = np.full((pairs.shape[1], BLOCK), ord(NO_EVENT), np.uint8)
        cells[row.ravel(), seq % BLOCK] = step
        yield pa.record_batch([pa.array(np.zeros(pairs.shape[1], np.int32)), pa.array(pairs[0]), pa.array(pairs[1]),
                               pa.array([r.tobytes().decode() for r in cells])], ["k", "slot", "block", "cells"])


def mood_fn(slot_ms: int, limit: int = dims.MOOD_CLAMP):
    """The line's value at the end of each slot, in order, empty slots too, when the watermark passes the slot. Open slots
    keep their blocks of steps; a block whose events have all come is kept as its composition, so events that come late
    within the delay take their place in the order."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        following, mood, pending = None, 0, {}
        if state.exists:
            following, mood, text = state.get
            pending = {int(s): {int(b): v for b, v in blocks.items()} for s, blocks in json.loads(text).items()}
        if not state.hasTimedOut:
            for pdf in pdfs:
                for s, b, cells in zip(pdf["slot"], pdf["block"], pdf["cells"]):
                    if following is not None and s < following:
                        continue
                    blocks = pending.setdefault(int(s), {})
                    had = blocks.get(int(b))
                    if isinstance(had, list):
                        continue  # a repeat of events that are all there
                    if had is not None:
                        cells = "".join(x if x != NO_EVENT else y for x, y in zip(had, cells))
                    blocks[int(b)] = cells if NO_EVENT in cells else clamp_triple(cells, limit) or []
        mark = state.getCurrentWatermarkMs()
        closed = [s for s in pending if (s + 1) * slot_ms <= mark]
        out = []
        if closed or following is not None:
            end = max(mark // slot_ms, following or 0)
            for s in range(following if following is not None else min(closed), end):
                for _, v in sorted(pending.pop(s, {}).items()):
                    f = clamp_triple(v, limit) if isinstance(v, str) else v
                    if f:
                        mood = min(f[2], max(f[1], mood + f[0]))
                out.append((s, mood))
            following = end
        state.update((following, mood, json.dumps(pending)))
        if pending:
            state.setTimeoutTimestamp((min(pending) + 1) * slot_ms - 1)
        if out:
            yield pd.DataFrame(out, columns=["slot", "mood"])
    return fn


def mood_line(stream: DataFrame, slot_seconds: int, delay_seconds: int, order: str = "event_id", time_col: str = "event_time") -> DataFrame:
    """E15 as a stream: (slot, mood) of every slot from the first on; within a slot events count in ``order``, whatever
    the order of their arrival. Tasks send a row a slot and ``BLOCK`` events to the one key."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    label = F.lower(F.coalesce(F.nullif(F.col("sentiment"), F.lit("")), F.lit("neutral")))
    step = F.lit(UNKNOWN)
    for name, c in STEPS.items():
        step = F.when(label == name, F.lit(c)).otherwise(step)
    rows = stream.where(F.col(time_col).isNotNull() & F.col(order).isNotNull()).select(
        F.floor(micros / (slot_seconds * 1_000_000)).cast("long").alias("slot"), F.col(order).cast("long").alias("seq"), step.alias("step"))
    blocks = rows.mapInArrow(_mood_blocks, "k int, slot long, block long, cells string").withColumn(
        "ts", F.timestamp_seconds((F.col("slot") + 1) * slot_seconds)).withWatermark("ts", f"{slot_seconds + delay_seconds} seconds")
    return blocks.groupBy("k").applyInPandasWithState(mood_fn(slot_seconds * 1000), MOOD_SCHEMA, MOOD_STATE, "append",
                                                      GroupStateTimeout.EventTimeTimeout)
