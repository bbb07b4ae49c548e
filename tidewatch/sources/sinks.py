"""Sinks and table utilities.

Writes are idempotent: a micro-batch writes to a folder keyed by its epoch id, so a
replayed epoch after a failure overwrites its own output instead of appending twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Timestamps keep microseconds on the wire (the JSON default stops at milliseconds).
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_json_lines(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A2: one JSON document per row in ``value`` (the topic message body)."""
    cols = [c for c in df.columns if c not in exclude]
    return df.select(F.to_json(F.struct(*cols), JSON_OPTIONS).alias("value"))


def from_json_lines(lines: DataFrame, schema, value_col: str = "value") -> DataFrame:
    """A1 decode: JSON text -> typed columns (missing keys -> NULL)."""
    return lines.select(F.from_json(F.col(value_col), schema, JSON_OPTIONS).alias("r")).select("r.*")


def write_json_topic(df: DataFrame, path: str, mode: str = "append") -> None:
    """A2 file form: JSON lines (the Kafka sink is ``write.format('kafka')`` on ``value``)."""
    to_json_lines(df).write.mode(mode).text(path)


def write_epoch(df: DataFrame, root: str, table: str, epoch_id: int) -> str:
    """Idempotent per-epoch write: <root>/<table>/epoch=<id> is overwritten on replay."""
    out = os.path.join(root, table, f"epoch={int(epoch_id)}")
    df.write.mode("overwrite").parquet(out)
    return out


def read_epoch(spark: SparkSession, root: str, table: str, epoch_id: int) -> DataFrame:
    """One epoch's rows; an error if that epoch has not been written."""
    return spark.read.parquet(os.path.join(root, table, f"epoch={int(epoch_id)}"))


def fanout_writer(root: str, alerts_fn=None):
    """A4: ``foreachBatch`` function writing every event to processed_events and alerts,
    if any, to meta_events, both keyed by epoch."""
    def _write(batch_df: DataFrame, epoch_id: int):
        write_epoch(batch_df, root, "processed_events", epoch_id)
        if alerts_fn is not None:
            alerts = alerts_fn(batch_df, epoch_id)
            if alerts is not None:
                write_epoch(alerts, root, "meta_events", epoch_id)
    return _write


def poll_since(df: DataFrame, last_seen: int | None, id_col: str = "event_id") -> DataFrame:
    """Rows with id > last_seen in ascending id order. The first poll (no last id)
    only records the newest id and emits nothing."""
    if last_seen is None:
        return df.limit(0)
    return df.where(F.col(id_col) > F.lit(last_seen)).orderBy(id_col)


def newest_id(df: DataFrame, id_col: str = "event_id"):
    return df.agg(F.max(id_col)).first()[0]


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A7 count step: one row per named table."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def clear_table(spark: SparkSession, path: str) -> int:
    """A7 empty step on one of our own tables: count, then overwrite with an empty frame of
    the same schema. Returns the count before clearing."""
    df = spark.read.parquet(path)
    n = df.count()
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return n
