"""Reading the provided Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, read in place. Column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a table that a task of a costly projection gets.
TASK_ROWS = 50_000


def spread(df: DataFrame, *by: Column, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by hash of ``by`` over tasks of about ``rows`` rows, if a task of its scan has more than twice as many.
    A file is split by row groups only, so one that is a single row group is read by one task whatever its size; what
    follows the read is not to wait for that task. The rows are counted without reading a column."""
    n, most = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return df.repartition(-(-n // rows), *by) if (most or 0) > 2 * rows else df


def spread_by_id(df: DataFrame, id_col: str, other: str, run: int, rows: int = TASK_ROWS) -> DataFrame:
    """``spread`` by runs of ``run`` consecutive ids, which stay together for map-side sums; rows without an id by ``other``."""
    return spread(df, F.expr(f"`{id_col}` div {int(run)}"), F.when(F.col(id_col).isNull(), F.col(other)), rows=rows)
