"""Helpers shared by the operators of this subpackage: shared-folder tables and key columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir`` (any URI that Spark's writers accept)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet (``options``: of the writer) in the shared folder and read it back: lineage is cut
    there, and a lost executor costs a re-read of files only."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, buckets: int, which: int) -> Column:
    """crc32 of the id as text, mod ``buckets``, equals ``which``; null ids are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(buckets)) == which,
                      F.lit(False))


def positions(df: DataFrame, part: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds ``_before`` (sum of ``weight``) and ``_rank`` (rows) before each row of its ``part`` in
    ``order``, which must be unique within it.

    A range exchange deals the rows evenly whatever the size of a part; each range is summed, the
    sums are accumulated (one row a range and part, so their number is bounded by the number of
    partitions and parts) and added to the running sums inside the ranges.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(n, part, *order).withColumn("_pid", F.spark_partition_id()), name)
    sums = dealt.groupBy(part, "_pid").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, "_pid", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    within = Window.partitionBy("_pid", part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_w1", F.coalesce(F.sum(weight).over(within), F.lit(0)))
            .withColumn("_n1", F.count(F.lit(1)).over(within))
            .join(F.broadcast(starts), [part, "_pid"])
            .withColumn("_before", F.col("_w0") + F.col("_w1")).withColumn("_rank", F.col("_n0") + F.col("_n1"))
            .drop("_w0", "_w1", "_n0", "_n1", "_pid"))
