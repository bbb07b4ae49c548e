"""A text index as a table: terms to sorted postings.

A row is (bucket, term, part, ids): the sorted ids of one part of the id space that hold the term. A part
spans ``PART`` ids, so a term of any frequency is spread over many rows and no row holds more than ``PART``
ids. Rows are written in folders by ``bucket`` (a hash of the term), sorted by term, with a Bloom filter on it: a
search reads the folders of its terms only, and there the row groups that may hold them.

Unions and intersections are made part by part on the postings: at most one row a term and part meet.
Null ids and texts without tokens have no postings; repeated ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

BUCKETS = 16
PART = 10_000


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, part: int = PART) -> DataFrame:
    """(bucket, term, part, ids) of a table of texts."""
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.explode(F.array_distinct(X.tokens(F.col(text_col)))).alias("term"))
    return (rows.groupBy("term", F.floor(F.col("id") / F.lit(part)).alias("part"))
            .agg(F.array_sort(F.collect_set("id")).alias("ids"))
            .select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "part", "ids"))


def write_index(df: DataFrame, path: str, id_col: str, text_col: str, buckets: int = BUCKETS) -> None:
    (postings(df, id_col, text_col, buckets).repartitionByRange("bucket", "term", "part").sortWithinPartitions("bucket", "term", "part")
     .write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").partitionBy("bucket").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, part long, ids array<long>, bucket int").parquet(path)


def _found(index: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """The terms' postings; bucket numbers are literals, so that only their folders are listed and read."""
    spark = index.sparkSession
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), buckets)).collect()]
    return index.where(F.col("bucket").isin(*sorted(set(numbers))) & F.col("term").isin(*terms))


def search_any(index: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Ids of the texts that hold any of the terms."""
    if not terms:
        return index.select(F.explode("ids").alias("id")).limit(0)
    parts = _found(index, terms, buckets).groupBy("part").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return parts.select(F.explode("ids").alias("id"))


def search_all(index: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Ids of the texts that hold all of the terms."""
    if not terms:
        return index.select(F.explode("ids").alias("id")).limit(0)
    parts = _found(index, terms, buckets).groupBy("part").agg(F.collect_list("ids").alias("lists"), F.count(F.lit(1)).alias("n"))
    shared = F.aggregate(F.slice("lists", 2, len(terms)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return parts.where(F.col("n") == len(set(terms))).select(F.explode(shared).alias("id"))
