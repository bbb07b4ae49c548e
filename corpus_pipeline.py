"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, works on all
rows that its predecessor kept and is written as Parquet before the next one reads it. All stages but
the last return the columns of ``documents``; the last returns one row a piece of a packed sequence.
Null texts are not toxic; they, and texts of fewer than 50 words, fail the quality rules. Empty input
gives empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import minhash, packing, quality, toxicity
from tidewatch.llm.common import read_table, stored
from tidewatch.llm.queries import tokenizer_path, toxicity_model

#: Not expressible in SQL: fitted models, sampling and a linear program.
ORACLE_SQL = None
#: Rows of an Arrow batch while texts go to a Python worker: whole rows wait beside it, and their number bounds
#: what an executor holds. Set for the session, since a stage runs only when its result is written.
ARROW_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    model = toxicity_model(spark, docs, sf_dir)
    return docs.filter(F.coalesce(toxicity.score_column(model, F.col("text")), F.lit(0.0)) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
