"""Model slots with a factory (U1, U2), beside the default column forms."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import models as M
from tidewatch.operators import enrich as EN

TEXTS = [(1, "good news " + "x" * 600 + " END"), (2, None), (3, "  \u3000 "), (4, "bad news"), (5, "")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").repartition(1)


def marked(folder, make):
    """A factory that leaves a file at each call, so that loads can be counted."""
    def factory():
        open(os.path.join(folder, f"load-{os.getpid()}-{len(os.listdir(folder))}"), "w").close()
        return make()
    return factory


def test_sentiment_slot_loads_once_and_sees_whole_texts(spark, texts, scratch):
    def make():
        return lambda batch: ["POSITIVE" if t.endswith("END") else "NEGATIVE" for t in batch]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = dict(texts.select("id", M.model_sentiment(F.col("text"), marked(scratch, make), "whole")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: "POSITIVE", 2: "NEUTRAL", 3: "NEUTRAL", 4: "NEGATIVE", 5: "NEUTRAL"}
    assert len(os.listdir(scratch)) == 1  # five Arrow batches, one load
    cut = dict(texts.select("id", M.model_sentiment(F.col("text"), make, "cut", max_chars=512)).collect())
    assert cut[1] == "NEGATIVE"


def test_embedding_slot(texts):
    def make():
        return lambda batch: [np.array([len(t), 1.0]) for t in batch]
    got = dict(texts.select("id", M.embed(F.col("text"), factory=make, name="lengths")).collect())
    assert got[4] == [8.0, 1.0] and got[2] == got[3] == got[5] == []


def test_tagger_slot_gets_whole_batches(texts, scratch):
    def make():
        def tag(batch):
            open(os.path.join(scratch, f"call-{len(batch)}"), "w").close()
            return [{"ORG": [t[:4]], "MISC": ["dropped"]} for t in batch]
        return tag
    got = {i: json.loads(j) for i, j in texts.select("id", M.model_entities_json(F.col("text"), make, "tags")).collect()}
    assert got == {1: {"ORG": ["good"]}, 2: {}, 3: {}, 4: {"ORG": ["bad "]}, 5: {}}
    assert os.listdir(scratch) == ["call-2"]


def test_whole_enrichment_with_models(spark):
    df = spark.createDataFrame([(1, "news from Tokyo", None, None), (2, "", 1.0, 2.0)], "id long, _raw_text string, lat double, lng double")
    out = EN.enrich_batch(df, sentiment_factory=lambda: lambda b: ["POSITIVE"] * len(b),
                          embed_factory=lambda: lambda b: [[0.5]] * len(b),
                          ner_factory=lambda: lambda b: [{"GPE": ["Tokyo"]}] * len(b), ingest_time=F.lit(None).cast("timestamp"))
    got = {r["id"]: r for r in out.collect()}
    assert "_raw_text" not in out.columns
    assert (got[1]["sentiment"], got[1]["embeddings"], got[1]["lat"]) == ("POSITIVE", [0.5], 35.6762)
    assert (got[2]["sentiment"], got[2]["entities"], got[2]["lat"]) == ("NEUTRAL", "{}", 1.0)


def test_default_vectors_are_the_tokens_counts():
    got = M.hashed_vectors([[1, 1, 3], [], None, [0]], 4)
    assert np.allclose(got, np.array([[0, 2, 0, 1], [0] * 4, [0] * 4, [1, 0, 0, 0]]) / np.array([[5 ** 0.5], [1], [1], [1]]))
