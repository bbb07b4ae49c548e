"""Access paths on the stored tables: pruning seen in the plans, the text index against the scan."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import setops as U
from tidewatch.operators import views as V
from tidewatch.plans import store as S
from tidewatch.plans import textindex as TI
from tidewatch.sources.feed import load_feed

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def by_date(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "by-date")
    S.write_by_date(U.processed_view(load_feed(spark, SF_SMALL)), path)
    return spark.read.parquet(path)


def scan(df):
    """The partition and data filters of the plan's scan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PartitionFilters"):]


def files_read(df):
    df.count()
    return len(set(r[0] for r in df.select(F.input_file_name()).distinct().collect()))


def test_layout_keeps_every_row(spark, by_date):
    feed = load_feed(spark, SF_SMALL)
    assert by_date.count() == feed.count()
    assert by_date.where("source_type is null").select("source").distinct().first()[0] == S.NO_SOURCE


def test_access_paths_read_their_folders_only(by_date):
    every = files_read(by_date)
    source = V.by_source_recent(by_date, "gdacs")
    assert "source#" in scan(source).split("DataFilters")[0] and files_read(source) <= every // 3
    span = V.time_range(by_date, "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    assert "event_date#" in scan(span).split("DataFilters")[0] and files_read(span) <= every // 5
    kept = V.retention(by_date, "7 DAYS")
    assert "event_date#" in scan(kept).split("DataFilters")[0] and files_read(kept) <= every // 2
    assert "In(event_id" in scan(V.by_ids(by_date, [3, 17]))


def test_bloom_filters_are_written(spark, by_date):
    import pyarrow.parquet as pq
    path = by_date.inputFiles()[0].removeprefix("file://")
    assert pq.ParquetFile(path).metadata.num_rows > 0
    raw = open(path, "rb").read()
    assert len(raw) > 1024  # a filter takes a kilobyte and more in each file
    plain = os.path.join(os.path.dirname(path), "..", "..", "..", "plain")
    one = spark.read.parquet(path)
    one.coalesce(1).write.mode("overwrite").parquet(plain)
    without = spark.read.parquet(plain).inputFiles()[0].removeprefix("file://")
    assert os.path.getsize(path) > os.path.getsize(without) + 1000


def test_stored_follows_its_input(spark, scratch):
    path = os.path.join(scratch, "t.parquet")

    def value():
        return S.stored(spark, scratch, "copy", lambda: spark.read.parquet(path), "t").first()[0]
    spark.range(1).write.parquet(path)
    assert value() == 0
    first = S.stored_path(spark, scratch, "copy", "t", lambda at: 1 / 0)
    spark.createDataFrame([(7,)], "id long").write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    assert value() == 7 and S.stored_path(spark, scratch, "copy", "t", lambda at: 1 / 0) != first


TEXTS = [(1, "alpha beta gamma"), (2, "beta beta delta"), (3, None), (4, ""), (None, "alpha"), (50_001, "Alpha, gamma!"), (50_001, "alpha gamma"),
         (-7, "gamma alpha beta"), (9, "the and")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    hot = [(i, "common " + ("rare" if i == 77 else "word")) for i in range(30_000, 60_000)]
    TI.write_index(spark.createDataFrame(TEXTS + hot, "id long, text string"), path, "id", "text")
    return TI.read_index(spark, path)


def ids(df):
    got = [r[0] for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_index_searches(index):
    assert ids(TI.search_any(index, ["alpha", "delta"])) == {1, 2, 50_001, -7}
    assert ids(TI.search_all(index, ["alpha", "gamma"])) == {1, 50_001, -7}
    assert ids(TI.search_all(index, ["alpha", "gamma", "beta"])) == {1, -7}
    assert ids(TI.search_all(index, ["alpha", "missing"])) == set() == ids(TI.search_any(index, ["missing"]))
    assert ids(TI.search_any(index, [])) == set() == ids(TI.search_all(index, []))
    assert ids(TI.search_all(index, ["alpha", "alpha"])) == ids(TI.search_any(index, ["alpha"]))
    assert len(ids(TI.search_all(index, ["common", "word"]))) == 30_000


def test_a_hot_term_is_many_rows_and_a_search_reads_its_buckets(index):
    rows = index.where("term = 'common'").select("part", F.size("ids").alias("n")).collect()
    assert len(rows) == 3 and all(r["n"] <= TI.PART for r in rows)
    found = TI.search_any(index, ["delta"])
    assert "bucket#" in scan(found).split("DataFilters")[0]


def test_index_equals_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    TI.write_index(docs, str(tmp_path / "i"), "doc_id", "text")
    for terms in (["the", "and"], ["thtion", "eriner"]):
        want = {r[0] for r in V.token_search(docs, "text", terms).select("doc_id").collect()}
        assert ids(TI.search_any(TI.read_index(spark, str(tmp_path / "i")), terms)) == want
