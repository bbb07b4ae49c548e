"""Registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bestfit, bpe, hnsw, kdshard, langid, lexical, minhash, packing, quality, toxicity, urlgraph, warczip
from .common import held_out, read_table

SHARDS = 8


def tokenizer_path(name: str) -> str:
    """Folder of the public vocabularies: TIDEWATCH_TOKENIZERS, or that of the installed package."""
    folder = os.environ.get("TIDEWATCH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    return langid.languages_of(docs, model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "languages", "shares")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Fitted on the labelled rows that are not held out (crc32 of the id mod 5 is not 0)."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    return toxicity.fit_toxicity(toxicity.labelled_sample(docs, labels, toxicity.SAMPLE_ROWS))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.toxicity_scores(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hnsw.usable(read_table(spark, sf_dir, "embeddings"))
    return hnsw.search(hnsw.build_index(vectors), vectors.filter("id % 100 = 0"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = kdshard.kd_shards(kdshard.document_items(read_table(spark, sf_dir, "documents")), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warczip.write_archives(read_table(spark, sf_dir, "pages"))
    return warczip.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_fit_sequences(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = align.align_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                    tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_bpe, op3_quality, op4_language, op5_toxicity, op6_urls, op7_neighbours, op8_packing,
    op9_shards, op10_archives, op11_best_fit, op12_alignment, op13_ranked)}

ORACLE_SQL = {
    "op10_archives": """
with p as (
  select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
q as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from q""",
    "op13_ranked": r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
b as (
  select row_number() over () as q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null),
t as (select count(*) as n, sum(len(terms))::bigint as l from d where len(terms) > 0),
tf as (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from d)
  group by r, doc_id, n, term),
w as (
  select term, floor(1000 * ln((2 * t.n + 2) / (2 * count(*) + 1)))::bigint as w from tf, t
  where term in (select term from b) group by term, t.n),
s as (
  select q, item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * t.n) // t.l))))::bigint as score
  from b join w using (term) join tf using (term), t group by q, item_id, r, doc_id)
select item_id, rank::integer as rank, doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0)
where rank <= 20""",
}
