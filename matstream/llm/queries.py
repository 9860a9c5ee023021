"""Queries of the llm operators: ``opN_<name>(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matstream.llm import (bytebpe, decontam, htmlcut, langid, lexrank, mixing, neardup, ngramlm, pii, secrets, vecdup,
                           warc, whitening)
from matstream.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("text_key", "found")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents"), broadcast_bytes=ngramlm.BROADCAST_BYTES)


def captures(pages: DataFrame) -> DataFrame:
    """Three visits of every page as archive records: a full response, then two not-modified revisits.

    ETags name the page's digest; one revisit in five has another, one page in seven has none
    and one in eleven no validator at all.
    """
    visit = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("visit")
    p = pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"), visit)
    key = F.crc32(F.concat_ws("-", F.col("page_id").cast("string"), F.col("visit").cast("string")).cast("binary"))
    etag = F.when(F.col("page_id") % 7 != 0, F.concat(
        F.when(F.col("visit") > 0, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), F.col("digest"),
        F.when((F.col("visit") > 0) & (key % 5 == 0), F.lit("-new")).otherwise(F.lit("")), F.lit('"')))
    modified = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string")))
    headers = F.map_filter(F.map_from_arrays(
        F.array(F.lit("ETag"), F.lit("Last-Modified"), F.lit("Content-Type"), F.lit("Date")),
        F.array(etag, modified, F.when(F.col("visit") == 0, F.lit("text/html")).otherwise(F.lit("text/plain")),
                F.col("visit").cast("string"))), lambda _, v: v.isNotNull())
    return p.select((F.col("page_id") * 3 + F.col("visit")).alias("record_id"), "url",
                    (F.col("page_id") * 10 + F.col("visit") * 25).alias("time"),
                    F.when(F.col("visit") == 0, F.lit("response")).otherwise(F.lit("revisit")).alias("kind"),
                    headers.alias("headers"), F.when(F.col("visit") == 0, F.col("digest")).alias("payload"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    field = {"etag": "ETag", "last_modified": "Last-Modified", "content_type": "Content-Type", "date": "Date"}
    return r.select("record_id", "url", "time", "kind", "canonical", "status", "refers_to", "payload",
                    *[F.col("headers")[v].alias(k) for k, v in field.items()])


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bytebpe.decode(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.rank_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pii, op3_source_mixing, op4_html_text, op5_language_id,
                                   op6_decontamination, op7_vector_dedup, op8_lm_score, op9_warc_revisits,
                                   op10_minhash_dedup, op11_byte_bpe, op12_lexical_search,
                                   op13_embedding_whitening)}
