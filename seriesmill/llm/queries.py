"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, url_filters, vector_codes
from .common import fresh_path, read


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95).withColumnRenamed("id", "vec_id")


#: Rules of op2: host, path and action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(read(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .wavelet import document_digests, read_token_shards, write_token_shards

    path = fresh_path(spark, "token-shards")
    write_token_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return document_digests(read_token_shards(spark, path))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import describe, find_secrets

    return describe(find_secrets(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract_pages, fit

    pages = read(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages)).withColumnRenamed("id", "page_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digests

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .languages import fit, predict

    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs, public_tokenizers.path("piece_bpe_32k.model"))).withColumnRenamed("id", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import described, encode_vectors

    return described(*encode_vectors(read(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label_column=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_token_shards": op3_token_shards,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_language_id": op11_language_id,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Cosines of all pairs; equal to op1's links as far as hashing finds them, which it does for all but pairs close to the threshold.
EMBEDDING_LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95 AND NOT isnan(list_cosine_similarity(a.e, b.e))),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a JOIN c ON v.vec_id = c.a
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": EMBEDDING_LINKS_SQL,
    "op2_url_filters": url_filters.ORACLE_SQL,
    "op7_decontamination": decontaminate.ORACLE_SQL,
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
