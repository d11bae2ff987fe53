"""Queries of the corpus operators on the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, sharding, suffix_dedup, topk, warc
from .common import read
from .decontamination import decontaminate
from .pieces import tokenize
from .quality import quality
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .topk import top_k
from .toxicity import toxicity
from .warc import archive_and_read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10).drop("spans")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents"), dropout=0.1, seed=0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=16)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read(spark, sf_dir, "pages"), least=100)


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS win FROM d WHERE len(w) >= 13),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_transform(list_filter(range(1, len(w) + 1), lambda p: g.ps IS NULL OR NOT list_contains(g.ps, p)), lambda p: w[p]) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_decontamination, op3_simhash_dedup, op4_quality_classifier, op5_topk_search, op6_substring_dedup, op7_toxicity, op8_sentencepiece, op9_sharding, op10_warc)}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": suffix_dedup.SQL, "op2_decontamination": decontamination.SQL, "op5_topk_search": topk.SQL, "op6_substring_dedup": SUBSTRING_SQL, "op9_sharding": sharding.SQL, "op10_warc": warc.SQL,
}
