"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.alignment import align_tokens
from evalweave.llm.common import scratch, table
from evalweave.llm.filter_audit import audit_documents, audit_sql
from evalweave.llm.jaccard_join import jaccard_groups
from evalweave.llm.language_id import identify
from evalweave.llm.learned_partitions import search
from evalweave.llm.licenses import licenses_sql, scan_licenses
from evalweave.llm.maxscore import top_k, top_k_sql
from evalweave.llm.minhash_forest import minhash_groups
from evalweave.llm.mixing import mix_sources, mix_sql
from evalweave.llm.pieces import digests, encode_pieces
from evalweave.llm.shards import shard_documents
from evalweave.llm.token_files import token_files
from evalweave.llm.url_lists import apply_lists, fetch_day, lists_sql, page_events

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), WORD_BPE)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, PIECE_BPE, decoded_col="decoded").select("doc_id", *digests(docs))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), scratch(spark, "sharded"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "shard", "shard_bytes", "version")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetch_day(F.col("page_id")).alias("fetch_day"))
    return apply_lists(pages, page_events(pages)).withColumn("fetch_day", F.col("fetch_day").cast("string"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"), percent=85, width=3)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_jaccard_join, op4_token_files, op5_language_id, op6_sentencepiece, op7_sharding, op8_exact_top_k, op9_learned_partitions, op10_url_lists, op11_token_alignment, op12_minhash_forest, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses_sql(), "op2_mix_sources": mix_sql(), "op8_exact_top_k": top_k_sql(), "op10_url_lists": lists_sql(), "op13_filter_audit": audit_sql()}
