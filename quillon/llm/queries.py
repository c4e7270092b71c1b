"""The queries op1 to op10 over the driver's tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bm25_wand, cube_mix, fingerprints, jaccard_join, lang_id, license_scan, packing, quality, token_store, warc
from quillon.session import ship


#: The vocabulary that op9 uses, on the driver alone.
TOKENIZER = os.environ.get("QUILLON_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(table(spark, sf_dir, "documents"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_wand.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_normalise_pages(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), token_store.read_vocabulary(TOKENIZER))


def op10_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_runs(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bm25_topk, op3_jaccard_join, op4_quality, op5_cube_mix, op6_fingerprints, op7_warc_normalise, op8_packing, op9_token_store, op10_license_scan, op10_license_runs)}
ORACLE_SQL = {"op2_bm25_topk": bm25_wand.SQL, "op3_jaccard_join": jaccard_join.SQL, "op4_quality": quality.SQL, "op10_license_scan": license_scan.SQL}
