"""The corpus pipeline: language, quality, near duplicates, mixing, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import cube_mix, jaccard_join, lang_id, packing, quality
from quillon.llm.common import write_table
from quillon.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go.

    Row by row, by the whole text: null and empty texts and texts without letters go, rows with a null id or language
    are judged like others, repeated rows alike; a margin that just reaches the least one is enough. All columns stay.
    """
    ship(spark)
    return lang_id.keep(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good, by their text, path and host, go.

    Row by row, by the whole text; even odds stay. Null and empty texts are judged by their site and as texts of that
    kind; a null source or language is an empty name, a null id has no label. Repeated rows are judged alike.
    """
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (transitively) the document with the least id stays.

    Null and empty texts and texts without words are no copies of anything and stay, as do rows with a null id. Rows
    that repeat an id are one document: all of them stay or go. Texts of any length are compared whole.
    """
    ship(spark)
    return jaccard_join.keep(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, sources in proportion to the square root of theirs.

    Rows of one id and source are one document and go together. Rows with a null id go, since nothing could draw them
    again; a null source is a source like others; null and empty texts, of 0 tokens, are drawn with their source's rate.
    """
    ship(spark)
    return cube_mix.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 tokens: one row a piece of a document.

    Longer texts are cut into pieces, no token is lost; texts without tokens are in no bin; each repeated row and each
    row with a null id is packed by itself.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing_stage)]

#: Training, the cube method and the linear program have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
