"""From documents to packed training bins: toxicity, line dedup, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of ``documents`` (the last one
the placements of its bins). ``n_chars`` follows the text where a stage changes it.

All stages: extra columns are dropped, whatever their names; an empty table gives an empty result; texts are read whole, however
long; rows are judged one by one, so repeated rows share their fate unless a stage says otherwise. Nulls in ``lang``, ``source`` and
``n_chars`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from tidemark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.7 or more go. Null and empty texts are scored as empty texts; null ids are kept or
    dropped by their text alone."""
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them, that with the largest id. Documents stay, also those without
    lines left; null and empty texts are one empty line and stay as they are. Rows that repeat an id are one document."""
    d = line_dedup.drop_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped_") > 0, F.col("kept_")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped_") > 0, F.char_length("kept_").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays, and rows that repeat it with a text of the class. Rows
    without an id or without words are nobody's copy and stay."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts have none; items without words have no windows."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies. Null and empty texts have no tokens and a row without a bin; repeated rows are packed
    each; pieces of one length go by doc_id, then by their order."""
    return packing.placements(docs)


STAGES = [("toxicity", clean), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmark_free), ("best_fit_packing", packed)]

#: Trained trees and best-fit have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
