"""A corpus pipeline: documents in, packed token sequences out.

STAGES: language ID (documents without a recognised language go), line dedup (one occurrence of each group of near-equal lines
stays; a document left without text goes), n-gram Jaccard join (one document of each group of near-duplicates stays),
benchmark decontamination (documents that share a passage with the benchmark go), best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of
``documents``, with ``text`` and ``n_chars`` as they are then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.language_id import accepted
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import best_fit_packing
from tidemark.session import ship, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without text or letters go."""
    ship(spark)
    return accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, an earlier one; those that keep no text go."""
    ship(spark)
    left = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles; rows without a doc_id
    stay."""
    ship(spark)
    gone = ngram_jaccard_join(docs, k=5, percent=80).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    ship(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens."""
    ship(spark)
    return best_fit_packing(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage before packing can be told in SQL (a trained network, edit distances); the tests hold the stages against brute force.
ORACLE_SQL = None
