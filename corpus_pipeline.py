"""From raw documents to packed training sequences, as five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``documents``; n_chars follows the text. The last returns packed pieces with their token ids.

Nulls in any column, empty and very long texts, repeated rows and empty tables are what they are to each operator:
a null or empty text has the score of a text without features, loses no line, is no copy of any other, is taken 0
times by the mixture and thus goes there; rows without an id stay until then; an empty table gives empty results.
Columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from plinth.llm.common import settle
from plinth.llm.queries import documents, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality_classifier.score_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are spread over many sources."""
    return _shaped(line_dedup.drop_spread_lines(docs.select(*COLUMNS), removed_out=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return _shaped(mixing.mixed_documents(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("source mixing", mixture), ("packing", packed)]

#: Classifier, tokens and components are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
