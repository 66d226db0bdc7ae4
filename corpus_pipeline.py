"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs; all but the last return the
columns of documents.  Other columns of docs are dropped; an empty table, and tables
of labels or benchmark items without rows, go through all stages.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.llm.decontamination import decontaminate  # noqa: E402
from pairloom.llm.ngram_jaccard import keep_one  # noqa: E402
from pairloom.llm.packing import pack, token_pieces  # noqa: E402
from pairloom.llm.pii import pseudonymise  # noqa: E402
from pairloom.llm.queries import tokenizer_path  # noqa: E402
from pairloom.llm.shared import stash  # noqa: E402
from pairloom.llm.toxicity import score_toxicity, train  # noqa: E402
from pairloom.session import ship  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.5).

    A null or empty text has the score of an empty text; without labels of both kinds every document stays;
    rows that repeat, or share a doc_id or have none, are judged each for itself.
    """
    ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(COLUMNS), model, into="_score").where("_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, 0.8).

    Documents without words have no near duplicates and stay, as do rows without a doc_id; rows that share
    the doc_id that is kept are one document and all stay.
    """
    ship(spark)
    return keep_one(docs.select(COLUMNS), n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; a null or empty text holds none; repeated rows are judged each for itself."""
    ship(spark)
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text (code points), and stays where the text is null; repeated rows come out alike."""
    found = pseudonymise(docs.select(COLUMNS), into="_pii").drop("_pii")
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048; a null or empty text is the end id alone, repeated rows are packed each for itself."""
    ship(spark)
    return pack(token_pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: The classifier and the packing cannot be expressed in SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
