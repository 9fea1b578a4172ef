"""Cleaning pipeline over `documents`: language, repeated lines, near copies, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; run() writes
each result to the shared folder and reads it back for the next. All stages but the last return the columns of
documents. n_chars follows the text where a stage changes it. ORACLE_SQL is None: the first stage's classifier isn't
expressible in SQL; tests/llm compares the whole run with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import decontamination, language_id, line_dedup, near_dedup, pieces
from courtside.llm.common import crc_mod, settle, table

#: A document goes if its language can't be told: no letter, or a probability below this.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that fit no learned language. What may teach is as in op2."""
    model = language_id.train(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)))
    judged = language_id.identify(docs, model, lang="__lang", score="__score")
    kept = F.col("__score") >= LEAST_SCORE if model.languages else F.lit(True)  # nothing learned: nothing rejected
    return judged.where(kept).drop("__lang", "__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later runs of 50 or more words that repeat line by line. Every document stays."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group. Documents that are left without a word are linked with nothing and stay."""
    judged = near_dedup.near_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(judged, F.col("doc_id") == F.col("__id"), "left_anti")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(judged, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids (end id last), with the ids' number and what they decode to."""
    return pieces.encode_pieces(docs, pieces.public_model()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("sentencepiece", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
