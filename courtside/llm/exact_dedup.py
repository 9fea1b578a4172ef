"""Operator 7, exact dedup: local, salted and global combining, native Spark only.

Method. Texts are normalised (each run of white space becomes one space; null is empty) and digested. A hash aggregate
keyed by (digest, salt, whole text) first combines within each input task, then within each salted group; a second one
keyed by (digest, whole text) combines the winners of the salts. Keys hold the whole text, so content is compared at
each stage and a digest only decides where a row goes. A content of which a third of the corpus are copies sends at most
one row per task to the salted stage and at most `salts` rows to the last one.

The winners then reach the rows by a join on the digest alone, which is exact wherever one content has that digest; a digest
of very many rows is dealt out in parts, each with a copy of its winner. Digests shared by several contents (none with
SHA-256) are joined by whole text instead.

Defined cases: null text is empty; texts differing only in white space are equal; leading and trailing white space counts
as one space, so " a" is not "a"; a row with a null id never wins while the group has another, and stays if all are null;
rows with the same id are one document: all of them stay or go; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_one, settle, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. digest: of the normalised text; may collide."""
    digest = digest or (lambda text: F.sha2(text, 256))
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest(F.col("body")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).groupBy("digest", "salt", "body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "body").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    winners = settle(merged.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep").alias("keep"), F.sum("n").alias("n")))
    single = winners.where("contents = 1").drop("contents")
    sha = F.sha2("body", 256).alias("sha")
    out = join_one(rows.select("id", "digest", sha), single, ["digest"], F.monotonically_increasing_id())
    shared = winners.where("contents > 1").select("digest")
    if not shared.isEmpty():  # digests that several contents have: whole texts are the key
        few = rows.join(shared, "digest", "left_semi")
        best = few.groupBy("digest", "body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        out = out.select("id", "sha", "keep", "n").unionByName(few.join(best, ["digest", "body"]).select("id", sha, "keep", "n"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""
