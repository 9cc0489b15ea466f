"""Exact deduplication by skew-safe combining.

Three combining steps, each of which groups by digest *and* whole normalised text:

1. every task combines the equal texts of its own rows (Spark's partial aggregation),
2. groups of (digest, text, salt) merge; the salt is the task that read the row, modulo ``salts``, so one text's rows
   meet in at most ``salts`` places and a task sends one row a text,
3. the salts' winners combine globally.

What follows carries digests only: once step 3 has shown that every digest stands for one text, documents find their
class by digest. Should a digest ever stand for two texts, documents are joined by digest and whole text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_skewed, text_of

#: Runs of these become one space; a fixed value of the contract.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _classes(rows: DataFrame, salts: int) -> DataFrame:
    merged = rows.withColumn("_salt", F.spark_partition_id() % salts).groupBy("_digest", "_norm", "_salt").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    return merged.repartition("_digest").groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of df: ``doc_id, keep_id, group_size, kept, digest``.

    Null text counts as empty text; empty texts are equal to each other. Of equal texts the smallest id stays; null ids
    are passed over while another id is there. Rows that repeat an id and text count each, and stay or go together.
    An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("_id"), normalised(df[text_col]).alias("_norm")).withColumn("_digest", digest(F.col("_norm")))
    classes = _classes(rows, salts)
    by_digest = cut(classes.groupBy("_digest").agg(F.count("*").alias("_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    docs = rows.select(F.col("_id").alias("doc_id"), "_digest")
    if by_digest.filter("_texts > 1").isEmpty():
        out = join_skewed(docs, by_digest, "_digest", "group_size", ["keep_id", "group_size"], F.col("doc_id"))
    else:
        docs = rows.select(F.col("_id").alias("doc_id"), "_digest", F.struct("_digest", "_norm").alias("_text"))
        texts = classes.select(F.struct("_digest", "_norm").alias("_text"), "keep_id", "group_size")
        out = join_skewed(docs, texts, "_text", "group_size", ["keep_id", "group_size"], F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("digest"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of df that stay, all columns, whatever their names: of equal texts, null being empty, the smallest id.

    Ids name documents: rows that share the id and text of a kept row stay with it. A row of null id stays where its
    whole group has null ids. An empty table stays empty.
    """
    rows = df.select(F.col(id_col).alias("_id"), normalised(df[text_col]).alias("_norm")).withColumn("_digest", sha256(F.col("_norm")))
    winners = _classes(rows, salts).select("keep_id", F.col("_digest").alias("digest"))
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    own_id, own_text = (inner[names.index(c)] for c in (id_col, text_col))
    return inner.join(winners, sha256(normalised(own_text)).eqNullSafe(F.col("digest")) & own_id.eqNullSafe(F.col("keep_id")), "left_semi").toDF(*names)
