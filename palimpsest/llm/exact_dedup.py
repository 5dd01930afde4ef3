"""Exact duplicates by a 128-bit content hash, with the bytes compared inside each group.

Texts are equal when identical after lower-casing A-Z. Rows are grouped by (MD5, whole normalised text): the
hash decides where a row goes, and the aggregation's own map compares the keys' bytes, so two texts with one hash stay
apart. Copies are combined before the shuffle, so a text that a third of all rows share crosses it
once per task. Only groups of two or more rows are joined back, on MD5 and SHA-256.

`keep` names which stable id stays: "min" (the default) or "max".
Defined cases: null counts as empty; rows that repeat a doc_id with one text all count and share their fate; a null
doc_id stays only if its whole group has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, whole_text


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(whole_text(text_col)).alias("norm"))
    groups = (
        rows.withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
        .groupBy("hash", "norm")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    )
    narrow = rows.select("doc_id", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("hash"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    joined = narrow.join(groups, ["hash", "sha"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
