"""Health checks of an archive and of the observations that it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..archive import Archive


def sources_without_conversations(a: Archive, observations: DataFrame) -> DataFrame:
    """(source_id) of registered sources that were observed but have no conversation."""
    observed = a.sources.select(F.col("id").alias("source_id")).join(observations.select("source_id").distinct(), "source_id", "left_semi")
    return observed.join(a.conversations.select("source_id").distinct(), "source_id", "left_anti")


def empty_conversations(a: Archive) -> DataFrame:
    return a.conversations.select("id", "source_id", "source_native_id").join(a.messages.select(F.col("conversation_id").alias("id")), "id", "left_anti")


def empty_messages(a: Archive) -> DataFrame:
    return a.messages.select("id", "conversation_id").join(a.content_blocks.select(F.col("message_id").alias("id")), "id", "left_anti")


def format_drift(a: Archive, observations: DataFrame, window: int = 20) -> DataFrame:
    """Per source: of the window locators seen last, how many gave no conversation; drifted if three and half of them or more.

    Imports of older archives and locators with a tombstone don't count. Ties in time go to the smaller locator.
    """
    seen = observations.where("not legacy").groupBy("source_id", "locator").agg(F.max("observed_at").alias("seen"), F.bool_or(F.col("kind") == "tombstone").alias("deleted")).where("not deleted")
    latest = seen.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("seen"), "locator"))).where(F.col("place") <= window)
    stored = a.conversations.select("source_id", F.col("source_native_id").alias("locator"), F.lit(True).alias("stored")).distinct()
    out = latest.join(stored, ["source_id", "locator"], "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("recent"), F.count_if(F.col("stored").isNull()).alias("empty"))
    return out.withColumn("drifted", (F.col("empty") >= 3) & (F.col("empty") * 2 >= F.col("recent")))


def unknown_kinds(records: DataFrame, known: Sequence[str], kind: str = "kind") -> DataFrame:
    """(kind, records) of record kinds that a normaliser doesn't know."""
    return records.where(F.col(kind).isNotNull() & ~F.col(kind).isin(*known)).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("records"))
