"""Archives made from the given tables: turns through transcripts and normalisers, events as tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import Archive
from ..session import configure
from ..sources.normalize import NORMALIZERS
from ..sources.render import RENDERERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def of_turns(spark: SparkSession, sf_dir: str, source: str = "claude_code") -> Archive:
    """The conversations table, rendered in a source's layout and normalised again."""
    return NORMALIZERS[source.removesuffix("_v2")](RENDERERS[source](table(spark, sf_dir, "conversations")))


def of_events(spark: SparkSession, sf_dir: str) -> Archive:
    """Events as tool calls: a user is a conversation, an event a message with one tool_use block."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    none = lambda type_: F.lit(None).cast(type_)
    text = lambda c: F.col(c).cast("string")
    source = F.when(F.col("user_id") % 3 == 0, "codex_cli").otherwise("claude_code")
    per_user = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).cast("int").alias("message_count"))
    conversations = per_user.select(
        text("user_id").alias("id"), source.alias("source_id"), text("user_id").alias("source_native_id"), F.concat(F.lit("User "), text("user_id")).alias("title"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("/p"), (F.col("user_id") % 11).cast("string"))).alias("project"),
        "started_at", "ended_at", "message_count", none("string").alias("content_hash"), F.lit("/events").alias("raw_path"), F.lit("{}").alias("metadata"), none("timestamp").alias("ingested_at"), none("double").alias("source_file_mtime"),
    )
    messages = e.select(
        text("event_id").alias("id"), text("user_id").alias("conversation_id"), text("event_id").alias("source_native_id"), none("string").alias("parent_message_id"), F.when(F.col("event_id") % 4 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("model-"), F.col("event_type"))).alias("model"), F.col("ts").alias("created_at"), F.col("event_id").cast("int").alias("sequence_index"), F.lit("{}").alias("metadata"),
    )
    kind = F.when(F.col("event_id") % 7 == 0, "thinking").otherwise("tool_use")
    blocks = e.select(
        F.concat(F.lit("b"), text("event_id")).alias("id"), text("event_id").alias("message_id"), F.lit(0).alias("block_index"), kind.alias("type"), F.when(kind == "thinking", F.col("event_type")).alias("text"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("tool_name"), text("event_id").alias("tool_use_id"), F.concat(F.lit('{"input":'), F.col("props"), F.lit("}")).alias("payload"),
    )
    raw = e.select(
        F.concat(F.lit("r"), text("event_id")).alias("id"), source.alias("source_id"), text("user_id").alias("source_native_conversation_id"), F.lit("/events").alias("raw_path"), F.col("event_id").cast("int").alias("line_number"), F.col("props").alias("payload"), none("timestamp").alias("ingested_at"),
    )
    sources = e.select(F.explode(F.array(F.lit("claude_code"), F.lit("codex_cli"), F.lit("omp"))).alias("id")).distinct().select(
        "id", F.upper("id").alias("name"), F.lit("1").alias("adapter_version"), none("timestamp").alias("first_seen"), none("timestamp").alias("last_ingested"), F.lit("{}").alias("config")
    )
    return Archive(sources, conversations, messages, blocks, raw)
