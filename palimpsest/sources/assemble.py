"""From a source's messages to the archive's tables: numbering, ids, parents, titles, spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..archive import BLOCK, Archive
from ..functions import columns as C


def block(type_: str, text: Column | None = None, tool_name: Column | None = None, tool_use_id: Column | None = None, payload: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(type_).alias("type"),
        (none if text is None else text).alias("text"),
        (none if tool_name is None else tool_name).alias("tool_name"),
        (none if tool_use_id is None else tool_use_id).alias("tool_use_id"),
        (none if payload is None else payload).alias("payload"),
    ).cast(BLOCK)


def no_blocks() -> Column:
    return F.array().cast(f"array<{BLOCK}>")


#: Sources whose messages name a parent; in the others there is none to resolve.
PARENTED = frozenset({"claude_code", "omp"})


@dataclass
class Parsed:
    """The conversations of one source before ids are made: what several versions of a conversation are merged from.

    conversations: locator, title, project, started_at, ended_at, metadata, raw_path, source_file_mtime; messages: locator, sequence_index,
    source_native_id, parent_source_native_id, role, model, created_at, metadata, blocks; events: locator, path, line, raw.
    """

    source: str
    version: str
    conversations: DataFrame
    messages: DataFrame
    events: DataFrame

    def archive(self) -> Archive:
        """The archive's tables. Payloads that are empty objects are null, empty metadata is {}."""
        source_id, empty = F.lit(self.source), F.lit(None)
        kept = self.messages.withColumn("conversation_id", C.conversation_id(source_id, F.col("locator")))
        kept = C.with_message_ids(kept)
        kept = C.with_parents(kept) if self.source in PARENTED else kept.withColumn("parent_message_id", F.lit(None).cast("string"))
        blocks = kept.select(F.col("id").alias("message_id"), F.posexplode("blocks").alias("block_index", "b")).select("message_id", "block_index", "b.*")
        sizes = self.messages.groupBy("locator").agg(F.count(F.lit(1)).cast("int").alias("message_count"))
        conversations = self.conversations.join(sizes.hint("merge"), "locator", "left").select(
            C.conversation_id(source_id, F.col("locator")).alias("id"),
            source_id.alias("source_id"),
            F.col("locator").alias("source_native_id"),
            "title",
            "project",
            "started_at",
            "ended_at",
            F.coalesce("message_count", F.lit(0)).alias("message_count"),
            empty.cast("string").alias("content_hash"),
            "raw_path",
            F.coalesce("metadata", F.lit("{}")).alias("metadata"),
            empty.cast("timestamp").alias("ingested_at"),
            "source_file_mtime",
        )
        raw = self.events.select(
            C.raw_event_id(C.conversation_id(source_id, F.col("locator")), F.col("line")).alias("id"),
            source_id.alias("source_id"),
            F.col("locator").alias("source_native_conversation_id"),
            F.col("path").alias("raw_path"),
            F.col("line").cast("int").alias("line_number"),
            F.col("raw").alias("payload"),
            empty.cast("timestamp").alias("ingested_at"),
        )
        time = empty.cast("timestamp")
        sources = self.conversations.sparkSession.range(1).select(
            source_id.alias("id"), source_id.alias("name"), F.lit(self.version).alias("adapter_version"), time.alias("first_seen"), time.alias("last_ingested"), F.lit("{}").alias("config")
        )
        return Archive(
            sources=sources,
            conversations=conversations,
            messages=kept.select("id", "conversation_id", "source_native_id", "parent_message_id", "role", "model", "created_at", F.col("sequence_index").cast("int"), F.coalesce("metadata", F.lit("{}")).alias("metadata")),
            content_blocks=blocks.select(
                C.block_id(F.col("message_id"), F.col("block_index")).alias("id"), "message_id", F.col("block_index").cast("int"), "type", "text", "tool_name", "tool_use_id", F.when(F.col("payload") != "{}", F.col("payload")).alias("payload")
            ),
            raw_events=raw,
        )


def parsed(source: str, version: str, handles: DataFrame, conversations: DataFrame, messages: DataFrame, events: DataFrame, untitled: Column | None = None) -> Parsed:
    """Numbers messages by `at` (any order within the conversation) and leaves out those without blocks.

    Conversations that are untitled (without more said: those whose title is null) take the first user line, if there is one.
    All that is joined by locator is grouped by it, so merges need no shuffle of their own; Spark would take these tables for less than they are.
    """
    kept = messages.where(F.size("blocks") > 0)
    kept = kept.withColumn("sequence_index", F.row_number().over(Window.partitionBy("locator").orderBy("at")) - 1).drop("at")
    blocks = kept.where("role = 'user'").select(F.col("locator").alias("conversation_key"), "role", "sequence_index", F.posexplode("blocks").alias("block_index", "b"))
    lines = C.first_user_line(blocks.select("conversation_key", "role", "sequence_index", "block_index", "b.type", "b.text")).withColumnRenamed("conversation_key", "locator")
    untitled = F.col("title").isNull() if untitled is None else untitled
    conversations = conversations.join(lines.hint("merge"), "locator", "left").withColumn("title", F.when(untitled, F.coalesce("line", "title")).otherwise(F.col("title")))
    mtimes = handles.groupBy("locator").agg(F.max("mtime").alias("source_file_mtime"))
    columns = ("locator", "title", "project", "started_at", "ended_at", "metadata", "raw_path", "source_file_mtime")
    return Parsed(source, version, conversations.join(mtimes.hint("merge"), "locator", "left").select(*columns), kept, events)


def or_default(v: Column, key: str, default: str) -> Column:
    """JSON text of a key's value; the default if the key is absent."""
    return F.coalesce(F.to_json(C.get(v, key)), F.lit(default))


def joined(v: Column, typed: bool, skip_empty: bool) -> Column:
    """The text items of a JSON array, by newlines; null if there is none. typed: only items whose type is text."""
    items = C.items_of(v)
    if typed:
        items = F.filter(items, lambda x: C.get_string(x, "type") == "text")
    texts = F.transform(items, lambda x: C.get_string(x, "text"))
    texts = F.filter(texts, lambda t: t != "") if skip_empty else F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def span(messages: DataFrame) -> DataFrame:
    """(locator, started_at, ended_at) over messages that have blocks."""
    return messages.where(F.size("blocks") > 0).groupBy("locator").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"))
