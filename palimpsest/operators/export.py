"""The canonical export: one nested JSON document per conversation, without internal ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import columns as C


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_or_text(column: str) -> Column:
    """A JSON column's canonical text; null for null."""
    return C.canonical(F.col(column))


def moved(text: Column, prefixes: dict[str, str]) -> Column:
    for old, new in prefixes.items():
        text = F.when(text.startswith(old), F.concat(F.lit(new), F.substring(text, F.lit(len(old) + 1), F.length(text)))).otherwise(text)
    return text


def member(name: str, value: Column) -> Column:
    """A JSON object's member; value is JSON text, null for a JSON null."""
    return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))


def object_of(**members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(member(k, v) for k, v in members.items())), F.lit("}"))


def list_of(rows: DataFrame, key: list[str], order: str, text: Column, name: str) -> DataFrame:
    """(key, name): JSON arrays of a parent's rows in their order; a conversation's own, and so bounded by it."""
    grouped = rows.select(*key, F.struct(F.col(order).alias("at"), text.alias("text")).alias("row")).groupBy(*key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select(*key, F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["text"]), ","), F.lit("]")).alias(name))


def export_canonical(a: Archive, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(source_id, source_native_id, document): messages by sequence, blocks by index, raw events by line, parents by native id; prefixes of paths are rewritten."""
    prefixes = prefixes or {}
    q = C.json_string
    path = lambda c: q(moved(F.col(c), prefixes))
    block = object_of(block_index=F.col("block_index").cast("string"), type=q(F.col("type")), text=path("text"), tool_name=q(F.col("tool_name")), tool_use_id=q(F.col("tool_use_id")), payload=json_or_text("payload"))
    blocks = list_of(a.content_blocks, ["message_id"], "block_index", block, "blocks")
    parents = a.messages.select(F.col("id").alias("parent_message_id"), F.col("source_native_id").alias("parent_native"))
    messages = a.messages.join(parents, "parent_message_id", "left").join(blocks.withColumnRenamed("message_id", "id"), "id", "left")
    message = object_of(
        sequence_index=F.col("sequence_index").cast("string"), source_native_id=q(F.col("source_native_id")), parent_source_native_id=q(F.col("parent_native")), role=q(F.col("role")), model=q(F.col("model")),
        created_at=q(stamp(F.col("created_at"))), metadata=json_or_text("metadata"), blocks=F.coalesce("blocks", F.lit("[]")),
    )
    messages = list_of(messages, ["conversation_id"], "sequence_index", message, "messages").withColumnRenamed("conversation_id", "id")
    event = object_of(line_number=F.col("line_number").cast("string"), raw_path=path("raw_path"), payload=json_or_text("payload"))
    raw = a.raw_events.withColumnRenamed("source_native_conversation_id", "source_native_id")
    events = list_of(raw, ["source_id", "source_native_id"], "line_number", event, "raw_events")
    c = a.conversations.join(messages, "id", "left").join(events, ["source_id", "source_native_id"], "left")
    document = object_of(
        source_id=q(F.col("source_id")), source_native_id=q(F.col("source_native_id")), title=q(F.col("title")), project=path("project"), started_at=q(stamp(F.col("started_at"))), ended_at=q(stamp(F.col("ended_at"))),
        message_count=F.col("message_count").cast("string"), raw_path=path("raw_path"), metadata=json_or_text("metadata"), messages=F.coalesce("messages", F.lit("[]")), raw_events=F.coalesce("raw_events", F.lit("[]")),
    )
    return c.select("source_id", "source_native_id", document.alias("document"))
