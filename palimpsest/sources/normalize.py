"""Normalisers: one Spark job per source, from handles to an archive. JSON is read with variant functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import columns as C
from .assemble import Parsed, block, joined, no_blocks, or_default, parsed, span
from .sessions import parse_hermes, parse_sessions
from .transcripts import explode_jsonl, scan_lines


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("locator").agg(F.any_value("path").alias("raw_path"), F.any_value("project_hint").alias("project_hint"), F.count(F.lit(1)).alias("n"))


def content_block(x: Column) -> Column:
    """A typed block of message content: text, thinking, tool_use, tool_result, image; others are kept whole."""
    type_ = C.get_string(x, "type")
    result = C.get(x, "content")
    text = F.when(C.kind(result) == "STRING", F.try_variant_get(result, "$", "string")).otherwise(joined(result, True, False))
    return (
        F.when(type_ == "text", block("text", C.get_string(x, "text")))
        .when(type_ == "thinking", block("thinking", C.get_string(x, "thinking")))
        .when(type_ == "tool_use", block("tool_use", None, C.get_string(x, "name"), C.get_string(x, "id"), C.object_text(input=or_default(x, "input", "{}"))))
        .when(type_ == "tool_result", block("tool_result", text, None, C.get_string(x, "tool_use_id"), C.object_text(is_error=or_default(x, "is_error", "false"), raw_content=F.to_json(result))))
        .when(type_ == "image", block("image", payload=C.object_text(source=or_default(x, "source", "{}"))))
        .otherwise(block("text", payload=C.object_text(unknown_block=F.to_json(x))))
    )


def parse_claude_code(handles: DataFrame, events: DataFrame | None = None) -> Parsed:
    """JSONL events of type user, assistant, system or summary."""
    v = F.col("v")
    events = explode_jsonl(handles) if events is None else events
    type_ = C.get_string(v, "type")
    message = C.as_object(C.get(v, "message"))
    content = C.get(message, "content")
    blocks = F.when(C.kind(content) == "STRING", F.array(block("text", F.try_variant_get(content, "$", "string")))).otherwise(F.coalesce(F.transform(C.items_of(content), content_block), no_blocks()))
    messages = events.where(type_.isin("user", "assistant", "system")).select(
        "locator",
        F.col("line").alias("at"),
        C.get_string(v, "uuid").alias("source_native_id"),
        C.get_string(v, "parentUuid").alias("parent_source_native_id"),
        type_.alias("role"),
        C.get_string(message, "model").alias("model"),
        C.iso_time(C.get_string(v, "timestamp")).alias("created_at"),
        C.object_text(request_id=F.to_json(C.get(v, "requestId")), cwd=F.to_json(C.get(v, "cwd"))).alias("metadata"),
        blocks.alias("blocks"),
    )
    summary = F.when((type_ == "summary") & C.get_string(v, "summary").isNotNull(), C.strip(C.get_string(v, "summary")))
    found = events.select("locator", "line", summary.alias("summary"), C.non_empty(v, "cwd").alias("cwd")).groupBy("locator")
    found = found.agg(F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("line"))).alias("title"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("cwd"))
    conversations = event_counts(events).join(found.hint("merge"), "locator").join(span(messages).hint("merge"), "locator", "left").select(
        "locator", "title", F.coalesce("cwd", "project_hint").alias("project"), "started_at", "ended_at", C.object_text(event_count=F.col("n").cast("string")).alias("metadata"), "raw_path"
    )
    return parsed("claude_code", "1", handles, conversations, messages, events)


def parse_codex_cli(handles: DataFrame, events: DataFrame | None = None) -> Parsed:
    """JSONL events {timestamp, type, payload}; the model is the first that a turn_context names, from there on."""
    v = F.col("v")
    events = explode_jsonl(handles) if events is None else events
    stamp = C.get(v, "timestamp")
    number = F.when(C.kind(stamp).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(stamp, "$", "double"))
    events = events.withColumn("time", F.when(number.isNotNull(), C.unix_time(number)).otherwise(C.iso_time(C.get_string(v, "timestamp"))))
    events = events.withColumn("type", C.get_string(v, "type")).withColumn("p", C.as_object(C.get(v, "payload")))
    p, kind = F.col("p"), C.get_string(F.col("p"), "type")
    order = Window.partitionBy("locator").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.when(F.col("type") == "turn_context", C.non_empty(p, "model"))
    events = events.withColumn("model", F.first(named, ignorenulls=True).over(order))
    output = C.get(p, "output")
    output_text = F.when(C.kind(output) == "STRING", F.try_variant_get(output, "$", "string")).when(C.kind(output) == "ARRAY", joined(output, False, True)).when(C.kind(output) == "OBJECT", C.get_string(output, "text"))
    text = joined(C.get(p, "content"), False, True)
    said = (F.col("type") == "event_msg") & (kind == "user_message") & C.non_empty(p, "message").isNotNull()
    item = F.col("type") == "response_item"
    speaker = C.get_string(p, "role")
    role = (
        F.when(said, "user")
        .when(item & (kind == "message") & speaker.isin("assistant", "user") & text.isNotNull(), speaker)
        .when(item & kind.isin("reasoning", "function_call", "web_search_call", "custom_tool_call"), "assistant")
        .when(item & kind.isin("function_call_output", "custom_tool_call_output"), "tool")
    )
    query = F.to_json(C.get(C.as_object(C.get(p, "action")), "query"))
    one = (
        F.when(said, block("text", C.non_empty(p, "message")))
        .when(kind == "message", block("text", text))
        .when(kind == "reasoning", block("thinking", joined(C.get(p, "summary"), False, True), payload=C.object_text(has_encrypted_content=C.truthy(C.get(p, "encrypted_content")).cast("string"))))
        .when(kind == "function_call", block("tool_use", None, C.get_string(p, "name"), C.get_string(p, "call_id"), C.object_text(arguments=or_default(p, "arguments", '""'))))
        .when(kind == "custom_tool_call", block("tool_use", None, C.get_string(p, "name"), C.get_string(p, "call_id"), C.object_text(input=or_default(p, "input", '""'))))
        .when(kind == "web_search_call", block("tool_use", None, F.lit("web_search"), C.get_string(p, "id"), C.object_text(status=F.to_json(C.get(p, "status")), query=query)))
        .otherwise(block("tool_result", output_text, None, C.get_string(p, "call_id")))
    )
    messages = events.withColumn("role", role).where("role is not null").select(
        "locator",
        F.col("line").alias("at"),
        F.when(~said, F.coalesce(C.non_empty(p, "call_id"), C.non_empty(p, "id"))).alias("source_native_id"),
        F.lit(None).cast("string").alias("parent_source_native_id"),
        "role",
        F.when((F.col("role") == "assistant") & ~said, F.col("model")).alias("model"),
        F.col("time").alias("created_at"),
        F.lit("{}").alias("metadata"),
        F.array(one).alias("blocks"),
    )
    cwd = F.when(F.col("type").isin("session_meta", "turn_context"), C.non_empty(p, "cwd"))
    found = events.withColumn("cwd", cwd).groupBy("locator").agg(F.min("time").alias("started_at"), F.max("time").alias("ended_at"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("project"))
    conversations = event_counts(events).join(found, "locator").select("locator", F.lit(None).cast("string").alias("title"), "project", "started_at", "ended_at", C.object_text(event_count=F.col("n").cast("string")).alias("metadata"), "raw_path")
    return parsed("codex_cli", "1", handles, conversations, messages, events)


def parse_claude_export(handles: DataFrame) -> Parsed:
    """One JSON object per conversation; its messages are an array."""
    v = F.col("v")
    docs = handles.select("locator", "path", F.trim(F.decode("content", "UTF-8")).alias("raw")).withColumn("v", C.parsed(F.col("raw")))
    chat = F.when(C.kind(C.get(v, "chat_messages")) == "ARRAY", F.try_variant_get(v, "$.chat_messages", "array<variant>"))
    items = docs.select("locator", F.posexplode(chat).alias("at", "m")).where(C.kind(F.col("m")) == "OBJECT")
    m = F.col("m")
    content, attached = C.get(m, "content"), C.items_of(C.get(m, "attachments"))
    listed = F.size(F.try_variant_get(content, "$", "array<variant>")) > 0
    own = F.when((C.kind(content) == "ARRAY") & listed, F.transform(C.items_of(content), content_block)).when(C.truthy(C.get(m, "text")), F.array(block("text", C.get_string(m, "text")))).otherwise(no_blocks())

    def attachment(x: Column) -> Column:
        members = {k: F.to_json(C.get(x, k)) for k in ("file_name", "file_size", "file_type", "extracted_content")}
        return block("attachment", C.get_string(x, "file_name"), payload=C.object_text(**members))

    sender = C.get(m, "sender")
    human = F.coalesce(sender.isNull() | (C.get_string(m, "sender") == "human"), F.lit(False))
    known = sender.isNotNull() & ~F.is_variant_null(sender)
    messages = items.select(
        "locator",
        "at",
        C.get_string(m, "uuid").alias("source_native_id"),
        F.lit(None).cast("string").alias("parent_source_native_id"),
        F.when(human, "user").otherwise("assistant").alias("role"),
        F.lit(None).cast("string").alias("model"),
        C.iso_time(C.get_string(m, "created_at")).alias("created_at"),
        F.when(known, C.object_text(sender=F.to_json(sender))).otherwise("{}").alias("metadata"),
        F.concat(own, F.coalesce(F.transform(attached, attachment), no_blocks())).alias("blocks"),
    )
    conversations = docs.join(span(messages).withColumnsRenamed({"started_at": "first", "ended_at": "last"}), "locator", "left").select(
        "locator",
        C.get_string(v, "name").alias("title"),
        F.lit(None).cast("string").alias("project"),
        F.least(C.iso_time(C.get_string(v, "created_at")), "first").alias("started_at"),
        F.greatest(C.iso_time(C.get_string(v, "updated_at")), "last").alias("ended_at"),
        C.object_text(message_count=F.coalesce(F.size(chat), F.lit(0)).cast("string")).alias("metadata"),
        F.col("path").alias("raw_path"),
    )
    events = docs.select("locator", "path", F.lit(0).alias("line"), "raw")
    return parsed("claude_export", "1", handles, conversations, messages, events)


def parse_omp(handles: DataFrame, events: DataFrame | None = None) -> Parsed:
    """JSONL with a title slot, a session header, messages and custom messages."""
    v = F.col("v")
    events = (explode_jsonl(handles) if events is None else events).withColumn("type", C.get_string(v, "type")).withColumn("time", C.iso_time(C.get_string(v, "timestamp")))
    m = C.as_object(C.get(v, "message"))
    speaker = C.get_string(m, "role")

    def text_of(v: Column) -> Column:
        return F.when(C.kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
            F.when(F.size(typed := F.filter(F.transform(F.filter(C.items_of(v), lambda x: C.get_string(x, "type") == "text"), lambda x: C.get_string(x, "text")), lambda t: t.isNotNull())) > 0, F.array_join(typed, "\n"))
        )

    def item(x: Column) -> Column:
        type_ = C.get_string(x, "type")
        arguments = C.get(x, "arguments")
        as_text = F.try_variant_get(arguments, "$", "string")
        inner = F.when(C.kind(arguments) == "STRING", F.coalesce(F.to_json(C.parsed(as_text)), C.object_text(raw=F.to_json(arguments)))).otherwise(F.to_json(arguments))
        members = F.map_filter(F.try_variant_get(x, "$", "map<string, variant>"), lambda k, v: k != "type")
        return (
            F.when(type_ == "text", block("text", C.non_empty(x, "text")))
            .when(type_ == "thinking", block("thinking", C.non_empty(x, "thinking")))
            .when(type_ == "toolCall", block("tool_use", None, C.get_string(x, "name"), C.get_string(x, "id"), C.object_text(arguments=inner)))
            .when(type_ == "image", block("image", payload=F.to_json(members)))
        )

    content = C.get(m, "content")
    string = F.try_variant_get(content, "$", "string")
    listed = F.filter(F.transform(C.items_of(content), item), lambda b: b.isNotNull() & (~b["type"].isin("text", "thinking") | b["text"].isNotNull()))
    plain = F.when(C.kind(content) == "STRING", F.when(string != "", F.array(block("text", string)))).otherwise(listed)
    details = C.as_object(C.get(m, "details"))
    failed = C.truthy(C.get(m, "isError"))
    payload = F.concat(F.lit("{"), F.concat_ws(",", F.when(details.isNotNull(), F.concat(F.lit('"details":'), F.to_json(details))), F.when(failed, F.lit('"isError":true'))), F.lit("}"))
    result = F.array(block("tool_result", text_of(content), C.get_string(m, "toolName"), C.get_string(m, "toolCallId"), payload))
    extra = text_of(C.get(v, "content"))
    custom = F.col("type") == "custom_message"
    attribution = F.when(custom, C.get_string(v, "attribution")).otherwise(C.get_string(m, "attribution"))
    role = F.when(custom, F.when(attribution == "user", "user").otherwise("assistant")).otherwise(F.when(speaker == "toolResult", "tool").when(speaker.isin("user", "assistant"), speaker))
    blocks = F.when(custom, F.when(extra != "", F.array(block("text", extra)))).otherwise(F.when(speaker == "toolResult", result).otherwise(plain))
    messages = events.where(F.col("type").isin("message", "custom_message")).withColumn("role", role).where("role is not null").select(
        "locator",
        F.col("line").alias("at"),
        C.get_string(v, "id").alias("source_native_id"),
        C.get_string(v, "parentId").alias("parent_source_native_id"),
        "role",
        F.when(~custom, C.get_string(m, "model")).alias("model"),
        F.col("time").alias("created_at"),
        F.when(attribution.isNotNull(), C.object_text(attribution=C.json_string(attribution))).otherwise("{}").alias("metadata"),
        F.coalesce(blocks, no_blocks()).alias("blocks"),
    )
    title = F.when(C.get_string(v, "title").isNotNull() & (C.strip(C.get_string(v, "title")) != ""), C.strip(C.get_string(v, "title")))
    header = F.col("type") == "session"
    slots = events.select("locator", "line", header.alias("header"), F.when(F.col("type").isin("title", "session"), title).alias("title"), F.when(header, C.get_string(v, "cwd")).alias("cwd"), F.when(header, F.col("time")).alias("begun"))
    line = F.col("line")
    found = slots.groupBy("locator").agg(
        F.max_by("title", F.when(F.col("header") & F.col("title").isNotNull(), line)).alias("header_title"),
        F.min_by("title", F.when(~F.col("header") & F.col("title").isNotNull(), line)).alias("slot_title"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), line)).alias("cwd"),
        F.max_by("begun", F.when(F.col("begun").isNotNull(), line)).alias("begun"),
        F.max(F.when(F.col("begun").isNotNull(), line)).alias("header_line"),
    )
    # The header's time sets the start; only messages after it can move it back.
    times = messages.where(F.size("blocks") > 0).select("locator", "at", "created_at").join(found.select("locator", "header_line"), "locator", "left")
    spans = times.groupBy("locator").agg(F.min(F.when(F.col("header_line").isNull() | (F.col("at") > F.col("header_line")), F.col("created_at"))).alias("first"), F.max("created_at").alias("ended_at"))
    conversations = event_counts(events).join(found, "locator").join(spans, "locator", "left").select(
        "locator",
        F.coalesce("header_title", "slot_title").alias("title"),
        F.coalesce("cwd", "project_hint").alias("project"),
        F.least("begun", "first").alias("started_at"),
        "ended_at",
        C.object_text(event_count=F.col("n").cast("string")).alias("metadata"),
        "raw_path",
    )
    return parsed("omp", "1", handles, conversations, messages, events)


PARSERS: dict[str, Callable[[DataFrame], Parsed]] = {
    "claude_code": parse_claude_code,
    "codex_cli": parse_codex_cli,
    "claude_export": parse_claude_export,
    "omp": parse_omp,
    "opencode": parse_sessions,
    "hermes_agent": parse_hermes,
}
#: Sources whose transcripts only ever grow; the others are logged as whole snapshots.
APPEND_ONLY = frozenset({"claude_code", "codex_cli", "omp"})


def read_transcripts(spark: SparkSession, root: str, source: str) -> Archive:
    """The archive of all transcript files of an append-only source under root, read in splits whatever their size."""
    handles, events = scan_lines(spark, root, source)
    return PARSERS[source](handles, events).archive()


def normalize(source: str, handles: DataFrame) -> Archive:
    return PARSERS[source](handles).archive()


NORMALIZERS: dict[str, Callable[[DataFrame], Archive]] = {source: partial(normalize, source) for source in PARSERS}
