"""Normalisers of relational sessions: two layouts of one agent, and another agent's tables. Handles hold a document per session.

A turn's parts become messages: what stands between two tool parts is one message, each tool part a tool_use message and, once it
has ended, a tool_result message. All of that happens inside a turn's array, so a turn is never split over rows and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..archive import BLOCK
from ..functions import columns as C
from .assemble import Parsed, block, no_blocks, or_default, parsed

MESSAGE = f"struct<native: string, role: string, model: string, metadata: string, blocks: array<{BLOCK}>>"


def obj(v: Column) -> Column:
    return C.let(v, C.as_object)


def str_of(v: Column) -> Column:
    return C.let(v, C.string_of)


def txt(v: Column, key: str) -> Column:
    return str_of(C.get(v, key))


def data_of(v: Column) -> Column:
    """A JSON data column: an object, or its text; anything else is an empty object."""
    own = lambda x: F.when(C.kind(x) == "OBJECT", x).otherwise(C.as_object(C.parsed(C.string_of(x))))
    return F.coalesce(C.let(v, own), F.parse_json(F.lit("{}")))


def id_of(v: Column) -> Column:
    return F.coalesce(str_of(v), F.to_json(v))


def millis(v: Column) -> Column:
    def own(x: Column) -> Column:
        text = F.trim(C.string_of(x))
        return F.when(C.truthy(x), F.coalesce(C.number_of(x), F.when(text.rlike(r"^[+-]?\d+$"), text.cast("double"))))

    return C.unix_time(C.let(v, own).cast("long") / 1000)


def variants(v: Column) -> Column:
    """The items of a JSON array, null items included; an empty array for anything else."""
    return F.coalesce(F.when(C.kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def no_null(v: Column) -> Column:
    """JSON text of a value that is neither absent nor null."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.to_json(v))


def true_text(v: Column) -> Column:
    return F.when(C.truthy(v), F.to_json(v))


def part_blocks(x: Column, begun: str, ended: str) -> Column:
    """The blocks of a part that is no tool: text, reasoning or a patch."""

    def own(type_: Column, text: Column, time: Column) -> Column:
        said = F.when(C.truthy(text), C.string_of(text))
        thought = block("thinking", said, payload=C.optional_object(start_ms=no_null(C.get(time, begun)), end_ms=no_null(C.get(time, ended))))
        patch = block("tool_result", tool_name=F.lit("patch"), payload=C.object_text(hash=F.to_json(C.get(x, "hash")), files=or_default(x, "files", "[]")))
        found = F.when((type_ == "text") & C.truthy(text), F.array(block("text", said))).when(type_ == "reasoning", F.array(thought)).when(type_ == "patch", F.array(patch))
        return F.coalesce(found, no_blocks())

    return C.let(txt(x, "type"), lambda type_: C.let(C.get(x, "text"), lambda text: C.let(obj(C.get(x, "time")), lambda time: own(type_, text, time))))


def message(native: Column, role: str | Column, model: Column, metadata: Column, blocks: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(native.alias("native"), role.alias("role"), model.alias("model"), metadata.alias("metadata"), blocks.alias("blocks")).cast(MESSAGE)


def tool_messages(x: Column, call: Column, name: Column, model: Column, text_of: Callable[[Column], Column], ends: tuple[str, ...]) -> Column:
    """A tool_use message and, if the state's status is one of ends, its tool_result message; text_of gives the result's text from the state."""
    none, empty = F.lit(None).cast("string"), F.lit("{}")

    def made(state: Column, status: Column, id_: Column) -> Column:
        text = F.coalesce(F.to_json(status), F.lit("null"))
        used = message(id_, "assistant", model, empty, F.array(block("tool_use", None, name, id_, C.object_text(input=or_default(state, "input", "{}"), status=text))))
        payload = C.optional_object(status=text, is_error=F.when(text == '"error"', "true"))
        result = message(id_, "tool", none, empty, F.array(block("tool_result", text_of(state), None, id_, payload)))
        return F.when(text.isin(*(f'"{e}"' for e in ends)), F.array(used, result)).otherwise(F.array(used))

    return C.let(obj(C.get(x, "state")), lambda state: C.let(C.get(state, "status"), lambda status: C.let(call, lambda id_: made(state, status, id_))))


def split_turn(parts: Column, native: Column, role: Column, model: Column, metadata: Column) -> Column:
    """The messages of a turn from its parts, structs of tool (bool), blocks and messages (of a tool): blocks between tools are one message. One pass over the parts."""
    state = f"struct<made: array<{MESSAGE}>, said: array<{BLOCK}>>"
    none = F.array().cast(f"array<{MESSAGE}>")

    def told(s: Column) -> Column:
        return F.concat(s["made"], F.when(F.size(s["said"]) > 0, F.array(message(native, role, model, metadata, s["said"]))).otherwise(none))

    def step(s: Column, p: Column) -> Column:
        after_tool = F.struct(F.concat(told(s), F.coalesce(p["messages"], none)).alias("made"), no_blocks().alias("said"))
        return F.when(p["tool"], after_tool.cast(state)).otherwise(F.struct(s["made"].alias("made"), F.concat(s["said"], p["blocks"]).alias("said")).cast(state))

    return F.aggregate(parts, F.struct(none.alias("made"), no_blocks().alias("said")).cast(state), step, told)


def documents(handles: DataFrame) -> DataFrame:
    text = F.trim(F.make_valid_utf8(F.col("content").cast("string")))
    return handles.select("locator", "path", "project_hint", text.alias("raw")).withColumn("top", obj(C.parsed(F.col("raw"))))


def legacy_rows(raw: Column) -> Column:
    """The objects of an import's lines."""
    lines = F.filter(F.split(raw, "\n"), lambda x: F.trim(x) != "")
    return F.filter(F.transform(lines, lambda x: C.parsed(x)), lambda x: C.kind(x) == "OBJECT")


def turn_span(turns: DataFrame) -> DataFrame:
    """(locator, started_at, ended_at) over created and completed times of all turns."""
    found = turns.groupBy("locator").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last"), F.max("done").alias("done"))
    return found.select("locator", "started_at", F.greatest("last", "done").alias("ended_at"))


def flat_messages(turns: DataFrame) -> DataFrame:
    """Turns with `made`, their messages, to message rows; `at` is a struct of the turn's place and the message's in it."""
    rows = turns.select("locator", "turn", "created_at", F.posexplode("made").alias("k", "m"))
    none = F.lit(None).cast("string")
    return rows.select("locator", F.struct("turn", "k").alias("at"), F.col("m.native").alias("source_native_id"), none.alias("parent_source_native_id"), "m.role", "m.model", "created_at", "m.metadata", "m.blocks")


def first_layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of documents with session, messages and parts, and of imports: lines of messages with their parts inside."""
    top = F.col("top")
    session = obj(C.get(top, "session"))
    is_doc = C.get(top, "session").isNotNull()
    docs = docs.withColumn("rows", F.when(is_doc, F.filter(variants(C.get(top, "messages")), lambda x: C.kind(x) == "OBJECT")).otherwise(legacy_rows(F.col("raw"))))
    turns = docs.select("locator", is_doc.alias("doc"), F.posexplode("rows").alias("turn", "row")).withColumn("id", id_of(C.get(F.col("row"), "id")))
    parts = docs.select("locator", F.posexplode(F.filter(variants(C.get(top, "parts")), lambda x: C.kind(x) == "OBJECT")).alias("place", "p"))
    parts = parts.groupBy("locator", id_of(C.get(F.col("p"), "message_id")).alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", F.to_json("p").alias("p")))).alias("own"))  # a turn's parts
    turns = turns.join(parts, ["locator", "id"], "left")
    inner = F.filter(variants(C.get(F.col("row"), "parts")), lambda x: C.kind(x) == "OBJECT")
    listed = F.coalesce(F.transform("own", lambda x: F.parse_json(x["p"])), F.array().cast("array<variant>"))
    turns = turns.withColumn("parts", F.transform(F.when(F.col("doc"), listed).otherwise(inner), lambda p: F.struct(C.get(p, "id").alias("id"), data_of(C.get(p, "data")).alias("data"))))
    turns = turns.withColumn("data", data_of(C.get(F.col("row"), "data")))
    data, time = F.col("data"), obj(C.get(F.col("data"), "time"))
    info = obj(C.get(data, "model"))
    named = lambda key: F.when(info.isNotNull(), C.or_other(C.get(info, key), C.get(data, key))).otherwise(C.get(data, key))
    role = F.when(txt(data, "role") == "user", "user").otherwise("assistant")
    model = F.when(role == "assistant", str_of(named("modelID")))
    metadata = C.optional_object(provider_id=true_text(named("providerID")), **{k: true_text(C.get(data, k)) for k in ("agent", "mode", "tokens")})
    turns = turns.withColumns({"role": role, "model": model, "metadata": metadata, "created_at": millis(C.or_other(C.get(time, "created"), C.get(F.col("row"), "time_created"))), "done": millis(C.get(time, "completed"))})

    def result(state: Column) -> Column:
        inner = C.get(obj(C.get(state, "metadata")), "output")
        return C.let(C.get(state, "output"), lambda output: str_of(F.when(output.isNull() | F.is_variant_null(output), inner).otherwise(output)))

    def part(x: Column) -> Column:
        tool = F.coalesce(txt(x, "type") == "tool", F.lit(False))
        made = F.when(tool, tool_messages(x, txt(x, "callID"), txt(x, "tool"), F.col("model"), result, ("completed",)))
        return F.struct(tool.alias("tool"), part_blocks(x, "start", "end").alias("blocks"), made.alias("messages"))

    turns = turns.withColumn("items", F.transform("parts", lambda p: part(p["data"])))
    turns = turns.withColumn("made", split_turn(F.col("items"), F.col("id"), F.col("role"), F.col("model"), F.col("metadata")))
    raw_parts = F.transform("parts", lambda p: C.object_text(id=F.to_json(p["id"]), data=F.to_json(p["data"])))
    raw = C.object_text(id=F.to_json(C.get(F.col("row"), "id")), data=F.to_json(data), time_created=F.to_json(C.get(F.col("row"), "time_created")), parts=F.concat(F.lit("["), F.array_join(raw_parts, ","), F.lit("]")))
    project = F.when(is_doc, txt(session, "directory")).otherwise(F.when(F.col("project_hint") != "", F.col("project_hint")))
    conversations = docs.select("locator", "path", txt(session, "title").alias("title"), project.alias("project"), F.lit("{}").alias("metadata"), F.lit(False).alias("second"))
    return conversations, turns.select("locator", "turn", "created_at", "done", "made", raw.alias("raw"))


def second_layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of documents with session_v2 and session_message."""
    session = obj(C.get(F.col("top"), "session_v2"))
    rows = F.filter(variants(C.get(F.col("top"), "session_message")), lambda x: C.kind(x) == "OBJECT")
    turns = docs.select("locator", data_of(C.get(session, "model")).alias("session_model"), F.posexplode(rows).alias("turn", "row"))
    row = F.col("row")
    turns = turns.withColumns({"data": data_of(C.get(row, "data")), "id": id_of(C.get(row, "id")), "type": txt(row, "type")})
    data, time = F.col("data"), obj(C.get(F.col("data"), "time"))
    info = F.coalesce(obj(C.get(data, "model")), F.col("session_model"))
    metadata = C.optional_object(provider_id=true_text(C.get(info, "providerID")), **{k: true_text(C.get(data, k)) for k in ("agent", "mode", "tokens")})
    turns = turns.withColumns({"model": txt(info, "id"), "metadata": metadata, "created_at": millis(C.or_other(C.get(time, "created"), C.get(row, "time_created"))), "done": millis(C.get(time, "completed"))})

    def attachment(x: Column) -> Column:
        names = [C.non_empty(obj(x), k) for k in ("filename", "name", "path", "url")]
        return block("attachment", F.coalesce(*names), payload=C.object_text(file=F.to_json(x)))

    def result(state: Column) -> Column:
        texts = F.filter(F.transform(F.filter(C.items_of(C.get(state, "content")), lambda y: txt(y, "type") == "text"), lambda y: txt(y, "text")), lambda t: t.isNotNull())
        listed = C.let(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n")))
        return F.coalesce(listed, txt(state, "output"), txt(obj(C.get(state, "metadata")), "output"), txt(state, "error"))

    def item(x: Column) -> Column:
        tool = F.coalesce(txt(x, "type") == "tool", F.lit(False))
        made = F.when(tool, tool_messages(x, txt(x, "id"), txt(x, "name"), F.col("model"), result, ("completed", "error")))
        return F.struct(tool.alias("tool"), part_blocks(x, "created", "completed").alias("blocks"), made.alias("messages"))

    text = C.get(data, "text")
    none = F.lit(None).cast("string")
    said = F.concat(F.when(C.truthy(text), F.array(block("text", str_of(text)))).otherwise(no_blocks()), F.transform(variants(C.get(data, "files")), attachment))
    turns = turns.withColumn("items", F.transform(F.filter(variants(C.get(data, "content")), lambda x: C.kind(x) == "OBJECT"), item))
    told = split_turn(F.col("items"), F.col("id"), F.lit("assistant"), F.col("model"), F.col("metadata"))
    made = F.when(F.col("type") == "assistant", told).when(F.col("type").isin("user", "system") & (F.size(said) > 0), F.array(message(F.col("id"), F.col("type"), none, F.lit("{}"), said)))
    members = F.map_concat(F.map_filter(F.try_variant_get(row, "$", "map<string, variant>"), lambda k, v: k != "data"), F.create_map(F.lit("data"), data))
    turns = turns.withColumns({"made": made, "raw": F.to_json(F.parse_json(F.to_json(members)))})
    conversations = docs.select("locator", "path", txt(session, "title").alias("title"), txt(session, "directory").alias("project"), F.lit('{"schema":"v2"}').alias("metadata"), F.lit(True).alias("second"))
    heads = docs.select("locator", F.lit(-1).alias("turn"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("done"), F.lit(None).cast(f"array<{MESSAGE}>").alias("made"), F.to_json(session).alias("raw"))
    return conversations, turns.select(heads.columns).unionByName(heads)


def parse_sessions(handles: DataFrame) -> Parsed:
    """Sessions of both relational layouts; the document tells which."""
    docs = documents(handles)
    newer = F.coalesce(C.kind(C.get(F.col("top"), "session_v2")) != "VOID", F.lit(False))
    one, two = first_layout(docs.where(~newer)), second_layout(docs.where(newer))
    # Documents are parsed once: all tables that are made of the turns read what is written here, and their plans stay small.
    conversations, turns = (scratch.save(a.unionByName(b), name) for a, b, name in zip(one, two, ("sessions", "turns"), strict=True))
    found = conversations.join(turn_span(turns), "locator", "left").withColumnRenamed("path", "raw_path")
    first = F.when(F.col("second"), 1).otherwise(0)  # the session's row is the first event of the second layout
    lines = turns.join(conversations.select("locator", "path", "second"), "locator")
    events = lines.select("locator", "path", (F.col("turn") + first).alias("line"), "raw")
    untitled = F.col("second") & (F.col("title").isNull() | (F.col("title") == ""))
    return parsed("opencode", "1", handles, found, flat_messages(turns.where("made is not null")), events, untitled)


def seconds(v: Column) -> Column:
    return C.unix_time(F.coalesce(C.number_of(v), F.trim(str_of(v)).try_cast("double")))


def parse_hermes(handles: DataFrame) -> Parsed:
    """Sessions with messages of another agent's tables, and imports: the session's row and its messages' rows as lines."""
    docs = documents(handles)
    is_doc = F.coalesce(C.kind(C.get(F.col("top"), "session")) != "VOID", F.lit(False))
    lines = legacy_rows(F.col("raw"))
    docs = docs.withColumn("session", F.when(is_doc, obj(C.get(F.col("top"), "session"))).otherwise(F.get(lines, F.lit(0))))
    docs = docs.withColumn("rows", F.when(is_doc, variants(C.get(F.col("top"), "messages"))).otherwise(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))).where("session is not null")
    session = F.col("session")
    every = docs.select("locator", "path", "session", F.posexplode("rows").alias("at", "row"))
    row = F.col("row")
    rows = every.where((C.kind(row) == "OBJECT") & (C.truthy(C.get(row, "active")) | C.truthy(C.get(row, "compacted"))))
    role = txt(row, "role")
    calls = C.items_of(C.parsed(txt(row, "tool_calls")))

    def call(x: Column) -> Column:
        function = obj(C.get(x, "function"))
        id_ = str_of(C.or_other(C.get(x, "id"), C.get(x, "call_id")))
        return block("tool_use", None, txt(function, "name"), id_, C.object_text(arguments=or_default(function, "arguments", '""')))

    usable = F.filter(calls, lambda x: obj(C.get(x, "function")).isNotNull() | ~C.truthy(C.get(x, "function")))
    used = F.when(role == "assistant", F.coalesce(F.transform(usable, call), no_blocks())).otherwise(no_blocks())
    text = F.when(C.truthy(C.get(row, "content")), str_of(C.get(row, "content")))
    said = F.when(C.truthy(C.get(row, "content")), F.array(block("text", text))).otherwise(no_blocks())
    reasoning = C.or_other(C.get(row, "reasoning"), C.get(row, "reasoning_content"))
    thought = F.when((role == "assistant") & C.truthy(reasoning), F.array(block("thinking", str_of(reasoning)))).otherwise(no_blocks())
    result = F.array(block("tool_result", text, txt(row, "tool_name"), txt(row, "tool_call_id")))
    text_null = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    metadata = C.optional_object(
        hermes_message_id=text_null(C.get(row, "id")),
        finish_reason=text_null(C.get(row, "finish_reason")),
        source=text_null(C.get(session, "source")),
        profile_name=text_null(C.get(session, "profile_name")),
        compacted=F.when(C.truthy(C.get(row, "compacted")), "true"),
        compressed_summary=F.when(C.truthy(C.get(row, "_compressed_summary")), "true"),
    )
    messages = rows.where(role.isin("user", "assistant", "system", "tool")).select(
        "locator",
        "at",
        id_of(C.get(row, "id")).alias("source_native_id"),
        F.lit(None).cast("string").alias("parent_source_native_id"),
        role.alias("role"),
        F.when(role == "assistant", txt(session, "model")).alias("model"),
        seconds(C.get(row, "timestamp")).alias("created_at"),
        metadata.alias("metadata"),
        F.when(role == "tool", result).otherwise(F.concat(used, said, thought)).alias("blocks"),
    )
    title = C.or_other(C.get(session, "title"), C.get(session, "display_name"))
    about = C.object_text(
        hermes_source=F.to_json(C.get(session, "source")), model=F.to_json(C.get(session, "model")), session_message_count=F.to_json(C.get(session, "message_count")), tool_call_count=F.to_json(C.get(session, "tool_call_count"))
    )
    times = messages.where(F.size("blocks") > 0).groupBy("locator").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    own = docs.select("locator", F.col("path").alias("raw_path"), str_of(title).alias("title"), txt(session, "cwd").alias("project"), about.alias("metadata"), seconds(C.get(session, "started_at")).alias("begun"), seconds(C.get(session, "ended_at")).alias("done"))
    whole = F.col("begun").isNotNull() & F.col("done").isNotNull()
    conversations = own.join(times, "locator", "left").select(
        "locator", "raw_path", "title", "project", "metadata", F.when(whole, F.col("begun")).otherwise(F.least("begun", "first")).alias("started_at"), F.when(whole, F.col("done")).otherwise(F.greatest("done", "last")).alias("ended_at")
    )
    head = docs.select("locator", "path", F.lit(0).alias("line"), F.to_json("session").alias("raw"))
    events = head.unionByName(every.select("locator", "path", (F.col("at") + 1).alias("line"), F.to_json("row").alias("raw")))
    return parsed("hermes_agent", "1", handles, conversations, messages, events, F.col("title").isNull() | (F.col("title") == ""))
