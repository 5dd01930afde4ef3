"""Turns of conversations rendered as transcripts of every layout, by Spark; the inverse of the normalisers, for archives from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transcripts import session_documents_hermes, session_documents_v1, session_documents_v2

EPOCH = "2024-01-01 00:00:00"
MODEL = "model-a"


def with_keys(turns: DataFrame) -> DataFrame:
    """Adds conv, native, at: the conversation's and the turn's native ids, and a time from a fixed epoch."""
    seconds = F.col("conv_id") * 3600 + F.col("turn")
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("conv"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string")).alias("native"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + seconds).alias("at"),
    )


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def handles(rows: DataFrame, source: str, line: Column, path: Column, project: Column, head: Column | None = None) -> DataFrame:
    """One handle per conversation: its lines in order of turn, after a head line."""
    grouped = rows.select("conv", "turn", line.alias("line"), path.alias("path"), project.alias("project_hint"), (head if head is not None else F.lit(None).cast("string")).alias("head"))
    grouped = grouped.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"), F.any_value("path").alias("path"), F.any_value("project_hint").alias("project_hint"), F.any_value("head").alias("head"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    text = F.when(F.col("head").isNotNull(), F.concat("head", F.lit("\n"), text)).otherwise(text)
    return grouped.select(F.lit(source).alias("source_id"), F.lit("").alias("scope"), F.col("conv").alias("locator"), "path", "project_hint", F.lit(None).cast("double").alias("mtime"), text.cast("binary").alias("content"))


def claude_code(turns: DataFrame) -> DataFrame:
    t = with_keys(turns)
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct("role", F.when(F.col("role") == "assistant", MODEL).alias("model"), text.alias("content"))
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), (F.col("turn") - 1).cast("string")))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("native").alias("uuid"), parent.alias("parentUuid"), iso(F.col("at")).alias("timestamp"), F.concat(F.lit("/work/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), message.alias("message")))
    return handles(t, "claude_code", line, F.concat(F.lit("/x/-work/"), "conv", F.lit(".jsonl")), F.lit("/work"))


def codex_cli(turns: DataFrame) -> DataFrame:
    t = with_keys(turns)
    content = F.array(F.struct(F.when(F.col("role") == "assistant", "output_text").otherwise("input_text").alias("type"), F.col("text").alias("text")))
    payload = F.struct(F.lit("message").alias("type"), "role", F.col("native").alias("id"), content.alias("content"))
    line = F.to_json(F.struct(iso(F.col("at")).alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    context = F.struct(F.lit(MODEL).alias("model"), F.lit("/work").alias("cwd"))
    head = F.to_json(F.struct(F.lit("turn_context").alias("type"), context.alias("payload")))
    return handles(t, "codex_cli", line, F.concat(F.lit("/x/rollout-"), "conv", F.lit(".jsonl")), F.lit(None).cast("string"), head)


def omp(turns: DataFrame) -> DataFrame:
    t = with_keys(turns)
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct("role", text.alias("content"), F.when(F.col("role") == "assistant", MODEL).alias("model"))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.col("native").alias("id"), iso(F.col("at")).alias("timestamp"), message.alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("Session "), "conv").alias("title"), F.lit("/work").alias("cwd")))
    return handles(t, "omp", line, F.concat(F.lit("/x/s/t_"), "conv", F.lit(".jsonl")), F.lit(None).cast("string"), head)


def claude_export(turns: DataFrame) -> DataFrame:
    t = with_keys(turns)
    sender = F.when(F.col("role") == "user", "human").otherwise("assistant")
    message = F.struct("turn", F.col("native").alias("uuid"), sender.alias("sender"), "text", iso(F.col("at")).alias("created_at"))
    grouped = t.groupBy("conv").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    document = F.to_json(F.struct(F.col("conv").alias("uuid"), F.concat(F.lit("Chat "), "conv").alias("name"), "chat_messages"))
    return grouped.select(F.lit("claude_export").alias("source_id"), F.lit("").alias("scope"), F.col("conv").alias("locator"), F.lit("/x/conversations.json").alias("path"), F.lit(None).cast("string").alias("project_hint"), F.lit(None).cast("double").alias("mtime"), document.cast("binary").alias("content"))


def millis(at: Column) -> Column:
    return F.unix_timestamp(at) * 1000


def sessions_of(t: DataFrame, *more: Column) -> DataFrame:
    """A row per conversation with the columns that the relational layouts share."""
    first = t.groupBy("conv").agg(F.min("at").alias("at"))
    return first.select(F.col("conv").alias("id"), F.concat(F.lit("Session "), "conv").alias("title"), millis(F.col("at")).alias("time_created"), *more)


def opencode(turns: DataFrame) -> DataFrame:
    """The first relational layout: session, message and part tables."""
    t = with_keys(turns)
    time = F.struct(millis(F.col("at")).alias("created"))
    data = F.to_json(F.struct("role", time.alias("time"), F.when(F.col("role") != "user", MODEL).alias("modelID")))
    messages = t.select(F.col("native").alias("id"), F.col("conv").alias("session_id"), millis(F.col("at")).alias("time_created"), data.alias("data"))
    part = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    parts = t.select(F.concat("native", F.lit("-p")).alias("id"), F.col("native").alias("message_id"), F.col("conv").alias("session_id"), millis(F.col("at")).alias("time_created"), part.alias("data"))
    return session_documents_v1(sessions_of(t, F.lit("/work").alias("directory")), messages, parts)


def opencode_v2(turns: DataFrame) -> DataFrame:
    """The second relational layout: session_v2 and session_message tables."""
    t = with_keys(turns)
    time = F.struct(millis(F.col("at")).alias("created")).alias("time")
    content = F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")
    model = F.struct(F.lit(MODEL).alias("id")).alias("model")
    data = F.when(F.col("role") == "assistant", F.to_json(F.struct(time, content, model))).otherwise(F.to_json(F.struct(time, "text")))
    messages = t.select(F.col("native").alias("id"), F.col("conv").alias("session_id"), F.col("role").alias("type"), F.col("turn").alias("seq"), millis(F.col("at")).alias("time_created"), data.alias("data"))
    return session_documents_v2(sessions_of(t, F.lit("/work").alias("directory")), messages)


def hermes_agent(turns: DataFrame) -> DataFrame:
    """Another agent's sessions and messages tables."""
    t = with_keys(turns)
    none = F.lit(None).cast("double")
    sessions = sessions_of(t, F.lit("/work").alias("cwd"), F.lit(MODEL).alias("model"), F.lit("cli").alias("source"), none.alias("started_at"), none.alias("ended_at"))
    messages = t.select(F.col("native").alias("id"), F.col("conv").alias("session_id"), "role", F.col("text").alias("content"), F.unix_timestamp("at").cast("double").alias("timestamp"), F.lit(1).alias("active"), F.lit(0).alias("compacted"))
    return session_documents_hermes(sessions, messages)


RENDERERS = {"claude_code": claude_code, "codex_cli": codex_cli, "omp": omp, "claude_export": claude_export, "opencode": opencode, "opencode_v2": opencode_v2, "hermes_agent": hermes_agent}
