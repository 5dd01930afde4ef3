"""Usage analytics over an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..archive import Archive


def tool_calls(a: Archive) -> DataFrame:
    """tool_use blocks with their message and conversation."""
    b = a.content_blocks.where("type = 'tool_use'").select(F.col("id").alias("call_id"), "tool_use_id", "tool_name", F.get_json_object("payload", "$.input").alias("input"), "message_id")
    m = a.messages.select(F.col("id").alias("message_id"), "conversation_id", "created_at")
    c = a.conversations.select(F.col("id").alias("conversation_id"), "project", "source_id")
    return b.join(m, "message_id").join(c, "conversation_id").select("call_id", "tool_use_id", "tool_name", "input", "message_id", "conversation_id", "created_at", "project", "source_id")


def _of_known_sources(a: Archive) -> DataFrame:
    """(conversation_id, source) of conversations whose source is registered."""
    return a.conversations.select(F.col("id").alias("conversation_id"), F.col("source_id").alias("source")).join(a.sources.select(F.col("id").alias("source")), "source")


def activity(a: Archive, by: str = "day", source: str | None = None) -> DataFrame:
    """Messages and conversations per source and day, week or month, newest first."""
    if by not in ("day", "week", "month"):
        raise ValueError("by is day, week or month")
    m = a.messages.where("created_at is not null").select("conversation_id", F.date_trunc(by, "created_at").alias("period")).join(_of_known_sources(a), "conversation_id")
    if source:
        m = m.where(F.col("source") == source)
    return m.groupBy("source", "period").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conversation_id").alias("conversations")).orderBy(F.desc("period"), "source")


def activity_monthly(a: Archive) -> DataFrame:
    return activity(a, "month").select("source", F.col("period").alias("month"), "messages").orderBy(F.desc("month"), "source")


def tools(a: Archive, source: str | None = None) -> DataFrame:
    """Calls and conversations per named tool."""
    calls = tool_calls(a).where("tool_name is not null")
    if source:
        calls = calls.where(F.col("source_id") == source)
    return _per_tool(calls).orderBy(F.desc("calls"), "tool_name")


def _per_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("conversation_id").alias("conversations"))


def tool_frequency(a: Archive) -> DataFrame:
    """The same, with calls whose tool has no name as a row of their own."""
    return _per_tool(tool_calls(a)).orderBy(F.desc("calls"), F.asc_nulls_last("tool_name"))


def conversations_by_length(a: Archive, longest: int | None = None, shortest: int | None = None) -> DataFrame:
    """The longest (20, unless told) or the shortest conversations."""
    if longest is not None and shortest is not None:
        raise ValueError("longest and shortest exclude each other")
    limit = shortest if shortest is not None else longest if longest is not None else 20
    order = F.asc("message_count") if shortest is not None else F.desc("message_count")
    c = a.conversations.withColumnRenamed("source_id", "source").join(a.sources.select(F.col("id").alias("source")), "source")
    return c.select("title", "source", "project", "message_count", "started_at", "ended_at").orderBy(order, F.asc_nulls_last("started_at"), F.asc_nulls_last("title")).limit(limit)


def models(a: Archive) -> DataFrame:
    m = a.messages.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conversation_id").alias("conversations"))
    return m.orderBy(F.desc("messages"), "model")


def model_counts(a: Archive) -> DataFrame:
    return a.messages.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), "model")


def projects(a: Archive, source: str = "claude_code") -> DataFrame:
    c = a.conversations.where((F.col("source_id") == source) & F.col("project").isNotNull()).groupBy("project")
    c = c.agg(F.count(F.lit(1)).alias("conversations"), F.sum("message_count").alias("total_messages"), F.min("started_at").alias("earliest"), F.max("ended_at").alias("latest"))
    return c.orderBy(F.desc("conversations"), "project")


def project_totals(a: Archive) -> DataFrame:
    """Conversations and messages per project, over all sources."""
    return a.conversations.groupBy("project").agg(F.count(F.lit(1)).alias("conversations"), F.sum("message_count").alias("total_messages")).orderBy(F.desc("total_messages"), F.asc_nulls_last("project"))


def source_stats(a: Archive) -> DataFrame:
    """Conversations and their time span per source; sources without any are kept."""
    c = a.conversations.select(F.col("source_id").alias("id"), F.col("id").alias("conversation"), "started_at", "ended_at")
    out = a.sources.select("id", "name").join(c, "id", "left").groupBy("id", "name")
    return out.agg(F.count("conversation").alias("conversations"), F.min("started_at").alias("earliest"), F.max("ended_at").alias("latest")).orderBy("id")


def source_counts(a: Archive) -> DataFrame:
    return a.conversations.groupBy("source_id").agg(F.count(F.lit(1)).alias("conversations")).orderBy("source_id")


def totals(a: Archive) -> DataFrame:
    """One row: conversations, messages, blocks and tool calls."""
    counts = [
        a.conversations.select(F.lit("conversations").alias("what")),
        a.messages.select(F.lit("messages").alias("what")),
        a.content_blocks.select(F.when(F.col("type") == "tool_use", "tool_calls").otherwise("blocks").alias("what")),
    ]
    n = lambda *names: F.count_if(F.col("what").isin(*names))
    return reduce(DataFrame.unionByName, counts).agg(n("conversations").alias("conversations"), n("messages").alias("messages"), n("blocks", "tool_calls").alias("blocks"), n("tool_calls").alias("tool_calls"))


def length_distribution(a: Archive) -> DataFrame:
    n = F.col("message_count")
    bucket = F.when(n < 5, "very short (< 5)").when(n < 20, "short (5-19)").when(n < 50, "medium (20-49)").otherwise("long (50+)")
    return a.conversations.groupBy(bucket.alias("length_bucket")).agg(F.count(F.lit(1)).alias("conversations")).orderBy(F.desc("conversations"), "length_bucket")


def shell_commands(a: Archive, tool: str = "Bash", source: str = "claude_code", path: str = "$.command", limit: int = 50) -> DataFrame:
    """How often each command was run, per project: the most frequent ones."""
    calls = tool_calls(a).where((F.col("tool_name") == tool) & (F.col("source_id") == source))
    out = calls.groupBy("project", F.get_json_object("input", path).alias("command")).agg(F.count(F.lit(1)).alias("times_run"))
    return out.orderBy(F.desc("times_run"), F.asc_nulls_last("project"), F.asc_nulls_last("command")).limit(limit)


def prompt_words_weekly(a: Archive) -> DataFrame:
    """The mean number of spaces in what users wrote, by week."""
    texts = a.content_blocks.where("type = 'text' and text is not null").select("message_id", "text")
    m = a.messages.where("role = 'user'").select(F.col("id").alias("message_id"), F.date_trunc("week", "created_at").alias("week"))
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return texts.join(m, "message_id").groupBy("week").agg(F.avg(spaces).alias("avg_word_count")).orderBy(F.asc_nulls_last("week"))


def keyword_conversations(a: Archive, keyword: str, limit: int = 20) -> DataFrame:
    """The newest conversations in which a block matches the keyword, whatever its case; % and _ are wildcards."""
    hits = a.content_blocks.where(F.col("text").ilike(f"%{escaped(keyword)}%")).select("message_id")
    found = a.messages.select(F.col("id").alias("message_id"), "conversation_id").join(hits, "message_id", "left_semi").select("conversation_id")
    c = a.conversations.join(found, a.conversations["id"] == found["conversation_id"], "left_semi").withColumnRenamed("source_id", "source").join(a.sources.select(F.col("id").alias("source")), "source")
    return c.select("started_at", "source", "project", "title").orderBy(F.desc("started_at"), F.asc_nulls_last("title")).limit(limit)


def escaped(pattern: str) -> str:
    """A LIKE pattern in which a backslash stands for itself."""
    return pattern.replace("\\", "\\\\")


def thinking_share(a: Archive) -> DataFrame:
    """Thinking blocks per hundred assistant messages, by month."""
    m = a.messages.where("role = 'assistant'").select(F.col("id").alias("message_id"), F.date_trunc("month", "created_at").alias("month"))
    b = a.content_blocks.select("message_id", (F.col("type") == "thinking").alias("thinking"))
    out = m.join(b, "message_id", "left").groupBy("month").agg(F.sum(F.when(F.col("thinking"), 1).otherwise(0)).alias("thinking_blocks"), F.count_distinct("message_id").alias("assistant_messages"))
    return out.withColumn("pct", F.round(100.0 * F.col("thinking_blocks") / F.nullif("assistant_messages", F.lit(0)), 1)).orderBy(F.desc("month"))


def recent_conversations(a: Archive, limit: int = 10) -> DataFrame:
    return a.conversations.select("title", F.col("source_id").alias("source"), "project", "message_count", "started_at").orderBy(F.desc("started_at"), F.asc_nulls_last("title")).limit(limit)


def fingerprint(a: Archive) -> DataFrame:
    """What two archives must share to hold the same conversations and messages: counts and order-free sums of id hashes."""
    part = lambda df, name: df.select(F.lit(name).alias("table_name"), F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    rows = part(a.conversations, "conversations").unionByName(part(a.messages, "messages"))
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("string").alias("id_sum")).orderBy("table_name")


def describe_archive(a: Archive) -> DataFrame:
    """A row per column of every table: position, type, nullability, and the table's rows."""
    spark = a.messages.sparkSession
    tables = a.tables() | {"tool_calls": a.tool_calls}
    columns = [(t, k, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    described = spark.createDataFrame(columns, "table_name string, position int, column_name string, data_type string, nullable boolean")
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("table_name", F.lit(t)) for t, df in tables.items()])
    return described.join(counts, "table_name").orderBy("table_name", "position")
