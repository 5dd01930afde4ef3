"""The library's own queries, by name, and their SQL for comparison.

Archives come from the given tables: `events` as tool calls, `conversations` rendered as transcripts and normalised again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import SCHEMAS
from ..operators import analytics as A
from ..sources.render import RENDERERS
from .archives import of_events, of_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The events table as archive tables, in SQL.
EVENTS = """
    WITH sources AS (SELECT unnest(['claude_code', 'codex_cli', 'omp']) AS id),
    messages AS (
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS conversation_id, CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role,
            CASE WHEN event_id % 4 != 0 THEN 'model-' || event_type END AS model, ts AS created_at
        FROM events
    ),
    conversations AS (
        SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 3 = 0 THEN 'codex_cli' ELSE 'claude_code' END AS source_id, 'User ' || user_id AS title,
            CASE WHEN user_id % 5 != 0 THEN '/p' || (user_id % 11) END AS project, min(ts) AS started_at, max(ts) AS ended_at, CAST(count(*) AS INTEGER) AS message_count
        FROM events GROUP BY user_id
    ),
    content_blocks AS (
        SELECT 'b' || event_id AS id, CAST(event_id AS VARCHAR) AS message_id, CASE WHEN event_id % 7 = 0 THEN 'thinking' ELSE 'tool_use' END AS type,
            CASE WHEN event_id % 7 = 0 THEN event_type END AS text, CASE WHEN event_id % 13 != 0 THEN event_type END AS tool_name, props
        FROM events
    ),
    tool_calls AS (
        SELECT b.tool_name, b.props, m.conversation_id, c.project, c.source_id
        FROM content_blocks b JOIN messages m ON m.id = b.message_id JOIN conversations c ON c.id = m.conversation_id WHERE b.type = 'tool_use'
    )
"""

#: The conversations table as archive tables after it went through claude_code transcripts, in SQL.
TURNS = r"""
    WITH t AS (
        SELECT conv_id, turn, role, text, 'conv-' || conv_id AS conv, 'c' || conv_id || '-t' || turn AS native, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn) AS made_at,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, string_split(regexp_replace(regexp_replace(text, '^[\s]+|[\s]+$', '', 'g'), '[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))[1] AS line
        FROM conversations
    ),
    titles AS (SELECT conv_id, left(arg_min(line, turn), 200) AS title FROM t WHERE role = 'user' AND text != '' AND line != '' GROUP BY conv_id)
"""


def sid(kind: str, *parts: str) -> str:
    """The stable id in SQL."""
    h = f"sha256('{kind}'" + "".join(f" || chr(0) || {p}" for p in parts) + ")"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


for _by in ("day", "week", "month"):
    register(
        f"activity_{_by}",
        f"{EVENTS} SELECT s.id AS source, date_trunc('{_by}', m.created_at)::TIMESTAMP AS period, count(*) AS messages, count(DISTINCT m.conversation_id) AS conversations FROM messages m JOIN conversations c ON c.id = m.conversation_id JOIN sources s ON s.id = c.source_id WHERE m.created_at IS NOT NULL GROUP BY ALL",
    )(lambda spark, sf_dir, by=_by: A.activity(of_events(spark, sf_dir), by))


@register("activity_one_source", f"{EVENTS} SELECT s.id AS source, date_trunc('day', m.created_at)::TIMESTAMP AS period, count(*) AS messages, count(DISTINCT m.conversation_id) AS conversations FROM messages m JOIN conversations c ON c.id = m.conversation_id JOIN sources s ON s.id = c.source_id WHERE s.id = 'codex_cli' GROUP BY ALL")
def activity_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity(of_events(spark, sf_dir), "day", "codex_cli")


@register("activity_monthly", f"{EVENTS} SELECT s.id AS source, date_trunc('month', m.created_at)::TIMESTAMP AS month, count(*) AS messages FROM messages m JOIN conversations c ON c.id = m.conversation_id JOIN sources s ON s.id = c.source_id GROUP BY ALL")
def activity_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity_monthly(of_events(spark, sf_dir))


@register("tools", f"{EVENTS} SELECT tool_name, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM tool_calls WHERE tool_name IS NOT NULL GROUP BY ALL")
def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tools(of_events(spark, sf_dir))


@register("tools_one_source", f"{EVENTS} SELECT tool_name, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM tool_calls WHERE tool_name IS NOT NULL AND source_id = 'claude_code' GROUP BY ALL")
def tools_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tools(of_events(spark, sf_dir), "claude_code")


@register("tool_frequency", f"{EVENTS} SELECT tool_name, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM tool_calls GROUP BY ALL")
def tool_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tool_frequency(of_events(spark, sf_dir))


@register("tool_calls", f"{EVENTS} SELECT tool_name, source_id, project, count(*) AS calls FROM tool_calls GROUP BY ALL")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_events(spark, sf_dir).tool_calls.groupBy("tool_name", "source_id", "project").agg(F.count(F.lit(1)).alias("calls"))


for _name, _order, _arguments in (("longest", "DESC", {"longest": 15}), ("shortest", "ASC", {"shortest": 15})):
    register(_name, f"{EVENTS} SELECT c.title, s.id AS source, c.project, c.message_count, c.started_at, c.ended_at FROM conversations c JOIN sources s ON s.id = c.source_id ORDER BY c.message_count {_order}, c.started_at, c.title LIMIT 15")(
        lambda spark, sf_dir, arguments=_arguments: A.conversations_by_length(of_events(spark, sf_dir), **arguments)
    )


@register("models", f"{EVENTS} SELECT model, count(*) AS messages, count(DISTINCT conversation_id) AS conversations FROM messages WHERE model IS NOT NULL GROUP BY ALL")
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.models(of_events(spark, sf_dir))


@register("model_counts", f"{EVENTS} SELECT model, count(*) AS messages FROM messages WHERE model IS NOT NULL GROUP BY ALL")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.model_counts(of_events(spark, sf_dir))


@register("projects", f"{EVENTS} SELECT project, count(*) AS conversations, CAST(sum(message_count) AS BIGINT) AS total_messages, min(started_at) AS earliest, max(ended_at) AS latest FROM conversations WHERE source_id = 'claude_code' AND project IS NOT NULL GROUP BY ALL")
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.projects(of_events(spark, sf_dir))


@register("project_totals", f"{EVENTS} SELECT project, count(*) AS conversations, CAST(sum(message_count) AS BIGINT) AS total_messages FROM conversations GROUP BY ALL")
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.project_totals(of_events(spark, sf_dir))


@register("source_stats", f"{EVENTS} SELECT s.id, upper(s.id) AS name, count(c.id) AS conversations, min(c.started_at) AS earliest, max(c.ended_at) AS latest FROM sources s LEFT JOIN conversations c ON c.source_id = s.id GROUP BY s.id")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.source_stats(of_events(spark, sf_dir))


@register("source_counts", f"{EVENTS} SELECT source_id, count(*) AS conversations FROM conversations GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.source_counts(of_events(spark, sf_dir))


@register("totals", f"{EVENTS} SELECT (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM content_blocks) AS blocks, (SELECT count(*) FROM content_blocks WHERE type = 'tool_use') AS tool_calls")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(of_events(spark, sf_dir))


@register(
    "length_distribution",
    "SELECT CASE WHEN n < 5 THEN 'very short (< 5)' WHEN n < 20 THEN 'short (5-19)' WHEN n < 50 THEN 'medium (20-49)' ELSE 'long (50+)' END AS length_bucket, count(*) AS conversations FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY ALL",
)
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.length_distribution(of_turns(spark, sf_dir))


@register("shell_commands", f"{EVENTS} SELECT project, json_extract_string(props, '$.k') AS command, count(*) AS times_run FROM tool_calls WHERE tool_name = 'click' AND source_id = 'claude_code' GROUP BY ALL ORDER BY times_run DESC, project NULLS LAST, command NULLS LAST LIMIT 50")
def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shell_commands(of_events(spark, sf_dir), "click", "claude_code", "$.k", 50)


@register("prompt_words_weekly", f"{TURNS} SELECT date_trunc('week', made_at)::TIMESTAMP AS week, round(avg(length(text) - length(replace(text, ' ', ''))), 6) AS avg_word_count FROM t WHERE role = 'user' GROUP BY ALL")
def prompt_words_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prompt_words_weekly(of_turns(spark, sf_dir)).withColumn("avg_word_count", F.round("avg_word_count", 6))


@register(
    "keyword_conversations",
    f"{TURNS} SELECT min(made_at) AS started_at, 'claude_code' AS source, '/work/p' || (conv_id % 7) AS project, any_value(title) AS title FROM t LEFT JOIN titles USING (conv_id) GROUP BY conv_id HAVING bool_or(text ILIKE '%tion the%') ORDER BY started_at DESC, title LIMIT 20",
)
def keyword_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_conversations(of_turns(spark, sf_dir), "tion the")


@register(
    "thinking_share",
    f"{EVENTS} SELECT date_trunc('month', m.created_at)::TIMESTAMP AS month, CAST(sum(CASE WHEN b.type = 'thinking' THEN 1 ELSE 0 END) AS BIGINT) AS thinking_blocks, count(DISTINCT m.id) AS assistant_messages, CAST(round(100.0 * sum(CASE WHEN b.type = 'thinking' THEN 1 ELSE 0 END) / nullif(count(DISTINCT m.id), 0), 1) AS DOUBLE) AS pct FROM messages m LEFT JOIN content_blocks b ON b.message_id = m.id WHERE m.role = 'assistant' GROUP BY ALL",
)
def thinking_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.thinking_share(of_events(spark, sf_dir))


@register("recent_conversations", f"{EVENTS} SELECT title, source_id AS source, project, message_count, started_at FROM conversations ORDER BY started_at DESC, title LIMIT 10")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_conversations(of_events(spark, sf_dir))


@register("fingerprint", f"{EVENTS} SELECT table_name, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(id), 1, 12)) AS BIGINT)) AS VARCHAR) AS id_sum FROM (SELECT 'conversations' AS table_name, id FROM conversations UNION ALL SELECT 'messages', id FROM messages) GROUP BY ALL")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fingerprint(of_events(spark, sf_dir))


def described_sql() -> str:
    """The columns of the archive that of_events() makes: those of SCHEMAS, times without a zone as in the events."""
    stated = {"sources": "id name adapter_version config", "conversations": "source_id message_count raw_path metadata", "messages": "role metadata", "content_blocks": "block_index type", "raw_events": "source_id raw_path", "tool_calls": "source_id"}
    calls = "call_id string, tool_use_id string, tool_name string, input string, message_id string, conversation_id string, created_at timestamp, project string, source_id string"
    times = ("started_at", "ended_at", "created_at")
    rows = [
        f"('{table}', {k}, '{name}', '{'timestamp_ntz' if name in times else type_}', {str(name not in stated[table].split()).lower()})"
        for table, schema in (SCHEMAS | {"tool_calls": calls}).items()
        for k, (name, type_) in enumerate(c.split() for c in schema.split(", "))
    ]
    counts = "SELECT 'sources' AS table_name, count(*) AS table_rows FROM sources UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT unnest(['messages', 'content_blocks', 'raw_events']), count(*) FROM events UNION ALL SELECT 'tool_calls', count(*) FROM tool_calls"
    return f"{EVENTS}, n AS ({counts}) SELECT d.*, table_rows FROM (VALUES {', '.join(rows)}) d(table_name, position, column_name, data_type, nullable) JOIN n USING (table_name)"


@register("describe_archive", described_sql())
def describe_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.describe_archive(of_events(spark, sf_dir))


#: What each layout carries of a turn: its role there (null: dropped), the model, the project and the title.
_LAYOUT = {
    "claude_code": ("role", "/work/p' || (conv_id % 7) || '", "title"),
    "codex_cli": ("CASE WHEN role IN ('user', 'assistant') THEN role END", "/work", "title"),
    "omp": ("CASE WHEN role IN ('user', 'assistant') THEN role END", "/work", "'Session conv-' || conv_id"),
    "claude_export": ("CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END", None, "'Chat conv-' || conv_id"),
    "opencode": ("CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END", "/work", "'Session conv-' || conv_id"),
    "opencode_v2": ("role", "/work", "'Session conv-' || conv_id"),
    "hermes_agent": ("role", "/work", "'Session conv-' || conv_id"),
}


def _ingest(source: str) -> None:
    role, project, title = _LAYOUT[source]
    kept = f"{TURNS}, k AS (SELECT * REPLACE ({role} AS role), row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM t WHERE ({role}) IS NOT NULL AND text != '')"
    every = "t" if source in ("codex_cli",) else "k"
    conversation = sid("conversation", f"'{source.removesuffix('_v2')}'", "conv")
    message = sid("message", conversation, "native")
    register(
        f"ingest_{source}_conversations",
        f"{kept}, s AS (SELECT conv_id, any_value(conv) AS conv, min(made_at) AS started_at, max(made_at) AS ended_at FROM {every} GROUP BY conv_id), c AS (SELECT conv_id, count(*) AS n FROM k GROUP BY conv_id)"
        f" SELECT {conversation} AS id, conv AS source_native_id, {title} AS title, {'NULL::VARCHAR' if project is None else f"'{project}'"} AS project, started_at, ended_at, CAST(coalesce(c.n, 0) AS INTEGER) AS message_count FROM s LEFT JOIN titles USING (conv_id) LEFT JOIN c USING (conv_id)",
    )(lambda spark, sf_dir: of_turns(spark, sf_dir, source).conversations.select("id", "source_native_id", "title", "project", "started_at", "ended_at", "message_count"))
    register(
        f"ingest_{source}_messages",
        f"{kept} SELECT {message} AS id, {conversation} AS conversation_id, native AS source_native_id, role, {'NULL::VARCHAR' if source == 'claude_export' else "CASE WHEN role = 'assistant' THEN 'model-a' END"} AS model, made_at AS created_at, CAST(n AS INTEGER) AS sequence_index FROM k",
    )(lambda spark, sf_dir: of_turns(spark, sf_dir, source).messages.select("id", "conversation_id", "source_native_id", "role", "model", "created_at", "sequence_index"))
    register(
        f"ingest_{source}_blocks",
        f"{kept} SELECT {sid('block', message, "'0'")} AS id, {message} AS message_id, 0::INTEGER AS block_index, 'text' AS type, text FROM k",
    )(lambda spark, sf_dir: of_turns(spark, sf_dir, source).content_blocks.select("id", "message_id", "block_index", "type", "text"))


for _source in RENDERERS:
    _ingest(_source)


@register(
    "message_parents",
    f"{TURNS} SELECT native AS source_native_id, {sid('message', sid('conversation', "'claude_code'", 'conv'), 'p.parent')} AS parent_message_id FROM (SELECT *, CASE WHEN turn > 0 THEN 'c' || conv_id || '-t' || (turn - 1) END AS parent FROM t) p WHERE parent IN (SELECT native FROM t) UNION ALL SELECT native, NULL FROM (SELECT *, CASE WHEN turn > 0 THEN 'c' || conv_id || '-t' || (turn - 1) END AS parent FROM t) WHERE parent IS NULL OR parent NOT IN (SELECT native FROM t)",
)
def message_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_turns(spark, sf_dir).messages.select("source_native_id", "parent_message_id")


from . import merging, upkeep, written  # noqa: E402, F401  (their queries register here)
