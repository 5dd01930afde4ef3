"""Queries of search, health checks and change detection, with their SQL; importing this module registers them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..archive import Archive
from ..operators import changes, health, search, text_index
from ..sources.normalize import NORMALIZERS
from ..sources.render import RENDERERS
from .archives import of_events, of_turns, table
from .queries import EVENTS, TURNS, register, sid

CONVERSATION = sid("conversation", "'claude_code'", "conv")
BLOCK = sid("block", sid("message", CONVERSATION, "native"), "'0'")


def bm25_sql(kept: str, words: tuple[str, ...]) -> str:
    """CTEs up to hit(native, score) over the turns that are kept."""
    listed = ", ".join(f"'{w}'" for w in words)
    return rf"""{TURNS}, d AS (SELECT * FROM t WHERE {kept}),
        tf AS (SELECT native, term, count(*) AS tf FROM (SELECT native, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM d) WHERE term != '' GROUP BY ALL),
        lens AS (SELECT native, coalesce(sum(tf), 0)::DOUBLE AS len FROM d LEFT JOIN tf USING (native) GROUP BY native),
        st AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
        dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        hit AS (SELECT native, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN dfs USING (term) JOIN lens USING (native), st WHERE term IN ({listed}) GROUP BY native)"""


def older_blocks(a: Archive) -> DataFrame:
    """Blocks of nine conversations in ten: what an index holds that lags behind."""
    old = a.messages.where(F.regexp_extract("source_native_id", r"^c(\d+)", 1).cast("long") % 10 != 0).select(F.col("id").alias("message_id"))
    return a.content_blocks.join(old, "message_id", "left_semi")


@register("search_bm25", f"{bm25_sql('true', ('the', 'und', 'ist'))} SELECT {BLOCK} AS block_id, round(score, 6) AS score FROM t JOIN hit USING (native)")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_text_index(of_turns(spark, sf_dir).content_blocks, stems=False)
    return search.match_bm25(index, "The und, ist").select("block_id", F.round("score", 6).alias("score"))


@register("search_bm25_stemmed")
def search_bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = of_turns(spark, sf_dir).content_blocks
    index = search.build_text_index(blocks, stop_words=StopWordsRemover.loadDefaultStopWords("english"))
    return search.match_bm25(index, "the resting rests")


@register(
    "search_substring",
    f"""{TURNS}, f AS (SELECT *, strpos(lower(text), 'tion') - 1 AS p FROM t LEFT JOIN titles USING (conv_id) WHERE lower(text) LIKE '%tion the%')
    SELECT 1.0::DOUBLE AS score, {CONVERSATION} AS conversation_id, {BLOCK} AS block_id, title, 'claude_code' AS source, '/work/p' || (conv_id % 7) AS project, role, made_at AS created_at,
        CASE WHEN p > 120 THEN '...' ELSE '' END || substr(text, greatest(0, p - 120) + 1, least(length(text), p + 124) - greatest(0, p - 120)) || CASE WHEN p + 124 < length(text) THEN '...' ELSE '' END AS snippet
    FROM f WHERE made_at >= TIMESTAMP '2024-01-02'""",
)
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_substring(of_turns(spark, sf_dir), "tion The", limit=None, since="2024-01-02", source="claude_code")


@register(
    "search_blended",
    f"""{bm25_sql('conv_id % 10 != 0', ('rest',))},
        r AS (SELECT block_id, score, row_number() OVER (ORDER BY score DESC, block_id) AS place FROM (SELECT {BLOCK} AS block_id, score FROM t JOIN hit USING (native)) QUALIFY place <= 20),
        f AS (SELECT block_id, row_number() OVER (ORDER BY seq, block_id) AS place FROM (SELECT {BLOCK} AS block_id, seq FROM t WHERE conv_id % 10 = 0 AND lower(text) LIKE '%rest%') QUALIFY place <= 20),
        k AS (SELECT least((SELECT count(*) FROM f), greatest(5, 20 - (SELECT count(*) FROM r))) AS keep),
        o AS (SELECT block_id, round(score, 6) AS score, 0 AS part, place FROM r, k WHERE place <= 20 - keep UNION ALL SELECT block_id, 1.0, 1, place FROM f, k WHERE place <= keep)
    SELECT block_id, score, CAST(row_number() OVER (ORDER BY part, place) AS INTEGER) AS rank FROM o""",
)
def search_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_turns(spark, sf_dir)
    index = search.build_text_index(older_blocks(a), stems=False)
    return search.search(a, index, "rest", limit=20).select("block_id", F.round("score", 6).alias("score"), "rank")


@register(
    "search_written_index",
    f"{bm25_sql('conv_id % 10 != 3', ('the', 'rest', 'und'))} SELECT {BLOCK} AS block_id, round(score, 6) AS score FROM t JOIN hit USING (native)",
)
def search_written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that grew by parts, lost a tenth of the conversations and was merged in between."""
    a, folder = of_turns(spark, sf_dir), scratch.new_path(spark, "index")
    number = F.regexp_extract("source_native_id", r"^c(\d+)", 1).cast("long") % 10
    blocks = scratch.save(a.content_blocks.join(a.messages.select(F.col("id").alias("message_id"), number.alias("number")), "message_id").select("id", "text", "number"), "blocks")
    text_index.create_index(spark, folder, stems=False)
    text_index.add_blocks(spark, folder, blocks.where("number < 8"))
    text_index.delete_blocks(spark, folder, blocks.where("number in (3, 9)"))
    text_index.add_blocks(spark, folder, blocks.where("number != 3"))
    return search.match_bm25(text_index.open_index(spark, folder), "the rest und").select("block_id", F.round("score", 6).alias("score"))


@register(
    "index_coverage",
    f"{TURNS}, n AS (SELECT count(*) FILTER (WHERE conv_id % 10 != 0) AS indexed, count(*) FILTER (WHERE conv_id % 10 = 0) AS pending FROM t) SELECT indexed, pending, pending >= greatest(2000, floor(indexed * 0.05)) AS needs_rebuild FROM n",
)
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_turns(spark, sf_dir)
    return search.index_coverage(a, search.build_text_index(older_blocks(a), stems=False))


@register("empty_conversations", f"{EVENTS} SELECT id, source_id, id AS source_native_id FROM conversations WHERE CAST(id AS BIGINT) % 10 = 0")
def empty_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_events(spark, sf_dir)
    return health.empty_conversations(replace(a, messages=a.messages.where(F.col("conversation_id").cast("long") % 10 != 0)))


@register("empty_messages", f"{EVENTS} SELECT id, conversation_id FROM messages WHERE CAST(id AS BIGINT) % 17 = 0")
def empty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_events(spark, sf_dir)
    return health.empty_messages(replace(a, content_blocks=a.content_blocks.where(F.col("message_id").cast("long") % 17 != 0)))


def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an observation of its user's conversation; some are imports, a few delete it."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.when(user % 3 == 0, "codex_cli").otherwise("claude_code").alias("source_id"),
        user.cast("string").alias("locator"),
        F.when(F.col("event_id") % 1009 == 0, "tombstone").otherwise("append").alias("kind"),
        F.col("ts").alias("observed_at"),
        (F.col("event_id") % 50 == 0).alias("legacy"),
    )


@register("sources_without_conversations", "SELECT 'codex_cli' AS source_id FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def sources_without_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_events(spark, sf_dir)
    a = replace(a, conversations=a.conversations.where("source_id != 'codex_cli'"))
    return health.sources_without_conversations(a, observed_events(spark, sf_dir))


@register(
    "format_drift",
    """WITH seen AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'codex_cli' ELSE 'claude_code' END AS source_id, user_id, max(ts) AS seen FROM events WHERE event_id % 50 != 0 GROUP BY ALL HAVING bool_and(event_id % 1009 != 0)),
    latest AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seen DESC, CAST(user_id AS VARCHAR)) <= 20),
    n AS (SELECT source_id, count(*) AS recent, count(*) FILTER (WHERE user_id % 9 < 4) AS empty FROM latest GROUP BY source_id)
    SELECT *, empty >= 3 AND empty * 2 >= recent AS drifted FROM n""",
)
def format_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_events(spark, sf_dir)
    a = replace(a, conversations=a.conversations.where(F.col("id").cast("long") % 9 >= 4))
    return health.format_drift(a, observed_events(spark, sf_dir))


@register("unknown_kinds", "SELECT event_type AS kind, count(*) AS records FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL")
def unknown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.unknown_kinds(table(spark, sf_dir, "events"), ("click", "view"), "event_type")


@register(
    "classify_changes",
    "SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 5 = 1 THEN 'inserted' WHEN user_id % 10 = 7 THEN 'replaced' WHEN user_id % 5 = 2 THEN 'appended' ELSE 'unchanged' END AS action FROM events GROUP BY ALL",
)
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = of_events(spark, sf_dir).conversations.withColumn("content_hash", F.md5(F.col("message_count").cast("string")))
    user = F.col("id").cast("long")
    stored = new.where(user % 5 != 1).withColumn("content_hash", F.when(user % 5 == 2, "old").otherwise(F.col("content_hash"))).withColumn("project", F.when(user % 10 == 7, "/moved").otherwise(F.col("project")))
    return changes.classify_changes(new, stored)


def rendered(turns: DataFrame) -> DataFrame:
    return RENDERERS["claude_code"](turns)


@register("kept_message_prefix", f"{TURNS} SELECT {CONVERSATION} AS conversation_id, kept, stored FROM (SELECT conv, coalesce(min(seq) FILTER (WHERE turn = conv_id % 8), count(*)) AS kept, count(*) AS stored FROM t GROUP BY conv)")
def kept_message_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    older = turns.withColumn("text", F.when(F.col("turn") == F.col("conv_id") % 8, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return changes.kept_message_prefix(of_turns(spark, sf_dir), NORMALIZERS["claude_code"](rendered(older)))


@register(
    "collect_changes",
    """WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
    SELECT 'conv-' || conv_id AS locator, CASE WHEN conv_id % 4 = 2 THEN 'snapshot' ELSE 'append' END AS kind, conv_id % 4 = 0 AS continued FROM c
    WHERE conv_id % 11 != 0 AND conv_id % 4 != 1 AND (conv_id % 4 != 0 OR last >= 2)""",
)
def collect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    part = F.col("conv_id") % 4
    logged = turns.where((part != 3) & ((part != 0) | (F.col("turn") < 2))).withColumn("text", F.when(part == 2, F.concat(F.lit("?"), F.col("text"))).otherwise(F.col("text")))
    states = rendered(logged).select(*changes.KEY, F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), "mtime")
    deleted = turns.where(F.col("conv_id") % 11 == 0).select(F.lit("claude_code").alias("source_id"), F.lit("").alias("scope"), F.concat(F.lit("conv-"), "conv_id").alias("locator")).distinct()
    return changes.collect_changes(rendered(turns), states, deleted).select("locator", "kind", (F.col("byte_offset") > 0).alias("continued"))


@register(
    "upsert_archive",
    f"{TURNS} SELECT conv AS source_native_id, count(*) AS messages, count(*) AS blocks, count(*) AS raw_events FROM t WHERE conv_id % 3 != 1 OR turn < 4 GROUP BY conv",
)
def upsert_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    archive = lambda rows: NORMALIZERS["claude_code"](rendered(rows))
    out = changes.upsert_archive(archive(turns.where("conv_id % 3 != 0 and turn < 4")), archive(turns.where("conv_id % 3 != 1")))
    b = out.content_blocks.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    m = out.messages.join(b, out.messages["id"] == b["message_id"], "left").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("blocks"))
    r = out.raw_events.groupBy(F.col("source_native_conversation_id").alias("source_native_id")).agg(F.count(F.lit(1)).alias("raw_events"))
    return out.conversations.join(m, out.conversations["id"] == m["conversation_id"]).join(r, "source_native_id").select("source_native_id", "messages", "blocks", "raw_events")
