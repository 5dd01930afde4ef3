"""Queries of written archives: upserts, deletions, sources and catch-up with a log; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..archive import Archive, read_archive
from ..operators import changes, observations
from ..sources.normalize import NORMALIZERS
from ..sources.render import RENDERERS
from ..streaming import catch_up as streams
from .archives import of_turns, table
from .merging import CONVERSATION, MERGED, observed
from .queries import TURNS, register, sid
from .upkeep import BLOCK


def archive_of(turns: DataFrame) -> Archive:
    return NORMALIZERS["claude_code"](RENDERERS["claude_code"](turns))


@register(
    "upsert_folder",
    f"""{TURNS}, n AS (SELECT conv_id, count(*) FILTER (WHERE turn >= 4) AS later FROM t GROUP BY conv_id)
    SELECT conv AS source_native_id, {BLOCK} AS block_id, text, CASE conv_id % 3 WHEN 0 THEN 'inserted' WHEN 2 THEN CASE WHEN later > 0 THEN 'appended' ELSE 'unchanged' END END AS action
    FROM t JOIN n USING (conv_id) WHERE conv_id % 3 != 1 OR turn < 4""",
)
def upsert_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written archive, upserted: a third of the conversations is new, a third has grown or not, a third isn't seen. All blocks with what was done."""
    turns = table(spark, sf_dir, "conversations")
    folder = scratch.new_path(spark, "archive")
    changes.upsert_folder(spark, folder, archive_of(turns.where("conv_id % 3 != 0 and turn < 4")))
    actions = changes.upsert_folder(spark, folder, archive_of(turns.where("conv_id % 3 != 1")))
    a = read_archive(spark, folder)
    own = a.conversations.select(F.col("id").alias("conversation_id"), "source_native_id").join(actions.withColumnRenamed("id", "conversation_id"), "conversation_id", "left")
    messages = a.messages.select(F.col("id").alias("message_id"), "conversation_id").join(own, "conversation_id")
    return a.content_blocks.join(messages, "message_id").select("source_native_id", F.col("id").alias("block_id"), "text", "action")


@register(
    "catch_up",
    f"{MERGED} SELECT {CONVERSATION} AS conversation_id, native AS source_native_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INTEGER) AS sequence_index FROM m",
)
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that follows a log of two devices: what is there, then segments that come late and an import; the first segments once more."""
    seen = observed(spark, sf_dir).withColumn("number", F.regexp_extract("segment", r"(\d+)", 1).cast("int"))
    log, archive, checkpoint = (scratch.new_path(spark, x) for x in ("log", "archive", "checkpoint"))
    new = [c for c in observations.COLUMNS if c not in ("device_id", "device_seq", "segment", "legacy", "observed_at")]

    def send(device: str, *numbers: int, legacy: bool = False) -> str | None:
        rows = seen.where((F.col("device_id") == device) & F.col("number").isin(*numbers) & (F.col("legacy") == legacy)).select(new)
        return observations.append_observations(spark, log, rows, device, legacy=legacy)

    def follow() -> None:
        streams.stream_catch_up(spark, log, archive, checkpoint).awaitTermination()

    first = [send("a", 1, 3, 5, 7), send("b", 3, 4, 5, 7)]
    follow()
    send("a", 2, 6, 8)
    send("b", 8, legacy=True)
    follow()
    streams.apply(spark, log, archive, [x for x in first if x])
    return read_archive(spark, archive).messages.select("conversation_id", "source_native_id", "sequence_index")


@register(
    "rebuild",
    f"""{MERGED} SELECT {CONVERSATION} AS conversation_id, native AS source_native_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INTEGER) AS sequence_index, 'stored' AS outcome FROM m""",
)
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive made anew from a log of two devices, in parts; its messages with what became of their conversation."""
    seen = observed(spark, sf_dir)
    log, archive = (scratch.new_path(spark, x) for x in ("log", "archive"))
    new = [c for c in observations.COLUMNS if c not in ("device_id", "device_seq", "segment", "legacy", "observed_at")]
    for device, legacy in (("a", False), ("b", False), ("b", True)):
        rows = seen.where((F.col("device_id") == device) & (F.col("legacy") == legacy)).select(new)
        observations.append_observations(spark, log, rows, device, legacy=legacy)
    size = seen.select(F.sum("length")).first()[0] or 0
    made = streams.rebuild(spark, log, archive, part_bytes=size // 2 + 1)
    outcomes = made.outcomes.select(streams.conversation_ids().alias("conversation_id"), "outcome")
    return read_archive(spark, archive).messages.select("conversation_id", "source_native_id", "sequence_index").join(outcomes, "conversation_id")


@register("kept_event_prefix", f"{TURNS} SELECT {CONVERSATION} AS conversation_id, kept, stored FROM (SELECT conv, coalesce(min(seq) FILTER (WHERE turn = conv_id % 8), count(*)) AS kept, count(*) AS stored FROM t GROUP BY conv)")
def kept_event_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    older = turns.withColumn("text", F.when(F.col("turn") == F.col("conv_id") % 8, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return changes.kept_event_prefix(of_turns(spark, sf_dir), archive_of(older))


@register(
    "delete_conversations",
    f"""{TURNS}, k AS (SELECT * FROM t WHERE conv_id % 4 != 1)
    SELECT 'conversation' AS kind, {CONVERSATION} AS id FROM k GROUP BY conv UNION ALL SELECT 'message', {sid("message", CONVERSATION, "native")} FROM k UNION ALL SELECT 'block', {BLOCK} FROM k UNION ALL SELECT 'event', conv || ':' || seq FROM k""",
)
def delete_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all tables without one conversation in four."""
    a = of_turns(spark, sf_dir)
    gone = a.conversations.where(F.regexp_extract("source_native_id", r"(\d+)", 1).cast("long") % 4 == 1).select("id")
    left = changes.delete_conversations(a, gone)
    events = left.raw_events.select(F.lit("event").alias("kind"), F.concat_ws(":", "source_native_conversation_id", F.col("line_number").cast("string")).alias("id"))
    kinds = {"conversation": left.conversations, "message": left.messages, "block": left.content_blocks}
    for kind, rows in kinds.items():
        events = events.unionByName(rows.select(F.lit(kind).alias("kind"), "id"))
    return events


@register(
    "register_sources",
    """WITH s AS (SELECT event_type || (user_id % 20) AS id, min(ts) FILTER (WHERE event_id % 2 = 0) AS old, min(ts) FILTER (WHERE event_id % 5 = 0) AS new, max(ts) FILTER (WHERE event_id % 2 = 0) AS last FROM events GROUP BY ALL)
    SELECT id, CASE WHEN new IS NOT NULL THEN 'new' ELSE 'old' END AS name, CASE WHEN new IS NOT NULL THEN '2' ELSE '1' END AS adapter_version, coalesce(old, new) AS first_seen,
        CASE WHEN new IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE last END AS last_ingested, CASE WHEN old IS NOT NULL THEN '{"k":1}' ELSE '{}' END AS config
    FROM s WHERE old IS NOT NULL OR new IS NOT NULL""",
)
def register_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("id", F.concat("event_type", (F.col("user_id") % 20).cast("string")))

    def sources(rows: DataFrame, name: str, version: str, config: str) -> DataFrame:
        seen = rows.groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_ingested"))
        return seen.select("id", F.lit(name).alias("name"), F.lit(version).alias("adapter_version"), "first_seen", "last_ingested", F.lit(config).alias("config"))

    return changes.register_sources(sources(e.where("event_id % 2 = 0"), "old", "1", '{"k":1}'), sources(e.where("event_id % 5 = 0"), "new", "2", "{}"), F.to_timestamp(F.lit("2030-01-01")))
