"""Queries of the observation log and of the merge, with their SQL; importing this module registers them.

Every conversation of the table is observed by two devices in one of six ways, by its number: appended in two parts, appended in overlapping parts that
arrive out of order, in two versions that differ from the third turn on, with a gap, deleted by the other device, or known further from an import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..archive import OBSERVATIONS
from ..operators import export, merge, observations, readonly
from ..operators.changes import pending_collection
from ..sources.render import RENDERERS
from .archives import of_events, of_turns, table
from .queries import EVENTS, TURNS, register, sid

COLUMNS = [c.split()[0] for c in OBSERVATIONS.split(", ")]


def _bytes(turns: DataFrame) -> DataFrame:
    """(locator, content, size) of turns as a transcript."""
    return RENDERERS["claude_code"](turns).select("locator", "content", F.octet_length("content").cast("long").alias("size"))


def _seen(content: DataFrame, device: str, seq: int, kind: str = "append", offset: Column | None = None, legacy: bool = False) -> DataFrame:
    values = {
        "device_id": F.lit(device), "device_seq": F.lit(seq).cast("long"), "source_id": F.lit("claude_code"), "scope": F.lit(""), "kind": F.lit(kind), "byte_offset": (F.lit(0) if offset is None else offset).cast("long"),
        "length": F.octet_length("content").cast("long"), "content_sha256": F.sha2("content", 256), "observed_at": F.to_timestamp(F.lit("2024-02-01")), "path": F.concat(F.lit(f"/{device}/"), "locator"), "project_hint": F.lit("/work"),
        "legacy": F.lit(legacy), "segment": F.lit(f"{device}-{seq}"),
    }
    return content.withColumns(values).select(*COLUMNS)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as observations of two devices."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = lambda k: t.where(F.col("conv_id") % 6 == k)
    size_of = lambda rows: _bytes(rows).select("locator", F.col("size").alias("before"))
    after = lambda k, n: _bytes(case(k).where(F.col("turn") >= n)).join(size_of(case(k).where(F.col("turn") < n)), "locator")
    first = lambda k, n: _bytes(case(k).where(F.col("turn") < n))
    other = case(2).where("turn >= 2").withColumn("turn", F.col("turn") + 1000).unionByName(case(2).where("turn < 2"))
    before = F.col("before")
    parts = [
        _seen(first(0, 2), "a", 1), _seen(after(0, 2), "a", 2, offset=before),
        _seen(after(1, 2), "b", 3, offset=before), _seen(first(1, 4), "a", 3), _seen(first(1, 1), "b", 4),
        _seen(_bytes(case(2)), "a", 5), _seen(_bytes(other), "b", 5, "snapshot"),
        _seen(after(3, 2), "a", 6, offset=before),
        _seen(_bytes(case(4)), "a", 7), _seen(_bytes(case(4)).withColumn("content", F.lit(None).cast("binary")), "b", 7, "tombstone"),
        _seen(first(5, 3), "a", 8), _seen(_bytes(case(5)), "b", 8, "snapshot", legacy=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return scratch.save(out, "observed")


#: Messages as merged, in SQL: case 2 has the other device's branch behind the first one's.
MERGED = f"""{TURNS}, n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
    m AS (
        SELECT conv_id, conv, native, turn AS place, role, made_at FROM t WHERE conv_id % 6 NOT IN (3, 4)
        UNION ALL
        SELECT conv_id, conv, 'c' || conv_id || '-t' || (turn + 1000), turn + 1000, role, made_at + to_seconds(1000) FROM t WHERE conv_id % 6 = 2 AND turn >= 2
    )"""
CONVERSATION = sid("conversation", "'claude_code'", "conv")


@register(
    "merge_messages",
    f"{MERGED} SELECT {CONVERSATION} AS conversation_id, native AS source_native_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INTEGER) AS sequence_index, role, made_at AS created_at FROM m",
)
def merge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.project(observed(spark, sf_dir)).archive.messages.select("conversation_id", "source_native_id", "sequence_index", "role", "created_at")


@register(
    "merge_conversations",
    f"{MERGED}, r AS (SELECT conv_id, count(*) AS events FROM m GROUP BY conv_id) SELECT {CONVERSATION} AS id, conv AS source_native_id, min(made_at) AS started_at, max(made_at) AS ended_at, CAST(count(*) AS INTEGER) AS message_count, '{{\"event_count\":' || any_value(events) || '}}' AS metadata,"
    " CASE WHEN max(place) >= 1000 THEN '/b/' ELSE '/a/' END || conv AS raw_path FROM m JOIN r USING (conv_id) GROUP BY conv_id, conv",  # the other device's transcript has longer ids, so it is the first version
)
def merge_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.project(observed(spark, sf_dir)).archive.conversations.select("id", "source_native_id", "started_at", "ended_at", "message_count", "metadata", "raw_path")


@register(
    "merge_divergences",
    f"""{MERGED}, d AS (SELECT *, unnest([2, 1002]) AS head FROM (SELECT DISTINCT conv_id, conv FROM t WHERE conv_id % 6 = 2 AND turn = 2))
    SELECT {CONVERSATION} AS conversation_id, 'c' || conv_id || '-t1' AS fork_after, 'c' || conv_id || '-t' || head AS branch_message, CASE WHEN head = 2 THEN 'a' ELSE 'b' END AS devices FROM d""",
)
def merge_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.project(observed(spark, sf_dir)).divergences.withColumn("devices", F.array_join("devices", ","))


@register(
    "projection_outcomes",
    f"{TURNS}, n AS (SELECT conv, conv_id, count(*) AS n FROM t GROUP BY ALL) SELECT conv AS locator, CASE WHEN conv_id % 6 = 3 THEN 'pending' WHEN conv_id % 6 = 4 THEN 'removed' ELSE 'stored' END AS outcome FROM n WHERE conv_id % 6 != 3 OR n > 2",
)
def projection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.project(observed(spark, sf_dir)).outcomes.select("locator", "outcome")


@register(
    "merge_raw_events",
    f"{MERGED} SELECT conv AS locator, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 6 != 2 OR place < 2 THEN 0 WHEN place >= 1000 THEN 1 ELSE 2 END, place) - 1 AS INTEGER) AS line_number, native FROM m",
)
def merge_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = merge.project(observed(spark, sf_dir)).archive.raw_events
    return raw.select(F.col("source_native_conversation_id").alias("locator"), "line_number", F.get_json_object("payload", "$.uuid").alias("native"))


@register(
    "reconstructed_versions",
    f"""{TURNS}, n AS (SELECT conv, conv_id, count(*) AS n FROM t GROUP BY ALL)
    SELECT conv AS locator, v.i AS version, CASE WHEN conv_id % 6 = 5 THEN least(n, 3) ELSE n END AS lines, CASE WHEN conv_id % 6 = 1 THEN 'a,b' WHEN conv_id % 6 = 2 THEN CASE WHEN n <= 2 THEN 'a,b' WHEN v.i = 0 THEN 'a' ELSE 'b' END ELSE 'a' END AS devices
    FROM n, (SELECT unnest([0, 1]) AS i) v WHERE conv_id % 6 NOT IN (3) AND (v.i = 0 OR (conv_id % 6 = 2 AND n > 2))""",
)
def reconstructed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.reconstruct_versions(observed(spark, sf_dir).where("kind != 'tombstone'"))
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    by = merge.devices(F.col("contributors"))
    # The order of two versions follows the longer transcript, so a pair is named by its devices.
    version = F.when(F.array_contains(by, "a"), 0).otherwise(1)
    return found.select("locator", version.alias("version"), lines.cast("long").alias("lines"), F.array_join(by, ",").alias("devices"))


@register(
    "collector_state",
    """WITH RECURSIVE log AS (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 11 = 0 AS whole, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id * 7 % 40 END AS place, event_type || ':' || event_id AS data FROM events WHERE event_id % 10 != 9 AND event_id % 50 != 0),
    state(user_id, k, content) AS (
        SELECT DISTINCT user_id, 0::BIGINT, '' FROM log
        UNION ALL SELECT s.user_id, log.k, CASE WHEN whole THEN data WHEN place <= length(content) THEN substr(content, 1, place) || data ELSE content END FROM state s JOIN log ON log.user_id = s.user_id AND log.k = s.k + 1)
    SELECT CAST(user_id AS VARCHAR) AS locator, length(content) AS length, sha256(content) AS sha256 FROM state QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
)
def collector_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an observation of its user's file: some replace it, others are put at a place inside, at the end or past it."""
    e = table(spark, sf_dir, "events")
    whole, data = F.col("event_id") % 11 == 0, F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).cast("binary")
    log = e.select(
        F.when(F.col("event_id") % 10 == 9, "b").otherwise("a").alias("device_id"), F.col("event_id").alias("device_seq"), F.lit("claude_code").alias("source_id"), F.lit("").alias("scope"), F.col("user_id").cast("string").alias("locator"),
        F.when(whole, "snapshot").otherwise("append").alias("kind"), F.when(whole, 0).otherwise(F.col("event_id") * 7 % 40).cast("long").alias("byte_offset"), F.octet_length(data).cast("long").alias("length"), data.alias("content"), (F.col("event_id") % 50 == 0).alias("legacy"),
    )
    return observations.collector_state(log, "a").select("locator", "length", "sha256")


@register(
    "append_observations",
    """WITH c AS (SELECT DISTINCT conv_id, 'conv-' || conv_id AS locator FROM conversations)
    SELECT locator, row_number() OVER (PARTITION BY conv_id % 3 = 0 ORDER BY locator) + CASE WHEN conv_id % 3 != 0 THEN (SELECT count(*) FROM c WHERE conv_id % 3 = 0) ELSE 0 END AS device_seq, true AS intact FROM c""",
)
def append_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transcripts, logged by one device in two segments; the second is sent twice."""
    handles = RENDERERS["claude_code"](table(spark, sf_dir, "conversations"))
    new = scratch.save(handles.select("source_id", "scope", "locator", F.lit("append").alias("kind"), F.lit(0).cast("long").alias("byte_offset"), "path", "project_hint", "content"), "new")
    folder = scratch.new_path(spark, "log")
    third = F.regexp_extract("locator", r"(\d+)", 1).cast("long") % 3 == 0
    observations.append_observations(spark, folder, new.where(third), "a")
    for _ in range(2):
        observations.append_observations(spark, folder, new.where(~third), "a", segment="rest")
    logged = observations.read_observations(spark, folder)
    sent = new.select("locator", F.sha2("content", 256).alias("sent"))
    return logged.join(sent, "locator").select("locator", "device_seq", ((F.sha2("content", 256) == F.col("sent")) & (F.col("content_sha256") == F.col("sent"))).alias("intact"))


@register(
    "missing_segments",
    """WITH s AS (SELECT DISTINCT event_type AS device_id, event_id // 250 AS k FROM events)
    SELECT device_id || '-' || k AS segment, device_id, CASE WHEN device_id = 'click' THEN 'push' ELSE 'pull' END AS direction FROM s WHERE (device_id = 'click' AND k % 4 = 1) OR (device_id != 'click' AND k % 3 = 0)""",
)
def missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of a log of all events: one lacks a third of the other devices' segments, the other a quarter of this device's."""
    log, number = _event_log(spark, sf_dir).drop("content"), F.floor(F.col("device_seq") / 250)
    log = log.withColumn("segment", F.concat_ws("-", "device_id", number.cast("string")))
    own = log.where((F.col("device_id") == "click") | (number % 3 != 0))
    other = log.where((F.col("device_id") != "click") | (number % 4 != 1))
    return observations.missing_segments(own, other, "click")


@register(
    "device_summary",
    "WITH e AS (SELECT event_type AS device_id, event_id, event_id // 1000 AS segment FROM events), a AS (SELECT device_id, count(DISTINCT segment) AS segments, max(event_id) AS last_seq FROM e WHERE device_id != 'view' GROUP BY 1),"
    " b AS (SELECT device_id, count(DISTINCT segment) AS other_segments, max(event_id) AS other_last_seq FROM e WHERE event_id % 3 != 0 AND device_id != 'click' GROUP BY 1)"
    " SELECT device_id, coalesce(segments, 0) AS segments, coalesce(last_seq, 0) AS last_seq, coalesce(other_segments, 0) AS other_segments, coalesce(other_last_seq, 0) AS other_last_seq FROM a FULL JOIN b USING (device_id)",
)
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log(spark, sf_dir)
    return observations.device_summary(log.where("device_id != 'view'"), log.where("device_seq % 3 != 0 and device_id != 'click'"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an observation: a device per kind of event, a segment per thousand."""
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string").cast("binary")
    return e.select(
        F.col("event_type").alias("device_id"), F.col("event_id").alias("device_seq"), F.lit("claude_code").alias("source_id"), F.lit("").alias("scope"), F.col("user_id").cast("string").alias("locator"), F.lit("append").alias("kind"), text.alias("content"),
        F.sha2(text, 256).alias("content_sha256"), F.octet_length(text).cast("long").alias("length"), F.concat("event_type", F.lit("-"), F.floor(F.col("event_id") / 1000).cast("string")).alias("segment"),
    )


@register(
    "audit_observations",
    "SELECT event_type AS device_id, event_id AS device_seq, p AS problem FROM (SELECT *, unnest([CASE WHEN event_id % 101 = 0 THEN 'content and hash differ' END, CASE WHEN event_id % 103 = 0 THEN 'content and length differ' END, CASE WHEN event_id % 107 = 0 THEN 'unknown kind' END]) AS p FROM events) WHERE p IS NOT NULL",
)
def audit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("device_seq")
    log = _event_log(spark, sf_dir).withColumns({
        "content_sha256": F.when(seq % 101 == 0, "0").otherwise(F.col("content_sha256")),
        "length": F.when(seq % 103 == 0, 999).otherwise(F.col("length")),
        "kind": F.when(seq % 107 == 0, "other").otherwise(F.col("kind")),
    })
    return observations.audit_observations(log).select("device_id", "device_seq", "problem")


@register(
    "index_observations",
    "SELECT event_type AS device_id, event_id AS device_seq FROM events WHERE event_id % 4 != 3",
)
def index_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log(spark, sf_dir)
    index, _ = observations.index_observations(log.where("device_seq % 4 = 0"), log.where("device_seq % 4 in (0, 1, 2)").unionByName(log.where("device_seq % 4 = 1")))
    return index.select("device_id", "device_seq")


@register("touched_keys", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS locator FROM events WHERE event_id % 40 = 1")
def touched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log(spark, sf_dir)
    return observations.index_observations(log.where("device_seq % 40 = 0"), log.where("device_seq % 40 in (0, 1)"))[1].select("locator")


@register("new_segments", "SELECT DISTINCT event_type || '-' || (event_id // 1000) AS segment FROM events WHERE event_type != 'view'")
def new_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log(spark, sf_dir)
    return observations.new_segments(log, log.where("device_id = 'view'").select("segment").distinct())


@register(
    "import_raw_events",
    f"{TURNS} SELECT conv AS locator, count(*) AS lines, CAST(sum(length(native)) AS BIGINT) AS ids FROM t WHERE conv_id % 4 != 0 GROUP BY conv",
)
def import_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_turns(spark, sf_dir)
    every = observations.import_raw_events(a.conversations, a.raw_events, _event_log(spark, sf_dir).limit(0))
    known = every.where(F.regexp_extract("locator", r"(\d+)", 1).cast("long") % 4 == 0)
    found = observations.import_raw_events(a.conversations, a.raw_events, known)
    lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")
    ids = F.aggregate(F.transform(lines, lambda x: F.length(F.get_json_object(x, "$.uuid"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("locator", F.size(lines).cast("long").alias("lines"), ids.alias("ids"))


@register(
    "pending_collection",
    "SELECT 'claude_code' AS source_id, count(*) AS discovered, count(*) FILTER (WHERE conv_id % 4 != 1) AS pending FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)",
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of which one in four is logged already, and one in four has grown."""
    handles = RENDERERS["claude_code"](table(spark, sf_dir, "conversations"))
    number = F.regexp_extract("locator", r"(\d+)", 1).cast("long") % 4
    logged = handles.withColumn("content", F.when(number == 2, F.unhex(F.lit("7B"))).otherwise(F.col("content"))).where(number.isin(1, 2))
    states = logged.select("source_id", "scope", "locator", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), "mtime")
    return pending_collection(handles, states)


@register(
    "export_canonical",
    f"""{TURNS} SELECT conv AS source_native_id, count(*) AS messages, count(*) AS events, CAST(sum(turn) AS BIGINT) AS sequence, string_agg(native, ',' ORDER BY turn) AS natives FROM t GROUP BY conv""",
)
def export_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = export.export_canonical(of_turns(spark, sf_dir))
    messages = F.from_json(F.get_json_object("document", "$.messages"), "array<struct<sequence_index: bigint, source_native_id: string>>")
    events = F.from_json(F.get_json_object("document", "$.raw_events"), "array<struct<line_number: bigint>>")
    sequence = F.aggregate(messages, F.lit(0).cast("long"), lambda s, x: s + x["sequence_index"])
    natives = F.array_join(F.transform(messages, lambda x: x["source_native_id"]), ",")
    return documents.select("source_native_id", F.size(messages).cast("long").alias("messages"), F.size(events).cast("long").alias("events"), sequence.alias("sequence"), natives.alias("natives"))


@register("read_only_query", f"{EVENTS} SELECT source_id, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM tool_calls WHERE tool_name LIKE '%i%' GROUP BY source_id")
def read_only_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = "WITH c AS (SELECT * FROM tool_calls WHERE tool_name LIKE '%i%') SELECT source_id, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM c GROUP BY source_id"
    return readonly.query(of_events(spark, sf_dir), statement)


@register("bounded_result", f"{EVENTS} SELECT CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS INTEGER) AS place, '{{\"id\":\"' || id || '\"}}' AS row FROM messages ORDER BY CAST(id AS BIGINT) LIMIT 500")
def bounded_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 of all messages' ids as bounded JSON rows (the limit is the feature)."""
    from pyspark.sql import Window

    rows = readonly.bounded(of_events(spark, sf_dir).messages.select("id").orderBy(F.col("id").cast("long"))).where("fits")
    return rows.select(F.row_number().over(Window.orderBy("place")).alias("place"), "row")


@register(
    "catch_up_projection",
    f"{MERGED} SELECT conv AS locator, count(*) AS messages FROM m WHERE conv_id % 6 IN (1, 2) GROUP BY conv",
)
def catch_up_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only conversations that two segments touch are projected, from all their observations."""
    log = observed(spark, sf_dir)
    arrived = log.select("segment").distinct().where("segment in ('b-4', 'b-5')")
    found = merge.project(merge.affected(log, arrived)).archive
    counts = found.messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    return found.conversations.join(counts, "id").select(F.col("source_native_id").alias("locator"), "messages")
