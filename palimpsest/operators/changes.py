"""What changed: between sources and what was logged of them, and between new conversations and stored ones."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..archive import DIVERGENCES, Archive, Conflict, Manifest, bucket_of, buckets_for, commit_manifest, read_archive, read_manifest, read_table, write_version
from ..functions import columns as C

KEY = ["source_id", "scope", "locator"]


def complete_lines(content: Column) -> Column:
    """The bytes without a last line that is still being written: one without a line end that isn't a JSON value."""
    # ISO-8859-1 has one character per byte, so positions in it are byte positions.
    tail = F.substring_index(F.decode(content, "ISO-8859-1"), "\n", -1)
    kept = F.substring(content, F.lit(1), F.octet_length(content) - F.length(tail))
    whole = (F.trim(F.regexp_replace(tail, r"\s", "")) == "") | C.parsed(F.try_validate_utf8(F.encode(tail, "ISO-8859-1").cast("string"))).isNotNull()
    return F.when(F.substring(content, -1, 1) == F.lit(b"\n"), content).when(whole, content).otherwise(kept)


def tombstoned(observations: DataFrame) -> DataFrame:
    """Keys that any device deleted."""
    return observations.where("kind = 'tombstone'").select(*KEY).distinct()


def collect_changes(handles: DataFrame, states: DataFrame, tombstones: DataFrame | None = None, append_only: bool = True, incremental: bool = False) -> DataFrame:
    """Observations to log of handles: KEY, kind, byte_offset, length, content_sha256, path, project_hint, content.

    states: KEY, length, sha256, mtime of what was logged last, a row per key. An append-only source's new bytes, or all bytes of
    a new handle, are an append; other changes are snapshots. Unchanged, empty and deleted handles give no row. incremental
    trusts an unchanged mtime; handles from scan_changed() leave such files unread.
    """
    if tombstones is not None:
        handles = handles.join(tombstones, KEY, "left_anti")
    known = handles.join(states.select(*KEY, F.col("length").alias("__length"), F.col("sha256").alias("__sha"), F.col("mtime").alias("__mtime")), KEY, "left")
    if incremental:
        known = known.where(~F.coalesce(F.col("mtime") == F.col("__mtime"), F.lit(False)))
    if append_only:
        known = known.withColumn("content", complete_lines(F.col("content")))
    size, old = F.octet_length("content").cast("long"), F.col("__length")
    known = known.withColumn("__size", size).where("__size > 0").withColumn("__new_sha", F.sha2("content", 256))
    known = known.where(~F.coalesce((old == F.col("__size")) & (F.col("__sha") == F.col("__new_sha")), F.lit(False)))
    # Only a content longer than what was logged can have grown; no other is hashed a second time. A content is one value and so under 2 GB.
    prefix = F.when(old < F.col("__size"), F.sha2(F.substring("content", F.lit(1), old.cast("int")), 256))
    grown = F.coalesce(prefix == F.col("__sha"), F.lit(False))
    offset = F.when(grown, old).otherwise(F.lit(0).cast("long")) if append_only else F.lit(0).cast("long")
    kind = F.when(grown | old.isNull(), "append").otherwise("snapshot") if append_only else F.lit("snapshot")
    logged = known.select(*KEY, kind.alias("kind"), offset.alias("byte_offset"), "path", "project_hint", "content", "__size")
    logged = logged.withColumn("content", F.substring("content", (F.col("byte_offset") + 1).cast("int"), F.col("__size").cast("int")))
    return logged.select(*KEY, "kind", "byte_offset", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("content_sha256"), "path", "project_hint", "content")


def pending_collection(handles: DataFrame, states: DataFrame, tombstones: DataFrame | None = None, append_only: bool = True) -> DataFrame:
    """(source_id, discovered, pending): how many handles there are, and how many of them hold something to log. Nothing is written."""
    pending = collect_changes(handles, states, tombstones, append_only).groupBy("source_id").agg(F.count(F.lit(1)).alias("pending"))
    found = handles.groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered")).join(pending, "source_id", "left")
    return found.select("source_id", "discovered", F.coalesce("pending", F.lit(0)).alias("pending"))


def with_content_hashes(a: Archive) -> Archive:
    """The archive with content_hash: over a conversation's row, its messages and blocks in order, and its raw events as they are.

    Times of ingest, paths and file times are no content. Hashes of messages and events are made first, so that a conversation gathers only these.
    """
    seen = _message_hashes(a).groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence_index", "h"))).alias("messages"))
    raw = a.raw_events.select("source_id", F.col("source_native_conversation_id").alias("source_native_id"), "line_number", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("h"))
    raw = raw.groupBy("source_id", "source_native_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "h"))).alias("events"))
    own = F.struct(F.lit("v1"), "source_id", "source_native_id", "title", "project", "started_at", "ended_at", "message_count", "metadata", "messages", "events")
    found = a.conversations.join(seen, "id", "left").join(raw, ["source_id", "source_native_id"], "left")
    return replace(a, conversations=found.withColumn("content_hash", F.sha2(F.to_json(own), 256)).select(*a.conversations.columns))


def classify_changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action) per new conversation: inserted, unchanged (same hash), replaced (other project or start) or appended."""
    old = stored.select("id", F.col("content_hash").alias("__hash"), F.col("project").alias("__project"), F.col("started_at").alias("__started"), F.lit(True).alias("__stored"))
    same = F.col("project").eqNullSafe(F.col("__project")) & F.col("started_at").eqNullSafe(F.col("__started"))
    action = F.when(F.col("__stored").isNull(), "inserted").when(F.col("content_hash") == F.col("__hash"), "unchanged").when(same, "appended").otherwise("replaced")
    return new.select("id", "content_hash", "project", "started_at").join(old, "id", "left").select("id", action.alias("action"))


def _message_hashes(a: Archive) -> DataFrame:
    """(conversation_id, sequence_index, h): a hash over every field of a message and of its blocks in order."""
    fields = ("block_index", "id", "type", "text", "tool_name", "tool_use_id", "payload")
    blocks = a.content_blocks.groupBy(F.col("message_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("blocks"))
    own = F.struct("id", "source_native_id", "parent_message_id", "role", "model", "created_at", "metadata", "blocks")
    return a.messages.join(blocks.hint("merge"), "id", "left").select("conversation_id", "sequence_index", F.sha2(F.to_json(own), 256).alias("h"))


def kept_message_prefix(new: Archive, stored: Archive) -> DataFrame:
    """(conversation_id, kept, stored) of stored conversations: how many leading messages need no rewrite; a gap ends them."""
    known = new.conversations.select(F.col("id").alias("conversation_id")).hint("merge")  # else broadcast, whatever their number: Spark takes them for too little
    old = _message_hashes(stored).withColumnRenamed("h", "__h").join(known, "conversation_id", "left_semi")
    both = old.join(_message_hashes(new), ["conversation_id", "sequence_index"], "full")
    differs = ~F.col("h").eqNullSafe(F.col("__h"))
    out = both.groupBy("conversation_id").agg(F.min(F.when(differs, F.col("sequence_index"))).alias("__first"), F.count("__h").alias("stored"))
    return out.where("stored > 0").select("conversation_id", F.coalesce(F.col("__first").cast("long"), F.col("stored")).alias("kept"), "stored")


def kept_event_prefix(new: Archive, stored: Archive) -> DataFrame:
    """(conversation_id, kept, stored) of stored conversations: how many leading raw events, by id, path and payload, need no rewrite; a gap ends them."""
    key = ["source_id", "source_native_conversation_id", "line_number"]
    fields = lambda a, name: a.raw_events.select(*key, F.struct("id", "raw_path", "payload").alias(name))
    names = new.conversations.select("source_id", F.col("source_native_id").alias("source_native_conversation_id"), F.col("id").alias("conversation_id"))
    both = fields(stored, "_old").join(fields(new, "_new"), key, "full").join(names, key[:2])
    found = both.groupBy("conversation_id").agg(F.min(F.when(~F.col("_new").eqNullSafe(F.col("_old")), F.col("line_number"))).alias("_first"), F.count("_old").alias("stored"))
    return found.where("stored > 0").select("conversation_id", F.coalesce(F.col("_first").cast("long"), F.col("stored")).alias("kept"), "stored")


def register_sources(stored: DataFrame, seen: DataFrame, now: Column | None = None) -> DataFrame:
    """sources with those that were seen: the first time stays, name, version and last_ingested are the new ones."""
    now = F.current_timestamp() if now is None else now
    names = [c for c in stored.columns if c != "id"]
    new = seen.select("id", F.struct(*names).alias("_new"))
    both = stored.select("id", F.struct(*names).alias("_old")).join(new, "id", "full")
    pick = {c: F.when(F.col("_new").isNotNull(), F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))).otherwise(F.col(f"_old.{c}")) for c in names}
    pick["first_seen"] = F.coalesce("_old.first_seen", "_new.first_seen", now)
    pick["config"] = F.coalesce("_old.config", "_new.config")
    pick["last_ingested"] = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("_old.last_ingested"))
    return both.select("id", *(pick[c].alias(c) for c in names))


def delete_conversations(a: Archive, gone: DataFrame) -> Archive:
    """The archive without the conversations of gone(id), from blocks to raw events."""
    gone = gone.select(F.col("id").alias("__gone")).distinct()
    lost = a.conversations.join(gone, F.col("id") == F.col("__gone"), "left_semi")
    messages = a.messages.join(gone, F.col("conversation_id") == F.col("__gone"), "left_anti")
    blocks = a.content_blocks.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi").select(a.content_blocks.columns)
    raw = a.raw_events.join(lost.select("source_id", F.col("source_native_id").alias("source_native_conversation_id")), ["source_id", "source_native_conversation_id"], "left_anti").select(a.raw_events.columns)
    return Archive(a.sources, a.conversations.join(gone, F.col("id") == F.col("__gone"), "left_anti"), messages, blocks, raw)


def upsert_archive(stored: Archive, new: Archive, now: Column | None = None) -> Archive:
    """stored with the conversations of new, whose content hashes are made here if one is missing. Unchanged ones keep their rows and take the new path and mtime;
    of changed ones, rows that are equal as a prefix keep their values, ingest times included."""
    now = F.current_timestamp() if now is None else now
    if not new.conversations.where("content_hash is null").isEmpty():
        new = with_content_hashes(new)
    actions = classify_changes(new.conversations, stored.conversations)
    changed = actions.where("action != 'unchanged'").select("id")
    rest, fresh = delete_conversations(stored, changed), delete_conversations(new, actions.where("action = 'unchanged'"))
    seen = new.conversations.select("id", F.col("raw_path").alias("__path"), F.col("source_file_mtime").alias("__mtime"), F.lit(True).alias("__seen"))
    kept = rest.conversations.join(seen, "id", "left").withColumn("raw_path", F.when(F.col("__seen"), F.col("__path")).otherwise(F.col("raw_path"))).withColumn("source_file_mtime", F.when(F.col("__seen"), F.col("__mtime")).otherwise(F.col("source_file_mtime")))
    kept = kept.select(rest.conversations.columns)
    old_events = stored.raw_events.select("id", F.col("raw_path").alias("__path"), F.col("payload").alias("__payload"), F.col("ingested_at").alias("__at"))
    same = F.col("raw_path").eqNullSafe(F.col("__path")) & F.col("payload").eqNullSafe(F.col("__payload"))
    events = fresh.raw_events.join(old_events, "id", "left").withColumn("ingested_at", F.when(same & F.col("__at").isNotNull(), F.col("__at")).otherwise(now)).select(fresh.raw_events.columns)
    return Archive(
        sources=register_sources(stored.sources, new.sources, now),
        conversations=kept.unionByName(fresh.conversations.withColumn("ingested_at", now)),
        messages=rest.messages.unionByName(fresh.messages),
        content_blocks=rest.content_blocks.unionByName(fresh.content_blocks),
        raw_events=rest.raw_events.unionByName(events),
    )


def upsert_folder(spark: SparkSession, folder: str, new: Archive, buckets: int | None = None, now: Column | None = None, gone: DataFrame | None = None, diverged: DataFrame | None = None, segments: DataFrame | None = None, saved: bool = False) -> DataFrame:
    """upsert_archive on a written archive, as one new version of it. Returns (id, action), also removed of those of gone(id) that were there.

    Only buckets that hold conversations which change are read and written; where nothing changes, no table is. diverged are new conversations' divergences,
    segments those of a log that the version then is made of. If another writer commits first, its version is taken as what is stored and all is done again. saved says that new's tables are written already.
    """
    new = new if saved else new.saved()
    new = replace(new, conversations=scratch.save(with_content_hashes(new).conversations, "conversations"))
    diverged = spark.createDataFrame([], DIVERGENCES) if diverged is None else scratch.save(diverged, "divergences")
    gone = spark.createDataFrame([], "id string") if gone is None else scratch.save(gone.select("id").distinct(), "gone")
    while True:
        base = read_manifest(spark, folder) or Manifest(0, buckets or buckets_for(new))
        try:
            return _upserted(spark, folder, base, new, now, gone, diverged, segments)
        except Conflict:
            continue


def _upserted(spark: SparkSession, folder: str, base: Manifest, new: Archive, now: Column | None, gone: DataFrame, diverged: DataFrame, segments: DataFrame | None) -> DataFrame:
    numbers = lambda df, column: {r["bucket"] for r in df.select(bucket_of(column, base.buckets)).distinct().collect()}  # noqa: E731  at most base.buckets
    seen = numbers(new.conversations, "id") | numbers(gone, "id")
    stored = read_archive(spark, folder, base, seen)
    actions = classify_changes(new.conversations, stored.conversations)
    removed = stored.conversations.join(gone, "id", "left_semi").select("id", F.lit("removed").alias("action"))
    actions = scratch.save(actions.join(gone, "id", "left_anti").unionByName(removed), "actions")
    # An unchanged conversation is written again only if its path or time is another one.
    old = stored.conversations.select("id", F.col("raw_path").alias("_path"), F.col("source_file_mtime").alias("_mtime"))
    moved = new.conversations.select("id", "raw_path", "source_file_mtime").join(old, "id").where(~(F.col("raw_path").eqNullSafe(F.col("_path")) & F.col("source_file_mtime").eqNullSafe(F.col("_mtime")))).select("id")
    touched = numbers(actions.where("action != 'unchanged'").select("id").unionByName(moved), "id")
    version, made, sources = uuid.uuid4().hex, {}, base.sources
    if touched:
        of = lambda df, column: df.where(bucket_of(column, base.buckets).isin(sorted(touched)))
        kept = of(new.conversations, "id").join(gone, "id", "left_anti")
        own = replace(new, conversations=kept)
        own = replace(own, messages=new.messages.join(kept.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(new.messages.columns))
        own = replace(own, content_blocks=new.content_blocks.join(own.messages.select(F.col("id").alias("message_id")), "message_id", "left_semi").select(new.content_blocks.columns))
        own = replace(own, raw_events=new.raw_events.join(kept.select("source_id", F.col("source_native_id").alias("source_native_conversation_id")), ["source_id", "source_native_conversation_id"], "left_semi").select(new.raw_events.columns))
        before = read_archive(spark, folder, base, touched)
        tables = upsert_archive(delete_conversations(before, gone), own, now).keyed(base.buckets)
        divs = read_table(spark, folder, base, "divergences", touched).join(new.conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")
        divs = divs.select(diverged.columns).unionByName(of(diverged, "conversation_id")).join(gone.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti").select(diverged.columns)
        made = write_version(spark, folder, version, tables | {"divergences": divs.select("*", bucket_of("conversation_id", base.buckets))}, base.buckets)
        sources = version
    current = {name: {b: v for b, v in own.items() if int(b) not in touched} | made.get(name, {}) for name, own in (dict.fromkeys(made, {}) | base.files).items()}
    listed = base.segments
    if segments is not None:
        segments.select("segment").distinct().write.parquet(f"{folder}/writes/{version}/segments")
        listed = (*listed, version)
    if touched or segments is not None:
        commit_manifest(spark, folder, Manifest(base.number + 1, base.buckets, current, sources, listed))
    return actions
