"""Merge of observations: what devices saw of a transcript becomes its versions, and its versions one conversation.

An observation is an append (bytes at an offset), a snapshot (the whole file) or a tombstone, keyed by (source_id, scope, locator). Nothing here
reads a clock or the order of arrival: the same set of observations gives the same conversation, whatever order or how often it came in.

Most keys take a path of columns only: those whose live fragments follow each other without overlap are one version, their bytes in order. The
keys whose fragments overlap, contradict or leave gaps are cut into atoms, and a function per key puts versions together from the atoms' hashes.
Versions are parsed by the source's normaliser, all at once, and merged by windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..archive import HANDLES, Archive, union
from ..functions import columns as C
from ..sources.assemble import Parsed
from ..sources.normalize import APPEND_ONLY, PARSERS
from .changes import KEY, tombstoned

CONTRIBUTOR = "struct<device: string, seq: bigint, path: string, project_hint: string>"
VERSIONS = f"source_id string, scope string, locator string, version int, legacy boolean, content binary, contributors array<{CONTRIBUTOR}>"
#: Joins a key's parts and a version into the locator of a parse, and is in no locator.
JOINT = "\x1f"


@dataclass
class Projection:
    """Conversations merged from observations, what their versions disagree about, and what became of each key."""

    archive: Archive
    divergences: DataFrame
    outcomes: DataFrame


def latest_snapshots(observations: DataFrame, append_only: Iterable[str] = APPEND_ONLY) -> DataFrame:
    """Observations without the snapshots that a later one of the same device supersedes, in sources that are logged as snapshots."""
    last = F.max(F.when(~F.col("legacy"), F.col("device_seq"))).over(Window.partitionBy(*KEY, "device_id"))
    kept = F.col("legacy") | F.col("source_id").isin(*append_only) | (F.col("device_seq") == last)
    return observations.withColumn("_kept", kept).where("_kept").drop("_kept")


def contributor() -> Column:
    return F.struct(F.col("device_id").alias("device"), F.col("device_seq").alias("seq"), "path", "project_hint").cast(CONTRIBUTOR)


def legacy_versions(observations: DataFrame) -> DataFrame:
    """Imports: each distinct content is a version of its own; the first by (device, seq) stands for it."""
    first = Window.partitionBy(*KEY, "content_sha256").orderBy("device_id", "device_seq")
    kept = observations.where("legacy").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("device_id", "device_seq"))
    return kept.select(*KEY, (place + 1_000_000).cast("int").alias("version"), F.lit(True).alias("legacy"), "content", F.array(contributor()).alias("contributors"))


class Version:
    """One consistent version of a file, while it is put together."""

    def __init__(self, content: Sequence) -> None:
        self.content = list(content)

    def agrees(self, offset: int, data: Sequence) -> bool:
        shared = self.content[offset : offset + len(data)]
        return offset <= len(self.content) and shared == list(data[: len(shared)])


def versions_of(fragments: list[tuple[int, Sequence, str, int]]) -> list[tuple[Sequence, list[int]]]:
    """Versions that (offset, data, device, seq) fragments describe, and the positions of those that agree with each.

    Fragments that agree extend a version. One that contradicts all of them begins another: at offset 0 a new file, else a fork of the first version
    that reaches so far. What lies past a gap waits for it to be filled. A version that begins another one is left out. Data are bytes, or tuples of
    whatever stands for them, with offsets in the same measure.
    """
    order = sorted(range(len(fragments)), key=lambda k: (fragments[k][0], -len(fragments[k][1]), *fragments[k][2:]))
    found: list[Version] = []
    waiting, placed = order, set()
    while waiting:
        left = []
        for k in waiting:
            offset, data = fragments[k][:2]
            fitting = [v for v in found if v.agrees(offset, data)]
            for v in fitting:
                v.content += data[len(v.content) - offset :] if offset + len(data) > len(v.content) else data[:0]
            if not fitting:
                base = next((v for v in found if len(v.content) >= offset), None)
                if offset and base is None:
                    left.append(k)
                    continue
                found.append(Version([*base.content[:offset], *data] if offset else data))
            placed.add(k)
        if len(left) == len(waiting):
            break
        waiting = left
    contents = [v.content for v in found]
    out = []
    for i, content in enumerate(contents):
        if any(j != i and other[: len(content)] == content and (len(other) > len(content) or j < i) for j, other in enumerate(contents)):
            continue
        here = lambda k, content=content: content[fragments[k][0] : fragments[k][0] + len(fragments[k][1])]
        agreeing = [k for k in order if k in placed and fragments[k][0] <= len(content) and here(k) == list(fragments[k][1])]
        out.append((type(fragments[0][1])(content), agreeing))
    return out


def _reconstructed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The versions of one key, from its fragments' places and the hashes of their atoms."""
    fragments = [(int(o), tuple(a), d, int(s)) for o, a, d, s in zip(pdf["first"], pdf["atoms"], pdf["device_id"], pdf["device_seq"], strict=True)]
    rows = []
    for n, (content, own) in enumerate(versions_of(fragments)):
        who = [{"device": pdf["device_id"].iloc[k], "seq": int(pdf["device_seq"].iloc[k]), "path": pdf["path"].iloc[k], "project_hint": pdf["project_hint"].iloc[k]} for k in own]
        rows.append((*pdf[KEY].iloc[0], n, list(content), who))
    return pd.DataFrame(rows, columns=[*KEY, "version", "atoms", "contributors"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of versions, whose pieces come in order."""
    last, held = None, []

    def row(key: tuple, held: list[bytes]) -> pa.RecordBatch:
        types = [pa.string()] * 3 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, b"".join(held)), types, strict=True)], names=[*KEY, "version", "content"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "version", "piece")]
        for *key, piece in zip(*columns, strict=True):
            if key != last:
                if last is not None:
                    yield row(last, held)
                last, held = key, []
            held.append(piece)
    if last is not None:
        yield row(last, held)


def contested_versions(fragments: DataFrame) -> DataFrame:
    """VERSIONS of keys whose fragments (KEY, byte_offset, content, device_id, device_seq, path, project_hint) overlap, contradict or leave gaps.

    All fragments of a key are cut where one of them begins or ends, so that each is a run of whole atoms, and atoms are equal if their SHA-256 are. The function that puts
    a key's versions together sees hashes only; a version's bytes are then put together from one fragment's piece for each of its atoms.
    """
    size = F.octet_length("content").cast("long")
    edges = fragments.select(*KEY, F.explode(F.array(F.lit(0).cast("long"), F.col("byte_offset"), F.col("byte_offset") + size)).alias("edge")).groupBy(*KEY)
    edges = edges.agg(F.array_sort(F.collect_set("edge")).alias("edges"))  # two numbers a fragment at most
    whole = fragments.join(edges, KEY).withColumn("first", F.array_position("edges", F.col("byte_offset")) - 1)
    count = F.array_position("edges", F.col("byte_offset") + size) - 1 - F.col("first")
    inner = F.slice("edges", (F.col("first") + 1).cast("int"), (count + 1).cast("int"))
    cut = whole.withColumn("count", count).withColumn("inner", inner)
    steps = F.when(F.col("count") > 0, F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))
    cut = cut.select(*KEY, "device_id", "device_seq", "byte_offset", "first", "content", "inner", F.explode(steps).alias("k"))
    at, to = F.get("inner", F.col("k")), F.get("inner", F.col("k") + 1)
    cut = cut.select(*KEY, "device_id", "device_seq", (F.col("first") + F.col("k")).alias("atom"), F.substring("content", (at - F.col("byte_offset") + 1).cast("int"), (to - at).cast("int")).alias("piece"))
    pieces = scratch.save(cut.withColumn("hash", F.unhex(F.sha2("piece", 256))), "pieces")
    atoms = pieces.groupBy(*KEY, "device_id", "device_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom", "hash"))), lambda x: x["hash"]).alias("atoms"))
    heads = whole.select(*KEY, "device_id", "device_seq", "path", "project_hint", "first").join(atoms, [*KEY, "device_id", "device_seq"], "left")
    heads = heads.withColumn("atoms", F.coalesce("atoms", F.array().cast("array<binary>")))
    schema = f"source_id string, scope string, locator string, version int, atoms array<binary>, contributors array<{CONTRIBUTOR}>"
    versions = scratch.save(heads.groupBy(*KEY).applyInPandas(_reconstructed, schema), "contested")
    wanted = versions.select(*KEY, "version", F.posexplode("atoms").alias("atom", "hash"))
    once = pieces.groupBy(*KEY, F.col("atom").cast("int").alias("atom"), "hash").agg(F.min("piece").alias("piece"))  # all of them are equal
    rows = wanted.join(once, [*KEY, "atom", "hash"]).select(*KEY, "version", "atom", "piece")
    contents = rows.repartition(*KEY, "version").sortWithinPartitions(*KEY, "version", "atom").mapInArrow(_joined, "source_id string, scope string, locator string, version int, content binary")
    found = versions.select(*KEY, "version", "contributors").join(contents, [*KEY, "version"], "left")
    return found.select(*KEY, "version", F.lit(False).alias("legacy"), F.coalesce("content", F.lit(b"")).alias("content"), "contributors")


def reconstruct_versions(observations: DataFrame) -> DataFrame:
    """VERSIONS of live observations. A snapshot covers the file from offset 0."""
    live = observations.where("not legacy").withColumn("byte_offset", F.when(F.col("kind") == "snapshot", 0).otherwise(F.col("byte_offset")).cast("long"))
    key, size = Window.partitionBy(*KEY), F.octet_length("content").cast("long")
    before = F.lag(F.col("byte_offset") + size).over(key.orderBy("byte_offset", F.desc(size), "device_id", "device_seq"))
    marked = live.withColumn("_follows", F.col("byte_offset") == F.coalesce(before, F.lit(0).cast("long"))).withColumn("_simple", F.min("_follows").over(key))
    own = F.struct("byte_offset", F.col("content").alias("content"), contributor().alias("by"))
    plain = marked.where("_simple").groupBy(*KEY).agg(F.array_sort(F.collect_list(own)).alias("own"))
    plain = plain.select(*KEY, F.lit(0).alias("version"), F.lit(False).alias("legacy"), F.unhex(F.array_join(F.transform("own", lambda x: F.hex(x["content"])), "")).alias("content"), F.transform("own", lambda x: x["by"]).alias("contributors"))
    rest = marked.where("not _simple").select(*KEY, "byte_offset", "content", "device_id", "device_seq", "path", "project_hint").dropDuplicates([*KEY, "device_id", "device_seq"])
    return plain.unionByName(contested_versions(rest))


def devices(contributors: Column) -> Column:
    """The distinct devices behind a version, sorted."""
    return F.array_sort(F.array_distinct(F.transform(contributors, lambda x: x["device"])))


def representative(contributors: Column, device: str) -> Column:
    """The observation whose path and hint describe a version: this device's latest, else the earliest by (device, seq)."""
    own = F.array_max(F.transform(F.filter(contributors, lambda x: x["device"] == device), lambda x: F.struct(x["seq"].alias("seq"), x["path"].alias("path"), x["project_hint"].alias("project_hint"))))
    least = F.array_min(contributors)
    field = lambda name: F.when(own.isNotNull(), own[name]).otherwise(least[name]).alias(name)
    return F.struct(field("path"), field("project_hint"))


def version_handles(versions: DataFrame, device: str) -> DataFrame:
    """HANDLES of versions; the locator names key and version."""
    by = representative(F.col("contributors"), device)
    locator = F.concat_ws(JOINT, "scope", "locator", F.col("version").cast("string"))
    found = versions.select("source_id", F.lit("").alias("scope"), locator.alias("locator"), by["path"].alias("path"), by["project_hint"].alias("project_hint"), F.lit(None).cast("double").alias("mtime"), "content")
    return found.to(found.sparkSession.createDataFrame([], HANDLES).schema)


def split_locator(df: DataFrame) -> DataFrame:
    """scope, locator and version from the locator of a parse."""
    own = F.split("locator", JOINT)
    return df.withColumns({"scope": F.get(own, F.lit(0)), "version": F.get(own, F.lit(2)).cast("int"), "locator": F.get(own, F.lit(1))})


def order_versions(versions: DataFrame, messages: DataFrame) -> DataFrame:
    """versions with rank from 0: live before imports, most messages, longest content, then the first contributor."""
    counts = messages.groupBy("scope", "locator", "version").agg(F.count(F.lit(1)).alias("_n"))
    first = F.get("contributors", F.lit(0))
    found = versions.join(counts, ["scope", "locator", "version"], "left")
    order = Window.partitionBy("scope", "locator").orderBy("legacy", F.desc(F.coalesce("_n", F.lit(0))), F.desc(F.octet_length("content")), first["device"], first["seq"], "version")
    return found.withColumn("rank", F.row_number().over(order) - 1).drop("_n")


def merge_messages(messages: DataFrame) -> DataFrame:
    """Messages of all versions (scope, locator, rank, sequence_index, ...) to those of the merged conversation: a new sequence_index, and
    block, null for what all versions have in common, else the number of its branch, fork, the primary position after which branches begin.

    The primary's messages come first. Messages that only other versions have stay together in blocks after the last primary message before them;
    from the earliest of these places on, the primary's rest and all blocks are put in order of their first message's time, then id.
    """
    conversation = Window.partitionBy("scope", "locator")
    key = F.coalesce(F.concat(F.lit("id:"), "source_native_id"), F.concat(F.lit("pos:"), F.col("sequence_index").cast("string")))
    m = messages.withColumn("_key", key)
    same = Window.partitionBy("scope", "locator", "_key")
    m = m.withColumn("_place", F.max(F.when(F.col("rank") == 0, F.col("sequence_index"))).over(same))
    earlier = F.row_number().over(same.orderBy("rank", "sequence_index"))
    m = m.withColumn("_new", (F.col("rank") > 0) & F.col("_place").isNull() & (earlier == 1))
    version = Window.partitionBy("scope", "locator", "rank").orderBy("sequence_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("_anchor", F.when(F.col("_new"), F.coalesce(F.last("_place", ignorenulls=True).over(version), F.lit(-1))))
    m = m.withColumn("_island", F.when(F.col("_new"), F.sum(F.when(F.col("_new"), 0).otherwise(1)).over(version)))
    m = m.where("rank = 0 or _new")
    last = F.max(F.when(F.col("rank") == 0, F.col("sequence_index"))).over(conversation)
    forks = F.min("_anchor").over(conversation)
    m = m.withColumn("fork", F.when(forks.isNotNull(), F.least(forks, F.coalesce(last, F.lit(-1)))))
    trunk = (F.col("rank") == 0) & (F.col("fork").isNull() | (F.col("sequence_index") <= F.col("fork")))
    m = m.withColumn("_trunk", trunk)
    group = Window.partitionBy("scope", "locator", "_trunk", "rank", "_island").orderBy("sequence_index")
    head = lambda c: F.when(~F.col("_trunk"), F.first(c).over(group))
    m = m.withColumns({"_time": head("created_at"), "_head": head(F.coalesce("source_native_id", F.lit(""))), "head_id": head("source_native_id")})
    at = conversation.orderBy(F.desc("_trunk"), F.col("_time").asc_nulls_last(), "_head", "rank", "_island", "sequence_index")
    return m.withColumn("sequence_index", F.row_number().over(at) - 1).drop("_key", "_place", "_new", "_anchor", "_time", "_head").withColumnRenamed("_island", "block")


def merge_events(events: DataFrame) -> DataFrame:
    """Raw events of all versions (scope, locator, rank, versions, line, raw): of several versions the union, the first of equal JSON values; a lone version's stay."""
    first = Window.partitionBy("scope", "locator", "_value").orderBy("rank", "line")
    kept = events.withColumn("_value", C.canonical(F.col("raw"))).withColumn("_n", F.row_number().over(first)).where("_n = 1 or versions = 1")
    return kept.withColumn("line", F.row_number().over(Window.partitionBy("scope", "locator").orderBy("rank", "line")) - 1).drop("_value", "_n")


def divergences(merged: DataFrame, primary: DataFrame, versions: DataFrame) -> DataFrame:
    """(scope, locator, fork_after, branch_message, devices): a row per live branch where two live versions disagree. Branches whose first message has no id are left out."""
    heads = merged.where("not _trunk").groupBy("scope", "locator", "rank", "block").agg(F.any_value("head_id").alias("branch_message"), F.any_value("fork").alias("fork"))
    ranked = versions.select("scope", "locator", "rank", "legacy", devices(F.col("contributors")).alias("devices"))
    found = heads.join(ranked, ["scope", "locator", "rank"]).where("not legacy")
    two = F.max(F.col("rank") > 0).over(Window.partitionBy("scope", "locator"))
    found = found.withColumn("_two", two).where("_two and branch_message is not null")
    after = primary.select("scope", "locator", F.col("sequence_index").alias("fork"), F.col("source_native_id").alias("fork_after"))
    return found.join(after, ["scope", "locator", "fork"], "left").select("scope", "locator", "fork_after", "branch_message", "devices")


def conversation_locator() -> Column:
    """The native id of a conversation: the locator, after the scope where there is one."""
    return F.when(F.col("scope") == "", F.col("locator")).otherwise(F.concat_ws("/", "scope", "locator"))


def merge(source: str, versions: DataFrame, device: str) -> tuple[Parsed, DataFrame]:
    """The merged conversations of one source, and their divergences."""
    parsed = PARSERS[source](version_handles(versions, device))
    # Each of them is read several times below; transcripts are parsed once.
    own, messages, events = (split_locator(scratch.save(df, "parsed")) for df in (parsed.conversations, parsed.messages, parsed.events))
    ranked = order_versions(versions, messages)
    ranks = ranked.select("scope", "locator", "version", "rank", F.count(F.lit(1)).over(Window.partitionBy("scope", "locator")).alias("versions"))
    on = ["scope", "locator", "version"]
    messages = messages.join(ranks, on).drop("version", "versions")
    merged = merge_messages(messages)
    found = divergences(merged, messages.where("rank = 0"), ranked)
    raw = merge_events(events.join(ranks, on).drop("version"))
    times = merged.groupBy("scope", "locator").agg(F.min("created_at").alias("_first"), F.max("created_at").alias("_last"), F.count("fork").alias("_forks"))
    counts = raw.groupBy("scope", "locator").agg(F.count(F.lit(1)).alias("_events"))
    c = own.join(ranks.where("rank = 0"), on).join(times, ["scope", "locator"]).join(counts, ["scope", "locator"], "left")  # without messages there is no conversation
    forked = F.col("_forks") > 0
    c = c.withColumns({
        "started_at": F.when(forked, F.col("_first")).otherwise(F.col("started_at")),
        "ended_at": F.when(forked, F.col("_last")).otherwise(F.col("ended_at")),
        "metadata": F.when(F.col("versions") > 1, C.with_event_count(F.col("metadata"), F.coalesce("_events", F.lit(0)))).otherwise(F.col("metadata")),
    })
    named = lambda df: df.withColumn("locator", conversation_locator()).drop("scope")
    conversations = named(c).select(*parsed.conversations.columns)
    raw = raw.drop("path").join(c.select("scope", "locator", F.col("raw_path").alias("path")), ["scope", "locator"])
    result = Parsed(source, parsed.version, conversations, named(merged).select(*parsed.messages.columns), named(raw).select(*parsed.events.columns))
    return result, named(found).select(C.conversation_id(F.lit(source), F.col("locator")).alias("conversation_id"), "fork_after", "branch_message", "devices")


def project(observations: DataFrame, device: str = "", sources: Iterable[str] | None = None) -> Projection:
    """Conversations from all their observations. A tombstone hides its key for good; sources without a normaliser stay in the log only."""
    names = sorted(PARSERS if sources is None else sources)
    keys = observations.select(*KEY).distinct()
    gone = tombstoned(observations)
    live = observations.where(F.col("source_id").isin(*names)).join(gone, KEY, "left_anti")
    live = latest_snapshots(live)
    versions = scratch.save(reconstruct_versions(live).unionByName(legacy_versions(live)), "versions")
    present = {r["source_id"] for r in versions.select("source_id").distinct().collect()}  # a row per normaliser at most
    parts, found = [], []
    for name in sorted(present) or names[:1]:
        merged, divs = merge(name, versions.where(F.col("source_id") == name).drop("source_id").withColumn("source_id", F.lit(name)), device)
        parts.append(merged.archive())
        found.append(divs)
    archive = union(parts)
    divs = found[0]
    for more in found[1:]:
        divs = divs.unionByName(more)
    stored = archive.conversations.select("source_id", F.col("source_native_id").alias("_native"), F.lit(True).alias("_stored"))
    known = keys.withColumn("_native", conversation_locator()).join(stored, ["source_id", "_native"], "left").join(gone.withColumn("_gone", F.lit(True)), KEY, "left")
    outcome = F.when(F.col("_gone"), "removed").when(~F.col("source_id").isin(*names), "unported").when(F.col("_stored"), "stored").otherwise("pending")
    return Projection(archive, divs, known.select(*KEY, outcome.alias("outcome")))


def affected(observations: DataFrame, new_segments: DataFrame) -> DataFrame:
    """All observations of the keys that new segments touch."""
    keys = observations.join(new_segments.select("segment").distinct(), "segment", "left_semi").select(*KEY).distinct()
    return observations.join(keys, KEY, "left_semi")
