"""The observation log: immutable segments, each of one device, and a commit per segment that gives its numbers.

A segment's rows are written first, with their place in it, under `segments/`; nothing reads them yet. Its commit is a small file under `commits/`, named by the
device's next sequence number and made only if there is none of that name: of two collectors of one device, one gets the number and
the other tries the next. device_seq is the commit's first number plus the place, so numbers have no gap and rows are never rewritten for them.
A segment without a commit, of a job that died, is not read, and its next attempt replaces it; a committed one is left as it is.

Segments are cut by a hash of the key, so that what is known of a few keys is read from their cuts alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import files, scratch
from ..archive import OBSERVATIONS
from ..numbering import in_order, parts_of
from .changes import KEY

COLUMNS = [c.split()[0] for c in OBSERVATIONS.split(", ")]
STATES = "source_id string, scope string, locator string, length long, sha256 string, mtime double"
COMMITS = "segment string, device_id string, first long, rows long"
#: Cuts of a segment, fixed for all logs.
CUTS = 16
STORED = ", ".join(c for c in OBSERVATIONS.split(", ") if c.split()[0] not in ("device_id", "device_seq", "segment"))


def cut_of() -> Column:
    """The cut of a segment that a key's observations are in."""
    return F.pmod(F.xxhash64(*KEY), F.lit(CUTS)).cast("int")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """COMMITS of the log: a row per segment."""
    if not files.names(spark, f"{folder}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).option("recursiveFileLookup", True).json(f"{folder}/commits")


def read_observations(spark: SparkSession, folder: str, content: bool = True, segments: list[str] | None = None, cuts: list[int] | None = None) -> DataFrame:
    """The log's observations; without content a scan reads headers only. Only the files of the given segments and cuts are read."""
    if not files.exists(spark, f"{folder}/segments"):
        found = spark.createDataFrame([], OBSERVATIONS)
        return found if content else found.drop("content")
    rows = spark.read.schema(f"place long, {STORED}, segment string, cut int").parquet(f"{folder}/segments")
    if segments is not None:
        rows = rows.where(F.col("segment").isin(segments))
    if cuts is not None:
        rows = rows.where(F.col("cut").isin(cuts))
    rows = rows.join(commits(spark, folder), "segment").withColumn("device_seq", F.col("first") + F.col("place") - 1)
    return rows.select([c for c in COLUMNS if content or c != "content"])


def _device_folder(folder: str, device: str) -> str:
    return f"{folder}/commits/device-{quote(device, safe='')}"


def commit(spark: SparkSession, folder: str, device: str, segment: str, rows: int) -> int:
    """Gives a written segment the device's next numbers; returns the first one. Another writer's commit in between only moves it on."""
    own = _device_folder(folder, device)
    while True:
        last = files.names(spark, own)[-1:]
        first = 1
        if last:
            known = json.loads(files.read(spark, f"{own}/{last[0]}"))
            first = known["first"] + known["rows"]
        text = json.dumps({"segment": segment, "device_id": device, "first": first, "rows": rows})
        if files.create(spark, f"{own}/{first:016d}.json", text):
            return first


def append_observations(spark: SparkSession, folder: str, new: DataFrame, device: str, observed_at: Column | None = None, legacy: bool = False, segment: str | None = None) -> str | None:
    """Writes new observations (as collect_changes gives them) as one segment of this device; returns its name, or None if there are none.

    Numbers follow the order of key, kind and offset. To try again after a failure, name the segment: what was committed stays as it is.
    """
    segment = uuid.uuid4().hex if segment is None else segment
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", segment):
        raise ValueError("a segment's name is made of letters, digits, dots and hyphens")
    if not commits(spark, folder).where(F.col("segment") == segment).isEmpty():
        return segment
    rows = in_order(new, [*KEY, "kind", "byte_offset"])
    parts = scratch.save(parts_of(rows), "parts")
    total = parts.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return None
    stated = {"content_sha256": F.sha2("content", 256), "length": F.octet_length("content").cast("long"), "legacy": F.lit(legacy)}
    stated["observed_at"] = F.current_timestamp() if observed_at is None else observed_at
    placed = rows.join(parts.select("part", "shift"), "part").withColumns(stated)
    placed = placed.select((F.col("row") + F.col("shift") + 1).alias("place"), *(c.split()[0] for c in STORED.split(", ")), cut_of().alias("cut"))
    _write(placed, folder, segment)
    commit(spark, folder, device, segment, total)
    return segment


def _write(rows: DataFrame, folder: str, segment: str) -> None:
    rows.hint("rebalance", "cut").write.mode("overwrite").partitionBy("cut").parquet(f"{folder}/segments/segment={segment}")


def new_segments(observations: DataFrame, indexed: DataFrame) -> DataFrame:
    """Segments of the log that have not been indexed yet."""
    return observations.select("segment").distinct().join(indexed.select("segment"), "segment", "left_anti")


def index_observations(index: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with arrived observations that it lacks, each once, and the keys that these touch."""
    fresh = arrived.join(index.select("device_id", "device_seq"), ["device_id", "device_seq"], "left_anti").select(*index.columns).dropDuplicates(["device_id", "device_seq"])
    return index.unionByName(fresh), fresh.select(*KEY).distinct()


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a key's observations in order, those that a replay takes: an append past the end of what is there is not."""
    last, end = None, 0
    for batch in batches:
        rows = batch.to_pydict()
        taken = []
        for *key, kind, offset, size in zip(*(rows[c] for c in (*KEY, "kind", "byte_offset", "size")), strict=True):
            if key != last:
                last, end = key, 0
            fits = kind == "snapshot" or offset <= end
            end = (0 if kind == "snapshot" else offset) + size if fits else end
            taken.append(fits)
        yield batch.filter(pa.array(taken, pa.bool_()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and SHA-256 of each key's pieces, which come in order, in batches that may end inside a key."""
    names = [*KEY, "length", "sha256"]
    types = [pa.string()] * 3 + [pa.int64(), pa.string()]
    last, length, digest = None, 0, hashlib.sha256()
    for batch in batches:
        done = []
        rows = batch.to_pydict()
        for *key, piece in zip(*(rows[c] for c in (*KEY, "piece")), strict=True):
            if key != last:
                if last is not None:
                    done.append((*last, length, digest.hexdigest()))
                last, length, digest = key, 0, hashlib.sha256()
            length += len(piece or b"")
            digest.update(piece or b"")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, types, strict=True)], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*last, length, digest.hexdigest()), types, strict=True)], names=names)


def pieces(observations: DataFrame) -> DataFrame:
    """(KEY, device_seq, at, size) of what a replay of one device's observations leaves: size bytes from the start of observation device_seq, at a place.

    A snapshot replaces the content; an append ends it at its offset and puts its bytes there; one past the end is ignored. So an observation keeps what is
    before the least offset of those that come later, and pieces follow each other. Contents are not read.
    """
    key = Window.partitionBy(*KEY)
    start = F.max(F.when(F.col("kind") == "snapshot", F.col("device_seq"))).over(key)
    rows = observations.select(*KEY, "device_seq", "kind", F.when(F.col("kind") == "snapshot", 0).otherwise(F.col("byte_offset")).cast("long").alias("byte_offset"), F.col("length").alias("size"), start.alias("start"))
    rows = rows.where(F.col("device_seq") >= F.coalesce("start", F.lit(0))).drop("start")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "device_seq")
    taken = rows.mapInArrow(_accepted, rows.schema)
    later = F.min("byte_offset").over(key.orderBy(F.desc("device_seq")).rowsBetween(Window.unboundedPreceding, -1))
    size = F.least(F.col("size"), later - F.col("byte_offset"))
    return taken.select(*KEY, "device_seq", F.col("byte_offset").alias("at"), size.alias("size")).where("size > 0")


def collector_state(observations: DataFrame, device: str) -> DataFrame:
    """STATES of what this device has logged, its observations replayed in order, in time in proportion to their bytes; a key's bytes stream through one task, none is held."""
    own = observations.where((F.col("device_id") == device) & ~F.col("legacy") & (F.col("kind") != "tombstone"))
    left = pieces(own.drop("content"))
    content = own.select(*KEY, "device_seq", "content")
    rows = left.join(content, [*KEY, "device_seq"]).select(*KEY, "at", F.substring("content", F.lit(1), F.col("size").cast("int")).alias("piece"))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "at")
    found = rows.mapInArrow(_hashed, "source_id string, scope string, locator string, length long, sha256 string")
    states = own.select(*KEY).distinct().join(found, KEY, "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return states.select(*KEY, F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("sha256", empty).alias("sha256"), F.lit(None).cast("double").alias("mtime"))


def audit_observations(observations: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(device_id, device_seq, segment, problem): what a log must not hold: numbers that do not grow in a segment, numbers used twice, a segment of two devices,
    contents that are not what their hash or length says, kinds that do not exist; with commits, segments that begin at another number than committed or have not as many rows."""
    segment = Window.partitionBy("segment")
    seen = {"_before": F.lag("device_seq").over(segment.orderBy("device_seq")), "_first": F.min("device_id").over(segment), "_seen": F.count(F.lit(1)).over(Window.partitionBy("device_id", "device_seq"))}
    rows = observations.withColumns(seen)
    problems = [
        F.when(F.col("_seen") > 1, "used twice"),
        F.when(F.col("device_seq") <= F.col("_before"), "out of order"),
        F.when(F.col("device_id") != F.col("_first"), "of another device"),
        F.when(~F.col("kind").isin("append", "snapshot", "tombstone"), "unknown kind"),
        F.when((F.col("kind") != "tombstone") & ~(F.sha2("content", 256) == F.col("content_sha256")), "content and hash differ"),
        F.when((F.col("kind") != "tombstone") & ~(F.octet_length("content") == F.col("length")), "content and length differ"),
    ]
    if commits is not None:
        named = commits.groupBy("segment").agg(F.min("first").alias("_named"), F.min("rows").alias("_rows"))
        rows = rows.withColumns({"_least": F.min("device_seq").over(segment), "_n": F.count(F.lit(1)).over(segment)}).join(named, "segment", "left")
        at_first = F.col("device_seq") == F.col("_least")  # one row speaks for its segment
        problems.append(F.when(at_first & ~F.col("_least").eqNullSafe(F.col("_named")), "begins at another number"))
        problems.append(F.when(at_first & ~F.col("_n").eqNullSafe(F.col("_rows")), "not as many as committed"))
    return rows.select("device_id", "device_seq", "segment", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def space_of(spark: SparkSession, folder: str, space: str | None = None) -> str | None:
    """The name of the space that a log belongs to, once it has one; it takes the given one if it has none."""
    if space is not None:
        files.create(spark, f"{folder}/space.txt", space)
    return files.read(spark, f"{folder}/space.txt") if files.exists(spark, f"{folder}/space.txt") else None


def missing_segments(own: DataFrame, other: DataFrame, device: str, reseed: bool = False) -> DataFrame:
    """(segment, device_id, direction) that two replicas lack: this device's own segments are pushed, those of other devices pulled; to reseed, segments of every device are pushed."""
    segments = lambda df: df.select("segment", "device_id").distinct()
    pushed = segments(own).join(segments(other), ["segment", "device_id"], "left_anti")
    pushed = pushed if reseed else pushed.where(F.col("device_id") == device)
    pulled = segments(other).join(segments(own), ["segment", "device_id"], "left_anti").where(F.col("device_id") != device)
    return pushed.withColumn("direction", F.lit("push")).unionByName(pulled.withColumn("direction", F.lit("pull")))


def replicate(spark: SparkSession, own_folder: str, other_folder: str, device: str, reseed: bool = False) -> None:
    """Copies the segments that each of two logs lacks into the other one; those of other devices must pass the audit, and both logs be of one space."""
    spaces = space_of(spark, own_folder), space_of(spark, other_folder)
    if None not in spaces and spaces[0] != spaces[1]:
        raise ValueError(f"the logs are of two spaces, {spaces[0]} and {spaces[1]}")
    own, other = read_observations(spark, own_folder), read_observations(spark, other_folder)
    lacking = missing_segments(own.drop("content"), other.drop("content"), device, reseed)
    pulled = other.join(lacking.where("direction = 'pull'").select("segment"), "segment", "left_semi")
    bad = audit_observations(pulled, commits(spark, other_folder)).limit(1).collect()
    if bad:
        raise ValueError(f"segment {bad[0]['segment']} cannot be taken: {bad[0]['problem']}")
    pushed = own.join(lacking.where("direction = 'push'").select("segment"), "segment", "left_semi")
    for rows, folder in ((pulled, own_folder), (pushed, other_folder)):
        _copy(spark, scratch.save(rows, "segments"), folder)


def _copy(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Writes segments of another log, with the numbers that they have, one by one; a commit whose number is taken by another segment is an error."""
    heads = rows.groupBy("segment", "device_id").agg(F.min("device_seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    for head in sorted(heads.collect(), key=lambda r: (r["device_id"], r["first"])):  # a row per segment that one replica lacks
        own = rows.where(F.col("segment") == head["segment"]).withColumn("place", F.col("device_seq") - head["first"] + 1)
        _write(own.select("place", *(c.split()[0] for c in STORED.split(", ")), cut_of().alias("cut")), folder, head["segment"])
        if not files.create(spark, f"{_device_folder(folder, head['device_id'])}/{head['first']:016d}.json", json.dumps(head.asDict())):
            raise ValueError(f"two segments of {head['device_id']} begin at {head['first']}")


def device_summary(own: DataFrame, other: DataFrame) -> DataFrame:
    """(device_id, segments, last_seq, other_segments, other_last_seq) of both replicas."""
    count = lambda df, prefix: df.groupBy("device_id").agg(F.count_distinct("segment").alias(f"{prefix}segments"), F.max("device_seq").alias(f"{prefix}last_seq"))
    both = count(own, "").join(count(other, "other_"), "device_id", "full")
    zero = F.lit(0).cast("long")
    return both.select("device_id", *(F.coalesce(c, zero).alias(c) for c in ("segments", "last_seq", "other_segments", "other_last_seq")))


def import_raw_events(conversations: DataFrame, raw_events: DataFrame, observations: DataFrame) -> DataFrame:
    """Another archive's conversations as snapshots to log: each one's payloads by line, a line each. Empty ones and contents logged already are left out."""
    lines = raw_events.groupBy("source_id", F.col("source_native_conversation_id").alias("locator")).agg(F.array_sort(F.collect_list(F.struct("line_number", "payload"))).alias("own"))
    text = F.concat(F.array_join(F.transform("own", lambda x: F.coalesce(x["payload"], F.lit(""))), "\n"), F.lit("\n"))
    found = lines.withColumn("content", text.cast("binary")).withColumn("content_sha256", F.sha2("content", 256))
    named = conversations.select("source_id", F.col("source_native_id").alias("locator"), F.col("raw_path").alias("path"), F.col("project").alias("project_hint"))
    found = found.join(named, ["source_id", "locator"]).withColumn("scope", F.lit(""))
    found = found.join(observations.select(*KEY, "content_sha256"), [*KEY, "content_sha256"], "left_anti")
    return found.select(*KEY, F.lit("snapshot").alias("kind"), F.lit(0).cast("long").alias("byte_offset"), F.octet_length("content").cast("long").alias("length"), "content_sha256", "path", "project_hint", "content")
