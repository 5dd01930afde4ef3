"""Catch-up: newly arrived segments of the log are applied to a written archive, once or as a stream.

What is known of a conversation is always made from all its observations, so a batch that runs again, late or out of order changes nothing.
A batch reads the headers of its own segments, then the cuts of the log and the buckets of the archive that hold the keys which these touch. What changes, and
that these segments were applied, is one version of the archive.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import files, scratch
from ..archive import Conflict, Manifest, bucket_of, buckets_for, commit_manifest, read_manifest, read_segments, read_table, write_version
from ..functions import columns as C
from ..operators.changes import KEY, upsert_folder, with_content_hashes
from ..operators.merge import conversation_locator
from ..operators.observations import COMMITS, collector_state, commits, cut_of, read_observations
from .projections import OUTCOMES, message_of, read_projection, write_projection

#: Observed bytes that a rebuild projects at once; a part has at least a cut of the log.
PART_BYTES = 64 << 30


@dataclass
class Rebuilt:
    """The version that a rebuild has made, OUTCOMES of all keys in the log, and STATES of what the device has logged."""

    manifest: Manifest
    outcomes: DataFrame
    states: DataFrame


def conversation_ids() -> Column:
    return C.conversation_id(F.col("source_id"), conversation_locator())


def apply(spark: SparkSession, log: str, archive: str, segments: list[str], device: str = "", buckets: int | None = None, most_failed: int = 100) -> DataFrame:
    """Projects the conversations that segments touch and upserts them; OUTCOMES of each key.

    outcome is unchanged where what was projected is what was stored. A conversation with a tombstone is deleted from the archive. One that can't be made fails alone:
    what the archive has of it stays, error says why, and it is tried again when a later segment touches it. More than most_failed of them are an error, and nothing is stored.
    """
    names = spark.createDataFrame([(s,) for s in segments], "segment string")
    keys = scratch.save(read_observations(spark, log, content=False, segments=segments).select(*KEY).distinct(), "keys")
    cuts = [r["cut"] for r in keys.select(cut_of().alias("cut")).distinct().collect()]  # at most CUTS
    touched = scratch.save(read_observations(spark, log, cuts=cuts).join(keys, KEY, "left_semi"), "touched")
    found = read_projection(spark, write_projection(touched, scratch.new_path(spark, "projected"), device, most_failed).folders)
    outcomes = found.outcomes.select("*", conversation_ids().alias("id"))
    gone = outcomes.where("outcome = 'removed'").select("id")
    actions = upsert_folder(spark, archive, found.archive, buckets, gone=gone, diverged=found.divergences, segments=names, saved=True)
    outcome = F.when((F.col("outcome") == "stored") & (F.col("action") == "unchanged"), "unchanged").otherwise(F.col("outcome"))
    return outcomes.join(actions, "id", "left").select(*KEY, outcome.alias("outcome"), "error")


def divergences(spark: SparkSession, archive: str) -> DataFrame:
    """What the versions of the archive's conversations disagree about."""
    return read_table(spark, archive, read_manifest(spark, archive), "divergences")


def catch_up(spark: SparkSession, log: str, archive: str, device: str = "", buckets: int | None = None, together: int = 1000) -> DataFrame:
    """apply() for the segments of the log that are not in the archive, up to `together` at a time; OUTCOMES of the last time a key was touched."""
    arrived = commits(spark, log).join(read_segments(spark, archive), "segment", "left_anti")
    names = [r["segment"] for r in scratch.save(arrived.orderBy("device_id", "first").select("segment"), "arrived").toLocalIterator()]
    outcomes = spark.createDataFrame([], OUTCOMES)
    for at in range(0, len(names), together):
        more = scratch.save(apply(spark, log, archive, names[at : at + together], device, buckets), "outcomes")
        outcomes = outcomes.join(more, KEY, "left_anti").select(*KEY, "outcome", "error").unionByName(more)
    return outcomes


def stream_catch_up(spark: SparkSession, log: str, archive: str, checkpoint: str, device: str = "", buckets: int | None = None, every: str | None = None, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Follows the log's commits: the segments of each batch that the archive lacks are applied. every is a processing time such as '5 minutes'; without it what is there is applied, and the stream ends.

    after gets the outcomes of a batch, to refresh an index for example. A batch that is run again finds its segments in the archive.
    """
    arrivals = spark.readStream.schema(COMMITS).option("recursiveFileLookup", True).json(f"{log}/commits")

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        new = [r["segment"] for r in rows.join(read_segments(session, archive), "segment", "left_anti").select("segment").distinct().collect()]  # a batch's files
        if new:
            outcomes = apply(session, log, archive, new, device, buckets)
            if after:
                after(outcomes)

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _parts(spark: SparkSession, log: str, listed: DataFrame, part_bytes: int) -> list[list[int]]:
    """The cuts of the log that have observations, in parts of about part_bytes."""
    sizes = read_observations(spark, log, content=False).join(listed, "segment", "left_semi").groupBy(cut_of().alias("cut")).agg(F.sum("length").alias("size"))
    out, room = [], 0
    for r in sizes.orderBy("cut").collect():  # at most CUTS
        size = r["size"] or 0
        if not out or size > room:
            out.append([])
            room = part_bytes
        out[-1].append(r["cut"])
        room -= size
    return out


def segments_of(spark: SparkSession, archive: str, write: str) -> DataFrame:
    """(segment): those that a write lists."""
    return spark.read.schema("segment string").parquet(f"{archive}/writes/{write}/segments")


def _begun(spark: SparkSession, log: str, archive: str, device: str, part_bytes: int) -> tuple[str, list[list[int]]]:
    """The name and the parts of a rebuild that was begun for this log and device and has made no version yet, else of a new one. The write of its name lists its segments."""
    base = read_manifest(spark, archive)
    for name in files.names(spark, f"{archive}/rebuilds"):
        folder = f"{archive}/rebuilds/{name}"
        if base and name in base.segments:  # died after its commit
            files.delete(spark, folder)
        elif files.exists(spark, f"{folder}/begun.json"):
            known = json.loads(files.read(spark, f"{folder}/begun.json"))
            if (known["log"], known["device"]) == (log, device):
                return name, known["parts"]
    name = uuid.uuid4().hex
    commits(spark, log).select("segment").write.parquet(f"{archive}/writes/{name}/segments")
    parts = _parts(spark, log, segments_of(spark, archive, name), part_bytes)
    files.create(spark, f"{archive}/rebuilds/{name}/begun.json", json.dumps({"log": log, "device": device, "parts": parts}))
    return name, parts


def rebuild(spark: SparkSession, log: str, archive: str, device: str = "", buckets: int | None = None, at_once: int = 4, most_failed: int = 100, part_bytes: int = PART_BYTES) -> Rebuilt:
    """The whole archive from all observations, as a new version in place of all before it; readers keep theirs until it is committed.

    The log is projected in parts by its cuts, `at_once` side by side, and each part that is done has a marker. A rebuild that died goes on with the parts that have none, over
    the segments that it began with: later ones are not in its list, so the next catch-up applies them. A conversation that can't be made fails alone (most_failed of a part at most) and is
    not in the new version. An error that stops a part cancels the jobs of the others. Of an empty log the version is empty.
    """
    name, parts = _begun(spark, log, archive, device, part_bytes)
    folder, listed = f"{archive}/rebuilds/{name}", segments_of(spark, archive, name)
    tag, stopped, errors = f"rebuild-{name}", threading.Event(), []
    context = spark.sparkContext

    def marker(number: int) -> str:
        return f"{folder}/done/{number:04d}.json"

    def make(number: int) -> None:
        if stopped.is_set() or files.exists(spark, marker(number)):
            return
        context.addJobTag(tag)
        try:
            rows = read_observations(spark, log, cuts=parts[number]).join(listed, "segment", "left_semi")
            written = write_projection(rows, f"{folder}/parts", device, most_failed, lambda: not stopped.is_set())
            files.create(spark, marker(number), json.dumps(written.folders))  # of two rebuilds that go on with this one, the first one's stays
        except Exception as e:
            errors.append(e)
            stopped.set()
            context.cancelJobsWithTag(tag)
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(make, range(len(parts))))
    if errors:
        raise errors[0]
    found = read_projection(spark, [x for k in range(len(parts)) for x in json.loads(files.read(spark, marker(k)))])
    own = replace(found.archive, conversations=scratch.save(with_content_hashes(found.archive).conversations, "conversations"))
    outcomes = scratch.save(found.outcomes, "outcomes")
    used = 0
    while True:
        base = read_manifest(spark, archive)
        number = buckets or (base.buckets if base else 0) or used or buckets_for(own)
        if number != used:  # the first time, or another writer has changed it
            version, used = uuid.uuid4().hex, number
            divs = found.divergences.select("*", bucket_of("conversation_id", number))
            made = write_version(spark, archive, version, own.keyed(number) | {"divergences": divs}, number)
        manifest = Manifest((base.number if base else 0) + 1, number, made, version, (name,))
        try:
            commit_manifest(spark, archive, manifest)
            break
        except Conflict:  # the other version's segments are in the list as well, or the next catch-up applies them again
            continue
    files.delete(spark, folder)
    states = collector_state(read_observations(spark, log).join(listed, "segment", "left_semi"), device)
    return Rebuilt(manifest, outcomes, states)


def collect_installed(sources: dict[str, Callable[[], DataFrame]], at_once: int = 4) -> tuple[DataFrame | None, dict[str, str]]:
    """Handles of every source that can be read, and the errors of those that cannot; sources are scanned side by side, and one that fails stops no other."""

    def scan(name: str) -> DataFrame | str:
        try:
            return scratch.save(sources[name](), "handles")
        except Exception as e:  # any source's error is reported, not raised
            return message_of(e)

    with ThreadPoolExecutor(at_once) as pool:
        scanned = dict(zip(sources, pool.map(scan, sources), strict=True))
    found, failed = None, {k: v for k, v in scanned.items() if isinstance(v, str)}
    for handles in (v for v in scanned.values() if not isinstance(v, str)):
        found = handles if found is None else found.unionByName(handles)
    return found, failed
