"""The tables of an archive, as explicit schemas and as a bundle of DataFrames."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, scratch

SCHEMAS = {
    "sources": "id string, name string, adapter_version string, first_seen timestamp, last_ingested timestamp, config string",
    "conversations": "id string, source_id string, source_native_id string, title string, project string, started_at timestamp, ended_at timestamp, message_count int, content_hash string, raw_path string, metadata string, ingested_at timestamp, source_file_mtime double",
    "messages": "id string, conversation_id string, source_native_id string, parent_message_id string, role string, model string, created_at timestamp, sequence_index int, metadata string",
    "content_blocks": "id string, message_id string, block_index int, type string, text string, tool_name string, tool_use_id string, payload string",
    "raw_events": "id string, source_id string, source_native_conversation_id string, raw_path string, line_number int, payload string, ingested_at timestamp",
}
DIVERGENCES = "conversation_id string, fork_after string, branch_message string, devices array<string>"
#: Tables of a written archive.
KEYED = SCHEMAS | {"divergences": DIVERGENCES}
BUCKET_BYTES = 256 << 20
OBSERVATIONS = "device_id string, device_seq long, source_id string, scope string, locator string, kind string, byte_offset long, length long, content_sha256 string, observed_at timestamp, path string, project_hint string, legacy boolean, segment string, content binary"
HANDLES = "source_id string, scope string, locator string, path string, project_hint string, mtime double, content binary"
BLOCK = "struct<type: string, text: string, tool_name: string, tool_use_id: string, payload: string>"


@dataclass
class Archive:
    """The normalised tables; each is a DataFrame and may be lazy."""

    sources: DataFrame
    conversations: DataFrame
    messages: DataFrame
    content_blocks: DataFrame
    raw_events: DataFrame

    @property
    def tool_calls(self) -> DataFrame:
        """tool_use blocks with their message and conversation."""
        from .operators.analytics import tool_calls

        return tool_calls(self)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def saved(self) -> Archive:
        """The same tables, each computed once and written to the shared folder, for jobs that read them several times."""
        return Archive(**{name: scratch.save(df, name) for name, df in self.tables().items()})

    def write(self, folder: str, buckets: int | None = None) -> Archive:
        """Writes the tables as a new version of the archive in a folder, in place of all that it held. Returns a reader of what was written.

        Tables that belong to conversations are cut into buckets by a hash of the conversation's id, so that an upsert rewrites the buckets of changed
        conversations only. Without a number of buckets, the tables' size decides, so that a bucket has about BUCKET_BYTES.
        """
        spark, own = self.conversations.sparkSession, self.saved()
        buckets = buckets or buckets_for(own)
        version = uuid.uuid4().hex
        number = (read_manifest(spark, folder) or Manifest(0, buckets)).number + 1
        manifest = Manifest(number, buckets, write_version(spark, folder, version, own.keyed(buckets) | {"divergences": _empty(spark, "divergences")}, buckets), version)
        commit_manifest(spark, folder, manifest)
        return read_archive(spark, folder, manifest)

    def keyed(self, buckets: int) -> dict[str, DataFrame]:
        """The tables, with the bucket of the conversation that a row belongs to."""
        conversations = self.conversations.select("*", bucket_of("id", buckets))
        messages = self.messages.select("*", bucket_of("conversation_id", buckets))
        blocks = self.content_blocks.join(self.messages.select(F.col("id").alias("message_id"), bucket_of("conversation_id", buckets)), "message_id").select(*self.content_blocks.columns, "bucket")
        natives = self.conversations.select("source_id", F.col("source_native_id").alias("source_native_conversation_id"), bucket_of("id", buckets))
        raw = self.raw_events.join(natives, ["source_id", "source_native_conversation_id"]).select(*self.raw_events.columns, "bucket")
        return {"sources": self.sources, "conversations": conversations, "messages": messages, "content_blocks": blocks, "raw_events": raw}

    def register(self, spark: SparkSession) -> None:
        """Temporary views by the tables' names."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)
        self.tool_calls.createOrReplaceTempView("tool_calls")


class Conflict(RuntimeError):
    """Another writer has committed a version of the archive in the meantime."""


@dataclass(frozen=True)
class Manifest:
    """What an archive consists of at one version: where each bucket of each table is, the sources, and which segments of a log went into it.

    A version is one small file, made only if there is none of its number; all tables change with it at once, and what it names is never changed, so
    readers keep theirs. files has, by table and bucket, the write that it is of; segments names the writes that list segments.
    """

    number: int
    buckets: int
    files: dict[str, dict[str, str]] = field(default_factory=dict)
    sources: str | None = None
    segments: tuple[str, ...] = ()


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


def buckets_for(saved: Archive) -> int:
    """A power of two that gives buckets of about BUCKET_BYTES; saved are tables that were written."""
    spark = saved.conversations.sparkSession
    # Each input file's folder is asked for its size once.
    folders = {path.rsplit("/", 1)[0] for df in saved.tables().values() for path in df.inputFiles()[:1]}
    total = sum(files.size(spark, x) for x in folders)
    return 1 << max(4, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))


def read_manifest(spark: SparkSession, folder: str) -> Manifest | None:
    """The newest version's manifest."""
    last = files.names(spark, f"{folder}/manifests")[-1:]
    if not last:
        return None
    found = json.loads(files.read(spark, f"{folder}/manifests/{last[0]}"))
    return Manifest(**(found | {"segments": tuple(found["segments"])}))


def commit_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    """Makes a version the newest one; Conflict if its number is taken."""
    if not files.create(spark, f"{folder}/manifests/{manifest.number:010d}.json", json.dumps(asdict(manifest))):
        raise Conflict(f"version {manifest.number} of {folder} is another writer's")


def write_version(spark: SparkSession, folder: str, version: str, tables: dict[str, DataFrame], buckets: int) -> dict[str, dict[str, str]]:
    """Writes tables, keyed by bucket, under the name of a write; returns which buckets each has, as Manifest.files."""
    made: dict[str, dict[str, str]] = {}
    for name, df in tables.items():
        path = f"{folder}/writes/{version}/{name}"
        if name == "sources":
            df.write.parquet(path)
            continue
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        made[name] = {x.removeprefix("bucket="): version for x in files.names(spark, path)}
    return made


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], f"{KEYED[name]}, bucket int")


def read_table(spark: SparkSession, folder: str, manifest: Manifest | None, name: str, buckets: set[int] | None = None) -> DataFrame:
    """A table of an archive at a version; with buckets, those alone."""
    schema = KEYED[name]
    paths = []
    if manifest and name == "sources":
        paths = [f"{folder}/writes/{manifest.sources}/sources"] if manifest.sources else []
    elif manifest:
        own = manifest.files.get(name, {})
        paths = [f"{folder}/writes/{version}/{name}/bucket={b}" for b, version in own.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_archive(spark: SparkSession, folder: str, manifest: Manifest | None = None, buckets: set[int] | None = None) -> Archive:
    """The archive in a folder at a version, the newest one unless stated; later versions do not change it. A table that isn't there is empty."""
    manifest = manifest or read_manifest(spark, folder)
    return Archive(**{name: read_table(spark, folder, manifest, name, buckets) for name in SCHEMAS})


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(segment): segments of a log that an archive's newest version is made of."""
    manifest = read_manifest(spark, folder)
    paths = [f"{folder}/writes/{version}/segments" for version in (manifest.segments if manifest else ())]
    return spark.read.schema("segment string").parquet(*paths) if paths else spark.createDataFrame([], "segment string")


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes what only versions before the last `keep` are made of; returns how many writes went. A write that is no version's yet stays if it is under way."""
    numbers = files.names(spark, f"{folder}/manifests")
    gone, kept = numbers[:-keep], numbers[-keep:]
    named = lambda name: _writes(json.loads(files.read(spark, f"{folder}/manifests/{name}")))
    still = set().union(*map(named, kept)) if kept else set()
    old = set().union(*map(named, gone)) - still if gone else set()
    for version in old:
        files.delete(spark, f"{folder}/writes/{version}")
    for name in gone:
        files.delete(spark, f"{folder}/manifests/{name}")
    return len(old)


def _writes(manifest: dict) -> set[str]:
    return {v for own in manifest["files"].values() for v in own.values()} | {manifest["sources"], *manifest["segments"]} - {None}


def union(parts: list[Archive]) -> Archive:
    """The archives of several sources as one."""
    first, *rest = parts
    tables = first.tables()
    for part in rest:
        tables = {k: v.unionByName(part.tables()[k]) for k, v in tables.items()}
    return Archive(**tables)
