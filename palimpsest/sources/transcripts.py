"""Scans: transcripts on disk, export arrays and relational sessions, as handles, and the events in them.

A handle is one conversation's bytes: source_id, scope, locator (the native id), path, project_hint, mtime, content.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: How each file source is laid out: a glob of file names, whether folders nest, and the pattern of the native id in the path.
LAYOUTS = {
    "claude_code": ("*.jsonl", False, r"([^/]*)\.jsonl$"),
    "codex_cli": ("rollout-*.jsonl", True, r"([^/-]*(?:-[^/-]*){4})\.jsonl$"),
    "omp": ("*.jsonl", False, r"/[^/_]*_([^/]*)\.jsonl$"),
}


def project_of_folder(source: str, folder: Column) -> Column:
    """A guess at a project's path from the name of its folder."""
    if source == "claude_code":
        return F.when(folder.startswith("-"), F.translate(folder, "-", "/"))
    if source == "omp":
        inner = F.regexp_replace(folder, "^-+|-+$", "")
        return F.when(folder.startswith("--"), F.concat(F.lit("/"), F.translate(inner, "-", "/"))).when(folder.startswith("-"), F.concat(F.lit("~/"), F.translate(inner, "-", "/")))
    return F.lit(None).cast("string")


def scan_transcripts(spark: SparkSession, root: str, source: str) -> DataFrame:
    """One handle per transcript file under root."""
    _, nested, _ = LAYOUTS[source]
    return _handles(spark, [root if nested else f"{root}/*/"], source).drop("file")


def scan_changed(spark: SparkSession, root: str, source: str, states: DataFrame) -> DataFrame:
    """Handles of the files whose time isn't the one that states (source_id, scope, locator, mtime) have of them. Only these files are opened; the others are listed.

    Their paths come to the driver, which has listed all files at this point.
    """
    _, nested, _ = LAYOUTS[source]
    listed = _handles(spark, [root if nested else f"{root}/*/"], source).drop("content")
    key = ["source_id", "scope", "locator"]
    known = states.select(*key, F.col("mtime").alias("known"))
    changed = listed.join(known, key, "left").where(~F.col("mtime").eqNullSafe(F.col("known"))).select("file")
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file"]) for r in changed.collect()]
    if not paths:
        return _handles(spark, [root if nested else f"{root}/*/"], source).drop("file").limit(0)
    return _handles(spark, paths, source).drop("file")


def _handles(spark: SparkSession, paths: list[str], source: str) -> DataFrame:
    names, nested, native = LAYOUTS[source]
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", str(nested).lower()).load(paths)
    path = F.regexp_replace("path", r"^file:/+", "/")
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    return found.select(
        F.lit(source).alias("source_id"),
        F.lit("").alias("scope"),
        F.regexp_extract(path, native, 1).alias("locator"),
        path.alias("path"),
        project_of_folder(source, folder).alias("project_hint"),
        F.col("modificationTime").cast("double").alias("mtime"),
        "content",
        F.col("path").alias("file"),
    ).where("locator != ''")


def scan_lines(spark: SparkSession, root: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The handles of transcript files under root, without their content, and the JSON objects in their lines, as explode_jsonl() gives them.

    Files are read in splits, so a long transcript is read by many tasks and is never one value. A line is in the split where it begins; its number is its place
    among its split's objects and the count of those in the splits before. Splits are named by where they begin, which is the same in both reads.
    """
    names, nested, _ = LAYOUTS[source]
    handles = scan_transcripts(spark, root, source).drop("content")
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", names).option("recursiveFileLookup", str(nested).lower())
    read = reader.text(root if nested else f"{root}/*/").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("order"))
    text = F.regexp_replace(F.make_valid_utf8("value"), r"^[\s]+|[\s]+$", "")
    objects = read.withColumn("raw", text).where("raw != ''").withColumn("v", C.parsed(F.col("raw"))).where(C.kind(F.col("v")) == "OBJECT")
    sizes = objects.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))  # a row per split
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("order")) - 1
    numbered = objects.withColumn("within", within).join(before, ["file", "start"])
    path = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    placed = numbered.select(path.alias("path"), (F.col("within") + F.col("before")).cast("int").alias("line"), "raw", "v")
    events = placed.join(handles.select("path", "source_id", "locator", "project_hint"), "path")
    return handles, events.select("source_id", "locator", "path", "project_hint", "line", "raw", "v")


def scan_export_array(spark: SparkSession, path: str, source: str = "claude_export") -> DataFrame:
    """One handle per object with a non-empty string `uuid` of a JSON array; a file that holds no array is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    items = F.when(C.kind(F.col("v")) == "ARRAY", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.lit("the export is not a JSON array")).cast("array<variant>"))
    rows = files.select("path", F.explode(items).alias("v")).where(C.kind(F.col("v")) == "OBJECT")
    rows = rows.withColumn("locator", C.non_empty(F.col("v"), "uuid")).where("locator is not null")
    return rows.select(
        F.lit(source).alias("source_id"), F.lit("").alias("scope"), "locator", "path", F.lit(None).cast("string").alias("project_hint"), F.lit(None).cast("double").alias("mtime"), F.to_json("v").cast("binary").alias("content")
    )


def rows_of(df: DataFrame) -> Column:
    """A table's row as a struct, binary columns left out."""
    return F.struct(*[c for c, type_ in df.dtypes if type_ != "binary"])


def grouped(children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """(session key, name): the ordered rows of each session, as JSON text of an array."""
    rows = children.groupBy(F.col(key).cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct(*order, rows_of(children).alias("row")))).alias("rows"))
    return rows.select("key", F.to_json(F.transform("rows", lambda r: r["row"])).alias(name))


def session_documents(source: str, path: str, session_name: str, sessions: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], profile: str | None = None) -> DataFrame:
    """One handle per session: an object of the session's row and, by name, arrays of its children's rows in their order."""
    own = sessions.select(F.col("id").cast("string").alias("key"), F.to_json(rows_of(sessions)).alias("session"))
    for name, (rows, order) in children.items():
        own = own.join(grouped(rows, "session_id", order, name), "key", "left")
    members = {session_name: F.col("session")} | {name: F.coalesce(name, F.lit("[]")) for name in children}
    locator = F.concat_ws("/", F.lit(profile), "key") if profile else F.col("key")
    return own.select(
        F.lit(source).alias("source_id"),
        F.lit("").alias("scope"),
        locator.alias("locator"),
        F.lit(path).alias("path"),
        F.lit(None).cast("string").alias("project_hint"),
        F.lit(None).cast("double").alias("mtime"),
        C.object_text(**members).cast("binary").alias("content"),
    )


def session_documents_v1(sessions: DataFrame, messages: DataFrame, parts: DataFrame, path: str = "opencode.db") -> DataFrame:
    """Sessions with messages and parts, both in order of time_created, then id."""
    order = ["time_created", "id"]
    return session_documents("opencode", path, "session", sessions, {"messages": (messages, order), "parts": (parts, order)})


def session_documents_v2(sessions: DataFrame, messages: DataFrame, path: str = "opencode.db") -> DataFrame:
    """Sessions of the second layout, messages in order of seq."""
    return session_documents("opencode", path, "session_v2", sessions, {"session_message": (messages, ["seq"])})


def only_newer_layout(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Handles of both layouts; a session in both is read from the second one."""
    return v1.join(v2.select("locator"), "locator", "left_anti").select(v2.columns).unionByName(v2)


def session_documents_hermes(sessions: DataFrame, messages: DataFrame, profile: str | None = None, path: str = "state.db") -> DataFrame:
    """Sessions with messages in order of (timestamp, id); ids of a named profile are prefixed with it."""
    return session_documents("hermes_agent", path, "session", sessions, {"messages": (messages, ["timestamp", "id"])}, profile)


def explode_jsonl(handles: DataFrame) -> DataFrame:
    """One row per JSON object of the content's lines: source_id, locator, path, project_hint, line, raw, v. Blank, malformed and
    non-object lines are left out, and lines are numbered from 0 after that, inside the array and so without a shuffle. Bytes that are no UTF-8 become U+FFFD."""
    lines = F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s]+|[\s]+$", "")), lambda x: x != "")
    objects = F.filter(F.transform(lines, lambda x: F.struct(x.alias("raw"), C.parsed(x).alias("v"))), lambda x: C.kind(x["v"]) == "OBJECT")
    return handles.select("source_id", "locator", "path", "project_hint", F.posexplode(objects).alias("line", "x")).select("source_id", "locator", "path", "project_hint", "line", "x.raw", "x.v")
