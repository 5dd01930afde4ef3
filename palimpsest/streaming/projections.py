"""Projections whose conversations fail alone: what can't be made of one key's observations stops no other key.

An error of a Spark job does not name the rows that it came from, so a projection that fails is done again for two halves of its keys, by the bits of a hash,
until a half that fails is one key. That takes about twice the work of the projection, and a few more jobs for each failure, the logarithm of the number of keys.
Errors that only a lost executor or a full disk explains go away when the halves are done again, or hit so many keys that they are raised.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import DIVERGENCES, SCHEMAS, Archive
from ..operators.changes import KEY
from ..operators.merge import Projection, project

#: What became of a key; error is null but for an outcome `failed`.
OUTCOMES = "source_id string, scope string, locator string, outcome string, error string"
WRITTEN = SCHEMAS | {"divergences": DIVERGENCES, "outcomes": OUTCOMES}
#: Sets the halves of a failed projection apart from the cuts of the log, which come from a hash of the same key.
SALT = "halves"


class TooManyFailures(RuntimeError):
    """More keys failed than a fault in single conversations explains."""


@dataclass
class Written:
    """The folders that hold what was projected, each with a folder per table of WRITTEN, and how many keys failed."""

    folders: list[str]
    failed: int


def message_of(e: Exception) -> str:
    """An error in a line; of one that came from the JVM as it is, the cause behind all others."""
    cause = getattr(e, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    text = str(e) if cause is None else str(cause.toString())
    return f"{type(e).__name__}: {next(iter(text.splitlines()), '')}"


def _write(found: Projection, folder: str) -> str:
    outcomes = found.outcomes.withColumn("error", F.lit(None).cast("string"))
    for name, df in (found.archive.tables() | {"divergences": found.divergences, "outcomes": outcomes}).items():
        df.write.parquet(f"{folder}/{name}")
    return folder


def write_projection(observations: DataFrame, folder: str, device: str = "", most_failed: int = 100, going_on: Callable[[], bool] = lambda: True) -> Written:
    """Projects observations into new folders under folder. Keys that fail have the outcome `failed` with their error, and no rows elsewhere.

    The error is raised as it is if observations can't be read at all, or if going_on() says that work has been called off; TooManyFailures after more than most_failed keys.
    """
    spark = observations.sparkSession
    done, failed = [], []

    def attempt(rows: DataFrame, bit: int) -> None:
        path = f"{folder}/{uuid.uuid4().hex}"
        try:
            done.append(_write(project(rows, device), path))
            return
        except Exception as e:
            if not going_on() or bit == 64:
                raise
            keys = rows.select(*KEY).distinct().limit(2).collect()
            if not keys:
                raise
            if len(keys) == 1:
                failed.append((*keys[0], "failed", message_of(e)))
                if len(failed) > most_failed:
                    raise TooManyFailures(f"{len(failed)} conversations failed, the last one with {failed[-1][-1]}") from e
                return
        half = F.shiftrightunsigned(F.xxhash64(F.lit(SALT), *KEY), bit).bitwiseAND(F.lit(1))
        for side in (0, 1):
            attempt(rows.where(half == side), bit + 1)

    attempt(observations, 0)
    if failed:
        path = f"{folder}/{uuid.uuid4().hex}"
        spark.createDataFrame(failed, OUTCOMES).write.parquet(f"{path}/outcomes")
        for name in WRITTEN.keys() - {"outcomes"}:
            spark.createDataFrame([], WRITTEN[name]).write.parquet(f"{path}/{name}")
        done.append(path)
    return Written(done, len(failed))


def read_projection(spark: SparkSession, folders: list[str]) -> Projection:
    """What was written to folders, as one; a source that is in several of them is one source."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(WRITTEN[name]).parquet(*(f"{x}/{name}" for x in folders)) if folders else spark.createDataFrame([], WRITTEN[name])

    tables = {f.name: read(f.name) for f in fields(Archive)}
    tables["sources"] = tables["sources"].dropDuplicates(["id"])  # a row per source and folder
    return Projection(Archive(**tables), read("divergences"), read("outcomes"))
