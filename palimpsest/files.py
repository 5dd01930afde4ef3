"""Small files in any folder that Spark can reach, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that holds text; False, with nothing changed, if there is one of this name already. Whoever sees the file sees all of it.

    The text is written under a hidden name, which then becomes the file's: on local disks by a link, which is refused if there is a file, elsewhere by a
    rename, which HDFS refuses likewise. Neither is lost or seen half done if the writer dies.
    """
    system, where = _at(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = system.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(hidden.toUri().getPath(), where.toUri().getPath())
            return True
        return not system.exists(where) and system.rename(hidden, where)
    except FileExistsError:
        return False
    finally:
        system.delete(hidden, False)


def read(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there. Hidden ones are left out."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    found = [x.getPath().getName() for x in system.listStatus(where)]
    return sorted(x for x in found if not x.startswith((".", "_")))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength() if system.exists(where) else 0


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)
