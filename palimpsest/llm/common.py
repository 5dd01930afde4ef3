"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_last(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts sorted batches anew so that rows with equal keys are never split. A group has to fit in memory."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        end = tuple(c[-1] for c in columns)
        same = columns[0] == end[0]
        for c, e in zip(columns[1:], end[1:], strict=True):
            same &= c == e
        first = int(batch.num_rows - same[::-1].argmin()) if not same.all() else 0
        if first or end != last:
            if done := kept + ([batch.slice(0, first)] if first else []):
                yield pa.Table.from_batches(done)
            kept = []
        kept.append(batch.slice(first))
        last = end
    if kept:
        yield pa.Table.from_batches(kept)
