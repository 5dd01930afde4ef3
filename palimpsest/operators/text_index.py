"""A text index in a folder: parts that never change, named by a manifest; new blocks make a part, deletions a list, and parts of like size are merged.

A part holds the postings of some blocks, sorted by term, so that a query reads the row groups of its terms alone, and the blocks with their lengths. A deletion adds a list of
blocks, which readers leave out of all parts until a merge drops their postings. The number of blocks and of their terms is in the manifest, so ranking needs
no look at the blocks. Every change is one manifest more, made only if there is none of its number: readers keep the one that they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files, scratch
from ..archive import Conflict
from .search import TextIndex, build_text_index

POSTINGS, BLOCKS = "term string, block_id string, tf long, len long", "block_id string, len long"
#: Parts are merged when this many are of one size, sizes being powers of this number.
FAN = 4


@dataclass(frozen=True)
class Part:
    name: str
    blocks: int
    terms: int


@dataclass(frozen=True)
class State:
    """One version of an index: its parts, its lists of deleted blocks with what they took along, and how words become terms."""

    number: int = 0
    parts: tuple[Part, ...] = ()
    gone: tuple[Part, ...] = ()
    stop_words: tuple[str, ...] = ()
    stems: bool = True


def state_of(spark: SparkSession, folder: str) -> State | None:
    last = files.names(spark, f"{folder}/manifests")[-1:]
    if not last:
        return None
    found = json.loads(files.read(spark, f"{folder}/manifests/{last[0]}"))
    parts = {k: tuple(Part(**p) for p in found[k]) for k in ("parts", "gone")}
    return State(**(found | parts | {"stop_words": tuple(found["stop_words"])}))


def _commit(spark: SparkSession, folder: str, state: State) -> State:
    if not files.create(spark, f"{folder}/manifests/{state.number:010d}.json", json.dumps(asdict(state))):
        raise Conflict(f"version {state.number} of {folder} is another writer's")
    return state


def create_index(spark: SparkSession, folder: str, stop_words: Sequence[str] = (), stems: bool = True) -> State:
    """An empty index, or the one that is there."""
    return state_of(spark, folder) or _commit(spark, folder, State(1, stop_words=tuple(stop_words), stems=stems))


def _read(spark: SparkSession, folder: str, parts: Sequence[Part], name: str, schema: str) -> DataFrame:
    paths = [f"{folder}/parts/{p.name}/{name}" for p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def open_index(spark: SparkSession, folder: str, state: State | None = None) -> TextIndex:
    """The index at its newest version, or at a given one."""
    state = state or state_of(spark, folder) or State()
    postings, blocks = _read(spark, folder, state.parts, "postings", POSTINGS), _read(spark, folder, state.parts, "blocks", BLOCKS)
    if state.gone:
        gone = _read(spark, folder, state.gone, "gone", BLOCKS).select("block_id")
        postings, blocks = postings.join(gone, "block_id", "left_anti").select("term", "block_id", "tf", "len"), blocks.join(gone, "block_id", "left_anti")
    size = tuple(sum(getattr(p, k) for p in state.parts) - sum(getattr(p, k) for p in state.gone) for k in ("blocks", "terms"))
    return TextIndex(postings, blocks, state.stop_words, state.stems, size)


def _changed(spark: SparkSession, folder: str, change: Callable[[State], State | None]) -> State:
    """Commits what change makes of the newest version; again, if another writer was first."""
    while True:
        base = state_of(spark, folder)
        if base is None:
            raise ValueError(f"there is no index in {folder}")
        new = change(base)
        if new is None:
            return base
        try:
            return _commit(spark, folder, replace(new, number=base.number + 1))
        except Conflict:
            continue


def _part(spark: SparkSession, folder: str, postings: DataFrame, blocks: DataFrame) -> Part:
    """Writes a part: postings dealt and sorted by term."""
    name = uuid.uuid4().hex
    blocks.write.parquet(f"{folder}/parts/{name}/blocks")
    postings.repartitionByRange("term", "block_id").sortWithinPartitions("term").write.parquet(f"{folder}/parts/{name}/postings")
    own = _read(spark, folder, [Part(name, 0, 0)], "blocks", BLOCKS).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return Part(name, *own)


def add_blocks(spark: SparkSession, folder: str, blocks: DataFrame) -> State:
    """Indexes the content blocks (id, text) that the index lacks; where many parts are of one size, they are merged."""

    def change(base: State) -> State | None:
        known = open_index(spark, folder, base).docs.select(F.col("block_id").alias("id"))
        new = scratch.save(blocks.select("id", "text").dropDuplicates(["id"]).join(known, "id", "left_anti"), "new-blocks")
        if new.isEmpty():
            return None
        # A block that was deleted and comes again is dropped from the older parts first, or its old postings would come back with it.
        base = _merged(spark, folder, base, base.parts) if base.gone and not new.join(_read(spark, folder, base.gone, "gone", BLOCKS), F.col("id") == F.col("block_id"), "left_semi").isEmpty() else base
        made = build_text_index(new, base.stop_words, base.stems)
        return replace(base, parts=(*base.parts, _part(spark, folder, made.postings, made.docs)))

    _changed(spark, folder, change)
    return merge_parts(spark, folder)


def delete_blocks(spark: SparkSession, folder: str, gone: DataFrame) -> State:
    """Takes blocks (id) out of the index."""

    def change(base: State) -> State | None:
        known = open_index(spark, folder, base).docs
        name = uuid.uuid4().hex
        known.join(gone.select(F.col("id").alias("block_id")).distinct(), "block_id", "left_semi").write.parquet(f"{folder}/parts/{name}/gone")
        own = _read(spark, folder, [Part(name, 0, 0)], "gone", BLOCKS).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return replace(base, gone=(*base.gone, Part(name, *own))) if own[0] else None

    return _changed(spark, folder, change)


def _merged(spark: SparkSession, folder: str, base: State, parts: Sequence[Part]) -> State:
    """base with some parts as one. If these are all, no deleted block is left anywhere."""
    own = open_index(spark, folder, replace(base, parts=tuple(parts)))
    rest = tuple(p for p in base.parts if p not in parts)
    made = _part(spark, folder, own.postings, own.docs)
    if not rest:
        return replace(base, parts=(made,), gone=())
    # Lists of deleted blocks stay for the other parts, but no longer count what this merge has dropped.
    lost_blocks, lost_terms = (sum(getattr(p, k) for p in parts) - getattr(made, k) for k in ("blocks", "terms"))
    gone = list(base.gone)
    if lost_blocks:
        gone[0] = replace(gone[0], blocks=gone[0].blocks - lost_blocks, terms=gone[0].terms - lost_terms)
    return replace(base, parts=(*rest, made), gone=tuple(gone))


def merge_parts(spark: SparkSession, folder: str, all_parts: bool = False) -> State:
    """Merges parts of like size where there are FAN of them, so that there are few parts whatever the number of additions; or all parts into one."""

    def change(base: State) -> State | None:
        if all_parts:
            return _merged(spark, folder, base, base.parts) if len(base.parts) > 1 or base.gone else None
        by_size: dict[int, list[Part]] = {}
        for p in base.parts:
            by_size.setdefault(max(0, p.blocks.bit_length() - 1) // 2, []).append(p)
        full = [parts for parts in by_size.values() if len(parts) >= FAN]
        return _merged(spark, folder, base, full[0]) if full else None

    before = state_of(spark, folder)
    after = _changed(spark, folder, change)
    return after if all_parts or after == before else merge_parts(spark, folder)
