"""A Merkle manifest of a dataset, kept as persistent trees: tampered leaves make versions that share every untouched node.

Rows are leaves: SHA-256 over their columns, written with lengths. Leaves are runs of one group (say, a language), in order of their
id; every two nodes become one until one is left, the group's root, and the groups' roots become the dataset's root alike.

Leaves are numbered by one range shuffle and cut into aligned blocks of 2 ** `height`. A task builds a block's part of the tree as
a persistent tree (`Block`): nodes are written once and never changed, and a tampered leaf makes a version by copying the nodes above it and no others. The
blocks' tops are the leaves of the next tree up, which is made in the same way, until one node is left; on the way down each block learns
the siblings beside the path above its top, and versions go on there: folded with these siblings, each version's top becomes its root.

What a task holds is a block: 2 ** height leaves and the nodes copied for its versions. Trees shrink by 2 ** height a step; nothing is collected.

Defined cases: a null column counts as null and not as empty; null ids and null groups come first; rows that repeat an id are
leaves of their own, in order of their hash; an empty table gives an empty manifest; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..numbering import in_order, parts_of
from .common import with_last

HEIGHT = 10


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 over values as text, each with its count of bytes before it; `-` stands for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


class Block:
    """The part of a persistent binary tree over some consecutive nodes, aligned to 2 ** height of them.

    Nodes live in one list and are (digest, left, right); none is ever changed. levels says how often nodes are paired; a node without a
    partner is hashed alone.
    """

    def __init__(self, digests: list[str], levels: int) -> None:
        self.nodes: list[tuple[str, int, int]] = [(d, -1, -1) for d in digests]
        self.levels = levels
        row = list(range(len(digests)))
        for _ in range(levels):
            row = [self._join(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _join(self, left: int, right: int) -> int:
        parts = [self.nodes[left][0]] + ([self.nodes[right][0]] if right >= 0 else [])
        self.nodes.append((digest(parts), left, right))
        return len(self.nodes) - 1

    def path(self, place: int) -> list[int]:
        """The nodes from the root down to a leaf."""
        found, at = [self.root], self.root
        for level in reversed(range(self.levels)):
            _, left, right = self.nodes[at]
            at = right if place >> level & 1 else left
            found.append(at)
        return found

    def siblings(self, place: int) -> list[str]:
        """The digests beside the path, from the leaf upwards; empty where a node has no partner."""
        path = self.path(place)
        beside = []
        for parent, child in zip(path, path[1:], strict=False):
            _, left, right = self.nodes[parent]
            other = left if child == right else right
            beside.append(self.nodes[other][0] if other >= 0 else "")
        return beside[::-1]

    def version(self, place: int, leaf: str) -> int:
        """The root of a version in which one leaf is another; only nodes on its path are new."""
        path = self.path(place)
        self.nodes.append((leaf, -1, -1))
        new = len(self.nodes) - 1
        for parent, child in zip(path[-2::-1], path[:0:-1], strict=True):
            _, left, right = self.nodes[parent]
            new = self._join(left, new) if child == right else self._join(new, right)
        return new


def folded(start: str, place: int, siblings: list[str]) -> str:
    """A node's digest carried up beside siblings; place says at which levels it is the right one."""
    for level, other in enumerate(siblings):
        start = digest(([other, start] if place >> level & 1 else [start, other]) if other else [start])
    return start


def hexes(siblings: list[bytes]) -> list[str]:
    return [x.hex() for x in siblings]


def _blocks(height: int):
    """Builds the blocks of sorted nodes: for each node its siblings inside its block, the block's top, and the top of its version."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in with_last(batches, ["run", "block"]):
            columns = rows.select(["size", "block", "place", "digest", "version"]).to_pydict()
            siblings, tops, versions = [], [], []
            at = 0
            while at < rows.num_rows:
                size, start = columns["size"][at], columns["block"][at] << height
                end = at + min(size - start, 1 << height)
                tree = Block(columns["digest"][at:end], min(height, (size - 1).bit_length()))
                top = tree.nodes[tree.root][0]
                for i, changed in enumerate(columns["version"][at:end]):
                    siblings.append([bytes.fromhex(x) for x in tree.siblings(i)])
                    tops.append(top)
                    versions.append(None if changed is None else tree.nodes[tree.version(i, changed)][0])
                at = end
            kept = rows.select([c for c in rows.column_names if c not in ("version", "block")])
            for name, values, kind in (("siblings", siblings, pa.list_(pa.binary())), ("top", tops, pa.string()), ("version_top", versions, pa.string())):
                kept = kept.append_column(name, pa.array(values, type=kind))
            yield from kept.to_batches()

    return build


def roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """nodes(run, size, place, digest, version, ...) with siblings, root and version_root, without size and version.

    Places in each run are 0 to size - 1. siblings go from a node up to its run's root. version_root is the root of the run in
    which the node's digest is its version; null without one. Other columns stay; their names must be others.
    """
    kept = [c for c in nodes.columns if c != "version"]
    types = dict(nodes.select(kept).dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "siblings array<binary>, top string, version_top string"])
    ranged = nodes.withColumn("block", F.shiftright("place", height)).repartition("run", "block").sortWithinPartitions("run", "block", "place")
    built = scratch.save(ranged.mapInArrow(_blocks(height), schema), "blocks")
    one, width = F.col("size") <= (1 << height), 1 << height
    kept = [c for c in kept if c != "size"]
    done = built.where(one).select(*kept, "siblings", F.col("top").alias("root"), F.col("version_top").alias("version_root"))
    larger = built.where(~one)
    if larger.isEmpty():
        return done
    # The blocks' tops are the leaves of the next tree; a block's first node stands for it.
    tops = larger.where(F.col("place") % width == 0).select("run", F.ceil(F.col("size") / width).alias("size"), F.shiftright("place", height).alias("place"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("version"))
    above = roots(tops, height).select("run", F.col("place").alias("above_place"), F.col("siblings").alias("above"), "root")
    joined = larger.withColumn("above_place", F.shiftright("place", height)).join(above, ["run", "above_place"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["version_top", "above_place", "siblings", "above"]).to_pydict()
            versions = [None if v is None else folded(v, b, hexes(s)) for v, b, s in zip(rows["version_top"], rows["above_place"], rows["above"], strict=True)]
            siblings = [a + b for a, b in zip(rows["siblings"], rows["above"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(siblings, pa.list_(pa.binary())), batch.column("root"), pa.array(versions, pa.string())], [*kept, "siblings", "root", "version_root"])

    return done.unionByName(joined.mapInArrow(go_on, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "siblings array<binary>, root string, version_root string"])))


def manifest(docs: DataFrame, leaf: Column, tampered: Column, id_col: str = "doc_id", group_col: str = "lang", height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, proof_sha256, folded_root, verified), a row for each row of docs.

    leaf is a row's digest, in hexadecimal digits, and tampered another one where the row has a version of its own, else null. siblings are the
    digests beside the path from the leaf to the root, from left to right by level, empty where there is none; folded_root is made of the tampered leaf,
    or the leaf, and these, and verified says whether it is the root.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("group"), leaf.alias("digest"), tampered.alias("version"))
    rows = in_order(rows, ["group", "doc_id", "digest"])
    parts = scratch.save(parts_of(rows, "group"), "parts")
    groups = in_order(parts.select("group").distinct(), ["group"])
    own = parts_of(groups).withColumnRenamed("size", "groups")
    groups = scratch.save(groups.join(own, "part").select(F.col("group").alias("name"), (F.col("row") + F.col("shift")).alias("run"), "groups"), "groups")
    parts = parts.join(groups, F.col("group").eqNullSafe(F.col("name"))).select(F.col("part").alias("of"), "name", "shift", "size", "run")
    nodes = rows.join(parts, (F.col("part") == F.col("of")) & F.col("group").eqNullSafe(F.col("name")))
    nodes = nodes.select("run", "size", (F.col("row") + F.col("shift")).alias("place"), "digest", "version", "doc_id")
    lower = scratch.save(roots(nodes, height).withColumnRenamed("root", "subroot"), "lower")
    tops = lower.where("place = 0").join(groups, "run").select(F.lit(0).cast("long").alias("run"), F.col("groups").alias("size"), F.col("run").alias("place"), F.col("subroot").alias("digest"), F.lit(None).cast("string").alias("version"))
    upper = scratch.save(roots(tops, height).select(F.col("place").alias("run"), F.col("siblings").alias("above"), "root"), "upper")

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("place", "run", "digest", "version_root", "siblings", "above", "root")}
            siblings, proofs, ends = [], [], []
            for place, run, own, version, low, high in zip(*(columns[c] for c in ("place", "run", "digest", "version_root", "siblings", "above")), strict=True):
                low, high = hexes(low), hexes(high)
                start = folded(own, place, low) if version is None else version
                ends.append(folded(start, run, high))
                siblings.append(low + high)
                proofs.append(digest(low + high))
            verified = [a == b for a, b in zip(ends, columns["root"], strict=True)]
            given = [batch.column(c) for c in ("doc_id", "digest", "subroot", "root")]
            made = [pa.array(siblings, pa.list_(pa.string())), pa.array(proofs, pa.string()), pa.array(ends, pa.string()), pa.array(verified, pa.bool_())]
            yield pa.RecordBatch.from_arrays(given + made, ["doc_id", "leaf", "subroot", "root", "siblings", "proof_sha256", "folded_root", "verified"])

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, siblings array<string>, proof_sha256 string, folded_root string, verified boolean"
    return lower.join(upper, "run").mapInArrow(proven, schema)
