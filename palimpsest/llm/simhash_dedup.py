"""SimHash near-duplicates with bit-sliced comparison.

Whole texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of `words` words; a
fingerprint has bit b set where over half of the shingles' XXH64 hashes (seed 42) have it. Documents link
at `radius` or fewer differing bits. Candidates share blocks - radius of the fingerprint's blocks (pigeonhole,
so no link is lost); inside a block, bit planes are compared with carry-save counters (bitslice.py).
Equal fingerprints are one node from the start, so copies are never compared or paired.

Defined cases: null and empty texts have fingerprint zero and link like any others; rows that repeat a doc_id
each get their row back, with that id's component; a row without an id links by its text, and gets the smallest id that its
component has, null if it has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .bitslice import TILE, confirmed, linked, links, near, runs_of, tiled
from .common import bytes_of, emit, with_last
from .components import components

#: Hashes that are counted together: seven bit planes hold counts up to 127.
PIECE = 127


def _added(rows: np.ndarray) -> list[np.ndarray]:
    """Bit planes of the counts of set bits over the PIECE rows of a column, by carry-save adders."""
    planes = []
    while len(rows):
        carries = []
        while len(rows) > 1:
            third = max(1, len(rows) // 3)
            a, b = rows[:third], rows[third : 2 * third]
            both = a ^ b
            if len(rows) == 2:
                carries.append(a & b)
                rows = both
                break
            c = rows[2 * third : 3 * third]
            carries.append((a & b) | (both & c))
            rows = np.concatenate((both ^ c, rows[3 * third :]))
        planes.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    return planes


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of `sizes` hashes: the bits set in over half of the run."""
    return majorities([hashes], sizes)[0]


def majorities(several: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """majority() of several arrays of hashes over the same runs.

    Runs are cut into pieces, whose bits are counted 64 at a time in bit planes; then the counts of a run's pieces are added.
    """
    out = [np.zeros(len(sizes), np.uint64) for _ in several]
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    pieces = (sizes + PIECE - 1) // PIECE
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    places = np.arange(len(several[0])) + np.repeat(first * PIECE - (np.cumsum(sizes) - sizes), sizes)
    counts = np.empty((total, 64), np.uint8)
    grid = np.zeros((total, PIECE), np.uint64)
    for hashes, found in zip(several, out, strict=True):
        grid.ravel()[places] = hashes
        for low in range(0, total, 256):
            planes = _added(np.ascontiguousarray(grid[low : low + 256].T))
            part = np.zeros((len(planes[0]), 64), np.uint8)
            for k, plane in enumerate(planes):
                part |= np.unpackbits(plane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") << k
            counts[low : low + 256] = part
        summed = np.add.reduceat(counts, first, axis=0, dtype=np.int32)
        found[full] = np.packbits(2 * summed > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, words: int) -> list[int]:
    parts = text.lower().split()
    hash_ = xxhash.xxh64_intdigest
    if len(parts) < words:
        return [hash_(b" ".join(parts), 42)] if parts else []
    return [hash_(b" ".join(s), 42) for s in zip(*(parts[k:] for k in range(words)), strict=False)]


def text_key(text: F.Column) -> F.Column:
    """Tells rows with one id and other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id long, fp long), a row per document; if keyed, also key, a 128-bit hash of the text's words, and text_key."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[("key", pa.binary()), ("text_key", pa.int64())] * keyed])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in texts]
            fp = majority(np.concatenate(hashes), np.array([*map(len, hashes)])) if hashes else np.zeros(0, np.uint64)
            keys = [[xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], batch.column("text_key")] if keyed else []
            yield emit(schema, [batch.column("doc_id"), fp.view(np.int64), *keys])

    own = [text_key(F.col(text_col)).alias("text_key")] * keyed
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *own)
    return rows.mapInArrow(make, "doc_id long, fp long" + ", key binary, text_key long" * keyed)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach from the document."""
    prints = scratch.save(fingerprints(docs, words, id_col, text_col), "simhash")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    joined = components(links(nodes.where("node is not null"), radius, blocks))
    roots = nodes.join(joined, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of `rows` minima: two sets share a band's key with a probability of their Jaccard similarity to the power of rows."""
    seeds = np.random.default_rng(5).integers(0, 2**64, (2, bands * rows), np.uint64)
    minima = np.array([((shingles ^ x) * (m | np.uint64(1))).min() for x, m in seeds.T], np.uint64).reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(minima)], np.uint64).view(np.int64)


def confirmed_duplicates(
    docs: DataFrame,
    words: int = 2,
    radius: int = 8,
    blocks: int = 8,
    shared: int = 3,
    check_words: int = 5,
    similarity: float = 0.8,
    bands: int = 16,
    band_rows: int = 4,
    wide: int = 22,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_key, component_id, kept), a row per row with an id, by links that the texts confirm: fingerprints within `wide` bits and, of their shingles of
    check_words words, a Jaccard similarity of at least `similarity`.

    Fingerprints are compared in two sets of groups. By blocks of the fingerprint, no pair within blocks - shared bits is lost, and
    up to radius, pairs are found if their bits fall into few blocks. At the least similarity, though, fingerprints differ in some 10 bits, so
    texts that share a band of minimum hashes of their check_words shingles are compared as well, there within `wide`: of pairs
    with a Jaccard similarity of 0.8, a share of 1 - (1 - 0.8 ** band_rows) ** bands has such a band.
    Texts with the same words are one node. component_id is the smallest doc_id that links reach; kept is true for that document, of several with that id
    for the one with the smallest text_key, so that rows with one id and other texts have their own fate. Families of linked texts get their texts back and are confirmed in tiles of bounded size.
    Joins with a row per document are merges: Spark takes the written nodes for a fraction of their size, and would send them through the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key")).where("doc_id is not null")
    prints = scratch.save(fingerprints(rows, words, keyed=True), "simhash")
    nodes = prints.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("fp").alias("fp"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(shingle_hashes(t, check_words), np.uint64) for t in bytes_of(batch, "text")]
            keys = [band_keys(h, bands, band_rows) if len(h) else [] for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["fp", "node", "keys"])

    first = rows.join(nodes.select("first.*", "node", "fp").hint("merge"), ["doc_id", "text_key"]).select("fp", "node", "text")
    banded_rows = first.mapInArrow(banded, "fp long, node long, keys array<long>").dropDuplicates(["node"])
    keyed = scratch.save(banded_rows.select("fp", "node", F.explode("keys").alias("key")), "bands")
    distinct = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(distinct.hint("merge"), "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges = links(distinct.select("fp", F.col("least").alias("node")), radius, blocks, shared).unionByName(same).unionByName(linked(keyed, wide))
    family = components(edges).withColumnRenamed("root", "family")
    family = nodes.join(family.hint("merge"), "node").select("family", "fp", "node", "first.*")
    texts = family.join(rows, ["doc_id", "text_key"]).select("family", "fp", "node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t, check_words), np.uint64)).tobytes() for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "fp", "node")), pa.array(sets, pa.binary())], names=["family", "fp", "node", "shingles"])

    sets = scratch.save(texts.mapInArrow(cut, "family long, fp long, node long, shingles binary").dropDuplicates(["node"]), "families")
    dealt = tiled(sets, "family", F.xxhash64("node"), TILE).repartition("family", "pair").sortWithinPartitions("family", "pair", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in with_last(batches, ["family", "pair"]):
            fp, node = group.column("fp").to_numpy().view(np.uint64), group.column("node").to_numpy()
            own = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]

            def alike(x: int, y: int, own: list[np.ndarray] = own) -> bool:
                a, b = own[x], own[y]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    return False
                both = len(np.intersect1d(a, b, assume_unique=True))
                return both >= similarity * (len(a) + len(b) - both)

            a, b = confirmed(len(fp), *near(fp, runs_of(group, ["family", "pair"]), max(radius, wide)), alike)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    roots = components(dealt.select("family", "pair", "fp", "node", "shingles").mapInArrow(confirm, "a long, b long"))
    own = nodes.join(roots.hint("merge"), "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    found = own.join(least.hint("merge"), "root").select("key", "least")
    kept = F.struct("doc_id", "text_key") == F.col("least")
    return prints.join(found.hint("merge"), "key").select("doc_id", "text_key", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def fingerprint_text(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
