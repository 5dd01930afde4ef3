"""Comparison of 64-bit fingerprints in vertical bit planes, and the Spark join around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_last

#: Fingerprints of a block that are compared in one task at most (two such tiles when a block is split).
TILE = 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fps: np.ndarray, lanes: np.ndarray, words: int) -> np.ndarray:
    """64 planes of `words` 64-lane words: bit b of the fingerprint in lane l is bit l of plane b."""
    full = np.zeros(words * 64, np.uint64)
    full[lanes] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def near(fps: np.ndarray, starts: np.ndarray, radius: int, grid: int = 1 << 20, until: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of positions within `radius` bits inside each run of fps that begins at one of starts; if `until` is given, only j < until[i].

    Every run has whole 64-lane words of its own. A query meets a word's 64 fingerprints at once: the planes
    that differ are added to bitwise counters with carry-save steps, and a (query, word) block is abandoned
    as soon as all of its lanes have passed the radius.
    """
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    words_of = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words_of)[:-1]))
    run = np.repeat(np.arange(len(starts)), sizes)
    lane = first_word[run] * 64 + np.arange(n) - starts[run]
    words = int(words_of.sum())
    planes = planes_of(fps, lane, words)
    used = np.zeros(words * 64, np.uint8)
    used[lane] = 1
    used = np.packbits(used, bitorder="little").view(np.uint64)
    at = np.zeros(words * 64, np.int64)
    at[lane] = np.arange(n)
    own = lane // 64
    last = first_word[run] + words_of[run]
    if until is not None:
        last = np.minimum(last, lane[np.maximum(until, np.arange(n) + 1) - 1] // 64 + 1)
    span = last - own  # a query meets its own word and those after it
    ends = np.cumsum(span)
    found_i, found_j = [], []
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + grid, "right")))
        part = span[low:high]
        q = np.repeat(np.arange(low, high), part)
        w = own[q] + np.arange(len(q)) - np.repeat(np.cumsum(part) - part, part)
        i, j = _meet(fps, planes, used, q, w, radius)
        j = at[j]
        keep = i < j
        if until is not None:
            keep &= j < until[i]
        found_i.append(i[keep])
        found_j.append(j[keep])
        low = high
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])


def _meet(fps: np.ndarray, planes: np.ndarray, used: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(1, radius.bit_length())
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    past = ~used[w]
    value = fps[q]
    for plane in range(64):
        same = (value >> np.uint64(plane)) & np.uint64(1)
        carry = planes[plane][w] ^ (np.uint64(0) - same)
        for b in range(width):
            count[b], carry = count[b] ^ carry, count[b] & carry
        past |= carry
        if plane % 8 == 7:
            more, equal = np.zeros(len(q), np.uint64), np.full(len(q), ALL)
            for b in reversed(range(width)):
                if radius >> b & 1:
                    equal = equal & count[b]
                else:
                    more |= equal & count[b]
                    equal = equal & ~count[b]
            past |= more
            alive = past != ALL
            if not alive.all():
                q, w, past, value = q[alive], w[alive], past[alive], value[alive]
                count = [c[alive] for c in count]
            if not len(q):
                break
    lanes = np.unpackbits((~past).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64), np.uint8)
    row, lane = np.nonzero(lanes)
    return q[row], w[row] * 64 + lane


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def confirmed(n: int, i: np.ndarray, j: np.ndarray, test: Callable[[int, int], bool]) -> tuple[list[int], list[int]]:
    """Of the pairs (i, j) that pass the test, those of a spanning forest; pairs that are connected already are not tested."""
    label = np.arange(n)
    a, b = [], []
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        open_ = label[x] != label[y]
        for p, q in zip(x[open_].tolist(), y[open_].tolist(), strict=True):
            if label[p] != label[q] and test(p, q):
                label[label == label[q]] = label[p]
                a.append(p)
                b.append(q)
    return a, b


def runs_of(group: pa.Table, keys: list[str]) -> np.ndarray:
    columns = [group.column(k).to_numpy() for k in keys]
    new = np.zeros(group.num_rows, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def block_keys(fp: Column, shared: int, blocks: int) -> list[Column]:
    """A key for every choice of `shared` blocks; two fingerprints within blocks - shared bits agree in one of them."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), shared)):
        key = F.lit(t).cast("long")
        for k in chosen:
            size = edges[k + 1] - edges[k]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(key)
    return keys


def tiled(rows: DataFrame, key: str, spread: Column, tile: int, few_keys: bool = False) -> DataFrame:
    """Adds `pair`, and rows so that every two rows with the same key meet under at least one pair.

    Keys with a single row are left out, as they have no partner. A key with more than `tile` rows is cut into
    tiles by `spread`; each tile meets each other tile under a pair of its own, so that a hot key becomes
    many tasks of bounded size and no row is left out. few_keys says that the key has a bounded number of values, so that
    their sizes can be sent to all tasks. Else the join is a merge: of rows that were exploded Spark knows the size before that, and would send them all through the driver.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = F.broadcast(sizes) if few_keys else sizes.hint("merge")
    tiles = F.ceil(F.col("rows") / tile).cast("long")
    own = F.pmod(spread, tiles)
    met = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda t: F.least(t, own) * (1 << 31) + F.greatest(t, own))
    return rows.join(sizes, key).withColumn("pair", F.explode(F.when(tiles == 1, F.array(F.lit(0).cast("long"))).otherwise(met))).drop("rows")


def links(fps: DataFrame, radius: int, blocks: int, shared: int | None = None, tile: int = TILE) -> DataFrame:
    """(fp long, node long), one row per fingerprint, to (a, b): links that connect the fingerprints within radius.

    Candidates share blocks - radius blocks, so no link is lost. With more `shared` blocks there are fewer candidates, and
    links beyond blocks - shared bits are found if their differing bits fall into few enough blocks.
    Of the links inside a block only a spanning forest is given, so their number never exceeds the rows.
    """
    keys = block_keys(F.col("fp"), shared or blocks - radius, blocks)
    return linked(fps.select("fp", "node", F.explode(F.array(*keys)).alias("key")), radius, tile)


def linked(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(fp long, node long, key long) to (a, b): links that connect the fingerprints within radius that share a key."""
    dealt = tiled(keyed, "key", F.xxhash64("fp"), tile)
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").select("key", "pair", "fp", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in with_last(batches, ["key", "pair"]):
            fp = group.column("fp").to_numpy().view(np.uint64)
            node = group.column("node").to_numpy()
            i, j = near(fp, runs_of(group, ["key", "pair"]), radius)
            label = forest(len(fp), i, j)
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")
