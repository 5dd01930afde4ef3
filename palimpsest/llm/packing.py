"""Best-fit packing of token sequences with swap-based local search.

Each document becomes its token ids and an end id; one longer than a sequence is cut into full pieces and a rest.
Texts are split at ASCII white space, which the tokenizer drops and never merges across, and the ids of each such
part are kept in a bounded memory per worker, so a text costs a look-up per word; what is new goes to the tokenizer in
batches.

Pieces are dealt to shards of a bounded size by a hash of their ids. In a shard, best-fit decreasing fills sequences and
local search improves them: it moves a document to another underfull sequence, or exchanges one for one or two for one,
whenever that makes the sum of squared fills grow, until sequences run empty, no step helps, or the shard's tokens could not be held by fewer sequences.
Sequences with room are then dealt to new shards of the same bounded size and packed again; a shard keeps what it had unless the new sequences are fewer or their
squared fill is larger. That is done until one shard is left, or until it leaves (nearly) as many open sequences as before.

Defined cases: null and empty texts are the end id alone; rows that repeat a doc_id, a null one included, are packed as often as they appear;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .common import bytes_of, emit

CACHE: dict[str, dict[bytes, bytes]] = {}
TOKENIZER: dict = {}
#: Parts of texts whose ids a worker keeps, and the bytes of the longest one; beyond it the memory is emptied.
CACHE_SIZE, LONG = 600_000, 64

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, shard long, sequence_id long, offset long, open boolean"


def tokenizer_at(path: str):
    if path not in TOKENIZER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        TOKENIZER[path] = Tokenizer.from_file(path)
        CACHE[path] = {}
    return TOKENIZER[path], CACHE[path]


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    Words are lower-cased first, as the tokenizer would; not in texts that may name a special token. Of a word that ends with a letter
    and a comma or full stop, the two are encoded apart, since the tokenizer never merges letters with punctuation.
    """
    tokenizer, cache = tokenizer_at(path)
    if len(cache) > CACHE_SIZE:
        cache.clear()
    split = [(t if b"<|" in t else t.lower()).split() for t in texts]
    ended = set().union(*split).difference(cache)
    parts = {w: (w[:-1], w[-1:]) for w in ended if w[-1:] in (b",", b".") and w[-2:-1].isalpha() and b"<|" not in w}
    new = [w for w in {*ended.difference(parts), *(x for both in parts.values() for x in both)} if w not in cache]
    for k in range(0, len(new), 4096):
        part = new[k : k + 4096]
        for word, found in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
            cache[word] = np.array(found.ids, "<u4").tobytes()
    for word, (a, b) in parts.items():
        cache[word] = cache[a] + cache[b]
    get = cache.__getitem__
    found = [b"".join(map(get, words)) for words in split]
    for word in [w for w in {*new, *parts} if len(w) > LONG]:  # so that what is kept has a bound in bytes
        cache.pop(word, None)
    return found


def pieces(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, copy (tells repeated rows apart), piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[] for _ in schema]
            for doc, copy, ids in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), encode(bytes_of(batch, "text"), tokenizer_path), strict=True):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[start : start + 4 * limit]
                    for column, value in zip(columns, (doc, copy, k, start // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            yield emit(schema, columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


class Bins:
    """Sequences being filled; sizes never exceed the limit."""

    def __init__(self, limit: int) -> None:
        self.limit, self.items, self.room = limit, [], []

    def best_fit(self, order: list[int], sizes: list[int]) -> None:
        """Each item, largest first, into the fullest sequence that has room for it."""
        at: list[list[int]] = [[] for _ in range(self.limit + 1)]
        mask = 0
        for item in order:
            size = sizes[item]
            open_ = mask >> size
            if open_:
                room = size + (open_ & -open_).bit_length() - 1
                bin_ = at[room].pop()
                if not at[room]:
                    mask &= ~(1 << room)
                self.items[bin_].append(item)
            else:
                bin_, room = len(self.items), self.limit
                self.items.append([item])
                self.room.append(room)
            left = room - size
            self.room[bin_] = left
            if left:
                at[left].append(bin_)
                mask |= 1 << left

    def improve(self, sizes: list[int]) -> None:
        """Local search over all underfull sequences, until no step helps or no fewer sequences could hold the items.

        A step moves an item, or exchanges one for one, two for one or one for two; the receiving sequence is at least as full as the giving one, and what it
        gains is positive, so the sum of squared fills grows with every step and the search ends.
        """
        least = -(-sum(sizes) // self.limit)
        moved = True
        while moved:
            moved = False
            for giver in sorted((b for b in range(len(self.items)) if self.room[b] and self.items[b]), key=lambda b: (-self.room[b], b)):
                while self.items[giver] and self.room[giver] and sum(map(bool, self.items)) > least and self._step(giver, sizes):
                    moved = True

    def _step(self, giver: int, sizes: list[int]) -> bool:
        """The best step that the giver can make: the one that leaves the least room in the receiving sequence."""
        rooms = np.array(self.room)
        takers = [b for b in np.flatnonzero((rooms > 0) & (rooms <= rooms[giver])).tolist() if b != giver and self.items[b]]
        if not takers:
            return False
        giving = sorted(self.items[giver], key=sizes.__getitem__)
        own = np.array([sizes[i] for i in giving])
        at = np.repeat(takers, [len(self.items[b]) for b in takers])
        out = np.array([i for b in takers for i in self.items[b]])
        size, reach = np.array([sizes[i] for i in out]), np.array([sizes[i] for i in out]) + rooms[at]
        best: tuple[int, int, list[int], list[int]] | None = None

        def offer(given: list[int], total: int, small: np.ndarray, most: np.ndarray, bins: np.ndarray, taken: Callable[[int], list[int]]) -> None:
            nonlocal best
            left = np.where((small < total) & (most >= total), most - total, self.limit + 1)
            k = int(left.argmin()) if len(left) else 0
            if len(left) and left[k] <= self.limit and (best is None or left[k] < best[0]):
                best = int(left[k]), int(bins[k]), given, taken(k)

        empty, bins = np.zeros(len(takers), np.int64), np.array(takers)
        for i, total in zip(giving, own.tolist(), strict=True):
            offer([i], total, empty, rooms[bins], bins, lambda k: [])  # a move
            offer([i], total, size, reach, at, lambda k: [int(out[k])])  # one for one
        first, second = np.triu_indices(len(own), 1)
        sums, where = np.unique(own[first] + own[second], return_index=True)
        for total, k in zip(sums.tolist(), where.tolist(), strict=True):  # two for one
            offer([giving[first[k]], giving[second[k]]], total, size, reach, at, lambda k: [int(out[k])])
        if best is None:  # one for two
            pairs = [(b, i, j, sizes[i] + sizes[j]) for b in takers for i, j in self._pairs(b, sizes)]
            if pairs:
                pair_bin, _, _, total_ = (np.array(x) for x in zip(*pairs, strict=True))
                for i, total in zip(giving, own.tolist(), strict=True):
                    offer([i], total, total_, total_ + rooms[pair_bin], pair_bin, lambda k: [pairs[k][1], pairs[k][2]])
        if best is None:
            return False
        return self._exchange(giver, best[1], best[2], best[3], sizes)

    def _pairs(self, b: int, sizes: list[int]) -> Iterator[tuple[int, int]]:
        """Two items of a sequence for each sum that two of its items have."""
        seen = set()
        for i, j in combinations(self.items[b], 2):
            if (total := sizes[i] + sizes[j]) not in seen:
                seen.add(total)
                yield i, j

    def _exchange(self, giver: int, taker: int, given: list[int], taken: list[int], sizes: list[int]) -> bool:
        more = sum(sizes[i] for i in given) - sum(sizes[i] for i in taken)
        self.items[giver] = [i for i in self.items[giver] if i not in given] + taken
        self.items[taker] = [i for i in self.items[taker] if i not in taken] + given
        self.room[giver] += more
        self.room[taker] -= more
        return True


def pack_sizes(sizes: list[int], limit: int) -> list[list[int]]:
    """Positions of sizes, by sequence."""
    bins = Bins(limit)
    bins.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes)
    bins.improve(sizes)
    return [b for b in bins.items if b]


def filler(limit: int, level: int, open_room: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one shard; sequences with room for open_room tokens stay open for the next level."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()

        def fills(found: list[list[int]]) -> list[int]:
            return [sum(sizes[i] for i in b) for b in found]

        found = pack_sizes(sizes, limit)
        if pdf["sequence_id"].iloc[0] >= 0:  # sequences from the level before
            before = [list(x) for x in pdf.groupby("sequence_id").indices.values()]
            found = min(before, found, key=lambda f: (len(f), -sum(x * x for x in fills(f))))
        fill_of = fills(found)
        again = {b for b in range(len(found)) if limit - fill_of[b] >= open_room}
        shard = int(pdf["shard"].iloc[0])
        sequence, offset, open_ = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for b, items in enumerate(found):
            at = 0
            for i in items:
                sequence[i], offset[i], open_[i] = (level << 56) | (shard << 24) | b, at, b in again
                at += sizes[i]
        return pdf.assign(sequence_id=sequence, offset=offset, open=open_)[[c.split()[0] for c in PACKED.split(", ")]]

    return fill


def pack(rows: DataFrame, limit: int, shard_size: int = 4096, open_share: int = 64) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces(). Sequences with less room than 1 / open_share of the limit are closed after a level."""
    rows = scratch.save(rows, "pieces")
    new = rows.select("*", F.lit(-1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full, open_rows = new.where(F.col("length") == limit), new.where(F.col("length") < limit)
    key, closed, level, before = F.xxhash64("doc_id", "copy", "piece"), [], 0, None
    size = open_rows.count()
    while size:
        shards = -(-size // shard_size)
        room = max(1, limit // open_share) if shards > 1 else limit + 1
        shard = F.pmod(key, F.lit(shards)).alias("shard")
        packed = scratch.save(open_rows.select(*rows.columns, shard, "sequence_id", "offset").groupBy("shard").applyInPandas(filler(limit, level, room), PACKED), "packed")
        open_rows = packed.where("open")
        size, sequences = open_rows.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if before is not None and sequences > 0.95 * before:  # dealing them anew helps no more
            closed.append(packed)
            break
        closed.append(packed.where("not open"))
        key, before, level = F.xxhash64("sequence_id"), sequences, level + 1
    out = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())  # a full piece is a sequence of its own
    for part in closed:
        out = out.unionByName(part.drop("open", "shard"))
    return out


def packed_documents(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and copy)."""
    return pack(pieces(docs, tokenizer_path, limit, end_id, id_col, text_col), limit)
