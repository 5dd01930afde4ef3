"""Ranked lexical search with the roles reversed: an inverted index of the items is broadcast, and the documents stream through it.

Terms are runs of ASCII letters and digits and of all other characters from U+0080 on; A-Z are lower-cased. In UTF-8 these are the bytes
of the same classes, so a text is translated and split as bytes. A document's counts of the items' terms are written once, which also
gives the statistics over all documents (documents, terms, documents with a term); then every task runs its documents' counts through the index, adds
what each posting gives to the items' scores, and keeps a heap of the best documents per item. Heaps are merged in two steps, so that
no group holds more than about the root of the number of tasks.

The index is cut into blocks of at most `BLOCK` in cost, a term of an item costing 1 and an item 256: so much is proven of what is broadcast,
but for an item that alone has more terms, which is a block. Documents are read once per block. Scores are 64-bit integers.

Defined cases: null texts have no terms; documents without a term count nowhere; rows that repeat an id are documents, or items, of their own; of equal scores the
smaller doc_id is first and a null one last; items without a term, or that no document scores on, give no row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..numbering import in_order, parts_of
from .common import bytes_of, emit

BLOCK, ITEM_COST = 1 << 19, 256
#: Bytes of a text that are split at once, and documents that are scored at once.
SLICE, TOGETHER = 1 << 20, 64
#: Every byte as it is in a term, or a space.
FOLD = bytes(b if chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(128)) + bytes(range(128, 256))
NO_ID = (1 << 63) - 1


def term_counts(text: bytes) -> Counter:
    """How often each term is in a text; the text is split in slices that end between terms."""
    flat, found, at = text.translate(FOLD), Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


@dataclass(frozen=True)
class Index:
    """A block of items as lists by term: term t is in items[first[t]:first[t + 1]], with its weight times its count there."""

    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    size: int

    def scores(self, owner: np.ndarray, terms: np.ndarray, worth: np.ndarray, documents: int) -> np.ndarray:
        """Scores of documents by items, where document owner[i] gives worth[i] to each posting of terms[i]."""
        lengths = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + lengths, lengths)
        out = np.zeros(documents * self.size, np.int64)
        np.add.at(out, np.repeat(owner * self.size, lengths) + self.items[at], self.weights[at] * np.repeat(worth, lengths))
        return out.reshape(documents, self.size)


class Heaps:
    """The best documents of each item: at most `most`, by score, then by smaller id."""

    def __init__(self, items: int, most: int) -> None:
        self.most = most
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a document with a lower score cannot enter
        self.last = np.full(items, -1, np.int64)  # nor one with this score and no smaller id

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > self.least) | ((scores == self.least) & (scores > 0) & (ids[:, None] < self.last))
        for d, i in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            heap, entry = self.heaps[i], (int(scores[d, i]), -int(ids[d]))
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.most:
                self.least[i], self.last[i] = heap[0][0], -heap[0][1]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        return ((i, -other, score) for i, heap in enumerate(self.heaps) for score, other in heap)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, block, id) and (block, item, term, times): items are numbered in order of their id, and dealt to blocks by cost."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("terms", pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())])))])
        for batch in batches:
            counts = [sorted(term_counts(t).items()) for t in bytes_of(batch, "text")]
            own = emit(kind, [[[{"term": t, "times": n} for t, n in c] for c in counts]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), own.column(0)], ["id", "terms"])

    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, terms array<struct<term: binary, times: bigint>>")
    rows = in_order(rows.withColumn("cost", F.size("terms") + ITEM_COST), ["id", "cost"])
    costs = rows.groupBy("part").agg(F.sum("cost").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row per part
    start = F.sum("cost").over(Window.partitionBy("part").orderBy("row")) - F.col("cost") + F.col("before")
    placed = rows.join(parts_of(rows).select("part", "shift"), "part").join(costs, "part")
    placed = placed.select((F.col("row") + F.col("shift")).alias("item"), F.floor(start / BLOCK).alias("block"), "id", "terms")
    placed = scratch.save(placed, "items")
    listed = placed.select("block", "item", F.explode("terms").alias("t")).select("block", "item", "t.term", "t.times")
    return placed.select("item", "block", "id"), listed


def counted(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: how many it has, and its counts of words, by their place."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast({w: i for i, w in enumerate(words)})
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), strict=True):
                found = term_counts(text)
                if found:
                    own = [(place[t], k) for t, k in found.items() if t in place]
                    for column, value in zip(out, (doc_id, found.total(), [t for t, _ in own], [k for _, k in own]), strict=True):
                        column.append(value)
            yield emit(schema, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scratch.save(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>"), "counts")


def best_of(counts: DataFrame, index: Index, documents: int, terms: int, most: int) -> DataFrame:
    """(item, doc_id, score, task): each task's heaps over the documents' counts."""
    shared = counts.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.size, most)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                own, times = part.column("terms"), part.column("times").flatten().to_numpy(zero_copy_only=False)
                norm = np.array([75 + 25 * n * documents // terms for n in part.column("n").to_pylist()], np.int64)
                owner = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
                worth = 1_000_000_000 * times // (1000 * times + 12 * norm[owner])
                heaps.add(ids, index.scores(owner, own.flatten().to_numpy(zero_copy_only=False), worth, part.num_rows))
        rows = list(heaps.rows())
        for at in range(0, len(rows), 1 << 16):
            items, ids, scores = zip(*rows[at : at + (1 << 16)], strict=True)
            yield emit(schema, [items, [None if i == NO_ID else i for i in ids], scores])

    return counts.mapInArrow(stream, "item long, doc_id long, score long").withColumn("task", F.spark_partition_id())


def search(docs: DataFrame, items: DataFrame, most: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    numbers, listed = item_terms(items, item_col, item_text)
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in sorted(r["block"] for r in numbers.select("block").distinct().toLocalIterator()):
        own = listed.where(F.col("block") == block).select("item", "term", "times").toArrow()  # at most BLOCK rows, or one item's
        if own.num_rows:
            found = found.unionByName(_search_block(spark, docs, own, most, id_col, text_col))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    names = numbers.select("item", F.col("id").alias("item_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most).join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, docs: DataFrame, own: pa.Table, most: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score): of one block of items, the best documents among those of about the root of the number of tasks."""
    encoded = own.column("term").combine_chunks().dictionary_encode()
    words, term = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    item, times = own.column("item").to_numpy(), own.column("times").to_numpy()
    low = int(item.min())
    counts = counted(docs, words, id_col, text_col)
    total = counts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = np.zeros(len(words), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator(prefetchPartitions=True):
        holding[r["term"]] = r["df"]
    n = total["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    order = np.argsort(term, kind="stable")
    index = Index(np.searchsorted(term[order], np.arange(len(words) + 1)), (item[order] - low).astype(np.int64), (weights[term] * times)[order], int(item.max()) - low + 1)
    best = best_of(counts, index, n, total["terms"], most)
    near = Window.partitionBy("item", F.floor(F.sqrt("task"))).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("place", F.row_number().over(near)).where(F.col("place") <= most)
    return scratch.save(best.select((F.col("item") + low).alias("item"), "doc_id", "score"), "best")
