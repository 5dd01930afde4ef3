"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into LZ78 dictionary phrases: the shortest ones not seen before in the text. Phrases are hashed as
they grow; the hashes of the phrase set are spread over `SLOTS` slots, of which each keeps its minimum (one-permutation minimum
hashing; an empty slot takes over the next filled one). The likeness of two fingerprints is the share of equal slots, an
estimate of the share of phrases in common, as compressors see it.

Defined cases: null counts as empty; a text without phrases has the fingerprint "", which is like "" (1) and
nothing else (0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .common import bytes_of, emit

SLOTS = 64
PRIME, MASK = 0x9E3779B97F4A7C15, (1 << 61) - 1


def parse(text: bytes, seen: set[int], h: int = 0) -> int:
    """Adds the phrases of a text to seen; returns the hash of an unfinished last phrase, or 0. Later text can continue from both."""
    add, prime, mask = seen.add, PRIME, MASK
    for c in text:
        h = ((h + c + 1) * prime) & mask
        if h not in seen:
            add(h)
            h = 0
    return h


def signature(seen: set[int], rest: int = 0) -> np.ndarray:
    """The slots' minima, 16 bits of each; of no phrases, an empty array."""
    if not seen:
        return np.zeros(0, np.uint16)
    x = np.fromiter(seen, np.uint64, len(seen))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x.sort()
    slot = x >> np.uint64(64 - SLOTS.bit_length() + 1)
    filled, first = np.unique(slot, return_index=True)
    values = (x[first] & np.uint64(0xFFFF)).astype(np.uint16)
    after = np.searchsorted(filled, np.arange(SLOTS)) % len(filled)
    return values[after]


def fingerprint(text: bytes) -> np.ndarray:
    seen: set[int] = set()
    return signature(seen, parse(text, seen))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def text_of(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit(schema, [batch.column("doc_id"), [text_of(fingerprint(t)) for t in bytes_of(batch, "text")]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def first_chars(text: bytes, n: int) -> bytes:
    """The first n code points of UTF-8 (all, if there are fewer)."""
    return text[:n] if text.isascii() else text.decode()[:n].encode()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parse:
    """A document, the phrases of its first half and the fingerprint of the whole."""

    def __init__(self, doc: int, text: bytes) -> None:
        self.doc, self.chars = doc, len(text) if text.isascii() else len(text.decode())
        self.head = first_chars(text, self.chars - self.chars // 2)
        seen: set[int] = set()
        h = parse(self.head, seen)
        self.half = seen.copy(), h
        self.print = signature(seen, parse(text[len(self.head) :], seen, h))

    def beside(self, text: bytes, print_: np.ndarray) -> tuple:
        """The row of OUT for this document and the text and fingerprint of the next one."""
        edited = self.head + first_chars(text, self.chars // 2)
        seen, h = self.half
        other = signature(seen, parse(edited[len(self.head) :], seen, h))
        return self.doc, self.chars, hashlib.sha256(edited).hexdigest(), text_of(self.print), text_of(other), likeness(self.print, other), likeness(self.print, print_)


def splice_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside the next one in descending id order (after the last comes the first).

    The edited text is the document's with its last half's code points replaced by the first of the next one's. Rows are dealt once, to sorted
    partitions; what a partition's last document needs of the next partition, its first document, is joined afterwards, two rows a partition.
    Rows without an id are left out; rows that repeat an id follow each other, in the order of their texts.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    dealt = rows.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    schema = pa.schema([*zip(names, kinds, strict=True), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # a document that waits for the next one
        edge = lambda doc, name, text: (doc, *[None] * 6, part, name, text.decode())
        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), strict=True):
                own = Parse(doc, text)
                found.append((*held[0].beside(text, own.print), part, None, None) if held else edge(doc, "first", text))
                held = own, text
            yield emit(schema, list(zip(*found, strict=True)) or [[]] * len(schema))
        if held:
            yield emit(schema, list(zip(edge(held[0].doc, "last", held[1]), strict=True)))

    made = scratch.save(dealt.mapInArrow(run, f"{OUT}, part int, edge string, text string"), "spliced")
    edges = made.where("edge is not null")
    firsts = edges.where("edge = 'first'").select("part", F.col("text").alias("next_text"))
    order = Window.orderBy("part")  # a narrow row per partition
    follows = firsts.select("part").select("part", F.lead("part").over(order).alias("after"), F.first("part").over(order).alias("least"))
    follows = follows.select("part", F.coalesce("after", "least").alias("next"))
    lasts = edges.where("edge = 'last'").join(follows, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")
    out = pa.schema([*zip(names, kinds, strict=True)])

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), bytes_of(batch, "next_text"), strict=True)
            found = [Parse(doc, text).beside(after, fingerprint(after)) for doc, text, after in pairs]
            yield emit(out, list(zip(*found, strict=True)) or [[]] * len(out))

    return made.where("edge is null").select(*names).unionByName(lasts.mapInArrow(join_edges, OUT))
