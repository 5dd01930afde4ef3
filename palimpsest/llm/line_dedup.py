"""Fuzzy line deduplication.

Lines are normalised (A-Z lower-cased, digits to 0, ASCII punctuation to spaces, spaces collapsed; a line of punctuation alone keeps
it). Equal normal forms are one line from the start. Each form has two SimHashes of 64 bits over its runs of `GRAM` bytes; candidates share one of
`blocks` blocks of either (pigeonhole: no pair within blocks - 1 bits of one SimHash is missed), are within `radius` bits of that one and `wide` of
both, and have lengths that allow the similarity. Candidates link if their edit similarity, 1 - distance / longer length in code
points, is `similarity` or more. Of each connected group one occurrence stays: the first by (doc_id, text's hash, line). Blank lines are no lines.

Blocks hold narrow rows without text. Inside a block, rows are sorted by length and meet only those that are short enough. Rows that are near each other in a block make a
group; a pair counts in the first block that it shares. Only lines in groups get their forms, from their texts, and are verified in the group; a group of
many or long lines is cut into parts that all meet each other, so that a task holds a bounded size. Pairs that are connected already are skipped.

Defined cases: null texts have no lines; rows with the same id and the same text count as one document and share their fate, rows with the same id and
other texts are documents of their own; rows without an id are left out of the decisions and deduplicate() leaves them as they are; an empty table gives an empty result; other
columns are ignored. The distance of two long lines takes time with the product of their lengths, after what they begin and end with in common.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .bitslice import confirmed, forest, near, runs_of, tiled
from .common import bytes_of, fresh, with_last
from .components import components
from .simhash_dedup import majorities

NORMAL = bytes.maketrans(
    (string.ascii_uppercase + string.digits + string.punctuation).encode(),
    (string.ascii_lowercase + "0" * 10 + " " * len(string.punctuation)).encode(),
)
#: Bytes of a run that is hashed.
GRAM = 6
#: Rows of a block that are compared at once, and the bytes of text that a group's part holds.
TILE, PART = 1 << 15, 8 << 20
#: Bits that number a block's tiles, and those of a line's length; longer lines count as of this length where rows are sorted.
TILE_BITS, SIZE_BITS = 12, 20
#: Bytes of text whose SimHashes are made at once.
CHUNK = 1 << 19
# Odd multipliers that mix a run's bytes into 64 bits.
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


#: Words of either line that a difference may span before the next two that agree, the fewest first.
STEPS = sorted(((s, t) for s in range(6) for t in range(6) if s or t), key=lambda x: (sum(x), abs(x[0] - x[1])))


def normal(line: bytes) -> bytes:
    return b" ".join(line.translate(NORMAL).split()) or b" ".join(line.split())


def prints_of(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two SimHashes of each form over its runs of GRAM bytes, the form having GRAM - 1 spaces on both sides."""
    if not forms:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edge = b" " * (GRAM - 1)
    text = edge + edge.join(forms) + b" " * 8
    counts = np.array([*map(len, forms)]) + GRAM - 1
    # With these spaces between forms, a run that begins in a form or in the spaces before it holds no byte of another form.
    h = np.ndarray((int(counts.sum()),), "<u8", text, 0, (1,)) & np.uint64((1 << 8 * GRAM) - 1)
    h *= MIX[0]
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    first, second = majorities([h * MIX[2], (h ^ MIX[0]) * MIX[1] ^ (h >> np.uint64(31))], counts)
    return first, second


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; some number above `most` if it exceeds that.

    Columns of the table are bits of integers, and a column holds the diagonals alone on which a path of `most` edits can run, as these
    are far fewer than the rows. It ends early once no path of so few is left.
    """
    if len(a) < len(b):
        a, b = b, a
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    n, m = len(a), len(b)
    spare = ((n if most is None else min(most, n)) - (n - m)) // 2
    if spare < 0:
        return n - m
    above, width = n - m + spare, n - m + 2 * spare + 1  # diagonals before the first one, and all
    # Of each character the column in which its bits were last set, and these: the diagonals in whose row of that column it stands.
    none, places = (0, 0), {}
    for k, c in enumerate(b[:spare], above):
        places[c] = 0, places.get(c, none)[1] | 1 << k
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    plus, minus, top = full >> above << above, 0, 0
    check = n if most is None else spare
    for k, c in enumerate(a):
        if k > check:
            least = nearest(plus, minus, top, above - (n - m), width)
            if least > most:
                return least
            check = k + max((most - least) // 2, 48)  # a column more adds two at most
        if k + spare < m:
            at, match = places.get(b[k + spare], none)
            places[b[k + spare]] = k, match >> k - at | lowest
        at, match = places.get(c, none)
        match >>= k - at
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up, down = minus | (full ^ (diagonal | plus)), plus & diagonal
        if not diagonal & 1:
            top += 1
        diagonal >>= 1  # the next column begins a row lower
        plus = down | (full ^ (diagonal | up))
        minus = diagonal & up
    last = (1 << spare) - 1
    return top + (plus & last).bit_count() - (minus & last).bit_count()


def nearest(plus: int, minus: int, top: int, last: int, width: int) -> int:
    """What paths through a column cost at least, by the column's first value and the steps down its diagonals; they end on diagonal `last`."""
    size = (width + 7) // 8
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=width - 1, bitorder="little").astype(np.int64) for x in (plus, minus))
    values = np.concatenate(([0], np.cumsum(up - down)))
    return top + int((values + np.abs(np.arange(width) - last)).min())


def replaced(x: list[str], y: list[str], most: float) -> int:
    """Characters that turn the words x into y when the two are walked side by side, and after a difference go on at the nearest words that agree again.

    The edit distance is no more than that. Ends once it exceeds `most`.
    """
    i = j = bound = 0
    n, m = len(x), len(y)
    while bound <= most:
        while i < n and j < m and x[i] == y[j]:
            i += 1
            j += 1
        if i == n or j == m:
            return bound + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)
        for s, t in STEPS:
            if i + s < n and j + t < m and x[i + s] == y[j + t] and x[i + s + 1 : i + s + 2] == y[j + t + 1 : j + t + 2]:
                break
        else:
            s = t = 1
        bound += max(sum(map(len, x[i : i + s])) + s, sum(map(len, y[j : j + t])) + t)
        i += s
        j += t
    return bound


def similar(a: str, b: str, least: float) -> bool:
    """Whether the edit similarity is `least` or more. Where replacing the words that differ is cheap enough, no distance is needed: it is no more than that."""
    longer = max(len(a), len(b))
    if not longer or a == b:
        return True
    if min(len(a), len(b)) < least * longer:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and 1 - sum([max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q]) / longer >= least:
        return True
    if 1 - replaced(x, y, (1 - least) * longer + 1) / longer >= least:
        return True
    return 1 - edit_distance(a, b, int((1 - least) * longer) + 1) / longer >= least


LINE = pa.struct([("line", pa.int32()), ("size", pa.int32()), ("key", pa.binary()), ("fp", pa.int64()), ("fp2", pa.int64())])


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): rows with an id; text_key, a 64-bit hash, tells texts with one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, lines): of each line that isn't blank its number, the length of its normal form, that one's 128-bit hash, and its SimHashes."""

    def made(texts: list[bytes]) -> pa.Array:
        forms, places, ends = [], [], [0]
        for text in texts:
            for k, line in enumerate(text.split(b"\n")):
                if form := normal(line):
                    forms.append(form)
                    places.append(k)
            ends.append(len(forms))
        fp, fp2 = prints_of(forms)
        sizes = [len(f) if f.isascii() else len(f.decode()) for f in forms]
        keys = pa.array([*map(xxhash.xxh3_128_digest, forms)], pa.binary())
        fields = [pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), keys, pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=[*LINE]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low, size = bytes_of(batch, "text"), 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= CHUNK or k == len(texts) - 1:
                    part = batch.slice(low, k + 1 - low)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), made(texts[low : k + 1])], names=["doc_id", "text_key", "lines"])
                    low, size = k + 1, 0

    return rows.mapInArrow(run, "doc_id long, text_key long, lines array<struct<line: int, size: int, key: binary, fp: long, fp2: long>>")


def groups(forms: DataFrame, blocks: int, radius: int, wide: int, similarity: float) -> DataFrame:
    """(group long, block int, id long): forms that are near each other in a block, connected by the pairs that no block before it has."""
    most, bits = PART, -(-64 // blocks)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    shared = []
    for side, (fp, other) in enumerate((("fp", "fp2"), ("fp2", "fp"))):
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            value = F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            shared.append(F.struct((value + ((side * blocks + k) << bits)).alias("key"), F.col(fp).alias("fp"), F.col(other).alias("fp2")))
    keyed = forms.select("id", "size", F.explode(F.array(*shared)).alias("k")).select("k.*", "id", "size")
    dealt = tiled(keyed, "key", F.xxhash64("id"), TILE, few_keys=True)  # keys have 64 / blocks bits
    # Block, tiles and length in one number: what rows are dealt by, and then sorted by, is as narrow as can be. Tiles of a pair are two halves of 31 bits.
    pair = F.shiftright("pair", 31) * (1 << TILE_BITS) + F.col("pair").bitwiseAND((1 << 31) - 1)
    pair = F.when(F.col("pair").bitwiseAND((1 << 31) - 1) >= 1 << TILE_BITS, F.raise_error(F.lit("a block has too many tiles")).cast("long")).otherwise(pair)
    run = (F.col("key") * (1 << 2 * TILE_BITS) + pair).alias("run")
    order = F.col("run") * (1 << SIZE_BITS) + F.least(F.col("size"), F.lit((1 << SIZE_BITS) - 1))
    dealt = dealt.select(run, "size", "fp", "fp2", "id").select(order.alias("order"), "fp", "fp2", "id")
    dealt = dealt.repartition(F.shiftright("order", SIZE_BITS)).sortWithinPartitions("order")
    dealt = dealt.select(F.shiftright("order", SIZE_BITS).alias("run"), "order", "fp", "fp2", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in with_last(batches, ["run"]):
            fp, fp2 = (group.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
            ids, sizes = group.column("id").to_numpy(), group.column("order").to_numpy() & ((1 << SIZE_BITS) - 1)
            starts = runs_of(group, ["run"])
            block = group.column("run").to_numpy() >> 2 * TILE_BITS + bits
            i, j = near(fp, starts, radius, until=reach(sizes, starts, similarity))
            own, other, second = fp[i] ^ fp[j], fp2[i] ^ fp2[j], block[i] >= blocks
            first = first_block(np.where(second, other, own), np.where(second, own, other), blocks, radius, wide) == block[i]
            label = forest(len(fp), i[first], j[first])
            members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            members = members[np.lexsort((ids[members], label[members]))]
            names, places = [], []
            for part in np.split(members, np.flatnonzero(np.diff(label[members])) + 1) if len(members) else []:
                for some in parts(part, sizes, most):
                    names.append(np.full(len(some), xxhash.xxh3_64_intdigest(ids[some].tobytes(), int(block[some[0]])), np.uint64).view(np.int64))
                    places.append(some)
            names, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, places))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(block[places], pa.int32()), pa.array(ids[places])], names=["group", "block", "id"])

    return dealt.mapInArrow(search, "group long, block int, id long").distinct()


def reach(sizes: np.ndarray, starts: np.ndarray, similarity: float) -> np.ndarray:
    """For each row of runs sorted by size, the position after the last row of its run whose length allows the similarity."""
    ends = np.append(starts[1:], len(sizes))
    out = np.empty(len(sizes), np.int64)
    for low, high in zip(starts, ends, strict=True):
        out[low:high] = low + np.searchsorted(sizes[low:high], sizes[low:high] / similarity + 1e-6, "right")
    return out


def parts(members: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The members at once, or where their lines are too much text, every two parts of a bounded size together."""
    chunk = np.cumsum(sizes[members].astype(np.int64)) // most
    cut = np.split(members, np.flatnonzero(np.diff(chunk)) + 1)
    if len(cut) == 1:
        yield members
    for a in range(len(cut)):
        for b in range(a + 1, len(cut)):
            yield np.concatenate((cut[a], cut[b]))


def first_block(differ: np.ndarray, differ2: np.ndarray, blocks: int, radius: int, wide: int) -> np.ndarray:
    """The first block that two lines share, by the bits in which their SimHashes differ; those of the second SimHash follow those of the first. -1 for no candidates."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [np.uint64(((1 << high) - 1) ^ ((1 << low) - 1)) for low, high in zip(edges, edges[1:], strict=False)]
    counts = [np.bitwise_count(x) for x in (differ, differ2)]
    out = np.full(len(differ), -1)
    for k in reversed(range(2 * blocks)):
        side = k // blocks
        out[((differ, differ2)[side] & masks[k % blocks] == 0) & (counts[side] <= radius)] = k
    out[counts[0] + counts[1] > wide] = -1
    return out


def verified(members: DataFrame, blocks: int, radius: int, wide: int, similarity: float) -> DataFrame:
    """(group, block, id, fp, fp2, form) to links (a, b) between lines near in SimHash and in their edits; a spanning forest of each group.

    A pair is tested in the first block that it shares, and so once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in with_last(batches, ["group"]):
            fp, fp2 = (some.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
            ids, block, forms = some.column("id").to_numpy(), some.column("block").to_numpy(), some.column("form").to_pylist()
            i, j = near(np.where(block < blocks, fp, fp2), runs_of(some, ["group"]), radius)
            first = first_block(fp[i] ^ fp[j], fp2[i] ^ fp2[j], blocks, radius, wide) == block[i]
            i, j = i[first], j[first]
            order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(fp2[i] ^ fp2[j]), kind="stable")
            a, b = confirmed(len(fp), i[order], j[order], lambda x, y, forms=forms: similar(forms[x], forms[y], similarity))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

    return members.repartition("group").sortWithinPartitions("group", "id").mapInArrow(run, "a long, b long")


def with_forms(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, fp, fp2, form) of wanted lines (id, doc_id, text_key, line, fp, fp2), read again from the texts of rows."""
    line = F.struct("line", "id", "fp", "fp2")
    places = wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list(line).alias("places"))  # a text's lines at most
    texts = rows.join(places, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k"))).select("text", "places")
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(bytes_of(batch, "text"), batch.column("places").to_pylist(), strict=True):
                parts_ = text.split(b"\n")
                out += [{"id": x["id"], "fp": x["fp"], "fp2": x["fp2"], "form": normal(parts_[x["line"]]).decode()} for x in own]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    made = texts.mapInArrow(run, "id long, fp long, fp2 long, form string")
    return made.dropDuplicates(["id"])


def kept_lines(
    docs: DataFrame, blocks: int = 5, radius: int = 10, wide: int = 18, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_lines, n_kept, kept_lines), a row per row with an id: its lines (blank ones aside), those that stay, and their numbers from 0."""
    spark = docs.sparkSession
    rows = documents_of(docs, id_col, text_col)
    found = scratch.save(lines(rows), "lines")
    single = found.select("doc_id", "text_key", F.explode("lines").alias("x")).select("doc_id", "text_key", "x.*")
    forms = single.groupBy("key").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"), *(F.first(c).alias(c) for c in ("fp", "fp2", "size")))
    forms = scratch.save(forms.drop("key").withColumn("id", F.monotonically_increasing_id()), "forms")
    near_by = groups(forms, blocks, radius, wide, similarity)
    path = scratch.write(near_by, "groups")
    near_by = scratch.load(spark, path, near_by)
    wanted = forms.join(near_by.select("id").distinct(), "id").select("id", "fp", "fp2", "first.*")
    edges = verified(near_by.join(with_forms(rows, wanted), "id").select("group", "block", "id", "fp", "fp2", "form"), blocks, radius, wide, similarity)
    roots = components(edges)
    scratch.drop(spark, path)
    own = forms.join(roots.withColumnRenamed("node", "id"), "id").select("root", "first")
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    later = own.join(least, "root").where("first != least")
    of_text = lambda df, name: df.groupBy("first.doc_id", "first.text_key").agg(F.array_sort(F.collect_list("first.line")).alias(name))  # noqa: E731  a text's lines at most
    none = F.array().cast("array<int>")
    stay = of_text(forms, "stay").join(of_text(later, "gone"), ["doc_id", "text_key"], "left")
    stay = stay.select("doc_id", "text_key", F.array_except("stay", F.coalesce("gone", none)).alias("stay"))
    out = found.select("doc_id", "text_key", F.size("lines").cast("long").alias("n_lines")).join(stay, ["doc_id", "text_key"], "left")
    n_kept = F.when(F.col("stay").isNull(), 0).otherwise(F.size("stay")).cast("long")
    return out.select("doc_id", "text_key", "n_lines", n_kept.alias("n_kept"), F.coalesce(F.array_join("stay", ","), F.lit("")).alias("kept_lines"))


def deduplicate(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay (and blank lines) only, by the decisions of kept_lines()."""
    own_id, own_key, kept = (fresh(docs, c) for c in ("id", "key", "kept"))
    own = decisions.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.split("kept_lines", ",").alias(kept)).dropDuplicates([own_id, own_key])
    joined = docs.join(own, (F.col(id_col).cast("long") == F.col(own_id)) & (text_key(F.col(text_col)) == F.col(own_key)), "left")
    cut = F.split(text_col, "\n")
    stays = F.filter(cut, lambda line, k: (F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")) == "") | F.array_contains(kept, k.cast("string")))
    text = F.when(F.col(kept).isNotNull(), F.array_join(stays, "\n")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*docs.columns)
