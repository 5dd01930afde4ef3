"""A class-based bigram language model: exchange clustering of words, and scores of whole texts.

P(word | before) = P(class | class before) * P(word | class). A text is its words (A-Z lower-cased, cut at ASCII white space) and
one end, which is a class of its own and also what stands before the first word.

Clustering works on units: the `exchange_words` most frequent words are units of their own, and every other word, unseen ones
included, belongs to one of `signatures` units by its last three bytes and its shape. All training words therefore count, and what
tasks hold is bounded. Unit bigrams of the whole training text are counted once; each round of exchange then takes
units in parallel, tries each class for each of half of the units against the class-bigram counts of the round before,
and keeps the assignment if the likelihood grows. Rounds end when neither half of the units gains more than `tolerance` of the likelihood; if `rounds` pass
before that, a warning is given.

Emissions use the count of each single word over all training text. The `core_words` most frequent are sent to the tasks; the rest of
a text's words is joined with the vocabulary by Spark, so a vocabulary of any size works.

Smoothing: a class emits w with (c(w) + d) / (N(class) + d * (V(class) + 1)), d = 0.1, one place being for all unseen words;
transitions are interpolated with the class unigram, weighted by `prior`.
Defined cases: null counts as empty, i.e. an end alone; without training rows all counts are zero and every word is unseen; rows
that repeat an id, a null one included, each get a row (a fold made of a null id is null: such rows are scored and never trained on); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from .common import bytes_of, emit

DISCOUNT = 0.1
#: Distinct words that a task counts before it sends them on.
FLUSH = 400_000
#: Bytes of the longest word that a task keeps the unit of, and of the text that it counts at most before it sends words on.
LONG, TEXT = 64, 256 << 20


@dataclass(frozen=True)
class Sizes:
    exchange_words: int = 4096
    signatures: int = 1024
    classes: int = 96
    core_words: int = 1 << 17
    rounds: int = 200
    tolerance: float = 1e-4
    prior: float = 20.0

    @property
    def units(self) -> int:
        """Words, then signatures, then the end."""
        return self.exchange_words + self.signatures + 1

    @property
    def end(self) -> int:
        return self.units - 1


def signature_of(word: bytes, sizes: Sizes) -> int:
    """The unit of a word that has none of its own."""
    shape = (len(word) > 6) + 2 * word.isalpha() + 4 * word.isdigit()
    return sizes.exchange_words + zlib.crc32(word[-3:] + bytes([shape])) % sizes.signatures


class Units(dict):
    """word -> unit; words outside are given their signature's when first met, in a bounded memory."""

    def __init__(self, words: list[bytes], sizes: Sizes, room: int = 300_000) -> None:
        super().__init__((w, k) for k, w in enumerate(words[: sizes.exchange_words]))
        self.sizes, self.room, self.fixed = sizes, room, len(self)

    def __missing__(self, word: bytes) -> int:
        unit = signature_of(word, self.sizes)
        if len(word) <= LONG and len(self) < self.fixed + self.room:
            self[word] = unit
        return unit


@dataclass
class Model:
    sizes: Sizes
    vocabulary: DataFrame
    tokens: int
    distinct: int
    ends: int
    core: list[tuple[bytes, int]]
    class_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    bigrams: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    members: np.ndarray = field(default_factory=lambda: np.zeros(0))
    likelihood: list[float] = field(default_factory=list)

    def transition(self) -> np.ndarray:
        """log10 P(class | class before)."""
        n = self.bigrams
        unigram = n.sum(0) + DISCOUNT
        unigram = unigram / unigram.sum()
        return np.log10((n + self.sizes.prior * unigram) / (n.sum(1, keepdims=True) + self.sizes.prior))

    def emission_base(self) -> np.ndarray:
        """log10 of what the words of each class share the probability of."""
        return np.log10(self.bigrams.sum(0) + DISCOUNT * (self.members + 1))


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) of a `text` column."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        read = 0
        for batch in batches:
            for text in bytes_of(batch, "text"):
                counts.update(text.lower().split())
                read += len(text)
            if len(counts) > FLUSH or read > TEXT:
                yield emit(schema, [list(counts), list(counts.values())])
                counts.clear()
                read = 0
        yield emit(schema, [list(counts), list(counts.values())])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def unit_bigrams(texts: DataFrame, words: list[bytes], sizes: Sizes) -> DataFrame:
    """(a int, b int, n long): how often unit b follows unit a, over whole texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(words[: sizes.exchange_words])
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    width = sizes.units

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value, sizes)
        get, end = units.__getitem__, sizes.end
        keys, counts, waiting = [], [], 0
        for batch in batches:
            ids: list[int] = [end]
            for text in bytes_of(batch, "text"):
                ids += map(get, text.lower().split())
                ids.append(end)
            u = np.array(ids, np.int64)
            key, n = np.unique(u[:-1] * width + u[1:], return_counts=True)
            keys.append(key)
            counts.append(n)
            waiting += len(key)
            if waiting > 3_000_000:
                key, n = merged(keys, counts)
                keys, counts, waiting = [key], [n], 0
                if len(key) > 1_500_000:
                    yield emit(schema, [key // width, key % width, n])
                    keys, counts = [], []
        if keys:
            key, n = merged(keys, counts)
            yield emit(schema, [key // width, key % width, n])

    return texts.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, now: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that raises the likelihood most for each unit, and by how much.

    left[u, c]: how often class c stands before unit u; right[u, c]: after it; own[u]: how often u follows itself;
    now[u]: its class; n: class bigrams. The likelihood is sum f(n[a, b]) - sum f(row) - sum f(column), f(x) = x log x.
    """
    classes = len(n)
    best, gain = now.copy(), np.zeros(len(now))
    rows, columns = n.sum(1), n.sum(0)
    for u in range(len(now)):
        a, before, after, self_ = now[u], left[u].copy(), right[u].copy(), own[u]
        total_in, total_out = before.sum(), after.sum()
        if not total_in:
            continue
        before[a] -= self_  # what joins the unit with itself moves with it
        after[a] -= self_
        m = n.copy()
        m[a, :] -= after
        m[:, a] -= before
        m[a, a] -= self_
        r, c = rows.copy(), columns.copy()
        r[a] -= total_out
        c[a] -= total_in
        m = np.maximum(m, 0)
        fm = xlogx(m)
        add_row = (xlogx(m + after[None, :]) - fm).sum(1)
        add_column = (xlogx(m + before[:, None]) - fm).sum(0)
        corner = np.diag(m)
        fix = xlogx(corner + after + before + self_) - xlogx(corner + after) - xlogx(corner + before) + xlogx(corner)
        score = add_row + add_column + fix - (xlogx(r + total_out) - xlogx(r)) - (xlogx(c + total_in) - xlogx(c))
        score[classes - 1] = -np.inf  # the end's own class
        b = int(score.argmax())
        if score[b] > score[a] + 1e-9:
            best[u], gain[u] = b, score[b] - score[a]
    return best, gain


def exchange(counts: DataFrame, sizes: Sizes, words: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all units, class bigrams, and the likelihood of each round.

    counts are unit bigrams. They are laid out once by unit, both as the first and as the second of a pair; a task then
    has every count of its units, and a round moves nothing but class numbers and one class-by-class table a task.
    """
    spark = counts.sparkSession
    classes, units, end = sizes.classes, sizes.units, sizes.end
    class_of = np.arange(units, dtype=np.int64) % (classes - 1)
    class_of[end] = classes - 1
    sides = counts.select(F.col("a").alias("unit"), F.col("b").alias("other"), F.lit(1).alias("right"), "n").unionByName(
        counts.select(F.col("b").alias("unit"), F.col("a").alias("other"), F.lit(0).alias("right"), "n")
    )
    sides = scratch.save(sides.repartition(F.pmod(F.col("unit"), F.lit(24))), "unit-pairs")

    def contexts(batches: Iterator[pa.RecordBatch], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        left, right, own = np.zeros((units, classes)), np.zeros((units, classes)), np.zeros(units)
        seen = np.zeros(units, bool)
        for batch in batches:
            u, o, side, n = (batch.column(k).to_numpy() for k in ("unit", "other", "right", "n"))
            seen[u] = True
            for target, rows in ((right, side == 1), (left, side == 0)):
                key, at = np.unique(u[rows].astype(np.int64) * classes + of[o[rows]], return_inverse=True)
                target.ravel()[key] += np.bincount(at, weights=n[rows], minlength=len(key)) if len(key) else 0
            same = (u == o) & (side == 1)
            np.add.at(own, u[same], n[same])
        return np.flatnonzero(seen), left, right, own

    def table(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros(classes * classes)
            for batch in batches:
                key = shared.value[batch.column("unit").to_numpy()] * classes + shared.value[batch.column("other").to_numpy()]
                part += np.bincount(key, weights=batch.column("n").to_numpy(), minlength=classes * classes)
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[at])], names=["key", "n"])

        out = np.zeros(classes * classes)
        for r in sides.where("right = 1").mapInArrow(run, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).collect():  # classes squared at most
            out[r["key"]] = r["n"]
        return out.reshape(classes, classes)

    def moves(of: np.ndarray, n: np.ndarray, turn: int) -> list:
        shared = spark.sparkContext.broadcast((of, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_, n_ = shared.value
            found, left, right, own = contexts(batches, of_)
            found = found[(found != end) & ((found * 2654435761 >> 7) % 2 == turn % 2)]
            best, gain = best_classes(left[found], right[found], own[found], of_[found], n_)
            moved = gain > 0
            yield pa.RecordBatch.from_arrays([pa.array(found[moved]), pa.array(best[moved]), pa.array(gain[moved])], names=["unit", "class", "gain"])

        return sides.mapInArrow(run, "unit long, class long, gain double").collect()  # a row per unit at most

    n = table(class_of)
    value = lambda m: float(xlogx(m).sum() - xlogx(m.sum(1)).sum() - xlogx(m.sum(0)).sum())
    seen = [value(n)]
    idle = 0  # rounds without a gain; the halves take turns
    for turn in range(sizes.rounds):
        found = moves(class_of, n, turn)
        better = None
        for share in (1.0, 0.4, 0.1):  # units move at once; where that overshoots, only those that gain most
            kept = sorted(found, key=lambda r: (-r["gain"], r["unit"]))[: int(len(found) * share + 0.999)]
            trial = class_of.copy()
            for r in kept:
                trial[r["unit"]] = r["class"]
            m = table(trial)
            if (v := value(m)) > seen[-1]:
                better = trial, m, v
                break
        if better is not None:
            class_of, n, v = better
            idle = 0 if v - seen[-1] > sizes.tolerance * abs(seen[-1]) else idle + 1
            seen.append(v)
        else:
            idle += 1
        if idle == 2:
            break
    else:
        warnings.warn(f"classes still changed after {sizes.rounds} rounds", stacklevel=2)
    return class_of, n, seen


def most_frequent(vocabulary: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, `most` of them at most, by count and then by themselves.

    A histogram of counts on a logarithmic grid tells which words these are, so that no task and not the driver sees more than it keeps.
    """
    step = F.floor(F.log2(F.col("c")) * 32).cast("int")
    left, least = most, None
    for r in sorted(vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):  # 32 * 63 rows at most
        if (left := left - r["n"]) < 0:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in vocabulary.where(step >= least).toLocalIterator()), key=lambda x: (-x[1], x[0]))


def fit(train: DataFrame, sizes: Sizes = Sizes(), text_col: str = "text") -> Model:
    """Learns from every row of train."""
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    vocabulary = scratch.save(count_words(texts), "vocabulary")
    ends = texts.count()
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    core = most_frequent(vocabulary, sizes.core_words)
    model = Model(sizes, vocabulary, words + ends, distinct + (ends > 0), ends, core)
    counts = scratch.save(unit_bigrams(texts, [w for w, _ in core], sizes), "unit-bigrams")
    model.class_of, model.bigrams, model.likelihood = exchange(counts, sizes, len(core))
    model.members = class_members(spark, model)
    return model


def class_members(spark: SparkSession, model: Model) -> np.ndarray:
    """Distinct words of each class, over the whole vocabulary."""
    sizes = model.sizes
    shared = spark.sparkContext.broadcast(([w for w, _ in model.core[: sizes.exchange_words]], model.class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, class_of = shared.value
        units, part = Units(words, sizes, 0), np.zeros(sizes.classes, np.int64)
        for batch in batches:
            part += np.bincount(class_of[[units[w] for w in batch.column("word").to_pylist()]], minlength=sizes.classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sizes.classes)), pa.array(part)], names=["class", "n"])

    out = np.zeros(sizes.classes)
    for r in model.vocabulary.select("word").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    out[sizes.classes - 1] += model.ends > 0
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) and the columns in keep, a row per document; log10 of the text's probability."""
    spark, sizes = docs.sparkSession, model.sizes
    base = float(np.log10(model.tokens + DISCOUNT * (model.distinct + 1)))
    shared = spark.sparkContext.broadcast((model.core, model.class_of, model.transition(), model.emission_base(), model.ends))  # bounded by Sizes
    names = ("n_tokens", "n_known", "base_score", "score")
    rare_type = pa.struct([("word", pa.binary()), ("class", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, class_of, transition, shares, ends = shared.value
        units = Units([w for w, _ in core], sizes, 0)
        place = {w: k for k, (w, _) in enumerate(core)}
        own_class = np.array([class_of[units[w]] for w, _ in core] or [0], np.int64)
        counts = np.array([c for _, c in core] or [0], float)
        log_count = np.log10(counts + DISCOUNT)
        emission = log_count - shares[own_class]
        end_class = sizes.classes - 1
        end_base = np.log10(ends + DISCOUNT) - base
        end_emission = np.log10(ends + DISCOUNT) - shares[end_class]
        get = place.get
        unit_of = units.__getitem__
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            rare, rare_classes, ends_at = [], [], [0]
            for text in bytes_of(batch, "text"):
                words = text.lower().split()
                at = np.array([get(w, -1) for w in words], np.int64)
                out = np.flatnonzero(at < 0)
                known = at[at >= 0]
                classes = np.empty(len(at) + 2, np.int64)
                classes[0] = classes[-1] = end_class
                inner = classes[1:-1]
                inner[:] = own_class[at]
                own = [words[k] for k in out.tolist()]
                rare_class = class_of[[unit_of(w) for w in own]] if own else np.zeros(0, np.int64)
                inner[out] = rare_class
                rare += own
                rare_classes.append(rare_class)
                ends_at.append(len(rare))
                columns[0].append(len(words) + 1)
                columns[1].append(len(known) + (ends > 0))
                columns[2].append(float(log_count[known].sum() - base * len(known) + end_base))
                columns[3].append(float(transition[classes[:-1], classes[1:]].sum() + emission[known].sum() + end_emission))
            values = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(np.concatenate(rare_classes) if rare_classes else [], pa.int32())], fields=[*rare_type])
            arrays = [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *keep, *names, "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    found = rows.mapInArrow(run, f"doc_id long, {kept}n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, class: int>>")
    found = scratch.save(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    shares = F.array(*(F.lit(float(x)) for x in model.emission_base()))
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.class")
    rare = rare.join(model.vocabulary, "word", "left").withColumn("log_count", F.log10(F.coalesce("c", F.lit(0)) + DISCOUNT))
    sums = rare.groupBy("row").agg(
        F.count("c").alias("more_known"),
        F.sum(F.col("log_count") - base).alias("more_base"),
        F.sum(F.col("log_count") - F.element_at(shares, F.col("class") + 1)).alias("more_score"),
    )
    zero = F.lit(0.0)
    return found.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
