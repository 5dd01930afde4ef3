"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from labelled running text. A text's letters (lower-cased, each run of anything else being one space) are
parsed greedily into the longest phrases that the automaton contains, across words; the language needing the fewest phrases, times the
bits that name a place in its labelled text, wins. Whole texts are parsed, and nothing of a text is kept.

The automata are fitted on a bounded sample of the labelled rows: whole texts, taken in the order of a hash of their ids, `sample_docs` of a language at most,
and of these as many as fit into a share of `sample_size` characters for all languages together; a text that doesn't fit is passed over, unless none of its language does. Languages are
values of the label column; more than `most_languages` is an error.

The score is 1 - cost(best) / cost(second), in [0, 1]; with one language only it is 1. Ties go to the language first by name.
Defined cases: null texts and texts without a letter are `und`, score 0, as is everything if no row has a label; rows
without an id are all in fit()'s sample, as a null hashes low, so callers leave them out before, and identify() predicts theirs; rows that repeat an id each get a row; an empty table gives an empty result; extra columns are kept as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



UND = "und"
#: Anything that is no letter.
GAP = re.compile(r"[\W\d_]+")
READERS: dict[str, "Reader"] = {}


def running(text: str) -> str:
    """Lower-case letters, with one space for whatever stands between them."""
    return f" {GAP.sub(' ', text.lower()).strip()} "


class SuffixAutomaton:
    """Every substring of the labelled text, as paths from the root; a state is the dictionary of its transitions."""

    def __init__(self, text: str) -> None:
        root: dict = {}
        out, link, length = [root], [-1], [0]
        last = 0
        for c in text:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append({})
            p = last
            while p >= 0 and c not in out[p]:
                out[p][c] = cur
                p = link[p]
            if p >= 0:
                q = out[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    out.append(out[q].copy())
                    while p >= 0 and out[p].get(c) == q:
                        out[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state in out:
            for c, k in state.items():
                state[c] = out[k]
        self.root = root

    def phrases(self, text: str) -> int:
        """How many longest matches a greedy parse needs; a character that does not occur is a phrase of its own."""
        root = edges = self.root
        count = 0
        for c in text:
            after = edges.get(c)
            if after is None:
                count += 1
                after = root.get(c, root)
                if after is root and edges is not root:
                    count += 1
            edges = after
        return count + (edges is not root)


@dataclass(frozen=True)
class Languages:
    """The fitted model: labels and their sampled text."""

    names: tuple[str, ...]
    texts: tuple[str, ...]

    @property
    def key(self) -> str:
        return f"{self.names}{hash(self.texts)}"


class Reader:
    """A model as a worker holds it."""

    def __init__(self, model: Languages) -> None:
        self.names = model.names
        self.automata = [SuffixAutomaton(t) for t in model.texts]
        self.bits = [math.log2(len(t) + 2) for t in model.texts]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UND, 0.0
        own = running(text)
        cost = [a.phrases(own) * b for a, b in zip(self.automata, self.bits, strict=True)]
        best = min(range(len(cost)), key=cost.__getitem__)
        if len(cost) == 1:
            return self.names[0], 1.0
        second = min(c for k, c in enumerate(cost) if k != best)
        return self.names[best], 1.0 - cost[best] / second


def fit(labelled: DataFrame, sample_docs: int = 256, sample_size: int = 240_000, most_languages: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Rows without a label or text are left out. What comes to the driver is about sample_size characters, however long single texts are."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Languages((), ())
    room = sample_size // len(sizes)
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 40) * min(1.0, sample_docs / n)) + 1)))
    drawn = rows.where(order < F.element_at(share, F.col("lang"))).select("lang", order.alias("at"), "id", F.length("text").alias("size"), "text")
    # Lengths come first, some sample_docs numbers a language; then only the texts that were chosen.
    kept, left = set(), dict.fromkeys(sizes, room)
    heads = sorted(drawn.select("lang", "at", "id", "size").collect(), key=lambda r: (r["at"], r["id"] or ""))
    for r in heads:
        if r["size"] <= left[r["lang"]]:
            left[r["lang"]] -= r["size"]
            kept.add((r["lang"], r["at"]))
    for r in sorted(heads, key=lambda r: (r["size"], r["at"])):  # a language of long texts alone has its shortest one
        if left[r["lang"]] == room and not any(lang == r["lang"] for lang, _ in kept):
            kept.add((r["lang"], r["at"]))
    chosen = labelled.sparkSession.createDataFrame(sorted(kept), "lang string, at long")  # sample_docs rows a language
    texts = dict.fromkeys(sizes, "")
    for r in sorted(drawn.join(F.broadcast(chosen), ["lang", "at"]).dropDuplicates(["lang", "at"]).collect(), key=lambda r: r["at"]):
        texts[r["lang"]] += running(r["text"])[:-1]
    names = tuple(sorted(texts))
    return Languages(names, tuple(texts[n] + " " for n in names))


def identify(spark: SparkSession, docs: DataFrame, model: Languages, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and the score."""
    if {lang_as, score_as} & set(docs.columns):
        raise ValueError(f"name the new columns otherwise: {lang_as} or {score_as} is there already")
    shared = spark.sparkContext.broadcast(model)  # bounded by most_languages times sample_size
    key = f"{model.key}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in READERS:
            READERS.clear()
            READERS[key] = Reader(shared.value)
        reader = READERS[key]
        for batch in batches:
            found = [reader.predict(t) for t in batch.column(text_col).to_pylist()]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, lang_as, score_as])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return docs.mapInArrow(run, schema)
