"""Text search over the blocks of an archive: an inverted index, BM25 ranks, and substring matches for what isn't indexed yet.

Words are runs of letters and digits, in lower case. Query words, and nothing else, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..archive import Archive
from .analytics import escaped
from .stemmer import stem

WORD_END = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: A rebuild is due when this many blocks, or this share of the indexed ones, are new.
REBUILD_BLOCKS, REBUILD_SHARE = 2000, 0.05
SNIPPET_CONTEXT = 120


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_END), lambda w: w != "")


@dataclass
class TextIndex:
    """postings(term, block_id, tf, len), len being the block's length in terms, docs(block_id, len), and how words became terms.

    size is (blocks, terms of all blocks) where that is known without a look at docs.
    """

    postings: DataFrame
    docs: DataFrame
    stop_words: Sequence[str] = ()
    stems: bool = True
    size: tuple[int, int] | None = None

    @property
    def dictionary(self) -> DataFrame:
        """(term, df): in how many blocks each term is."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@F.pandas_udf(StringType())
def _stem_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(stem)


def _terms(words: DataFrame, stop_words: Sequence[str], stems: bool) -> DataFrame:
    """Adds term to rows with word; stop words go. Each distinct word is stemmed once."""
    if stop_words:
        words = words.where(~F.col("word").isin(*stop_words))
    if not stems:
        return words.withColumn("term", F.col("word"))
    return words.join(words.select("word").distinct().withColumn("term", _stem_words("word")), "word")


def build_text_index(blocks: DataFrame, stop_words: Sequence[str] = (), stems: bool = True) -> TextIndex:
    """The index of content blocks; blocks without text count as documents of length 0."""
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    rows = blocks.select(F.col("id").alias("block_id"), words.alias("words"))
    counted = rows.select("block_id", F.size("words").cast("long").alias("len"), F.explode("words").alias("word")).groupBy("block_id", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    postings = counted.withColumnRenamed("word", "term")
    if stems:
        postings = _terms(counted, (), True).groupBy("term", "block_id", "len").agg(F.sum("tf").alias("tf"))
    return TextIndex(postings.select("term", "block_id", "tf", "len"), rows.select("block_id", F.size("words").cast("long").alias("len")), tuple(stop_words), stems)


def asked_terms(index: TextIndex, query: str) -> list[str]:
    """The terms of a query's words, each once."""
    spark = index.docs.sparkSession
    words = spark.createDataFrame([(query,)], "query string").select(tokens(F.col("query"))).first()[0]
    return sorted({stem(w) if index.stems else w for w in words if w not in index.stop_words})


def match_bm25(index: TextIndex, query: str) -> DataFrame:
    """(block_id, score) of blocks in which a word of the query occurs. Only the query's terms are read of the postings; their own rows tell how rare they are."""
    hits = index.postings.where(F.col("term").isin(asked_terms(index, query)))
    n, total = index.size or index.docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    rarity = hits.groupBy("term").agg(F.log(1 + (n - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf"))  # a row per word of the query
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(total / n if total else 1.0)))
    return hits.join(F.broadcast(rarity), "term").groupBy("block_id").agg(F.sum(score).alias("score"))


def located(a: Archive, source: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Blocks with their message and conversation. since is inclusive and until exclusive, both dates in UTC."""
    m = a.messages.select(F.col("id").alias("message_id"), "conversation_id", "role", "created_at", "sequence_index")
    c = a.conversations.select(F.col("id").alias("conversation_id"), "title", F.col("source_id").alias("source"), "project")
    if since:
        m = m.where(F.col("created_at") >= F.to_timestamp(F.lit(since), "yyyy-MM-dd"))
    if until:
        m = m.where(F.col("created_at") < F.to_timestamp(F.lit(until), "yyyy-MM-dd"))
    if source:
        c = c.where(F.col("source") == source)
    return a.content_blocks.select(F.col("id").alias("block_id"), "message_id", "block_index", "text").join(m, "message_id").join(c, "conversation_id")


def matching(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose text holds the query, whatever its case; % and _ are wildcards."""
    return rows.where(F.lower("text").like(f"%{escaped(query.lower())}%")).withColumn("score", F.lit(1.0))


def snippet(text: Column, query: str, context: int = SNIPPET_CONTEXT) -> Column:
    """The text around the query's first word; its beginning if the word isn't in it."""
    first = (query.split() or [query])[0]
    at = F.instr(F.lower(text), first.lower()) - 1
    start, end = F.greatest(F.lit(0), at - context), F.least(F.length(text), at + len(first) + context)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    head = F.when(F.length(text) > 2 * context, F.concat(F.substring(text, 1, 2 * context), F.lit("..."))).otherwise(text)
    return F.when(text.isNull(), "").when(at < 0, head).otherwise(around)


SUBSTRING_ORDER = ("sequence_index", "block_index", "block_id")


def shaped(rows: DataFrame, query: str, *more: str) -> DataFrame:
    return rows.select(*more, "score", "conversation_id", "block_id", "title", "source", "project", "role", "created_at", snippet(F.col("text"), query).alias("snippet"))


def search_substring(a: Archive, query: str, limit: int | None = 20, **filters: str | None) -> DataFrame:
    """Substring matches in order of their place in conversations; limit None: all, in no order."""
    rows = matching(located(a, **filters), query)
    return shaped(rows if limit is None else rows.orderBy(*SUBSTRING_ORDER).limit(limit), query)


def search(a: Archive, index: TextIndex | None, query: str, limit: int = 20, **filters: str | None) -> DataFrame:
    """The best ranked blocks, then substring matches in blocks that the index lacks, which get a quarter of the places at least.

    Without an index all results are substring matches. rank orders the rows.
    """
    rows = located(a, **filters)
    fresh = matching(rows, query)
    if index:
        fresh = fresh.join(index.docs, "block_id", "left_anti")
    found = fresh.orderBy(*SUBSTRING_ORDER).limit(limit).withColumn("fresh", F.lit(True))
    if index:
        ranked = rows.join(match_bm25(index, query), "block_id").orderBy(F.desc("score"), "block_id").limit(limit)
        found = found.unionByName(ranked.withColumn("fresh", F.lit(False)))
    # From here on there are 2 * limit rows at most.
    order = [F.when(~F.col("fresh"), -F.col("score")), F.when(F.col("fresh"), F.col("sequence_index")), F.when(F.col("fresh"), F.col("block_index")), F.col("block_id")]
    everything = Window.partitionBy(F.lit(0))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("fresh").orderBy(*order))).withColumn("n_fresh", F.count_if("fresh").over(everything)).withColumn("n_ranked", F.count_if(~F.col("fresh")).over(everything))
    keep = F.least("n_fresh", F.greatest(F.lit(limit // 4), limit - F.col("n_ranked")))
    found = found.where(F.when(F.col("fresh"), F.col("place") <= keep).otherwise(F.col("place") <= limit - keep))
    found = found.withColumn("rank", F.row_number().over(everything.orderBy("fresh", "place")))
    return shaped(found, query, "rank").orderBy("rank")


def index_coverage(a: Archive, index: TextIndex | None) -> DataFrame:
    """One row: indexed blocks, blocks with text that the index lacks, and whether a rebuild is due."""
    texts = a.content_blocks.where("text is not null").select(F.col("id").alias("block_id"), F.lit(0).alias("indexed"), F.lit(1).alias("pending"))
    if index is None:
        rows = texts
    else:
        rows = texts.join(index.docs, "block_id", "left_anti").unionByName(index.docs.select("block_id", F.lit(1).alias("indexed"), F.lit(0).alias("pending")))
    out = rows.agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("indexed"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))
    due = F.lit(True) if index is None else F.col("pending") >= F.greatest(F.lit(REBUILD_BLOCKS), F.floor(F.col("indexed") * REBUILD_SHARE))
    return out.withColumn("needs_rebuild", due)
