"""A training corpus from raw documents, as five stages; each is one operator whose decisions take effect.

A stage gets the documents that its predecessor kept and returns a DataFrame, which run() writes as Parquet and reads again.
All but the last return the columns of documents. Decisions are made by row: rows with one id and other texts have fates of their own, and only
equal rows share theirs.

1. language: texts without a letter, null ones included, go (predicted `und`); no other text does, with labels or without.
2. exact: of equal texts, the document with the smallest doc_id stays.
3. near: documents link if their SimHashes are near and their 5-word shingles have a Jaccard similarity of 0.8 or more; of
   the documents that links connect, the one with the smallest doc_id stays.
4. secrets: spans found as secrets are replaced in the text; every document stays.
5. packing: documents become token sequences of at most 4096 tokens; a row per piece.

A null doc_id cannot be decided on and passes stages 2 and 3. An empty table gives empty stages; other columns, whatever their names, pass the first four.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.llm import language_id, packing, secrets
from palimpsest.llm.common import fold_of, fresh, table
from palimpsest.llm.exact_dedup import exact_duplicates, text_hash
from palimpsest.llm.queries import tokenizer_file
from palimpsest.llm.simhash_dedup import confirmed_duplicates, text_key
from palimpsest.session import configure


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs but for the rows of gone(doc_id, key), where key is made of the text; all columns stay."""
    id_, own = fresh(docs, "id"), fresh(docs, "key")
    gone = gone.toDF(id_, own).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(id_)) & (key == F.col(own)), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = language_id.fit(docs.where(fold_of(F.col("doc_id"), 5) != 0))
    if not model.names:  # no label to learn from: one language that takes every text with a letter
        model = language_id.Languages(("any",), ("",))
    lang, score = fresh(docs, "lang"), fresh(docs, "score")
    found = language_id.identify(spark, docs, model, lang_as=lang, score_as=score)
    return found.where(F.col(lang) != language_id.UND).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    gone = exact_duplicates(docs, keep="min").where("not kept").select("doc_id", "text_sha256")
    return without(docs, gone, text_hash(F.col("text")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    gone = confirmed_duplicates(docs, check_words=5, similarity=0.8).where("not kept").select("doc_id", "text_key")
    return without(docs, gone, text_key(F.col("text")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"), limit=4096, end_id=1).drop("copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]

#: Language models, fingerprints and tokenizers have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), "stage")
    return docs
