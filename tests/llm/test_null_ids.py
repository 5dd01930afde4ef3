"""Rows without an id, and rows that repeat one, in the operators that give a row for each."""

import pytest
from palimpsest.llm import class_lm, language_id, packing, piece_bpe, secrets, simhash_dedup
from palimpsest.llm.common import fold_of
from palimpsest.llm.queries import tokenizer_file
from pyspark.sql import functions as F

FOX, ALONE = "the quick brown fox jumps over it", "nothing else is like this one here"
ROWS = [(None, FOX, "en"), (None, FOX, "en"), (None, None, "en"), (None, ALONE, "en"), (1, FOX, "en"), (1, "other text is here now", "en"), (2, "", "de"), (3, 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"', None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3).cache()


def ids(found):
    return sorted((r["doc_id"] is not None, r["doc_id"]) if r["doc_id"] is not None else (False, 0) for r in found)


EVERY = sorted((i is not None, i or 0) for i, *_ in ROWS)


def test_simhash(docs):
    found = simhash_dedup.near_duplicates(docs, words=3, radius=2, blocks=4).collect()
    assert ids(found) == EVERY
    # FOX links with id 1, the null text with the empty one of id 2, and ALONE with nothing.
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == ["1", "1", "2", "None"]


def test_secrets_and_pieces(docs):
    assert ids(secrets.find(docs).collect()) == EVERY
    assert ids(piece_bpe.encoded(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False).collect()) == EVERY


def test_packing(docs):
    found = packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"), limit=4096, end_id=1).collect()
    assert ids(found) == EVERY  # each is one piece
    assert sorted(r["offset"] for r in found)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in found}) == len(ROWS)


def test_language_models(docs):
    rows = docs.select("doc_id", "text", (fold_of(F.col("doc_id"), 10) == 0).alias("held_out"))
    model = class_lm.fit(rows.where("not held_out"))
    assert model.tokens == 8 + 6 + 1 + 4  # what rows with an id hold
    found = class_lm.score(rows, model, keep=("held_out",)).collect()
    assert ids(found) == EVERY and all(r["score"] < 0 for r in found)


def test_language_id(spark, docs):
    model = language_id.fit(docs.where("doc_id is not null"))
    found = language_id.identify(spark, docs, model).collect()
    assert ids(found) == EVERY
    assert [r["lang_pred"] for r in found if r["text"] is None] == [language_id.UND]
