"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..session import configure
from . import class_lm, language_id, lexical, line_dedup, lz_fingerprint, merkle, packing, pii, piece_bpe, secrets, warc
from .common import fold_of, table
from .exact_dedup import exact_duplicates
from .simhash_dedup import fingerprint_text, near_duplicates


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(configure(spark), sf_dir, "documents"), words=3, radius=2, blocks=4)
    return found.select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(configure(spark), sf_dir, "documents"), keep="max")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents").select("doc_id", "text", (fold_of(F.col("doc_id"), 10) == 0).alias("held_out"))
    model = class_lm.fit(docs.where("not held_out"))
    found = class_lm.score(docs, model, keep=("held_out",))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    return packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"), limit=4096, end_id=1).drop("copy")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(configure(spark), sf_dir, "documents"))
    counts = [secrets.of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    tests = F.array_join(F.transform("tests", lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string"), t["stratum"], F.format_number(t["p"], 4))), ",")
    joined = secrets.joined(F.col("base")).cast("binary")
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), tests.alias("tests"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_lines(table(configure(spark), sf_dir, "documents")).drop("text_key")


def op7_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    return piece_bpe.encoded(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    learn = fold_of(F.col("doc_id"), 5) != 0
    model = language_id.fit(docs.where(learn))
    return language_id.identify(spark, docs.select("doc_id", (~learn).alias("held_out"), "text"), model).drop("text")


def op9_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.splice_comparison(table(configure(spark), sf_dir, "documents"))


def op10_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(configure(spark), "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_archives(spark, folder).drop("url", "payload")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    leaf = lambda n_chars: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(fold_of(F.col("doc_id"), 7) == 0, leaf(F.col("n_chars") + 1))
    return merkle.manifest(docs, leaf(F.col("n_chars")), tampered).drop("siblings")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(configure(spark), sf_dir, "documents"))
    counts = [pii.of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), scores.alias("scores"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_class_lm_scoring,
        op3_exact_dedup,
        op4_best_fit_packing,
        op5_secret_scans,
        op6_fuzzy_line_dedup,
        op7_sentencepiece_bpe,
        op8_language_id,
        op9_lz_fingerprints,
        op10_warc_writer,
        op11_lexical_search,
        op12_merkle_manifest,
        op13_pii,
    )
}

LEXICAL_SQL = r"""
    WITH own AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
    terms AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM own),
    lengths AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
    total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    tfs AS (SELECT r, term, count(*) AS tf FROM terms GROUP BY r, term),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    scored AS (
        SELECT item_id, r, CAST(sum(CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * documents) // total.terms))))) AS BIGINT) AS score
        FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN lengths USING (r), total GROUP BY item_id, r)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored JOIN own USING (r) WHERE score > 0 QUALIFY rank <= 20
"""

#: Leaves, levels of the runs and of the roots, then each row's way up; crc32 is written out bit by bit.
MERKLE_SQL = """
    WITH RECURSIVE field AS (
        SELECT doc_id, lang, n_chars,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(text) || ':' || text, '-') AS tail,
            list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
        FROM documents),
    leaves AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered,
            sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other
        FROM field),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    tree(lang, level, i, h, n) AS (
        SELECT lang, 0, place, leaf, n FROM placed
        UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
    subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    tops(level, i, h, n) AS (
        SELECT 0, i, h, n FROM subs
        UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
    low(lang, place, level, i, h, n, proof) AS (
        SELECT lang, place, 0, place, CASE WHEN tampered THEN other ELSE leaf END, n, '' FROM placed
        UNION ALL SELECT w.lang, place, w.level + 1, w.i // 2, sha256(CASE WHEN w.i % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || w.h END), (w.n + 1) // 2, proof || coalesce(s.h, '')
        FROM low w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
    high(lang, place, level, i, h, n, proof) AS (
        SELECT low.lang, place, 0, subs.i, low.h, subs.n, proof FROM low JOIN subs ON low.lang IS NOT DISTINCT FROM subs.lang WHERE low.n = 1
        UNION ALL SELECT w.lang, place, w.level + 1, w.i // 2, sha256(CASE WHEN w.i % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || w.h END), (w.n + 1) // 2, proof || coalesce(s.h, '')
        FROM high w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)
    SELECT p.doc_id, p.leaf, subs.h AS subroot, tops.h AS root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = tops.h AS verified
    FROM placed p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang JOIN high ON p.lang IS NOT DISTINCT FROM high.lang AND p.place = high.place AND high.n = 1 JOIN tops ON tops.n = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op11_lexical_search": LEXICAL_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
