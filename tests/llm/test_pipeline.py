"""The pipeline: each stage against brute force on its own input, and the whole."""

import collections
import itertools
import re
import zlib

import corpus_pipeline
from palimpsest import scratch
from palimpsest.llm import secrets
from palimpsest.llm.simhash_dedup import shingle_hashes
from tests.llm.test_text import check_packing


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 %%"), (None, "no id has this text here")]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "x", 0) for d, t in odd], docs.schema))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(x) for x in docs.select("doc_id", "text").collect()]
        docs = scratch.save(stage(spark, docs, sf), "test-stage")
        if k < 4:
            assert docs.columns == columns, name
            after = collections.Counter(tuple(x) for x in docs.select("doc_id", "text").collect())
        if k == 0:
            assert after == collections.Counter(x for x in before if x[1] and any(map(str.isalpha, x[1])))
        elif k == 1:
            keep = {}
            for d, t in before:
                if d is not None:
                    keep[lower(t)] = min(d, keep.get(lower(t), d))
            assert after == collections.Counter((d, t) for d, t in before if d is None or keep[lower(t)] == d)
        elif k == 2:
            gone = {d for d, _ in before} - {d for d, _ in after}
            sets = {d: set(shingle_hashes(t.encode(), 5)) for d, t in before if d is not None}
            alike = collections.defaultdict(set)
            for a, b in itertools.combinations(sorted(sets), 2):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    alike[a].add(b)
                    alike[b].add(a)
            assert gone <= set(alike)  # clean documents stay
            assert not [(d, alike[d]) for d in gone if all(x in gone for x in closure(alike, d))]  # one of each group stays
            left = [d for d in sets if d not in gone and any(x not in gone for x in alike[d])]
            assert len(left) <= 0.1 * len(alike)
        elif k == 3:
            assert [d for d, _ in sorted(before, key=str)] == [d for d, _ in sorted(after, key=str)] or len(before) == sum(after.values())
            changed = [(t, u) for (d, t) in before for (e, u) in after if d == e and t != u]
            assert all("[SECRET]" in u for _, u in changed)
            assert not any(re.search(secrets.HEX, u) for _, u in after)
        else:
            n, least = check_packing(before, docs.collect(), 4096)
            assert n <= least + 1


def test_language_without_labels(spark, sf):
    rows = [(0, "clean text"), (1, "Été"), (2, None), (3, ""), (4, "123 %%"), (None, "no id")]
    for lang in (None, "en"):  # no label at all, and labels in the held-out fold alone
        own = [(d, t, lang if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else None) for d, t in rows]
        frame = spark.createDataFrame(own, "doc_id long, text string, lang string")
        assert {x["text"] for x in corpus_pipeline.language(spark, frame, sf).collect()} == {"clean text", "Été", "no id"}


def closure(alike, start):
    seen, todo = {start}, [start]
    while todo:
        for x in alike[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert got.count() > 0
