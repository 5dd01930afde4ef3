"""The Merkle manifest against a plain tree over all rows, and the sharing of persistent versions."""

import hashlib
import random
import zlib

import pytest
from palimpsest.llm import merkle
from palimpsest.llm import queries as Q
from palimpsest.llm.common import fold_of
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, run string, place long, siblings int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = (row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"])
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, place, node):
    beside = []
    for level in levels[:-1]:
        other = level[place ^ 1] if place ^ 1 < len(level) else ""
        node = sha(other, node) if place & 1 else sha(node, other)
        beside.append(other)
        place //= 2
    return beside, node


def expected(rows):
    runs = {}
    for r in rows:
        runs.setdefault(r["lang"], []).append(r)
    names = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        runs[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {name: levels_of([leaf_of(r) for r in runs[name]]) for name in names}
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(runs[name]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            low, node = climb(trees[name], i, leaf_of(r, int(tampered)))
            high, node = climb(top, k, node)
            out.append((r["doc_id"], leaf_of(r), trees[name][-1][0], top[-1][0], sha(*low, *high), node, node == top[-1][0]))
    return sorted(out, key=repr)


def made(docs, height):
    leaf = lambda n: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when(fold_of(F.col("doc_id"), 7) == 0, leaf(F.col("n_chars") + 1))
    return merkle.manifest(docs, leaf(F.col("n_chars")), tampered, height=height)


def rows_of(found):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_plain_trees(spark, height):
    rnd = random.Random(height)
    langs = [None, "", "en", "en", "en", "ß", "Z"]
    rows = [(rnd.choice([i, i, 7, None]), rnd.choice([None, "", "web"]), rnd.choice(langs), rnd.choice([None, i]), rnd.choice([None, "", "é" * i]), "r", 1, 2) for i in range(150)]
    rows += [(500 + i, "one", f"lang{i}", 1, "alone", "r", 1, 2) for i in range(9)] + [(7, "web", "en", 5, "copy", "r", 1, 2)] * 70
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(made(docs, height)) == expected([r.asDict() for r in docs.collect()])


def test_small_tables(spark):
    docs = spark.createDataFrame([(9, "s", None, None, "x", "r", 1, 2)], SCHEMA)
    (one,) = made(docs, 4).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["siblings"] == []
    assert made(docs.limit(0), 4).count() == 0


def test_versions_share_all_but_their_path():
    leaves = [sha(str(i)) for i in range(11)]
    tree = merkle.Block(leaves, 4)
    before = list(tree.nodes)
    for place in range(11):
        size = len(tree.nodes)
        root = tree.version(place, sha("other"))
        assert len(tree.nodes) == size + 5  # the leaf and four nodes above it
        other = [*leaves]
        other[place] = sha("other")
        assert tree.nodes[root][0] == merkle.Block(other, 4).nodes[-1][0]
        assert merkle.folded(leaves[place], place, tree.siblings(place)) == tree.nodes[tree.root][0]
    assert tree.nodes[: len(before)] == before


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(Q.op12_merkle_manifest(spark, sf_dir)) == expected(docs)
