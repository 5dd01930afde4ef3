"""Ranked lexical search against a plain ranking of all documents for each item."""

import math
import random
import re
from collections import Counter

from palimpsest.llm import lexical
from palimpsest.llm import queries as Q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id long, score string, term string"


def terms(text):
    return Counter(TERM.findall((text or "").translate(FOLD)))


def expected(docs, items, most=20):
    """docs and items as (id, text)."""
    counts = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 75 + (25 * c.total() * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in terms(text).items() if t in c)
            scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[-1], -s[0]) for rank, s in enumerate(sorted(x for x in scored if x[0])[:most], 1)]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in found.collect()), key=repr)


def test_terms_are_cut_and_folded_as_the_pattern_says(monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(lexical, "SLICE", 7)
    for _ in range(500):
        text = "".join(rnd.choice(["A", "z", "É", "ß", " ", "-", "9", "\x7f", "\x80", "\u0085", " ", "\U0001f600", "\n", "[", "_"]) for _ in range(rnd.randrange(60)))
        assert {k.decode(): v for k, v in lexical.term_counts(text.encode()).items()} == terms(text)


def test_search_equals_a_plain_ranking(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Été", "été", "the"]
    text = lambda most: " ".join(rnd.choices(words, weights=[1] * 42 + [30], k=rnd.randrange(most)))
    docs = [(i if i % 50 else None, text(30)) for i in range(400)] + [(1000 + i, "same words here w1") for i in range(150)] + [(3, None), (3, ""), (7, "w1 " * 50_000)]
    items = [(i, text(12)) for i in range(12)] + [(None, "w1 w2"), (50, None), (51, "--"), (52, "unknown"), (53, "same words w1 w1 W1"), (54, "the")]
    own = spark.createDataFrame([(*x, 5, "s", "t") for x in docs], DOCS).repartition(7)
    asked = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")
    want = expected(docs, items)
    assert rows_of(lexical.search(own, asked)) == want
    monkeypatch.setattr(lexical, "BLOCK", 900)  # three or four items a block
    assert rows_of(lexical.search(own, asked)) == want
    assert rows_of(lexical.search(own, asked, most=1)) == [x for x in want if x[1] == 1]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert rows_of(lexical.search(docs, items)) == expected([(1, "a")], [(1, "a")])


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert rows_of(Q.op11_lexical_search(spark, sf_dir)) == expected(read("documents", "doc_id"), read("benchmark", "item_id"))
