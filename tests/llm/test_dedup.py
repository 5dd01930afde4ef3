"""SimHash, exact, confirmed and line deduplication against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from palimpsest import scratch
from palimpsest.llm import bitslice, line_dedup
from palimpsest.llm.components import components
from palimpsest.llm.exact_dedup import exact_duplicates
from palimpsest.llm.queries import op1_simhash_near_dedup, op3_exact_dedup, op6_fuzzy_line_dedup
from palimpsest.llm.simhash_dedup import confirmed_duplicates, majority, near_duplicates, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, fp string, kept string, component_id string"


def docs(spark, rows):
    """Rows of (doc_id, text) with other columns whose names clash with those of results."""
    return spark.createDataFrame([(d, t, "en", "x", None, "y") for d, t in rows], SCHEMA)


def fp_of(text, words=3):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ÀB", "Cc"]
    base = [" ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 8, 40, 300]))) for _ in range(n)]
    out = [(i, t) for i, t in enumerate(base)] + [(n + i, t.upper().replace("É", "é")) for i, t in enumerate(base[:10])]
    out += [(2 * n + i, t + " tail") for i, t in enumerate(base)]
    return out + [(900, None), (901, ""), (902, " \t\n"), (903, "\x0b A\x0cb"), (903, "\x0b A\x0cb")]


def test_bit_sliced_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    for radius in (0, 1, 2, 3, 5, 8):
        fps = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 6, dtype=np.uint64)) for _ in range(40)] + [base])
        for _ in range(3):
            fps[:150] ^= np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)
        starts = np.array([0, 1, 70, 200])
        i, j = bitslice.near(fps, starts, radius, grid=50)
        ends = [*starts[1:], len(fps)]
        want = {(a, b) for s, e in zip(starts, ends) for a, b in itertools.combinations(range(s, e), 2) if bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want
        assert len(i) == len(want)
        label = bitslice.forest(len(fps), i, j)
        assert label.tolist() == [closure(range(len(fps)), want)[k] for k in range(len(fps))]


def test_majority_over_many_hashes():
    r = np.random.default_rng(3)
    sizes = [0, 1, 2, 254, 255, 256, 700, 0, 3]
    hashes = r.integers(0, 2**63, sum(sizes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = majority(hashes, np.array(sizes)), 0
    for k, n in enumerate(sizes):
        own = [int(h) for h in hashes[at : at + n]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        at += n


def test_components_of_a_path_and_a_star(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash_components(spark, monkeypatch, tile):
    monkeypatch.setattr(bitslice.links, "__defaults__", (None, tile))
    rows = corpus()
    got = near_duplicates(docs(spark, rows)).collect()
    fps = {d: fp_of(t) for d, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    root = closure(fps, edges)
    assert len(got) == len(rows)
    assert {(x["doc_id"], x["fp"] % 2**64, x["component_id"]) for x in got} == {(d, fps[d], root[d]) for d in fps}


def test_simhash_query(spark, sf):
    got = op1_simhash_near_dedup(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {d: fp_of(t) for d, t in texts.items()}
    root = closure(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert {(x["doc_id"], x["fingerprint"], x["component_id"]) for x in got.collect()} == {(d, f"{fps[d]:016x}", root[d]) for d in fps}


def test_confirmed_duplicates(spark):
    r = random.Random(7)
    words = [f"v{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(6):
        text = r.choices(words, k=200)
        for copy in range(5):
            own = list(text)
            if copy:
                own[r.randrange(200)] = f"changed{copy}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + k, " ".join(r.choices(words, k=150))) for k in range(30)] + [(500, None), (501, ""), (502, rows[0][1] + " ")]
    sets = {d: set(shingle_hashes((t or "").encode(), 5)) for d, t in rows}
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = confirmed_duplicates(docs(spark, rows)).collect()
    got = {x["doc_id"]: x["component_id"] for x in found}
    assert got == closure(sets, alike)
    assert {x["doc_id"] for x in found if x["kept"]} == set(got.values())
    twice = [(1, rows[0][1]), (1, "a text of its own that has one id with another one"), (2, rows[0][1] + " x"), (2, "lone")]
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in confirmed_duplicates(docs(spark, twice)).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True)]
    assert confirmed_duplicates(docs(spark, [])).count() == 0


def test_rows_of_near_duplicates_are_not_broadcast(spark, monkeypatch):
    """The size that Spark takes written or exploded rows for is far below theirs, and the driver's memory holds what is broadcast."""
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(200)]
    texts = [" ".join(r.choices(vocabulary, k=30)) for _ in range(40)]
    rows = docs(spark, [*enumerate(texts), *((40 + k, f"{t} more") for k, t in enumerate(texts))])
    plans, write = [], scratch.write
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(scratch, "write", lambda df, name: seen(df) or write(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # so that only what is taken for small is small here
    try:
        found = confirmed_duplicates(rows)
        seen(found)
        assert {x["component_id"] for x in found.collect()} == {*range(40)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    whole = [p for p in plans if "MapInArrow" in p or p is plans[-1]]  # the rounds of components() read links alone, here some hundred bytes
    assert len(whole) >= 4
    assert not [p for p in whole if "BroadcastExchange" in p]


def edited(r, words, vocabulary, kind, share):
    """words with an edit that leaves about `share` of their 5-word shingles, by Jaccard similarity."""
    n, own = len(words), list(words)
    if kind == "appended":
        return own + r.choices(vocabulary, k=int(n * (1 / share - 1)))
    lost = int(n * (1 - share) / (1 + share)) - (4 if kind == "replaced" else 0)
    if kind == "replaced":
        at = r.randrange(n - lost)
        own[at : at + lost] = r.choices(vocabulary, k=lost)
    else:
        for at in r.sample(range(n // 5), max(1, lost // 5)):
            own[5 * at + 2] = r.choice(vocabulary)
    return own


def test_confirmed_duplicates_with_larger_edits(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, pairs = [], collections.defaultdict(list)
    for kind in ("scattered", "appended", "replaced"):
        for share in (0.8, 0.85, 0.9):
            for _ in range(60):
                text = r.choices(vocabulary, k=r.randrange(100, 600))
                copy = edited(r, text, vocabulary, kind, share + r.random() * 0.05)
                a, b = (set(shingle_hashes(" ".join(t).encode(), 5)) for t in (text, copy))
                if len(a & b) >= 0.8 * len(a | b):
                    pairs[kind, share].append(len(rows))
                rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    got = {x["doc_id"]: x["component_id"] for x in confirmed_duplicates(docs(spark, rows)).collect()}
    found = {k: (sum(got[n + 1] == n for n in own), len(own)) for k, own in pairs.items()}
    print(found)
    assert all(n >= 30 and hit >= 0.97 * n for hit, n in found.values()), found
    assert all(got[d] in (d, d - d % 2) for d in got)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    rows = corpus()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    pick = {"min": min, "max": max}[keep]
    want = sorted((d, pick(groups[lower(t)]), len(groups[lower(t)]), d == pick(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows)
    assert sorted(tuple(x) for x in exact_duplicates(docs(spark, rows), keep).collect()) == want


def test_exact_corner_cases(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    assert [tuple(x)[:4] for x in exact_duplicates(docs(spark, [(None, "a"), (None, "A")])).collect()] == [(None, None, 2, True)] * 2
    long = "x" * 300_000
    assert {x["group_size"] for x in exact_duplicates(docs(spark, [(1, long), (2, long + "y")])).collect()} == {1}


def test_exact_query_against_sql(spark, sf):
    import duckdb

    from palimpsest.llm.queries import ORACLE_SQL

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE_SQL['op3_exact_dedup']})").fetchall()
    assert sorted(tuple(x) for x in op3_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == sorted(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choices("abcé", k=r.randint(0, 90))) for _ in range(2))
        if r.random() < 0.5:
            b = a[: r.randint(0, 20)] + "x" + a[r.randint(0, 20) :]
        assert line_dedup.edit_distance(a, b) == distance(a, b)


def test_quick_bound_agrees_with_the_distance():
    r = random.Random(6)
    for _ in range(600):
        a = " ".join("".join(r.choices("abé", k=r.randint(1, 6))) for _ in range(r.randint(1, 12)))
        words = a.split(" ")
        if r.random() < 0.5:
            words.insert(r.randrange(len(words)), "ab")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "".join(r.choices("abé", k=r.randint(1, 6)))
        b = " ".join(words[: len(words) - r.randint(0, 1)] or ["x"])
        assert line_dedup.similar(a, b, 0.8) == (1 - distance(a, b) / max(len(a), len(b)) >= 0.8)


def test_long_lines_with_a_word_more_need_no_distance(monkeypatch):
    def refused(*_):
        raise AssertionError("a distance was taken")

    monkeypatch.setattr(line_dedup, "edit_distance", refused)
    words = [f"w{k}" for k in range(600)]
    assert line_dedup.similar(" ".join(words), " ".join([*words[:40], "more", *words[40:300], *words[302:]]), 0.8)


def test_bounded_edit_distance():
    r = random.Random(7)
    for _ in range(600):
        a = "".join(r.choices("abcé ", k=r.randint(0, 120)))
        b = list(a)
        for _ in range(r.randint(0, 40)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
        b = "".join(b) if r.random() < 0.8 else "".join(r.choices("abcé ", k=r.randint(0, 120)))
        true = distance(a, b)
        for most in {0, 1, max(true - 1, 0), true, true + 1, len(a) // 5}:
            got = line_dedup.edit_distance(a, b, most)
            assert got == true if true <= most else got > most


def print_of(form, second):
    """A SimHash of runs of six bytes, bit by bit."""
    padded, hs = b" " * 5 + form + b" " * 5, []
    m1, m2, m3 = map(int, line_dedup.MIX)
    for k in range(len(form) + 5):
        h = int.from_bytes(padded[k : k + 6], "little") * m1 % 2**64
        h = (h ^ h >> 32) * m2 % 2**64
        h ^= h >> 29
        hs.append((h ^ m1) * m2 % 2**64 ^ h >> 31 if second else h * m3 % 2**64)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def key_of(text):
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + 2**63) % 2**64 - 2**63


def brute_lines(rows, similarity=0.8, blocks=5, radius=10, wide=18):
    found = {}
    for d, t in rows:
        if d is not None:
            for k, line in enumerate((t or "").split("\n")):
                if form := line_dedup.normal(line.encode()):
                    found[d, key_of(t), k] = form
    forms = sorted(set(found.values()))
    fps = {f: (print_of(f, False), print_of(f, True)) for f in forms}
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def meet(a, b):
        counts = [bin(x ^ y).count("1") for x, y in zip(fps[a], fps[b])]
        shared = [any((x ^ y) >> low & ((1 << (high - low)) - 1) == 0 for low, high in zip(edges, edges[1:])) for x, y in zip(fps[a], fps[b])]
        return sum(counts) <= wide and any(c <= radius and s for c, s in zip(counts, shared))

    alike = lambda a, b: 1 - distance(a.decode(), b.decode()) / max(len(a.decode()), len(b.decode())) >= similarity
    root = closure(forms, [(a, b) for a, b in itertools.combinations(forms, 2) if meet(a, b) and alike(a, b)])
    kept = {}
    for place, form in sorted(found.items()):
        kept.setdefault(root[form], place)
    stay = set(kept.values())
    out = []
    for d, t in rows:
        if d is not None:
            key = key_of(t)
            out.append((d, key, sum(p[:2] == (d, key) for p in found), sorted(p[2] for p in stay if p[:2] == (d, key))))
    return sorted(out)


def decided(frame):
    return sorted((x["doc_id"], x["text_key"], x["n_lines"], [*map(int, filter(None, x["kept_lines"].split(",")))]) for x in frame.collect())


def line_rows():
    r = random.Random(2)
    pool = [" ".join(r.choices([f"word{i}" for i in range(300)], k=r.choice([2, 6, 30, 60]))) for _ in range(25)]
    rows = []
    for d in range(30):
        lines = [r.choice(pool) for _ in range(6)]
        lines[0] = lines[0].upper() + "!!"
        parts = lines[1].split(" ")
        parts[-1] = parts[-1] + "x"
        lines[1] = " ".join(parts)
        rows.append((d, "\n".join([*lines, "", "***", f"number {d} of the lines counted here"])))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "a\r\nb\ta"), (104, "-----\n" + "-" * 60), (None, "no id"), (105, "é " * 3000 + "x"), (106, "é " * 2999 + "y")]
    return rows + [(1, "short"), (1, "a\nb\n" + pool[3]), (2, pool[3] + " x"), (1, "short"), (107, rows[5][1]), (7, rows[5][1])]


@pytest.mark.parametrize("part, tile", [(8 << 20, 1 << 15), (300, 4)])
def test_lines(spark, monkeypatch, part, tile):
    monkeypatch.setattr(line_dedup, "PART", part)
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rows = line_rows()
    want = brute_lines(rows)
    decisions = line_dedup.kept_lines(docs(spark, rows))
    assert decided(decisions) == want
    by_text = {(d, k): set(keep) for d, k, _, keep in want}
    texts = sorted(((x["doc_id"], x["text"]) for x in line_dedup.deduplicate(docs(spark, rows), decisions).collect()), key=str)
    left = []
    for d, t in rows:
        keep = by_text.get((d, key_of(t)))
        left.append((d, t if t is None or d is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" \t\n\r\x0b\x0c") or k in keep)))
    assert texts == sorted(left, key=str)
    assert line_dedup.kept_lines(docs(spark, [])).count() == 0


def test_links_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.range(1000).selectExpr("id a", "id + 1 b").mapInArrow(count, "a long, b long")
    assert {x["root"] for x in components(edges).collect()} == {0}
    assert seen.value == 1000


def test_lines_query(spark, sf):
    """All lines of the smallest table against brute force."""
    got = op6_fuzzy_line_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_kept", "kept_lines"]
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_lines(rows)
    assert sorted((x["doc_id"], x["n_lines"], x["n_kept"], x["kept_lines"]) for x in got.collect()) == sorted((d, n, len(keep), ",".join(map(str, keep))) for d, _, n, keep in want)
