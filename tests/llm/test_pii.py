"""Personal data against the plain patterns, and the further proposals by hand."""

import hashlib
import random
import re

import pytest
from palimpsest.llm import pii
from palimpsest.llm import queries as Q

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["1", "2", "25", "255", "4.", "a", "@", "b.c", ".", "+", "(", ")", "-", " ", "é", "\U0001f600", "411111111111", "1111", "x_y@z.w", "\n", "DE89"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def keeps(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if keeps(k, m.group()))


def places(spans):
    return [(s["start"], s["ord"], s["end"]) for s in spans]


def named(spans, text):
    return [(pii.KINDS[s["ord"]], text[s["start"] : s["end"]]) for s in spans]


def test_base_spans_equal_the_plain_patterns(spark):
    rnd = random.Random(13)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(70))) for _ in range(3000)]
    texts += [None, "", "x@a.b@c.d@e.f", "é@a.b@c.d", "1.2.3.4.5.6.7.8 0255.1.1.0001 256.1.1.1", "1 " * 5000 + "a@b.c"]
    found = {r["i"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4), id_col="i").withColumnRenamed("doc_id", "i").collect()}
    for i, text in enumerate(texts):
        assert places(found[i]["base"]) == plain(text), text
        assert set(places(found[i]["base"])) <= set(places(found[i]["spans"]))
        starts = [s["start"] for s in found[i]["spans"]]
        assert starts == sorted(starts)


def test_very_long_texts_take_linear_time(spark):
    texts = ["a" * 400_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" + "b." * 100_000, "+" * 100_000, "AB12 " * 50_000, "a:" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted((r["doc_id"], len(r["base"])) for r in pii.find(rows).collect()) == [(0, 0), (1, 0), (2, 25_000), (3, 0), (4, 1), (5, 0), (6, 0), (7, 0)]


def test_checksums_and_words_nearby_decide_on_further_spans(spark):
    cases = {
        "7536784127813050 4845168114407329 paid": [("card", "4845168114407329")],  # the run of 32 digits is no base card
        "7536784127813050 4845168114407329 order": [],
        "iban DE89370400440532013000 and GB82 WEST 1234 5698 7654 32.": [("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32")],
        "DE88370400440532013000": [],  # mod 97 fails
        "call (030) 1234 5678 now": [("phone", "(030) 1234 5678")],
        "room (030) 1234 5678 now": [],
        "ssn 078-05-1120": [("tax", "078-05-1120")],
        "part 078-05-1120": [],
        "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334": [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")],
        "phone +49 30 1234567 89": [("phone", "+49 30 1234567 89")],  # a base span, reported once
    }
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame([(t, t) for t in cases], "doc_id string, text string")).collect()}
    for text, want in cases.items():
        assert named(found[text], text) == want, text


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, base string, spans int, row string"
    rows = spark.createDataFrame([(1, "a@b.c", "x", 1, "r"), (1, "a@b.c", "x", 1, "r"), (None, None, None, None, None), (2, "plain", "y", 2, "s")], schema)
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in pii.find(rows).collect()) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    kept = pii.redact(rows)
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.where("doc_id is not null").collect())) == [(1, "[PERSONAL]", "x", 1, "r")] * 2 + [(2, "plain", "y", 2, "s")]
    assert kept.where("doc_id is null").first()["text"] is None
    assert pii.find(rows.limit(0)).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = Q.op13_pii(spark, sf_dir)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    rows = got.collect()
    assert len(rows) == len(texts)
    kinds = list(PLAIN)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
