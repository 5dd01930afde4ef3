"""The WARC writer and reader: round trips, revisits, rolled files and determinism."""

import base64
import collections
import gzip
import hashlib
import random

import pytest

from palimpsest import scratch
from palimpsest.llm import queries as Q
from palimpsest.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, refers_to string, part string"


def pages(spark, rows):
    return spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA)


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= min_bytes:
            first[h or ""] = min(p, first.get(h or "", p))
    out = collections.Counter()
    for p, _, h in rows:
        size = len((h or "").encode())
        refers = first.get(h or "") if size >= min_bytes else None
        refers = None if refers == p else refers
        out[p, size, sha(h), "response" if refers is None else "revisit", refers] += 1
    return out


def made(r, n=120):
    bodies = ["", "<p>same</p>", "é🙂" * 400, None, "WARC/1.1\r\n\r\n\r\nx"]
    rows = [(k * 7 - 50, f"http://x.test/{k}?a=b c\r\nX: y", r.choice(bodies) if k % 2 else f"<html>{r.random()}</html>" * r.randint(1, 60)) for k in range(n)]
    return rows + [(-50, None, rows[1][2]), (-50, "http://twice", "<p>same</p>"), (None, "http://none", "lone"), (None, None, "<p>same</p>"), (10**13, "far", "z" * 400_000)]


@pytest.mark.parametrize("min_bytes", [0, 12])
def test_round_trip(spark, min_bytes):
    rows = made(random.Random(1))
    folder = scratch.new_path(spark, "warc")
    listed = warc.write_archives(pages(spark, rows), folder, min_bytes=min_bytes, roll_bytes=4000, range_rows=30).collect()
    assert len(listed) > 5 and sum(x["records"] for x in listed) == len(rows)
    back = warc.read_archives(spark, folder, payloads=True).collect()
    assert collections.Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in back) == expected(rows, min_bytes)
    payloads = {(p, sha(h)): (h or "").encode() for p, _, h in rows}
    assert all(bytes(x["payload"]) == payloads[x["page_id"], x["payload_digest"]] for x in back if x["record_type"] == "response")
    local = folder.removeprefix("file://")
    for x in listed:
        data = open(f"{local}/data/{x['file']}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (x["bytes"], x["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_the_same_files_from_other_partitions(spark):
    rows = made(random.Random(2))
    shas = []
    for n in (1, 7):
        r = random.Random(n)
        folder = scratch.new_path(spark, "warc")
        listed = warc.write_archives(pages(spark, r.sample(rows, len(rows))).repartition(n), folder, roll_bytes=4000, range_rows=30).collect()
        shas.append(sorted((x["file"], x["sha256"]) for x in listed))
    assert shas[0] == shas[1]


def test_files_outside_the_manifest_are_not_read(spark):
    folder = scratch.new_path(spark, "warc")
    warc.write_archives(pages(spark, [(1, "u", "x")]), folder)
    open(f"{folder.removeprefix('file://')}/data/pages-999999-00000.warc.gz", "wb").write(b"half a file")
    assert warc.read_archives(spark, folder).count() == 1


def test_an_empty_table(spark):
    folder = scratch.new_path(spark, "warc")
    assert warc.write_archives(pages(spark, []), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_a_damaged_record_is_an_error(spark):
    folder = scratch.new_path(spark, "warc")
    name = warc.write_archives(pages(spark, [(1, "u", "payload")]), folder).first()["file"]
    path = f"{folder.removeprefix('file://')}/data/{name}"
    data = gzip.decompress(open(path, "rb").read()).replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad")
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="not what its headers say|Content|length|payload|record"):
        warc.read_archives(spark, folder).collect()


def test_query(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = Q.op10_warc_writer(spark, sf)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got.collect()) == expected(rows)
