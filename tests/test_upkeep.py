"""Search, stems and change detection on small rows that the tables don't hold."""

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from palimpsest import files, scratch
from palimpsest.archive import HANDLES, SCHEMAS, Archive
from palimpsest.operators import changes, search, text_index
from palimpsest.operators.stemmer import stem
from palimpsest.plans.queries import QUERIES
from palimpsest.sources.transcripts import explode_jsonl, scan_changed, scan_transcripts


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("at", "at"), ("", "")],
)
def test_stems(word, want):
    assert stem(word) == want


@pytest.fixture
def archive(spark):
    rows = {
        "conversations": [("c", "s", "n", "Title", None, None, None, 3, None, None, "{}", None, None)],
        "messages": [(f"m{k}", "c", None, None, "user", None, None, k, "{}") for k in range(3)],
        "content_blocks": [("b0", "m0", 0, "text", "Running water", None, None, None), ("b1", "m1", 0, "text", "he runs; 100%_sure \\ x", None, None, None), ("b2", "m2", 0, "text", None, None, None, None)],
    }
    return Archive(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def test_stemmed_search_and_fresh_blocks(archive):
    index = search.build_text_index(archive.content_blocks.where("id != 'b1'"))
    found = search.search(archive, index, "run", limit=4).collect()
    assert [(r["block_id"], r["rank"]) for r in found] == [("b0", 1), ("b1", 2)]
    assert found[0]["score"] > 0 and found[1]["score"] == 1.0
    assert search.index_coverage(archive, index).first()[:2] == (2, 1)


def test_search_without_an_index_and_without_blocks(archive):
    assert [r["block_id"] for r in search.search(archive, None, "RUN").collect()] == ["b0", "b1"]
    assert [r["block_id"] for r in search.search_substring(archive, "\\ x").collect()] == ["b1"]
    empty = replace(archive, content_blocks=archive.content_blocks.limit(0))
    assert search.search(empty, search.build_text_index(empty.content_blocks), "run").collect() == []


@pytest.mark.parametrize(("text", "want"), [("a" * 300 + "Needle" + "b" * 300, "..." + "a" * 5 + "Needle" + "b" * 5 + "..."), ("short", "short"), ("c" * 20, "c" * 10 + "..."), ("", ""), (None, "")])
def test_snippet(spark, text, want):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(search.snippet(F.col("text"), "needle other", 5)).first()[0] == want


@pytest.mark.parametrize(("content", "want"), [(b'{"a":1}\n{"b"', b'{"a":1}\n'), (b'{"a":1}\n{"b":2}', b'{"a":1}\n{"b":2}'), (b'{"a":1}\n', b'{"a":1}\n'), (b'{"\xc3', b""), (b'{"\xc3\xa9":1}\n  ', b'{"\xc3\xa9":1}\n  '), (b"", b"")])
def test_complete_lines(spark, content, want):
    rows = spark.createDataFrame([(content,)], "content binary")
    assert bytes(rows.select(changes.complete_lines(F.col("content"))).first()[0]) == want


def test_collected_appends_hold_the_new_bytes(spark):
    handles = spark.createDataFrame([("s", "", "x", "/x", None, 2.0, b'{"a":1}\n{"b":2}\n'), ("s", "", "y", "/y", None, 1.0, b""), ("s", "", "z", "/z", None, 1.0, b"[]\n")], HANDLES)
    first = b'{"a":1}\n'
    states = spark.createDataFrame([("s", "", "x", len(first), hashlib.sha256(first).hexdigest(), 1.0), ("s", "", "z", 99, "other", 1.0)], "source_id string, scope string, locator string, length long, sha256 string, mtime double")
    got = {r["locator"]: (r["kind"], r["byte_offset"], bytes(r["content"])) for r in changes.collect_changes(handles, states).collect()}
    assert got == {"x": ("append", 8, b'{"b":2}\n'), "z": ("snapshot", 0, b"[]\n")}
    assert [r["locator"] for r in changes.collect_changes(handles, states, incremental=True).collect()] == ["x"]


def test_broken_utf8_is_replaced(spark):
    handles = spark.createDataFrame([("s", "", "x", "/x", None, 1.0, b'{"a":"\xff"}\n\n{"b":1}\n')], HANDLES)
    assert [(r["line"], r["raw"]) for r in explode_jsonl(handles).orderBy("line").collect()] == [(0, '{"a":"\ufffd"}'), (1, '{"b":1}')]


def test_a_written_index_ranks_as_a_new_one(spark, tmp_path):
    """Additions, repeats, deletions, a block that comes back, and merges."""
    r, folder = random.Random(1), str(tmp_path)
    texts = {f"b{i}": None if i % 17 == 0 else " ".join(r.choices(["run", "runs", "walk", "the", "é", "sat"], k=r.randrange(9))) for i in range(60)}
    frame = lambda names: spark.createDataFrame([(n, texts[n]) for n in names], "id string, text string")
    names, there = list(texts), set()
    text_index.create_index(spark, folder, stop_words=["the"])
    ranked = lambda index: {x["block_id"]: round(x["score"], 9) for x in search.match_bm25(index, "running é The").collect()}

    def holds():
        new = search.build_text_index(frame(sorted(there)), stop_words=["the"])
        own = text_index.open_index(spark, folder)
        assert own.size == (len(there), new.docs.agg(F.sum("len")).first()[0])
        assert ranked(own) == ranked(new) and {x["block_id"] for x in own.docs.collect()} == there

    for step in range(4):
        more = names[step * 12 : step * 12 + 15]
        text_index.add_blocks(spark, folder, frame(more))
        there |= set(more)
        if step == 1:
            text_index.delete_blocks(spark, folder, frame(names[5:9] + names[50:]))
            there -= set(names[5:9])
            holds()
    assert len(text_index.state_of(spark, folder).parts) < 4  # merged on the way
    before = text_index.state_of(spark, folder)
    text_index.add_blocks(spark, folder, frame(names[5:7]))
    there |= set(names[5:7])
    holds()
    assert text_index.add_blocks(spark, folder, frame(names[:9][:3])).number == text_index.state_of(spark, folder).number
    assert len(text_index.merge_parts(spark, folder, all_parts=True).parts) == 1
    holds()
    assert text_index.open_index(spark, folder, before).docs.count() == len(there) - 2  # a reader keeps its version


def test_rows_of_transcripts_are_not_broadcast(spark, sf):
    """Spark takes what comes of a variant for a fraction of its size; the driver's memory holds what is broadcast."""
    plan = QUERIES["kept_message_prefix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan


def test_files_of_a_known_time_are_not_opened(spark, tmp_path):
    (tmp_path / "-p [x] {y}").mkdir()
    for n in range(4):
        (tmp_path / "-p [x] {y}" / f"k{n}*.jsonl").write_text(f'{{"n":{n}}}\n')
    seen = scan_transcripts(spark, str(tmp_path), "claude_code")
    times = {r["locator"]: r["mtime"] for r in seen.collect()}
    states = lambda **own: spark.createDataFrame([("claude_code", "", f"{k}*", t) for k, t in own.items()], "source_id string, scope string, locator string, mtime double")
    own = scan_changed(spark, str(tmp_path), "claude_code", states(k0=times["k0*"], k1=1.0, k2=times["k2*"]))
    assert sorted((r["locator"], bytes(r["content"])) for r in own.collect()) == [("k1*", b'{"n":1}\n'), ("k3*", b'{"n":3}\n')]
    assert len(own.inputFiles()) == 2 and own.columns == seen.columns
    assert scan_changed(spark, str(tmp_path), "claude_code", states(**{k[:-1]: t for k, t in times.items()})).count() == 0


def test_intermediate_tables_can_be_deleted(spark):
    saved = scratch.save(spark.range(5), "numbers")
    (path,) = {f.rsplit("/", 1)[0] for f in saved.inputFiles()}
    assert saved.count() == 5 and files.exists(spark, path)
    scratch.drop(spark, scratch.write(spark.range(1), "gone"))  # one that is gone already is no error
    made = dict(scratch._made)
    scratch._made[spark.sparkContext.applicationId] = made[spark.sparkContext.applicationId][-2:]  # other tests' tables stay
    assert scratch.clear(spark) == 2 and not files.exists(spark, path)
