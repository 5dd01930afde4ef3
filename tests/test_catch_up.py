"""Written archives: versions that change as one; catch-up with the log, once, as a stream, late and again; rebuild."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest import archive as archives
from palimpsest.archive import read_archive, read_manifest, read_segments, vacuum
from palimpsest.operators import changes, merge, observations
from palimpsest.sources.normalize import NORMALIZERS
from palimpsest.streaming import catch_up, projections

from .test_merge import A, B, C, X, ids

NEW = "source_id string, scope string, locator string, kind string, byte_offset long, path string, project_hint string, content binary"
HANDLES = archives.HANDLES


def send(spark, log, device, *rows):
    """Logs (locator, text, offset, kind) as a segment."""
    made = [("claude_code", "", n, kind, at, f"/{device}/{n}", "/p", None if text is None else text.encode()) for n, text, at, kind in rows]
    return observations.append_observations(spark, log, spark.createDataFrame(made, NEW), device)


def whole(spark, folder):
    """All rows of the archive, without times of ingest."""
    a = read_archive(spark, folder)
    drop = {"conversations": ["ingested_at"], "raw_events": ["ingested_at"], "sources": ["first_seen", "last_ingested"]}
    return {name: sorted(map(repr, df.drop(*drop.get(name, [])).collect())) for name, df in a.tables().items()}


def outcomes(found):
    return {r["locator"]: r["outcome"] for r in found.collect()}


def transcripts(spark, **texts):
    rows = [("claude_code", "", n, f"/in/{n}", "/p", 1.0, t.encode()) for n, t in texts.items()]
    return NORMALIZERS["claude_code"](spark.createDataFrame(rows, HANDLES))


def actions(found):
    return sorted(r["action"] for r in found.collect())


def test_catch_up_once_and_as_a_stream(spark, tmp_path):
    log, once, followed = (str(tmp_path / x) for x in ("log", "once", "followed"))
    stream = lambda: catch_up.stream_catch_up(spark, log, followed, str(tmp_path / "checkpoint"), buckets=4).awaitTermination(300)
    step = lambda: outcomes(catch_up.catch_up(spark, log, once, buckets=4))
    send(spark, log, "d1", ("x", A + B, 0, "append"), ("y", A, 0, "append"), ("gone", A, 0, "append"), ("gap", B, len(A), "append"))
    assert step() == {"x": "stored", "y": "stored", "gone": "stored", "gap": "pending"}
    stream()
    assert ids(read_archive(spark, once)) == {"x": list("ab"), "y": ["a"], "gone": ["a"]}
    assert step() == {}  # nothing has arrived
    before = read_manifest(spark, once)
    send(spark, log, "d2", ("x", A + B + X, 0, "snapshot"), ("y", A, 0, "append"), ("gone", None, 0, "tombstone"))
    send(spark, log, "d1", ("x", C, len(A + B), "append"), ("gap", A, 0, "append"))
    assert step() == {"x": "stored", "y": "unchanged", "gone": "removed", "gap": "stored"}
    stream()
    assert ids(read_archive(spark, once)) == {"x": list("abcx"), "y": ["a"], "gap": list("ab")}
    assert [r["devices"] for r in catch_up.divergences(spark, once).orderBy("branch_message").collect()] == [["d1"], ["d1", "d2"]]  # what d1 logged first is in both
    assert ids(read_archive(spark, once, before)) == {"x": list("ab"), "y": ["a"], "gone": ["a"]}  # a reader keeps its version
    # All segments again change nothing, and both ways end with the rows of a rebuild.
    names = [r["segment"] for r in read_segments(spark, once).collect()]
    assert len(names) == len(set(names)) == 3
    now = whole(spark, once)
    assert set(outcomes(catch_up.apply(spark, log, once, names)).values()) == {"unchanged", "removed"}
    assert whole(spark, once) == now == whole(spark, followed)
    catch_up.rebuild(spark, log, once, buckets=8)
    assert whole(spark, once) == now and read_manifest(spark, once).buckets == 8
    assert outcomes(catch_up.catch_up(spark, log, once)) == {}
    assert ids(merge.project(observations.read_observations(spark, log)).archive) == ids(read_archive(spark, once))
    assert vacuum(spark, once, keep=1) > 0 and whole(spark, once) == now


def test_upserts_write_only_what_changes(spark, tmp_path):
    folder = str(tmp_path)
    texts = {f"k{i}": A + B for i in range(20)}
    assert actions(changes.upsert_folder(spark, folder, transcripts(spark, **texts), buckets=16)) == ["inserted"] * 20
    first = read_manifest(spark, folder)
    assert actions(changes.upsert_folder(spark, folder, transcripts(spark, **texts))) == ["unchanged"] * 20
    assert read_manifest(spark, folder) == first  # no version for nothing
    times = {r["id"]: r["ingested_at"] for r in read_archive(spark, folder).raw_events.collect()}
    assert actions(changes.upsert_folder(spark, folder, transcripts(spark, k1=A + B + C, k2=A + B, new=A))) == ["appended", "inserted", "unchanged"]
    second = read_manifest(spark, folder)
    moved = {b for b, v in second.files["messages"].items() if first.files["messages"].get(b) != v}
    assert (second.number, len(moved)) == (2, len(moved & {str(r["bucket"]) for r in transcripts(spark, k1=A, new=A).conversations.select(archives.bucket_of("id", 16)).collect()}))
    assert ids(read_archive(spark, folder)) == texts.fromkeys(texts, list("ab")) | {"k1": list("abc"), "new": ["a"]}
    after = {r["id"]: r["ingested_at"] for r in read_archive(spark, folder).raw_events.collect()}
    assert {k: after[k] for k in times} == times and len(after) == len(times) + 2  # events that stay keep their time
    conversation = transcripts(spark, k1=A).conversations.select("id")
    assert actions(changes.upsert_folder(spark, folder, transcripts(spark, k2=A), gone=conversation)) == ["appended", "removed"]
    found = read_archive(spark, folder)
    assert ids(found) == texts.fromkeys([k for k in texts if k != "k1"], list("ab")) | {"k2": ["a"], "new": ["a"]}
    assert found.content_blocks.join(found.messages.select(F.col("id").alias("message_id")), "message_id", "left_anti").count() == 0
    assert found.raw_events.where("source_native_conversation_id = 'k1'").count() == 0


def test_a_write_that_dies_between_tables_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    changes.upsert_folder(spark, folder, transcripts(spark, a=A, b=A), buckets=2)
    now = whole(spark, folder)
    written = []

    def dies(spark, folder, version, tables, buckets):
        for name, df in tables.items():
            if len(written) == 3:
                raise OSError("disk is gone")
            written.append(name)
            df.write.partitionBy(*(["bucket"] if "bucket" in df.columns else [])).parquet(f"{folder}/writes/{version}/{name}")

    with monkeypatch.context() as m:
        m.setattr(changes, "write_version", dies)
        with pytest.raises(OSError, match="gone"):
            changes.upsert_folder(spark, folder, transcripts(spark, a=A + B, c=C))
    assert len(written) == 3 and whole(spark, folder) == now
    changes.upsert_folder(spark, folder, transcripts(spark, a=A + B, c=C))
    assert ids(read_archive(spark, folder)) == {"a": list("ab"), "b": ["a"], "c": ["c"]}


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    folder = str(tmp_path)
    changes.upsert_folder(spark, folder, transcripts(spark, base=A), buckets=1)  # all of them change the same bucket
    texts = [{f"k{n}": A + B, "base": A + B} for n in range(3)]
    threads = [threading.Thread(target=lambda t=t: changes.upsert_folder(spark, folder, transcripts(spark, **t))) for t in texts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(read_archive(spark, folder)) == dict.fromkeys(["base", "k0", "k1", "k2"], list("ab"))


def test_kept_events_end_at_a_gap(spark):
    stored, new = transcripts(spark, a=A + B + C, b=A + B), transcripts(spark, a=A + X + C, b=A + B + C, c=A)
    found = {r["conversation_id"]: (r["kept"], r["stored"]) for r in changes.kept_event_prefix(new, stored).collect()}
    of = {r["source_native_id"]: r["id"] for r in new.conversations.collect()}
    assert found == {of["a"]: (1, 3), of["b"]: (2, 2)}


def poisoned(monkeypatch, *names):
    """The parser fails on these conversations; how often it has been asked is counted."""
    plain, asked = merge.PARSERS["claude_code"], []

    def parse(handles):
        asked.append(1)
        bad = F.split("locator", merge.JOINT)[1].isin(*names)
        return plain(handles.withColumn("content", F.when(bad, F.raise_error(F.lit("poison")).cast("binary")).otherwise(F.col("content"))))

    monkeypatch.setitem(merge.PARSERS, "claude_code", parse)
    return asked


def test_a_conversation_that_fails_stops_no_other(spark, tmp_path, monkeypatch):
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    names = ["k0", "k1", "k2"]
    send(spark, log, "d1", *((n, A, 0, "append") for n in names))
    catch_up.catch_up(spark, log, folder, buckets=2)
    send(spark, log, "d1", *((n, B, len(A), "append") for n in names))
    with monkeypatch.context() as m:
        poisoned(m, "k1")
        found = catch_up.catch_up(spark, log, folder).collect()
        assert {r["locator"]: r["outcome"] for r in found} == {"k0": "stored", "k1": "failed", "k2": "stored"}
        assert all(("poison" in r["error"]) if r["outcome"] == "failed" else r["error"] is None for r in found)
        assert ids(read_archive(spark, folder)) == {"k0": list("ab"), "k1": ["a"], "k2": list("ab")}  # what was stored stays
    again = [r["segment"] for r in read_segments(spark, folder).collect()]
    assert outcomes(catch_up.apply(spark, log, folder, again)) == {"k0": "unchanged", "k1": "stored", "k2": "unchanged"}


def test_a_rebuild_leaves_out_what_fails(spark, tmp_path, monkeypatch):
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    send(spark, log, "d1", ("k0", A + B, 0, "append"), ("k1", A, 0, "append"))
    with monkeypatch.context() as m:
        poisoned(m, "k1")
        rebuilt = catch_up.rebuild(spark, log, folder, "d1", buckets=2)
    assert outcomes(rebuilt.outcomes) == {"k0": "stored", "k1": "failed"}
    assert ids(read_archive(spark, folder)) == {"k0": list("ab")}
    assert {r["locator"]: r["length"] for r in rebuilt.states.collect()} == {"k0": len(A + B), "k1": len(A)}
    assert outcomes(catch_up.catch_up(spark, log, folder)) == {}  # its segment went in


def test_a_rebuild_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    names = ["k0", "k3"]
    send(spark, log, "d1", *((n, A, 0, "append") for n in names))
    rebuild = lambda: catch_up.rebuild(spark, log, folder, buckets=2, at_once=1, most_failed=0, part_bytes=1)
    with monkeypatch.context() as m:
        poisoned(m, "k3")
        with pytest.raises(projections.TooManyFailures, match="poison"):
            rebuild()
    assert read_manifest(spark, folder) is None
    (begun,) = (tmp_path / "archive" / "rebuilds").iterdir()
    done = {x.name for x in (begun / "done").glob("[!.]*.json")} if (begun / "done").exists() else set()
    parts = len(json.loads((begun / "begun.json").read_text())["parts"])
    assert len(done) < parts
    send(spark, log, "d1", ("late", A, 0, "append"))
    asked = poisoned(monkeypatch)
    rebuild()
    assert len(asked) == parts - len(done)  # only what was not done yet
    assert ids(read_archive(spark, folder)) == dict.fromkeys(names, ["a"])
    assert not any((tmp_path / "archive" / "rebuilds").iterdir())
    assert outcomes(catch_up.catch_up(spark, log, folder)) == {"late": "stored"}


def test_a_rebuild_that_died_after_its_commit_is_not_resumed(spark, tmp_path, monkeypatch):
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    catch_up.rebuild(spark, log, folder)  # of nothing
    assert ids(read_archive(spark, folder)) == {}
    send(spark, log, "d1", ("x", A, 0, "append"))
    with monkeypatch.context() as m:
        m.setattr(catch_up.files, "delete", lambda *_: None)
        catch_up.rebuild(spark, log, folder)
    send(spark, log, "d1", ("y", B, 0, "append"))
    catch_up.rebuild(spark, log, folder)
    assert ids(read_archive(spark, folder)) == {"x": ["a"], "y": ["b"]}


def test_a_source_that_fails_stops_no_other(spark):
    def broken():
        raise FileNotFoundError("no such folder\nreally")

    good = lambda n: lambda: spark.createDataFrame([("s", "", n, "/p", None, 1.0, b"")], HANDLES)
    found, failed = catch_up.collect_installed({"one": good("a"), "bad": broken, "two": good("b")})
    assert sorted(r["locator"] for r in found.collect()) == ["a", "b"]
    assert failed == {"bad": "FileNotFoundError: no such folder"}
