"""The observation log: numbers without a gap, commits, replicas, and the replay of what a device logged."""

import hashlib
import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest import files
from palimpsest.operators import changes, observations

NEW = "source_id string, scope string, locator string, kind string, byte_offset long, path string, project_hint string, content binary"


def rows(spark, names, content=b"x"):
    return spark.createDataFrame([("s", "", n, "append", 0, f"/{n}", None, content) for n in names], NEW)


def numbers(spark, folder, device):
    found = observations.read_observations(spark, folder, content=False).where(F.col("device_id") == device).select("device_seq", "locator", "segment").collect()
    return sorted(map(tuple, found))


def test_wide_contents_are_numbered_without_loss(spark, tmp_path):
    """Contents whose partitions are coalesced otherwise than those of their keys."""
    wide = spark.range(1500).select(
        F.lit("s").alias("source_id"), F.lit("").alias("scope"), F.format_string("k%05d", "id").alias("locator"), F.lit("append").alias("kind"), F.lit(0).cast("long").alias("byte_offset"),
        F.lit("/p").alias("path"), F.lit(None).cast("string").alias("project_hint"), F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 512), 470).cast("binary").alias("content"),
    )
    folder = str(tmp_path)
    segment = observations.append_observations(spark, folder, wide, "d")
    assert numbers(spark, folder, "d") == [(k + 1, f"k{k:05d}", segment) for k in range(1500)]
    log = observations.read_observations(spark, folder)
    assert log.where("length = 60160").count() == 1500
    assert observations.audit_observations(log, observations.commits(spark, folder)).count() == 0


def test_equal_keys_are_numbered_too(spark, tmp_path):
    observations.append_observations(spark, str(tmp_path), rows(spark, ["same"] * 500).repartition(6), "d")
    assert [n for n, _, _ in numbers(spark, str(tmp_path), "d")] == list(range(1, 501))


def test_collectors_of_one_device_share_its_numbers(spark, tmp_path):
    folder, made = str(tmp_path), []
    write = lambda k: made.append(observations.append_observations(spark, folder, rows(spark, [f"{k}-{i}" for i in range(10 + k)]), "d/é"))
    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = numbers(spark, folder, "d/é")
    assert [n for n, _, _ in found] == list(range(1, 47)) and len(set(made)) == 4
    assert {s: len({n - k for k, n in enumerate(sorted(n for n, _, x in found if x == s))}) for s in made} == dict.fromkeys(made, 1)  # each segment's run has no hole


def test_one_of_many_makes_a_file_and_all_see_it_whole(spark, tmp_path):
    text, won, seen = "x" * 100_000, [], []

    def writer(k):
        for n in range(20):
            if files.create(spark, f"{tmp_path}/made/{n:02d}", f"{k}{text}"):
                won.append((n, k))
            seen.append((n, files.read(spark, f"{tmp_path}/made/{n:02d}")))

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 20 and len(seen) == 120
    assert {(n, f"{k}{text}") for n, k in won} == set(seen)
    assert files.names(spark, f"{tmp_path}/made") == [f"{n:02d}" for n in range(20)]
    assert len(list((tmp_path / "made").iterdir())) == 20  # nothing hidden is left


def test_a_failed_write_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    first = observations.append_observations(spark, folder, rows(spark, ["a", "b"]), "d")
    with monkeypatch.context() as m:
        m.setattr(observations, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            observations.append_observations(spark, folder, rows(spark, ["c", "half"]), "d", segment="again")
    assert [x[1] for x in numbers(spark, folder, "d")] == ["a", "b"]
    for _ in range(2):  # the second one changes nothing
        assert observations.append_observations(spark, folder, rows(spark, ["c"]), "d", segment="again") == "again"
    assert numbers(spark, folder, "d") == [(1, "a", first), (2, "b", first), (3, "c", "again")]
    assert observations.append_observations(spark, folder, rows(spark, []), "d") is None
    with pytest.raises(ValueError, match="name"):
        observations.append_observations(spark, folder, rows(spark, ["c"]), "d", segment="../x")


def test_cuts_and_segments_are_read_alone(spark, tmp_path):
    folder = str(tmp_path)
    names = [f"k{i}" for i in range(60)]
    segments = [observations.append_observations(spark, folder, rows(spark, names), d) for d in ("d", "e")]
    own = observations.read_observations(spark, folder, segments=segments[:1])
    assert {r["device_id"] for r in own.select("device_id").collect()} == {"d"} and own.count() == 60
    cut = rows(spark, ["k7"]).select(observations.cut_of()).first()[0]
    near = observations.read_observations(spark, folder, cuts=[cut])
    of_cut = {r["locator"] for r in rows(spark, names).where(observations.cut_of() == cut).collect()}
    assert {r["locator"] for r in near.collect()} == of_cut and len(of_cut) < 20


def test_replicas_take_each_others_segments(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for folder, device in ((one, "d1"), (two, "d2")):
        for k in range(2):
            observations.append_observations(spark, folder, rows(spark, [f"{device}-{k}-{i}" for i in range(3)]), device)
    for _ in range(2):
        observations.replicate(spark, one, two, "d1")
    both = sorted(map(tuple, observations.read_observations(spark, one).collect()), key=repr)
    assert both == sorted(map(tuple, observations.read_observations(spark, two).collect()), key=repr) and len(both) == 12
    assert observations.append_observations(spark, one, rows(spark, ["more"]), "d2") and numbers(spark, one, "d2")[-1][0] == 7
    assert observations.space_of(spark, one, "home") == "home" and observations.space_of(spark, one, "other") == "home"
    observations.space_of(spark, two, "work")
    with pytest.raises(ValueError, match="spaces"):
        observations.replicate(spark, one, two, "d1")


def test_segments_that_fail_the_audit_are_not_taken(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    segment = observations.append_observations(spark, two, rows(spark, ["a", "b"]), "d2")
    bad = observations.read_observations(spark, two).withColumn("content", F.lit(b"other")).withColumn("place", F.col("device_seq"))
    made = bad.select("place", *(c.split()[0] for c in observations.STORED.split(", ")), observations.cut_of().alias("cut"))
    observations._write(spark.createDataFrame(made.collect(), made.schema), two, segment)
    with pytest.raises(ValueError, match=f"{segment} cannot be taken: content"):
        observations.replicate(spark, one, two, "d1")
    assert observations.read_observations(spark, one).count() == 0


def test_the_audit_holds_segments_to_their_commits(spark, tmp_path):
    folder = str(tmp_path)
    segment = observations.append_observations(spark, folder, rows(spark, ["a", "b", "c"]), "d")
    log, commits = observations.read_observations(spark, folder), observations.commits(spark, folder)
    problems = lambda log, commits: sorted(r["problem"] for r in observations.audit_observations(log, commits).collect())
    assert problems(log, commits) == []
    assert problems(log.where("locator != 'a'"), commits) == ["begins at another number", "not as many as committed"]
    assert problems(log.where("locator != 'b'"), commits) == ["not as many as committed"]
    assert problems(log, commits.where(F.col("segment") != segment)) == ["begins at another number", "not as many as committed"]
    assert problems(log.withColumn("content", F.lit(b"y")), commits) == ["content and hash differ"] * 3


def replayed(log):
    content = b""
    for _, kind, offset, data in sorted(log):
        if kind == "snapshot":
            content = data
        elif offset <= len(content):
            content = content[:offset] + data
    return len(content), hashlib.sha256(content).hexdigest()


def test_collector_state_equals_a_replay_of_random_logs(spark):
    rnd = random.Random(5)
    logs = defaultdict(list)
    for k in range(300):
        for seq in rnd.sample(range(1, 1000), rnd.randrange(1, 12)):
            kind = rnd.choice(["append"] * 5 + ["snapshot"])
            logs[f"k{k}"].append((seq, kind, rnd.choice([0, 3, 5, 8, 40, 5000]) if kind == "append" else rnd.choice([0, 7]), rnd.randbytes(rnd.choice([0, 1, 3, 5, 30]))))
    made = [("d", "s", "", k, *x[:3], len(x[3]), x[3], False) for k, own in logs.items() for x in own]
    made += [("other", "s", "", "k1", 5000, "snapshot", 0, 3, b"abc", False), ("d", "s", "", "k2", 5001, "snapshot", 0, 3, b"abc", True), ("d", "s", "", "k3", 5002, "tombstone", 0, 0, None, False)]
    schema = "device_id string, source_id string, scope string, locator string, device_seq long, kind string, byte_offset long, length long, content binary, legacy boolean"
    found = observations.collector_state(spark.createDataFrame(made, schema).repartition(5), "d").collect()
    assert {r["locator"]: (r["length"], r["sha256"]) for r in found} == {k: replayed(own) for k, own in logs.items()}


def test_long_lines_take_linear_time(spark):
    long = b'{"a":"' + b"x" * 3_000_000
    made = spark.createDataFrame([(b"[]\n" + long,), (long + b'"}',), (long + b'"}\n',)], "content binary")
    assert [len(r[0]) for r in made.select(changes.complete_lines(F.col("content"))).collect()] == [3, 3_000_008, 3_000_009]
