"""The merge of observations against a plain version of its rules, in any order of arrival; and the log."""

import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from palimpsest.archive import OBSERVATIONS
from palimpsest.operators import merge, observations
from palimpsest.operators.merge import versions_of

EPOCH = "2024-01-01T00:00:"


def line(name, parent=None, at=None, text=None):
    return json.dumps({"type": "user", "uuid": name, "parentUuid": parent, "timestamp": None if at is None else f"{EPOCH}{at:02d}Z", "message": {"role": "user", "content": text or f"text of {name}"}}) + "\n"


def compact(text):
    """A line as another program would write it: equal by value."""
    return json.dumps(json.loads(text), separators=(",", ":")) + "\n"


def seen(device, seq, locator, content, kind="append", offset=0, legacy=False, segment=None, source="claude_code", scope=""):
    data = None if content is None else content.encode()
    sha = hashlib.sha256(data or b"").hexdigest()
    return (device, seq, source, scope, locator, kind, offset, len(data or b""), sha, None, f"/{device}/{locator}", "/p", legacy, segment or f"{device}-{seq}", data)


def frame(spark, rows):
    return spark.createDataFrame(rows, OBSERVATIONS)


def ids(archive):
    rows = archive.messages.join(archive.conversations.select(F.col("id").alias("conversation_id"), F.col("source_native_id").alias("locator")), "conversation_id").orderBy("locator", "sequence_index").collect()
    return {k: [r["source_native_id"] for r in g] for k, g in itertools.groupby(rows, lambda r: r["locator"])}


A, B, C, D, X, Y = (line(n, at=k) for k, n in enumerate("abcdxy"))


def test_scenarios(spark):
    rows = [
        seen("d1", 1, "appends", A + B), seen("d2", 1, "appends", B + C, offset=len(A)), seen("d2", 2, "appends", A),
        seen("d2", 3, "late", C, offset=len(A + B)), seen("d1", 2, "late", A + B),
        seen("d1", 3, "stale", A + B + C), seen("d2", 4, "stale", A, "snapshot"),
        seen("d1", 4, "forked", A + B + C), seen("d2", 5, "forked", A + B + X + Y, "snapshot"),
        seen("d1", 5, "repeated", A + A + A),
        seen("d1", 6, "deleted", A), seen("d2", 6, "deleted", None, "tombstone"),
        seen("d1", 7, "gap", B, offset=len(A)),
        seen("d1", 8, "imported", A + B), seen("d2", 7, "imported", compact(A) + B + C, "snapshot", legacy=True), seen("d3", 7, "imported", compact(A) + B + C, "snapshot", legacy=True),
        seen("d1", 9, "unknown", A, source="other"),
        seen("d1", 10, "scoped", A), seen("d1", 11, "scoped", B, scope="s"),
    ]
    wants = {"appends": list("abc"), "late": list("abc"), "stale": list("abc"), "forked": list("abcxy"), "repeated": list("aaa"), "imported": list("abc"), "scoped": ["a"], "s/scoped": ["b"]}
    r = random.Random(3)
    for turn in range(2):
        if turn:
            r.shuffle(rows)
            rows = rows + rows[:4]
        index, _ = observations.index_observations(frame(spark, []), frame(spark, rows))
        found = merge.project(index, "d2")
        assert ids(found.archive) == wants
        got = [(x["fork_after"], x["branch_message"], x["devices"]) for x in found.divergences.collect()]
        assert sorted(got) == [("b", "c", ["d1"]), ("b", "x", ["d2"])]
        outcomes = {(x["source_id"], x["scope"], x["locator"]): x["outcome"] for x in found.outcomes.collect()}
        assert outcomes["claude_code", "", "deleted"] == "removed" and outcomes["claude_code", "", "gap"] == "pending" and outcomes["other", "", "unknown"] == "unported"
        conversations = {x["source_native_id"]: x for x in found.archive.conversations.collect()}
        assert json.loads(conversations["imported"]["metadata"]) == {"event_count": 3}
        assert json.loads(conversations["repeated"]["metadata"]) == {"event_count": 3}
        assert conversations["appends"]["raw_path"] == "/d2/appends"
        raw = found.archive.raw_events.groupBy("source_native_conversation_id").count().collect()
        assert {x[0]: x[1] for x in raw} == {"appends": 3, "late": 3, "stale": 3, "forked": 5, "repeated": 3, "imported": 3, "scoped": 1, "s/scoped": 1}


def plain_merge(versions):
    """The merge by lists: versions are lists of (id, time), the first version first."""
    primary, seen_ids = versions[0], {}
    for k, (name, _) in enumerate(primary):
        seen_ids[name] = k
    present, blocks = set(seen_ids), []
    for v in versions[1:]:
        anchor, block = -1, None
        for name, at in v:
            if name in present:
                anchor, block = seen_ids.get(name, anchor), None
                continue
            present.add(name)
            if block is None:
                block = (anchor, [])
                blocks.append(block)
            block[1].append((name, at))
    if not blocks:
        return [n for n, _ in primary]
    fork = min([len(primary) - 1, *(a for a, _ in blocks)])
    parts = ([primary[fork + 1 :]] if primary[fork + 1 :] else []) + [b for _, b in blocks]
    parts.sort(key=lambda p: (p[0][1] is None, p[0][1] or 0, p[0][0]))
    return [n for n, _ in primary[: fork + 1]] + [n for p in parts for n, _ in p]


def test_random_versions_merge_like_lists(spark):
    r = random.Random(5)
    rows, wants, seq = [], {}, 0
    for k in range(40):
        pool = [(f"m{n}", r.choice([None, *range(50)])) for n in range(12)]
        trunk = pool[: r.randint(0, 4)]
        versions = []
        for _ in range(r.randint(1, 4)):
            rest = pool[4:]
            r.shuffle(rest)
            body = trunk + rest[: r.randint(0, 6)]
            if body and r.random() < 0.3:
                body.insert(r.randrange(len(body)), r.choice(body))
            versions.append(body)
        texts = ["".join(line(n, at=t) for n, t in v) for v in versions]
        kept = [(v, t, d) for d, (v, t) in enumerate(zip(versions, texts)) if t and not any(o.startswith(t) and (len(o) > len(t) or e < d) for e, o in enumerate(texts) if e != d)]
        for v, t, d in kept:
            seq += 1
            rows.append(seen(f"d{d}", seq, f"c{k:02d}", t))
        order = sorted(kept, key=lambda x: (-len(x[0]), -len(x[1].encode()), x[2]))
        if order:
            wants[f"c{k:02d}"] = plain_merge([v for v, _, _ in order])
    r.shuffle(rows)
    assert ids(merge.project(frame(spark, rows)).archive) == wants


def test_reconstruction_does_not_depend_on_order():
    r = random.Random(9)
    for _ in range(200):
        base, other = (bytes(r.choices(b"ab", k=12)) for _ in range(2))
        fragments = []
        for seq in range(r.randint(1, 7)):
            text = r.choice([base, base, other])
            start = r.randint(0, 8)
            fragments.append((start, text[start : start + r.randint(1, 8)], r.choice("xyz"), seq))
        if r.random() < 0.7:
            fragments.append((0, base[:6], "x", 99))
        want = versions_of(fragments)
        named = lambda found, own: sorted((c, sorted(own[k][2:] for k in by)) for c, by in found)
        for _ in range(4):
            own = fragments[:]
            r.shuffle(own)
            assert named(versions_of(own), own) == named(want, fragments)
        for content, by in want:
            assert all(content[fragments[k][0] :].startswith(fragments[k][1]) for k in by)


def test_snapshots_of_other_sources_supersede(spark):
    doc = lambda *names: json.dumps({"session": {"id": "s", "title": "T"}, "messages": [{"id": n, "data": {"role": "user"}} for n in names], "parts": [{"id": n + "p", "message_id": n, "data": {"type": "text", "text": n}} for n in names]})
    rows = [seen("d1", 1, "s", doc("a", "b"), "snapshot", source="opencode"), seen("d1", 2, "s", doc("a"), "snapshot", source="opencode")]
    found = merge.project(frame(spark, rows))
    assert ids(found.archive) == {"s": ["a"]}
    assert found.divergences.count() == 0


def test_contested_keys_equal_versions_of_bytes(spark):
    r = random.Random(4)
    rows, wants = [], {}
    for k in range(60):
        texts = ["".join(r.choices("ab", k=14)) for _ in range(2)]
        own = []
        for seq in range(r.randint(1, 8)):
            text, start = r.choice([texts[0], texts[0], texts[1]]), r.choice([0, 0, *range(9)])
            own.append((start, text[start : start + r.randint(0, 9)], r.choice("xyz"), seq))
        rows += [seen(d, s, f"c{k}", t, offset=o) for o, t, d, s in own]
        found = versions_of([(o, t.encode(), d, s) for o, t, d, s in own])
        wants |= {(f"c{k}", n): (content, sorted(own[i][2:] for i in by)) for n, (content, by) in enumerate(found)}
    fragments = frame(spark, rows).select(*merge.KEY, "byte_offset", "content", "device_id", "device_seq", "path", "project_hint").repartition(5)
    got = merge.contested_versions(fragments).collect()
    assert {(x["locator"], x["version"]): (bytes(x["content"]), sorted((c["device"], c["seq"]) for c in x["contributors"])) for x in got} == wants
