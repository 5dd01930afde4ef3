"""Normalisers on small hand-made transcripts: edge cases of content, roles, titles and ids."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.archive import HANDLES
from palimpsest.functions import columns as C
from palimpsest.sources.normalize import NORMALIZERS, read_transcripts
from palimpsest.sources.transcripts import only_newer_layout, scan_export_array, scan_transcripts, session_documents_hermes, session_documents_v1, session_documents_v2

normalize_claude_code, normalize_codex_cli = NORMALIZERS["claude_code"], NORMALIZERS["codex_cli"]


def handle(spark, source, events, locator="s1", project=None):
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in events)
    return spark.createDataFrame([(source, "", locator, f"/x/{locator}.jsonl", project, None, bytearray(text.encode()))], HANDLES)


def blocks(archive):
    joined = archive.messages.join(archive.content_blocks.withColumnRenamed("id", "block_id").drop("id"), F.col("id") == F.col("message_id"))
    return [tuple(x) for x in joined.select("sequence_index", "block_index", "role", "type", "text", "tool_name").orderBy("sequence_index", "block_index").collect()]


def test_session_file(spark):
    at = "2026-01-02T03:04:05Z"
    events = [
        {"type": "summary", "summary": "  A title ", "leafUuid": "z"},
        {"type": "user", "uuid": "a", "timestamp": at, "cwd": "/work", "message": {"role": "user", "content": "hello\nthere"}},
        "not json",
        "[1]",
        {"type": "assistant", "uuid": "b", "parentUuid": "a", "timestamp": at, "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "c", "parentUuid": "b", "timestamp": at, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
        {"type": "user", "uuid": "d", "timestamp": at, "message": {"role": "user", "content": 5}},
    ]
    archive = normalize_claude_code(handle(spark, "claude_code", events))
    one = archive.conversations.first()
    assert (one["title"], one["project"], one["message_count"]) == ("A title", "/work", 3)
    assert blocks(archive) == [
        (0, 0, "user", "text", "hello\nthere", None),
        (1, 0, "assistant", "thinking", "hm", None),
        (1, 1, "assistant", "tool_use", None, "Bash"),
        (2, 0, "user", "tool_result", "x\ny", None),
    ]
    parents = {x["source_native_id"]: x["parent_message_id"] for x in archive.messages.collect()}
    ids = {x["source_native_id"]: x["id"] for x in archive.messages.collect()}
    assert parents == {"a": None, "b": ids["a"], "c": ids["b"]}


def test_title_falls_back_to_the_first_user_line(spark):
    events = [{"type": "user", "uuid": "a", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "user", "content": "  first line \nsecond"}}]
    assert normalize_claude_code(handle(spark, "claude_code", events)).conversations.first()["title"] == "first line "  # the text is stripped, then cut at its first line break


def test_rollout_file(spark):
    events = [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": "m1", "cwd": "/w"}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "do it"}},
        {"timestamp": "2026-01-01T00:00:02Z", "type": "turn_context", "payload": {"model": "m2"}},
        {"timestamp": "2026-01-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{}", "call_id": "k"}},
        {"timestamp": "2026-01-01T00:00:04Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "done"}},
        {"timestamp": "2026-01-01T00:00:09Z", "type": "event_msg", "payload": {"type": "task_complete"}},
    ]
    archive = normalize_codex_cli(handle(spark, "codex_cli", events))
    found = [(x["role"], x["model"], x["source_native_id"]) for x in archive.messages.orderBy("sequence_index").collect()]
    assert found == [("user", None, None), ("assistant", "m1", "k"), ("tool", None, "k")]
    assert archive.messages.select("id").distinct().count() == 3
    one = archive.conversations.first()
    assert (one["project"], (one["ended_at"] - one["started_at"]).total_seconds()) == ("/w", 9.0)


def test_no_handles(spark):
    archive = normalize_claude_code(spark.createDataFrame([], HANDLES))
    assert archive.conversations.count() == archive.messages.count() == archive.content_blocks.count() == 0


def test_times(spark):
    texts = ["2026-01-02T03:04:05Z", "2026-01-02 03:04:05", "2026-01-02T03:04:05+02:00", "2026", "10:00", "", None, "x"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", C.iso_time(F.col("t")).cast("string").alias("at")).orderBy("k").collect()
    assert [x["at"] for x in rows] == ["2026-01-02 03:04:05", "2026-01-02 03:04:05", "2026-01-02 01:04:05", None, None, None, None, None]


def payloads(archive):
    joined = archive.messages.select(F.col("id").alias("message_id"), "sequence_index").join(archive.content_blocks, "message_id")
    return [(*x[:2], x["type"], x["text"], x["tool_name"], x["tool_use_id"], None if x["payload"] is None else json.loads(x["payload"])) for x in joined.select("sequence_index", "block_index", "type", "text", "tool_name", "tool_use_id", "payload").orderBy("sequence_index", "block_index").collect()]


def test_session_file_keeps_all_kinds(spark):
    content = [{"type": "tool_use", "id": "t", "name": "n"}, {"type": "tool_use", "id": "u", "name": "n", "input": None}, {"type": "tool_result", "tool_use_id": "t", "content": "out", "is_error": True}, {"type": "tool_result", "tool_use_id": "v"}, {"type": "image", "source": {"k": 1}}, {"type": "new", "x": 2}, 7]
    got = payloads(normalize_claude_code(handle(spark, "claude_code", [{"type": "assistant", "uuid": "a", "message": {"content": content}}])))
    assert got == [
        (0, 0, "tool_use", None, "n", "t", {"input": {}}),
        (0, 1, "tool_use", None, "n", "u", {"input": None}),
        (0, 2, "tool_result", "out", None, "t", {"is_error": True, "raw_content": "out"}),
        (0, 3, "tool_result", None, None, "v", {"is_error": False, "raw_content": None}),
        (0, 4, "image", None, None, None, {"source": {"k": 1}}),
        (0, 5, "text", None, None, None, {"unknown_block": {"type": "new", "x": 2}}),
    ]


def test_rollout_keeps_all_kinds(spark):
    item = lambda **p: {"timestamp": 1700000000.5, "type": "response_item", "payload": p}
    events = [
        {"type": "session_meta", "payload": {"cwd": "/w"}},
        {"type": "turn_context", "payload": {"model": "m"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}},
        item(type="message", role="developer", content=[{"type": "x", "text": "no"}]),
        item(type="reasoning", summary=[{"text": "why"}, {"text": ""}], encrypted_content="e"),
        item(type="function_call", name="f", call_id="c", arguments="{}"),
        item(type="function_call_output", call_id="c", output={"text": "out"}),
        item(type="custom_tool_call", name="g", call_id="d", input="in"),
        item(type="custom_tool_call_output", call_id="d", output=[{"text": "a"}, {"text": "b"}]),
        item(type="web_search_call", id="w", status="completed", action={"query": "q"}),
    ]
    archive = normalize_codex_cli(handle(spark, "codex_cli", events))
    assert payloads(archive) == [
        (0, 0, "text", "hi", None, None, None),
        (1, 0, "thinking", "why", None, None, {"has_encrypted_content": True}),
        (2, 0, "tool_use", None, "f", "c", {"arguments": "{}"}),
        (3, 0, "tool_result", "out", None, "c", None),
        (4, 0, "tool_use", None, "g", "d", {"input": "in"}),
        (5, 0, "tool_result", "a\nb", None, "d", None),
        (6, 0, "tool_use", None, "web_search", "w", {"status": "completed", "query": "q"}),
    ]
    assert [(x["role"], x["model"]) for x in archive.messages.orderBy("sequence_index").collect()] == [("user", None), ("assistant", "m"), ("assistant", "m"), ("tool", None), ("assistant", "m"), ("tool", None), ("assistant", "m")]
    assert archive.conversations.first()["started_at"].microsecond == 500000


def test_titled_session_keeps_all_kinds(spark):
    message = lambda id_, role, content, **more: {"type": "message", "id": id_, "timestamp": "2026-01-02T00:00:00Z", "message": {"role": role, "content": content, **more}}
    calls = [{"type": "text", "text": "t"}, {"type": "text", "text": ""}, {"type": "thinking", "thinking": "h"}, {"type": "toolCall", "id": "c", "name": "n", "arguments": '{"a": 1}'}, {"type": "toolCall", "id": "d", "name": "n", "arguments": "not json"}, {"type": "image", "data": "x", "mime": "y"}]
    events = [
        {"type": "title", "title": "slot"},
        {"type": "session", "title": "", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z"},
        message("a", "user", "hello"),
        message("b", "assistant", calls, model="m"),
        message("c", "toolResult", [{"type": "text", "text": "r"}], toolName="n", toolCallId="c", details={"k": 1}, isError=True),
        {"type": "custom_message", "id": "e", "content": "extra", "attribution": "user"},
        {"type": "compaction"},
    ]
    archive = NORMALIZERS["omp"](handle(spark, "omp", events))
    assert payloads(archive) == [
        (0, 0, "text", "hello", None, None, None),
        (1, 0, "text", "t", None, None, None),
        (1, 1, "thinking", "h", None, None, None),
        (1, 2, "tool_use", None, "n", "c", {"arguments": {"a": 1}}),
        (1, 3, "tool_use", None, "n", "d", {"arguments": {"raw": "not json"}}),
        (1, 4, "image", None, None, None, {"data": "x", "mime": "y"}),
        (2, 0, "tool_result", "r", "n", "c", {"details": {"k": 1}, "isError": True}),
        (3, 0, "text", "extra", None, None, None),
    ]
    assert archive.conversations.first()["title"] == "slot"
    assert [x["role"] for x in archive.messages.orderBy("sequence_index").collect()] == ["user", "assistant", "tool", "user"]


def test_export_with_attachments(spark):
    chat = {"uuid": "s1", "name": "", "chat_messages": [
        {"uuid": "a", "sender": "human", "text": "t", "content": [], "attachments": [{"file_name": "f", "file_size": 3, "extracted_content": "z"}], "created_at": "2026-01-02T00:00:00Z"},
        {"uuid": "b", "sender": "assistant", "content": [{"type": "text", "text": "u"}]}, {"uuid": "c", "text": ""}, 5]}
    archive = NORMALIZERS["claude_export"](handle(spark, "claude_export", [chat]))
    assert payloads(archive) == [(0, 0, "text", "t", None, None, None), (0, 1, "attachment", "f", None, None, {"file_name": "f", "file_size": 3, "file_type": None, "extracted_content": "z"}), (1, 0, "text", "u", None, None, None)]
    one = archive.conversations.first()
    assert (one["title"], json.loads(one["metadata"])) == ("", {"message_count": 4})


def test_relational_sessions_of_both_layouts(spark, tmp_path):
    rows = lambda schema, *values: spark.createDataFrame(list(values), schema)
    tool = {"type": "tool", "callID": "k", "tool": "Bash", "state": {"status": "completed", "input": {"c": 1}, "metadata": {"output": "out"}}}
    open_tool = {"type": "tool", "callID": "l", "tool": "Bash", "state": {"status": "running"}}
    parts = [{"type": "step-start"}, {"type": "text", "text": "say"}, {"type": "reasoning", "text": "why", "time": {"start": 5, "end": None}}, tool, {"type": "text", "text": ""}, open_tool, {"type": "patch", "hash": "h"}, {"type": "text", "text": "end"}]
    sessions = rows("id string, title string, directory string", ("s", "T", "/w"), ("n", "old", "/w"))
    data = {"role": "assistant", "time": {"created": 1700000000000, "completed": 1700000009000}, "model": {"modelID": "m", "providerID": "p"}, "mode": "build"}
    messages = rows("id string, session_id string, time_created long, data string", ("m1", "s", 1, json.dumps({"role": "user"})), ("m2", "s", 2, json.dumps(data)))
    listed = [("q", "m1", "s", 1, json.dumps({"type": "text", "text": "hi"}))] + [(f"p{k}", "m2", "s", 10 + k, json.dumps(x)) for k, x in enumerate(parts)]
    v1 = session_documents_v1(sessions, messages, rows("id string, message_id string, session_id string, time_created long, data string", *listed))
    content = [{"type": "text", "text": "go"}, {"type": "tool", "id": "k", "name": "B", "state": {"status": "error", "input": {}, "error": "bad"}}, {"type": "reasoning", "text": ""}]
    newer = rows("id string, title string, directory string, model string", ("n", "", "/v", json.dumps({"id": "sm", "providerID": "pp"})))
    turns = [("u", "n", "user", 1, 1700000000000, json.dumps({"text": "first\nline", "files": [{"name": "f.txt"}, 3]})), ("a", "n", "assistant", 2, 1700000001000, json.dumps({"content": content})), ("x", "n", "idle", 3, 1700000002000, "{}")]
    v2 = session_documents_v2(newer, rows("id string, session_id string, type string, seq long, time_created long, data string", *turns))
    archive = NORMALIZERS["opencode"](only_newer_layout(v1, v2)).write(str(tmp_path), 2)
    got = {x["source_native_id"]: x for x in archive.conversations.collect()}
    assert [(got[k]["title"], got[k]["project"], got[k]["message_count"]) for k in "sn"] == [("T", "/w", 6), ("first", "/v", 5)]
    assert (got["s"]["started_at"].year, got["s"]["ended_at"].timestamp()) == (1970, 1700000009.0)
    assert got["n"]["metadata"] == '{"schema":"v2"}'
    m = archive.messages.join(archive.conversations.select(F.col("id").alias("conversation_id"), F.col("source_native_id").alias("own")), "conversation_id")
    listed = [(x["own"], x["source_native_id"], x["role"], x["model"]) for x in m.orderBy("own", "sequence_index").collect()]
    assert listed == [
        ("n", "u", "user", None), ("n", "a", "assistant", "sm"), ("n", "k", "assistant", "sm"), ("n", "k", "tool", None), ("n", "a", "assistant", "sm"),
        ("s", "m1", "user", None), ("s", "m2", "assistant", "m"), ("s", "k", "assistant", "m"), ("s", "k", "tool", None), ("s", "l", "assistant", "m"), ("s", "m2", "assistant", "m"),
    ]
    by = {(x[3], x[4], x[5]): x[6] for x in payloads(archive)}
    assert by[None, "Bash", "k"] == {"input": {"c": 1}, "status": "completed"} and by["out", None, "k"] == {"status": "completed"}
    assert by[None, "Bash", "l"] == {"input": {}, "status": "running"} and by[None, "patch", None] == {"hash": "h", "files": []}
    assert by["why", None, None] == {"start_ms": 5} and by["bad", None, "k"] == {"status": "error", "is_error": True}
    assert by["f.txt", None, None] == {"file": {"name": "f.txt"}} and by[None, None, None] in ({"file": 3}, None)
    raw = archive.raw_events.where("source_native_conversation_id = 's'").orderBy("line_number").collect()
    assert [json.loads(x["payload"])["id"] for x in raw] == ["m1", "m2"] and json.loads(raw[0]["payload"])["parts"] == [{"id": "q", "data": {"type": "text", "text": "hi"}}]
    assert [json.loads(x["payload"])["id"] for x in archive.raw_events.where("source_native_conversation_id = 'n'").orderBy("line_number").collect()] == ["n", "u", "a", "x"]


def test_imported_relational_session(spark):
    lines = [{"id": "m", "data": {"role": "user"}, "time_created": 1700000000000, "parts": [{"id": "p", "data": {"type": "text", "text": "hi"}}]}]
    archive = NORMALIZERS["opencode"](handle(spark, "opencode", lines, project="/hint"))
    assert (archive.conversations.first()["project"], [x[3] for x in payloads(archive)]) == ("/hint", ["hi"])


def test_agent_with_tool_calls_in_columns(spark):
    sessions = spark.createDataFrame([("s", "cli", None, "m", 100.5, None, "/w", None, b"z")], "id string, source string, display_name string, model string, started_at double, ended_at double, cwd string, title string, blob binary")
    calls = json.dumps([{"id": "c", "function": {"name": "f", "arguments": "{}"}}, {"call_id": "d"}, {"function": 5}])
    schema = "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, reasoning string, reasoning_content string, active int, compacted int"
    messages = [
        (1, "s", "user", "draft", None, None, None, 101.0, None, None, 0, 0), (2, "s", "user", "kept\nmore", None, None, None, 100.0, None, None, 0, 1), (3, "s", "user", "", None, None, None, 102.0, None, None, 1, 0),
        (4, "s", "assistant", "said", None, calls, None, 103.0, "", "why", 1, 0), (5, "s", "tool", "out", "c", None, "f", 104.0, None, None, 1, 0), (6, "s", "other", "x", None, None, None, 105.0, None, None, 1, 0),
    ]
    handles = session_documents_hermes(sessions, spark.createDataFrame(messages, schema), "work")
    archive = NORMALIZERS["hermes_agent"](handles)
    one = archive.conversations.first()
    assert (one["source_native_id"], one["title"], one["project"], one["message_count"]) == ("work/s", "kept", "/w", 3)
    assert (one["started_at"].second, one["ended_at"].second) == (40, 44)
    assert payloads(archive) == [
        (0, 0, "text", "kept\nmore", None, None, None),
        (1, 0, "tool_use", None, "f", "c", {"arguments": "{}"}),
        (1, 1, "tool_use", None, None, "d", {"arguments": ""}),
        (1, 2, "text", "said", None, None, None),
        (1, 3, "thinking", "why", None, None, None),
        (2, 0, "tool_result", "out", "f", "c", None),
    ]
    assert archive.raw_events.count() == 7
    assert json.loads(archive.messages.where("sequence_index = 0").first()["metadata"])["compacted"] is True


def test_scans_of_files(spark, tmp_path):
    (tmp_path / "-work-x").mkdir()
    (tmp_path / "-work-x" / "abc.jsonl").write_text('{"type":"user","uuid":"a","message":{"content":"hi"}}\n')
    (tmp_path / "2026" / "01").mkdir(parents=True)
    (tmp_path / "2026" / "01" / "rollout-2026-01-02T00-00-00-1-2-3-4-5.jsonl").write_text("{}\n")
    (tmp_path / "-work-x" / "2026_id-1.jsonl").write_text("{}\n")
    found = scan_transcripts(spark, str(tmp_path), "claude_code").collect()
    assert {(x["locator"], x["project_hint"]) for x in found} == {("abc", "/work/x"), ("2026_id-1", "/work/x")} and all(x["mtime"] > 0 for x in found)
    assert [x["locator"] for x in scan_transcripts(spark, str(tmp_path), "codex_cli").collect()] == ["1-2-3-4-5"]
    assert [x["locator"] for x in scan_transcripts(spark, str(tmp_path), "omp").collect()] == ["id-1"]
    archive = normalize_claude_code(scan_transcripts(spark, str(tmp_path), "claude_code"))
    assert {x["source_native_id"]: x["message_count"] for x in archive.conversations.collect()} == {"abc": 1, "2026_id-1": 0}
    (tmp_path / "export.json").write_text(json.dumps([{"uuid": "u", "chat_messages": []}, {"uuid": ""}, 5]))
    assert [x["locator"] for x in scan_export_array(spark, str(tmp_path / "export.json")).collect()] == ["u"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="not a JSON array"):
        scan_export_array(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("size", ["97b", "128m"])
def test_files_read_in_splits_give_the_rows_of_whole_files(spark, tmp_path, size):
    """Splits that end inside lines, blank and broken lines, broken UTF-8, spaces and signs in paths, one locator in two folders."""
    line = lambda n, text: json.dumps({"type": "user" if n % 2 else "assistant", "uuid": f"u{n}", "timestamp": f"2024-01-01T00:00:{n % 60:02d}Z", "message": {"role": "user", "content": text}}, ensure_ascii=False)
    for folder, name, n in (("-work-a b+c%20", "one", 40), ("-work-d", "two", 1), ("-work-d", "none", 0), ("-work-e", "two", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        rows = [x for k in range(n) for x in (line(k, "é\u2028" * k), *[["", "{half", "[1]", "  \r"], []][k % 2])]
        (tmp_path / folder / f"{name}.jsonl").write_bytes("\n".join(rows).encode() + (b'\n{"type":"system","x":"\xff"}' if n > 1 else b""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        whole, split = normalize_claude_code(scan_transcripts(spark, str(tmp_path), "claude_code")), read_transcripts(spark, str(tmp_path), "claude_code")
        for name, table in whole.tables().items():
            if name in ("messages", "content_blocks", "raw_events"):
                assert sorted(map(repr, split.tables()[name].collect())) == sorted(map(repr, table.collect())), name
        assert split.raw_events.count() == 46
        if size == "97b":
            assert spark.read.text(f"{tmp_path}/*/").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
