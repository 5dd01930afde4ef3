"""Read-only SQL: what passes, what is refused, and how large a result gets; the canonical export."""

import json

import pytest

from pyspark.errors import AnalysisException

from palimpsest.archive import SCHEMAS, Archive
from palimpsest.operators import export, readonly


@pytest.fixture(scope="module")
def archive(spark):
    rows = {
        "sources": [("s", "S", "1", None, None, "{}")],
        "conversations": [("c", "s", "n", "Title", "/w/p", None, None, 2, None, "/tmp/in/x", "{}", None, None)],
        "messages": [("m0", "c", "a", None, "user", None, None, 0, "{}"), ("m1", "c", "b", "m0", "assistant", "m", None, 1, '{"z":1,"a":2}')],
        "content_blocks": [("b0", "m0", 0, "text", "hello", None, None, None), ("b1", "m1", 0, "tool_use", None, "Bash", "t", '{"input":{"command":"ls"}}')],
        "raw_events": [("r", "s", "n", "/tmp/in/x", 0, '{"k":1}', None)],
    }
    return Archive(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})


#: A statement of each kind of plan that a read may have, and how many rows it gives.
READS = {
    "SELECT role, upper(model) AS model FROM messages WHERE sequence_index > 0": 1,
    "select id from messages order by sequence_index desc limit 1": 1,
    "VALUES (1, 'one'), (2, 'two')": 2,
    "SELECT role, count(*) AS n FROM messages GROUP BY role HAVING count(*) = 1": 2,
    "SELECT title, role FROM conversations AS k LEFT JOIN messages AS m ON m.conversation_id = k.id": 2,
    "SELECT id FROM messages UNION ALL SELECT id FROM conversations": 3,
    "SELECT id FROM messages EXCEPT SELECT message_id FROM content_blocks": 0,
    "SELECT role FROM messages INTERSECT SELECT 'user'": 1,
    "WITH spoken AS (SELECT * FROM messages), users AS (SELECT * FROM spoken WHERE role = 'user') SELECT id FROM users": 1,
    "WITH messages AS (SELECT 5 AS five) SELECT five FROM messages": 1,
    "SELECT (SELECT max(sequence_index) FROM messages) AS top, exists(SELECT 1 FROM raw_events) AS seen": 1,
    "SELECT m.id FROM messages m WHERE m.id NOT IN (SELECT message_id FROM tool_calls)": 1,
    "SELECT k.id, x.n FROM conversations k, LATERAL (SELECT count(*) AS n FROM messages m WHERE m.conversation_id = k.id) x": 1,
    "SELECT id, row_number() OVER w AS place FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY id)": 2,
    "SELECT word FROM content_blocks LATERAL VIEW explode(split(text, 'l')) AS word": 3,
    "SELECT pos FROM posexplode(array('a', 'b'))": 2,
    "SELECT * FROM (SELECT role, sequence_index FROM messages) PIVOT (max(sequence_index) FOR role IN ('user', 'assistant'))": 1,
    "SELECT role, count(*) AS n FROM messages GROUP BY ROLLUP(role)": 3,
    "FROM messages |> WHERE role = 'user' |> SELECT id": 1,
    "SHOW TABLES": 6,
    "SHOW TABLES LIKE 'raw*'": 1,
    "SHOW COLUMNS FROM sources": 6,
    "DESCRIBE conversations": 13,
    "DESCRIBE QUERY SELECT id, role FROM messages": 2,
    "/* a ; in a comment */ SELECT ';' AS semicolon -- and one here ;": 1,
}
#: Statements that write, run, tell of other things or read what is not the archive's.
OTHERS = [
    "",
    "   ",
    "SELEC id FROM messages",
    "SELECT id FROM messages; SELECT id FROM messages",
    "TRUNCATE TABLE messages",
    "UPDATE messages SET role = 'user'",
    "MERGE INTO messages USING conversations ON false WHEN NOT MATCHED THEN INSERT *",
    "INSERT OVERWRITE DIRECTORY '{folder}/written' USING parquet SELECT * FROM messages",
    "FROM messages INSERT INTO secret SELECT id",
    "CREATE OR REPLACE TEMP VIEW messages AS SELECT 1",
    "CREATE TABLE {folder_name} USING parquet AS SELECT 1 AS a",
    "DECLARE VARIABLE v INT DEFAULT 1",
    "SET VAR v = 1",
    "RESET",
    "USE default",
    "ANALYZE TABLE default.secret COMPUTE STATISTICS",
    "BEGIN SELECT 1; END",
    "EXPLAIN EXTENDED SELECT id FROM messages",
    "EXECUTE IMMEDIATE 'SELECT * FROM default.secret'",
    "EXECUTE IMMEDIATE 'CREATE TABLE {folder_name} USING parquet AS SELECT 1 AS a'",
    "EXECUTE IMMEDIATE 'INSERT OVERWRITE DIRECTORY \"{folder}/written\" USING parquet SELECT 1 AS a'",
    "SELECT * FROM secret",
    "SELECT * FROM default.secret",
    "SELECT * FROM spark_catalog.default.secret",
    "SELECT * FROM IDENTIFIER('default.secret')",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT * FROM (WITH secret AS (SELECT 1 a) SELECT 1) q, secret",
    "SELECT (SELECT max(word) FROM secret) AS word",
    "SELECT id FROM messages WHERE exists(SELECT 1 FROM secret)",
    "SELECT k.id FROM conversations k, LATERAL (SELECT * FROM secret) x",
    "WITH kept AS (SELECT * FROM secret) SELECT 1",
    "SELECT * FROM global_temp.shared",
    "SELECT * FROM parquet.`{folder}/file`",
    "SELECT * FROM json.`{folder}/file`",
    "DESCRIBE default.secret",
    "DESCRIBE secret",
    "DESCRIBE QUERY SELECT * FROM secret",
    "SHOW TABLES IN default",
    "SHOW DATABASES",
    "SHOW FUNCTIONS",
    "SHOW COLUMNS FROM secret",
    "SHOW CREATE TABLE secret",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.Math', 'abs', 1)",
    "SELECT id FROM messages ORDER BY java_method('java.lang.Math', 'random')",
    "SELECT default.f(1)",
    "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', 1)",
    "SELECT * FROM python_worker_logs()",
]


@pytest.fixture(scope="module")
def others(spark, tmp_path_factory):
    """Things that a statement must not reach: a table, a shared view and a file."""
    folder = tmp_path_factory.mktemp("others")
    spark.sql(f"CREATE TABLE IF NOT EXISTS default.secret USING parquet LOCATION '{folder}/secret' AS SELECT 'hidden' AS word")
    spark.sql("SELECT 1 AS a").createOrReplaceGlobalTempView("shared")
    spark.range(1).write.parquet(f"{folder}/file")
    yield folder
    spark.sql("DROP TABLE default.secret")
    spark.catalog.dropGlobalTempView("shared")


@pytest.mark.parametrize("statement", READS)
def test_reads_pass(archive, others, statement):
    assert readonly.query(archive, statement).count() == READS[statement]


@pytest.mark.parametrize("statement", OTHERS)
def test_others_are_refused(spark, archive, others, statement):
    tables = {t.name for t in spark.catalog.listTables("default")}
    with pytest.raises((readonly.NotAllowed, AnalysisException)) as found:
        readonly.query(archive, statement.format(folder=others, folder_name=f"t{others.name}"))
    assert found.type is readonly.NotAllowed, found.value
    assert not (others / "written").exists()
    assert {t.name for t in spark.catalog.listTables("default")} == tables


def test_the_caller_keeps_its_session(spark, archive):
    readonly.query(archive, "SELECT 1").collect()
    assert not spark.catalog.tableExists("raw_events")
    assert spark.sql("SELECT reflect('java.lang.Math', 'max', 2, 3)").first()[0] == "3"


def test_tables_may_be_made_by_python(spark, archive):
    """What a table of the archive is made of is the caller's own."""
    lengths = archive.messages.mapInPandas(lambda frames: (f.assign(role=f["role"] * 2) for f in frames), archive.messages.schema)
    own = Archive(**(archive.tables() | {"messages": lengths}))
    assert {r["role"] for r in readonly.query(own, "SELECT role FROM messages").collect()} == {"useruser", "assistantassistant"}


@pytest.mark.parametrize(
    ("sizes", "kept"),
    [([700_000], 0), ([10, 700_000, 10], 1), ([100_000] * 8, 5), ([1] * 501, 500), ([1] * 500, 500), ([], 0)],
)
def test_rows_are_kept_as_long_as_they_fit(spark, archive, sizes, kept):
    """The first rows that are within the limits of rows and bytes are kept; a longer row ends them."""
    titles = [(str(k), "s", "n", "n" * n, *[None] * 9) for k, n in enumerate(sizes)]
    rows = spark.createDataFrame(titles, SCHEMAS["conversations"])
    own = Archive(**(archive.tables() | {"conversations": rows}))
    found = readonly.run(own, "SELECT title FROM conversations ORDER BY CAST(id AS INT)")
    assert (len(found.rows), found.truncated) == (kept, kept < len(sizes))
    assert len(found.json.encode()) <= readonly.MOST_BYTES and [len(x["title"]) for x in json.loads(found.json)] == sizes[:kept]


def test_small_results_are_whole(archive):
    found = readonly.run(archive, "SELECT 1 AS b, NULL AS a")
    assert (found.json, found.columns, found.truncated) == ('[{"b":1,"a":null}]', ["b", "a"], False)
    with pytest.raises(ValueError, match="column names"):
        readonly.run(archive, f"SELECT 1 AS `{'x' * 300_000}`")


def test_long_statements_end(archive):
    with pytest.raises(TimeoutError):
        readonly.run(archive, "SELECT sum(id % 7) FROM range(0, 400000000000, 1, 1600)", seconds=2)


def test_canonical_export(archive):
    (row,) = export.export_canonical(archive, {"/tmp/in": "$INPUT"}).collect()
    assert json.loads(row["document"]) == {
        "source_id": "s", "source_native_id": "n", "title": "Title", "project": "/w/p", "started_at": None, "ended_at": None, "message_count": 2, "raw_path": "$INPUT/x", "metadata": {},
        "messages": [
            {"sequence_index": 0, "source_native_id": "a", "parent_source_native_id": None, "role": "user", "model": None, "created_at": None, "metadata": {}, "blocks": [{"block_index": 0, "type": "text", "text": "hello", "tool_name": None, "tool_use_id": None, "payload": None}]},
            {"sequence_index": 1, "source_native_id": "b", "parent_source_native_id": "a", "role": "assistant", "model": "m", "created_at": None, "metadata": {"a": 2, "z": 1}, "blocks": [{"block_index": 0, "type": "tool_use", "text": None, "tool_name": "Bash", "tool_use_id": "t", "payload": {"input": {"command": "ls"}}}]},
        ],
        "raw_events": [{"line_number": 0, "raw_path": "$INPUT/x", "payload": {"k": 1}}],
    }
