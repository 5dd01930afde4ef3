"""Read-only SQL over an archive, and results of a bounded size.

A statement is parsed, and its plan is held to lists of what may be in it: kinds of nodes, functions that Spark itself defines, tables of the
archive. Then Spark analyses it, which resolves every name, and the analysed plan is held to a list again: each leaf must be one of the
archive's tables, which are temporary views of an isolated session, or rows that the statement states itself. What is on no list is refused, so new kinds of
statements are refused until they are listed. Only then is a DataFrame made of it. DESCRIBE and SHOW are answered from the tables'
schemas, without a command being run.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..archive import Archive

#: Nodes that a parsed query may be made of.
PARSED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate", "Join", "LateralJoin", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "UnresolvedHaving", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "OneRowRelation", "OneRowRelation$", "LocalRelation", "Generate", "WithWindowDefinition", "Pivot", "UnresolvedPivot",
    "PipeOperator", "Unpivot", "Sample", "Window", "Expand", "ResolvedInlineTable",
}
#: Nodes that an analysed query may have beside them, above the archive's tables.
ANALYSED = PARSED | {"CTERelationDef", "CTERelationRef", "WithCTE", "Range", "UnionLoop", "Aggregate", "View"} - {"UnresolvedRelation"}
#: Tables that a statement may make by a function.
MAKERS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}
#: Functions of Spark that run other code or tell about the machine.
CALLING = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "user", "session_user", "assert_true", "raise_error"}
#: Expressions of an analysed query that run code which is not Spark's.
FOREIGN = ("UDF", "UDAF", "UDTF", "Reflect", "ScalaAggregator", "SQLFunction", "Java", "FromAvro", "Python")
MOST_ROWS, MOST_BYTES, SECONDS = 500, 512_000, 30


class NotAllowed(ValueError):
    """The statement is not a read of the archive."""


def _items(spark: SparkSession, seq) -> list:
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _inner(spark: SparkSession, node) -> list:
    """The plans right below a node: children, those of expressions, and the tables of WITH."""
    found = _items(spark, node.children()) + _items(spark, node.subqueries())
    if _name(node) == "UnresolvedWith":
        found += [x._2() for x in _items(spark, node.cteRelations())]
    return found


def _expressions(spark: SparkSession, node):
    todo = _items(spark, node.expressions())
    while todo:
        found = todo.pop()
        yield found
        todo += _items(spark, found.children())


def _own_view(spark: SparkSession, node, tables: set[str]) -> bool:
    """Whether a node is one of the temporary views of the archive's tables."""
    name = node.desc().identifier() if _name(node) == "View" else None
    return name is not None and node.isTempView() and not name.database().isDefined() and name.table().lower() in tables


def _parsed(session: SparkSession, statement: str):
    try:
        return session._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except (PySparkException, Py4JJavaError) as e:
        raise NotAllowed(f"not one SQL statement: {str(e).splitlines()[0] if str(e) else ''}") from e


def check_parsed(session: SparkSession, plan) -> None:
    """Raises NotAllowed unless a parsed plan is made of listed nodes, functions of Spark and tables without a place in their name."""
    builtin = session._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    identifier = session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    todo = [plan]
    while todo:
        node = todo.pop()
        if _name(node) not in PARSED:
            raise NotAllowed(f"{_name(node)} is no part of a read")
        if _name(node) == "UnresolvedRelation":
            parts = _items(session, node.multipartIdentifier())
            if len(parts) != 1 or node.isStreaming():
                raise NotAllowed(f"{'.'.join(parts)} is no table of the archive")
        if _name(node) == "UnresolvedTableValuedFunction":
            name = ".".join(_items(session, node.name()))
            if name.lower() not in MAKERS:
                raise NotAllowed(f"{name} makes no table here")
        for e in _expressions(session, node):
            kind = _name(e)
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                parts = _items(session, e.nameParts()) if kind == "UnresolvedFunction" else [e.name().funcName()]
                name = parts[-1].lower()
                if len(parts) != 1 or name in CALLING or not builtin.functionExists(identifier(name)):
                    raise NotAllowed(f"{'.'.join(parts)} is no function here")
            elif kind.startswith("ExpressionWithUnresolvedIdentifier") or any(x in kind for x in FOREIGN):
                raise NotAllowed(f"{kind} is no part of a read")
        todo += _inner(session, node)


def check_analysed(session: SparkSession, plan, tables: set[str]) -> None:
    """Raises NotAllowed unless every leaf of an analysed plan is a table of the archive or stated in the query."""
    todo = [plan]
    while todo:
        node = todo.pop()
        if _own_view(session, node, tables):
            continue  # what a table is made of is the caller's own
        if _name(node) not in ANALYSED or _name(node) == "View":
            raise NotAllowed("only tables of the archive can be read")
        for e in _expressions(session, node):
            if any(x in _name(e) for x in FOREIGN):
                raise NotAllowed(f"{_name(e)} is no part of a read")
        todo += _inner(session, node)


def isolated(archive: Archive) -> SparkSession:
    """A session that holds the archive's tables as views and nothing else of the caller's."""
    spark = archive.conversations.sparkSession
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    registry = session._jsparkSession.sessionState().functionRegistry()
    for name in CALLING:
        registry.dropFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    for name, df in views(archive).items():
        _rows(session, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return session


def views(archive: Archive) -> dict[str, DataFrame]:
    """What a statement can read."""
    return archive.tables() | {"tool_calls": archive.tool_calls}


def _rows(session: SparkSession, plan) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _described(spark: SparkSession, schema) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), None) for f in schema]
    return spark.createDataFrame(rows, "col_name string, data_type string, comment string")


def _told(session: SparkSession, plan, archive: Archive) -> DataFrame | None:
    """The answer to DESCRIBE or SHOW, from the tables' schemas; None for other plans."""
    kind, tables = _name(plan), views(archive)
    of = lambda name: next((df for k, df in tables.items() if k == name.lower()), None)
    if kind == "ShowTables" and _name(plan.namespace()) in ("CurrentNamespace$", "CurrentNamespace"):
        wanted = plan.pattern().get() if plan.pattern().isDefined() else "*"
        rows = session.createDataFrame([(name,) for name in sorted(tables)], "tableName string")
        pattern = "^(?i)" + wanted.replace("*", ".*") + "$"
        return rows.where(F.col("tableName").rlike(pattern))
    if kind in ("DescribeRelation", "ShowColumns"):
        target = plan.relation() if kind == "DescribeRelation" else plan.child()
        parts = _items(session, target.multipartIdentifier()) if _name(target) in ("UnresolvedTableOrView", "UnresolvedRelation") else []
        found = of(parts[0]) if len(parts) == 1 else None
        plain = kind == "DescribeRelation" and plan.partitionSpec().isEmpty() or kind == "ShowColumns" and not plan.namespace().isDefined()
        if found is None or not plain:
            raise NotAllowed(f"{'.'.join(parts) or kind} is no table of the archive")
        described = _described(session, found.schema)
        return described if kind == "DescribeRelation" else described.select("col_name")
    if kind == "DescribeQueryCommand":
        return _described(session, _checked(session, plan.plan(), set(tables)).schema)
    return None


def _checked(session: SparkSession, plan, tables: set[str]) -> DataFrame:
    check_parsed(session, plan)
    rows = _rows(session, plan)  # analyses; a query of listed nodes runs nothing
    check_analysed(session, rows._jdf.queryExecution().analyzed(), tables)
    return rows


def query(archive: Archive, statement: str) -> DataFrame:
    """The result of one SELECT, WITH, VALUES, DESCRIBE or SHOW statement over the archive."""
    session = isolated(archive)
    plan = _parsed(session, statement.strip())
    told = _told(session, plan, archive)
    return told if told is not None else _checked(session, plan, set(views(archive)))


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[str]
    truncated: bool

    @property
    def json(self) -> str:
        """The rows as a JSON array of objects, their members in the columns' order."""
        return "[" + ",".join(self.rows) + "]"


def bounded(df: DataFrame, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> DataFrame:
    """(place, row, fits): the first rows + 1 rows as JSON objects in column order, and whether the rows up to each fit the size with their names.

    A row over the limit is cut off before it leaves its task, so that no more than the limit of each comes to the driver.
    """
    names = sum(len(c.encode()) + 4 for c in df.columns) * 2 + 2048
    if names > size:
        raise ValueError("the column names alone are larger than a result may be; use shorter aliases")
    columns = [F.col(f"`{c}`") for c in df.columns]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    listed = df.limit(rows + 1).select(text.alias("row")).withColumn("place", F.monotonically_increasing_id())
    cost = F.octet_length("row") + 4 * (len(df.columns) + 2) + 2
    total = F.sum(cost).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + names  # of rows + 1 rows
    found = listed.withColumn("fits", (total <= size) & (F.row_number().over(Window.orderBy("place")) <= rows))
    return found.select("place", F.when(F.col("fits"), F.col("row")).alias("row"), "fits")


def run(archive: Archive, statement: str, rows: int = MOST_ROWS, size: int = MOST_BYTES, seconds: float = SECONDS) -> Result:
    """query() within the limits of rows, bytes and time, its analysis included; the prefix of rows that fits is kept."""
    context, tag = archive.conversations.sparkSession.sparkContext, f"read-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    timer.start()
    try:
        df = query(archive, statement)
        found = bounded(df, rows, size).collect()
    except (PySparkException, Py4JJavaError) as e:
        if not timer.is_alive():
            raise TimeoutError(f"the statement took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    kept = [r["row"] for r in sorted(found, key=lambda r: r["place"]) if r["fits"]]
    return Result(df.columns, kept, len(kept) < len(found))
