"""The governed gate on typical statements, and a governed query's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.gate import Authority
from ..registry import TABLES, query

STATEMENTS = {
    "join": "SELECT c_mktsegment, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "cte": "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT t.k, t.n FROM t ORDER BY t.n DESC LIMIT 3",
    "window": "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation",
    "delete": "DELETE FROM orders WHERE o_orderkey = 1",
    "drop": "DROP TABLE orders",
    "insert": "INSERT INTO nation VALUES (99, 'x', 0)",
    "two": "SELECT 1; SELECT 2",
    "semicolon_in_text": "SELECT ';' AS mark FROM region",
    "unknown_table": "SELECT * FROM secrets",
    "unknown_column": "SELECT password FROM customer",
    "qualified_column": "SELECT c.password FROM customer c",
    "parse_error": "SELEC 1",
    "show": "SHOW TABLES",
    "set": "SET spark.sql.ansi.enabled = false",
    "reflect": "SELECT reflect('java.lang.System', 'getProperty', 'java.version') AS x",
    "java_method": "SELECT n_name FROM nation WHERE java_method('java.lang.System', 'getenv', n_name) IS NULL",
    "try_reflect": "SELECT try_reflect('java.lang.System', 'exit', 0) AS x",
    "file": "SELECT * FROM parquet.`/data/customer.parquet`",
    "file_behind_cte": "WITH `parquet./data/customer.parquet` AS (SELECT 1 AS r_name) SELECT * FROM parquet.`/data/customer.parquet`",
    "cte_out_of_scope": "SELECT (WITH s AS (SELECT 1 AS x) SELECT x FROM s) AS y FROM s",
    "table_function": "SELECT * FROM range(10)",
    "script": "SELECT TRANSFORM(n_name) USING 'cat' FROM nation",
    "identifier": "SELECT * FROM IDENTIFIER('nation')",
    "correlated": "SELECT c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "correlated_unknown": "SELECT c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.nope)",
}

#: Statement, decision, errors and tables, as they should be.
EXPECTED = """SELECT * FROM (VALUES
    ('join', 'allowed', CAST([] AS VARCHAR[]), ['customer', 'orders']), ('cte', 'allowed', [], ['orders']), ('window', 'allowed', [], ['nation']),
    ('delete', 'blocked', ['non_readonly_operations: DeleteFromTable'], []), ('drop', 'blocked', ['non_readonly_operations: DropTable'], []), ('insert', 'blocked', ['non_readonly_operations: InsertIntoStatement'], []),
    ('two', 'blocked', ['expected_one_statement: found 2'], []), ('semicolon_in_text', 'allowed', [], ['region']), ('unknown_table', 'blocked', ['unknown_table: secrets'], ['secrets']),
    ('unknown_column', 'blocked', ['unknown_column: password'], ['customer']), ('qualified_column', 'blocked', ['unknown_column: c.password'], ['customer']),
    ('show', 'blocked', ['expected_readonly_query'], []), ('set', 'blocked', ['expected_readonly_query'], []), ('reflect', 'blocked', ['function_not_allowed: reflect'], []),
    ('java_method', 'blocked', ['function_not_allowed: java_method'], ['nation']), ('try_reflect', 'blocked', ['function_not_allowed: try_reflect'], []),
    ('file', 'blocked', ['unknown_table: parquet./data/customer.parquet'], ['parquet./data/customer.parquet']),
    ('file_behind_cte', 'blocked', ['unknown_table: parquet./data/customer.parquet'], ['parquet./data/customer.parquet']),
    ('cte_out_of_scope', 'blocked', ['unknown_table: s'], ['s']), ('table_function', 'blocked', ['function_not_allowed: range'], []),
    ('script', 'blocked', ['unsupported_operation: ScriptTransformation'], []), ('identifier', 'blocked', ['unsupported_operation: PlanWithUnresolvedIdentifier'], []),
    ('correlated', 'allowed', [], ['customer', 'orders']), ('correlated_unknown', 'blocked', ['unknown_column: c.nope'], ['customer', 'orders']), ('parse_error', 'blocked', ['parse_error'], [])
) AS t(name, decision, errors, tables)"""


def authority(spark: SparkSession, sf_dir: str) -> Authority:
    return Authority(spark, {"warehouse": {t: f"{sf_dir}/{t}.parquet" for t in TABLES}})


@query("sql_gate_decisions", EXPECTED)
def sql_gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of each statement; of a parse error without the parser's message."""
    a = authority(spark, sf_dir)
    rows = []
    for name, sql in STATEMENTS.items():
        v = a.validate("warehouse", sql)
        rows.append((name, v["decision"], [e if not e.startswith("parse_error") else "parse_error" for e in v["validation"]["errors"]], list(v["validation"]["referenced_tables"])))
    return spark.createDataFrame(rows, "name string, decision string, errors array<string>, tables array<string>")


@query("governed_execution", "SELECT r_name AS region, CAST(count(*) AS BIGINT) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def governed_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipt = authority(spark, sf_dir).execute("warehouse", "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    return spark.createDataFrame([tuple(r) for r in receipt["execution"]["rows"]], "region string, nations long")


@query("governed_explain", "SELECT 'explained' AS decision, TRUE AS joins, TRUE AS aggregates, FALSE AS touches_rows")
def governed_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's plan by the gate: it joins and aggregates, and is one row of text."""
    receipt = authority(spark, sf_dir).explain("warehouse", STATEMENTS["join"])
    plan = receipt["query_plan"]["rows"][0][0]
    return spark.createDataFrame([(receipt["decision"], "Join" in plan, "Aggregate" in plan, len(receipt["query_plan"]["rows"]) != 1)], "decision string, joins boolean, aggregates boolean, touches_rows boolean")
