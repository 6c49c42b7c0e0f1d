"""What the driver calls."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "sum_charge" in got.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_without_the_training_operators():
    for path in (ROOT / "quarrykit").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or "corpus_pipeline" in n for n in names), path


def test_the_callers_session_is_left_alone(spark, sf):
    before = {k: spark.conf.get(k) for k in ("spark.sql.caseSensitive", "spark.sql.ansi.doubleQuotedIdentifiers")}
    entry.queries()["filter_param"](spark, sf).count()
    assert {k: spark.conf.get(k) for k in before} == before
    assert not [t for t in spark.catalog.listTables() if t.name == "bundle"]


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["filter_param"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in plan
