"""The driver's contract, and that the corpus operators are optional."""

from __future__ import annotations

import ast
import importlib.util
from pathlib import Path

import pytest

import __spark_entry__
from tests.conftest import SF
from weftgraph.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.QUERIES) >= 50


def test_without_the_optional_parts(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("weftgraph.llm", "corpus_pipeline") else real(name, *a))
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "weftgraph").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "weftgraph").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("weftgraph.llm", "corpus_pipeline")) for n in names), path


@pytest.mark.parametrize("name", ["vector_topk", "keyword_search", "chunk_ids", "merge_entities", "query_keywords"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(catalog.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda f: sorted(str([None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else str(x) for x in r]) for r in f[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)
