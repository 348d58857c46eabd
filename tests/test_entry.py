import ast
import pathlib
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent


def test_registered_queries():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and {"feed_default", "p5_found"} <= set(q)
    assert entry.llm is None or all(f"p{n}_" in " ".join(q) for n in range(1, 10))


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "feedmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_the_entry_works_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("feedmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "feedmill.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import importlib

    again = importlib.import_module("__spark_entry__")
    assert again.llm is None and "feed_default" in again.queries()
    monkeypatch.setitem(sys.modules, "__spark_entry__", entry)


def test_small_queries_run(spark):
    for name in ("feed_default", "digest_counts", "due_sources", "purge_tier_counts", "companies_overview"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
