"""The driver contract, with and without the removable parts."""

import os
import sys

import pytest

D = "/root/testdata/sf0.001"


def test_registry_needs_no_session_and_names_agree():
    import __spark_entry__ as e

    assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())


def test_removable_parts(monkeypatch):
    import __spark_entry__ as e

    whole = set(e.queries())
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("factorspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "factorspark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(e.queries())
    assert rest and not any(n.startswith("op") or n == "pipeline" for n in rest) and rest <= whole
    assert set(e.oracle_sql()) <= rest


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "factorspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "factorspark.llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
