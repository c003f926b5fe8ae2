"""The driver contract holds with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry
from lumastack import registry


def test_every_query_has_a_callable_and_sql_has_a_query():
    names = entry.queries()
    assert all(callable(f) for f in names.values())
    assert set(entry.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_import_without_the_optional_parts(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lumastack.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(registry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
