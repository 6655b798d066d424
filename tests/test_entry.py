"""The entry module works with and without the optional corpus operators."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_sql_belongs_to_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["lexmill.llm.queries", "corpus_pipeline"])
def test_parts_that_cannot_be_imported_are_left_out(monkeypatch, missing):
    real = importlib.import_module
    left = entry.all_queries()

    def fails(name, *args):
        if name == missing:
            raise ImportError(f"no {name}")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", fails)
    with pytest.warns(UserWarning, match="left out"):
        names = set(entry.queries())
    assert set(left) <= names and "pipeline" not in names
    assert (names == set(left)) == (missing != "corpus_pipeline" or "lexmill.llm.queries" not in sys.modules)
