import importlib

import pytest
from oracle import agrees

from ravelin.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, spark, sf_dir):
    agrees(QUERIES[name], ORACLES[name], spark, sf_dir)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("broken", ["ravelin.llm.queries", "corpus_pipeline"])
def test_entry_without_corpus_operators(broken, monkeypatch):
    """Deleted or broken, they are left out and every other query stays."""
    import __spark_entry__ as e

    def fail(name):
        if name == broken or name == "corpus_pipeline":
            raise ImportError(name)
        return importlib.import_module(name)

    monkeypatch.setattr(e, "import_module", fail)
    with pytest.warns(UserWarning, match="left out"):
        found = e.queries()
    assert set(QUERIES) <= set(found) and "pipeline" not in found
