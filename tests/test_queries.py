import pytest

import __spark_entry__
from oracle import SF, compare
from plumbline.plans import registry

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql_repeats(spark, name):
    run = lambda: sorted(map(str, registry.QUERIES[name](spark, str(SF)).collect()))
    assert run() == run()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(monkeypatch):
    """Without the training-data subpackage the entry still lists everything else."""
    import sys

    for m in [m for m in sys.modules if m.startswith("plumbline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        import corpus_pipeline  # noqa: F401
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
