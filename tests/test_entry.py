"""The driver's contract."""

import __spark_entry__ as driver
from siftlake.plans import registry


def test_entry_is_the_flagship(spark):
    df = driver.entry(spark)
    assert df.columns == ["dataset", "detector", "mean_pseudo_auc", "true_auc", "pseudo_rank", "true_rank", "rho"]
    assert df.count() == 9


def test_every_sql_has_its_query():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)


def test_the_library_does_not_need_the_corpus_operators():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "siftlake.llm" not in p.read_text(), p
