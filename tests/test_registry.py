import __spark_entry__ as entry
from kinvec.plans import registry


def test_names_and_sql():
    found = entry.queries()
    assert registry.FLAGSHIP in found and set(registry.QUERIES) <= set(found)
    assert set(entry.oracle_sql()) <= set(found)


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n > 0
