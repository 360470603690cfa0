"""Every query of the engine beside its SQL in DuckDB, on the smallest tables."""

import pytest

from compare import canonical, oracle_rows
from weftgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE_SQL:
        assert got == canonical(*oracle_rows(SF, catalogue.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
