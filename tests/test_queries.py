"""Every point-set query with SQL gives the rows of its SQL; the others give rows with values in all columns."""

import pytest

from lodestone.plans import registry

from oracle import both

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    got, want = both(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect() or registry.queries()[name](spark, LARGER).collect()  # rays may hit none of few disks
    assert rows and len(set(df.columns)) == len(df.columns)
    for c in df.columns:
        assert any(r[c] is not None for r in rows), c
