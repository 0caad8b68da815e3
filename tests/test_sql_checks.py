"""Every registered query against its checking SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from pricewright import plans


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, small_dir, con, name):
    df = plans.QUERIES[name](spark, small_dir)
    if name in plans.SQL:
        assert differences(df, con, plans.SQL[name]) == []
    else:
        assert df.count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_inventory_line_is_registered():
    lines = {f"{group}{i}" for group, last in
             dict(S=10, F=12, J=6, A=12, W=9, T=5, U=2, X=23, R=14, L=8, Q=1, P=1).items() for i in range(1, last + 1)}
    registered = {part.strip() for ids in plans.SURVEY_IDS.values() for part in ids.split(",")}
    assert lines - registered == set()
