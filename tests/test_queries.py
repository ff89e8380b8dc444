"""Every query of the engine: its rows against its SQL, and a stable schema."""

import pytest

from harvestry import catalog
from tests.sqlcheck import same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, base, name):
    df = catalog.QUERIES[name](spark, base)
    if name in catalog.ORACLES:
        same_rows(df, catalog.ORACLES[name], base)
    else:
        assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "start_day", "end_day", "tag", "town", "title"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
