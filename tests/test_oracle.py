"""Each core query gives the rows of its SQL."""

from pathlib import Path

import pytest

from lexforge.plans.queries import QUERIES, SQL
from tests.compare import both

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, name):
    ours, theirs = both(spark, QUERIES[name], SQL[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "text"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
