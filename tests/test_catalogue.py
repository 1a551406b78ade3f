"""Every query runs; every query with an SQL twin gives its rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.conftest import SF

from lodestone.plans import catalogue
from tests.duck import assert_same, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


def test_table_chunks_on_odd_rows(spark, tmp_path):
    """Balances without plain digits, a missing key, and names of several lines, one of them blank."""
    odd = {5: -0.0, 9: -0.001, 12: float("nan"), 17: float("inf"), 21: float("-inf"), 30: 0.125}
    rows = [(None if i == 3 else i, f"Customer {i}" + "\n \nsecond" * (i % 4 == 0), i % 2, odd.get(i, 1000.5 * i), "A" * (1 + i % 60)) for i in range(400)]
    columns = dict(zip(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), zip(*rows)))
    pq.write_table(pa.table(columns), tmp_path / "customer.parquet")
    assert_same(QUERIES["table_chunks"](spark, str(tmp_path)), connect(tmp_path), SQL["table_chunks"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "found_in", "rank"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
