"""Every registered query against its DuckDB oracle (sf0.001 by default;
set LEDGERFLOW_ORACLE_SF to another folder, e.g. /root/testdata/sf0.01)."""
import os

import pytest

import __spark_entry__ as E
from ledgerflow.plans.catalog import ORACLE, QUERIES
from oracle_check import compare, duck

SF = os.environ.get("LEDGERFLOW_ORACLE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_is_known():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    if name not in E.oracle_sql():
        assert len(sdf) >= 1
        return
    odf = con.sql(E.oracle_sql()[name]).df()
    exact, tolerant, msg = compare(sdf, odf)
    assert exact, msg


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.split for r in rows} == {"train", "val", "test"}
    assert df.columns == ["split", "n_users", "n_cells", "n_positive", "false_positive_rate",
                          "false_negative_rate", "positive_mae", "percentage_error"]
