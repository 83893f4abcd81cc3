"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import connect, duck_rows, spark_rows

from proofmill.plans import packs, sessions, streams, texts  # noqa: F401
from proofmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, rows = spark_rows(df)
    assert columns
    if name in ORACLES:
        assert (columns, rows) == duck_rows(con, ORACLES[name])


def test_registry_covers_oracles():
    assert set(ORACLES) <= set(QUERIES)
