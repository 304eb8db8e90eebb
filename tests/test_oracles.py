"""Every registered query of the library proper against its SQL, on the smallest tables."""

import pytest

from ledgerline.plans.catalog import ORACLES, QUERIES

from .oracle import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, name):
    check(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
