"""Every query of the core against its SQL."""

from __future__ import annotations

import pytest
from conftest import agree

from tesseral.queries import queries
from tesseral.sql import ORACLES


def test_every_query_has_sql():
    assert set(queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    agree(queries()[name](spark, sf_dir), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 29
