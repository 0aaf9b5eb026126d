"""Every registered query of the library against its DuckDB equivalent."""

from __future__ import annotations

import pytest

from lexspark import catalogue
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert not differences(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf_dir)
