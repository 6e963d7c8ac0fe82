"""Every registered query with SQL gives the same rows as DuckDB; the others give rows."""

from __future__ import annotations

import pytest

from tests.compare import same_rows
from tests.conftest import SF_DIR
from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF_DIR), duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0
