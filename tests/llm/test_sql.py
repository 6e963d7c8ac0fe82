"""Queries of the training-data operators that SQL can express give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same_rows
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF_DIR), duck.sql(ORACLE_SQL[name]))
