"""Compares a Spark result with DuckDB's, as the driver does: columns by name, rows in any order, types too."""

from __future__ import annotations

import pandas as pd

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}


def plain(value):
    if value is None or (not isinstance(value, (list, tuple, dict)) and pd.isna(value)):
        return None
    if isinstance(value, str):
        return value
    if str(type(value)).find("bool") >= 0:
        return bool(value)
    return float(value)


def same_rows(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    assert kinds == dict(zip(relation.columns, map(str, relation.types), strict=True))
    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    right = sorted(repr(tuple(map(plain, r))) for r in relation.df()[columns].astype(object).itertuples(index=False, name=None))
    assert left, "no rows"
    assert left == right
