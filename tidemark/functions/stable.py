"""Comparable output: fractions reduced to what both summation orders agree on, whole numbers kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: types of DuckDB whose numbers are whole
WHOLE = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT", "UHUGEINT")


def comparable(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keep ``keys`` as they are, whole numbers to the digit, and reduce every other column to float precision.

    Sums of doubles depend on their order in the last bits. Small numbers go to
    a grid of 1e-6 first (shifted off the decimal ties), then to float32.
    """
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}

    def reduce_one(name: str) -> str:
        x = f"cast(`{name}` as double)"
        if name in whole:
            return f"{x} AS `{name}`"
        return (f"cast(cast(if(abs({x}) < 1e5D, cast(floor({x} * 1e6D + 0.5137D) as double) / 1e6D, {x}) as float) as double)"
                f" AS `{name}`")

    return df.selectExpr(*keys, *[reduce_one(c) for c in df.columns if c not in keys])


def comparable_sql(sql: str, keys: list[str]) -> str:
    """The same reduction around a DuckDB query."""
    rest = "COLUMNS(* EXCLUDE (" + ", ".join(keys) + "))" if keys else "COLUMNS(*)"
    x = f"CAST({rest} AS DOUBLE)"
    head = ", ".join(keys) + ", " if keys else ""
    return (
        f"SELECT {head}CASE WHEN typeof({rest}) IN {WHOLE} THEN {x} ELSE CAST(CAST(CASE WHEN abs({x}) < 1e5 "
        f'THEN floor({x} * 1e6 + 0.5137) / 1e6 ELSE {x} END AS FLOAT) AS DOUBLE) END AS "\\0" FROM ({sql}) AS _result'
    )
