"""Named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _six_decimals(c: str) -> Column:
    """Half away from zero on the binary value, in plain arithmetic; Spark's own
    ``round`` goes through decimals."""
    x = F.col(f"`{c}`")
    near = F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(x) < 1e12, near).otherwise(x)


def query(name: str, sql: str | None = None, round_cols: str | list[str] = "") -> Callable[[Query], Query]:
    """Register a query. Doubles are compared at 6 decimals: all of them are
    rounded on the Spark side, ``round_cols`` names them for the SQL side."""

    def add(fn: Query) -> Query:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
            return df.withColumns({c: _six_decimals(c) for c in doubles}) if doubles else df

        QUERIES[name] = rounded
        if sql:
            cols = round_cols.split() if isinstance(round_cols, str) else round_cols
            swaps = ", ".join(f'ROUND("{c}", 6) AS "{c}"' for c in cols)
            ORACLE[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if cols else sql
        return fn

    return add
