from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Round doubles so that the last bits of a floating sum do not matter."""
    return df.withColumns({c: F.round(F.col(c), n) for c in cols})


def r6(cols: str, n: int = 6) -> str:
    """'a b c' -> 'round(a, 6) AS a, ...' for the oracle side."""
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols.split())
