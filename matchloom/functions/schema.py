"""Checks of input frames. Column checks need no job; those of values need one each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, column: str, what: str) -> DataFrame:
    if not df.groupBy(column).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"{what} must have unique {column} values")
    return df
