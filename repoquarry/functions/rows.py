"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list[Column | str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array, with the kept columns; empty and null arrays give no row.

    A plain explode lets the optimizer infer "the array is not empty" as a filter and push it below the projection, which
    evaluates the whole array expression again. The outer form with a filter behind it evaluates it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position or "_position", name))
    found = rows.filter(F.col(position or "_position").isNotNull())
    return found if position else found.drop("_position")
