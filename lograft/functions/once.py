"""Columns that are computed once per row, whatever uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column. The optimizer neither copies the expression into later ones nor pushes a filter on it below."""
    return df.withColumn(name, F.explode(F.array(value)))
