"""Helpers that shape the plan rather than the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter over a plain column is pushed below it by repeating the column's
    expression; for parsed JSON that means parsing a text once per predicate.
    A generator of one row stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
