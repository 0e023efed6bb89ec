"""Columns that are costly to compute and used more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, each evaluated once per row.

    The optimizer copies a projected expression into the filters and projections above it; past a
    generator, here of exactly one row, it cannot.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
