"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generate.

    Filters on them stay above it, so a long rule or a JSON parse runs once per row
    instead of being copied into every filter and projection that mentions it.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
