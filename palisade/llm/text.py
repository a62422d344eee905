"""Words of a text as column expressions; a word is a run of anything but the six ASCII spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """All words of ``text``; an empty array for a null text or one without a word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` as column names that ``df`` does not have; a clash gets underscores before it."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names
