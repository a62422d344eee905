"""Settings of a translation run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from palisade.constants import DEFAULT_CATALOG, DEFAULT_SCHEMA


@dataclass(frozen=True)
class Config:
    catalog: str = DEFAULT_CATALOG
    schema: str = DEFAULT_SCHEMA
    # (mapping_type, source_value, target_value) overrides, or None
    mapping: DataFrame | None = None
    # mask type: SQL text over {column}; adds to or replaces the known ones
    masks: Mapping[str, str] | None = None
