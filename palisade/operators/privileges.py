"""Access types to privileges, names to principals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.constants import LOCATION_PRIVILEGES, PRIVILEGES
from palisade.functions.masks import literal_map
from palisade.functions.once import computed_once
from palisade.operators.config import Config
from palisade.sources.mappings import with_override


def default_privilege(kind: Column) -> Column:
    """Lower-case, drop a ``service:`` prefix, look up, else upper-case what is left."""
    name = F.regexp_replace(F.lower(kind), "^[^:]*:", "")
    return F.coalesce(F.try_element_at(literal_map(PRIVILEGES), name), F.upper(name))


def location_privilege(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LOCATION_PRIVILEGES), F.lower(kind)), F.upper(kind))


def map_privilege(df: DataFrame, config: Config, kind: str = "access_type", out: str = "privilege") -> DataFrame:
    named = computed_once(df, __default=default_privilege(F.col(kind)))
    return with_override(named, config.mapping, "privilege", kind, out, F.col("__default")).drop("__default")


def map_principal(df: DataFrame, config: Config, name: str = "pname", out: str = "principal") -> DataFrame:
    return with_override(df, config.mapping, "principal", name, out)


def explode_accesses(items: DataFrame) -> DataFrame:
    """Allowed accesses only; an access without the flag counts as allowed."""
    kept = [c for c in items.columns if c != "accesses"]
    rows = items.select(*kept, F.posexplode("accesses").alias("acc_pos", "a"))
    return rows.filter(F.coalesce("a.is_allowed", F.lit(True)) & F.col("a.type").isNotNull()).select(
        *kept, "acc_pos", F.col("a.type").alias("access_type")
    )


def _tagged(names: str, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("ptype"), n.alias("pname")))


def explode_principals(items: DataFrame, roles: bool = True) -> DataFrame:
    """Users, then groups, then (for access items) roles."""
    kinds = [("users", "user"), ("groups", "group")] + ([("roles", "role")] if roles else [])
    kept = [c for c in items.columns if c not in ("users", "groups", "roles")]
    everyone = F.concat(*[_tagged(names, kind) for names, kind in kinds])
    rows = items.select(*kept, F.posexplode(everyone).alias("prin_pos", "w"))
    return rows.select(*kept, "prin_pos", "w.ptype", "w.pname")
