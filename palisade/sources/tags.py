"""Tag definitions and resource tags, in both of their JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.sources.documents import with_root_keys


def _raw(name: str) -> Column:
    return F.from_json("json", f"{name} STRING")[name]


def read_tag_definitions(docs: DataFrame) -> DataFrame:
    """(source, tag_pos, tag): one row per defined tag, from an object or a list."""
    return _definitions(docs).select("source", "tag_pos", "tag")


def read_tag_attributes(docs: DataFrame) -> DataFrame:
    """(source, tag, attr_pos, attr_key, attr_value) in file order."""
    return _definitions(docs).select(
        "source", "tag", F.posexplode("attrs").alias("attr_pos", "attr_key", "attr_value")
    )


def _definitions(docs: DataFrame) -> DataFrame:
    entry = "STRUCT<name: STRING, attributeDefs: MAP<STRING, STRING>>"
    raw = _raw("tagDefinitions")
    as_list = F.filter(F.from_json(raw, f"ARRAY<{entry}>"), lambda e: e["name"].isNotNull())
    as_map = F.transform(
        F.map_entries(F.from_json(raw, f"MAP<STRING, {entry}>")),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["attributeDefs"].alias("attributeDefs")),
    )
    entries = F.when(raw.startswith("{"), as_map).otherwise(as_list)
    rows = with_root_keys(docs).filter("keys IS NOT NULL").select("source", F.posexplode(entries).alias("tag_pos", "e"))
    return rows.select("source", "tag_pos", F.col("e.name").alias("tag"), F.col("e.attributeDefs").alias("attrs"))


def read_resource_tags(docs: DataFrame) -> DataFrame:
    """(source, path, path_pos, tag_pos, tag).

    The object form is path -> tags. The list form builds the path from its parts:
    no column means ``.*``, no database means ``table.column``, no table drops the
    entry, and a later entry for a path replaces the earlier one but keeps its place.
    """
    raw = _raw("resourceTags")
    as_map = F.transform(
        F.map_entries(F.from_json(raw, "MAP<STRING, ARRAY<STRING>>")),
        lambda e: F.struct(e["key"].alias("path"), e["value"].alias("tags")),
    )
    listed = F.from_json(
        raw,
        "ARRAY<STRUCT<resource: STRUCT<database: STRING, table: STRING, column: ARRAY<STRING>>, tags: ARRAY<STRING>>>",
    )

    def paths(entry: Column) -> Column:
        r = entry["resource"]
        columns = F.when(F.size(r["column"]) > 0, r["column"]).otherwise(F.array(F.lit("*")))
        base = F.concat_ws(".", F.when(F.length(r["database"]) > 0, r["database"]), r["table"])
        built = F.transform(
            columns, lambda c: F.struct(F.concat_ws(".", base, c).alias("path"), entry["tags"].alias("tags"))
        )
        return F.when(F.length(r["table"]) > 0, built).otherwise(F.slice(built, 1, 0))

    entries = F.when(raw.startswith("{"), as_map).otherwise(F.flatten(F.transform(listed, paths)))
    rows = (
        with_root_keys(docs)
        .filter("keys IS NOT NULL")
        .select("source", F.posexplode(entries).alias("pos", "e"))
        .select("source", "pos", F.col("e.path").alias("path"), F.col("e.tags").alias("tags"))
    )
    kept = rows.groupBy("source", "path").agg(
        F.min("pos").alias("path_pos"), F.max_by("tags", "pos").alias("tags")
    )
    return kept.select("source", "path", "path_pos", F.posexplode("tags").alias("tag_pos", "tag"))
