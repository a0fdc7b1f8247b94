"""Entities: a root table with member tables that reach it through foreign keys, versioned as a whole.

A commit gives each root key that it touches one new version, with the sorted set of touched tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of_join
from tidemark.operators.state import intervals


def touches(changes: DataFrame, table: str, path: Sequence[tuple[str, DataFrame]] = ()) -> DataFrame:
    """root_pk, commit_lsn and table_name of each change of a member table.

    `path` leads to the root: (foreign key column, changes of the table it refers to) for each hop; the root's own path
    is empty. Keys are those at the commit: of the removed row for a DELETE, else of the new one.
    """
    if not path:
        return changes.select(F.col("pk").alias("root_pk"), "commit_lsn", F.lit(table).alias("table_name"))
    image = F.when(F.col("op") == "DELETE", F.col("old")).otherwise(F.col("new"))
    at = changes.select("commit_lsn", image.getField(path[0][0]).alias("key"))
    for (_, parent), (column, _) in zip(path, path[1:]):
        met = as_of_join(at, intervals(parent), F.col("key"), F.col("commit_lsn"), "left")
        at = met.select("commit_lsn", F.col("version.row").getField(column).alias("key"))
    return at.where("key IS NOT NULL").select(F.col("key").alias("root_pk"), "commit_lsn", F.lit(table).alias("table_name"))


def versions(*touched: DataFrame) -> DataFrame:
    """root_pk, version (1, 2, 3 ...), commit_lsn and tables, from the touches of all member tables."""
    whole = touched[0]
    for part in touched[1:]:
        whole = whole.unionByName(part)
    commits = whole.groupBy("root_pk", "commit_lsn").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))
    by = Window.partitionBy("root_pk").orderBy("commit_lsn")
    return commits.select("root_pk", F.row_number().over(by).cast("bigint").alias("version"), "commit_lsn", "tables")


def heads(entity_versions: DataFrame) -> DataFrame:
    """The latest version and its commit for each root key."""
    return entity_versions.groupBy("root_pk").agg(F.max("version").alias("version"), F.max("commit_lsn").alias("head_lsn"))


def version_lsn(entity_versions: DataFrame, root_pk, version: int) -> DataFrame:
    """The commit of one version of one root."""
    return entity_versions.where((F.col("root_pk") == F.lit(root_pk)) & (F.col("version") == version)).select("commit_lsn")


def change_feed(entity_versions: DataFrame, domain: str, entity: str, from_lsn: int | None = None, to_lsn: int | None = None, root_pk=None) -> DataFrame:
    """The entity's changes between two commits, both included: commit_lsn, domain, entity, root_pk, entity_version, tables."""
    rows = entity_versions
    if from_lsn is not None:
        rows = rows.where(F.col("commit_lsn") >= from_lsn)
    if to_lsn is not None:
        rows = rows.where(F.col("commit_lsn") <= to_lsn)
    if root_pk is not None:
        rows = rows.where(F.col("root_pk") == F.lit(root_pk))
    return rows.select(
        "commit_lsn", F.lit(domain).alias("domain"), F.lit(entity).alias("entity"), "root_pk", F.col("version").alias("entity_version"), F.to_json("tables").alias("tables")
    )
