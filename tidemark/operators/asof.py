"""As-of joins with versioned foreign keys.

The join is an equi-join on the key with the interval as a further condition, so Spark keeps a hash or sort-merge join;
a key's versions, not its table, bound what a row is compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_join(base: DataFrame, versions: DataFrame, key: Column, lsn: Column, how: str = "inner") -> DataFrame:
    """base with `version` (valid_from, valid_to, row), the row of that key as of the commit `lsn`; now if that is null.

    `versions` comes from state.intervals.
    """
    base = base.withColumns({"__key": key, "__lsn": lsn})
    right = versions.select("pk", F.struct("valid_from", "valid_to", "row").alias("version"))
    v = F.col("version")
    holds = F.when(F.col("__lsn").isNull(), v["valid_to"].isNull()).otherwise(
        (v["valid_from"] <= F.col("__lsn")) & (v["valid_to"].isNull() | (F.col("__lsn") < v["valid_to"]))
    )
    return base.join(right, (F.col("__key") == F.col("pk")) & holds, how).drop("__key", "__lsn", "pk")


def with_entity_lsn(base: DataFrame, entity_versions: DataFrame, key: Column, version: Column, name: str = "__as_of_lsn") -> DataFrame:
    """base with the commit of the entity version that each row refers to; null where the version is null or unknown.

    Joins to the entity's other tables use the same commit.
    """
    base = base.withColumns({"__key": key, "__version": version})
    right = entity_versions.select(F.col("root_pk").alias("__root"), F.col("version").alias("__number"), F.col("commit_lsn").alias(name))
    return base.join(right, (F.col("__key") == F.col("__root")) & (F.col("__version") == F.col("__number")), "left").drop("__key", "__version", "__root", "__number")
