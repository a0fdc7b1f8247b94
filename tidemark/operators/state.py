"""State, history and validity of a versioned table, from its change rows.

A change row is (commit_lsn, seq, op, pk, old, new): op is INSERT, UPDATE or DELETE, old and new are structs of the
table's columns, and (commit_lsn, seq) orders the changes. All functions are lazy plans: filters on commit_lsn reach the
Parquet scan, and one shuffle by primary key gives a state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state_at(changes: DataFrame, lsn: int | None = None, checkpoint: DataFrame | None = None) -> DataFrame:
    """The table as of a commit, or at head: the last change of each key, unless it is a DELETE; with _lsn.

    `checkpoint` is a state written earlier (with its columns, `_lsn` and `pk`); then `changes` need only be those after it.
    """
    seen = changes if lsn is None else changes.where(F.col("commit_lsn") <= F.lit(lsn))
    seen = seen.select("pk", "commit_lsn", F.col("seq").cast("long").alias("seq"), "op", "new")
    if checkpoint is not None:
        columns = [c for c in checkpoint.columns if c not in ("_lsn", "pk")]
        base = checkpoint.select("pk", F.col("_lsn").alias("commit_lsn"), F.lit(-1).cast("long").alias("seq"), F.lit("INSERT").alias("op"), F.struct(*columns).alias("new"))
        seen = seen.unionByName(base)
    last = seen.groupBy("pk").agg(F.max_by(F.struct("op", "new", "commit_lsn"), F.struct("commit_lsn", "seq")).alias("last"))
    return last.where("last.op <> 'DELETE'").select("last.new.*", F.col("last.commit_lsn").alias("_lsn"))


def lsn_at(commits: DataFrame, timestamp) -> DataFrame:
    """One row: the greatest commit_lsn whose timestamp isn't after the given one, 0 if there is none."""
    return commits.where(F.col("commit_timestamp") <= timestamp).agg(F.coalesce(F.max("commit_lsn"), F.lit(0)).cast("long").alias("lsn"))


def history(changes: DataFrame) -> DataFrame:
    """Every change with the row it left, or the row a DELETE removed: __operation, __commit_lsn and the columns."""
    image = F.when(F.col("op") == "DELETE", F.col("old")).otherwise(F.col("new"))
    return changes.select(F.col("op").alias("__operation"), F.col("commit_lsn").alias("__commit_lsn"), image.alias("image")).select("__operation", "__commit_lsn", "image.*")


def intervals(changes: DataFrame) -> DataFrame:
    """Each version of each row with the commits it holds for: pk, valid_from (its _lsn), valid_to (null: still), row."""
    by = Window.partitionBy("pk").orderBy("commit_lsn", "seq")
    ends = changes.select("pk", "commit_lsn", "op", F.col("new").alias("row"), F.lead("commit_lsn").over(by).alias("valid_to"))
    return ends.where("op <> 'DELETE' AND (valid_to IS NULL OR valid_to > commit_lsn)").select("pk", F.col("commit_lsn").alias("valid_from"), "valid_to", "row")


def row_lsn(changes: DataFrame, pk) -> DataFrame:
    """One row: the _lsn of the current row of a key, null if there is none."""
    own = changes.where(F.col("pk") == F.lit(pk)).agg(F.max_by(F.struct("op", "commit_lsn"), F.struct("commit_lsn", "seq")).alias("last"))
    return own.select(F.when(F.col("last.op") != "DELETE", F.col("last.commit_lsn")).alias("row_lsn"))


def timeline(changes_by_table: dict[str, DataFrame], commits: DataFrame | None = None) -> DataFrame:
    """commit_lsn and the array of {table_name, operation, n} that each commit made, tables in order."""
    parts = [c.select("commit_lsn", F.lit(name).alias("table_name"), F.col("op").alias("operation")) for name, c in changes_by_table.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    counted = whole.groupBy("commit_lsn", "table_name", "operation").agg(F.count("*").alias("n"))
    out = counted.groupBy("commit_lsn").agg(F.array_sort(F.collect_list(F.struct("table_name", "operation", "n"))).alias("changes"))
    return out if commits is None else commits.join(out, "commit_lsn", "left")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; none if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
