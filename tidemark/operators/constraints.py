"""Constraint checks as anti and semi joins: each gives the staged rows that break a constraint, with an SQLSTATE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SQLSTATE codes.
NOT_NULL, UNIQUE, FOREIGN_KEY, CHECK = "23502", "23505", "23503", "23514"


class ConstraintError(ValueError):
    """A write breaks a constraint; `sqlstate` tells which kind."""

    def __init__(self, sqlstate: str, message: str) -> None:
        super().__init__(message)
        self.sqlstate = sqlstate


def null_violations(staged: DataFrame, column: str) -> DataFrame:
    return staged.where(F.col(column).isNull()).withColumn("sqlstate", F.lit(NOT_NULL))


def unique_violations(staged: DataFrame, column: str, state: DataFrame | None = None) -> DataFrame:
    """Staged values that occur twice, or that the table has; nulls never clash. One row for each value."""
    twice = staged.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column)
    if state is not None:
        taken = staged.where(F.col(column).isNotNull()).join(state.select(column).distinct(), column, "left_semi").select(column)
        twice = twice.unionByName(taken).distinct()
    return twice.withColumn("sqlstate", F.lit(UNIQUE))


def primary_key_violations(staged: DataFrame, column: str, state: DataFrame | None = None) -> DataFrame:
    """Values of a primary key that are null, occur twice, or that the table has; one row for each."""
    nulls = null_violations(staged.select(column), column).distinct()
    return nulls.unionByName(unique_violations(staged, column, state))


def foreign_key_violations(staged: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Staged rows whose reference is neither null nor a value of the parent's column."""
    known = parent.select(F.col(parent_column).alias("__known")).distinct()
    lost = staged.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__known"), "left_anti")
    return lost.withColumn("sqlstate", F.lit(FOREIGN_KEY))


def check_violations(staged: DataFrame, predicate: str) -> DataFrame:
    """Staged rows for which the predicate is false; unknown passes."""
    return staged.where(~F.coalesce(F.expr(predicate), F.lit(True))).withColumn("sqlstate", F.lit(CHECK))
