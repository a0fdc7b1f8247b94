"""INSERT, UPDATE, DELETE, upsert and TRUNCATE as change rows computed from a state; nothing is written here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = ["op", "pk", "old", "new"]
#: A column of staged rows that holds their order in the statement.
ORDER = "__order"


def _row(columns: Sequence[str], given: Mapping[str, Column] | None = None) -> Column:
    return F.struct(*[(given or {}).get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def _nothing(df: DataFrame, columns: Sequence[str]) -> Column:
    kind = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in columns)
    return F.lit(None).cast(f"struct<{kind}>")


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_lsn", ORDER)]


def insert(staged: DataFrame, pk: str) -> DataFrame:
    columns = _columns(staged)
    return staged.select(F.lit("INSERT").alias("op"), F.col(pk).alias("pk"), _nothing(staged, columns).alias("old"), _row(columns).alias("new"))


def update(state: DataFrame, pk: str, assignments: Mapping[str, Column], predicate: Column | None = None) -> DataFrame:
    """Assignments apply from left to right, each seeing the earlier ones. A changed key is a DELETE and an INSERT."""
    columns = _columns(state)
    rows = state if predicate is None else state.where(predicate)
    rows = rows.select(_row(columns).alias("__old"), *[F.col(f"`{c}`") for c in columns])
    for name, value in assignments.items():
        rows = rows.withColumn(name, value.cast(state.schema[name].dataType))
    rows = rows.select("__old", _row(columns).alias("__new"))
    moved = ~F.col(f"__old.{pk}").eqNullSafe(F.col(f"__new.{pk}"))
    nothing = _nothing(state, columns)
    entry = lambda op, key, old, new: F.struct(F.lit(op).alias("op"), key.alias("pk"), old.alias("old"), new.alias("new"))
    old, new = F.col("__old"), F.col("__new")
    both = F.array(entry("DELETE", old[pk], old, nothing), entry("INSERT", new[pk], nothing, new))
    return rows.select(F.explode(F.when(moved, both).otherwise(F.array(entry("UPDATE", new[pk], old, new)))).alias("c")).select("c.*")


def delete(state: DataFrame, pk: str, predicate: Column | None = None) -> DataFrame:
    columns = _columns(state)
    rows = state if predicate is None else state.where(predicate)
    return rows.select(F.lit("DELETE").alias("op"), F.col(pk).alias("pk"), _row(columns).alias("old"), _nothing(state, columns).alias("new"))


def truncate(state: DataFrame, pk: str) -> DataFrame:
    """One DELETE for each row."""
    return delete(state, pk)


def upsert(state: DataFrame, staged: DataFrame, pk: str, assignments: Mapping[str, Column | str] | None = None, order: str | None = None, on: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (on) DO NOTHING, or DO UPDATE SET with `assignments`: a Column, or "EXCLUDED.column".

    `on` is the primary key unless given. Staged rows apply one after another by `order`: of several with one key the first
    is inserted if the key is new, and each later one updates. Rows whose `on` is null meet no other.
    """
    columns, on = _columns(state), on or pk
    by = F.monotonically_increasing_id() if order is None else F.col(order)
    rows = staged.select(F.col(on).alias("__key"), _row(columns).alias("__row"), by.alias("__by"))
    new = rows.where("__key IS NOT NULL").groupBy("__key")
    new = new.agg(F.min_by("__row", "__by").alias("__first"), F.max_by("__row", "__by").alias("__last"), F.count("*").alias("__n"))
    old = state.select(F.col(on).alias("__on"), F.col(pk).alias("__pk"), _row(columns).alias("__old"))
    met = new.join(old, F.col("__key") == F.col("__on"), "left")
    value = lambda v: F.col("__last").getField(v.split(".", 1)[1]) if isinstance(v, str) else v

    def merged(row: str) -> Column:
        """`row` with what the last staged row assigns; other expressions see the columns of `row`."""
        return F.struct(*[(value(assignments[c]) if c in assignments else F.col(row).getField(c)).cast(state.schema[c].dataType).alias(c) for c in columns])

    nothing = _nothing(state, columns)
    fresh = met.where("__pk IS NULL")
    made = F.col("__first") if not assignments else F.when(F.col("__n") > 1, merged("__first")).otherwise(F.col("__first"))
    if assignments:
        fresh = fresh.select("*", "__first.*")
    inserted = fresh.select(F.lit("INSERT").alias("op"), made.alias("__new"))
    unmet = rows.where("__key IS NULL").select(F.lit("INSERT").alias("op"), F.col("__row").alias("__new"))
    inserted = inserted.unionByName(unmet).select("op", F.col(f"__new.`{pk}`").alias("pk"), nothing.alias("old"), F.col("__new").alias("new"))
    if assignments is None:
        return inserted
    changed = met.where("__pk IS NOT NULL").select("*", "__old.*")
    changed = changed.select(F.lit("UPDATE").alias("op"), F.col("__pk").alias("pk"), F.col("__old").alias("old"), merged("__old").alias("new"))
    return inserted.unionByName(changed)


def apply(state: DataFrame, changes: DataFrame, pk: str, lsn: int) -> DataFrame:
    """The state after one commit of changes, rows of which carry its _lsn."""
    kept = state.join(changes.select(F.col("pk").alias("__pk")).distinct(), F.col(pk) == F.col("__pk"), "left_anti")
    made = changes.where("op <> 'DELETE'").select("new.*").withColumn("_lsn", F.lit(lsn).cast("long"))
    return kept.unionByName(made)
