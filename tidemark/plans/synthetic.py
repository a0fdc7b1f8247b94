"""Change logs that are pure functions of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import entity


def _change(at: Column, op: str, pk: str, old: Column, new: Column) -> Column:
    return F.struct(at.cast("long").alias("commit_lsn"), F.lit(0).alias("seq"), F.lit(op).alias("op"), F.col(pk).alias("pk"), old.alias("old"), new.alias("new"))


def orders_log(orders: DataFrame) -> DataFrame:
    """INSERT of each order as new; UPDATE to its status if its key divides by 3; DELETE if it divides by 10."""
    key = F.col("o_orderkey")
    row = lambda status: F.struct("o_orderkey", "o_custkey", status.alias("o_orderstatus"))
    first, last = row(F.lit("N")), row(F.col("o_orderstatus"))
    nothing = F.lit(None).cast("struct<o_orderkey: bigint, o_custkey: bigint, o_orderstatus: string>")
    updated = key % 3 == 0
    changes = F.array(
        _change(key + 1, "INSERT", "o_orderkey", nothing, first),
        F.when(updated, _change(key + 1_000_000, "UPDATE", "o_orderkey", first, last)),
        F.when(key % 10 == 0, _change(key + 2_000_000, "DELETE", "o_orderkey", F.when(updated, last).otherwise(first), nothing)),
    )
    return orders.select(F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("c.*")


def customers_log(customers: DataFrame) -> DataFrame:
    """INSERT of each customer at its key; UPDATE at a million and its key, which marks the name."""
    key = F.col("c_custkey")
    row = lambda name: F.struct("c_custkey", name.alias("c_name"))
    first, last = row(F.col("c_name")), row(F.concat("c_name", F.lit("*")))
    nothing = F.lit(None).cast("struct<c_custkey: bigint, c_name: string>")
    changes = F.array(_change(key, "INSERT", "c_custkey", nothing, first), _change(key + 1_000_000, "UPDATE", "c_custkey", first, last))
    return customers.select(F.explode(changes).alias("c")).select("c.*")


def commit_time(lsn: str) -> Column:
    """Commits a second apart from the start of 2024."""
    return F.timestamp_add("SECOND", F.col(lsn), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def user_versions(events: DataFrame) -> DataFrame:
    """Versions of users: each event is a commit that touches its user's row and the event's."""
    row = F.struct("event_id", "user_id")
    nothing = F.lit(None).cast("struct<event_id: bigint, user_id: bigint>")
    log = events.select(_change(F.col("event_id") + 1, "INSERT", "event_id", nothing, row).alias("c")).select("c.*")
    users = log.select("commit_lsn", "seq", "op", F.col("new.user_id").alias("pk"), "old", "new")
    return entity.versions(entity.touches(users, "users"), entity.touches(log, "events", [("user_id", users)]))


def lines_with_reference(lineitem: DataFrame) -> DataFrame:
    """Lines that refer to their order's first commit, its second, or to none."""
    n, key = F.col("l_linenumber") % 4, F.col("l_orderkey")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(n == 0, None).when(n == 1, key + 1).otherwise(key + 1_000_000).cast("long").alias("ref"))


def stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
