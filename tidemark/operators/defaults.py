"""Column defaults that depend on the table or the transaction; fixed once, when rows are staged."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def autoincrement(staged: DataFrame, state: DataFrame, column: str, order: str) -> DataFrame:
    """staged with `column`: the numbers after the table's maximum, in the order of another column.

    Rows are range-partitioned by the order, numbered within partitions, and shifted by the sizes of the partitions
    before, so no task sees all rows.
    """
    top = state.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("__top"))
    placed = staged.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    out = numbered.join(F.broadcast(before), "__part").join(F.broadcast(top))
    return out.withColumn(column, (F.col("__top") + F.col("__before") + F.col("__rn")).cast("long")).drop("__part", "__rn", "__before", "__top")


def uuid7(at_ms: int | None = None) -> str:
    """A UUID of version 7, ordered by its time in milliseconds."""
    ms = int(time.time() * 1000) if at_ms is None else at_ms
    raw = bytearray(ms.to_bytes(6, "big") + os.urandom(10))
    raw[6], raw[8] = raw[6] & 0x0F | 0x70, raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))
