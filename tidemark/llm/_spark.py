"""What the operators share: table access, and cutting lineage in the folder that all executors see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch

#: White space that separates words, fixed by the contracts: space, and the control characters 9 to 13.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """The words of a text, unchanged, as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, spark.checkpoint.dir, whose files go when the session's JVM ends."""
    return scratch(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again, so that a lost executor costs no recomputation of it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
