"""Following a commit log as a stream; the checkpoint is the point to resume from."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the data that is there now, written to files and read back.

    In append mode the file sink writes each row once; in complete mode each batch replaces the result.
    """
    path, point = scratch(spark, "drained"), scratch(spark, "drain")
    writer = stream.writeStream.option("checkpointLocation", point).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


COMMITS = "lsn long, tx string, time double, domains array<string>, operations array<array<string>>, files map<string, string>"


def follow_commits(ledger, from_lsn: int | None = None, to_lsn: int | None = None) -> DataFrame:
    """A stream of commit records; files of transactions that failed have no record and so never show."""
    rows = ledger.spark.readStream.schema(COMMITS).json(f"{ledger.path}/commits")
    if from_lsn is not None:
        rows = rows.where(F.col("lsn") >= from_lsn)
    return rows if to_lsn is None else rows.where(F.col("lsn") <= to_lsn)


def follow_entity(session, domain: str, name: str, handle, checkpoint: str, pk=None, from_lsn: int | None = None, to_lsn: int | None = None, once: bool = True, limit: int | None = None):
    """Call handle(changes, batch number) with an entity's changes as commits arrive; the checkpoint is where it resumes.
    After `limit` changes it stops.

    A batch is the commits that are new since the last one; after a failure the same batch comes again, so a handler
    that goes by (commit_lsn, root_pk) sees each change once.
    """

    seen, started = [0], []

    def run(batch: DataFrame, number: int) -> None:
        low, high = batch.agg(F.min("lsn"), F.max("lsn")).first()
        if low is None or limit is not None and seen[0] >= limit:
            return
        found = session.entity_changes(domain, name, pk, low, high)
        if limit is not None:
            found = found.limit(limit - seen[0])
            seen[0] += found.count()
        handle(found, number)
        if limit is not None and seen[0] >= limit and started:
            threading.Thread(target=started[0].stop, daemon=True).start()

    writer = follow_commits(session.ledger, from_lsn, to_lsn).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    started.append(writer.trigger(availableNow=True).start() if once else writer.start())
    return started[0]


def replicate(ledger, to: str, checkpoint: str, once: bool = True):
    """Copy commits to another log as they arrive, in order; commits that it has are passed over."""
    from tidemark.sources.ledger import Conflict, Ledger

    def run(batch: DataFrame, number: int) -> None:
        target = Ledger(ledger.spark, to)
        high = batch.agg(F.max("lsn")).first()[0]
        for record in ledger.commits(high):
            if record["lsn"] <= target.head():
                continue
            for folder in ledger.files(record):
                ledger.spark.read.parquet(f"{ledger.path}/{folder}").write.mode("overwrite").parquet(f"{to}/{folder}")
            try:
                target.publish(record)
            except Conflict:
                pass  # an earlier run of this batch got this far

    writer = follow_commits(ledger).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
