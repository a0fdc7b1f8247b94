"""The commit log: change rows as Parquet files, and one small JSON file for each commit, written last.

    commits/<number>.json          what a commit did, its LSN, its files, and the catalog if it changed that
    segments/<number>.json         the commits of SEGMENT numbers up to this one, so that a reader opens few files
    changes/<table>/<lsn>-<tx>/    its change rows: commit_lsn, seq, op, pk, old, new
    checkpoints/<table>/<lsn>/     a state, so that reads needn't go back to the start

Commits are numbered without gaps. A commit's file is written under another name and then gets its own, which fails if
that is taken; so a reader sees a commit whole or not at all, and of two writers from one head one has to look again.
Readers go by commit files only, so files of a transaction that failed are never seen. All files are reached through
Hadoop's file systems; on stores without an atomic rename the commit folder needs one that has conditional writes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import state


class Conflict(RuntimeError):
    """Another transaction committed first; SQLSTATE 40001."""

    sqlstate = "40001"


#: Commits that a segment holds.
SEGMENT = 64


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._known: list[dict] = []  # by number, from 1

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def read_json(self, name: str) -> Any:
        """A JSON file of the log's folder; None if it isn't there."""
        fs, at = self._fs(f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: Any) -> bool:
        """Write a JSON file as a whole; False if there is one of that name."""
        folder, _, last = name.rpartition("/")
        fs, target = self._fs(f"{self.path}/{name}")
        _, other = self._fs(f"{self.path}/{folder}/_{last}.{uuid.uuid4().hex}")
        out = fs.create(other, False)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":  # a local rename would overwrite, a link doesn't
                try:
                    os.link(other.toUri().getPath(), target.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(target) and fs.rename(other, target)
        finally:
            fs.delete(other, False)

    def remove(self, name: str) -> None:
        """Remove a folder of the log."""
        fs, at = self._fs(f"{self.path}/{name}")
        fs.delete(at, True)

    def commits(self, upto: int | None = None) -> list[dict]:
        """The records of the commits up to an LSN, in order; each is read once, by segments where there are any."""
        while True:
            n = len(self._known)
            found = self.read_json(f"segments/{n + SEGMENT:020d}.json") if n % SEGMENT == 0 else None
            if found is None:
                one = self.read_json(f"commits/{n + 1:020d}.json")
                found = [one] if one is not None else []
            self._known += found
            if not found:
                break
        return [c for c in self._known if upto is None or c["lsn"] <= upto]

    def head(self) -> int:
        found = self.commits()
        return found[-1]["lsn"] if found else 0

    def catalog(self, lsn: int | None = None) -> dict[str, Any]:
        """The catalog as of a commit: tables, entities and indexes."""
        found = next((c["catalog"] for c in reversed(self.commits(lsn)) if c.get("catalog") is not None), None)
        return json.loads(json.dumps(found)) if found else {"tables": {}, "entities": {}, "indexes": {}}

    def write_changes(self, table: str, changes: DataFrame, lsn: int) -> str:
        """Write change rows (seq, op, pk, old, new) of one table; gives the folder for the commit record."""
        folder = f"changes/{table}/{lsn:020d}-{uuid.uuid4().hex}"
        changes.withColumn("commit_lsn", F.lit(lsn).cast("long")).write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, record: dict, number: int | None = None) -> None:
        """Make a commit visible under the number after the last one that this reader knows; Conflict if it is taken."""
        number = len(self._known) + 1 if number is None else number
        if not self.write_json(f"commits/{number:020d}.json", record):
            raise Conflict(f"commit {number} is taken")
        if number % SEGMENT == 0:
            self.write_json(f"segments/{number:020d}.json", self.commits()[number - SEGMENT : number])

    def changes(self, table: str, upto: int | None = None, after: int = 0) -> DataFrame | None:
        """The change rows of a table in (after, upto]; columns that a file lacks are null. None if there are none.

        Those before a table was dropped belong to another table of its name.
        """
        groups: dict[str, list[str]] = {}
        after = max([after, *(c["lsn"] - 1 for c in self.commits(upto) if table in c["drops"])])
        for c in self.commits(upto):
            if c["lsn"] > after and table in c["files"]:
                groups.setdefault(c["shapes"][table], []).append(f"{self.path}/{c['files'][table]}")
        out: DataFrame | None = None
        for paths in groups.values():  # one read for each shape that the table has had
            df = self.spark.read.parquet(*paths)
            out = df if out is None else aligned(out, df)
        return out

    def base(self, table: str, upto: int) -> tuple[int, DataFrame | None]:
        """The latest checkpoint of a table not after an LSN, and its LSN; without one, the commit that made it anew."""
        least, folder = 0, None
        for c in self.commits(upto):
            if table in c["drops"]:
                least, folder = c["lsn"] - 1, None
            if table in c["checkpoints"]:
                least, folder = c["lsn"], c["checkpoints"][table]
        later = [int(n) for n in self._names(f"checkpoints/{table}") if n.isdigit() and least < int(n) <= upto]
        if later:
            least, folder = later[-1], f"checkpoints/{table}/{later[-1]:020d}"
        return least, self.spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def write_checkpoint(self, table: str, rows: DataFrame, pk: str, lsn: int, tx: str = "") -> str:
        """Write a state; that of a commit being made has its transaction in its name, and counts once that is published."""
        folder = f"checkpoints/{table}/{lsn:020d}" + f"-{tx}" * bool(tx)
        rows.withColumn("pk", F.col(pk)).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return folder

    def state(self, table: str, schema: str, upto: int | None = None) -> DataFrame:
        """The table as of a commit, with _lsn."""
        upto = self.head() if upto is None else upto
        at, base = self.base(table, upto)
        changes = self.changes(table, upto, at)
        if changes is None:
            return base.drop("pk") if base is not None else self.spark.createDataFrame([], f"{schema}, _lsn long")
        return state.state_at(changes, None, base)

    def lsn_at(self, timestamp: float) -> int:
        """The last commit whose time, in seconds, isn't after the given one; 0 if there is none."""
        return max((c["lsn"] for c in self.commits() if c["time"] <= timestamp), default=0)

    def files(self, record: dict) -> list[str]:
        """The folders that a commit's record names."""
        return [*record["files"].values(), *record["checkpoints"].values()]

    def digest(self, folder: str) -> dict:
        """The number of rows of a folder, and two sums over their hashes; equal rows don't cancel."""
        df = self.spark.read.parquet(f"{self.path}/{folder}")
        row = F.to_json(F.struct(*df.columns))
        total = lambda seed: F.coalesce(F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string")
        return df.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first().asDict()

    def backup(self, to: str, lsn: int | None = None, timestamp: float | None = None) -> dict:
        """Copy the log up to a commit, or to the last one at a time in seconds; gives a manifest of what was copied."""
        target, manifest = Ledger(self.spark, to), {}
        if timestamp is not None:
            lsn = self.lsn_at(timestamp)
        for c in self.commits(lsn):
            for folder in self.files(c):
                self.spark.read.parquet(f"{self.path}/{folder}").write.mode("overwrite").parquet(f"{to}/{folder}")
                manifest[folder] = self.digest(folder)
            target.commits()
            target.publish(c)
        return manifest

    def verify(self, manifest: dict) -> list[str]:
        """Folders of a backup whose rows aren't those of the manifest."""
        return [folder for folder, want in manifest.items() if self.digest(folder) != want]

    def new_record(self, lsn: int, tx: str, domains: list[str]) -> dict:
        """A commit's record; `catalog` is for commits that change it."""
        return {"lsn": lsn, "tx": tx, "time": time.time(), "domains": domains, "files": {}, "shapes": {}, "operations": [], "checkpoints": {}, "drops": [], "catalog": None}


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both change tables as one, with old and new structs of all the columns of either."""
    fields = {f.name: f.dataType for df in (a, b) for f in df.schema["new"].dataType.fields}

    def widened(df: DataFrame) -> DataFrame:
        for side in ("old", "new"):
            have = set(df.schema[side].dataType.names)
            wide = F.struct(*[(F.col(side).getField(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
            df = df.withColumn(side, F.when(F.col(side).isNotNull(), wide))
        return df

    return widened(a).unionByName(widened(b))
