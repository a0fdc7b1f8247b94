"""A session over a commit log: SQL with domains, time travel, row history, entities and transactions."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import access, asof, constraints, dml, entity, state
from tidemark.operators.constraints import ConstraintError
from tidemark.operators.defaults import autoincrement, uuid7
from tidemark.plans import dialect, system
from tidemark.plans import statements as S
from tidemark.plans.names import DomainError, split_imports
from tidemark.sources.ledger import Conflict, Ledger, aligned

#: How often a transaction looks again at a log that others write to, before it gives up.
TRIES = 10
_WRITES = S.DDL | {"insert", "update", "delete", "truncate", "append"}


class Transaction:
    """Queued statements of one transaction, applied together at COMMIT."""

    def __init__(self, domains: list[str], head: int) -> None:
        self.domains, self.head, self.queue = domains, head, []
        self.returned: DataFrame | None = None  # rows of the last INSERT ... RETURNING

    def rollback_to(self, name: str) -> None:
        for i in range(len(self.queue) - 1, -1, -1):
            if self.queue[i] == ("savepoint", name):
                del self.queue[i + 1 :]
                return
        raise ValueError(f"no savepoint {name}")


class _Taken(Exception):
    """Another commit came first."""


class Session:
    """`policy` and `principal` are optional: without a policy everything is allowed."""

    def __init__(self, spark: SparkSession, path: str, policy: access.Policy | None = None, principal: str | None = None) -> None:
        self.spark, self.ledger, self.tx = spark, Ledger(spark, path), None
        self.domains: list[str] = []
        self.policy, self.principal = policy, principal
        self.settings: dict[str, str] = {}
        self.counts: Counter[str] = Counter()  # statements by kind
        self.strategies: Counter[str] = Counter()  # how tables were read
        self.times: dict[str, list[float]] = {"read": [], "write": []}  # the latest ones, in milliseconds

    def _allow(self, needed: str | None) -> None:
        if self.policy is not None:
            self.policy.check(self.principal, needed)

    # Reads

    def head(self) -> int:
        return self.ledger.head()

    def table(self, name: str, lsn: int | None = None) -> DataFrame:
        """A table, domain.table, as of a commit or at head; with _lsn."""
        schema = self._definition(name, lsn)["schema"]
        _, base = self.ledger.base(name, self.head() if lsn is None else lsn)
        self.strategies["log" if base is None else "checkpoint and log"] += 1
        return self.ledger.state(name, schema, lsn)

    def as_of(self, text: str, lsn: int, domains: list[str] | None = None) -> DataFrame:
        """A query over every table as of one commit."""
        imports, text = split_imports(text)
        return dialect.query(self.spark, text, self._binder(min(lsn, self.head()), self.domains if domains is None else domains, imports), self._calls())

    def history(self, name: str, where: str | None = None) -> DataFrame:
        """Every change of a table in order of commits, with the row it left or removed."""
        self._allow(access.HISTORY)
        changes = self.ledger.changes(name)
        rows = state.history(changes) if changes is not None else self.spark.createDataFrame([], f"__operation string, __commit_lsn long, {self._definition(name)['schema']}")
        return (rows if where is None else rows.where(dialect.expression(where))).orderBy("__commit_lsn")

    def row_lsn(self, name: str, pk) -> int | None:
        definition = self._definition(name)
        row = self.table(name).where(F.col(definition["pk"]) == F.lit(pk)).select("_lsn").first()
        return row[0] if row else None

    def entity_versions(self, domain: str, name: str, lsn: int | None = None) -> DataFrame:
        """root_pk, version, commit_lsn and tables of an entity."""
        definition = self.ledger.catalog(lsn)["entities"].get(f"{domain}.{name}")
        if definition is None:
            raise ValueError(f"no entity {domain}.{name}")
        touched = []
        for table, hops in definition["paths"].items():
            changes = self.ledger.changes(f"{domain}.{table}", lsn)
            parents = [(column, self.ledger.changes(f"{domain}.{parent}", lsn)) for column, parent in hops]
            if changes is not None and all(p is not None for _, p in parents):
                touched.append(entity.touches(changes, table, parents))
        return entity.versions(*touched) if touched else self.spark.createDataFrame([], "root_pk long, version long, commit_lsn long, tables array<string>")

    def entity_version(self, domain: str, name: str, pk) -> int | None:
        return self.entity_versions(domain, name).where(F.col("root_pk") == F.lit(pk)).agg(F.max("version")).first()[0]

    def entity_head_lsn(self, domain: str, name: str, pk) -> int | None:
        return self.entity_versions(domain, name).where(F.col("root_pk") == F.lit(pk)).agg(F.max("commit_lsn")).first()[0]

    def entity_version_lsn(self, domain: str, name: str, pk, version: int) -> int | None:
        row = entity.version_lsn(self.entity_versions(domain, name), pk, version).first()
        return row[0] if row else None

    def entity_changes(self, domain: str, name: str, pk=None, from_lsn: int | None = None, to_lsn: int | None = None) -> DataFrame:
        return entity.change_feed(self.entity_versions(domain, name), domain, name, from_lsn, to_lsn, pk).orderBy("commit_lsn", "root_pk", "entity_version")

    def resolve_reference(self, name: str, pk) -> int | None:
        """What a versioned foreign key to this row would capture now."""
        domain, table = name.split(".")
        for key, definition in self.ledger.catalog()["entities"].items():
            if key.startswith(f"{domain}.") and table in definition["paths"]:
                if definition["root"] != table:
                    raise ValueError(f"{name} is a member of entity {key}, not its root")
                return self.entity_version(domain, key.split(".")[1], pk)
        return self.row_lsn(name, pk)

    def _referring(self, name: str, lsn: int | None = None) -> DataFrame:
        """A table with a hidden column for each of its versioned foreign keys: the commit that it refers to, null for now."""
        rows, catalog = self.table(name, lsn), self.ledger.catalog(lsn)
        for v in self._definition(name, catalog=catalog)["versioned"]:
            column, found = dialect.HIDDEN + v["lsn_column"], self._entity_of(v["table"], catalog)
            if found is None:
                rows = rows.withColumn(column, F.col(v["lsn_column"]))
            else:
                rows = asof.with_entity_lsn(rows, self.entity_versions(*found, lsn), F.col(v["column"]), F.col(v["lsn_column"]), column)
        return rows

    @staticmethod
    def _entity_of(root: str, catalog: dict) -> tuple[str, str] | None:
        """Domain and name of the entity whose root a table is."""
        domain, table = root.split(".")
        return next((tuple(k.split(".")) for k, e in catalog["entities"].items() if k.startswith(f"{domain}.") and e["root"] == table), None)

    def versioned_join(self, base: str, how: str = "inner", column: str | None = None) -> DataFrame:
        """A table with `version`: the row that a versioned foreign key refers to, as of the captured version. The key is
        the table's first unless its column is named."""
        self._allow(access.HISTORY)
        v = next(v for v in self._definition(base)["versioned"] if column in (None, v["column"]))
        rows = self._referring(base)
        out = asof.as_of_join(rows, state.intervals(self.ledger.changes(v["table"])), F.col(v["column"]), F.col(dialect.HIDDEN + v["lsn_column"]), how)
        return out.drop(*[c for c in out.columns if c.startswith(dialect.HIDDEN)])

    def _versioned(self, base: str, right: str, lsn: int) -> tuple[DataFrame, str, DataFrame] | None:
        """For a join of two tables of different domains: base with the commits it refers to, the column that holds them,
        and the versions of right. Members of an entity follow the reference to its root."""
        catalog = self.ledger.catalog(lsn)
        if base not in catalog["tables"] or right not in catalog["tables"] or base.split(".")[0] == right.split(".")[0]:
            return None
        for v in catalog["tables"][base]["versioned"]:
            found = self._entity_of(v["table"], catalog)
            members = [f"{found[0]}.{t}" for t in catalog["entities"][".".join(found)]["paths"]] if found else [v["table"]]
            changes = self.ledger.changes(right, lsn) if right in members else None
            if changes is not None:
                h = dialect.HIDDEN
                versions = state.intervals(changes).select("row.*", F.col("valid_from").alias("_lsn"), F.col("valid_from").alias(f"{h}from"), F.col("valid_to").alias(f"{h}to"))
                return self._referring(base, lsn), h + v["lsn_column"], versions
        return None

    def timeline(self, from_lsn: int = 0, to_lsn: int | None = None, domain: str | None = None) -> DataFrame:
        """A row for each commit and operation."""
        rows = [
            (c["lsn"], c["tx"], datetime.fromtimestamp(c["time"], timezone.utc).replace(tzinfo=None), *name.split("."), operation)
            for c in self.ledger.commits(to_lsn) if c["lsn"] >= from_lsn and (domain is None or domain in c["domains"]) for name, operation in c["operations"]
        ]
        return self.spark.createDataFrame(rows, "commit_lsn long, tx_id string, commit_timestamp timestamp_ntz, domain string, table_name string, operation string")

    def schema_snapshot(self, lsn: int | None = None) -> DataFrame:
        """A row for each column of each table."""
        return self._system("admin.schema_snapshot", lsn)

    def _system(self, name: str, lsn: int | None = None, args: list | None = None) -> DataFrame | None:
        """A system relation, or the rows of a system function; None if there is none of that name."""
        frame, name = self.spark.createDataFrame, system.full_name(name)
        if name in system.OF_CATALOG and args is None:
            schema, rows = system.OF_CATALOG[name](system.Catalog(self.ledger.catalog(lsn)))
            return frame(rows, schema)
        if name == "admin.row_history" and args is not None and len(args) == 1:
            found = S.history_of(S.normalise(str(args[0]))) or (str(args[0]).lower(), None)
            return self.history(self._qualified(found[0], self.domains), found[1])
        if name == "admin.entity_version_history" and args is not None and len(args) == 3:
            self._allow(access.HISTORY)
            rows = self.entity_versions(str(args[0]), str(args[1]), lsn).where(F.col("root_pk") == F.lit(args[2]))
            return rows.select("version", "commit_lsn", "tables")
        if name == "admin.replay_to_lsn" and args is not None and len(args) == 1:
            self._allow(access.HISTORY)
            at = min(int(args[0]), self.head())
            return frame([(int(args[0]), at, len(self.ledger.commits(at)), len(self.ledger.catalog(at)["tables"]))], "requested_lsn long, replayed_lsn long, commits long, tables long")
        if name == "admin.timeline_commits":
            return self.timeline(*(args or []))
        if args is not None:
            return None
        if name == "admin.scan_strategy_stats":
            return frame(sorted(self.strategies.items()), "strategy string, scans long")
        if name == "admin.engine_stats":
            rows = [("head_lsn", float(self.head())), ("commits", float(len(self.ledger.commits()))), *((f"statements_{k}", float(n)) for k, n in sorted(self.counts.items()))]
            for kind, seen in sorted(self.times.items()):
                rows += [(f"{kind}_p{p}_ms", sorted(seen)[min(len(seen) - 1, len(seen) * p // 100)]) for p in (50, 95, 99) if seen]
            return frame(rows, "name string, value double")
        if name == "admin.replication_status":
            return frame([("local", self.head())], "node string, applied_lsn long")
        if name == "admin.leadership_state":
            return frame([("local", "leader", self.head())], "node string, role string, head_lsn long")
        if name == "admin.cluster_members":
            return frame([("local", self.ledger.path)], "node string, address string")
        return None

    def _calls(self) -> dict[str, Callable]:
        """Functions of literal arguments that queries may call."""
        commits = self.ledger.commits()
        settings = lambda name, missing_ok=False: self.settings.get(str(name).lower())
        calls = {
            "current_lsn": self.head,
            "row_lsn": lambda table, pk: self.row_lsn(self._qualified(table.lower(), self.domains), pk),
            "entity_version": lambda domain, name, pk: self.entity_version(domain, name, pk),
            "entity_head_lsn": lambda domain, name, pk: self.entity_head_lsn(domain, name, pk),
            "entity_version_lsn": lambda domain, name, pk, version: self.entity_version_lsn(domain, name, pk, version),
            "resolve_reference": lambda table, pk: self.resolve_reference(table.lower(), pk),
            "now": lambda: system.clock(commits[-1]["time"] if commits else 0),
            "current_database": lambda: "tidemark",
            "current_schema": lambda: self.domains[0] if self.domains else None,
            "current_setting": settings,
            "version": lambda: f"tidemark on Spark {self.spark.version}",
        }
        return calls | {f"has_{what}_privilege": lambda *args: self._may(args[-1]) for what in ("table", "schema", "database", "column")}

    def _may(self, privilege: str) -> bool:
        try:
            self._allow(None if str(privilege).upper() in ("SELECT", "USAGE", "CONNECT") else access.ADMIN)
        except access.AccessError:
            return False
        return True

    def explain(self, text: str) -> DataFrame:
        """One row: the operation, its domains and tables, the shape of the plan as JSON, and Spark's plan."""
        kind, found = S.parse(S.normalise(text))
        if kind != "select":
            table = found.get("table") if isinstance(found, dict) else None
            row = (kind.upper(), ",".join(self.domains), table or "", json.dumps({"kind": kind, "nodes": []}), "")
        else:
            imports, text = split_imports(S.as_of(text)[0])
            binder = self._binder(self.head(), self.domains, imports)
            df = dialect.query(self.spark, text, binder, self._calls())
            made = df._jdf.queryExecution()
            plan = made.explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            nodes = re.findall(r"^[ +:\-*()\d]*([A-Z]\w+)", made.executedPlan().treeString(), re.M)
            row = ("SELECT", ",".join(self.domains), ",".join(sorted(binder.used)), json.dumps({"kind": "select", "nodes": nodes}), plan)
        return self.spark.createDataFrame([row], "operation string, domain string, table string, plan_shape string, access_plan string")

    def checkpoint(self, name: str) -> None:
        """Write the table's state at head, from which later reads start."""
        self.ledger.write_checkpoint(name, self.table(name), self._definition(name)["pk"], self.head())

    # SQL

    def sql(self, text: str, args: Mapping | None = None, handle: Callable | None = None) -> DataFrame | str:
        """Run one statement. Reads give a DataFrame; writes are queued in a transaction, or committed by themselves.

        `handle(changes, batch)` receives what TAIL ... FOLLOW finds, which gives the streaming query.
        """
        began = time.perf_counter()
        text = S.normalise(S.inline(text, args) if args else text)
        kind, found = S.parse(text)
        self.counts[kind] += 1
        try:
            return self._run(text, kind, found, handle)
        finally:
            seen = self.times["write" if kind in _WRITES or kind == "commit" else "read"]
            seen.append(1000 * (time.perf_counter() - began))
            del seen[:-1000]

    def _run(self, text: str, kind: str, found, handle: Callable | None):
        self._allow(access.ADMIN if kind in _WRITES or kind == "copy_from" else access.HISTORY if kind == "tail" else None)
        if kind == "begin":
            if self.tx:
                raise ValueError("a transaction is open")
            self.tx, self.domains = Transaction(found, self.head()), found
            return "BEGIN"
        if kind in ("commit", "rollback", "savepoint", "rollback_to"):
            if not self.tx:
                raise ValueError("no transaction is open")
            if kind == "commit":
                tx, self.tx = self.tx, None
                return f"COMMIT {self._commit(tx)}"
            if kind == "rollback":
                self.tx = None
            elif kind == "savepoint":
                self.tx.queue.append(("savepoint", found))
            else:
                self.tx.rollback_to(found)
            return kind.upper()
        if kind == "select":
            return self._select(text)
        if kind == "explain":
            return self.explain(found)
        if kind == "tail":
            return self._tail(found, handle)
        if kind == "show":
            rows = sorted(self.settings.items()) if found == "all" else [(found, self.settings.get(found, ""))]
            return self.spark.createDataFrame(rows, "name string, setting string")
        if kind in ("set", "reset", "deallocate"):
            if kind == "set":
                self.settings[found[0]] = found[1]
            elif kind == "reset":
                self.settings = {} if found == "all" else {k: v for k, v in self.settings.items() if k != found}
            return kind.upper()
        if kind in ("copy_from", "copy_to"):
            if found["format"] == "BINARY":
                raise ValueError("COPY in binary format isn't supported")
            if kind == "copy_from":
                return f"COPY {self.copy_from(found['table'], found['columns'], found['path'], found['format'] == 'CSV')}"
            self.copy_to(found["query"], found["path"], found["format"] == "CSV")
            return "COPY"
        if self.tx:
            self.tx.queue.append((kind, found))
            return "QUEUED"
        own = Transaction(self.domains, self.head())
        own.queue.append((kind, found))
        lsn = self._commit(own)
        return own.returned if own.returned is not None else f"COMMIT {lsn}"

    def _tail(self, found: dict, handle: Callable | None):
        if not found["follow"]:
            rows = self.entity_changes(found["domain"], found["entity"], found["pk"], found["from"], found["to"])
            return rows if found["limit"] is None else rows.limit(found["limit"])
        if handle is None:
            raise ValueError("TAIL ... FOLLOW needs a handle for what it finds")
        from tidemark.streaming import tail

        point = self.settings.get("follow_checkpoint") or f"{self.ledger.path}/followers/{uuid.uuid4().hex}"
        return tail.follow_entity(self, found["domain"], found["entity"], handle, point, found["pk"], found["from"], found["to"], once=found["to"] is not None, limit=found["limit"])

    def _select(self, text: str) -> DataFrame:
        if found := S.history_of(text):
            return self.history(self._qualified(found[0], self.domains), found[1])
        text, lsn, timestamp = S.as_of(text)
        if timestamp is not None:
            lsn = self.ledger.lsn_at(timestamp)
        if lsn is not None:
            self._allow(access.HISTORY)
        return self.as_of(text, self.head() if lsn is None else lsn)

    def _definition(self, name: str, lsn: int | None = None, catalog: dict | None = None) -> dict:
        tables = (catalog or self.ledger.catalog(lsn))["tables"]
        if name not in tables:
            raise ValueError(f"no table {name}")
        return tables[name]

    def _qualified(self, name: str, domains: list[str], catalog: dict | None = None) -> str:
        if "." in name:
            if name.split(".")[0] not in domains:
                raise DomainError(f"{name} lies outside the domains {domains}")
            return name
        tables = (catalog or self.ledger.catalog())["tables"]
        return next((f"{d}.{name}" for d in domains if f"{d}.{name}" in tables), f"{domains[0]}.{name}" if domains else name)

    def _binder(self, lsn: int, domains: list[str], imports: list[tuple[str, str, str]]) -> dialect.Binder:
        """The tables that a query of these domains sees as of a commit."""
        known = self.ledger.catalog(lsn)["tables"]
        every = {t.split(".")[0] for t in known}
        imported = {alias: f"{d}.{t}" for d, t, alias in imports}

        def table(name: str) -> tuple[str, DataFrame] | None:
            if name in imported:
                if imported[name] not in known:
                    raise DomainError(f"no table {imported[name]} to import")
                return imported[name], self.table(imported[name], lsn)
            domain, _, bare = name.partition(".")
            if bare and domain in domains or not bare:
                full = name if bare else next((f"{d}.{name}" for d in domains if f"{d}.{name}" in known), None)
                if full in known:
                    return full, self.table(full, lsn)
            if (rows := self._system(name, lsn)) is not None:
                return system.full_name(name), rows
            if bare and domain in every | set(domains):
                raise DomainError(f"{name} lies outside the query's domains")
            return None

        return dialect.Binder(table, lambda name, args: self._system(name, lsn, args), lambda base, right: self._versioned(base, right, lsn), every)

    # Writes

    def _commit(self, tx: Transaction) -> int:
        """Apply a transaction's statements in order, check them, write their changes, and publish one commit.

        If another commit comes first, all of it is done again on the new head: inserts then go on, and an update or
        delete of a table that changed since the transaction began is a conflict.
        """
        steps = [s for s in tx.queue if s[0] != "savepoint"]
        if not steps:
            return self.head()
        for _ in range(TRIES):
            staged: list[str] = []
            try:
                return self._attempt(tx, steps, staged)
            except _Taken:
                continue
            finally:
                for folder in staged:
                    self.ledger.remove(folder)
        raise Conflict("other transactions kept committing first")

    def _attempt(self, tx: Transaction, steps: list[tuple], folders: list[str]) -> int:
        commits = self.ledger.commits()
        number, head = len(commits) + 1, commits[-1]["lsn"] if commits else 0
        lsn = head + len(steps) + 2
        record = self.ledger.new_record(lsn, uuid.uuid4().hex, tx.domains)
        catalog = self.ledger.catalog()
        states: dict[str, DataFrame] = {}
        staged: dict[str, DataFrame] = {}
        altered: set[str] = set()
        returning: tuple[str, int, list[str]] | None = None
        changed = {name for c in commits if c["lsn"] > tx.head for name in (*c["files"], *c["checkpoints"], *c["drops"])}

        def now(name: str) -> DataFrame:
            return states[name] if name in states else self.ledger.state(name, self._definition(name, catalog=catalog)["schema"], head)

        def cut(df: DataFrame) -> DataFrame:
            """df as files of the log's folder, so that later statements of the transaction don't plan it again."""
            folders.append(f"staged/{uuid.uuid4().hex}")
            df.write.parquet(f"{self.ledger.path}/{folders[-1]}")
            return self.spark.read.schema(df.schema).parquet(f"{self.ledger.path}/{folders[-1]}")

        for seq, (kind, s) in enumerate(steps):
            name = self._qualified(s["table"], tx.domains, catalog) if "table" in s else None
            if kind in ("update", "delete", "truncate") and name in changed:
                raise Conflict(f"{name} has changed since the transaction began")
            if kind in S.DDL:
                self._ddl(kind, s, name, tx.domains, catalog, record, states, staged, altered, now, cut)
                record["operations"].append([name or f"{tx.domains[0]}.", kind.upper()])
                record["catalog"] = catalog
                continue
            definition = self._definition(name, catalog=catalog)
            pk, conflict = definition["pk"], s.get("conflict")
            where = lambda: F.expr(dialect.expression(s["where"], self._calls())) if s["where"] else None  # noqa: E731, B023
            if kind in ("insert", "append"):
                if kind == "insert":
                    values = dialect.expression(s["values"], self._calls())
                    given = self.spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join('`' + c + '`' for c in s['columns'])})")
                else:
                    given = s["rows"]
                rows = self._staged(given, s["columns"], definition, now, catalog, staged, lsn)
                if conflict is None:
                    changes = dml.insert(rows, pk)
                else:
                    on = conflict["columns"][0]
                    if len(conflict["columns"]) > 1 or on != pk and not any(c["name"] == on and c.get("unique") for c in definition["columns"]):
                        raise ValueError("ON CONFLICT goes by the primary key or a unique column")
                    values = conflict["set"] and {c: e if e.startswith("EXCLUDED.") else F.expr(dialect.expression(e)) for c, e in conflict["set"].items()}
                    changes = dml.upsert(now(name), rows, pk, values, dml.ORDER, on)
            elif kind == "update":
                values = {c: F.expr(dialect.expression(e, self._calls())) for c, e in s["set"].items()}
                changes = self._recaptured(dml.update(now(name), pk, values, where()), definition, now, catalog, staged, lsn)
            elif kind == "delete":
                changes = dml.delete(now(name), pk, where())
            else:
                changes = dml.truncate(now(name), pk)
            changes = cut(changes.withColumn("seq", F.lit(seq)))
            if s.get("returning"):
                returning = (name, seq, s["returning"])
            moved = kind == "update" and pk in s["set"] or conflict is not None and conflict["columns"][0] != pk
            self._check(changes, name, definition, now, kind in ("insert", "append") and conflict is None, moved)
            states[name] = dml.apply(now(name), changes, pk, lsn)
            staged[name] = changes if name not in staged else aligned(staged[name], changes)
            record["operations"].append([name, "INSERT" if kind == "append" else kind.upper()])
        for name, changes in staged.items():
            record["files"][name] = self.ledger.write_changes(name, changes, lsn)
            record["shapes"][name] = self._definition(name, catalog=catalog)["schema"]
        for name in altered:
            record["checkpoints"][name] = self.ledger.write_checkpoint(name, now(name), self._definition(name, catalog=catalog)["pk"], lsn, record["tx"])
        try:
            self.ledger.publish(record, number)
        except Conflict as e:
            for folder in self.ledger.files(record):
                self.ledger.remove(folder)
            raise _Taken from e
        if returning:
            name, seq, columns = returning
            made = self.spark.read.parquet(f"{self.ledger.path}/{record['files'][name]}").where(F.col("seq") == seq)
            tx.returned = made.select("new.*").select(*columns)
        return lsn

    def _staged(self, rows: DataFrame, given: list[str], definition: dict, now, catalog: dict, staged: dict, lsn: int) -> DataFrame:
        """The rows of an INSERT in order, with defaults and captured versions filled in, in the table's types."""
        rows = rows.withColumn(dml.ORDER, F.monotonically_increasing_id())
        for c in definition["columns"]:
            default = c.get("default")
            if c["name"] in given:
                rows = rows.withColumn(c["name"], F.col(c["name"]).cast(c["type"]))
            elif default is None:
                rows = rows.withColumn(c["name"], F.lit(None).cast(c["type"]))
            elif default == "AUTOINCREMENT":
                rows = autoincrement(rows, now(self._name_of(definition, catalog)), c["name"], dml.ORDER)
            elif default == "UUID_V7":
                n = rows.count()  # rows of a literal VALUES list
                ids = self.spark.createDataFrame([(i, uuid7()) for i in range(n)], "__n long, __uuid string")
                numbered = autoincrement(rows, self.spark.range(0).withColumnRenamed("id", "__n"), "__n", dml.ORDER).withColumn("__n", F.col("__n") - 1)
                rows = numbered.join(ids, "__n").withColumn(c["name"], F.col("__uuid")).drop("__n", "__uuid")
            elif default == "TX_TIMESTAMP":
                rows = rows.withColumn(c["name"], F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast(c["type"]))
            else:
                rows = rows.withColumn(c["name"], F.expr(dialect.expression(default)).cast(c["type"]))
        for v in definition["versioned"]:
            rows = self._capture(rows, v, now, catalog, staged, lsn)
        return rows.select(*[c["name"] for c in definition["columns"]], dml.ORDER)

    @staticmethod
    def _name_of(definition: dict, catalog: dict) -> str:
        return next(n for n, d in catalog["tables"].items() if d is definition)

    def _recaptured(self, changes: DataFrame, definition: dict, now, catalog: dict, staged: dict, lsn: int) -> DataFrame:
        """Changes of an UPDATE, with empty version columns of the new rows filled in."""
        if not definition["versioned"]:
            return changes
        columns = [c["name"] for c in definition["columns"]]
        kept = changes.where("op <> 'DELETE'").select(F.col("op").alias("__op"), F.col("pk").alias("__pk"), F.col("old").alias("__old"), "new.*")
        for v in definition["versioned"]:
            kept = self._capture(kept, v, now, catalog, staged, lsn)
        kept = kept.select(F.col("__op").alias("op"), F.col("__pk").alias("pk"), F.col("__old").alias("old"), F.struct(*columns).alias("new"))
        return changes.where("op = 'DELETE'").unionByName(kept)

    def _pending(self, domain: str, paths: dict, staged: dict, lsn: int) -> DataFrame | None:
        """The roots of an entity that this transaction touches."""
        touched = []
        at = lambda df: df.withColumn("commit_lsn", F.lit(lsn).cast("long"))
        for table, hops in paths.items():
            if f"{domain}.{table}" not in staged:
                continue
            parents = []
            for column, parent in hops:
                old, new = self.ledger.changes(f"{domain}.{parent}"), staged.get(f"{domain}.{parent}")
                parts = [p for p in (old, None if new is None else at(new)) if p is not None]
                parents.append((column, aligned(*parts) if len(parts) == 2 else parts[0]))
            touched.append(entity.touches(at(staged[f"{domain}.{table}"]), table, parents).select("root_pk"))
        out = None
        for part in touched:
            out = part if out is None else out.union(part)
        return out and out.distinct()

    def _capture(self, rows: DataFrame, v: dict, now, catalog: dict, staged: dict, lsn: int) -> DataFrame:
        """Fill an empty version column: the entity's version for a root, counting the one that this transaction makes,
        else the row's _lsn."""
        domain, _ = v["table"].split(".")
        target = self._definition(v["table"], catalog=catalog)
        found = now(v["table"]).select(F.col(target["pk"]).alias("__ref"), F.col("_lsn").alias("__token"))
        if (of := self._entity_of(v["table"], catalog)) is not None:
            paths = catalog["entities"][".".join(of)]["paths"]
            token = F.coalesce("__version", F.lit(0))
            if ".".join(of) in self.ledger.catalog()["entities"]:
                known = entity.heads(self.entity_versions(*of)).select(F.col("root_pk").alias("__ref"), F.col("version").alias("__version"))
                found = found.join(known, "__ref", "left")
            else:
                found = found.withColumn("__version", F.lit(None).cast("long"))
            if (pending := self._pending(domain, paths, staged, lsn)) is not None:
                found = found.join(pending.select(F.col("root_pk").alias("__ref"), F.lit(1).alias("__more")), "__ref", "left")
                token = token + F.coalesce("__more", F.lit(0))
            found = found.select("__ref", token.alias("__token"))
        out = rows.join(found, F.col(v["column"]) == F.col("__ref"), "left")
        if out.where(F.col(v["column"]).isNotNull() & F.col("__ref").isNull()).limit(1).count():
            raise ConstraintError("23000", f"{v['column']} refers to no row of {v['table']}")
        return out.withColumn(v["lsn_column"], F.coalesce(F.col(v["lsn_column"]), F.col("__token").cast("long"))).drop("__ref", "__token")

    def _check(self, changes: DataFrame, name: str, definition: dict, now, insert: bool, moved: bool) -> None:
        """Raise ConstraintError for the first constraint that the written rows break. `moved`: other rows than plain
        inserts may take a key that another row has."""
        rows, pk = changes.where("op <> 'DELETE'").select("new.*"), definition["pk"]

        def others() -> DataFrame:
            """The rows that this statement leaves as they are."""
            return now(name) if insert else now(name).join(changes.where("op <> 'INSERT'").select(F.col("pk").alias("__pk")), F.col(pk) == F.col("__pk"), "left_anti")

        def fail(found: DataFrame, what: str) -> None:
            if row := found.select("sqlstate").first():
                raise ConstraintError(row[0], f"{name}: {what}")

        fail(constraints.primary_key_violations(rows, pk, others() if insert or moved else None), "primary key")
        for c in definition["columns"]:
            if c.get("not_null"):
                fail(constraints.null_violations(rows, c["name"]), f"{c['name']} is null")
            if c.get("unique"):
                fail(constraints.unique_violations(rows, c["name"], others()), f"{c['name']} isn't unique")
            if c.get("references"):
                table, column = c["references"]
                parent = f"{name.split('.')[0]}.{table}"
                values = now(parent)
                if parent == name:
                    values = values.select(column).unionByName(rows.select(column))
                fail(constraints.foreign_key_violations(rows, c["name"], values, column), f"{c['name']} refers to no row")
            if c.get("check"):
                fail(constraints.check_violations(rows, c["check"]), f"check of {c['name']}")
            if c["kind"] == "JSON":
                bad = rows.where(F.col(c["name"]).isNotNull() & F.try_parse_json(c["name"]).isNull())
                fail(bad.withColumn("sqlstate", F.lit("22P02")), f"{c['name']} is no JSON")

    def _ddl(self, kind: str, s: dict, name: str | None, domains: list[str], catalog: dict, record: dict, states: dict, staged: dict, altered: set, now, cut) -> None:
        tables, entities, indexes = catalog["tables"], catalog["entities"], catalog["indexes"]
        if kind == "create_table":
            if name in tables:
                if s["if_not_exists"]:
                    return
                raise ValueError(f"{name} exists")
            tables[name] = json.loads(json.dumps(s["definition"]))
            states[name] = self.spark.createDataFrame([], f"{s['definition']['schema']}, _lsn long")
            return
        if kind == "create_entity":
            key = f"{domains[0]}.{s['name']}"
            if key in entities:
                if s["if_not_exists"]:
                    return
                raise ValueError(f"entity {key} exists")
            entities[key] = {"root": s["root"], "paths": {t: self._path(domains[0], t, s["root"], tables) for t in [s["root"], *s["includes"]]}}
            return
        if kind == "drop_index":
            if indexes.pop(s["name"], None) is None and not s["if_exists"]:
                raise ValueError(f"no index {s['name']}")
            return
        if kind == "drop_table":
            if name not in tables:
                if s["if_exists"]:
                    return
                raise ValueError(f"no table {name}")
            bare, domain = name.split(".")[1], name.split(".")[0]
            holders = [c for t, d in tables.items() if t.startswith(f"{domain}.") and t != name for c in d["columns"] if (c.get("references") or [None])[0] == bare]
            members = [k for k, e in entities.items() if k.startswith(f"{domain}.") and bare in e["paths"]]
            if (holders or members) and not s["cascade"]:
                raise ConstraintError("2BP01", f"{name} is referred to")
            for c in holders:
                c.pop("references")
            for k in members:
                del entities[k]
            for i in [i for i, x in indexes.items() if x["table"] == name]:
                del indexes[i]
            del tables[name]
            record["drops"].append(name)  # a table made anew under this name doesn't see its rows
            for some in (states, staged, altered):
                if name in some:
                    some.remove(name) if some is altered else some.pop(name)
            return
        definition = self._definition(name, catalog=catalog)
        if kind == "create_index":
            if s["name"] in indexes:
                if s["if_not_exists"]:
                    return
                raise ValueError(f"index {s['name']} exists")
            indexes[s["name"]] = {"table": name, "columns": s["columns"], "using": s["using"]}
            return
        rows, columns = now(name), definition["columns"]
        if kind == "add_column":
            c = s["column"]
            if c.get("not_null") and c.get("default") is None and rows.limit(1).count():
                raise ConstraintError("23502", f"{c['name']} needs a default")
            columns.append(c)
            rows = rows.withColumn(c["name"], F.expr(dialect.expression(c["default"]) if c["default"] else "NULL").cast(c["type"]))
        elif kind == "drop_column":
            if s["name"] == definition["pk"]:
                raise ValueError("the primary key stays")
            definition["columns"] = [c for c in columns if c["name"] != s["name"]]
            rows = rows.drop(s["name"])
            for i in [i for i, x in indexes.items() if x["table"] == name and s["name"] in x["columns"]]:
                del indexes[i]
        else:
            if s["to"] in [c["name"] for c in columns] or s["name"] not in [c["name"] for c in columns]:
                raise ValueError(f"can't rename {s['name']} to {s['to']}")
            for c in columns:
                if c["name"] == s["name"]:
                    c["name"] = s["to"]
            definition["pk"] = s["to"] if definition["pk"] == s["name"] else definition["pk"]
            rows = rows.withColumnRenamed(s["name"], s["to"])
            for x in indexes.values():
                if x["table"] == name:
                    x["columns"] = [s["to"] if c == s["name"] else c for c in x["columns"]]
        definition["schema"] = S.schema_of(definition["columns"])
        rows = rows.select(*[c["name"] for c in definition["columns"]], "_lsn")
        altered.add(name)  # the commit holds the whole table in its new shape
        states[name] = cut(rows)

    @staticmethod
    def _path(domain: str, table: str, root: str, tables: dict) -> list[list[str]]:
        """The shortest chain of foreign keys from a member to the root: (column, referenced table)."""
        seen, todo = {table}, [(table, [])]
        while todo:
            at, hops = todo.pop(0)
            if at == root:
                return hops
            for c in tables[f"{domain}.{at}"]["columns"]:
                if c.get("references") and c["references"][0] not in seen:
                    seen.add(c["references"][0])
                    todo.append((c["references"][0], [*hops, [c["name"], c["references"][0]]]))
        raise ValueError(f"{table} doesn't reach {root}")

    # Files

    def copy_from(self, table: str, columns: list[str], path: str, csv: bool = False) -> int:
        """Append a tab-separated or CSV file to a table as one commit; empty CSV fields and \\N are null."""
        self._allow(access.ADMIN)
        definition = self._definition(self._qualified(table, self.domains))
        kinds = {c["name"]: c["type"] for c in definition["columns"]}
        reader = self.spark.read.schema(", ".join(f"`{c}` string" for c in columns))
        raw = reader.options(sep="," if csv else "\t", nullValue="" if csv else "\\N", quote='"' if csv else "", escape='"').csv(path)
        return self.append(table, raw.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]))

    def append(self, table: str, rows: DataFrame, conflict: dict | None = None) -> int | str:
        """Insert a DataFrame whose columns are some of the table's, in the open transaction or as one commit.

        `conflict` is what ON CONFLICT says: {"columns": [column], "set": None or {column: expression}}.
        """
        self._allow(access.ADMIN)
        step = ("append", {"table": table, "columns": rows.columns, "rows": rows, "conflict": conflict})
        if self.tx:
            self.tx.queue.append(step)
            return "QUEUED"
        own = Transaction(self.domains, self.head())
        own.queue.append(step)
        return self._commit(own)

    def copy_to(self, query: str, path: str, csv: bool = False) -> None:
        """Write a query's rows as tab-separated text or CSV."""
        df = self._select(query)
        df.drop("_lsn").write.options(sep="," if csv else "\t", nullValue="" if csv else "\\N", quote='"' if csv else "", escape='"').csv(path)

    @staticmethod
    def validate_fixture(text: str) -> dict:
        """A fixture, JSON of version 1, if it is one whose statements give the same rows each time."""
        fixture = json.loads(text)
        if fixture.get("version") != 1 or set(fixture) - {"version", "name", "description", "steps"} or not fixture.get("name"):
            raise ValueError("not a fixture of version 1")
        for step in fixture["steps"]:
            if step.get("mode") not in ("domain", "cross") or not step.get("domains") or (step["mode"] == "cross") != (len(step["domains"]) > 1):
                raise ValueError(f"step {step.get('name')}: its mode doesn't fit its domains")
            for statement in step["statements"]:
                masked = S.mask(statement)[0]
                if re.search(r"\b(NOW|RANDOM|RAND|UUID|CURRENT_TIMESTAMP)\s*\(", masked, re.I) or re.match(r"\s*(BEGIN|COMMIT|ROLLBACK|SAVEPOINT)\b", masked, re.I):
                    raise ValueError(f"a fixture can't hold: {statement}")
                S.parse(S.normalise(statement))
        return fixture

    def load_fixture(self, text: str) -> None:
        """Run a fixture: each step's statements in a transaction of its domains."""
        for step in self.validate_fixture(text)["steps"]:
            cross = "CROSS " if step["mode"] == "cross" else ""
            self.sql(f"BEGIN {cross}DOMAIN {', '.join(step['domains'])}")
            for statement in step["statements"]:
                self.sql(statement)
            self.sql("COMMIT")

    def export_fixture(self, name: str, domains: list[str]) -> str:
        """A fixture that makes the tables of these domains and their rows, each table behind those that it refers to.

        Fixtures are for small tables: their rows come to the driver, one partition at a time.
        """
        tables = {t: d for t, d in self.ledger.catalog()["tables"].items() if t.split(".")[0] in domains}
        steps = []
        for full in system.by_reference(tables):
            domain, bare = full.split(".")
            definition = tables[full]
            columns = [c["name"] for c in definition["columns"]]
            statements = [system.create_table(bare, definition)]
            for row in self.table(full).select(*[F.col(c).cast("string") for c in columns]).orderBy(definition["pk"]).toLocalIterator():
                plain = {"INT", "FLOAT", "BOOL"}
                value = lambda c, v: "NULL" if v is None else v if c["kind"] in plain else "'" + v.replace("'", "''") + "'"
                statements.append(f"INSERT INTO {bare} ({', '.join(columns)}) VALUES ({', '.join(value(c, row[c['name']]) for c in definition['columns'])})")
            others = sorted({v["table"].split(".")[0] for v in definition["versioned"]} - {domain})
            steps.append({"name": bare, "mode": "cross" if others else "domain", "domains": [domain, *others], "statements": [x.replace(f" {bare} ", f" {full} ", 1) for x in statements] if others else statements})
        for key, e in self.ledger.catalog()["entities"].items():
            if key.split(".")[0] in domains:
                members = [t for t in e["paths"] if t != e["root"]]
                inside = f"ROOT {e['root']}" + (f", INCLUDES {', '.join(members)}" if members else "")
                steps.append({"name": key.split(".")[1], "mode": "domain", "domains": [key.split(".")[0]], "statements": [f"CREATE ENTITY {key.split('.')[1]} ({inside})"]})
        return json.dumps({"version": 1, "name": name, "steps": steps})

    @staticmethod
    def rollback_of(forward: list[str]) -> list[str]:
        """Statements that undo schema changes, last one first."""
        out = []
        for statement in reversed(forward):
            kind, s = S.parse(S.normalise(statement))
            undo = {
                "add_column": lambda: f"ALTER TABLE {s['table']} DROP COLUMN {s['column']['name']}",  # noqa: B023
                "rename_column": lambda: f"ALTER TABLE {s['table']} RENAME COLUMN {s['to']} TO {s['name']}",  # noqa: B023
                "create_index": lambda: f"DROP INDEX {s['name']}",  # noqa: B023
                "create_table": lambda: f"DROP TABLE {s['table']}",  # noqa: B023
            }
            if kind not in undo:
                raise ValueError(f"no statement undoes: {statement}")
            out.append(undo[kind]())
        return out

    def preflight(self, forward: list[str], rollback: list[str] | None, scratch: str) -> bool:
        """Whether rollback undoes forward: both run on a copy of the log, and tables and catalog are compared. A rollback
        that isn't given is made from forward."""
        rollback = self.rollback_of(forward) if rollback is None else rollback
        self.ledger.backup(scratch)
        trial = Session(self.spark, scratch)
        trial.domains = list(self.domains)
        for statement in [*forward, *rollback]:
            trial.sql(statement)
        old, new = self.ledger.catalog(), trial.ledger.catalog()
        if old != new:
            return False
        return not any(state.same_rows(self.table(t).drop("_lsn"), trial.table(t).drop("_lsn")).limit(1).count() for t in old["tables"])
