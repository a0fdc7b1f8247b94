"""Registered queries that go through Session.sql, over logs written from the tables.

The log that most of them read is written once for a Spark session and folder. Commits, by LSN:

    7   tables customers, orders and lines of domain sales, and parcels of domain ship; entity purchase of orders and lines
    12  all rows of sales; a checkpoint of orders follows
    15  orders whose key divides by 3 get status X and twice their total
    18  a parcel for each order, with the version of its purchase
    22  first lines, and orders whose key divides by 10, are deleted
    25  orders whose key divides by 7 get status Z
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.sources.scratch import scratch
from tidemark.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_LOGS: dict[tuple[str, str], str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session(spark: SparkSession, path: str, *domains: str):
    from tidemark.session import Session

    s = Session(spark, path)
    s.domains = list(domains)
    return s


def _log(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _LOGS:
        return _LOGS[key]
    s = _session(spark, scratch(spark, "log"))
    s.sql("BEGIN CROSS DOMAIN ship, sales")
    s.sql("CREATE TABLE sales.customers (id INT PRIMARY KEY, name TEXT, nation INT, balance FLOAT)")
    s.sql("CREATE TABLE sales.orders (id INT PRIMARY KEY, customer INT, status TEXT, total FLOAT CHECK (total >= 0))")
    s.sql("CREATE TABLE sales.lines (id INT PRIMARY KEY, order_id INT REFERENCES orders(id), qty FLOAT)")
    s.sql("CREATE TABLE ship.parcels (id INT PRIMARY KEY, order_id INT, v INT, VERSIONED FOREIGN KEY (order_id) REFERENCES sales.orders(id) AS OF v)")
    s.sql("CREATE ENTITY purchase (ROOT orders, INCLUDES lines)")
    s.sql("COMMIT")
    s.sql("BEGIN DOMAIN sales")
    s.append("customers", _read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance"))
    s.append("orders", _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS customer", "o_orderstatus AS status", "o_totalprice AS total"))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("qty"))
    s.append("lines", lines.selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS order_id", "qty"))
    s.sql("COMMIT")
    s.checkpoint("sales.orders")
    s.sql("UPDATE orders SET status = 'X', total = total * 2 WHERE MOD(id, 3) = 0")
    s.domains = ["ship"]
    s.append("parcels", _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS order_id"))
    s.sql("BEGIN DOMAIN sales")
    s.sql("DELETE FROM lines WHERE MOD(id, 10) = 1")
    s.sql("DELETE FROM orders WHERE MOD(id, 10) = 0")
    s.sql("COMMIT")
    s.sql("UPDATE orders SET status = 'Z' WHERE MOD(id, 7) = 0")
    _LOGS[key] = s.ledger.path
    return s.ledger.path


def _register(name: str, f: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    f.__name__ = name
    QUERIES[name] = f
    if oracle:
        ORACLE_SQL[name] = oracle


def _sql(name: str, text: str, oracle: str, *domains: str) -> None:
    _register(name, lambda spark, sf_dir: _session(spark, _log(spark, sf_dir), *(domains or ("sales",))).sql(text), oracle)


def _query(oracle: str | None):
    return lambda f: _register(f.__name__, f, oracle) or f


def _orders(lsn: int) -> str:
    """The state of orders as of a commit, in SQL."""
    status = "CASE WHEN FALSE THEN NULL " + ("WHEN o_orderkey % 7 = 0 THEN 'Z' " if lsn >= 25 else "") + ("WHEN o_orderkey % 3 = 0 THEN 'X' " if lsn >= 15 else "") + "ELSE o_orderstatus END"
    at = "CASE WHEN FALSE THEN NULL " + ("WHEN o_orderkey % 7 = 0 THEN 25 " if lsn >= 25 else "") + ("WHEN o_orderkey % 3 = 0 THEN 15 " if lsn >= 15 else "") + "ELSE 12 END"
    total = "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END" if lsn >= 15 else "o_totalprice"
    where = "WHERE o_orderkey % 10 <> 0" if lsn >= 22 else ""
    return f"(SELECT o_orderkey AS id, o_custkey AS customer, {status} AS status, {total} AS total, CAST({at} AS BIGINT) AS _lsn FROM orders {where})"


_LINES = "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)"

_sql("session_select", "SELECT id, status, total, _lsn FROM orders", f"SELECT id, status, total, _lsn FROM {_orders(25)}")
_sql("session_as_of_lsn", "SELECT o.id, o.status, c.name FROM orders o JOIN customers c ON o.customer = c.id AS OF LSN 15", f"SELECT o.id, o.status, c_name AS name FROM {_orders(15)} o JOIN customer ON customer = c_custkey")
_sql("session_as_of_checkpoint", "SELECT id, status, total, _lsn FROM orders /* as-of-lsn: 22 */", f"SELECT id, status, total, _lsn FROM {_orders(22)}")
_sql("session_as_of_in_string", "SELECT id, 'AS OF LSN 1' AS note FROM orders WHERE status <> 'FOR HISTORY'", f"SELECT id, 'AS OF LSN 1' AS note FROM {_orders(25)}")
_sql(
    "session_history", "SELECT * FROM orders FOR HISTORY",
    f"""SELECT 'INSERT' AS __operation, CAST(12 AS BIGINT) AS __commit_lsn, id, customer, status, total FROM {_orders(12)} UNION ALL
        SELECT 'UPDATE', 15, id, customer, status, total FROM {_orders(15)} WHERE id % 3 = 0 UNION ALL
        SELECT 'DELETE', 22, id, customer, status, total FROM {_orders(15)} WHERE id % 10 = 0 UNION ALL
        SELECT 'UPDATE', 25, id, customer, status, total FROM {_orders(25)} WHERE id % 7 = 0""",
)
_sql(
    "session_names", "WITH orders AS (SELECT customer, COUNT(*) AS n FROM orders GROUP BY customer) SELECT c.id, orders.n FROM orders, customers c WHERE c.id = orders.customer",
    f"WITH n AS (SELECT customer, count(*) AS n FROM {_orders(25)} GROUP BY customer) SELECT customer AS id, n FROM n JOIN customer ON c_custkey = customer",
)
_sql(
    "session_average", "SELECT status, AVG(id) AS whole, AVG(CAST(customer AS FLOAT)) AS fraction, AVG(id) FILTER (WHERE id > 100) AS some FROM orders GROUP BY status",
    f"SELECT status, CAST(sum(id) // count(id) AS BIGINT) AS whole, avg(customer) AS fraction, CAST(sum(id) FILTER (id > 100) // count(id) FILTER (id > 100) AS BIGINT) AS some FROM {_orders(25)} GROUP BY status",
)
_sql(
    "session_functions",
    "SELECT id, LENGTH(name || 'é') AS n, MOD(id, nation) AS m, CAST(name AS INT) AS bad, '3.7'::INT + id AS i, LEFT(name, -1) AS l, SUBSTRING(name, 0, 4) AS s, TRIM(' ' || name || '  ') AS t, "
    "CEIL(balance) AS c, FLOOR(id) AS f, EXTRACT(DOW FROM TIMESTAMP_NTZ '2024-01-07 10:00:00') AS d FROM customers",
    """SELECT c_custkey AS id, strlen(c_name || 'é') AS n, CASE WHEN c_nationkey <> 0 THEN c_custkey % c_nationkey END AS m, CAST(NULL AS BIGINT) AS bad, 3 + c_custkey AS i, '' AS l,
       substring(c_name, 1, 4) AS s, c_name AS t, ceil(c_acctbal) AS c, c_custkey AS f, CAST(0 AS BIGINT) AS d FROM customer""",
)
_sql(
    "session_import", "IMPORT sales.orders AS o; SELECT p.id, o.status FROM parcels p LEFT JOIN o ON p.order_id = o.id AND o.total < 0 OR p.id = o.id AND p.v < 0",
    "SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS status FROM orders", "ship",
)
_sql(
    "session_vfk_cascade", "SELECT p.id, p.v, o.status, l.id AS line, l.qty FROM ship.parcels p JOIN sales.orders o ON p.order_id = o.id LEFT JOIN sales.lines l ON l.order_id = o.id",
    f"SELECT o.id, CAST(CASE WHEN o.id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS v, o.status, l_orderkey * 10 + l_linenumber AS line, l_quantity AS qty FROM {_orders(15)} o LEFT JOIN {_LINES} ON l_orderkey = o.id",
    "sales", "ship",
)
_sql(
    "session_join_same_domain", "SELECT o.id, COUNT(l.id) AS n FROM orders o LEFT JOIN lines l ON l.order_id = o.id GROUP BY o.id",
    f"SELECT o.id, count(l_linenumber) AS n FROM {_orders(25)} o LEFT JOIN {_LINES} ON l_orderkey = o.id AND l_linenumber <> 1 GROUP BY o.id",
)
_FEED = f"""
    WITH t AS (SELECT o_orderkey AS k, 12 AS c, 'orders' AS t FROM orders UNION ALL SELECT l_orderkey, 12, 'lines' FROM lineitem
        UNION ALL SELECT o_orderkey, 15, 'orders' FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT l_orderkey, 22, 'lines' FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey, 22, 'orders' FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT id, 25, 'orders' FROM {_orders(25)} WHERE id % 7 = 0),
    g AS (SELECT k, c, list_sort(list(DISTINCT t)) AS ts FROM t GROUP BY k, c),
    v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c) AS n FROM g)
    SELECT CAST(c AS BIGINT) AS commit_lsn, 'sales' AS domain, 'purchase' AS entity, k AS root_pk, CAST(n AS BIGINT) AS entity_version, '["' || array_to_string(ts, '","') || '"]' AS tables FROM v"""
_sql("session_tail", "TAIL ENTITY CHANGES sales.purchase FROM LSN 12 TO LSN 22", _FEED + " WHERE c BETWEEN 12 AND 22")
_sql(
    "session_columns", "SELECT table_schema, table_name, column_name, ordinal_position, is_nullable FROM information_schema.columns",
    """SELECT * FROM (VALUES ('sales', 'customers', 'id', 1, 'NO'), ('sales', 'customers', 'name', 2, 'YES'), ('sales', 'customers', 'nation', 3, 'YES'), ('sales', 'customers', 'balance', 4, 'YES'),
       ('sales', 'orders', 'id', 1, 'NO'), ('sales', 'orders', 'customer', 2, 'YES'), ('sales', 'orders', 'status', 3, 'YES'), ('sales', 'orders', 'total', 4, 'YES'),
       ('sales', 'lines', 'id', 1, 'NO'), ('sales', 'lines', 'order_id', 2, 'YES'), ('sales', 'lines', 'qty', 3, 'YES'),
       ('ship', 'parcels', 'id', 1, 'NO'), ('ship', 'parcels', 'order_id', 2, 'YES'), ('ship', 'parcels', 'v', 3, 'YES')) AS t(table_schema, table_name, column_name, ordinal_position, is_nullable)""",
)
_sql(
    "session_pg_catalog", "SELECT n.nspname, c.relname, c.relnatts, COUNT(a.attname) AS n FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid GROUP BY n.nspname, c.relname, c.relnatts",
    "SELECT * FROM (VALUES ('sales', 'customers', 4, 4::BIGINT), ('sales', 'orders', 4, 4), ('sales', 'lines', 3, 3), ('ship', 'parcels', 3, 3)) AS t(nspname, relname, relnatts, n)",
)
_sql("session_timeline", "SELECT commit_lsn, domain, table_name, operation FROM admin.timeline_commits WHERE operation <> 'CREATE_ENTITY'", """
    SELECT CAST(c AS BIGINT) AS commit_lsn, domain, table_name, operation FROM (VALUES (7, 'sales', 'customers', 'CREATE_TABLE'), (7, 'sales', 'orders', 'CREATE_TABLE'), (7, 'sales', 'lines', 'CREATE_TABLE'),
    (7, 'ship', 'parcels', 'CREATE_TABLE'), (12, 'sales', 'customers', 'INSERT'), (12, 'sales', 'orders', 'INSERT'), (12, 'sales', 'lines', 'INSERT'), (15, 'sales', 'orders', 'UPDATE'),
    (18, 'ship', 'parcels', 'INSERT'), (22, 'sales', 'lines', 'DELETE'), (22, 'sales', 'orders', 'DELETE'), (25, 'sales', 'orders', 'UPDATE')) AS t(c, domain, table_name, operation)""")  # fmt: skip
_sql(
    "session_row_history", "SELECT __operation, COUNT(*) AS n, MAX(__commit_lsn) AS last FROM admin.row_history('SELECT * FROM orders FOR HISTORY WHERE MOD(id, 3) = 0') GROUP BY __operation",
    """SELECT __operation, count(*) AS n, max(c) AS last FROM (
        SELECT 'INSERT' AS __operation, CAST(12 AS BIGINT) AS c FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'UPDATE', 15 FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'DELETE', 22 FROM orders WHERE o_orderkey % 30 = 0 UNION ALL SELECT 'UPDATE', 25 FROM orders WHERE o_orderkey % 21 = 0 AND o_orderkey % 10 <> 0) GROUP BY __operation""",
)
_sql(
    "session_helpers",
    "SELECT current_lsn() AS head, row_lsn('orders', 21) AS row, entity_version('sales', 'purchase', 21) AS version, entity_head_lsn('sales', 'purchase', 21) AS at, "
    "entity_version_lsn('sales', 'purchase', 21, 2) AS second, resolve_reference('sales.orders', 21) AS token",
    f"WITH f AS ({_FEED}) SELECT CAST(25 AS BIGINT) AS head, (SELECT _lsn FROM {_orders(25)} WHERE id = 21) AS row, (SELECT max(entity_version) FROM f WHERE root_pk = 21) AS version, "
    "(SELECT max(commit_lsn) FROM f WHERE root_pk = 21) AS at, (SELECT commit_lsn FROM f WHERE root_pk = 21 AND entity_version = 2) AS second, (SELECT max(entity_version) FROM f WHERE root_pk = 21) AS token",
)


@_query(f"SELECT id, status, total FROM {_orders(15)}")
def session_as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, _log(spark, sf_dir), "sales")
    at = next(c["time"] for c in s.ledger.commits() if c["lsn"] == 15)
    return s.sql(f"SELECT id, status, total FROM orders AS OF TIMESTAMP '{datetime.fromtimestamp(at + 1e-5, timezone.utc).isoformat()}'")


@_query(_FEED)
def session_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity's changes followed as a stream, each batch written to files."""
    s, out = _session(spark, _log(spark, sf_dir), "sales"), scratch(spark, "followed")
    s.settings["follow_checkpoint"] = scratch(spark, "follower")
    s.sql("TAIL ENTITY CHANGES sales.purchase TO LSN 25 FOLLOW", handle=lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@_query(f"SELECT id, status, total, _lsn FROM {_orders(25)}")
def session_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, read from a copy of the log that a stream has made."""
    s, to = _session(spark, _log(spark, sf_dir), "sales"), scratch(spark, "replica")
    tail.replicate(s.ledger, to, scratch(spark, "replicator")).awaitTermination()
    return _session(spark, to, "sales").sql("SELECT id, status, total, _lsn FROM orders")


@_query(f"SELECT id, status FROM {_orders(15)}")
def session_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, from a backup up to a commit whose files are verified."""
    s, to = _session(spark, _log(spark, sf_dir), "sales"), scratch(spark, "backup")
    manifest = s.ledger.backup(to, 15)
    copy = _session(spark, to, "sales")
    if copy.ledger.verify(manifest):
        raise ValueError("the backup's files aren't those of the log")
    return copy.sql("SELECT id, status FROM orders")


def _suppliers(spark: SparkSession, sf_dir: str):
    s = _session(spark, scratch(spark, "log"), "d")
    s.sql("CREATE TABLE suppliers (id INT PRIMARY KEY, name TEXT UNIQUE, balance FLOAT)")
    s.append("suppliers", _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"))
    return s


@_query("SELECT s_suppkey AS id, s_name AS label, CAST(5 AS BIGINT) AS rating FROM supplier UNION ALL SELECT -1, 'more', 7")
def session_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added, one renamed and one dropped, and a row of the new shape."""
    s = _suppliers(spark, sf_dir)
    s.sql("ALTER TABLE suppliers ADD COLUMN rating INT DEFAULT 5")
    s.sql("BEGIN DOMAIN d")
    s.sql("ALTER TABLE suppliers RENAME COLUMN name TO label")
    s.sql("ALTER TABLE suppliers DROP COLUMN balance")
    s.sql("INSERT INTO suppliers (id, label, rating) VALUES (-1, 'more', 7)")
    s.sql("COMMIT")
    return s.sql("SELECT id, label, rating FROM suppliers")


@_query("SELECT CASE WHEN s_suppkey % 5 = 0 THEN -s_suppkey - 1 ELSE s_suppkey END AS id, s_name AS name, CAST(9 AS BIGINT) AS _lsn FROM supplier")
def session_update_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update that moves some keys: the state that a DELETE and an INSERT for each leave."""
    s = _suppliers(spark, sf_dir)
    s.sql("UPDATE suppliers SET id = CASE WHEN MOD(id, 5) = 0 THEN -id - 1 ELSE id END")
    return s.sql("SELECT id, name, _lsn FROM suppliers")


@_query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(-1 AS DOUBLE) ELSE s_acctbal END AS balance FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || '+', s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet others by a unique column, which update those, and rows that don't."""
    s = _suppliers(spark, sf_dir)
    met = _read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    rows = met.selectExpr("s_suppkey + 5000000 AS id", "s_name AS name", "s_acctbal AS balance").unionByName(met.selectExpr("s_suppkey + 1000000 AS id", "s_name || '+' AS name", "s_acctbal AS balance"))
    s.append("suppliers", rows, {"columns": ["name"], "set": {"balance": "-1.0"}})
    return s.sql("SELECT id, name, balance FROM suppliers")


@_query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey = 3")
def session_made_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table truncated, dropped and made again holds only what came after."""
    s = _suppliers(spark, sf_dir)
    s.sql("TRUNCATE TABLE suppliers")
    if s.sql("SELECT id FROM suppliers").limit(1).count():
        raise ValueError("the table isn't empty")
    s.sql("DROP TABLE suppliers")
    s.sql("CREATE TABLE suppliers (id INT PRIMARY KEY, name TEXT)")
    s.append("suppliers", _read(spark, sf_dir, "supplier").where("s_nationkey = 3").selectExpr("s_suppkey AS id", "s_name AS name"))
    return s.sql("SELECT id, name FROM suppliers")


@_query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def session_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read into another."""
    s, path = _suppliers(spark, sf_dir), scratch(spark, "copied")
    s.sql(f"COPY suppliers (id, name, balance) TO '{path}' WITH CSV")
    s.sql("CREATE TABLE again (id INT PRIMARY KEY, name TEXT, balance FLOAT)")
    s.sql(f"COPY again (id, name, balance) FROM '{path}' WITH CSV")
    return s.sql("SELECT id, name, balance FROM again")


@_query("SELECT n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def session_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables exported as a fixture, in the order of their references, and loaded into another log."""
    s = _session(spark, scratch(spark, "log"), "geo")
    s.sql("CREATE TABLE regions (id INT PRIMARY KEY, name TEXT)")
    s.sql("CREATE TABLE nations (id INT PRIMARY KEY, name TEXT, region INT REFERENCES regions(id))")
    s.append("regions", _read(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS name"))
    s.append("nations", _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region"))
    copy = _session(spark, scratch(spark, "log"), "geo")
    copy.load_fixture(s.export_fixture("geo", ["geo"]))
    return copy.sql("SELECT n.id, n.name, r.name AS region FROM nations n JOIN regions r ON n.region = r.id")


@_query(f"SELECT id, customer, status, total, _lsn FROM {_orders(25)}")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders replayed from the start of the log, without the checkpoint."""
    return state.state_at(_session(spark, _log(spark, sf_dir), "sales").ledger.changes("sales.orders"))


@_query("SELECT s_suppkey AS id, s_name || '!' AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE s_acctbal END AS balance FROM supplier")
def session_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction leaves that goes back to a savepoint and on from there."""
    s = _suppliers(spark, sf_dir)
    for text in (
        "BEGIN DOMAIN d", "UPDATE suppliers SET balance = 0 WHERE MOD(id, 2) = 0", "SAVEPOINT a", "DELETE FROM suppliers",
        "ROLLBACK TO a", "UPDATE suppliers SET name = name || '!'", "COMMIT",
    ):
        s.sql(text)
    return s.sql("SELECT id, name, balance FROM suppliers")


@_query("""SELECT * FROM (VALUES ('check', '23514'), ('conflict', '40001'), ('domain', '42501'), ('foreign key', '23503'), ('history', '42501'), ('json', '22P02'), ('moved key', '23505'),
           ('null', '23502'), ('primary key', '23505'), ('reference', '23000'), ('right', '42501'), ('unique', '23505'), ('used table', '2BP01')) AS t(what, sqlstate)""")
def session_sqlstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each kind of refused statement gives; nothing of them is left in the log."""
    from tidemark.operators.access import Policy
    from tidemark.session import Session

    s = _session(spark, scratch(spark, "log"), "d")
    s.sql("CREATE TABLE nations (id INT PRIMARY KEY, name TEXT NOT NULL UNIQUE, region INT CHECK (region >= 0), doc JSON)")
    s.sql("CREATE TABLE towns (id INT PRIMARY KEY, nation INT REFERENCES nations(id))")
    s.append("nations", _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region"))
    s.sql("BEGIN DOMAIN e")
    s.sql("CREATE TABLE visits (id INT PRIMARY KEY, nation INT, v INT, VERSIONED FOREIGN KEY (nation) REFERENCES d.nations(id) AS OF v)")
    s.sql("COMMIT")
    policy = Policy({"reader": {}, "admin": {"privileges": ["ADMIN"]}})

    def state(domains: list[str], text: str, principal: str = "admin") -> str | None:
        own = Session(spark, s.ledger.path, policy, principal)
        own.domains = domains
        try:
            own.sql(text)
        except Exception as e:
            return getattr(e, "sqlstate", None) or type(e).__name__
        return None

    head = s.head()
    rows = [
        ("primary key", state(["d"], "INSERT INTO nations (id, name) VALUES (3, 'x')")),
        ("unique", state(["d"], "UPDATE nations SET name = 'y' WHERE id < 2")),
        ("moved key", state(["d"], "UPDATE nations SET id = 7 WHERE id = 3")),
        ("null", state(["d"], "INSERT INTO nations (id, name) VALUES (NULL, 'x')")),
        ("check", state(["d"], "UPDATE nations SET region = -1 WHERE id = 1")),
        ("json", state(["d"], "UPDATE nations SET doc = '{' WHERE id = 1")),
        ("foreign key", state(["d"], "INSERT INTO towns (id, nation) VALUES (1, 99)")),
        ("used table", state(["d"], "DROP TABLE nations")),
        ("reference", state(["e"], "INSERT INTO visits (id, nation) VALUES (1, 99)")),
        ("domain", state(["e"], "SELECT id FROM d.nations")),
        ("right", state(["d"], "DELETE FROM nations", "reader")),
        ("history", state(["d"], "SELECT * FROM nations FOR HISTORY", "reader")),
    ]
    if s.head() != head:
        raise ValueError("a refused statement has left a commit")
    s.sql("BEGIN DOMAIN d")
    s.sql("UPDATE nations SET region = 0")
    _session(spark, s.ledger.path, "d").sql("DELETE FROM nations WHERE id = 0")
    try:
        s.sql("COMMIT")
    except RuntimeError as e:
        rows.append(("conflict", e.sqlstate))
    return spark.createDataFrame(rows, "what string, sqlstate string")
