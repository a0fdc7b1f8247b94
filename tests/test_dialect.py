"""The dialect through Session.sql: names, functions, versioned joins, system relations, access, and the commit protocol."""

import json
import threading

import pytest

from tidemark.operators.access import AccessError, Policy
from tidemark.operators.constraints import ConstraintError
from tidemark.session import Session
from tidemark.sources.ledger import Conflict


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = Session(spark, str(tmp_path_factory.mktemp("dialect") / "log"))
    s.sql("BEGIN DOMAIN sales")
    s.sql("CREATE TABLE orders (id INT PRIMARY KEY, status TEXT, total FLOAT, at TIMESTAMP, doc JSON)")
    s.sql("CREATE TABLE status (id INT PRIMARY KEY, name TEXT UNIQUE)")
    s.sql("CREATE TABLE lines (id INT PRIMARY KEY, order_id INT REFERENCES orders(id), qty INT)")
    s.sql("CREATE ENTITY ord (ROOT orders, INCLUDES lines)")
    s.sql("CREATE INDEX by_status ON orders (status)")
    s.sql("COMMIT")
    s.sql("BEGIN DOMAIN sales")
    s.sql("INSERT INTO orders (id, status, total, at, doc) VALUES (1, ' é ', 10.5, TIMESTAMP_NTZ '2024-01-07 10:20:30', '{\"a\": {\"b\": 3}}'), (2, 'AS OF LSN 1', 21.5, NULL, NULL), (4, '3.7', 7, NULL, NULL)")
    s.sql("INSERT INTO status (id, name) VALUES (1, 'one')")
    s.sql("COMMIT")
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "query, want",
    [
        ("SELECT id, status FROM orders WHERE id = 2", [(2, "AS OF LSN 1")]),
        ("SELECT id FROM orders WHERE status = 'AS OF LSN 1'", [(2,)]),
        ("WITH orders AS (SELECT 99 AS id) SELECT id FROM orders", [(99,)]),
        ("WITH orders AS (SELECT id FROM orders WHERE id > 2) SELECT id FROM orders", [(4,)]),
        ("SELECT sales.orders.id FROM sales.orders, sales.status s WHERE s.id = sales.orders.id", [(1,)]),
        ("SELECT o.id FROM orders o WHERE EXISTS (SELECT 1 FROM status WHERE status.id = o.id)", [(1,)]),
        ("SELECT AVG(id) AS a, AVG(total) AS b, AVG(id + total) AS c FROM orders", [(2, 13.0, 46 / 3)]),
        ("SELECT id, AVG(id) OVER (ORDER BY id) AS a FROM orders", [(1, 1), (2, 1), (4, 2)]),
        ("SELECT LENGTH(status) AS n, TRIM(status) AS t, LEFT(status, -1) AS l, SUBSTRING(status, 0, 2) AS s FROM orders WHERE id = 1", [(4, "é", "", " é")]),
        ("SELECT MOD(id, 0) AS m, MOD(7, 4) AS n, CAST(status AS INT) AS i, status::FLOAT AS f, total::INT AS t FROM orders WHERE id <> 1", [(None, 3, 3, 3.7, 7), (None, 3, None, None, 21)]),
        ("SELECT EXTRACT(DOW FROM at) AS d, EXTRACT('epoch', at) AS e, EXTRACT(century FROM at) AS c, doc->'a'->>'b' AS b FROM orders WHERE id = 1", [(0, 1704622830.0, None, "3")]),
        ("SELECT CEIL(total) AS c, FLOOR(id) AS f, ROUND(total) AS r FROM orders WHERE id = 1", [(11.0, 1, 11.0)]),
        ("SELECT DATE_TRUNC('week', at) IS NULL AS w, DATE_TRUNC('era', at) AS e FROM orders WHERE id = 1", [(False, None)]),
        ("SELECT 'it''s' AS s, 'a\\b' AS b, /* FROM x */ 1 AS one", [("it's", "a\\b", 1)]),
        ("SELECT table_name FROM information_schema.tables WHERE table_schema = 'sales'", [("lines",), ("orders",), ("status",)]),
        ("SELECT t.tablename, t.hasindexes FROM pg_tables t JOIN pg_catalog.pg_namespace n ON n.nspname = t.schemaname WHERE t.hasindexes", [("orders", True)]),
        ("SELECT conname FROM pg_constraint WHERE contype = 'f'", [("lines_order_id_fkey",)]),
        ("SELECT column_name FROM information_schema.columns WHERE table_name = 'lines' AND is_nullable = 'NO'", [("id",)]),
        ("SELECT __operation, id FROM admin.row_history('SELECT * FROM status FOR HISTORY')", [("INSERT", 1)]),
        ("SELECT version, tables FROM admin.entity_version_history('sales', 'ord', 2)", [(1, ["orders"])]),
        ("SELECT operation FROM admin.timeline_commits WHERE table_name = 'status'", [("CREATE_TABLE",), ("INSERT",)]),
        ("SELECT tables, commits FROM admin.replay_to_lsn(7)", [(3, 1)]),
        ("SELECT node, role FROM admin.leadership_state", [("local", "leader")]),
        ("SELECT current_lsn() AS l, row_lsn('orders', 2) AS r, entity_version('sales', 'ord', 1) AS v, entity_head_lsn('sales', 'ord', 1) AS h, entity_version_lsn('sales', 'ord', 1, 9) AS n, resolve_reference('sales.orders', 1) AS f", [(11, 11, 1, 11, None, 1)]),
        ("SELECT has_table_privilege('orders', 'SELECT') AS p, current_database() AS d, current_schema() AS s", [(True, "tidemark", "sales")]),
    ],
)
def test_query(session, query, want):
    assert rows(session.sql(query)) == sorted(want, key=repr)


def test_now_is_the_time_of_the_last_commit(session):
    a, b = (session.sql("SELECT NOW() AS t").first()[0] for _ in range(2))
    assert a == b and a.endswith("Z")


def test_settings_and_explain(session):
    session.sql("SET application_name = 'x y'")
    assert rows(session.sql("SHOW application_name")) == [("application_name", "x y")]
    session.sql("RESET application_name")
    assert rows(session.sql("SHOW application_name")) == [("application_name", "")]
    row = session.sql("EXPLAIN SELECT id FROM orders WHERE id = 1").first()
    assert (row.operation, row.domain, row.table) == ("SELECT", "sales", "orders") and "Filter" in row.access_plan
    assert json.loads(row.plan_shape)["nodes"]
    assert session.sql("EXPLAIN DELETE FROM orders WHERE id = 1").first().table == "orders"


@pytest.fixture
def fresh(spark, tmp_path):
    s = Session(spark, str(tmp_path / "log"))
    s.sql("BEGIN DOMAIN a")
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT UNIQUE, w TEXT)")
    s.sql("CREATE TABLE u (id INT PRIMARY KEY, v INT)")
    s.sql("COMMIT")
    return s


def test_racing_commits(fresh):
    other = Session(fresh.spark, fresh.ledger.path)
    for s in (fresh, other):
        s.sql("BEGIN DOMAIN a")
    fresh.sql("INSERT INTO t (id) VALUES (1)")
    fresh.sql("UPDATE t SET w = 'x' WHERE id = 1")
    other.sql("INSERT INTO t (id) VALUES (2)")
    other.sql("INSERT INTO u (id) VALUES (2)")
    other.sql("INSERT INTO u (id) VALUES (3)")
    done = []
    threads = [threading.Thread(target=lambda s=s: done.append(s.sql("COMMIT"))) for s in (other,)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    with pytest.raises(Conflict):  # its UPDATE is of a table that changed meanwhile
        fresh.sql("COMMIT")
    fresh.sql("INSERT INTO t (id) VALUES (1)")
    assert rows(other.sql("SELECT id FROM t")) == [(1,), (2,)]
    lsns = [c["lsn"] for c in other.ledger.commits()]
    assert lsns == sorted(set(lsns))


def test_inserts_of_two_writers_both_stand(fresh):
    other = Session(fresh.spark, fresh.ledger.path)
    other.domains = ["a"]
    fresh.sql("BEGIN DOMAIN a")
    fresh.sql("INSERT INTO t (id) VALUES (1)")
    publish, first = fresh.ledger.publish, []

    def late(record, number=None):
        if not first:
            first.append(other.sql("INSERT INTO t (id) VALUES (2)"))  # between reading the head and publishing
        publish(record, number)

    fresh.ledger.publish = late
    fresh.sql("COMMIT")
    assert rows(fresh.sql("SELECT id FROM t")) == [(1,), (2,)]
    fresh.sql("BEGIN DOMAIN a")
    fresh.sql("INSERT INTO t (id) VALUES (5)")
    first.clear()
    other_insert = other.sql
    other.sql = lambda text: other_insert("INSERT INTO t (id) VALUES (5)")
    with pytest.raises(ConstraintError):  # checked again on the new head
        fresh.sql("COMMIT")


def test_table_made_anew_is_empty(fresh):
    fresh.sql("INSERT INTO t (id) VALUES (1)")
    fresh.sql("DROP TABLE t")
    fresh.sql("CREATE TABLE t (id INT PRIMARY KEY, z TEXT)")
    assert rows(fresh.sql("SELECT id, z FROM t")) == []
    fresh.sql("BEGIN DOMAIN a")
    fresh.sql("INSERT INTO t (id, z) VALUES (7, 'gone')")
    fresh.sql("DROP TABLE t")
    fresh.sql("CREATE TABLE t (id INT PRIMARY KEY, z TEXT)")
    fresh.sql("INSERT INTO t (id, z) VALUES (8, 'new')")
    fresh.sql("ALTER TABLE t ADD COLUMN y INT DEFAULT 5")
    fresh.sql("INSERT INTO t (id) VALUES (9)")
    fresh.sql("COMMIT")
    assert rows(fresh.sql("SELECT id, z, y FROM t")) == [(8, "new", 5), (9, None, 5)]


def test_on_conflict_in_order(fresh):
    fresh.sql("INSERT INTO t (id, v, w) VALUES (1, 1, 'a'), (1, 2, 'b') ON CONFLICT (id) DO NOTHING")
    assert rows(fresh.sql("SELECT id, v, w FROM t")) == [(1, 1, "a")]
    fresh.sql("INSERT INTO t (id, v, w) VALUES (2, 5, 'a'), (2, 6, 'RETURNING id') ON CONFLICT (id) DO UPDATE SET w = EXCLUDED.w")
    assert rows(fresh.sql("SELECT id, v, w FROM t WHERE id = 2")) == [(2, 5, "RETURNING id")]
    fresh.sql("INSERT INTO t (id, v, w) VALUES (3, 5, 'c'), (4, NULL, 'd'), (5, NULL, 'e') ON CONFLICT (v) DO UPDATE SET w = EXCLUDED.w")
    assert rows(fresh.sql("SELECT id, w FROM t WHERE id > 1")) == [(2, "c"), (4, "d"), (5, "e")]
    fresh.sql("CREATE INDEX i ON t (v)")
    fresh.sql("CREATE INDEX IF NOT EXISTS i ON u (v)")
    assert fresh.ledger.catalog()["indexes"]["i"]["table"] == "a.t"


def test_segments_and_torn_files(fresh, monkeypatch):
    from tidemark.sources import ledger

    monkeypatch.setattr(ledger, "SEGMENT", 2)
    for i in range(3):
        fresh.sql(f"INSERT INTO u (id) VALUES ({i})")
    fresh.ledger.write_json("commits/_torn", {})
    again = Session(fresh.spark, fresh.ledger.path)
    again.domains = ["a"]
    assert len(again.ledger.commits()) == 4 and again.ledger._names("segments") == [f"{n:020d}.json" for n in (2, 4)]
    assert rows(again.sql("SELECT id FROM u")) == [(0,), (1,), (2,)] and not again.ledger._names("staged")


def test_versioned_joins_in_sql(spark, tmp_path):
    s = Session(spark, str(tmp_path / "log"))
    s.sql("BEGIN DOMAIN sales")
    s.sql("CREATE TABLE orders (id INT PRIMARY KEY, status TEXT)")
    s.sql("CREATE TABLE lines (id INT PRIMARY KEY, order_id INT REFERENCES orders(id), qty INT)")
    s.sql("CREATE TABLE rates (id INT PRIMARY KEY, rate FLOAT)")
    s.sql("CREATE ENTITY ord (ROOT orders, INCLUDES lines)")
    s.sql("COMMIT")
    s.sql("BEGIN CROSS DOMAIN ship, sales")
    s.sql(
        "CREATE TABLE ship.parcel (id INT PRIMARY KEY, order_id INT, v INT, rate_id INT, at INT, "
        "VERSIONED FOREIGN KEY (order_id) REFERENCES sales.orders(id) AS OF v, VERSIONED FOREIGN KEY (rate_id) REFERENCES sales.rates(id) AS OF at)"
    )
    s.sql("INSERT INTO sales.orders (id, status) VALUES (1, 'new')")
    s.sql("INSERT INTO sales.rates (id, rate) VALUES (1, 0.5)")
    s.sql("INSERT INTO sales.lines (id, order_id, qty) VALUES (10, 1, 5)")
    s.sql("INSERT INTO ship.parcel (id, order_id, rate_id) VALUES (1, 1, 1)")  # versions pending in this transaction
    s.sql("COMMIT")
    s.sql("BEGIN DOMAIN sales")
    s.sql("UPDATE lines SET qty = 6 WHERE id = 10")
    s.sql("COMMIT")
    s.sql("BEGIN CROSS DOMAIN ship, sales")
    s.sql("UPDATE sales.orders SET status = 'sent' WHERE id = 1")
    s.sql("UPDATE sales.rates SET rate = 0.7 WHERE id = 1")
    s.sql("INSERT INTO ship.parcel (id, order_id) VALUES (2, 1)")
    s.sql("INSERT INTO ship.parcel (id, order_id, v) VALUES (3, 1, 99)")
    s.sql("COMMIT")
    assert rows(s.sql("SELECT id, v FROM ship.parcel")) == [(1, 1), (2, 3), (3, 99)]
    first = "SELECT p.id, o.status, l.qty FROM ship.parcel p JOIN sales.orders o ON p.order_id = o.id LEFT JOIN sales.lines l ON l.order_id = o.id WHERE p.id > 0"
    assert rows(s.sql(first)) == [(1, "new", 5), (2, "sent", 6), (3, "sent", 6)]
    second = "SELECT parcel.id, r.rate FROM ship.parcel LEFT JOIN sales.rates AS r ON parcel.rate_id = r.id"
    assert rows(s.sql(second)) == [(1, 0.5), (2, None), (3, None)]
    assert [c for c in s.sql("SELECT * FROM ship.parcel p JOIN sales.orders o ON p.order_id = o.id").columns if c.startswith("__")] == []
    s.sql("BEGIN CROSS DOMAIN ship, sales")
    s.sql("UPDATE ship.parcel SET v = NULL WHERE id = 1")  # captured anew
    s.sql("COMMIT")
    assert rows(s.sql("SELECT id, v FROM ship.parcel WHERE id = 1")) == [(1, 3)]


def test_access(fresh):
    fresh.sql("INSERT INTO t (id) VALUES (1)")
    policy = Policy({"ann": {"privileges": ["ADMIN"]}, "bob": {"roles": ["past"]}, "past": {"roles": ["bob"], "privileges": ["SELECT_HISTORY"]}, "cat": {}, "dan": {"enabled": False, "roles": ["ann"]}})

    def act(name, text):
        s = Session(fresh.spark, fresh.ledger.path, policy, name)
        s.domains = ["a"]
        return s.sql(text)

    act("ann", "INSERT INTO t (id) VALUES (2)")
    assert rows(act("cat", "SELECT id FROM t")) == [(1,), (2,)] and act("bob", "SELECT * FROM t FOR HISTORY").count() == 2
    for name, text in (("cat", "SELECT * FROM t FOR HISTORY"), ("cat", "SELECT id FROM t AS OF LSN 1"), ("bob", "DELETE FROM t"), ("dan", "SELECT id FROM t"), ("eve", "SELECT id FROM t")):
        with pytest.raises(AccessError) as e:
            act(name, text)
        assert e.value.sqlstate == "42501"


def test_copy_fixture_backup_and_preflight(fresh, tmp_path):
    (tmp_path / "in.tsv").write_text("1\t5\tx y\n2\t\\N\tz\n")
    fresh.sql(f"COPY t (id, v, w) FROM '{tmp_path}/in.tsv'")
    fresh.sql(f"COPY (SELECT id, w FROM t WHERE id > 1) TO '{tmp_path}/out' WITH CSV")
    assert [p.read_text() for p in (tmp_path / "out").glob("*.csv") if p.stat().st_size] == ["2,z\n"]
    with pytest.raises(ValueError):
        fresh.sql(f"COPY t (id) FROM '{tmp_path}/in.tsv' WITH BINARY")
    text = fresh.export_fixture("f", ["a"])
    copy = Session(fresh.spark, str(tmp_path / "copy"))
    copy.load_fixture(text)
    assert rows(copy.table("a.t").drop("_lsn")) == rows(fresh.table("a.t").drop("_lsn"))
    commits = fresh.ledger.commits()
    fresh.sql("DELETE FROM t WHERE id = 1")
    fresh.ledger.backup(str(tmp_path / "then"), timestamp=commits[-1]["time"])
    assert Session(fresh.spark, str(tmp_path / "then")).head() == commits[-1]["lsn"]
    assert fresh.preflight(["ALTER TABLE t ADD COLUMN z INT", "CREATE INDEX k ON t (w)"], None, str(tmp_path / "try"))


def test_tail_follow_in_sql(fresh, tmp_path):
    fresh.sql("CREATE ENTITY e (ROOT t)")
    for i in range(3):
        fresh.sql(f"INSERT INTO t (id) VALUES ({i})")
    seen = []
    query = fresh.sql(f"TAIL ENTITY CHANGES a.e FROM LSN 1 TO LSN {fresh.head()} FOLLOW", handle=lambda df, _: seen.extend(r.root_pk for r in df.collect()))
    query.awaitTermination()
    assert seen == [0, 1, 2]
    few = []
    query = fresh.sql("TAIL ENTITY CHANGES a.e LIMIT 2 FOLLOW", handle=lambda df, _: few.extend(r.root_pk for r in df.collect()))
    query.awaitTermination(60)
    assert few == [0, 1]
    assert rows(fresh.sql("TAIL ENTITY CHANGES a.e FOR 2").select("root_pk")) == [(2,)]


def test_moved_keys(fresh):
    fresh.sql("INSERT INTO t (id, v) VALUES (1, 1), (2, 2), (3, 3)")
    fresh.sql("UPDATE t SET id = id + 10 WHERE id < 3")
    assert rows(fresh.sql("SELECT id, v FROM t")) == [(11, 1), (12, 2), (3, 3)]
    for text in ("UPDATE t SET id = 3 WHERE id = 11", "UPDATE t SET v = 3 WHERE id = 11", "INSERT INTO t (id, v) VALUES (3, 9) ON CONFLICT (v) DO NOTHING"):
        with pytest.raises(ConstraintError) as e:
            fresh.sql(text)
        assert e.value.sqlstate == "23505"


def test_parameters(fresh):
    fresh.sql("INSERT INTO t (id, w) VALUES ($1, $2), ($3, '$1')", {"1": 1, "2": "it's", "3": 2})
    assert rows(fresh.sql("SELECT w FROM t WHERE id = $id", {"id": 1})) == [("it's",)]
    assert rows(fresh.sql("SELECT id FROM t WHERE w = '$1' OR $flag", {"1": "no", "flag": None})) == [(2,)]


def test_indexes(fresh):
    fresh.sql("CREATE INDEX i ON t (v)")
    fresh.sql("CREATE INDEX j ON t (v, w) USING BTREE")
    with pytest.raises(ValueError):
        fresh.sql("CREATE INDEX k ON t (v, w) USING HASH")
    assert rows(fresh.sql("SELECT indexname FROM pg_indexes")) == [("i",), ("j",)]
    fresh.sql("ALTER TABLE t RENAME COLUMN w TO x")
    fresh.sql("DROP INDEX i")
    fresh.sql("DROP INDEX IF EXISTS i")
    assert fresh.ledger.catalog()["indexes"]["j"]["columns"] == ["v", "x"]
    fresh.sql("ALTER TABLE t DROP COLUMN x")
    assert fresh.ledger.catalog()["indexes"] == {}
