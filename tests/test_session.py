import json

import pytest

from tidemark.operators.constraints import ConstraintError
from tidemark.plans.names import DomainError
from tidemark.session import Session
from tidemark.sources.ledger import Conflict


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, str(tmp_path / "log"))
    s.sql("BEGIN DOMAIN sales")
    s.sql("CREATE TABLE orders (id INT PRIMARY KEY, status TEXT NOT NULL DEFAULT 'new', total FLOAT CHECK (total >= 0))")
    s.sql("CREATE TABLE lines (id INT PRIMARY KEY DEFAULT AUTOINCREMENT, order_id INT REFERENCES orders(id), qty INT)")
    s.sql("CREATE ENTITY ord (ROOT orders, INCLUDES lines)")
    s.sql("COMMIT")
    s.sql("BEGIN DOMAIN sales")
    s.sql("INSERT INTO orders (id, total) VALUES (1, 10.5), (2, 20)")
    s.sql("INSERT INTO lines (order_id, qty) VALUES (1, 5), (2, 7)")
    s.sql("COMMIT")
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_time_travel_and_history(session):
    before = session.head()
    session.sql("UPDATE orders SET status = 'paid', total = total * 2 WHERE id = 1")
    session.sql("DELETE FROM orders WHERE id = 2")
    assert rows(session.sql("SELECT id, status, total FROM orders")) == [(1, "paid", 21.0)]
    assert rows(session.sql(f"SELECT o.id, l.qty FROM orders o JOIN lines l ON o.id = l.order_id AS OF LSN {before}")) == [(1, 5), (2, 7)]
    history = session.sql("SELECT * FROM orders FOR HISTORY").select("__operation", "id").collect()
    assert [tuple(r) for r in history][2:] == [("UPDATE", 1), ("DELETE", 2)]
    versions = rows(session.entity_versions("sales", "ord").select("root_pk", "version"))
    assert versions == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize(
    "statement, state",
    [
        ("INSERT INTO orders (id, total) VALUES (1, 1)", "23505"),
        ("INSERT INTO lines (order_id, qty) VALUES (77, 1)", "23503"),
        ("INSERT INTO orders (id, total) VALUES (5, -1)", "23514"),
        ("INSERT INTO orders (id, status, total) VALUES (6, NULL, 1)", "23502"),
    ],
)
def test_constraints(session, statement, state):
    head = session.head()
    with pytest.raises(ConstraintError) as e:
        session.sql(statement)
    assert e.value.sqlstate == state and session.head() == head


def test_savepoint_upsert_and_schema_changes(session):
    session.sql("BEGIN DOMAIN sales")
    session.sql("INSERT INTO orders (id, total) VALUES (1, 99), (3, 30) ON CONFLICT (id) DO UPDATE SET total = EXCLUDED.total")
    session.sql("SAVEPOINT a")
    session.sql("DELETE FROM orders WHERE id = 3")
    session.sql("ROLLBACK TO a")
    session.sql("COMMIT")
    session.sql("ALTER TABLE orders ADD COLUMN note TEXT DEFAULT 'n'")
    session.sql("ALTER TABLE orders RENAME COLUMN note TO remark")
    session.sql("ALTER TABLE orders DROP COLUMN status")
    assert rows(session.sql("SELECT id, total, remark FROM orders")) == [(1, 99.0, "n"), (2, 20.0, "n"), (3, 30.0, "n")]


def test_conflict_is_found(session):
    other = Session(session.spark, session.ledger.path)
    session.sql("BEGIN DOMAIN sales")
    session.sql("UPDATE orders SET total = 1 WHERE id = 1")
    other.domains = ["sales"]
    other.sql("UPDATE orders SET total = 2 WHERE id = 1")
    with pytest.raises(Conflict):
        session.sql("COMMIT")


def test_domains_and_versioned_references(session):
    session.sql("BEGIN DOMAIN ship")
    session.sql("CREATE TABLE parcel (id INT PRIMARY KEY, order_id INT, v INT, VERSIONED FOREIGN KEY (order_id) REFERENCES sales.orders(id) AS OF v)")
    session.sql("COMMIT")
    with pytest.raises(DomainError):
        session.sql("SELECT id FROM sales.orders")
    assert rows(session.sql("IMPORT sales.orders; SELECT id FROM orders")) == [(1,), (2,)]
    session.sql("BEGIN CROSS DOMAIN ship, sales")
    session.sql("UPDATE sales.orders SET status = 'sent' WHERE id = 1")
    session.sql("INSERT INTO ship.parcel (id, order_id) VALUES (1, 1), (2, 2)")
    session.sql("INSERT INTO ship.parcel (id, order_id, v) VALUES (3, 1, 1)")
    session.sql("COMMIT")
    seen = session.versioned_join("ship.parcel").select("id", "v", "version.row.status")
    assert rows(seen) == [(1, 2, "sent"), (2, 1, "new"), (3, 1, "new")]


def test_backup_checkpoint_preflight_and_fixture(session, tmp_path):
    session.checkpoint("sales.orders")
    session.sql("UPDATE orders SET total = 7 WHERE id = 2")
    manifest = session.ledger.backup(str(tmp_path / "copy"))
    copy = Session(session.spark, str(tmp_path / "copy"))
    copy.domains = ["sales"]
    assert copy.ledger.verify(manifest) == []
    assert rows(copy.table("sales.orders")) == rows(session.table("sales.orders"))
    assert session.preflight(["ALTER TABLE lines ADD COLUMN z INT"], ["ALTER TABLE lines DROP COLUMN z"], str(tmp_path / "try"))
    fixture = {"version": 1, "name": "f", "steps": [{"name": "a", "mode": "domain", "domains": ["sales"], "statements": ["INSERT INTO orders (id, total) VALUES (8, 1)"]}]}
    session.load_fixture(json.dumps(fixture))
    assert (8,) in rows(session.sql("SELECT id FROM orders"))
    fixture["steps"][0]["statements"] = ["INSERT INTO orders (id, total) VALUES (9, RANDOM())"]
    with pytest.raises(ValueError):
        session.load_fixture(json.dumps(fixture))


def test_copy_round_trip(session, tmp_path):
    (tmp_path / "in.csv").write_text('11,"a ""b"", c",4.5\n12,x,\n')
    session.domains = ["sales"]
    session.copy_from("orders", ["id", "status", "total"], str(tmp_path / "in.csv"), csv=True)
    assert rows(session.sql("SELECT id, status, total FROM orders WHERE id > 10")) == [(11, 'a "b", c', 4.5), (12, "x", None)]


def test_returning(session):
    assert rows(session.sql("INSERT INTO lines (order_id, qty) VALUES (1, 1) RETURNING id, qty")) == [(3, 1)]
    assert rows(session.sql("INSERT INTO orders (id, total) VALUES (6, 1) RETURNING *")) == [(6, "new", 1.0)]


def test_follow_resumes_and_replicates(session, tmp_path):
    from tidemark.streaming import tail

    seen = []
    handle = lambda df, _: seen.extend((r.commit_lsn, r.root_pk) for r in df.collect())
    for _ in range(2):
        tail.follow_entity(session, "sales", "ord", handle, str(tmp_path / "point")).awaitTermination()
        if len(seen) == 2:
            session.sql("UPDATE orders SET total = 3 WHERE id = 2")
    assert seen == [(9, 1), (9, 2), (session.head(), 2)]
    session.sql("ALTER TABLE orders ADD COLUMN note TEXT")
    for _ in range(2):
        tail.replicate(session.ledger, str(tmp_path / "copy"), str(tmp_path / "point2")).awaitTermination()
        session.sql("DELETE FROM lines WHERE qty = 5")
    copy = Session(session.spark, str(tmp_path / "copy"))
    for t in ("sales.orders", "sales.lines"):
        assert rows(copy.table(t)) == rows(session.table(t, copy.head()))
