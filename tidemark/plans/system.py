"""System relations: what a log's catalog, commits and session look like as tables.

Their rows come from the catalog and the commit records, which the driver holds anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

#: Schemas that hold system relations.
SCHEMAS = frozenset({"information_schema", "pg_catalog", "admin"})
#: Object ids that the relations of pg_catalog give to types of the dialect; the numbers are fixed by PostgreSQL.
_TYPE_IDS = {"INT": 20, "FLOAT": 701, "TEXT": 25, "BOOL": 16, "TIMESTAMP": 1114, "JSON": 114}
_TYPE_NAMES = {"INT": "bigint", "FLOAT": "double precision", "TEXT": "text", "BOOL": "boolean", "TIMESTAMP": "timestamp without time zone", "JSON": "json"}
_FIRST_ID = 16384


class Catalog:
    """A catalog as of a commit, with stable numbers for its domains, tables and constraints."""

    def __init__(self, catalog: dict[str, Any]) -> None:
        self.tables, self.entities, self.indexes = catalog["tables"], catalog["entities"], catalog["indexes"]
        self.domains = sorted({t.split(".")[0] for t in self.tables})
        self.space = {d: _FIRST_ID + i for i, d in enumerate(self.domains)}
        self.number = {t: _FIRST_ID + 1000 + i for i, t in enumerate(sorted(self.tables))}

    def columns(self):
        for name in sorted(self.tables):
            for i, c in enumerate(self.tables[name]["columns"]):
                yield (*name.split("."), name, i + 1, c)

    def constraints(self):
        """(name, domain, table, type, columns, referenced table)"""
        for name in sorted(self.tables):
            domain, table = name.split(".")
            d = self.tables[name]
            yield f"{table}_pkey", domain, table, "PRIMARY KEY", [d["pk"]], None
            for c in d["columns"]:
                if c.get("unique"):
                    yield f"{table}_{c['name']}_key", domain, table, "UNIQUE", [c["name"]], None
                if c.get("references"):
                    yield f"{table}_{c['name']}_fkey", domain, table, "FOREIGN KEY", [c["name"]], f"{domain}.{c['references'][0]}"
                if c.get("check"):
                    yield f"{table}_{c['name']}_check", domain, table, "CHECK", [c["name"]], None
            for v in d["versioned"]:
                yield f"{table}_{v['column']}_vfkey", domain, table, "VERSIONED FOREIGN KEY", [v["column"]], v["table"]


def _schemata(c: Catalog):
    return "catalog_name string, schema_name string", [("tidemark", d) for d in c.domains]


def _tables(c: Catalog):
    return "table_catalog string, table_schema string, table_name string, table_type string", [("tidemark", *t.split("."), "BASE TABLE") for t in sorted(c.tables)]


def _columns(c: Catalog):
    rows = [("tidemark", d, t, col["name"], i, col.get("default"), "NO" if col.get("not_null") or col["name"] == c.tables[full]["pk"] else "YES", _TYPE_NAMES[col["kind"]]) for d, t, full, i, col in c.columns()]
    return "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string", rows


def _table_constraints(c: Catalog):
    return "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string", [(d, n, d, t, kind) for n, d, t, kind, _, _ in c.constraints()]


def _key_column_usage(c: Catalog):
    rows = [(d, n, d, t, col, i + 1) for n, d, t, kind, cols, _ in c.constraints() if kind != "CHECK" for i, col in enumerate(cols)]
    return "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int", rows


def _pg_tables(c: Catalog):
    indexed = {x["table"] for x in c.indexes.values()}
    return "schemaname string, tablename string, tableowner string, hasindexes boolean", [(*t.split("."), "tidemark", t in indexed) for t in sorted(c.tables)]


def _pg_namespace(c: Catalog):
    return "oid long, nspname string", [(c.space[d], d) for d in c.domains]


def _pg_class(c: Catalog):
    rows = [(c.number[t], t.split(".")[1], c.space[t.split(".")[0]], "r", len(c.tables[t]["columns"])) for t in sorted(c.tables)]
    rows += [(_FIRST_ID + 100_000 + i, n, c.space[x["table"].split(".")[0]], "i", len(x["columns"])) for i, (n, x) in enumerate(sorted(c.indexes.items()))]
    return "oid long, relname string, relnamespace long, relkind string, relnatts int", rows


def _pg_attribute(c: Catalog):
    rows = [(c.number[full], col["name"], _TYPE_IDS[col["kind"]], i, bool(col.get("not_null")) or col["name"] == c.tables[full]["pk"]) for _, _, full, i, col in c.columns()]
    return "attrelid long, attname string, atttypid int, attnum int, attnotnull boolean", rows


def _pg_type(c: Catalog):
    return "oid int, typname string", [(_TYPE_IDS[k], k.lower()) for k in _TYPE_IDS]


def _pg_constraint(c: Catalog):
    kinds = {"PRIMARY KEY": "p", "UNIQUE": "u", "FOREIGN KEY": "f", "CHECK": "c", "VERSIONED FOREIGN KEY": "f"}
    rows = [(_FIRST_ID + 200_000 + i, n, kinds[kind], c.number[f"{d}.{t}"], c.number.get(ref, 0)) for i, (n, d, t, kind, _, ref) in enumerate(c.constraints())]
    return "oid long, conname string, contype string, conrelid long, confrelid long", rows


def _pg_indexes(c: Catalog):
    rows = [(*x["table"].split("."), n, f"CREATE INDEX {n} ON {x['table']} ({', '.join(x['columns'])}) USING {x['using'].upper()}") for n, x in sorted(c.indexes.items())]
    return "schemaname string, tablename string, indexname string, indexdef string", rows


def _schema_snapshot(c: Catalog):
    rows = [(d, t, col["name"], col["type"], col["name"] == c.tables[full]["pk"], bool(col.get("not_null"))) for d, t, full, _, col in c.columns()]
    return "domain string, table_name string, column_name string, data_type string, primary_key boolean, not_null boolean", rows


#: Relations that a catalog gives, by name.
OF_CATALOG: dict[str, Callable[[Catalog], tuple[str, list[tuple]]]] = {
    "information_schema.schemata": _schemata,
    "information_schema.tables": _tables,
    "information_schema.columns": _columns,
    "information_schema.table_constraints": _table_constraints,
    "information_schema.key_column_usage": _key_column_usage,
    "pg_catalog.pg_tables": _pg_tables,
    "pg_catalog.pg_namespace": _pg_namespace,
    "pg_catalog.pg_class": _pg_class,
    "pg_catalog.pg_attribute": _pg_attribute,
    "pg_catalog.pg_type": _pg_type,
    "pg_catalog.pg_constraint": _pg_constraint,
    "pg_catalog.pg_indexes": _pg_indexes,
    "admin.schema_snapshot": _schema_snapshot,
}


def full_name(name: str) -> str:
    """The dotted name of a system relation; those of pg_catalog may be bare."""
    return f"pg_catalog.{name}" if name.startswith("pg_") and "." not in name else name


def clock(seconds: float) -> str:
    """A commit's time as text."""
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def create_table(name: str, definition: dict) -> str:
    """The statement that makes a table of this definition."""
    parts = []
    for c in definition["columns"]:
        text = f"{c['name']} {c['kind']}"
        text += " PRIMARY KEY" if c["name"] == definition["pk"] else ""
        text += " NOT NULL" if c.get("not_null") else ""
        text += " UNIQUE" if c.get("unique") else ""
        text += f" DEFAULT {c['default']}" if c.get("default") is not None else ""
        text += f" REFERENCES {c['references'][0]}({c['references'][1]})" if c.get("references") else ""
        parts.append(text + (f" CHECK ({c['check']})" if c.get("check") else ""))
    parts += [f"VERSIONED FOREIGN KEY ({v['column']}) REFERENCES {v['table']}({v['parent_column']}) AS OF {v['lsn_column']}" for v in definition["versioned"]]
    return f"CREATE TABLE {name} ({', '.join(parts)})"


def by_reference(tables: dict[str, dict]) -> list[str]:
    """Names of tables, each behind those that it refers to; a reference in a circle is passed over."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if name in state:
            return
        state[name] = 1
        domain = name.split(".")[0]
        refs = [f"{domain}.{c['references'][0]}" for c in tables[name]["columns"] if c.get("references")] + [v["table"] for v in tables[name]["versioned"]]
        for ref in sorted(refs):
            if ref in tables:
                visit(ref)
        out.append(name)

    for name in sorted(tables):
        visit(name)
    return out
