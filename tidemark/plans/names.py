"""Names of tables across domains: bare names resolve in the first domain, IMPORT adds others for one query."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_IMPORT = re.compile(r"\s*IMPORT\s+(\w+)\.(\w+)(?:\s+AS\s+(\w+))?\s*;", re.I)


class DomainError(PermissionError):
    """A table outside the query's domains; SQLSTATE 42501."""

    sqlstate = "42501"


def split_imports(text: str) -> tuple[list[tuple[str, str, str]], str]:
    """The (domain, table, name) of each leading IMPORT, and what follows."""
    found = []
    while m := _IMPORT.match(text):
        found.append((m[1].lower(), m[2].lower(), (m[3] or m[2]).lower()))
        text = text[m.end() :]
    return found, text.strip().rstrip(";")


class Domains:
    """Tables by domain and name."""

    def __init__(self, tables: Mapping[str, Mapping[str, DataFrame]]) -> None:
        self.tables = {d.lower(): {t.lower(): df for t, df in some.items()} for d, some in tables.items()}

    def visible(self, domains: Sequence[str], imports: Sequence[tuple[str, str, str]] = ()) -> dict[str, DataFrame]:
        """The tables that a query in these domains sees, by bare and by dotted name."""
        names: dict[str, DataFrame] = {}
        for d in domains:
            for t, df in self.tables[d.lower()].items():
                names.setdefault(t, df)
                names[f"{d.lower()}.{t}"] = df
        for d, t, name in imports:
            if t not in self.tables.get(d, {}):
                raise DomainError(f"no table {d}.{t} to import")
            names[name] = self.tables[d][t]
        return names

    def sql(self, spark: SparkSession, text: str, domains: Sequence[str]) -> DataFrame:
        """A query over the visible tables; no view of them is left behind."""
        from tidemark.plans import dialect

        imports, text = split_imports(text)
        names = self.visible(domains, imports)

        def table(name: str) -> tuple[str, DataFrame] | None:
            if name in names:
                return name, names[name]
            if "." in name and name.split(".")[0] in self.tables:
                raise DomainError(f"{name} lies outside the query's domains")
            return None

        return dialect.query(spark, text, dialect.Binder(table, domains=self.tables))
