"""Principals, roles and what they may do."""

from __future__ import annotations

from collections.abc import Mapping

ADMIN, HISTORY = "ADMIN", "SELECT_HISTORY"


class AccessError(PermissionError):
    """A principal without the right; SQLSTATE 42501."""

    sqlstate = "42501"


class Policy:
    """Principals by name: {"enabled": bool, "roles": [principals whose privileges it has too], "privileges": [...]}.

    Any enabled principal reads tables as they are now. ADMIN is needed to write, SELECT_HISTORY or ADMIN to read the past.
    """

    def __init__(self, principals: Mapping[str, Mapping]) -> None:
        self.principals = {name: dict(p) for name, p in principals.items()}

    def privileges(self, name: str) -> set[str]:
        """Those of a principal and, through any number of steps, of its roles; disabled roles give none."""
        found, todo, seen = set(), [name], set()
        while todo:
            at = todo.pop()
            p = self.principals.get(at)
            if at in seen or p is None or not p.get("enabled", True):
                continue
            seen.add(at)
            found.update(p.get("privileges", ()))
            todo += p.get("roles", ())
        return found

    def check(self, name: str | None, needed: str | None) -> None:
        """Raise AccessError unless the principal is enabled and has the privilege; None stands for reading."""
        p = self.principals.get(name)
        if p is None or not p.get("enabled", True):
            raise AccessError(f"{name} is no enabled principal")
        if needed is not None and not self.privileges(name) & {needed, ADMIN}:
            raise AccessError(f"{name} lacks {needed}")
