"""Joins on one of several equalities, `ON a.x = b.x OR a.y = b.y`, as equi-joins.

Spark sorts and hashes rows by equalities that all pairs meet. Where each pair meets one of several it has the nested loop,
which compares every row with every other. Here a row is taken once for each alternative that it can meet, under the
alternative's number and keys, and one equi-join by both finds the pairs; a pair is kept under the first alternative that
holds, so once. Both sides are read once.

An outer join keeps a row that has no match under any alternative. Rows with the same values in the condition's columns
have the same matches, so a window over those columns, and over the partition that a row came from (which spreads frequent
values), tells that; of such a row one copy is left.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEPT = {"Inner": (), "LeftOuter": (0,), "RightOuter": (1,), "FullOuter": (0, 1)}
_HOW = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "FullOuter": "full"}


def _kind(x: Any) -> str:
    return x.getClass().getSimpleName()


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _flat(e: Any, kind: str) -> list[Any]:
    return _flat(e.left(), kind) + _flat(e.right(), kind) if _kind(e) == kind else [e]


def _of(e: Any, plan: Any) -> bool:
    """Whether an expression has columns, all of them of a plan."""
    return not e.references().isEmpty() and e.references().subsetOf(plan.outputSet())


class Splitter:
    """Rewrites such joins in the plan of a query."""

    def __init__(self, spark: SparkSession, hidden: str) -> None:
        self.spark, self.hidden, self.joins = spark, hidden, 0
        self.jvm = spark.sparkContext._jvm
        self.catalyst = self.jvm.org.apache.spark.sql.catalyst

    def apply(self, df: DataFrame) -> DataFrame:
        plan = df._jdf.queryExecution().analyzed()
        if plan.isStreaming() or not self._any(plan):
            return df
        # as the optimizer does: tables become parts of the plan, unless they are read twice and differ each time
        plan = self.catalyst.optimizer.InlineCTE(False, False).apply(plan)
        return self._frame(self._walk(plan, []))

    def _frame(self, plan: Any) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def _column(self, e: Any) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    def _and(self, parts: list[Any]) -> Any:
        whole = parts[0]
        for part in parts[1:]:
            whole = self.catalyst.expressions.And(whole, part)
        return whole

    def _any(self, plan: Any) -> bool:
        return self._found(plan) is not None or any(self._any(child) for child in _items(plan.children()))

    def _found(self, plan: Any) -> list[Any] | None:
        """The alternatives of a join, if it has several."""
        if _kind(plan) != "Join" or _kind_of_join(plan) not in _KEPT or plan.condition().isEmpty():
            return None
        condition = plan.condition().get()
        if not condition.deterministic() or self.catalyst.expressions.SubqueryExpression.hasSubquery(condition):
            return None
        found = self._alternatives(condition, plan.left(), plan.right())
        return found if found and len(found) > 1 else None

    def _alternatives(self, e: Any, left: Any, right: Any) -> list[Any] | None:
        """Conditions, each with an equality between the sides, of which one holds exactly where e does; None if e has no
        such form."""
        parts = _flat(e, "And")
        if any(self._equality(p, left, right) for p in parts):
            return [e]
        for k, p in enumerate(parts):
            if _kind(p) == "In":
                choice = [self.catalyst.expressions.EqualTo(p.value(), x) for x in _items(p.list())]
            else:
                choice = _flat(p, "Or")
            if (len(choice) > 1 or _kind(p) == "In") and all(found := [self._alternatives(c, left, right) for c in choice]):
                return [self._and([a, *parts[:k], *parts[k + 1 :]]) for f in found for a in f]
        return None

    @staticmethod
    def _equality(e: Any, left: Any, right: Any) -> tuple[Any, Any] | None:
        """Both sides of an equality between the sides of a join."""
        if _kind(e) in ("EqualTo", "EqualNullSafe"):
            for a, b in ((e.left(), e.right()), (e.right(), e.left())):
                if _of(a, left) and _of(b, right):
                    return a, b
        return None

    def _walk(self, plan: Any, filters: list[Any]) -> Any:
        """The plan with its joins rewritten; `filters` are conditions above it, which may as well be met earlier."""
        kind, children = _kind(plan), _items(plan.children())
        if not children:
            return plan
        passed = [[] for _ in children]
        if kind == "Filter":
            passed[0] = filters + [c for c in _flat(plan.condition(), "And") if c.deterministic() and not self.catalyst.expressions.SubqueryExpression.hasSubquery(c)]
        elif kind == "SubqueryAlias":
            passed[0] = filters
        elif kind == "Join" and _kind_of_join(plan) in ("Inner", "Cross", "LeftOuter", "RightOuter"):
            for side, lost in ((0, "RightOuter"), (1, "LeftOuter")):
                passed[side] = [c for c in filters if _of(c, children[side]) and _kind_of_join(plan) != lost]
        found = self._found(plan)
        made = [self._walk(child, down) for child, down in zip(children, passed)]
        if found and not any(self._shared(side) for side in made):
            made = [self.catalyst.plans.logical.Filter(self._and(down), side) if down else side for side, down in zip(made, passed)]
            return self._join(plan, found, *made)
        return plan if all(a is b for a, b in zip(made, children)) else plan.withNewChildren(self.jvm.PythonUtils.toSeq(made))

    def _shared(self, plan: Any) -> bool:
        """Whether a plan reads a table that others of the query read, too, and that can't be computed twice."""
        return _kind(plan) == "CTERelationRef" or any(self._shared(child) for child in _items(plan.children()))

    def _join(self, join: Any, alternatives: list[Any], left: Any, right: Any) -> Any:
        self.joins += 1
        how, prefix = _kind_of_join(join), f"{self.hidden}{self.joins}_"
        kept, sides = _KEPT[how], (left, right)
        keys: list[list[tuple[Any, Any, bool]]] = []
        for a in alternatives:
            found = [(p, self._equality(p, left, right)) for p in _flat(a, "And")]
            keys.append([(*sides_of, _kind(p) == "EqualNullSafe") for p, sides_of in found if sides_of])
        frames = [self._copies(side, s, alternatives, keys, s in kept, prefix) for s, side in enumerate(sides)]
        tags, parts = ([F.col(f"{prefix}{name}{s}") for s in (0, 1)] for name in ("tag", "part"))

        first = F.lit(None)
        for i in range(len(alternatives) - 1, -1, -1):
            first = F.when(self._column(alternatives[i]), F.lit(i)).otherwise(first)
        on = (tags[0] == tags[1]) & (tags[0] == first)
        for i, own in enumerate(keys):
            for j, (_, _, safe) in enumerate(own):
                a, b = (F.col(f"{prefix}key{i}_{j}_{s}") for s in (0, 1))
                on &= a.eqNullSafe(b) if safe else a == b
        df = frames[0].join(frames[1], on, _HOW[how])

        columns = _items(join.condition().get().references().toSeq())
        pair = tags[0].isNotNull() & tags[1].isNotNull()
        stays = pair
        for s in kept:
            same = [self._column(c) for c in columns if _of(c, sides[s])]
            other = [F.when(tags[s].isNull(), parts[1 - s])] if len(kept) > 1 else []
            w = Window.partitionBy(*same, parts[s], *other)
            met, least = f"{prefix}met{s}", f"{prefix}least{s}"
            df = df.select("*", F.max(pair).over(w).alias(met), F.min(tags[s]).over(w).alias(least))
            stays |= tags[1 - s].isNull() & ~F.col(met) & (tags[s] == F.col(least))
        if kept:
            df = df.where(stays)
        return df.select(*[self._column(c) for side in sides for c in _items(side.output())])._jdf.queryExecution().analyzed()

    def _copies(self, plan: Any, s: int, alternatives: list[Any], keys: list[list[tuple[Any, Any, bool]]], keep: bool, prefix: str) -> DataFrame:
        """A side's rows, one for each alternative that they can meet, with its number and keys. A row of a kept side that
        can meet none gets a number that the other side hasn't, a different one for each partition."""
        df, n = self._frame(plan), len(alternatives)
        tag, part = f"{prefix}tag{s}", f"{prefix}part{s}"
        if keep:
            df = df.select("*", F.spark_partition_id().alias(part))
        numbers = []
        for i, a in enumerate(alternatives):
            can = F.lit(True)
            for p in _flat(a, "And"):
                if _of(p, plan):
                    can &= self._column(p)
            for *own, safe in keys[i]:
                can &= F.lit(True) if safe else self._column(own[s]).isNotNull()
            numbers.append(F.when(can, F.lit(i)))
        copies = F.array_compact(F.array(*numbers))
        if keep:
            none = F.array(-1 - F.col(part) if s == 0 else n + F.col(part))
            copies = F.when(F.size(copies) > 0, copies).otherwise(none)
        df = df.select("*", F.explode(copies).alias(tag))
        values = []
        for i, own in enumerate(keys):
            for j, pair in enumerate(own):
                # a constant under the other alternatives, as null would equal nothing
                other = self._column(getattr(self.catalyst.expressions.Literal, "default")(pair[s].dataType()))
                values.append(F.when(F.col(tag) == i, self._column(pair[s])).otherwise(other).alias(f"{prefix}key{i}_{j}_{s}"))
        return df.select("*", *values)


def _kind_of_join(join: Any) -> str:
    return _kind(join.joinType()).rstrip("$")


def split(df: DataFrame, hidden: str) -> DataFrame:
    """A query whose joins on one of several equalities are equi-joins; `hidden` begins the names of columns that are made
    on the way."""
    return Splitter(df.sparkSession, hidden).apply(df)
