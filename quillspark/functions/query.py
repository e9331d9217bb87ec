"""Queries given as JSON trees, built as Columns: names are bound to the tables' schemas, and unknown ones refused.

A query holds select, from and, if need be, where, group, order and limit. Expressions are trees of one key each:

    {"column": {"this": {"identifier": "price"}, "table": {"identifier": "p"}}}     the table is optional
    {"literal": {"this": "100", "is_string": false}}, {"null": {}}, {"boolean": {"this": true}}, {"star": {}}
    {"alias": {"this": …, "alias": {"identifier": "n"}}}, {"cast": {"this": …, "to": "double"}}
    {"gt": {"this": …, "expression": …}} and the like, see BINARY and UNARY; {"in": {"this": …, "expressions": […]}}
    {"between": {"this": …, "low": …, "high": …}}, {"count": {"this": …}} and the like, see FUNCTIONS

Nothing is put together as SQL text, so a name or literal can't be more than one.
"""

from __future__ import annotations

import decimal
import json
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "and": operator.and_, "or": operator.or_,
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "div": operator.truediv, "mod": operator.mod, "like": F.like,
}
UNARY: dict[str, Callable[[Column], Column]] = {"not": operator.inv, "neg": operator.neg, "is_null": F.isnull, "paren": lambda c: c}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
FUNCTIONS: dict[str, Callable[[Column], Column]] = AGGREGATES | {"lower": F.lower, "upper": F.upper, "length": F.length, "abs": F.abs, "year": F.year}
TYPES = {"bigint", "int", "double", "string", "date", "timestamp", "boolean"}


class Query:
    """A JSON query over tables by name. Anything unknown or out of place is a ValueError that names it."""

    def __init__(self, tables: dict[str, DataFrame], tree: str | dict) -> None:
        self.tree = self._object(json.loads(tree) if isinstance(tree, str) else tree, "query", {"select", "from"}, {"where", "group", "order", "limit"})
        self.tables: dict[str, DataFrame] = {}
        for entry in self._list(self.tree["from"], "from"):
            own = self._object(entry, "from", {"table"})["table"]
            own = self._object(own, "table", {"this"}, {"alias", "on"})
            name = self._identifier(own["this"])
            if name not in tables:
                raise ValueError(f"unknown table {name!r}")
            alias = self._identifier(own["alias"]) if "alias" in own else name
            if alias in self.tables:
                raise ValueError(f"table {alias!r} twice")
            if bool(self.tables) != ("on" in own):
                raise ValueError(f"table {alias!r}: every table but the first needs a condition on which it is joined")
            self.tables[alias] = tables[name]

    # --- shape

    @staticmethod
    def _object(value: object, what: str, needs: set[str], may: frozenset | set[str] = frozenset()) -> dict:
        if not isinstance(value, dict) or not needs <= set(value) <= needs | may:
            raise ValueError(f"{what}: {json.dumps(value)[:200]}")
        return value

    def _list(self, value: object, what: str) -> list:
        found = self._object(value, what, {"expressions"})["expressions"]
        if not isinstance(found, list) or not found:
            raise ValueError(f"{what} is empty")
        return found

    def _identifier(self, value: object) -> str:
        name = self._object(value, "identifier", {"identifier"})["identifier"]
        if not isinstance(name, str) or not name:
            raise ValueError(f"identifier: {name!r}")
        return name

    def _one(self, tree: object) -> tuple[str, object]:
        if not isinstance(tree, dict) or len(tree) != 1:
            raise ValueError(f"not an expression: {json.dumps(tree)[:200]}")
        return next(iter(tree.items()))

    # --- expressions

    def _column(self, own: dict) -> Column:
        own = self._object(own, "column", {"this"}, {"table"})
        name = self._identifier(own["this"])
        holders = [a for a, t in self.tables.items() if name in t.columns]
        if "table" in own:
            alias = self._identifier(own["table"])
            holders = [a for a in holders if a == alias]
        if len(holders) != 1:
            raise ValueError(f"{'unknown' if not holders else 'ambiguous'} column {name!r}")
        return F.col(f"`{holders[0]}`.`{name.replace('`', '``')}`")

    @staticmethod
    def _literal(own: dict) -> Column:
        own = Query._object(own, "literal", {"this"}, {"is_string"})
        if own.get("is_string", True):
            return F.lit(str(own["this"]))
        try:
            number = decimal.Decimal(str(own["this"]))
        except decimal.InvalidOperation:
            raise ValueError(f"not a number: {own['this']!r}") from None
        return F.lit(int(number)) if number == number.to_integral_value() and "." not in str(own["this"]) else F.lit(float(number))

    def expression(self, tree: object, aggregates: bool = False) -> Column:
        kind, own = self._one(tree)
        inner = lambda t: self.expression(t, aggregates)
        if kind == "column":
            return self._column(own)
        if kind == "literal":
            return self._literal(own)
        if kind == "null":
            return F.lit(None)
        if kind == "boolean":
            return F.lit(bool(self._object(own, kind, {"this"})["this"]))
        if kind in BINARY:
            own = self._object(own, kind, {"this", "expression"})
            return BINARY[kind](inner(own["this"]), inner(own["expression"]))
        if kind in UNARY:
            return UNARY[kind](inner(self._object(own, kind, {"this"})["this"]))
        if kind == "in":
            own = self._object(own, kind, {"this", "expressions"})
            return inner(own["this"]).isin(*[inner(e) for e in self._list({"expressions": own["expressions"]}, kind)])
        if kind == "between":
            own = self._object(own, kind, {"this", "low", "high"})
            return inner(own["this"]).between(inner(own["low"]), inner(own["high"]))
        if kind == "cast":
            own = self._object(own, kind, {"this", "to"})
            if own["to"] not in TYPES:
                raise ValueError(f"unknown type {own['to']!r}")
            return inner(own["this"]).cast(own["to"])
        if kind in FUNCTIONS:
            if kind in AGGREGATES and not aggregates:
                raise ValueError(f"{kind} can't stand here")
            own = self._object(own, kind, {"this"})["this"]
            if kind == "count" and own == {"star": {}}:
                return F.count(F.lit(1))
            return FUNCTIONS[kind](self.expression(own))
        raise ValueError(f"unknown expression {kind!r}")

    def _has_aggregate(self, tree: object) -> bool:
        if isinstance(tree, dict):
            return any(k in AGGREGATES or self._has_aggregate(v) for k, v in tree.items())
        return isinstance(tree, list) and any(map(self._has_aggregate, tree))

    def _output(self, tree: object, aggregates: bool) -> list[tuple[str, Column]]:
        kind, own = self._one(tree)
        if kind == "star":
            return [(c, F.col(f"`{a}`.`{c}`")) for a, t in self.tables.items() for c in t.columns]
        if kind == "alias":
            own = self._object(own, kind, {"this", "alias"})
            return [(self._identifier(own["alias"]), self.expression(own["this"], aggregates))]
        if kind == "column":
            return [(self._identifier(own["this"]), self.expression(tree))]
        return [(kind, self.expression(tree, aggregates))]

    # --- the whole

    def frame(self) -> DataFrame:
        rows = None
        for (alias, table), entry in zip(self.tables.items(), self.tree["from"]["expressions"], strict=True):
            table = table.alias(alias)
            rows = table if rows is None else rows.join(table, self.expression(entry["table"]["on"]))
        if "where" in self.tree:
            rows = rows.where(self.expression(self.tree["where"]))
        wanted = self._list(self.tree["select"], "select")
        grouped = "group" in self.tree or self._has_aggregate(wanted)
        out = [o for t in wanted for o in self._output(t, grouped)]
        if len({n for n, _ in out}) < len(out):
            raise ValueError("two columns of one name; give one an alias")
        if grouped:
            keys = [self.expression(k) for k in self._list(self.tree["group"], "group")] if "group" in self.tree else []
            plain = [t for t in wanted if not self._has_aggregate(t)]
            held = [json.dumps(k, sort_keys=True) for k in self.tree.get("group", {}).get("expressions", [])]
            for t in plain:
                kind, own = self._one(t)
                if json.dumps(own["this"] if kind == "alias" else t, sort_keys=True) not in held:
                    raise ValueError(f"neither grouped nor aggregated: {json.dumps(t)[:200]}")
            names = [f"_g{i}" for i in range(len(keys))]
            sums = [(n, c) for (n, c), t in zip(out, wanted, strict=True) if self._has_aggregate(t)]
            found = rows.groupBy(*[k.alias(g) for k, g in zip(keys, names, strict=True)]).agg(*[c.alias(f"_a{i}") for i, (_, c) in enumerate(sums)] or [F.lit(0).alias("_none")])
            places, columns = {n: f"_a{i}" for i, (n, _) in enumerate(sums)}, []
            for (n, _), t in zip(out, wanted, strict=True):
                kind, own = self._one(t)
                source = places[n] if n in places else names[held.index(json.dumps(own["this"] if kind == "alias" else t, sort_keys=True))]
                columns.append(F.col(source).alias(n))
            rows = found.select(*columns)
        else:
            rows = rows.select(*[c.alias(n) for n, c in out])
        if "order" in self.tree:
            order = []
            for entry in self._list(self.tree["order"], "order"):
                entry = self._object(entry, "order", {"this"}, {"desc"})
                name = self._identifier(entry["this"])
                if name not in rows.columns:
                    raise ValueError(f"unknown column {name!r} to order by")
                order.append(F.desc(f"`{name}`") if entry.get("desc") else F.asc(f"`{name}`"))
            rows = rows.orderBy(*order)
        if "limit" in self.tree:
            if not isinstance(self.tree["limit"], int) or self.tree["limit"] < 0:
                raise ValueError(f"limit: {self.tree['limit']!r}")
            rows = rows.limit(self.tree["limit"])
        return rows
