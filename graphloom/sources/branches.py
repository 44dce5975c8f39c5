"""A triple table over plain tables, of which a query builds only the branches that its filters leave.

A branch has literal types, and knows which column of its table makes its uids and
payload fields.  Filters on types choose branches; filters on uids and on fields of
plain columns also become conditions on the table's own columns, so they reach the
scan.  They only narrow: the same filters still hold for the triples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.model import NODE, TRIPLE_SCHEMA, triples

_NUMBERS = ("int", "bigint", "double")
_COMPARE: dict[str, Callable[[Column, object], Column]] = {"==": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Uid:
    """uids of one kind: the prefix and the columns that follow it."""

    kind: str
    columns: tuple[str, ...]

    def column(self) -> Column:
        return F.concat(F.lit(self.kind), *[x for c in self.columns for x in (F.lit("-"), F.col(c).cast("string"))])

    def condition(self, uid: object) -> Column | None:
        """What a table's rows of this uid have; None if it is none of this kind."""
        if not isinstance(uid, str) or not uid.startswith(f"{self.kind}-"):
            return None
        parts = uid[len(self.kind) + 1 :].split("-")
        if len(parts) != len(self.columns) or any(not p.isascii() or not p.isdigit() or str(int(p)) != p or int(p) >= 1 << 63 for p in parts):
            return None
        return reduce(Column.__and__, [F.col(c) == int(p) for c, p in zip(self.columns, parts, strict=True)])


@dataclass(frozen=True)
class Branch:
    """Triples of one table: (a) -axb_type-> (b), a node where b is None."""

    table: Callable[[], DataFrame]
    a_type: str
    a: Uid
    axb_type: str = NODE
    b_type: str | None = None
    b: Uid | None = None
    data: dict[str, Column | str] = field(default_factory=dict)  # a string is a column of the table
    scope: tuple[Uid, str] | None = None  # the node that the graph is nested in, and the graph's name

    def condition(self, filters: list[tuple], scope: str | None) -> Column | None:
        """What the table's rows need for the filters; None if no triple of the branch can meet them."""
        out = F.lit(True)
        if scope is not None:
            if (self.scope is None) != (scope == ""):
                return None
            if self.scope is not None:
                uid, _, name = scope.rpartition("/")
                own = self.scope[0].condition(uid) if name == self.scope[1] else None
                if own is None:
                    return None
                out = out & own
        ends = {"aUid": self.a, "bUid": self.b or self.a}
        types = {"aType": self.a_type, "axbType": self.axb_type, "bType": self.b_type or self.a_type}
        for name, op, value in filters:
            if name in types and op in ("==", "in"):
                if types[name] not in (value if op == "in" else [value]):
                    return None
            elif name in ends and op in ("==", "in"):
                if paths.is_long(op, value):
                    if not any(isinstance(v, str) and v.startswith(f"{ends[name].kind}-") for v in value):
                        return None
                    continue
                met = [c for v in (value if op == "in" else [value]) if (c := ends[name].condition(v)) is not None]
                if not met:
                    return None
                out = out & reduce(Column.__or__, met)
            else:
                path = paths.data_path(name)
                column = self.data.get(path[2:]) if path else None
                if isinstance(column, str) and op in _COMPARE and value is not None:
                    kind = dict(self.table().dtypes)[column]
                    if (paths.kind_of(value) == "number" and not paths.is_large(value) and kind in _NUMBERS) or (isinstance(value, str) and kind == "string"):
                        out = out & _COMPARE[op](F.col(column), F.lit(float(value) if kind in _NUMBERS else value))
        return out

    def rows(self, condition: Column) -> DataFrame:
        df = self.table().where(condition)
        data = {k: F.col(v) if isinstance(v, str) else v for k, v in self.data.items()}
        scope = F.concat(self.scope[0].column(), F.lit(f"/{self.scope[1]}")) if self.scope else None
        return triples(df, self.a_type, self.a.column(), self.axb_type, self.b_type or self.a_type, (self.b or self.a).column(), data, scope)


@dataclass(frozen=True)
class Branches:
    """All branches of a triple table."""

    spark: SparkSession
    parts: tuple[Branch, ...]

    def narrowed(self, filters: list[tuple], scope: str | None = None) -> DataFrame:
        """The triples that may meet the filters (and lie in the graph of this scope, unless None)."""
        found = [(b, c) for b in self.parts if (c := b.condition(filters, scope)) is not None]
        if not found:
            return self.spark.createDataFrame([], TRIPLE_SCHEMA)
        return reduce(DataFrame.unionByName, [b.rows(c) for b, c in found])

    def frame(self) -> DataFrame:
        return self.narrowed([])
