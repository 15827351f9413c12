"""A fluent query over one DataFrame. Clauses may come in any order; nothing runs before a
terminal, and terminals that return frames stay lazy.

Rules: `where` adds to the current group, `or_where` opens the next one, and groups are
joined by OR. An empty `where_in` is false, an empty `where_not_in` says nothing. A later
order, group or having replaces the earlier. Aggregates of no rows are 0. LIKE ignores case.
Plain columns of a grouped query are those of the group's row with the least `row_id`."""

from __future__ import annotations

import operator
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_NONE = object()


class TableQuery:
    def __init__(self, df: DataFrame, row_id: str | None = None):
        self.df, self.row_id = df, row_id
        self.groups: list[list[Column]] = [[]]
        self.columns: list[str | Column] = []
        self.keys: list[str] = []
        self.condition: str | None = None
        self.order: list[Column] = []
        self.n: int | None = None
        self.skip = 0
        self.unique = False

    def _with(self, **changes) -> TableQuery:
        new = copy(self)
        new.groups = [list(g) for g in self.groups]
        for k, v in changes.items():
            setattr(new, k, v)
        return new

    # Predicates
    def _and(self, predicate: Column | None) -> TableQuery:
        new = self._with()
        if predicate is not None:
            new.groups[-1].append(predicate)
        return new

    def _compare(self, column: str, op, value) -> Column:
        if value is _NONE:
            op, value = "=", op
        if value is None:
            return F.col(column).isNull() if op == "=" else F.col(column).isNotNull()
        if op.lower() == "like":
            return F.col(column).ilike(value)
        if op not in OPERATORS:
            raise ValueError(f"{op!r} is no comparison")
        return OPERATORS[op](F.col(column), F.lit(value))

    def where(self, column: str | dict, op=_NONE, value=_NONE) -> TableQuery:
        """where("a", 1), where("a", ">", 1), or a dict of equalities (a list means IN)."""
        if isinstance(column, dict):
            out = self
            for k, v in column.items():
                out = out.where_in(k, v) if isinstance(v, (list, tuple)) else out._and(self._compare(k, "=", v))
            return out
        return self._and(self._compare(column, op, value))

    def or_where(self, column: str, op=_NONE, value=_NONE) -> TableQuery:
        new = self._with()
        new.groups.append([self._compare(column, op, value)])
        return new

    def where_in(self, column: str, values: list) -> TableQuery:
        return self._and(F.col(column).isin(list(values)) if values else F.lit(False))

    def where_not_in(self, column: str, values: list) -> TableQuery:
        return self._and(~F.col(column).isin(list(values)) if values else None)

    def where_between(self, column: str, low, high) -> TableQuery:
        if isinstance(low, (int, float)) and isinstance(high, (int, float)) and low > high:
            low, high = high, low
        return self._and(F.col(column).between(low, high))

    def where_like(self, column: str, pattern: str) -> TableQuery:
        return self._and(F.col(column).ilike(pattern))

    def where_null(self, column: str) -> TableQuery:
        return self._and(F.col(column).isNull())

    def where_not_null(self, column: str) -> TableQuery:
        return self._and(F.col(column).isNotNull())

    def where_column(self, predicate: Column) -> TableQuery:
        return self._and(predicate)

    # Shape
    def select(self, *columns: str | Column) -> TableQuery:
        return self._with(columns=list(columns))

    def distinct(self) -> TableQuery:
        return self._with(unique=True)

    def group_by(self, *keys: str) -> TableQuery:
        return self._with(keys=list(keys))

    def having(self, condition: str) -> TableQuery:
        return self._with(condition=condition)

    def order_by(self, *columns: str | tuple[str, str]) -> TableQuery:
        """Names, or (name, "desc"). Nulls come first ascending and last descending."""
        named = [(c, "asc") if isinstance(c, str) else c for c in columns]
        return self._with(order=[F.col(c).desc() if way.lower() == "desc" else F.col(c).asc() for c, way in named])

    def limit(self, n: int) -> TableQuery:
        return self._with(n=max(0, int(n)))

    def offset(self, n: int) -> TableQuery:
        return self._with(skip=max(0, int(n)))

    # Terminals
    def filtered(self) -> DataFrame:
        groups = [reduce(operator.and_, g) for g in self.groups if g]
        return self.df.filter(reduce(operator.or_, groups)) if groups else self.df

    def _page(self, df: DataFrame) -> DataFrame:
        df = df.orderBy(*self.order) if self.order else df
        df = df.offset(self.skip) if self.skip else df
        return df if self.n is None else df.limit(self.n)

    def frame(self) -> DataFrame:
        df = self.filtered()
        if self.keys:
            return self._page(self._grouped(df))
        df = df.select(*self.columns) if self.columns else df
        return self._page(df.distinct() if self.unique else df)

    def _grouped(self, df: DataFrame) -> DataFrame:
        made = []
        for c in self.columns or df.columns:
            if isinstance(c, Column):
                made.append(c)
            elif c not in self.keys:
                made.append((F.min_by(c, self.row_id) if self.row_id else F.min(c)).alias(c))
        extra = [F.expr(self.condition).alias("_having")] if self.condition else []
        out = df.groupBy(*self.keys).agg(*(made or [F.count(F.lit(1)).alias("n")]), *extra)
        return out.filter("_having").drop("_having") if extra else out

    def aggregate(self, kind: str, column: str | None = None, alias: str | None = None) -> DataFrame:
        """One row with count, sum, avg, min or max; 0 for no rows. With group_by a row for
        each group."""
        of = F.count(F.lit(1)) if kind == "count" else F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](F.col(column)), F.lit(0))
        made = of.alias(alias or kind)
        df = self.filtered()
        return self._page(df.groupBy(*self.keys).agg(made)) if self.keys else df.agg(made)

    def value_of(self, kind: str, column: str | None = None):
        """The aggregate's value, of the first group if grouped."""
        row = self.aggregate(kind, column).first()
        return row[kind] if row else 0

    def count(self) -> int:
        return self.value_of("count")

    def first(self):
        return self.limit(1).frame().first()

    def get(self, column: str):
        row = self.select(column).limit(1).frame().first()
        return row[0] if row else None

    def exists(self) -> bool:
        return not self.filtered().isEmpty()


def rows_of(df: DataFrame, columns: list[str] | None = None, where: dict | None = None, order_by: list | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The declarative form: equalities, an order, a page of at most 1,000 rows."""
    q = TableQuery(df).where(where or {}).offset(offset).limit(min(limit, 1000))
    q = q.select(*columns) if columns else q
    if not order_by:
        return q.frame()
    ordered = [(c, "asc") if isinstance(c, str) else c for c in order_by]
    keys = [F.col(c).desc() if way.lower() == "desc" else F.col(c).asc() for c, way in ordered]
    out = q.filtered().orderBy(*keys).offset(q.skip).limit(q.n)
    return out.select(*columns) if columns else out
