"""Named tables: DataFrames under a name and its aliases, and read-only SQL over them."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from .operators.query import TableQuery

#: Error conditions of Spark by what they mean to a caller.
CODES = {"TABLE_OR_VIEW_NOT_FOUND": "table_not_found", "UNRESOLVED_COLUMN": "column_not_resolved", "AMBIGUOUS_REFERENCE": "alias_conflict", "PARSE_SYNTAX_ERROR": "sql_error"}


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def is_read_only(sql: str) -> bool:
    """One statement whose parsed plan holds no command but those that show or describe. What
    doesn't parse can't run, so it passes for the error it will give, unless it is several."""
    spark = SparkSession.active()
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    try:
        plan = session.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return ";" not in re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    logical = jvm.org.apache.spark.sql.catalyst.plans.logical
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        changes = any(is_instance_of(spark.sparkContext._gateway, node, kind) for kind in (logical.Command, logical.ParsedStatement))
        if changes and not name.startswith(("Show", "Describe", "Explain")):
            return False
        if not name.startswith("Explain"):
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
    return True


class Catalog:
    """Tables of one scope. Hidden columns are not shown by query and SQL."""

    def __init__(self, spark: SparkSession, scope: str = ""):
        self.spark, self.scope = spark, scope
        self.tables: dict[str, DataFrame] = {}
        self.names: dict[str, str] = {}
        self.column_names: dict[str, dict[str, str]] = {}

    def register(self, name: str, df: DataFrame, aliases: tuple[str, ...] = (), hidden: tuple[str, ...] = (), row_id: str | None = None, column_aliases: dict[str, tuple[str, ...]] | None = None) -> None:
        if row_id in hidden:
            raise QueryError("alias_conflict", "the row id can't be hidden")
        for alias in (name, *aliases):
            if self.names.get(alias, name) != name:
                raise QueryError("alias_conflict", f"{alias} is {self.names[alias]}")
        shown = df.drop(*hidden)
        self.column_names[name] = self._columns_by_alias(shown.columns, column_aliases or {})
        self.tables[name] = shown
        for alias in (name, *aliases):
            self.names[alias] = name
            if re.fullmatch(r"\w+", alias):
                shown.createOrReplaceTempView(f"{self.scope}{alias}")

    @staticmethod
    def _columns_by_alias(columns: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
        found = {c: c for c in columns}
        for column, others in aliases.items():
            for alias in others:
                if found.get(alias, column) != column:
                    raise QueryError("alias_conflict", f"{alias} is {found[alias]}")
                found[alias] = column
        return {alias: c for alias, c in found.items() if c in columns}

    def column(self, name: str, alias: str) -> str:
        """The column of a table behind one of its names."""
        self.frame(name)
        known = self.column_names[self.names[name]]
        if alias not in known:
            raise QueryError("column_not_resolved", f"{name}.{alias}")
        return known[alias]

    def listing(self) -> list[tuple[str, tuple[str, ...], int]]:
        """Name, other names and number of columns of every table whose name has no leading _."""
        return [(n, tuple(a for a, of in self.names.items() if of == n and a != n), len(df.columns)) for n, df in sorted(self.tables.items()) if not n.startswith("_")]

    def in_scope(self, template: dict[str, list[str]]) -> Catalog:
        """A catalog of the template's tables and columns alone."""
        out = Catalog(self.spark, f"{self.scope}scoped_")
        for name, columns in template.items():
            if name in self.tables:
                own = [self.column(name, c) for c in columns if c in self.column_names[name]]
                out.register(name, self.tables[name].select(*own))
        return out

    def header_faults(self, name: str, headers: list[str]) -> list[tuple[str, str]]:
        """(issue, column) where a header and a table disagree: missing, unknown, repeated, order."""
        columns = self.frame(name).columns
        found = [self.column_names[self.names[name]].get(h) for h in headers]
        faults = [("unknown", h) for h, c in zip(headers, found, strict=True) if c is None]
        faults += [("missing", c) for c in columns if c not in found]
        faults += [("repeated", c) for c in columns if found.count(c) > 1]
        placed = [columns.index(c) for c in dict.fromkeys(found) if c]
        return faults + ([("order", headers[0])] if placed != sorted(placed) else [])

    def frame(self, name: str) -> DataFrame:
        if name not in self.names:
            raise QueryError("table_not_found", name)
        return self.tables[self.names[name]]

    def query(self, name: str, row_id: str | None = None) -> TableQuery:
        return TableQuery(self.frame(name), row_id)

    def columns(self, name: str) -> list[tuple[int, str, str, bool]]:
        return [(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(self.frame(name).schema)]

    def sql(self, text: str, args: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """A read with bound parameters; a page of at most 1,000 rows if limit is given."""
        if not is_read_only(text):
            raise QueryError("read_only_violation", text[:80])
        bound = [int(a) if isinstance(a, bool) else a for a in args or []]
        try:
            df = self.spark.sql(text, args=bound) if bound else self.spark.sql(text)
        except (AnalysisException, ParseException) as e:
            condition = (e.getCondition() or "").split(".")[0]
            raise QueryError(CODES.get(condition, "sql_error"), str(e).splitlines()[0]) from e
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(min(max(0, limit), 1000))
