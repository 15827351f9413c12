"""Schema migration: a plan from two schemas, and its execution with counted losses."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CONVERSIONS = ("identity", "stringify", "integer_strict", "real_strict")


@dataclass
class Plan:
    renames: dict[str, str] = field(default_factory=dict)
    adds: dict[str, object] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)
    conversions: dict[str, str] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)

    @property
    def decision(self) -> str:
        return "invalid" if self.issues else "needs_choice" if self.drops else "auto_apply"


def plan(old: StructType, new: StructType, defaults: dict[str, object] | None = None) -> Plan:
    """Columns match by name, then by display name (field metadata 'display') and type."""
    defaults, out = defaults or {}, Plan()
    shown = lambda f: f.metadata.get("display", f.name)
    gone = [f for f in old if f.name not in new.names]
    for f in new:
        if f.name in old.names:
            was = old[f.name].dataType
            if was != f.dataType:
                kind = {"string": "stringify", "bigint": "integer_strict", "double": "real_strict"}.get(f.dataType.simpleString())
                if kind:
                    out.conversions[f.name] = kind
                else:
                    out.issues.append(f"{f.name}: {was.simpleString()} to {f.dataType.simpleString()}")
            continue
        match = [g for g in gone if shown(g) == shown(f) and g.dataType == f.dataType]
        if len(match) == 1:
            out.renames[match[0].name] = f.name
            gone.remove(match[0])
        elif f.nullable or f.name in defaults:
            out.adds[f.name] = defaults.get(f.name)
        else:
            out.issues.append(f"{f.name} must not be null and has no default")
    out.drops = [g.name for g in gone]
    return out


def converted(column: Column, kind: str) -> Column:
    if kind == "stringify":
        return column.cast("string")
    return column.cast("string").try_cast({"integer_strict": "bigint", "real_strict": "double"}[kind]) if kind != "identity" else column


def migrate(df: DataFrame, p: Plan, new: StructType, confirm_drops: bool = False) -> DataFrame:
    if p.issues or (p.drops and not confirm_drops):
        raise ValueError(f"{p.decision}: {p.issues or p.drops}")
    back = {v: k for k, v in p.renames.items()}
    one = lambda f: F.lit(p.adds[f.name]).cast(f.dataType) if f.name in p.adds else converted(F.col(back.get(f.name, f.name)), p.conversions.get(f.name, "identity"))
    return df.select(*[one(f).alias(f.name) for f in new])


def lossy(df: DataFrame, p: Plan) -> DataFrame:
    """column, n_lost: cells that a strict conversion can't keep (a dry run)."""
    checks = [F.count_if(F.col(c).isNotNull() & converted(F.col(c), k).isNull()).alias(c) for c, k in p.conversions.items()]
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, n_lost long")
    return df.agg(*checks).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_lost")) for c in p.conversions])))


def reconciled(df: DataFrame, template: StructType, aliases: dict[str, str]) -> DataFrame:
    """df in a template's shape: columns by name or alias, the missing ones null."""
    named = reduce(lambda d, a: d.withColumnRenamed(*a), [(k, v) for k, v in aliases.items() if k in df.columns], df)
    empty = df.sparkSession.createDataFrame([], template)
    return empty.unionByName(named.select(*[c for c in named.columns if c in template.names]), allowMissingColumns=True)


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """rule, n: rows that break each check (an SQL condition; null holds). One pass."""
    broken = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(name) for name, c in checks.items()])
    return broken.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in checks])))
