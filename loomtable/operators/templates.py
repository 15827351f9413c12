"""Bringing many databases in line with a new template: which of their tables and columns are
the template's, by staged matching, and what becomes of each.

before: a row a column of every table of every database (scope, sheet, name, column, physical):
sheet is the table's stable key, name and column what users see, physical the stored name. The
template is a list of Sheets, small as it is written by hand. All matching is equal joins on
(scope, mark), so databases spread and none is gathered.

Names meet after match_key (white space, case, width). Tables match by name, then by an alias
that the template declares, then by a known pair of names under the same key; columns by name,
then (in a table with the same key) by stored name, then by a declared alias. Each stage works
on what the one before left and takes only pairs that are alone on both sides.

A blocked table leaves everything as it was, so a database with one gets no changes (`ready` is
false for all its rows). Null names match nothing; a table of no columns is a row with a null
column; an empty template hides all tables, and a database without tables has no row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..session import written


@dataclass
class Sheet:
    key: str
    name: str
    columns: dict[str, str] = field(default_factory=dict)  # shown name: stored name
    aliases: list[str] = field(default_factory=list)
    column_aliases: dict[str, list[str]] = field(default_factory=dict)  # shown name: former names
    former: list[str] = field(default_factory=list)  # names that this key had


def staged(left: DataFrame, right: DataFrame, within: list[str], stages: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (within, l, r, stage) and the ambiguous (within, l, r, stage) of left (within, l,
    marks) and right (within, r, marks): marks hold an array of texts a stage."""
    pairs = clashes = None
    for stage in range(stages):
        marked = lambda df, x: df.select(*within, x, F.explode(F.array_distinct(F.get("marks", F.lit(stage)))).alias("_m"))  # noqa: E731, B023
        met = marked(left, "l").join(marked(right, "r"), [*within, "_m"]).select(*within, "l", "r").distinct()
        alone = [met.groupBy(*within, x).agg(F.count(F.lit(1)).alias(f"_n_{x}")) for x in ("l", "r")]
        counted = written(met.join(alone[0], [*within, "l"]).join(alone[1], [*within, "r"]), "stage")
        sure = (F.col("_n_l") == 1) & (F.col("_n_r") == 1)
        found, unsure = (counted.filter(c).select(*within, "l", "r", F.lit(stage).alias("stage")) for c in (sure, ~sure))
        pairs, clashes = (found, unsure) if pairs is None else (pairs.unionAll(found), clashes.unionAll(unsure))
        left, right = (df.join(found.select(*within, x), [*within, x], "left_anti") for df, x in ((left, "l"), (right, "r")))
    return pairs, clashes


def _marks(*each: Column) -> Column:
    return F.array(*[F.array_compact(m) for m in each]).alias("marks")


def _template(scopes: DataFrame, template: list[Sheet]) -> DataFrame:
    """The template's columns once for every scope: each is an answer to be given there."""
    spark = scopes.sparkSession
    rows = [(s.key, s.name, [*s.aliases], [*s.former], c, p, s.column_aliases.get(c, [])) for s in template for c, p in (s.columns or {None: None}).items()]
    flat = spark.createDataFrame(rows, "sheet string, name string, aliases array<string>, former array<string>, column string, physical string, column_aliases array<string>")
    # Names are brought to their marks by the function that the databases' names go through.
    keys = flat.select("*", F.posexplode(F.concat("aliases", "former", "column_aliases")).alias("_i", "_x")).select("_x").distinct()
    known = {r["_x"]: r["k"] for r in keys.select("_x", match_key("_x").alias("k")).collect()}
    marked = [(r["sheet"], r["name"], r["name_key"], [known[x] for x in r["aliases"]], [known[x] for x in r["former"]], r["column"], r["column_key"], r["physical"], [known[x] for x in r["column_aliases"]]) for r in flat.select("*", match_key("name").alias("name_key"), match_key("column").alias("column_key")).collect()]
    names = ["sheet", "name", "name_key", "aliases", "former", "column", "column_key", "physical", "column_aliases"]
    arrays = {"aliases", "former", "column_aliases"}
    value = lambda n, v: (F.array(*[F.lit(x) for x in v]).cast("array<string>") if n in arrays else F.lit(v).cast("string")).alias(n)
    if not marked:
        return scopes.limit(0).select("scope", *[value(n, [] if n in arrays else None) for n in names])
    return scopes.select("scope", F.inline(F.array(*[F.struct(*[value(n, v) for n, v in zip(names, r, strict=True)]) for r in marked])))


def reconciled(before: DataFrame, template: list[Sheet], delete_missing: bool = False, confirmed: bool = False) -> DataFrame:
    """scope, sheet, template, outcome, why, renames, inherited, added, hidden, ready of each
    table: sheet its key (null where none is there), template the key it has in the template.

    outcome: introduce, rebase (name or columns change), keep, hide or delete (not in the
    template) and blocked, with why: key_taken, ambiguous, column_reused, unconfirmed. renames
    maps stored names to the template's; inherited, added and hidden list shown columns."""
    old = written(before.withColumns({"_nk": match_key("name"), "_ck": match_key("column")}), "before")
    new = written(_template(old.select("scope").distinct(), template), "template")
    none = F.array().cast("array<string>")
    own = lambda c: F.array(F.col(c))
    at = lambda sheet, names: F.transform(names, lambda x: F.concat_ws("\t", sheet, x))
    old_tables, new_tables = old.select("scope", "sheet", "name", "_nk").distinct(), new.select("scope", "sheet", "name", "name_key", "aliases", "former").distinct()
    left = old_tables.select("scope", F.col("sheet").alias("l"), _marks(own("_nk"), own("_nk"), at(F.col("sheet"), own("_nk"))))
    right = new_tables.select("scope", F.col("sheet").alias("r"), _marks(own("name_key"), F.col("aliases"), at(F.col("sheet"), F.col("former"))))
    pairs, clashes = staged(left, right, ["scope"], 3)
    pairs = written(pairs, "pairs")

    # Columns of matched tables: they belong together by the pair's keys.
    theirs = old.filter("column IS NOT NULL").join(pairs.select("scope", F.col("l").alias("sheet"), F.col("r").alias("template")), ["scope", "sheet"])
    ours = new.filter("column IS NOT NULL").select("scope", F.col("sheet").alias("template"), "column", "column_key", F.lower("physical").alias("_p"), F.col("physical").alias("_to"), "column_aliases").join(pairs.select("scope", F.col("l").alias("sheet"), F.col("r").alias("template")), ["scope", "template"])
    same_key = F.col("sheet") == F.col("template")
    within = ["scope", "sheet", "template"]
    stored = F.when(same_key, F.array(F.lower("physical"))).otherwise(none)
    columns, _ = staged(
        theirs.select(*within, F.col("column").alias("l"), _marks(own("_ck"), stored, own("_ck"))),
        ours.select(*within, F.col("column").alias("r"), _marks(own("column_key"), F.when(same_key, F.array("_p")).otherwise(none), F.col("column_aliases"))), within, 3,
    )
    columns = written(columns, "columns")
    from_, to = theirs.select(*within, F.col("column").alias("l"), "physical"), ours.select(*within, F.col("column").alias("r"), "_to", "_p")
    both = columns.join(from_, [*within, "l"]).join(to, [*within, "r"])
    listed = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  columns of one table
    renamed = F.array_sort(F.collect_set(F.when(F.col("physical") != F.col("_to"), F.struct("physical", "_to"))))
    kept = both.groupBy(*within).agg(listed("r").alias("inherited"), F.map_from_entries(renamed).alias("renames"), F.max(F.col("l") != F.col("r")).alias("_shown"))
    gone = from_.join(columns.select(*within, "l"), [*within, "l"], "left_anti").withColumn("_p", F.lower("physical"))
    fresh = to.join(columns.select(*within, "r"), [*within, "r"], "left_anti")
    hidden, added = gone.groupBy(*within).agg(listed("l").alias("hidden")), fresh.groupBy(*within).agg(listed("r").alias("added"))
    reused = fresh.join(gone.select(*within, "_p"), [*within, "_p"]).select(*within).distinct().withColumn("_reused", F.lit(True))

    named = old_tables.select("scope", "sheet", F.col("name").alias("_was")), new_tables.select("scope", F.col("sheet").alias("template"), F.col("name").alias("_now"))
    table = pairs.select("scope", F.col("l").alias("sheet"), F.col("r").alias("template")).join(named[0], ["scope", "sheet"]).join(named[1], ["scope", "template"])
    for part in (kept, hidden, added, reused):
        table = table.join(part, within, "left")
    # The template's key may belong to another table of the database.
    taken = old_tables.select("scope", F.col("sheet").alias("template"), F.lit(True).alias("_there"))
    table = table.join(taken, ["scope", "template"], "left")
    changed = F.col("_was").eqNullSafe(F.col("_now")) & (F.size(F.coalesce("hidden", none)) + F.size(F.coalesce("added", none)) == 0) & ~F.coalesce("_shown", F.lit(False)) & (F.coalesce(F.size("renames"), F.lit(0)) == 0)
    why = F.when(F.col("_there") & ~same_key, "key_taken").when(F.col("_reused"), "column_reused")
    matched = table.select("scope", "sheet", "template", F.when(why.isNotNull(), "blocked").when(changed, "keep").otherwise("rebase").alias("outcome"), why.alias("why"), "renames", "inherited", "added", "hidden")

    unsure = lambda x, to: clashes.select("scope", F.col(x).alias(to)).distinct().withColumn("_unsure", F.lit(True))
    rest_new = new.groupBy("scope", F.col("sheet").alias("template")).agg(listed("column").alias("added")).join(pairs.select("scope", F.col("r").alias("template")), ["scope", "template"], "left_anti")
    rest_new = rest_new.join(taken, ["scope", "template"], "left").join(unsure("r", "template"), ["scope", "template"], "left")
    why = F.when(F.col("_unsure"), "ambiguous").when(F.col("_there"), "key_taken")
    text, mapped = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    brought = rest_new.select("scope", text.alias("sheet"), "template", F.when(why.isNotNull(), "blocked").otherwise("introduce").alias("outcome"), why.alias("why"), mapped.alias("renames"), none.alias("inherited"), "added", none.alias("hidden"))
    rest_old = old.groupBy("scope", "sheet").agg(listed("column").alias("hidden")).join(pairs.select("scope", F.col("l").alias("sheet")), ["scope", "sheet"], "left_anti")
    why = F.when(F.lit(delete_missing and not confirmed), "unconfirmed").cast("string")
    outcome = F.when(why.isNotNull(), "blocked").otherwise("delete" if delete_missing else "hide")
    left_over = rest_old.select("scope", "sheet", text.alias("template"), outcome.alias("outcome"), why.alias("why"), mapped.alias("renames"), none.alias("inherited"), none.alias("added"), "hidden")

    every = written(matched.unionByName(brought).unionByName(left_over), "outcomes")
    blocked = every.filter("outcome = 'blocked'").select("scope").distinct().withColumn("_blocked", F.lit(True))
    filled = every.withColumns({c: F.coalesce(c, none) for c in ("inherited", "added", "hidden")}).withColumn("renames", F.coalesce("renames", F.map_from_arrays(none, none)))
    return filled.join(blocked, "scope", "left").withColumn("ready", F.col("_blocked").isNull()).drop("_blocked")
