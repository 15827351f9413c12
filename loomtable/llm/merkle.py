r"""Merkle dataset manifest: hash trees over a table's rows, a proof for every row, its check.

H is lower-case hex sha256. A row's leaf is H of its fields, each `-` if null, else its UTF-8
byte count, `:` and its text. The leaves of a group, in order, are the bottom of a tree: every
`fanout` consecutive nodes (the last run may have fewer, even one; nothing is padded) become H
of their hex digests, until one is left, the group's subroot. The subroots, by group, are the
leaves of one more tree with the root.

How it is worked out. Rows become narrow leaves, which are range-sorted; a task packs its part
into blocks of up to `block` leaves of one group. Counts by (group, part) say where each block
begins, so a block is an indexed run of leaves that need not begin or end at a run's edge.
Within a block leaves go on a mountain range: a stack with an open run for every level, whose
full runs carry a node up. What has no parent in its block is a peak (some two a level). Peaks
are merged by bands of levels: all that lies below one ancestor at the band's upper edge is a
group of `fanout ** band` nodes at most, so no group grows with the table, and a band later the
nodes that are left are so many times fewer. The same bands go down again with the siblings
that lead from every node to the root; last, each block meets the paths of its own peaks, and a
leaf's proof is its siblings in the block and those of its peak.

Results of the odd cases: null and repeated ids are leaves like others (nulls first, then by
leaf), a null group is a group and comes first, equal rows are a leaf each and their proofs go
by their places; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

FANOUT, BLOCK, BAND_NODES = 2, 4096, 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = pa.struct([("left", pa.binary()), ("right", pa.binary())])
BLOCKS = "part int, nth int, _g string, n int, ids array<string>, leaves binary, forged binary"
PEAKS = "_g string, total long, part int, nth int, level int, at long, hash binary"
PATHS = "_g string, total long, part int, nth int, level int, at long, steps array<struct<left:binary,right:binary>>, subroot binary, root binary"
PROOFS = "_g string, id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, steps array<struct<left:binary,right:binary>>"


def node_of(run: Sequence[bytes]) -> bytes:
    """H of digests, which enter as hex."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def widths(total: int, fanout: int) -> list[int]:
    """Nodes by level, from the leaves to the one that is left."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def mountains(start: int, leaves: Sequence[bytes], total: int, fanout: int) -> tuple[list[int], list[list[bytes]]]:
    """By level: the place of the first node that these leaves (from place start) complete, and
    all those nodes. A node is complete when its whole run is there or the tree ends with it."""
    width = widths(total, fanout)
    first, nodes = [start], [[]]
    for leaf in leaves:
        level, node = 0, leaf
        while True:
            nodes[level].append(node)
            behind = first[level] + len(nodes[level])
            begins = (behind - 1) // fanout * fanout
            if level + 1 == len(width) or (behind % fanout and behind < width[level]) or begins < first[level]:
                break
            node = node_of(nodes[level][begins - first[level] :])
            level += 1
            if level == len(nodes):
                first.append(begins // fanout)
                nodes.append([])
    return first, nodes


def peaks_of(first: list[int], nodes: list[list[bytes]], fanout: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, place, digest) of the nodes whose parent is not among them."""
    for level, (lo, row) in enumerate(zip(first, nodes, strict=True)):
        above = range(first[level + 1], first[level + 1] + len(nodes[level + 1])) if level + 1 < len(nodes) else range(0)
        for i, node in enumerate(row):
            if (lo + i) // fanout not in above:
                yield level, lo + i, node


def _cut(joined: bytes) -> list[bytes]:
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after another, so that only one heavy row is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def pack(rows: DataFrame, order: list[Column], block: int = BLOCK) -> DataFrame:
    """rows (_g, id, leaf, forged, and what order names) as sorted blocks."""
    wanted = rows.repartitionByRange("_g", *order, "_row").sortWithinPartitions("_g", *order, "_row").select("_g", "id", "leaf", "forged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, open_ = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("_g", pa.string()), ("n", pa.int32()), ("ids", pa.list_(pa.string())), ("leaves", pa.binary()), ("forged", pa.binary())])

        def closed() -> pa.RecordBatch:
            nonlocal nth, open_
            g, ids, leaves, forged = zip(*open_, strict=True)
            made = pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "_g": g[0], "n": len(ids), "ids": ids, "leaves": b"".join(leaves), "forged": b"".join(forged)}], schema)
            nth, open_ = nth + 1, []
            return made

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if open_ and (len(open_) == block or open_[0][0] != row[0]):
                    yield closed()
                open_.append(row)
        if open_:
            yield closed()

    return staged(wanted.mapInArrow(run, BLOCKS), "merkle-blocks")


def indexed(blocks: DataFrame) -> DataFrame:
    """blocks with start (leaves of the group before the block) and total (all of them)."""
    parts = blocks.groupBy("_g", "part").agg(F.sum("n").alias("m"))
    parts = parts.select("_g", "part", (F.sum("m").over(Window.partitionBy("_g").orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("_g")).alias("total"))
    inside = Window.partitionBy("_g", "part").orderBy("nth")
    places = blocks.select("_g", "part", "nth", (F.sum("n").over(inside) - F.col("n")).alias("inner"))
    places = places.join(parts, ["_g", "part"]).select("part", "nth", (F.col("before") + F.col("inner")).alias("start"), "total")
    return staged(blocks.join(places, ["part", "nth"]), "merkle-indexed")


def _peaks(blocks: DataFrame, fanout: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_g", pa.string()), ("total", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("level", pa.int32()), ("at", pa.int64()), ("hash", pa.binary())])
        for r in _sized(batches):
            first, nodes = mountains(r["start"], _cut(r["leaves"]), r["total"], fanout)
            yield pa.RecordBatch.from_pylist([{"_g": r["_g"], "total": r["total"], "part": r["part"], "nth": r["nth"], "level": level, "at": at, "hash": node} for level, at, node in peaks_of(first, nodes, fanout)], schema)

    return staged(blocks.select("_g", "total", "part", "nth", "start", "leaves").mapInArrow(run, PEAKS), "merkle-peaks")


def _climbed(rows, low: int, high: int, fanout: int) -> tuple[int, list[dict[int, bytes]]]:
    """The level a band's group ends at (high, or the tree's last), and by level from low the
    nodes by place: those that are given and those made of them."""
    width = widths(int(rows["total"].iloc[0]), fanout)
    top = min(high, len(width) - 1)
    levels: list[dict[int, bytes]] = [{} for _ in range(low, top + 1)]
    for level, at, node in zip(rows["level"], rows["at"], rows["hash"], strict=True):
        levels[int(level) - low][int(at)] = bytes(node)
    for level in range(low, top):
        runs = defaultdict(list)
        for at in sorted(levels[level - low]):
            runs[at // fanout].append(levels[level - low][at])
        for at, run in runs.items():
            if len(run) != min(fanout, width[level] - at * fanout):
                raise ValueError(f"a node of level {level} is missing")
            levels[level + 1 - low][at] = node_of(run)
    return top, levels


def _upward(low: int, band: int, fanout: int):
    """A group of a band to the one node it ends in."""

    def up(rows):
        top, levels = _climbed(rows, low, low + band, fanout)
        (at,), g = levels[-1], rows["_g"].iloc[0]
        return pd.DataFrame([(g, int(rows["total"].iloc[0]), top, at, levels[-1][at])], columns=["_g", "total", "level", "at", "hash"])

    return up


def _downward(low: int, band: int, fanout: int):
    """A group of a band, and the way of its end to the root, to the ways of its members."""

    def down(rows):
        is_way = rows["hash"].isna()
        nodes, way = rows[~is_way], rows[is_way].iloc[0]
        top, levels = _climbed(nodes, low, low + band, fanout)
        steps = [{at: [] for at in level} for level in levels]
        steps[-1] = {at: [(bytes(s["left"]), bytes(s["right"])) for s in way["steps"]] for at in levels[-1]}
        for k in range(len(levels) - 2, -1, -1):
            for at in levels[k]:
                steps[k][at] = [_step(levels[k], at, fanout), *steps[k + 1][at // fanout]]
        of = zip(nodes["_g"], nodes["total"], nodes["part"], nodes["nth"], nodes["level"], nodes["at"], strict=True)
        made = [(g, int(total), part, nth, int(level), int(at), [{"left": a, "right": b} for a, b in steps[int(level) - low][int(at)]], way["subroot"], way["root"]) for g, total, part, nth, level, at in of]
        return pd.DataFrame(made, columns=["_g", "total", "part", "nth", "level", "at", "steps", "subroot", "root"]).astype({"part": "Int32", "nth": "Int32"})

    return down


def _ancestor(low: int, band: int, fanout: int) -> Column:
    """The place of a node's ancestor at the upper edge of the band."""
    return F.expr(f"at div cast(pow({fanout}, {low + band} - level) as bigint)")


@dataclass
class Forest:
    """What a build leaves in the shared folder: blocks, the nodes of each band, the subroots."""

    blocks: DataFrame
    bands: list[tuple[int, DataFrame]]
    subroots: DataFrame
    fanout: int
    band: int


def grow(blocks: DataFrame, fanout: int = FANOUT, band_nodes: int = BAND_NODES) -> Forest:
    """The trees of all groups of indexed blocks, band by band."""
    band = 1
    while fanout ** (band + 1) <= band_nodes:
        band += 1
    most = blocks.agg(F.max("total")).first()[0] or 0
    height = len(widths(most, fanout)) - 1
    peaks = _peaks(blocks, fanout)
    carried = peaks.limit(0)
    bands, tops = [], []
    for low in range(0, height + 1, band):
        nodes = staged(peaks.filter(F.col("level").between(low, low + band - 1)).union(carried).withColumn("above", _ancestor(low, band, fanout)), "merkle-band")
        bands.append((low, nodes))
        made = staged(nodes.groupBy("_g", "above").applyInPandas(_upward(low, band, fanout), "_g string, total long, level int, at long, hash binary"), "merkle-carried")
        ends = F.col("level") == _height(fanout)
        tops.append(made.filter(ends).select("_g", F.col("hash").alias("subroot"), F.lit(low).alias("low")))
        carried = made.filter(~ends).select("_g", "total", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("nth"), "level", "at", "hash")
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.union(more)
    return Forest(blocks, bands, staged(subroots, "merkle-subroots"), fanout, band)


def _height(fanout: int) -> Column:
    """The least level with one node, of total leaves: integers alone, as logarithms round."""
    reach = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fanout)), k) < F.col("total"))
    return F.size(F.filter(reach, lambda less: less))


def _paths(forest: Forest, crowns: DataFrame) -> DataFrame:
    """part, nth, peaks: for every block the way of each of its peaks to the root. crowns (_g,
    steps, subroot, root) has the way of each group's subroot."""
    fanout, band = forest.fanout, forest.band
    ended = crowns.join(forest.subroots.select("_g", "low"), "_g")
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (("total", "long"), ("part", "int"), ("nth", "int"), ("level", "int"), ("at", "long"), ("hash", "binary"))]
    way = ["steps", "subroot", "root"]
    found, above = [], None
    for low, nodes in reversed(forest.bands):
        given = ended.filter(F.col("low") == low).select("_g", F.lit(0).cast("long").alias("above"), *blank, *way)
        if above is not None:
            given = given.union(above.select("_g", F.col("at").alias("above"), *blank, *way))
        no_way = [F.lit(None).cast("array<struct<left:binary,right:binary>>").alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root")]
        both = nodes.select("_g", "above", "total", "part", "nth", "level", "at", "hash", *no_way).union(given)

        ways = staged(both.groupBy("_g", "above").applyInPandas(_downward(low, band, fanout), PATHS), "merkle-ways")
        found.append(ways.filter("part IS NOT NULL"))
        above = ways.filter("part IS NULL")
    all_ways = found[0]
    for more in found[1:]:
        all_ways = all_ways.union(more)
    return all_ways.groupBy("part", "nth").agg(F.collect_list(F.struct("level", "at", "steps")).alias("peaks"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))


def _step(level: dict[int, bytes] | list[bytes], at: int, fanout: int, first: int = 0) -> tuple[bytes, bytes]:
    """The others of a node's run: those on its left, those on its right."""
    lo = at // fanout * fanout
    if isinstance(level, dict):
        return b"".join(level[i] for i in range(lo, at)), b"".join(level[i] for i in range(at + 1, lo + fanout) if i in level)
    return b"".join(level[lo - first : at - first]), b"".join(level[at + 1 - first : lo + fanout - first])


def folded(leaf: bytes, steps) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = node_of((left, leaf, right))
    return leaf


def _proofs(forest: Forest, crowns: DataFrame, with_steps: bool) -> DataFrame:
    """A row for every leaf: digests as hex, the proof's digest, the root folded from `forged`
    and the siblings; steps only if asked for, as they are long."""
    fanout = forest.fanout
    given = forest.blocks.join(_paths(forest, crowns), ["part", "nth"]).select("_g", "ids", "leaves", "forged", "start", "total", "peaks", "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([("_g", text), ("id", text), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("steps", pa.list_(STEP))])
        for r in _sized(batches):
            first, nodes = mountains(r["start"], _cut(r["leaves"]), r["total"], fanout)
            ways: list[dict[int, list]] = [{} for _ in nodes]
            for peak in r["peaks"]:
                ways[peak["level"]][peak["at"]] = [(s["left"], s["right"]) for s in peak["steps"]]
            for level in range(len(nodes) - 1, -1, -1):
                for i in range(len(nodes[level])):
                    at = first[level] + i
                    if at not in ways[level]:
                        ways[level][at] = [_step(nodes[level], at, fanout, first[level]), *ways[level + 1][at // fanout]]
            made = []
            subroot, root = r["subroot"].hex(), r["root"].hex()
            for i, (id_, leaf, forged) in enumerate(zip(r["ids"], nodes[0], _cut(r["forged"]), strict=True)):
                steps = ways[0][first[0] + i]
                proof = hashlib.sha256(b"".join(x for s in steps for x in s).hex().encode()).hexdigest()
                made.append((r["_g"], id_, leaf.hex(), subroot, root, proof, folded(forged, steps).hex(), [{"left": a, "right": b} for a, b in steps] if with_steps else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)

    return given.mapInArrow(run, PROOFS)


def _leaf(docs: DataFrame, fields: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    def field(name: str) -> Column:
        text = (changed or {}).get(name, F.col(name)).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256))


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", forged: dict[str, Column] | None = None, forge: Column | None = None, fanout: int = FANOUT, block: int = BLOCK, band_nodes: int = BAND_NODES, with_steps: bool = False) -> DataFrame:
    """_g (null group: '', else '=' and the group), id (key as text), leaf, subroot, root,
    proof_sha256, folded_root, steps. Rows where `forge` holds are folded from a leaf whose
    fields are those of `forged`; siblings stay the original ones."""
    leaf = _leaf(docs, fields)
    other = F.when(forge, _leaf(docs, fields, forged)).otherwise(leaf) if forge is not None else leaf
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g"), F.col(key).alias("_key"), leaf.alias("leaf"), other.alias("forged"), F.monotonically_increasing_id().alias("_row"))
    rows = staged(rows, "merkle-leaves").withColumn("id", F.col("_key").cast("string"))
    trees = grow(indexed(pack(rows, [F.col("_key").asc_nulls_first(), F.col("leaf")], block)), fanout, band_nodes)
    tops = trees.subroots.select(F.lit("").alias("_g"), F.col("_g").alias("id"), F.col("subroot").alias("leaf"), F.col("subroot").alias("forged"), F.lit(0).alias("_row"))
    crown = grow(indexed(pack(tops, [F.col("id")], block)), fanout, band_nodes)
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    at_root = crown.subroots.select("_g", nothing.alias("steps"), "subroot", F.col("subroot").alias("root"))
    crowns = _proofs(crown, at_root, True).select(F.col("id").alias("_g"), "steps", F.unhex("leaf").alias("subroot"), F.unhex("root").alias("root"))
    return _proofs(trees, staged(crowns, "merkle-crowns"), with_steps)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + F.lit(1)}
    forge = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), F.lit(False))
    found = proofs(docs, forged=more, forge=forge)
    return found.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 over DuckDB's lists: the table by its rule, then a fold over the bytes of ASCII text.
CRC_SQL = """
crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n))"""


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


#: The trees level by level, whole tables at once.
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, lang, n_chars, {" || ".join(_field_sql(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang"))} AS head, {_field_sql("text")} AS tail FROM documents),
l AS (SELECT doc_id, lang, sha256(head || {_field_sql("n_chars::VARCHAR")} || tail) AS leaf,
      sha256(head || {_field_sql("(n_chars + CASE WHEN " + crc_sql("doc_id::VARCHAR") + " % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR")} || tail) AS forged FROM d, crc_table),
p AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
nodes AS (SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
    UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2),
subroots AS (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes WHERE n = 1),
crown AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, pos // 2),
walk AS (SELECT p.g, p.doc_id, p.pos AS place, p.forged AS f, 0 AS step, p.pos AS pos, s.height, s.pos AS crown_pos, '' AS proof, s.height + (SELECT max(level) FROM crown) AS steps FROM p JOIN subroots AS s USING (g)
    UNION ALL SELECT w.g, w.doc_id, w.place,
        sha256(CASE WHEN here % 2 = 1 THEN coalesce(x.h, '') || f ELSE f || coalesce(x.h, '') END),
        step + 1, CASE WHEN step + 1 = w.height THEN w.crown_pos ELSE here // 2 END, w.height, w.crown_pos, proof || coalesce(x.h, ''), steps
    FROM (SELECT *, CASE WHEN step = 0 AND height = 0 THEN crown_pos ELSE pos END AS here FROM walk) AS w
    LEFT JOIN (SELECT g, level, pos, h, false AS up FROM nodes UNION ALL SELECT NULL, level, pos, h, true FROM crown) AS x
      ON x.up = (step >= height) AND (x.up OR x.g = w.g) AND x.level = CASE WHEN step >= height THEN step - height ELSE step END AND x.pos = xor(here, 1)
    WHERE step < steps)
SELECT p.doc_id, p.leaf, s.subroot, c.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = c.h AS verified
FROM p JOIN subroots AS s USING (g) JOIN walk AS w ON w.g = p.g AND w.place = p.pos AND w.step = w.steps, (SELECT h FROM crown WHERE n = 1) AS c
"""
