r"""License scans: spans of a text against licence templates by Dice over word bigrams.

Normalised text is lower case, spells licence as license and has no copyright statements: the
mark, the years and the holder, up to the first words of a template, the end of a sentence or
of the line, and "all rights reserved". What stands before and after a statement stays, as lines
of their own. Words are runs of letters and digits. Spans are each line, each paragraph (between blank lines)
and the whole text, so both a one-line notice and a licence wrapped over many lines are
found. A span's distinct word bigrams A meet a template's B by 2 |A and B| / (|A| + |B|).

A licence of several paragraphs amid other text is found as a run: lines in a row, blank ones
skipped, that begin and end with a line holding bigrams of the template. A run reaches the
threshold only if t / (2 - t) of B's bigrams are in it, so only texts with that many are looked
at, and only lines near enough to each other (`ROOM` times the upper bound in words). The best
runs that do not overlap a better one count as spans, but for those that hold a span found by
itself for the same template.

As that is at most 2 min / (|A| + |B|), only templates with |B| between |A| t / (2 - t) and
|A| (2 - t) / t can reach the threshold t. Each template carries these bounds, and a span is
compared with those that hold it alone. Bigrams are compared by 64-bit hashes.

A notice that differs from a template by a telling word (NonCommercial, Lesser, not) or by the
version's number is another license or none, however like: a span must have the telling words of
the template, no other ones, and name its version.

Everything is an expression over a row: no shuffle, no join. The templates are constants of
the plan, some 70 rows whose number does not follow the corpus.

Results of the odd cases: null and empty texts, and texts of one word, have no licence (null,
dice 0, no spans); of templates with an equal Dice the first in the list names the span, and
of spans the highest names the document. Repeated rows repeat their result; other columns
pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = 0.8
#: A run's words are at most this often the distinct bigrams a template allows.
ROOM = 2
RESULTS = ["license", "category", "dice", "n_license_spans", "licenses"]
NO_WORD = r"[^\p{L}\p{N}]+"
MARK = r"copyright\s+(?:\(c\)|©|[0-9]{4})"
#: Ends a holder's name: the end of a sentence, but not an initial or an abbreviation.
SENTENCE_END = r"(?<!\b(?:inc|ltd|corp|co|llc|bros|dr|jr|sr|st|al|\p{L}))[.;!?](?=\s)"
RESERVED = r"(?:[\x20\t.,;]*all[\x20\t]+rights[\x20\t]+reserved\b\.?)?"


class Template(NamedTuple):
    license: str
    category: str
    text: str
    #: Version numbers that a span must name, without an ending 0; none if empty.
    version: str = ""


# Words that make another license of a notice, or none.
TELLING = ["not", "non", "noncommercial", "nc", "noderivatives", "noderivs", "nd", "sharealike", "sa", "lesser", "library general", "affero", "lgpl", "agpl"]


# Notices and licence texts as their authors publish them.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = [
    Template("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0.", "2"),
    Template("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "2"),
    Template("MIT", "permissive", "Released under the MIT License."),
    Template("MIT", "permissive", "This software is licensed under the MIT License."),
    Template("MIT", "permissive", f"{_GRANT} the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    Template("ISC", "permissive", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    Template("BSD-2-Clause", "permissive", f"{_BSD} 1 {_BSD_1} 2 {_BSD_2} {_BSD_END}"),
    Template("BSD-3-Clause", "permissive", f"{_BSD} 1 {_BSD_1} 2 {_BSD_2} 3 {_BSD_3} {_BSD_END}"),
    Template("BSD-3-Clause", "permissive", "This project is licensed under the BSD 3-Clause License.", "3"),
    Template("Zlib", "permissive", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    Template("Unlicense", "public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3.", "3"),
    Template("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2.", "2"),
    Template("GPL-3.0-or-later", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "3"),
    Template("GPL-2.0-or-later", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "2"),
    Template("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3.", "3"),
    Template("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3.", "3"),
    Template("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "2"),
    Template("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0.", "4"),
    Template("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0.", "4"),
    Template("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0.", "4"),
    Template("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "4"),
    Template("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "4"),
    Template("CC0-1.0", "public domain", "Released under the CC0 1.0 Universal Public Domain Dedication.", "1"),
    Template("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "2 1"),
    Template("LGPL-2.0", "copyleft", "This work is licensed under the GNU Library General Public License, version 2.", "2"),
    Template("GPL-1.0", "copyleft", "This work is licensed under the GNU General Public License, version 1.", "1"),
    Template("AGPL-1.0", "copyleft", "This work is licensed under the Affero General Public License, version 1.", "1"),
]


def _creative_commons() -> list[Template]:
    """The notices of every variant and version, long and short, but for those above."""
    parts = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    places = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
    found = []
    for variant in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        kind = "noncommercial" if "NC" in variant else "no derivatives" if "ND" in variant else "copyleft" if "SA" in variant else "permissive"
        for version, place in places.items():
            said = "-".join(parts[x] for x in variant.split("-"))
            number = version.replace(".", " ").removesuffix(" 0")
            found.append(Template(f"CC-{variant}-{version}", kind, f"This work is licensed under a Creative Commons {said} {version} {place} License.", number))
            found.append(Template(f"CC-{variant}-{version}", kind, f"Licensed under CC {variant} {version}.", number))
    known = {t.text for t in TEMPLATES}
    return [t for t in found if t.text not in known]


TEMPLATES += _creative_commons()


def _statement(templates: list[Template]) -> str:
    """A copyright statement, without the license that may follow on its line."""
    openings = sorted({r"[^\p{L}\p{N}\n]+".join(re.findall(r"[^\W_]+", t.text.lower().replace("licence", "license"))[:2]) for t in templates} - {""})
    begins = rf"\b(?:{'|'.join(openings)})\b" if openings else "$"
    return rf"{MARK}[^\n]*?(?:(?={begins})|(?={MARK})|{RESERVED}(?:{SENTENCE_END}|(?=\n)|\z)){RESERVED}"


def normalised(text: Column, templates: list[Template]) -> Column:
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))
    statement = _statement(templates)
    return F.regexp_replace(F.regexp_replace(plain, rf"(?<=[^\n]){statement}", "\n"), statement, "")


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def _known(spark: SparkSession, templates: list[Template], least: float) -> Column:
    """The templates as one constant: place in the list, bounds, bigram hashes."""
    words = F.array_remove(F.split(normalised(F.col("text"), templates), NO_WORD), "")
    rows = spark.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "i int, text string").select("i", words.alias("w"))
    facts = {r["i"]: r for r in rows.select("i", _bigrams(F.col("w")).alias("grams"), _telling(F.array_join("w", " ")).alias("telling")).collect()}
    grams, said = ([facts[i][c] for i in range(len(templates))] for c in ("grams", "telling"))
    low = [math.ceil(len(g) * least / (2 - least) - 1e-9) for g in grams]
    high = [math.floor(len(g) * (2 - least) / least + 1e-9) for g in grams]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low[i]).alias("low"), F.lit(high[i]).alias("high"), F.lit(list(g)).alias("grams"), F.lit(said[i]).alias("telling"), F.lit(templates[i].version).alias("version")) for i, g in enumerate(grams)])


def _telling(said: Column) -> Column:
    """The telling words of a span, as one text."""
    padded = F.concat(F.lit(" "), said, F.lit(" "))
    return F.array_join(F.filter(F.array(*[F.lit(x) for x in TELLING]), lambda x: F.contains(padded, F.concat(F.lit(" "), x, F.lit(" ")))), ",")


def _versions(said: Column) -> Column:
    """Numbers in a row, without an ending 0."""
    numbers = F.split(F.regexp_replace(said, "[^ ]*[^ 0-9][^ ]*", "|"), r"\|")
    return F.transform(numbers, lambda x: F.regexp_replace(F.trim(x), "( 0)+$", ""))


def _agrees(said: Column, t: Column) -> Column:
    """Whether a span has the telling words of a template, no other ones, and its version."""
    return (_telling(said) == t["telling"]) & ((t["version"] == "") | F.array_contains(_versions(said), t["version"]))


def _dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


_RUN = "array<struct<dice:double,i:int,short:int,k:int,e:int,said:string>>"


def _runs(t: Column, least: float) -> Column:
    """The runs of _lines, from line k to e, that reach the threshold with a template. A line
    that brings no bigram of the template that the run has not yet ends no run: the run before
    it is shorter and at least as like."""
    need = F.ceil(F.size(t["grams"]) * (least / (2 - least)) - 1e-9)
    room = (t["high"] * ROOM + 1).cast("int")
    # Of each line the template's bigrams, with the one from the line before and without.
    facts = F.transform("_lines", lambda x: F.struct(F.array_intersect(x["grams"], t["grams"]).alias("hits"), F.array_intersect(_bigrams(x["words"]), t["grams"]).alias("own"), F.size(x["words"]).alias("n")))

    def of(f: Column, sums: Column) -> Column:
        def ends(k: Column) -> Column:
            """Lines that end a run from line k: words and the bigrams seen up to each."""
            start = F.struct(k.alias("e"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<int>").alias("found"))

            def step(at: Column, x: Column) -> Column:
                n = at["n"] + x["n"]
                hits = F.when(at["e"] == k, x["own"]).otherwise(x["hits"])
                full = (n > room) | (F.size(hits) == 0) | (F.size(at["seen"]) == F.size(t["grams"]))
                seen = F.when(full, at["seen"]).otherwise(F.array_union(at["seen"], hits))
                # Bound once, or it would be worked out for each use.
                return F.transform(F.array(seen), lambda now: F.struct((at["e"] + 1).alias("e"), n.alias("n"), now.alias("seen"), F.when((at["e"] > k) & (F.size(now) > F.size(at["seen"])) & (F.size(now) >= need), F.concat(at["found"], F.array(at["e"]))).otherwise(at["found"]).alias("found")))[0]

            near = F.size(F.filter(F.slice(sums, k + 1, room), lambda w: w - F.get(sums, k) <= room))
            return F.aggregate(F.slice(f, k + 1, near), start, step, lambda at: at["found"])

        # The bigram that joins two lines is with the second one.
        hit = lambda k: F.coalesce(F.size(F.get(f, k)["hits"]), F.lit(0)) > 0
        starts = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda k: hit(k) | hit(k + 1))
        spans = F.flatten(F.transform(starts, lambda k: F.transform(ends(k), lambda e: F.struct(k.alias("k"), e.alias("e")))))
        worded = F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["e"].alias("e"), F.flatten(F.transform(F.slice("_lines", s["k"] + 1, s["e"] - s["k"] + 1), lambda x: x["words"])).alias("words")))
        valued = F.transform(worded, lambda s: F.struct(_dice(_bigrams(s["words"]), t["grams"]).alias("dice"), (-t["i"]).alias("i"), (s["k"] - s["e"]).alias("short"), s["k"].alias("k"), s["e"].alias("e"), F.array_join(s["words"], " ").alias("said")))
        return F.filter(valued, lambda r: (r["dice"] >= least) & _agrees(r["said"], t))

    return F.flatten(F.transform(F.array(facts), lambda f: F.flatten(F.transform(F.array(F.col("_sums")), lambda sums: of(f, sums)))))


def _with_likely(out: DataFrame, known: Column, least: float) -> DataFrame:
    """out with _likely: the templates of which the text holds t / (2 - t) of the bigrams. No
    span of it can reach the threshold with another, so most texts are done here."""
    every = F.array_distinct(F.flatten(F.transform(known, lambda t: t["grams"])))
    out = out.withColumn("_own", F.array_intersect(_bigrams(F.array_remove(F.split("_norm", NO_WORD), "")), every))
    # _own is bound once, or Spark would work it out anew for every template.
    enough = lambda own: F.filter(known, lambda t: F.size(F.array_intersect(own, t["grams"])) >= F.ceil(F.size(t["grams"]) * (least / (2 - least)) - 1e-9))
    return out.withColumn("_likely", F.flatten(F.transform(F.filter(F.array("_own"), lambda own: F.size(own) > 0), enough)))


def _with_runs(out: DataFrame, least: float) -> DataFrame:
    """out with _found: the spans of _single, and the runs of lines that are licenses."""
    lines = F.filter(F.transform(F.split("_norm", "\n"), lambda x: F.array_remove(F.split(x, NO_WORD), "")), lambda w: F.size(w) > 0)
    out = out.withColumn("_split", F.when(F.size("_likely") > 0, lines).otherwise(F.array().cast("array<array<string>>")))
    # Words of each line, and its bigrams with the one from the line before.
    before = lambda k: F.coalesce(F.slice(F.get("_split", k - 1), -1, 1), F.array().cast("array<string>"))
    out = out.withColumn("_lines", F.transform("_split", lambda w, k: F.struct(w.alias("words"), _bigrams(F.concat(before(k), w)).alias("grams"))))
    # Words of all lines up to each.
    sums = F.aggregate("_split", F.array().cast("array<int>"), lambda at, w: F.concat(at, F.array(F.coalesce(F.element_at(F.when(F.size(at) > 0, at), -1), F.lit(0)) + F.size(w))))
    out = out.withColumn("_sums", sums)
    found = F.when(F.size("_lines") > 1, F.flatten(F.transform("_likely", lambda t: _runs(t, least))))
    out = out.withColumn("_runs", F.sort_array(F.coalesce(found, F.array().cast(_RUN)), asc=False))
    free = lambda taken, r: ~F.exists(taken, lambda x: (x["k"] <= r["e"]) & (r["k"] <= x["e"]))
    best = F.aggregate("_runs", F.array().cast(_RUN), lambda taken, r: F.when(free(taken, r), F.concat(taken, F.array(r).cast(_RUN))).otherwise(taken))
    # A run around a span found by itself for the same template, or within it, is that span again.
    inside = lambda x, y: F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), y, F.lit(" ")))
    again = lambda r: F.exists("_single", lambda x: (x["i"] == r["i"]) & (inside(x["said"], r["said"]) | inside(r["said"], x["said"])))
    out = out.withColumn("_best_runs", F.when(F.size("_runs") > 0, best).otherwise(F.array().cast(_RUN)))
    pure = lambda xs: F.transform(xs, lambda x: F.struct(x["dice"].alias("dice"), x["i"].alias("i")))
    # Of runs with the same words one counts, as of equal lines or paragraphs.
    new = F.array_distinct(F.transform(F.filter("_best_runs", lambda r: ~again(r)), lambda r: F.struct(r["dice"].alias("dice"), r["i"].alias("i"), r["said"].alias("said"))))
    return out.withColumn("_found", F.concat(pure("_single"), pure(new)))


def scan(docs: DataFrame, templates: list[Template] | None = None, least: float = LEAST, text: str = "text") -> DataFrame:
    """docs with license, category, dice (of the best span), n_license_spans, licenses (of
    all spans, sorted, comma-separated)."""
    templates = templates or TEMPLATES
    kept = [c for c in docs.columns if c not in RESULTS]
    known = _known(docs.sparkSession, templates, least)
    names = F.array(*[F.lit(t.license) for t in templates])
    kinds = F.array(*[F.lit(t.category) for t in templates])
    out = docs.withColumn("_norm", normalised(F.col(text), templates))
    out = _with_likely(out, known, least)
    spans = F.concat(F.array("_norm"), F.split("_norm", r"\n[\x20\t\r]*\n"), F.split("_norm", "\n"))
    out = out.withColumn("_spans", F.when(F.size("_likely") > 0, F.array_distinct(spans)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_words", F.transform("_spans", lambda s: F.array_remove(F.split(s, NO_WORD), "")))
    out = out.withColumn("_many", F.filter("_words", lambda w: F.size(w) > 1))
    out = out.withColumn("_grams", F.transform("_many", lambda w: F.struct(_bigrams(w).alias("grams"), F.array_join(w, " ").alias("said"))))

    def best(s: Column) -> Column:
        fits = F.filter("_likely", lambda t: F.size(s["grams"]).between(t["low"], t["high"]))
        like = F.filter(fits, lambda t: (_dice(s["grams"], t["grams"]) >= least) & _agrees(s["said"], t))
        dice = F.transform(like, lambda t: F.struct(_dice(s["grams"], t["grams"]).alias("dice"), (-t["i"]).alias("i"), s["said"].alias("said")))
        return F.array_max(dice)

    out = out.withColumn("_single", F.filter(F.transform("_grams", best), lambda b: b.isNotNull()))
    out = _with_runs(out, least)
    out = out.withColumn("_best", F.array_max("_found"))
    at = lambda b: F.element_at(names, 1 - b["i"])
    return out.select(
        *kept,
        F.when(F.col("_best").isNotNull(), F.element_at(names, 1 - F.col("_best.i"))).alias("license"),
        F.when(F.col("_best").isNotNull(), F.element_at(kinds, 1 - F.col("_best.i"))).alias("category"),
        F.round(F.coalesce("_best.dice", F.lit(0.0)), 6).alias("dice"),
        F.size("_found").cast("long").alias("n_license_spans"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", at))), ",").alias("licenses"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(t.license)}, {quoted(t.category)}, {quoted(t.text)}, {quoted(t.version)})" for i, t in enumerate(TEMPLATES))


_NORM = r"regexp_replace(replace(lower(coalesce({}, '')), 'licence', 'license'), 'copyright\s+(\(c\)|©|[0-9]{{4}})[^\n]*', '', 'g')"
_TELLING = "list_filter([" + ", ".join(f"'{x}'" for x in TELLING) + "], lambda x: contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || x || ' '))"
_VERSIONS = "list_transform(str_split(regexp_replace(array_to_string({0}, ' '), '[^ ]*[^ 0-9][^ ]*', '|', 'g'), '|'), lambda x: regexp_replace(trim(x), '( 0)+$', ''))"
_LIST = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

#: The same by joins: every span that is a license's within the bounds, and the best of each text.
OP6_SQL = rf"""
WITH t AS (SELECT i, license, category, version, {_TELLING.format("w")} AS telling, {_LIST.format("w")} AS g FROM (SELECT i, license, category, version, regexp_extract_all({_NORM.format("text")}, '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_values()}) v(i, license, category, text, version))),
n AS (SELECT row_number() OVER () AS r, doc_id, {_NORM.format("text")} AS norm FROM documents),
s AS (SELECT DISTINCT r, unnest(list_concat([norm], regexp_split_to_array(norm, '\n[\x20\t\r]*\n'), str_split(norm, chr(10)))) AS span FROM n),
w AS (SELECT r, span, regexp_extract_all(span, '[\p{{L}}\p{{N}}]+') AS w FROM s),
g AS (SELECT r, span, w, {_LIST.format("w")} AS g FROM w WHERE len(w) > 1),
m AS (SELECT r, span, w, t.telling, t.version, t.license, t.category, t.i, 2.0 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) BETWEEN ceil(len(t.g) * {LEAST} / {2 - LEAST} - 1e-9) AND floor(len(t.g) * {2 - LEAST} / {LEAST} + 1e-9)),
b AS (SELECT * FROM m WHERE dice >= {LEAST} AND {_TELLING.format("w")} = telling AND (version = '' OR list_contains({_VERSIONS.format("w")}, version)) QUALIFY row_number() OVER (PARTITION BY r, span ORDER BY dice DESC, i) = 1),
d AS (SELECT r, first(license ORDER BY dice DESC, i) AS license, first(category ORDER BY dice DESC, i) AS category, max(dice) AS dice, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM b GROUP BY r)
SELECT n.doc_id, d.license, d.category, round(coalesce(d.dice, 0.0), 6)::DOUBLE AS dice, coalesce(d.n, 0)::BIGINT AS n_license_spans, coalesce(d.licenses, '') AS licenses
FROM n LEFT JOIN d ON n.r = d.r
"""
