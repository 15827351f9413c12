r"""URL filter: glob rules as one bit-parallel automaton.

Every rule is a glob over the canonical URL (host, path, query; no scheme, no fragment):

    ?    any one byte               *    a run without / ? #
    **   any run                    else the character itself

All rules lie side by side in a row of 64-bit words, a bit for each state. A step of the
automaton is Shift-And with loops, for all rules and all URLs of a block at once:

    D = ((D << 1) & enter[c]) | (D & stay[c])

`enter[c]` holds the states that character c leads into, `stay[c]` those in which a
wildcard absorbs c. A URL fits a rule if the rule's last state is set after its last byte.

Host rules (a host with its subdomains, and a path prefix) are two globs each, so the same
automaton decides them; the longest one that fits wins over every plain glob. Of plain
globs the longest that fits wins, at equal length the block. No fit: `default`.

Null URLs and those without "://" have an empty host and path; they fit only globs that
fit the empty string. Equal rows get equal results, other columns pass through unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of URL text in a block of the automaton.
BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


@dataclass(frozen=True)
class GlobRule:
    verdict: str
    glob: str


class ShiftAnd:
    """The automaton of some globs; matches(urls) is a row of booleans for each URL."""

    def __init__(self, globs: list[str]):
        starts, ends, at = [], [], 0
        enter: list[tuple[int, int | None]] = []
        stay: list[tuple[int, str]] = []
        for g in globs:
            starts.append(at)
            raw, i = g.encode(), 0
            while i < len(raw):
                c = raw[i : i + 1]
                if raw[i : i + 2] == b"**":
                    stay.append((at, "any"))
                    i += 2
                elif c == b"*":
                    stay.append((at, "part"))
                    i += 1
                else:
                    at += 1
                    enter.append((at, None if c == b"?" else raw[i]))
                    i += 1
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for state, byte in enter:
            self.enter[slice(None) if byte is None else byte, state >> 6] |= np.uint64(1 << (state & 63))
        inside = np.array([b for b in range(256) if b not in b"/?#"])
        for state, run in stay:
            self.stay[slice(None) if run == "any" else inside, state >> 6] |= np.uint64(1 << (state & 63))
        for state in starts:
            self.first[state >> 6] |= np.uint64(1 << (state & 63))
        self.ends = np.array(ends, dtype=np.int64)

    def matches(self, urls: list[str]) -> np.ndarray:
        raw = [u.encode("utf-8", "surrogatepass") for u in urls]
        found = np.zeros((len(raw), len(self.ends)), bool)
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        at = 0
        while at < len(order):  # blocks of URLs of like length
            wide = max(1, len(raw[order[at]]))
            block = order[at : at + max(1, BLOCK_BYTES // wide)]
            found[block] = self._block([raw[i] for i in block], wide)
            at += len(block)
        return found

    def _block(self, raw: list[bytes], wide: int) -> np.ndarray:
        """raw: longest first."""
        chars = np.zeros((len(raw), wide), np.uint8)
        for i, r in enumerate(raw):
            chars[i, : len(r)] = np.frombuffer(r, np.uint8)
        lengths = np.array([len(r) for r in raw])
        d = np.tile(self.first, (len(raw), 1))
        for p in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -p, side="left"))  # URLs longer than p
            c, old = chars[:n, p], d[:n]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            d[:n] = (moved & self.enter[c]) | (old & self.stay[c])
        return (d[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the query with its mark."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return host, path, query


def judge(pages: DataFrame, host_rules: list[HostRule], glob_rules: list[GlobRule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the host rule that decided, else null), verdict.

    Columns of pages that bear one of these names are replaced."""
    globs = [(g, r) for r in host_rules for g in r.globs()] + [(r.glob, r) for r in glob_rules]
    rules = [r for _, r in globs]
    # The order of precedence: host rules before globs, longer before shorter, block before allow.
    rank = sorted(range(len(rules)), key=lambda i: (isinstance(rules[i], GlobRule), -len(rules[i].name if isinstance(rules[i], HostRule) else rules[i].glob), rules[i].verdict != "block", i))
    automaton = ShiftAnd([globs[i][0] for i in rank])
    names = np.array([rules[i].name if isinstance(rules[i], HostRule) else None for i in rank] + [None], dtype=object)
    verdicts = np.array([rules[i].verdict for i in rank] + [default], dtype=object)

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            fits = automaton.matches(urls.tolist()) if len(urls) else np.zeros((0, len(rank)), bool)
            best = np.where(fits.any(1), fits.argmax(1), len(rank)) if len(rank) else np.zeros(len(urls), int)
            yield pd.DataFrame({"rule": names[best], "verdict": verdicts[best]})

    kept = pages.drop("host", "path", "rule", "verdict")
    host, path, query = parts(pages[url])
    out = pages.select(*[pages[c] for c in kept.columns], host.alias("host"), path.alias("path"), query.alias("_query"))
    out = out.withColumn("_judged", decide(F.concat("host", "path", "_query")))
    return out.select(*kept.columns, "host", "path", F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict"))


HOST_RULES = [HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/")]

#: Judge what no host rule names.
GLOB_RULES = [
    GlobRule("block", "ads.**"), GlobRule("block", "**.ads.*/**"), GlobRule("block", "track*.*/**"),
    GlobRule("block", "**/wp-admin/**"), GlobRule("block", "**/login**"), GlobRule("block", "**/cart/**"),
    GlobRule("block", "**.exe"), GlobRule("block", "**.zip"), GlobRule("block", "**?sessionid=**"),
    GlobRule("block", "*casino*/**"), GlobRule("block", "*porn*/**"), GlobRule("allow", "*.edu/**"),
]


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES, GLOB_RULES).select("page_id", "host", "path", "rule", "verdict")


#: The same judgement as plain predicates over the parts of a URL.
OP10_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule, host || path || query AS canon FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(canon, '(?s)/wp-admin/|^.*.sessionid=') THEN 'block'
    WHEN regexp_matches(canon, '(?s)^[^/?#]*casino[^/?#]*/|\.ads\.[^/?#]*/|^track[^/?#]*\.[^/?#]*/|/login|/cart/') THEN 'block'
    WHEN regexp_matches(canon, '^[^/?#]*porn[^/?#]*/') THEN 'block'
    WHEN regexp_matches(canon, '^[^/?#]*\.edu/') THEN 'allow'
    WHEN regexp_matches(canon, '(?s)^ads\.|\.exe$|\.zip$') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
