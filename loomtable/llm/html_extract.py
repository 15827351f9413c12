r"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Subtrees that are never article text are cut: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, by tag,
role, or a word of their class or id. Every block of running text then passes points to
the elements around it: one, one for each comma, and one for each hundred characters up to
three; the parent gets them whole, the grandparent half, the k-th above it 1/(3k), up to
`LEVELS` above. An element's points are discounted by the share of its text that stands in
links. The best element is taken, or the article or main element around it; without such a one
the lowest element around it that holds nearly all of the page's text outside links, so an article in
many boxes stays whole. With it go those of its siblings that score well beside it and what
stands between these; headings, lists, tables, paragraphs and bare text beside it stay unless
they are mostly links.

A cut for the words of a class or id is taken back where the article must be inside, as no
other text is on the page (see take_back), unless the words name reader comments; how much of
the page an element holds never decides it alone. All passes are linear in the page: open tags
are counted, sums go from the leaves up, nothing recurses.

Results of the odd cases: null or empty html, and pages without text, give an empty text;
text outside any element is a block of the page; unclosed elements end with their
parent; a tag cut off by the end of the page is markup. Repeated rows repeat their result;
other columns pass through, those named text or n_chars are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
CUT = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas math button select option textarea input label fieldset menu dialog audio video map title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend"}
SCOPE = frozenset("table td th caption html button object".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs combx comment comments commentlist community consent cookie cookies discussion disclaimer disqus "
    "footer footnav foot gdpr header masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification alert pager pagination popup promo promoted promotion related remark replies reply respond "
    "response responses rss share sharing shoutbox sidebar sidebars sidenav skyscraper social sponsor sponsored sponsors subscribe subscription thread threads toolbar topbar tracking warning widget widgets".split()
)
#: Words that name what readers wrote: cut however long it is.
READERS = frozenset("combx comment comments commentlist discussion disqus replies reply respond response responses shoutbox thread threads".split())
LIKELY = frozenset("article articlebody body content entry hentry main page post story text".split())
#: Elements kept beside the best one unless they are mostly links.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure center".split())
LEVELS = 20
#: So much text outside cut elements and links is an article, or may be.
TEXT_CHARS = 25
#: The share of the page's text outside links that the article holds, if no element is marked as one.
NEARLY_ALL = 0.9
CUT_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAMES = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "parent", "parts", "cut", "soft", "likely", "points", "own", "chars", "linked", "open")

    def __init__(self, tag: str, parent: Element | None, cut: bool = False, soft: bool = False, likely: bool = False):
        self.tag, self.parent, self.cut, self.soft, self.likely = tag, parent, cut, soft, likely
        self.parts: list[Element | str] = []
        self.points = self.own = 0.0
        self.chars = self.linked = 0
        # Which of the tags that others end are open from here up to the next scope.
        above = 0 if parent is None or tag in SCOPE else parent.open
        self.open = (above & ~BITS["li"] if tag in LISTS else above) | BITS.get(tag, 0)


LISTS = frozenset(("ul", "ol", "menu"))
#: By start tag: the open elements that it ends; a bit for each tag among them.
ENDED = {tag: ENDS.get(tag, {"p"}) for tag in ENDS_P | ENDS.keys()}
BITS = {tag: 1 << n for n, tag in enumerate(sorted(set().union(*ENDED.values())))}
ENDED_BITS = {tag: sum(BITS[t] for t in ended) for tag, ended in ENDED.items()}


def unlikely(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether to cut an element, whether only for its names, and whether these speak for
    article text."""
    if tag in CUT or (tag == "header" and not inside_article):
        return True, False, False
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in CUT_ROLES:
                return True, False, False
        else:
            names.update(NAMES.findall(value))
    likely = bool(names & LIKELY)
    cut = bool(names & UNLIKELY) and not likely and tag not in ("html", "body", "article", "main")
    return cut, cut and not names & READERS, likely


def parse(page: str) -> Element:
    root = top = Element("html", None)
    at = 0
    opened: Counter[str] = Counter()

    def close(node: Element) -> None:
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent
        opened[node.tag] -= 1
        top = node.parent

    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            top.parts.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:  # a comment or a declaration
            continue
        tag = name.lower()
        if closing:
            if opened[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in ("html", "body"):
            continue
        if top.open & ENDED_BITS.get(tag, 0):
            node = top
            while node.tag not in ENDED[tag]:
                node = node.parent
            close(node)
        if tag in VOID:
            if tag == "br":
                top.parts.append("\n")
            elif tag == "hr":
                top.parts.append(Element("hr", top))
            continue
        cut, soft, likely = unlikely(tag, attributes or "", opened["article"] + opened["main"] > 0)
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":  # <path/> of an image
            continue
        node = Element(tag, top, cut, soft, likely)
        top.parts.append(node)
        top = node
        opened[tag] += 1
    return root


RAW_ENDS = {tag: re.compile(rf"</{tag}\s*/?>", re.I) for tag in RAW}


def elements(root: Element) -> list[Element]:
    """All elements but those of cut subtrees (cut only for their names: they are among them),
    each before those inside it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.cut or node.soft:
            out.append(node)
            stack.extend(x for x in node.parts if isinstance(x, Element))
    return out


def take_back(root: Element) -> None:
    """Takes back cuts that only class words gave, where the article must be inside: if nothing
    else has text of its own, the cut element with most text, and if that has none outside a cut
    element in it, the largest in there, and so on; if no article or main element is left but cut
    ones are, those around the longest, should it be longer than all that is left."""
    found = elements(root)
    softs: dict[int, list[Element]] = {}
    above: dict[int, Element | None] = {id(root): None}
    free, whole = Counter(), Counter()  # text that is not in a link: outside cut elements inside an element, and all
    in_link: dict[int, bool] = {}
    for node in found:
        if node.parent is not None:
            above[id(node)] = node.parent if node.parent.cut else above[id(node.parent)]
        in_link[id(node)] = node.tag == "a" or (node.parent is not None and in_link[id(node.parent)])
        if node.cut:
            softs.setdefault(id(above[id(node)]), []).append(node)
        if not in_link[id(node)]:
            own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
            free[id(node)] += own
            whole[id(node)] += own
    for node in reversed(found):
        if node.parent is not None:
            whole[id(node.parent)] += whole[id(node)]
            free[id(node.parent)] += 0 if node.cut else free[id(node)]
    at, key = root, id(None)
    while free[id(at)] < TEXT_CHARS and softs.get(key):
        at = max(softs[key], key=lambda x: whole[id(x)])
        if not whole[id(at)]:
            return
        at.cut, key = False, id(at)
    if at is not root:
        return
    marked = [x for x in found if x.tag in ("article", "main")]
    inside = [x for x in marked if not x.cut and above[id(x)] is not None]
    if inside and len(inside) == len(marked):
        best = max(inside, key=lambda x: free[id(x)])
        if free[id(best)] > free[id(root)]:
            node = above[id(best)]
            while node is not None:
                node.cut, node = False, above[id(node)]


def running(node: Element) -> Iterator[tuple[Element, str, bool]]:
    """Pieces of text in page order, each with its block element, and if it is in a link.
    A None text marks where a block begins or ends."""
    stack: list[tuple[Element | str | None, Element, bool]] = [(node, node, False)]
    while stack:
        part, block, linked = stack.pop()
        if part is None:
            yield block, None, linked
        elif isinstance(part, str):
            if part:
                yield block, part, linked
        elif not part.cut:
            own = part if part.tag in BLOCK else block
            if own is part:
                yield part, None, linked
                stack.append((None, block, linked))
            linked = linked or part.tag == "a"
            stack.extend((x, own, linked) for x in reversed(part.parts))
        elif part.tag in BLOCK:
            yield block, None, linked


def blocks(node: Element) -> Iterator[tuple[Element, str, int]]:
    """(element, text in one line, characters of it in links) of every block with text."""
    pieces: list[str] = []
    linked = 0
    owner = node
    for block, text, in_link in running(node):
        if text is None:
            if pieces and (said := " ".join("".join(pieces).split())):
                yield owner, said, min(linked, len(said))
            pieces, linked = [], 0
            owner = block
        else:
            owner = block
            pieces.append(text)
            linked += len(text) * in_link
    if pieces and (said := " ".join("".join(pieces).split())):
        yield owner, said, min(linked, len(said))


def score(root: Element) -> list[Element]:
    """The elements that got points, best first."""
    owners: dict[int, Element] = {}
    for owner, text, linked in blocks(root):
        above = owner if owner.tag not in TEXTUAL else owner.parent or owner
        above.own += 1 + text.count(",") + min(len(text) // 100, 3)
        owners[id(above)] = above
        owner.chars += len(text)
        owner.linked += linked
    for node in reversed(elements(root)):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored: dict[int, Element] = {}
    for node in owners.values():
        own, level = node.own, 0
        while node is not None and level <= LEVELS:
            node.points += own if level == 0 else own / 2 if level == 1 else own / (3 * level)
            scored[id(node)] = node
            node, level = node.parent, level + 1
    for node in scored.values():
        if node.tag in ("article", "main") or node.likely:
            node.points += 25
        node.points *= 1 - node.linked / max(1, node.chars)
    return sorted(scored.values(), key=lambda x: -x.points)


#: Elements of running text: their points begin at the element around them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre dt dd blockquote".split())


def beside(best: Element) -> list[Element | str]:
    """What of best's parent belongs to the article, in page order."""
    parts = [x for x in best.parent.parts if isinstance(x, str) or not x.cut]
    least = max(10.0, best.points / 5)

    def links(x: Element | str) -> float:
        return 0.0 if isinstance(x, str) else x.linked / max(1, x.chars)

    def fits(x: Element | str) -> bool:
        if isinstance(x, str):
            return True
        return x is best or x.points >= least or (x.tag == best.tag and x.tag in ("article", "section")) or (x.tag in PLAIN and links(x) < 0.5) or x.tag not in BLOCK

    certain = [i for i, x in enumerate(parts) if not isinstance(x, str) and fits(x)]
    return [x for i, x in enumerate(parts) if fits(x) or (certain[0] < i < certain[-1] and links(x) < 0.5)]


def container(best: Element, root: Element) -> Element:
    """The lowest element around best with nearly all of the page's text that is in no link."""
    most = (root.chars - root.linked) * NEARLY_ALL
    while best.chars - best.linked < most and best.parent is not None:
        best = best.parent
    return best


def without_lists_of_links(node: Element) -> None:
    """Cuts the children of node, and of elements that hold most of its text, which are mostly
    links."""
    while True:
        inner = [x for x in node.parts if isinstance(x, Element) and not x.cut and x.tag in BLOCK and x.tag not in TEXTUAL]
        for x in inner:
            x.cut = x.linked * 2 > x.chars
        large = [x for x in inner if not x.cut and x.chars * 2 > node.chars]
        if not large:
            return
        node = large[0]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    take_back(root)
    ranked = score(root)
    if not ranked:
        return ""
    best = ranked[0]
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:  # an article is taken whole, whichever part of it scores best
        best = node
    elif (around := container(best, root)) is not best:
        best = around
        without_lists_of_links(best)
    if best is root or best.parent is None:
        return "\n\n".join(text for _, text, _ in blocks(root))
    frame = Element("div", None)
    frame.parts = beside(best)
    return "\n\n".join(text for _, text, _ in blocks(frame))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points of text)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    out = pages.select(*kept, run(pages[html]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
