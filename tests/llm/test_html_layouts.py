"""The main text of generated layouts: a planted article comes out whole and alone."""

import random

import pytest

from loomtable.llm import html_extract

WRAPS = ["div", "section", "p", "li", "td", "div div", "section div", "div div div", "section div p", "div section div", "center"]


def sentence(rng, kind, words):
    said = [f"{kind}{rng.randrange(10**6)}" for _ in range(words)]
    return ", ".join([" ".join(said[: words // 2]), " ".join(said[words // 2 :])]) + "."


def boxed(text, wrap):
    for tag in reversed(wrap.split()):
        text = {"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}</{tag}>")
    return text


@pytest.mark.parametrize("seed", range(120))
def test_planted_articles(seed):
    rng = random.Random(seed)
    wrap = rng.choice(WRAPS)
    said = [sentence(rng, "text", rng.randrange(8, 40)) for _ in range(rng.randrange(2, 12))]
    body = "".join(boxed(x, wrap if rng.random() < 0.7 else rng.choice(WRAPS)) for x in said)
    long = lambda n: "".join(f"<p>{sentence(rng, 'other', 20)}</p>" for _ in range(n))
    around = [f'<div class="{rng.choice(["sidebar", "related posts", "widget", "cookie-consent", "newsletter"])}">{long(rng.randrange(1, 20))}</div>' for _ in range(rng.randrange(3))]
    readers = [f'<div id="{rng.choice(["comments", "thread", "disqus"])}">{long(rng.randrange(1, 20))}</div>'] if rng.random() < 0.5 else []
    menu = "<ul>" + "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(8)) + "</ul>"
    article = {0: f"<article>{body}</article>", 1: f'<div class="content">{body}</div>', 2: f"<div>{body}</div>", 3: f"<main><div>{body}</div></main>"}[seed % 4]
    page = f"<html><body><nav>{menu}</nav><header><a href=/>Site</a></header>{''.join(around[:1])}{article}{''.join(around[1:] + readers)}<footer>End of it.</footer></body></html>"
    assert html_extract.main_text(page).split("\n\n") == said


P = "<p>Some words of the article, and more of them, to be read here.</p>"
A = "Some words of the article, and more of them, to be read here."
O = "<p>Words of another kind, which nobody, really, asked for in this place.</p>"  # noqa: E741
ROWS = [f"Row {k} of the text, with words in it, as an article." for k in range(6)]


@pytest.mark.parametrize(("page", "want"), [
    (f"<div class=header-wrap>{P}{P}</div><div class=sidebar>{O}</div>", [A, A]),  # all of it under speaking names: the longest
    (f"<div class=widget><div class=widget>{P}</div></div>", [A]),
    (f"<div class='sidebar-layout'><article>{P * 3}</article></div><p>A line of the site, which is short.</p>", [A] * 3),
    (f"<div class=content>{P * 3}</div><div class=related><article>{O}</article></div>", [A] * 3),
    (f"<div>{P}</div><div class=cookie-consent>{O * 9}</div>", [A]),
    (f"<div>{P}</div><div class=thread>{O * 9}</div>", [A]),
    ("<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in ROWS) + "</table>", ROWS),
    ("<div>" + "".join(f"<section><div>{x}</div></section>" for x in ROWS) + "</div>", ROWS),
    (f"<div><div>{P}</div><div><div><section>{P}</section></div></div><ul><li><a href=a>menu</a></li><li><a href=b>menu</a></li></ul></div>", [A, A]),
    ("<div class=ad><a href=x>only a link of some length here, is it not</a></div>", []),
])
def test_boxes_and_names(page, want):
    assert [x for x in html_extract.main_text(page).split("\n\n") if x] == want
