"""Main text of pages of several layouts."""

from __future__ import annotations

import math
import random
import re
import statistics
import time
from html.parser import HTMLParser

import pytest

from garoa.llm import html_text

ONE = "The first paragraph of the story, with a comma, and a full stop. It goes on for a while."
TWO = "The second one is as long as the first, more or less; it ends here. And here, too."
STORY = f"<h1>A title</h1><p>{ONE}</p><p>Short.</p><ul><li>one item</li><li>two</li></ul><p>{TWO}</p>"
TEXT = f"A title\n\n{ONE}\n\nShort.\n\none item\n\ntwo\n\n{TWO}"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News, sports, and more</a></li></ul>"
LONG = "Buy now, it is cheap, it is good, it is the best you can get today! Really, do it. " * 4

PAGES = {
    "article": f"<nav>{MENU}</nav><div class='ad'>{LONG}</div><article>{STORY}</article><footer>&copy; us, {LONG}</footer>",
    "main": f"<header>{MENU}<h2>Site</h2></header><main>{STORY}</main><aside>{LONG}</aside>",
    "divs": f"<div id='top-nav'>{MENU}</div><div class='page'><div class='post'>{STORY}</div><div id='comments'><p>{LONG}</p></div></div>",
    "bare": f"<div>{MENU}</div>{STORY}<div class='cookie-notice'>{LONG}</div>",
    "side": f"<div class='layout with-sidebar'><div class='sidebar'>{LONG}</div><article class='no-comments'>{STORY}<footer>tags</footer></article></div>",
    "inner": f"<article>{STORY}<section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p></form></article><article><p>More, soon.</p></article>",
    "roles": f"<div role=navigation>{MENU}</div><div role=main>{STORY}</div><div hidden>{LONG}</div><div style='display: none'>{LONG}</div>",
    "upper": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{STORY}</ARTICLE></BODY>",
    "titled": f"<header><h1>The site</h1>{MENU}</header>{STORY}<footer>{LONG}</footer>",
    "open": f"<nav>{MENU}</nav><article><h1>A title<p>{ONE}<p>Short.<ul><li>one item<li>two</ul><p>{TWO}",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{PAGES[name]}</body></html>"
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>a &amp; b&nbsp;&lt;c&gt; &#233;&#x4e00; &unknown; &copy</p></article>", "a & b <c> é一 &unknown; ©"),
        ("<article><p>a<br>b  \n c<b>d</b> <i> e</i></p></article>", "a b cd e"),
        ("<article><p><b>one<br><p>two</p></article>", "one\n\ntwo"),
        ("<article><script>var x = '<p>no</p>';</script><p>1 < 2 and 3 > 2, yes.</p><!-- <p>no</p> --></article>", "1 < 2 and 3 > 2, yes."),
        ("<article><p title='a>b' class=\"x\">kept</p><p>cut <b", "kept\n\ncut"),
        ("<article><p>end</p></article></div></p></body>", "end"),
        ("plain text, no tags.", "plain text, no tags."),
        ("<p></p>", ""),
        ("", ""),
        (None, ""),
        ("<", "<"),
        ("<script>", ""),
    ],
)
def test_markup(html, text):
    assert html_text.main_text(html) == text


def test_table_of_odd_rows(spark):
    rows = [(1, "u", PAGES["article"]), (1, "u", PAGES["article"]), (None, None, None), (3, "v", "<p>" + "x, " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = sorted((r.page_id or 0, r.n_chars, r.text[:9]) for r in html_text.extract(df).collect())
    assert out == [(0, 0, ""), (1, len(TEXT), "A title\n\n"), (1, len(TEXT), "A title\n\n"), (3, 299_999, "x, x, x, ")]
    assert html_text.extract(df.limit(0)).collect() == []


def test_deep_nesting_is_no_problem():
    assert html_text.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


SENTENCE = "A sentence of the article, long enough to be prose; with marks, and more of them. And another one!"
P = f"<p>{SENTENCE}</p>"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<form><article><h1>T</h1>{P}</article></form>", ["T", SENTENCE]),
        (f"<form id='aspnet'><h1>T</h1>{P}{P}</form><div class='footer'>Imprint</div>", ["T", SENTENCE, SENTENCE]),
        (f"<div class='with-sidebar'>{P}{P}</div>", [SENTENCE, SENTENCE]),
        (f"<article>{P}<section id='discussion'><h2>D</h2>{P}</section></article>", [SENTENCE, "D", SENTENCE]),
        (f"<article>{P}<section class='related-work'>{P}</section></article>", [SENTENCE, SENTENCE]),
        (f"<article>{P}<div class='related'><a href='x'>More</a> <a href='y'>Yet more</a></div></article>", [SENTENCE]),
        (f"<article>{P}<p>See <math><mi>x</mi></math> and <label>this</label> <span class='search'>here</span>.</p></article>", [SENTENCE, "See x and this here."]),
        (f"<article>{P}</article><div class='comments'>{P * 20}</div>", [SENTENCE]),
        (f"<body><nav>{'<a href=z>Home</a>' * 9}</nav>{P}{P}<aside><article>{P[:40]}</article></aside></body>", None),
    ],
)
def test_names_alone_decide_nothing(page, blocks):
    found = html_text.main_text(page).split("\n\n")
    if blocks is not None:
        assert found == blocks
    assert "Home" not in found


def test_unclosed_and_stray_tags_take_constant_work():
    start = time.perf_counter()
    for page in ("<article>" + "<font>" * 20_000 + P, "<article>" + "<b>" * 9000 + "</i>" * 20_000 + P, "<article>" + "<div>" * 5000 + P):
        assert SENTENCE in html_text.main_text(page)
    assert time.perf_counter() - start < 6


def plain_paths(page: str) -> list[tuple[str, str]]:
    """Path and text of each text of a well-formed page, by the standard parser."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.path, self.out = [], []

        def handle_starttag(self, tag, attrs):
            words = sorted(set(re.findall(r"[a-z0-9]+", (dict(attrs).get("class") or "").lower())))
            self.path.append(".".join([tag, *words]))

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, data):
            self.out.append(("/".join(self.path), data))

    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader.out


def test_paths_are_chosen_by_their_ratios():
    draw = random.Random(2)
    for _ in range(40):
        parts = []
        for _ in range(draw.randint(3, 14)):
            words = " ".join(draw.choice(["word", "other,", "end."]) for _ in range(draw.choice([2, 3, 25, 60])))
            kind = draw.choice(["p", "div class='x'", "div class='y z'", "li", "a"])
            parts.append(f"<{kind}>{words}</{kind.split()[0]}>")
        page = f"<html><body><div class='one'>{''.join(parts)}</div></body></html>"
        nodes = plain_paths(page)
        score = {}
        for path in {p for p, _ in nodes}:
            own = [t for p, t in nodes if p == path]
            marks = sum(c in ".,;:!?" for t in own for c in t)
            score[path] = sum(len(t) for t in own) / len(own) * math.log1p(1 + marks / len(own))
        row = [0.0 if p.endswith("/a") else score[p] for p, _ in nodes]
        wide = [row[0], *row, row[-1]]
        smooth = [sum(w * wide[i + j] for j, w in enumerate((0.25, 0.5, 0.25))) if row[i] else 0.0 for i in range(len(row))]
        limit = 0.5 * statistics.pstdev(smooth)
        mean = {p: statistics.fmean(s for (q, _), s in zip(nodes, smooth, strict=True) if q == p) for p, _ in nodes}
        want = [t for p, t in nodes if mean[p] > 0 and mean[p] >= limit - 1e-9] if any(row) else []
        mine = html_text.texts(page)
        chosen = html_text.content_paths(mine)
        assert [t for e, t, _ in mine if e.path in chosen] == want
