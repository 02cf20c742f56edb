"""Main text of pages: cuts against all labellings, reading against known blocks, and whole pages of several layouts."""

import itertools
import random
import time

import pytest

from voxloom.llm import pages as P
from voxloom.llm.common import table
from voxloom.llm.queries import op11_minimum_cut_pages

A = "The committee met on Tuesday to discuss the new rules. It found that most of them had never been applied, and said so."
B = "Several members asked for more time. “We can't decide this today,” said one of them, who did not want to be named."
C = "In the end a vote was postponed until the spring, when a second report on the costs is due to be published."
SHORT = "Not everyone agreed."


def lowest(excess, edges):
    """The labelling of least cost with the fewest nodes on the source's side, out of all."""
    best = None
    for side in itertools.product([False, True], repeat=len(excess)):
        cost = sum(max(0, x) for x, s in zip(excess, side, strict=True) if not s) + sum(max(0, -x) for x, s in zip(excess, side, strict=True) if s)
        cost += sum(c for a, b, c in edges if side[a] != side[b])
        best = min(best or (cost, sum(side), side), (cost, sum(side), side))
    return list(best[2])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        excess = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        want = lowest(excess, edges)
        assert P.settled(excess, edges) == want and P.minimum_cut(excess, edges) == want


def texts(html):
    return [b.text for b in P.read(html).blocks]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain", ["plain"]),
        ("a < b &amp; c&lt;d &copy &#233;&nbsp;x", ["a < b & c<d © é x"]),
        ("<p>a<p>b<br>c<br/>d<hr>e", ["a", "b c d", "e"]),
        ("<p><b>bold<br><p>next</b> one</p>tail", ["bold", "next one", "tail"]),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>w", ["x", "y", "z", "w"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ('<script>var a="</p><p>no";</script><p>yes<style>p{}</style>!</p>', ["yes!"]),
        ("<!-- <p>no --><p>yes<!---->!<!doctype x><?x y?>", ["yes!"]),
        ('<a title="x > y" href=z>in</a> out <b class=">', ["in out"]),
        ("<p>cut <!-- never closed <p>x", ["cut"]),
        ("<p>cut <script>never closed <p>x", ["cut"]),
        ("<title>T</title><p>é\n\t 漢字\x0b🙂</p></body></html>after", ["é 漢字 🙂", "after"]),
        ("<div>a<span>b</div>c</span>d", ["ab", "cd"]),
        ("<SCRIPT>x</Script ><P CLASS=y>İ</P>", ["İ"]),
        ("</p></div></b>x<p/>y", ["x", "y"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2020 by the publisher. All rights reserved. Nothing may be copied without permission.</p></footer>"
REPLY = "I have read this twice and still think that it is wrong. The rules were applied in our town last year, as everyone knows."
LAYOUTS = {
    "article": f"<body>{MENU}<article><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p></article>{FOOT}",
    "own header": f"<body><header><div class=logo>The Daily</div>{MENU}</header><main><article><header><h1>Vote put off</h1></header><p>{A}<p>{SHORT}<p>{B}<p>{C}</article></main>{FOOT}",
    "divs": f'<body class="has-sidebar"><div id="top-menu"><a href="/">Home</a> <a href="/n">News</a></div><div id="wrap"><div class="post-content"><h2>Vote put off</h2><div>{A}</div><div>{SHORT}</div><div>{B}</div><div>{C}</div></div><div class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Rain expected</a><li><a href=/2>Team wins again</a></ul><p>{REPLY}</p></div></div><div id="footer">Copyright 2020</div>',
    "bare": f"<html><body><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p><p><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></p></body></html>",
    "adverts and notices": f'<body><div class="cookie-notice"><p>We use cookies to give you the best experience of this site. By going on you agree to our use of them.</p><button>Accept</button></div>{MENU}<article><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><div class="ad"><p>Buy one, get one free. Our best offer of the year ends on Sunday, so order now.</p></div><p>{B}</p><aside><p>Read more about this in our archive of reports.</p></aside><p>{C}</p></article>{FOOT}',
    "comments": f'<body>{MENU}<div class=story><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p></div><section id="comments"><h3>2 comments</h3><article class="comment"><p>{REPLY}</p></article><article class="comment"><p>{REPLY}</p></article><form><label>Your name</label><textarea>x</textarea><button>Send</button></form></section>{FOOT}',
    "one form": f'<body><form id="aspnet"><div class="navbar"><a href=/>Home</a></div><main><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p></main><div><input name=q><select><option>All<option>None</select></div></form>',
    "cut off": f"<body>{MENU}<article><h1>Vote put off</h1><p><b>{A}<br><p>{SHORT}</p><p>{B}</p><p>{C}</p></article><footer>&copy; The Da",
    "roles": f'<body><div role="navigation"><p>{REPLY}</p></div><div role="main"><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p></div><div hidden><p>{REPLY}</p></div><div style="display: none"><p>{REPLY}</p></div><div role="contentinfo"><p>{REPLY}</p></div>',
    "tables": f"<body><table><tr><td class=menu><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>Vote put off</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p><p>{C}</p></td></tr></table>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert P.main_text(LAYOUTS[layout]).split("\n") == ["Vote put off", A, SHORT, B, C]


def test_smoothness_keeps_short_blocks_between_paragraphs_and_drops_those_between_links():
    short = "<p>So be it</p>"
    (alone,) = P.read(f"<body>{short}").blocks
    link = '<p><a href="/">Home page</a></p>'
    assert alone.odds < 0 and P.main_text(f"<body>{short}") == ""
    assert P.main_text(f"<body><p>{A}</p>{short}<p>{B}</p>") == f"{A}\nSo be it\n{B}"
    assert P.main_text(f"<body><div><p>{A}</p><p>{B}</p></div><div>{link}{short}{link}</div>") == f"{A}\n{B}"


def test_long_and_deep_pages_end_soon():
    began = time.time()
    assert P.main_text("<article>" + f"<p>{A}</p><div class=ad>x</div>" * 20_000).count("\n") == 19_999
    for odd in ("<div>" * 50_000, "<p>" * 50_000, "<td><p>" * 20_000, "<b>" * 50_000 + "</i>" * 50_000, '<a x="' * 50_000, "<" * 200_000, "<!--" * 50_000, "<li>x" * 30_000, "<div>x" * 3_000, "<table></td>" * 3000):
        P.main_text(odd + "tail")
    assert time.time() - began < 60


def test_extract(spark):
    rows = [(1, "u", LAYOUTS["article"]), (1, "u", LAYOUTS["article"]), (2, None, None), (3, "", ""), (None, "v", "<p>x"), (4, "w", LAYOUTS["divs"] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS text", "8 AS n_chars", "9 AS other")
    got = sorted((tuple(r) for r in P.extract(pages).select("page_id", "url", "other", "text", "n_chars").collect()), key=str)
    assert got == sorted(((i, u, 9, P.main_text(h), len(P.main_text(h))) for i, u, h in rows), key=str)
    assert P.extract(pages.where("false")).collect() == []


def test_query_gives_the_articles(spark, sf_dir):
    """The tables' pages hold one article each; a plain reading of it by patterns."""
    import re
    from html import unescape

    got = {r["page_id"]: r for r in op11_minimum_cut_pages(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(rows)
    for row in rows:
        own = re.search(r"<article>(.*?)(</article>|<footer|$)", row["html"] or "", re.DOTALL)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", own[1] if own else "")
        want = [" ".join(unescape(re.sub(r"<[^<>]*>?", "", p)).split()) for p in parts]
        assert got[row["page_id"]]["text"] == "\n".join(x for x in want if x) and got[row["page_id"]]["url"] == row["url"]
