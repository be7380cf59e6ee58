from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq

from tideline.llm import extract


class Article(HTMLParser):
    """Text blocks of the first article element, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.done = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.done += [""] if tag not in ("b", "br", "a") else []
        self.done[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.done += [""] if tag not in ("b", "br", "a") else []

    def handle_data(self, data):
        self.done[-1] += data if self.inside else ""


def brute(page):
    p = Article()
    p.feed(page)
    p.close()
    return "\n".join(filter(None, (" ".join(x.split()) for x in p.done)))


def test_all_pages_against_another_parser():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert extract.main_text(page) == brute(page)


def test_pages_without_an_article_element():
    long = "A sentence, with commas, that goes on for a while. It has more than one sentence; it is prose."
    page = f"""<html><head><title>t</title></head><body class="has-sidebar"><div id=top-nav><a href=/a>Home</a> <a href=/b>News</a></div>
    <div class="wrap"><div class=post><p>{long}<p>{long} &amp; more<br>here <b>bold</b></div><div class="side-bar sidebar"><p>{long}</p></div>
    <ul><li><a href=x>one</a><li><a href=y>two</a></ul><div class="comments"><p>{long}</p></div></div><script>if (a < b) document.write("<p>x</p>")</script>
    <footer>{long}</footer></body></html>"""
    assert extract.main_text(page) == f"{long}\n{long} & more here bold"


def test_names_of_frames_and_comments():
    page = """<body><div id="page" class="has-sidebar"><div class="right-sidebar layout"><article class="post with-comments"><p>Text.</p></article>
    <section class="comments"><article><p>no</p></article></section><article class="comment"><p>no</p></article></div></div>"""
    assert extract.main_text(page) == "Text."


def test_inside_an_article():
    page = """<body><header><h1>Site</h1></header><main><article><h1>Title</h1><p>One.</p><aside>no</aside><div class='ad'>no</div><p>Two
    lines &lt;b&gt;</p><div class="cookie-notice">no</div><form><p>no</p></form><section id="comments"><p>no</p></section></article></main><p>no"""
    assert extract.main_text(page) == "Title\nOne.\nTwo lines <b>"


LONG = "A sentence, with commas, that goes on for a while. It has more than one sentence; it is prose, as articles are."
MIXED = {
    # no names and no telling elements at all: the ratios decide
    "bare frames": (f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Heading</h1><p>{LONG}</p><p>Short.</p><p>{LONG} {LONG}</p></div><div><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><div>All rights reserved</div></body>", f"Heading\n{LONG}\nShort.\n{LONG} {LONG}"),
    "heading in its own frame": (f"<div><span>12 May</span></div><div><h1>Heading</h1></div><div><p>{LONG}<p>{LONG}</div><div>Next page</div>", f"Heading\n{LONG}\n{LONG}"),
    "table layout": (f"<table><tr><td><a href=a>Start</a><br><a href=b>Map</a></td><td><p>{LONG}<p>{LONG}</td><td>Buy now</td></tr></table>", f"{LONG}\n{LONG}"),
    # links are article text in an article
    "linked heading and references": (f"<article><h1><a href=x>The headline</a></h1><p>{LONG}</p><ul><li><a href=r>First reference</a><li><a href=s>Second reference</a></ul></article><ul><li><a href=t>elsewhere</a></ul>", f"The headline\n{LONG}\nFirst reference\nSecond reference"),
    "names that only sound bad": (f'<article><p>{LONG}</p><div class="related-work"><h2>Related work</h2><p>{LONG}</p></div><section id="skip-lists"><p>On skip lists.</p></section><div class="share-prices">Up.</div></article>', f"{LONG}\nRelated work\n{LONG}\nOn skip lists.\nUp."),
    "a list between paragraphs": (f"<div><p>{LONG}</p><ul><li>milk<li><a href=e>eggs</a></ul><p>{LONG}</p></div><div>Menu</div>", f"{LONG}\nmilk\neggs\n{LONG}"),
    "bad names around all": (f'<div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
    # what names and kinds tell
    "advert in an inline frame": (f'<article><p>{LONG}</p><span class="ad"><div>BUY NOW</div></span><p>{LONG} <span class="advert">Buy!</span>End.</p></article>', f"{LONG}\n{LONG} End."),
    "notices": (f'<div class="acme-cookie-banner"><p>{LONG}</p></div><div class="post"><p>{LONG} One.</p></div><div id="comments"><p>{LONG}</p></div><div class="related-posts"><p>{LONG}</p></div>', f"{LONG} One."),
    "a header within the article": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>By A.</footer></article>", f"Title\n{LONG}"),
    "script with a slash": (f'<article><p>{LONG}</p><script src="a"/>var x=1;</script><p>End.</p></article>', f"{LONG}\nEnd."),
    "hidden": (f'<article><p>{LONG}</p><p hidden>a</p><p style="display: none">b</p><span class="sr-only">c</span><p aria-hidden=true>d</p>e</article>', f"{LONG}\ne"),
}


def test_mixed_pages():
    for name, (page, want) in MIXED.items():
        assert extract.main_text(page) == want, name


LINKS = "".join(f"<li><a href=/{i}>Section number {i} of the site</a>" for i in range(6))
TEASERS = "".join(f"<div><a href=/{i}>Another story that one may like to read {i}</a></div>" for i in range(5))
#: Frames with names, and article elements, beside which links or scraps stand that no name tells.
FRAMED = {
    "a menu in an article page": (f"<nav><ul>{LINKS}</ul></nav><article><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
    "crumbs and pager by name": (f'<div class="breadcrumbs"><a href=/>Home page</a> <a href=/x>A part of it</a></div><div class="post"><p>{LONG}</p><p>{LONG}</p></div><div class="pagination"><a href=2>The next page of all</a></div>', f"{LONG}\n{LONG}"),
    "related stories by name": (f'<main><p>{LONG}</p><div class="related-posts">{TEASERS}</div></main>', LONG),
    "sharing by name": (f'<article><p>{LONG}</p></article><div class="social share"><a href=f>Tell your friends there</a><a href=t>Tell all others here</a></div>', LONG),
    "teasers without a name": (f"<article><p>{LONG}</p><p>{LONG}</p></article><div>{TEASERS}</div>", f"{LONG}\n{LONG}"),
    "teasers beside a main element": (f"<main><h2>On</h2><p>{LONG}</p></main><div>{TEASERS}</div>", f"On\n{LONG}"),
    "date and byline frames": (f'<div class="x1">Tuesday</div><div class="x2">By A. B.</div><div class="x3"><p>{LONG}</p><p>{LONG}</p></div><div class="x4">Print</div>', f"{LONG}\n{LONG}"),
    "toolbar and tags": (f'<ul class="toolbar">{LINKS}</ul><div class="entry"><h2>On</h2><p>{LONG} {LONG}</p></div><ul>{LINKS}</ul>', f"On\n{LONG} {LONG}"),
    "a role": (f'<div role="navigation">{LINKS}</div><div role="main"><p>{LONG}</p></div>', LONG),
    "masthead of links": (f'<div class="masthead"><a href=/>The Daily Paper of the Town</a></div><article><p>{LONG}</p></article><footer>{LONG}</footer>', LONG),
    "menu in the article's frame": (f'<div class="page"><ul class="main-menu">{LINKS}</ul><article><h1>T</h1><p>{LONG}</p><p>End.</p></article></div>', f"T\n{LONG}\nEnd."),
    "two columns": (f'<div class="left"><ul>{LINKS}</ul></div><div class="right"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
    # by structure
    "a list at the end": ("<div><h1>Tips</h1><p>Below, a list of things, which are good for you, and for others; read on.</p><ul><li>Eat</li><li>Sleep</li></ul></div>", "Tips\nBelow, a list of things, which are good for you, and for others; read on.\nEat\nSleep"),
    "sections of one frame": (f"<div><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Brief.</p></section></div><div>Print</div>", f"One\n{LONG}\nTwo\nBrief."),
    "words of the article in names": (f'<article><p>{LONG}</p><section class="comment-analysis"><p>On comments.</p></section><div class="cookie-recipe">Flour and milk.</div><div class="cookie-notice">No.</div><section id="reader-comments-newsletter">No.</section></article>', f"{LONG}\nOn comments.\nFlour and milk."),
    "a sidebar of many levels": (f'<article><p>{LONG}</p></article><div class="sidebar">{"<div>" * 600}{"</div>" * 600}<p>{LONG}</p></div>', LONG),
    "a sidebar with a long name": (f'<div class="{"x" * 9000} sidebar"><p>{LONG}</p></div><div><p>{LONG} End.</p></div>', f"{LONG} End."),
}


def test_framed_pages():
    for name, (page, want) in FRAMED.items():
        assert extract.main_text(page) == want, name


def test_without_the_ratios_texts_are_wrong(monkeypatch):
    """With every ratio set to 1 only priors and structure are left: over half of the hand-written pages, and given ones, change."""
    written, given = list((MIXED | FRAMED).values()), pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    right = [extract.main_text(p) for p in given]
    monkeypatch.setattr(extract, "ratios", lambda length, own, marks, count: (np.ones(len(length)), np.ones(len(length))))
    wrong = [extract.main_text(p) != want for p, want in written]
    print("wrong without ratios:", sum(wrong), "of", len(wrong), "and", sum(extract.main_text(p) != r for p, r in zip(given, right)), "of", len(given))
    assert len(written) >= 24 and 2 * sum(wrong) >= len(written)
    assert sum("<article" in p or "class=" in p or "<main" in p for p, _ in written) > len(written) / 2
    assert sum(extract.main_text(p) != r for p, r in zip(given, right)) > 0


def test_awkward_pages_take_time_in_proportion():
    import time

    n = 1_000_000
    pages = ["<a " * (n // 3), "<a title=\"" * (n // 10), "<p class='" * (n // 10), "<svg>" * (n // 5), "<script>" * (n // 8), "<!--" * (n // 4), "<" * n, "<div>" * (n // 5), "<div>" * 60_000 + "</p>" * 60_000 + "</ul>x" * 60_000, "<p><article>" + "<ul>" * 100_000 + "<h1>x" * 100_000, "&#" + "9" * n + ";", "</" * (n // 2), "<b>" * (n // 3), "<span class=ad>" * (n // 15), "<span class=ad></b>" * (n // 20), "<p>a" * (n // 4), "<div>" * (n // 10) + "x</div>" * (n // 10), "<article>" * (n // 20) + "<p>a. b" * (n // 20), "<ul><li>x" * (n // 10), "<div><p>a, b.</p><section>" * (n // 40), "<div>" * 500 + "<p>a" * (n // 5), "&" * n, "<a href='x" * (n // 10) + "'>"]
    for page in pages:
        start = time.time()
        extract.main_text(page)
        assert time.time() - start < 15, page[:20]


def test_odd_rows(spark):
    pages = [None, "", "<", "plain words", "<p>open <!-- never ends", '<a title="open>text</a>', "<article><p>x" + " y" * 50000, "</p></div>"]
    df = spark.createDataFrame([(None if i == 1 else i, None, p, 5) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract.extract(df, keep=("url",)).collect()}
    assert len(got) == len(pages) and got[0].text == "" and got[7].n_chars == 0
    assert got[3].text == "plain words" and got[4].text == "open" and got[6].n_chars == 100001
    assert extract.extract(df.limit(0)).count() == 0
