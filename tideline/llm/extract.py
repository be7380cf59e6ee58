"""HTML extraction by tag-path ratios.

A page is read in one forward scan as elements and text. Structural elements make a path from the root to each block of
text; inline markup does not. For each path of a page the text length (that of links counts little) and the punctuation
of its blocks are added up and divided by the number of its blocks and tags. Both ratios are smoothed along the page's
order of paths, multiplied by a prior for where the path stands, and fused; the paths at or over a share of the page's best
are content.

Priors are weak where the ratios can tell. A frame of links (a menu, breadcrumbs, sharing, related posts) gets half of the
best prior however it is named: its links tell what it is. An article or main element is a few times likelier than no frame.
Only where prose stands in a frame of another purpose (footers, sidebars, notices, adverts, forms, readers' comments) do
element, role or class name speak strongly, since such prose has the ratios of prose. Names alone drop nothing: a page whose
whole text stands in a frame of a bad name keeps it, and a page without any names is cut by its ratios.

Beside the blocks of such paths stay, unless a name speaks against them: blocks of the same article element; blocks
between the first and the last content block of one element, so short items, linked references and the like; lists, tables,
quotations and sections, if not mostly links, in an element that has content; and headings directly before a block that
stays. Scripts, styles, controls, frames and hidden elements have no text at all.

Defined results: null, empty and text-free pages give an empty text; tags that are not closed or not opened, comments
that do not end and quotes that do not close are read as browsers do, roughly; elements nest and attributes are as long as
they are; repeated rows each give a row; pages are read whole, in time proportional to their length; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import runtime

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")

#: Elements without text of the page; the first ones hold characters only, whatever these look like.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
SKIPPED = frozenset("template svg math object canvas select datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog menu center hgroup search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are no article text by their kind.
BESIDE = frozenset("head nav header footer aside form dialog menu button search".split())
#: A start tag closes an open element of these kinds if none of the limits stands between.
CLOSES = {
    **{t: ({"p"}, {"article", "section", "div", "body", "td", "th", "li", "blockquote"}) for t in BLOCK - {"html", "body", "head"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "body": ({"head"}, set()),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names and roles of frames of links.
LINK_FRAMES = frozenset("nav navbar navigation menu menus menubar toolbar search breadcrumb breadcrumbs pagination pager header masthead share sharing social related recommended recommendations widget widgets skip more".split())
#: What an element that has content may have beside it: its text goes by the element that they stand in.
WITHIN = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption section details summary".split())
#: A class name or id with one of these words marks what is no article text.
MARKS = frozenset("advert adverts advertisement advertisements advertising adsense adslot sponsored sponsors navbar breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr popup modal newsletter subscribe subscription signup comment comments commentlist disqus pagination".split())
#: These do so only if all other words of the name are among COMPANIONS: "related-posts" does, "related-work" does not.
WEAK_MARKS = frozenset("ad ads adv sponsor promo promos promoted promotion banner banners nav navigation menu menus header masthead footer aside notice notices overlay share sharing social related recommended recommendations reply replies respond responses widget widgets toolbar login search pager copyright disclaimer alert alerts skip".split())
COMPANIONS = frozenset("top bottom left right main site page global primary secondary side inner outer upper lower box bar block area section container wrapper wrap holder panel module unit slot item items list link links button buttons icon icons content body text title post posts article articles story stories entry entries news more to the and of us our for by form inline mini big small top-level bg col column row grid group region zone frame layer header footer nav menu".split())
#: An article element is marked only as a reader's comment or an advert.
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo promoted comment comments reply replies".split())
HIDING = frozenset("hidden visually-hidden visuallyhidden sr-only screen-reader-text".split())
#: Names that say what a page's frame has beside the article.
LAYOUT = re.compile(r"\b(?:has|with|without|no|left|right|two|one)[-_ ]+[a-z]+\b")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
#: Priors of a path in an article, in a main element, and of prose where a name or kind speaks against it; a frame of links
#: has a share of the page's best prior.
ARTICLE, MAIN, BESIDE_IT, LINKED_IT = 8.0, 3.0, 0.02, 0.5
#: The weight of link text, and the share of the page's best at which a path is content.
LINK, SHARE = 0.02, 0.25


class Element:
    """An open element: its structural parent, kind, path, prior class (0 none, 1 main, 2 article), and marks that it has or inherits.

    beside: 0, 1 for a frame of links, 2 for prose that is beside the article. at: place on the stack. article: the outermost
    one it stands in. frame: the innermost element around it, or itself, that is not of the kinds WITHIN.
    """

    __slots__ = ("parent", "tag", "path", "inside", "beside", "hidden", "at", "article", "frame")

    def __init__(self, parent: Element | None, tag: str, path: int, inside: int, beside: int, hidden: bool, at: int):
        self.parent, self.tag, self.path, self.inside, self.beside, self.hidden, self.at = parent, tag, path, inside, beside, hidden, at
        self.article = (parent.article if parent else None) or (self if inside == 2 else None)
        self.frame = parent.frame if parent and tag in WITHIN else self


class Block(NamedTuple):
    """A block's element, whether a name or kind speaks against it, its text, characters in links, and inline tags."""

    element: Element
    beside: int
    text: str
    links: int
    tags: int


def plain(raw: str) -> str:
    """Character references decoded; a number of thousands of digits is no character."""
    if "&" not in raw:
        return raw
    try:
        return html.unescape(raw)
    except ValueError:
        return html.unescape(re.sub(r"&#[0-9]{9,}", "&#1114112", raw))


def _words(names: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()) if w]


def _marked(tag: str, at: dict[str, str], inside: int) -> int:
    """What element, role and names say: 0 nothing, 1 a frame of links, 2 prose beside the article.

    Within an article a name that holds one of the words says so only if its other words do not speak of something else.
    """
    role = at.get("role", "").lower()
    if tag in BESIDE or role in ROLES:
        return 1 if tag in LINK_FRAMES or role in LINK_FRAMES else 2
    if tag in ("html", "body", "main"):
        return 0
    found = 0
    for name in LAYOUT.sub(" ", f"{at.get('class', '')} {at.get('id', '')}").split():
        words = _words(name)
        if tag == "article":
            marks = [w for w in words if w in ARTICLE_MARKS]
        else:
            marks = [w for w in words if w in MARKS]
            if not marks or inside == 2:
                marks += [w for w in words if w in WEAK_MARKS]
                if len([w for w in words if w in MARKS]) < 2 and not all(w in MARKS or w in WEAK_MARKS or w in COMPANIONS for w in words):
                    marks = []
        if marks:
            found = max(found, 1 if all(w in LINK_FRAMES for w in marks) else 2)
    return found


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower() or not HIDING.isdisjoint(at.get("class", "").lower().split())


class Reader:
    """One forward scan of a page; what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1; a miss is remembered."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def after_end_tag(self, tag: str, at: int) -> int:
        """Where the tag's next end tag ends, or -1."""
        key = f"</{tag}"
        if key in self.missing:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(self.page, at)
        if m is None:
            self.missing.add(key)
            return -1
        end = self.find(">", m.end())
        return len(self.page) if end < 0 else end + 1

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes of a tag from behind its name, whether it ends in a slash, and where it ends."""
        page, found, slash = self.page, {}, False
        while True:
            m = ATTRIBUTE.match(page, at)
            if m is None:
                end = self.find(">", at)
                return found, page[end - 1 : end] == "/", len(page) if end < 0 else end + 1
            name, at = m[1].lower(), m.end()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                close = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    m = UNQUOTED.match(page, at)
                    value, at = m[0].strip("\"'"), m.end()
            found.setdefault(name, plain(value))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; all but what is hidden or no text."""
    out: list[Block] = []
    reader, paths = Reader(page), {}
    root = Element(None, "", 0, 0, 0, False, 0)
    stack: list[Element] = [root]  # structural elements, and inline ones that are marked or hidden
    places: dict[str, list[int]] = {}  # of the open elements of a kind on the stack
    here = root  # the innermost structural element
    text: list[str] = []
    aside: list[str] = []  # text of marked inline elements within the block
    links = tags = linked = 0

    def flush() -> None:
        nonlocal text, aside, links, tags
        if text or aside:
            for parts, beside in ((text, here.beside), (aside, 2)):
                whole = " ".join("".join(parts).split())
                if whole and not here.hidden:
                    out.append(Block(here, beside, whole, min(links, len(whole)), tags))
        text, aside, links, tags = [], [], 0, 0

    def add(raw: str) -> None:
        nonlocal links
        top = stack[-1]
        if raw and not top.hidden:
            words = plain(raw)
            (aside if top.beside and not here.beside else text).append(words)
            if linked:
                links += len(words.strip())

    def cut(n: int) -> None:
        nonlocal here
        for e in stack[n:]:
            places[e.tag].pop()
        del stack[n:]
        here = stack[-1] if stack[-1].tag in BLOCK or stack[-1] is root else stack[-1].parent

    def opened(e: Element) -> None:
        stack.append(e)
        places.setdefault(e.tag, []).append(e.at)

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        second = page[start + 1 : start + 2]
        closing = second == "/"
        m = NAME.match(page, start + 1 + closing)
        if m is None:
            if second == "!" and page.startswith("--", start + 2):
                end = reader.find("-->", start + 2)
                at = size if end < 0 else end + 3
            elif second in ("!", "?", "/") and second:
                end = reader.find(">", start + 1)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        tag = m[0].lower()
        known, slash, at = reader.attributes(m.end())
        if tag in RAW or tag in SKIPPED:
            if not closing and not (slash and tag in ("svg", "math")):
                end = reader.after_end_tag(tag, at)
                at = end if end >= 0 else size if tag in RAW else at
            continue
        if tag not in BLOCK:
            tags += 1
            if tag == "br":
                (aside if stack[-1].beside and not here.beside else text).append(" ")
            elif tag == "a":
                linked = not closing
            if closing:
                if places.get(tag) and here.at <= places[tag][-1]:
                    cut(places[tag][-1])
            elif tag not in VOID:
                hidden, beside = bool(known) and _hidden(known), _marked(tag, known, here.inside) if known or tag in BESIDE else 0
                if hidden or beside or places.get(tag):  # one of a kind that is open is counted, so that end tags fit
                    top = stack[-1]
                    opened(Element(here, tag, here.path, here.inside, max(top.beside, beside), top.hidden or hidden, len(stack)))
            continue
        flush()
        linked = 0
        if closing:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        close, limits = CLOSES.get(tag, ((), ()))
        if any(places.get(t) for t in close):
            bar = max((places[t][-1] for t in limits if places.get(t)), default=0)  # an element that is both ends at itself
            above = [places[t][bisect(places[t], bar)] for t in close if places.get(t) and places[t][-1] > bar]
            if above:
                cut(min(above))
        if tag in ("html", "body") and places.get(tag):
            continue
        inside = 2 if tag == "article" or known.get("itemprop") == "articleBody" else 1 if tag == "main" or known.get("role", "").lower() == "main" else 0
        top, names = stack[-1], " ".join(_words(f"{known.get('class', '')} {known.get('id', '')}"))
        beside = _marked(tag, known, top.inside) if tag != "header" or top.inside < 2 else 0
        label = (top.path, tag, names if tag not in ("p", "li", "tr", "td") else "")
        here = Element(here, tag, paths.setdefault(label, len(paths) + 1), max(top.inside, inside), max(top.beside, beside), top.hidden or _hidden(known), len(stack))
        opened(here)
    flush()
    return out


def ratios(length: np.ndarray, own: np.ndarray, marks: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and punctuation by path: what is no link, for each block and tag."""
    return own * length / count, own * marks / count


def content(found: list[Block], share: float = SHARE) -> list[str]:
    """The texts of the blocks that are content, in page order."""
    if not found:
        return []
    keys = [(b.element.path, b.element.inside, b.beside) for b in found]
    order = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    of = np.array([order[k] for k in keys])
    add = lambda values: np.bincount(of, np.array(values, float), len(order))
    length, linked = add([len(b.text) for b in found]), add([b.links for b in found])
    marks, count = add([len(PUNCTUATION.findall(b.text)) for b in found]), add([1 + 0.25 * b.tags for b in found])
    text, punctuation = ratios(length, np.maximum(1 - linked / length, LINK), marks, count)
    place = np.array([(1.0, MAIN, ARTICLE)[inside] for _, inside, _ in order])
    level = np.array([beside for _, _, beside in order])
    best = place[level == 0].max(initial=1.0)
    prior = np.where(level == 0, place, np.where((level == 1) & (linked > length / 2), LINKED_IT * best, BESIDE_IT * place))
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), np.array([0.05, 0.9, 0.05]), "valid")
    fused = prior * smooth(text) * np.sqrt(1 + smooth(punctuation))
    stays = (fused >= share * fused.max())[of]
    _beside_content(found, stays)
    return [b.text for b, s in zip(found, stays) if s]


def _beside_content(found: list[Block], stays: np.ndarray) -> None:
    """Marks in stays what goes with the content: see the module's fourth paragraph.

    What stands between two blocks of one element is within that element, so its descendants need not be looked for.
    """
    first: dict[Element | None, int] = {}
    last: dict[Element | None, int] = {}
    articles, frames = set(), set()
    for i in np.flatnonzero(stays).tolist():
        e = found[i].element
        first.setdefault(e.parent, i)
        last[e.parent] = i
        articles.add(e.article)
        if e.parent is not None and (e.parent.tag == "section" or e.parent.tag not in WITHIN):
            frames.add(e.parent.frame)
    articles.discard(None)
    between = np.zeros(len(found) + 1, np.int64)
    for holder, i in first.items():
        between[i] += 1
        between[last[holder]] -= 1
    between = np.cumsum(between) > 0
    for i in np.flatnonzero(~stays).tolist():
        b, e = found[i], found[i].element
        within = e if e.tag in WITHIN else e.parent if e.parent is not None and e.parent.tag in WITHIN else None
        if not b.beside and (e.article in articles or between[i] or within is not None and within.frame in frames and 2 * b.links < len(b.text)):
            stays[i] = True
    for i in range(len(found) - 2, -1, -1):
        if stays[i + 1] and not found[i].beside and found[i].element.tag in HEADINGS:
            stays[i] = True


def main_text(page: str) -> str:
    return "\n".join(content(blocks(page)))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id column, the columns of keep, text, n_chars, n_blocks."""

    def kernel(pages: list[bytes]) -> dict[str, list]:
        texts = [content(blocks(p.decode())) for p in pages]
        whole = ["\n".join(t) for t in texts]
        return {"text": whole, "n_chars": [len(t) for t in whole], "n_blocks": [len(t) for t in texts]}

    return runtime.map_rows(df, [id_col, *keep], html_col, kernel, "text string, n_chars long, n_blocks long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return extract(runtime.table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=("url",)).select("page_id", "url", "text", "n_chars", "n_blocks")
