"""Main-text extraction from HTML by tree scoring.

A tolerant scan builds the tree. Paragraph-like elements earn points for length and commas and pass them to their
ancestors, the parent in full, the grandparent by half, three more by less; an element's points are discounted by its
link density. The element with most points is the container; an enclosing article or main element takes its place if
what else it holds reads like text; siblings that score or read like it are kept. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments go, by element or by the words of their class, id and role;
words that an article may be about go only beside words that say nothing else.
What a page itself names its main part wins over longer text beside it, and all sibling articles that read like text are kept.
Null and empty html give an empty text; very long and deeply nested pages take one linear pass; of elements with equal
points the first counts; repeated rows are extracted each by itself; an empty table gives no rows. Only the id, the url
and the html are read, so that other columns, of any name, change nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_NAME, _SPACE, _ATTRIBUTE, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"(=?[^\s/>=]*)(\s*=\s*)?", r"[^\s>]*"))
_COMMENT_END = re.compile(r"--!?>")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_READ = frozenset("class id role hidden aria-hidden style".split())

#: HTML's elements without content, those whose content is no markup, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text.
DROPPED = frozenset("nav footer aside form button select menu dialog svg canvas object audio video map head template fieldset label".split())
#: Elements whose start ends an open p, li, and so on; the search for the open one stops at these.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset("html body div article section main td th table ul ol dl blockquote aside nav header footer form fieldset".split())
_P_ENDS = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SCORED = frozenset("p pre blockquote td dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class, id or role that name parts of a page and nothing that an article could be about; they mark other things than main text wherever they stand (a star: starts of words).
UNLIKELY = """adbox adslot navbar topnav topbar masthead disqus contentinfo complementary lightbox taglist toolbar pager""".split()
#: Words that do so only by themselves, beside one another or beside plain words, as an article may be about them.
DOUBTFUL = """ad ads advert* alert* banner* breadcrumb* comment comments commenting consent cookie* copyright footer* form gdpr header* hidden login menu*
modal* nav navigation* newsletter* notice* notification* overlay* pagination popular popup* promo* rail recommend* related* replies reply
respond search* share* sharing side sidebar* signup skip social* sponsor* subscribe* subscription* tags trending widget*""".split()
#: Words that say nothing of what an element is about, but where or how it stands.
PLAIN = frozenset("""area bar block body bottom box button buttons center col column columns contained container content contents desktop fixed floating form global
group heading holder icon icons image info inner item items leaderboard left link links list lists main mega message mobile module msg nested outer page panel placement post posts primary
rectangle region right row secondary section sheet site skyscraper slot small space sticky text thread title toggle top trail unit wide wrap wrapper zone""".split())
#: Beside these, a header is the article's own.
OWN = frozenset("article entry hentry post story".split())
SIDES = frozenset("left right".split())
#: Ids that name the main part of a page, as the element and the role do.
MAIN = frozenset("main maincontent main-content main_content".split())
LIKELY = frozenset("article articlebody body content entry hentry main maincontent page post story text".split())


def _among(words: list[str]) -> Callable[[str], bool]:
    whole, starts = frozenset(w for w in words if w[-1] != "*"), tuple(w[:-1] for w in words if w[-1] == "*")
    return lambda part: part in whole or part.startswith(starts)


_unlikely, _doubtful = _among(UNLIKELY), _among(DOUBTFUL)


class Node:
    __slots__ = ("tag", "parent", "skip", "likely", "length", "links", "commas", "points", "comment", "main")

    def __init__(self, tag: str, parent: int, skip: bool, likely: bool, comment: bool, main: bool = False) -> None:
        self.tag, self.parent, self.skip, self.likely, self.comment, self.main = tag, parent, skip, likely, comment, main
        self.length = self.links = self.commas = 0
        self.points = 0.0


@lru_cache(maxsize=4096)
def _named(name: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role speaks for other things than main text, for main text, of reader comments."""
    parts = [p for p in re.split(r"[-_:]+", _HUMP.sub("-", name).lower()) if p]
    if any(map(_unlikely, parts)):
        return True, False, any(p == "disqus" or p.startswith(("comment", "respond", "repl")) for p in parts)
    doubt = [p for p in parts if _doubtful(p)]
    others = [p for p in parts if p not in doubt]
    if doubt == ["side"] and SIDES.intersection(others):  # one of two columns
        doubt = []
    if doubt and all(p in PLAIN or p.isdigit() or len(p) < 3 for p in others) and not (OWN.intersection(others) and all(p.startswith("header") for p in doubt)):
        return True, False, any(p.startswith(("comment", "respond", "repl")) for p in doubt)
    return False, not LIKELY.isdisjoint(parts), False


def _traits(tag: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether an element is to be dropped, whether its names speak for main text, whether they speak of reader comments."""
    skip, likely, comment = tag in DROPPED, tag in ("article", "main"), False
    for name, value in attributes.items():
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            skip = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                unlikely, speaks, of_comments = _named(word)
                skip, likely, comment = skip | unlikely, likely | speaks, comment | of_comments
    if tag in ("html", "body", "main") or tag == "article" and not comment:
        skip = False
    return skip, likely, comment


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag from `at` (after its name) on, the place after it, and whether it closes itself.

    A quote that is not closed, or by one that no space, slash or end of tag follows, while an end of tag stands between
    them, opens nothing: the tag ends there. last: the last place of each quote, so that no search goes to the end in vain.
    """
    found: dict[str, str] = {}
    n = len(page)
    while True:
        at = _SPACE.match(page, at).end()
        if at >= n:
            return found, n, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/"
        m = _ATTRIBUTE.match(page, at)
        name, at, value = m[1].lower(), m.end(), ""
        if m[2] is not None and at < n:
            if page[at] in "\"'":
                end = page.find(page[at], at + 1) if at < last[page[at]] else -1
                stop = page.find(">", at + 1, end if end >= 0 else n)
                if end < 0 or stop >= 0 and not (page[end + 1 : end + 2] in ("", "/", ">") or page[end + 1].isspace()):
                    if stop < 0:
                        return found, n, False
                    found.setdefault(name, page[at + 1 : stop])
                    return found, stop + 1, False
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        if name in _READ:
            found.setdefault(name, value)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes (each after its parent) and pieces of text by node; a piece "\n" stands where a block starts or ends.

    One pass: of the open elements, the places of each name and of those that bound a search are kept in lists, so that
    nothing is searched for on the stack.
    """
    nodes = [Node("", -1, False, False, False)]
    pieces: list[tuple[int, str]] = []
    stack, scopes = [0], [0]
    places: dict[str, list[int]] = {}
    last = {q: page.rfind(q) for q in "\"'"}
    at, said, n = 0, 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[nodes[stack.pop()].tag].pop()
        while scopes[-1] >= depth:
            scopes.pop()

    while True:
        at = page.find("<", at)
        kind = page[at + 1 : at + 2] if at >= 0 else ""
        if at >= 0 and not (kind in ("!", "?", "/") or kind.isascii() and kind.isalpha()):
            at += 1
            continue
        if (at if at >= 0 else n) > said:
            pieces.append((stack[-1], page[said : at if at >= 0 else n]))
        if at < 0:
            break
        if kind == "!" and page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                end = page.find(">", at + 4) + 1
            else:
                m = _COMMENT_END.search(page, at + 4)
                end = m.end() if m else n
        elif kind in ("!", "?"):
            mark = "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(mark, at)
            end = end + len(mark) if end >= 0 else n
        elif kind == "/":
            m = _NAME.match(page, at + 2)
            end = page.find(">", at) + 1 or n
            if m:
                tag = m[0].lower()
                depth = (places.get(tag) or [0])[-1]
                if depth and (tag in BLOCK or depth >= scopes[-1]):
                    close(depth)
                if tag in BLOCK:
                    pieces.append((stack[-1], "\n"))
        else:
            m = _NAME.match(page, at + 1)
            tag = m[0].lower()
            attributes, end, closed = ({}, m.end() + 1, False) if page[m.end() : m.end() + 1] == ">" else _attributes(page, m.end(), last)
            ends = _ENDS.get(tag, ()) + (("p",) if tag in _P_ENDS else ())
            depth = max(((places.get(t) or [0])[-1] for t in ends), default=0)
            if depth and depth >= scopes[-1]:
                close(depth)
            if tag in BLOCK:
                pieces.append((stack[-1], "\n"))
            if tag in RAW and not closed:
                m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, end)
                end = m.end() if m else n
            elif tag not in VOID and tag not in RAW:
                skip, likely, comment = _traits(tag, attributes)
                main = tag == "main" or attributes.get("role", "").lower() == "main" or attributes.get("id", "").lower() in MAIN
                nodes.append(Node(tag, stack[-1], skip or tag == "header", likely, comment, main))
                if not closed or tag in BLOCK:
                    places.setdefault(tag, []).append(len(stack))
                    if tag in _SCOPE:
                        scopes.append(len(stack))
                    stack.append(len(nodes) - 1)
        at = said = end
    return nodes, pieces


def _held(nodes: list[Node], pieces: list[tuple[int, str]]) -> list[bool]:
    """For each node whether it or an ancestor is dropped. A page header that is an article's own keeps the article's headings."""
    inside = [False] * len(nodes)
    article = [False] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        up = x.parent
        article[k] = article[up] or x.tag in ("article", "main")
        own = x.skip and not (x.tag == "header" and article[up])
        inside[k] = inside[up] or own
    return inside


def extract(page: str | None) -> str:
    """The main text: white space in a block is one space, blocks are joined by one space."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    if len(nodes) == 1 and not any(t.strip() for _, t in pieces):
        return ""
    dropped = _held(nodes, pieces)
    if not any(not dropped[k] and t.strip() for k, t in pieces):
        dropped = [False] * len(nodes)
        for k, x in enumerate(nodes[1:], 1):
            dropped[k] = dropped[x.parent] or x.comment or x.tag in ("nav", "footer", "aside")
    texts: list[tuple[int, str]] = []
    for k, t in pieces:
        if "&" in t:
            t = html.unescape(t)
        texts.append((k, t))
        if dropped[k]:
            continue
        size = len(t.strip())
        if size:
            x = nodes[k]
            x.length += size
            x.commas += t.count(",") + t.count("،") + t.count("、") + t.count("，")
    # Lengths, commas and link text go up; then points go from paragraphs to their ancestors.
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        if x.tag == "a":
            x.links = x.length
        if not dropped[k]:
            up = nodes[x.parent]
            up.length += x.length
            up.links += x.links
            up.commas += x.commas
    blocks_below = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        if x.tag in BLOCK or blocks_below[k]:
            blocks_below[x.parent] = True
    for k, x in enumerate(nodes):
        if not k or dropped[k] or x.length < 25 or not (x.tag in _SCORED or x.tag in ("div", "section", "li") and not blocks_below[k]):
            continue
        own = (1 + x.commas + min(x.length / 100, 3)) * (1 - x.links / x.length)
        up, share = x.parent, 1.0
        for level in range(5):
            if up < 0:
                break
            nodes[up].points += own * share
            share = 0.5 if level == 0 else 1 / (3 * (level + 1))
            up = nodes[up].parent
    score = lambda x: x.points * (1 - x.links / x.length if x.length else 0) * (1.25 if x.likely else 1)
    # Where the page names its main part, and that holds text that is no links, only what is in it can be the container, however short.
    named = [not dropped[k] and x.main and x.length > 2 * x.links for k, x in enumerate(nodes)]
    inside = [False] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        inside[k] = named[k] or inside[x.parent]
    may = inside if any(inside) else [True] * len(nodes)
    best, most = -1, 0.0
    for k, x in enumerate(nodes):
        if k and not dropped[k] and may[k] and (now := score(x)) > most:
            best, most = k, now
    if best < 0 and any(inside):
        best = max((k for k in range(len(nodes)) if named[k]), key=lambda k: nodes[k].length - nodes[k].links)
    if best < 0:  # no paragraph: what an article or main element holds, or all that is not dropped
        best = next((k for k, x in enumerate(nodes) if x.tag in ("article", "main") and not dropped[k] and x.length), 0)
    # An article or main element around the best one takes its place if what else it holds reads like text too: half of it
    # is no links, and for a main element, which may hold anything, if paragraphs gave it a fifth of the best one's points.
    up, own = best, nodes[best]
    while up > 0:
        x = nodes[up]
        more, links = x.length - own.length, x.links - own.links
        if x.tag in ("article", "main") and not dropped[up] and links <= more / 2 and (x.tag == "article" or up == best or score(x) >= 0.2 * most):
            best = up
            if x.tag == "article":
                break
        up = x.parent
    chosen = {best}
    if best > 0 and nodes[best].tag not in ("body", "html"):
        least = max(10.0, 0.2 * most)
        parent = nodes[best].parent
        for k, x in enumerate(nodes):
            if k and x.parent == parent and k != best and may[k] and not dropped[k] and x.tag not in ("a", "span"):
                density = x.links / x.length if x.length else 1.0
                if score(x) >= least or x.tag == "article" == nodes[best].tag and score(x) > 0 and density <= 0.5 or x.tag == "p" and (x.length > 80 and density < 0.25 or 0 < x.length <= 80 and not x.links) or x.tag in _HEADINGS and not x.links and nodes[best].tag != "article":
                    chosen.add(k)
    kept = [False] * len(nodes)
    for k, x in enumerate(nodes):
        kept[k] = not dropped[k] and (k in chosen or (k > 0 and kept[x.parent]))
    # A block of dropped or foreign text still parts what stands around it.
    return " ".join("".join(t if kept[k] else " " if t == "\n" else "" for k, t in texts).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars) of every page; no shuffle."""
    small_batches(pages.sparkSession)
    of_id = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    found = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return found.mapInArrow(run, f"id {of_id}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
