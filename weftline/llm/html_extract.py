"""Main text of web pages by tree scoring.

Every text block passes points for its length and its commas to its ancestors, all of them to the parent,
half to the grandparent, a sixth and then ever less further up. A container's points are discounted by the share of its
text that is inside links; the best container wins, widened to the article around it, and siblings with a
fair share of its points, headings and link-free paragraphs beside it are kept with it. Elements that are never main text
(menus, headers, footers, forms, scripts, styles, hidden parts) are not entered at all. A class or id that names such a part
(a sidebar, an advert, comments) halves its element's score; if nothing else stands in the name, the element goes, unless it holds
over half of the page's points.

Pages are independent, so this is one pass without a shuffle: Arrow batches in, Arrow batches out; the work
per page is one scan of its tags and a tree of its blocks, whose points are added up from the last node to the first, so
that neither deep trees nor tags that never end cost more than their length.

Defined results: null and empty pages give an empty text; pages with no scoring block but some text keep that
text; repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
DELIMITER = re.compile("[>\"']")
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas xmp".split())
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header"
    " hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head button label option".split()
)
NEVER = frozenset("head nav footer aside form menu dialog button label fieldset option search dir".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in a class or id that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar sidenav aside nav navbar navigation menu topbar breadcrumb breadcrumbs footer footnav header masthead comment comments commentlist disqus respond replies reply share sharing social"
    " related recommended newsletter subscribe subscription signup login widget pagination pager toolbar skip tags".split()
)
#: Words beside a mark that say where or what form it is; before it, only PLACE.
PLACE = frozenset("site main global left right top bottom primary secondary sticky fixed".split())
FORM = PLACE | frozenset("area bar block body box button buttons container content footer form group header icons inner item items links list outer panel row section slot title unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[a-z]+")


#: Elements that end an open one of their kind, up to the elements that hold them.
KINDS = (("li", "ul ol menu"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "table"), ("option", "datalist"))
SAME = {name: k for k, (same, _) in enumerate(KINDS) for name in same.split()}
SCOPES = {name: [k for k, (same, stops) in enumerate(KINDS) if name in f"{same} {stops}".split()] for same, stops in KINDS for name in f"{same} {stops}".split()}


class Node:
    __slots__ = ("name", "parent", "drop", "mark", "inside", "near", "own", "children", "deeper", "chars", "link_chars", "held", "gone", "seen", "within", "top")

    def __init__(self, name: str, parent: Node | None, drop: bool, mark: int = 0):
        self.name, self.parent, self.drop, self.mark = name, parent, drop, mark
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        near = parent.near if parent else (None,) * len(KINDS)  # the nearest element of each kind
        if name in SCOPES:
            near = tuple(self if k in SCOPES[name] else x for k, x in enumerate(near))
        self.near = near
        self.own = self.children = self.deeper = self.held = 0.0
        self.chars = self.link_chars = 0
        self.gone = self.seen = self.within = False
        self.top: Node | None = None

    @property
    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    @property
    def score(self) -> float:
        return (self.own + self.children / 2 + self.deeper / 6) * (1 - self.density) * (0.5 if self.mark else 1)


class Tags:
    """Ends of tags. What has once been searched in vain is not searched again, so a page costs time in proportion to its length."""

    def __init__(self, page: str):
        self.page, self.places = page, [m.start() for m in DELIMITER.finditer(page)]
        self.last = page.rfind(">")
        self.vain: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at ``at``, -1 if there is none. A quote counts after = only."""
        page, tried = self.page, []
        while (k := bisect_left(self.places, at)) < len(self.places):
            d = self.places[k]
            if page[d] == ">":
                return d
            if d in self.vain:
                break
            tried.append(d)
            before = d - 1
            while page[before].isspace():
                before -= 1
            at = page.find(page[d], d + 1) + 1 if page[before] == "=" else d + 1
            if not at:
                break
        self.vain.update(tried)
        return -1

    def next(self, at: int) -> int:
        return self.page.find(">", at) if at <= self.last else -1


def _never(name: str, attrs: str, inside_article: bool) -> bool:
    if name in NEVER or name == "header" and not inside_article:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _mark(name: str, attrs: str) -> int:
    """2 if a token of the class or id is a mark and nothing else, 1 if one begins with a mark, else 0."""
    if not attrs or "=" not in attrs or name in ("html", "body", "article", "main"):
        return 0
    out = 0
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = WORD.findall(token)
                while len(words) > 1 and words[0] in PLACE:
                    words = words[1:]
                if words and words[0] in MARKS:
                    out = max(out, 2 if all(w in MARKS or w in FORM for w in words) else 1)
    return out


def _blocks(page: str) -> tuple[list[Node], list[tuple[str, Node, int]]]:
    """The nodes, each after its parent, and (text, innermost node, characters in links) of every block in page order, dropped parts left out."""
    root = Node("#", None, False)
    nodes, node, out, parts, linked, links = [root], root, [], [], 0, 0
    opened: Counter = Counter()  # open nodes by name
    skip: list[str] = []  # inline elements that are not main text
    first: dict[str, int] = {}  # where each of their names stands first
    tags = Tags(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, node, min(linked, len(text))))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not node.drop and not skip:
            parts.append(text)
            if links:
                linked += len(text.strip())

    def leave(until: Node) -> None:
        nonlocal node
        while node is not until:
            opened[node.name] -= 1
            node = node.parent

    said = look = 0
    while (lt := page.find("<", look)) >= 0:
        closing, m = page.startswith("/", lt + 1), None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = end + 2 if end >= 0 else len(page) - 1
        elif m := NAME.match(page, lt + 1 + closing):
            end = tags.end(m.end())
            if end < 0 and closing:
                end = tags.next(m.end())
        else:
            end = tags.next(lt + 2) if page[lt + 1 : lt + 2] in ("!", "?", "/") else -1
        if end < 0:
            look = lt + 1
            continue
        say(page[said:lt])
        said = look = end + 1
        if not m:
            continue
        name, attrs = m[0].lower(), page[m.end() : end]
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                if opened[name] > 0:
                    flush()
                    up = node
                    while up.name != name:
                        up = up.parent
                    leave(up.parent)
                    links = 0
                    skip.clear()
                    first.clear()
            elif name in first:
                k = first[name]
                for x in skip[k:]:
                    if first.get(x, -1) >= k:
                        del first[x]
                del skip[k:]
        elif name in RAW:
            if not attrs.endswith("/"):
                ended = RAW_END[name].search(page, end + 1)
                said = look = ended.end() if ended else len(page)
        elif name == "a":
            links += 1
        elif name == "br":
            say(" ")
        elif name in BLOCK:
            flush()
            links = 0
            if name == "hr":
                continue
            if node.name == "p" or node.name in HEADINGS and name in HEADINGS:
                leave(node.parent)
            if name in SAME:
                near = node.near[SAME[name]]
                if near is not None and SAME.get(near.name) == SAME[name]:
                    leave(near.parent)
            node = Node(name, node, node.drop or _never(name, attrs, node.inside), _mark(name, attrs))
            nodes.append(node)
            opened[name] += 1
            skip.clear()
            first.clear()
        elif name not in VOID and (skip or _never(name, attrs, True) or _mark(name, attrs) == 2):
            first.setdefault(name, len(skip))
            skip.append(name)
    say(page[said:])
    flush()
    return nodes, out


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def main_text(page: str | None) -> str:
    nodes, blocks = _blocks(page or "")
    total = 0.0
    for text, node, linked in blocks:
        points = _points(text, linked)
        node.held += points
        total += points
    for node in reversed(nodes[1:]):
        node.parent.held += node.held
    for node in nodes:  # marked elements that hold at most half of the page's points
        node.gone = node.parent is not None and node.parent.gone or node.mark == 2 and 2 * node.held <= total
    blocks = [b for b in blocks if not b[1].gone]
    if not blocks:
        return ""
    for text, node, linked in blocks:
        holder = node.parent if node.name == "p" or node.name in HEADINGS or node.name == "pre" else node
        holder.own += _points(text, linked)
        holder.seen = True
        node.chars, node.link_chars = node.chars + len(text), node.link_chars + linked
    for node in reversed(nodes[1:]):
        up = node.parent
        up.children += node.own
        up.deeper += node.children + node.deeper * 2 / 3
        up.chars, up.link_chars, up.seen = up.chars + node.chars, up.link_chars + node.link_chars, up.seen or node.seen
    best = max((n for n in nodes if n.seen), key=lambda n: n.score)  # the first of equals
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    best = up or best
    least = max(10.0, 0.2 * best.score)
    for node in nodes:
        up = node.parent
        node.within = node is best or up is not None and up.within
        node.top = node if best.parent is not None and best.parent in (node, up) else up and up.top

    def kept(text: str, node: Node, linked: int) -> bool:
        if node.within:
            return True
        top = node.top
        if top is None:
            return False
        if top is node and (node.name == "p" or node.name in HEADINGS) and linked * 4 <= len(text) and best.name != "body":
            return True
        return top.seen and top.score >= least and top.density < 0.25

    return "\n".join(text for text, node, linked in blocks if kept(text, node, linked))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
