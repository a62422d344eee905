"""Main text of web pages by composite text density.

A node of the page tree has a density: its characters per tag, where characters and tags inside links
count against it. The sum over a node's children is large where many dense blocks stand side by side,
so the subtree with the largest sum is the article. The least density on the way from it up to the body
is the threshold: blocks elsewhere that reach it widen the subtree to the wrapper of them all, and
parts that lie below it, and that are mostly links, are left out, as are elements that never hold an article's text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments, by element name or role, or by a class or id all of whose words
name such a part). A form or a class or id of that kind says little where it wraps the page: such a mark goes if most of
the text, or the only article, is inside.

Everything happens within a row; memory is one Arrow batch and one page's tree.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.DOTALL)
#: One attribute of a start tag; quotes have a meaning only where a value begins.
_ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
#: Elements whose content is text, not markup, up to their end tag.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "meter", "nobr", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "img",
}
_NEVER = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "input",
    "textarea", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "dialog", "menu", "title", "fieldset", "datalist",
}
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: What the parts of a page are called that are not its article: menus, headers, footers, sidebars, notices, adverts, forms, comments.
_KINDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "notices",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising",
    "adsense", "banner", "sponsored", "promo", "form", "newsletter", "signup", "login", "search", "comment", "comments", "commentlist", "disqus",
}
#: What may stand beside such a word in a name without making it the name of something else.
_FILLERS = {
    "site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "list", "section", "area", "wrap", "wrapper",
    "box", "container", "bar", "block", "slot", "unit", "links", "item", "items", "inner", "outer", "widget", "user", "users", "reader", "readers",
    "mobile", "desktop", "sticky", "fixed", "google", "js", "id", "policy",
}
#: The same for all kinds but headers, which hold the title there.
_OF_ARTICLES = {"post", "entry", "article", "blog", "story"}
_HEADERS = {"header", "masthead", "banner"}
#: Elements that may as well wrap a whole page, and words that never name such a wrapper.
_WRAPPERS = {"form", "fieldset"}
_NEVER_WRAPPERS = {
    "comment", "comments", "commentlist", "disqus", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "ad", "ads", "advert",
    "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsored", "promo",
}
#: Share of the unlinked text of a page that is most of it, and share below which articles in sight are teasers.
_MOST, _TEASER = 0.75, 0.1
#: A start tag of one of these ends open elements of the second set, up to one of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("name", "never", "wraps", "children", "parent", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, never: bool, parent: Node | None, wraps: bool = False) -> None:
        self.name, self.never, self.parent, self.wraps = name, never, parent, wraps  # wraps: never, unless it wraps the page
        self.children: list[Node | str] = []
        self.depth: int = 0 if parent is None else parent.depth + 1


class _Open:
    """Open elements, found by name without a walk."""

    def __init__(self, root: Node) -> None:
        self.at, self.named, self.blocks = root, {"": [root]}, [root]

    def push(self, node: Node) -> None:
        self.at = node
        self.named.setdefault(node.name, []).append(node)
        if node.name not in _INLINE:
            self.blocks.append(node)

    def close(self, node: Node) -> None:
        """Ends ``node``, which is open, and all in it."""
        while True:
            ended = self.at
            self.named[ended.name].pop()
            if ended.name not in _INLINE:
                self.blocks.pop()
            self.at = ended.parent
            if ended is node:
                return

    def last(self, name: str) -> Node | None:
        found = self.named.get(name)
        return found[-1] if found else None


def _attributes(page: str, pos: int) -> tuple[dict[str, str], int]:
    """Attributes of a start tag, the first of a name counting, and the place after its end."""
    found: dict[str, str] = {}
    if page[pos : pos + 1] == ">":
        return found, pos + 1
    while pos < len(page):
        m = _ATTRIBUTE.match(page, pos)
        pos = max(m.end(), pos + 1) if m.end() == pos and page[pos : pos + 1] != ">" else m.end()
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if page[pos : pos + 1] == ">":
            return found, pos + 1
    return found, len(page)


def _kind(name: str) -> str | None:
    """The kind that a class or id names, if all its words speak of that."""
    words = [w.lower() for w in _WORDS.findall(name)]
    kinds = [w for w in words if w in _KINDS]
    others = _FILLERS if not kinds or kinds[-1] in _HEADERS else _FILLERS | _OF_ARTICLES
    return kinds[-1] if kinds and all(w in _KINDS or w in others for w in words) else None


def _is_never(name: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether that is undone where it wraps the page."""
    if name in _NEVER and name not in _WRAPPERS:
        return True, False
    # A header inside an article holds its title; elsewhere it is the page's.
    if name == "header":
        return not in_article, False
    never = name in _WRAPPERS or attributes.get("role", "").strip().lower() == "form"
    if not attributes or name in ("html", "body"):
        return never, never
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return True, False
    if name in ("article", "main"):
        return never, never
    if attributes.get("role", "").strip().lower() in _NEVER_ROLES:
        return True, False
    for one in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        if kind := _kind(one):
            if in_article and kind in _HEADERS:
                continue
            never = True
            if kind in _NEVER_WRAPPERS:
                return True, False
    return never, never


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misnested elements end with whatever closes around them. Linear in the page."""
    root = Node("", False, None)
    open_, pos = _Open(root), 0
    while pos < len(page):
        m = _PART.match(page, pos)
        pos = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if not piece.startswith("<") or piece == "<":
                open_.at.children.append(html.unescape(piece))
            elif piece.startswith("<![CDATA["):
                open_.at.children.append(piece[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        attributes, pos = _attributes(page, pos)
        if m.group(1):
            if (ended := open_.last(name)) is not None:
                open_.close(ended)
            continue
        if name in _VOID:
            open_.at.children.append(Node(name, name == "input", open_.at))
            continue
        if name in ("html", "body") and open_.last(name) is not None:
            continue
        _close_before(name, open_)
        in_article = bool(open_.last("article") or open_.last("main"))
        never, wraps = _is_never(name, attributes, in_article)
        node = Node(name, never, open_.at, wraps)
        open_.at.children.append(node)
        if name in _RAW:
            end = re.compile(rf"</{name}(?![^\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if not ("/" == page[pos - 2 : pos - 1] and name in ("svg", "path")):
            open_.push(node)
    _unmark(root)
    return root


def _unmark(root: Node) -> None:
    """Clears the marks of elements that wrap the page: its ``main``, its article, or most of its unlinked text.

    Articles in sight are the page's, unless they hold next to nothing of it.
    """
    stack, text = [(root, False, False)], {}
    order, wrappers, articles = [], [], []
    while stack:
        node, linked, within = stack.pop()
        order.append(node)
        linked, within = linked or node.name == "a", within or node.never
        text[node] = 0 if linked else sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str) and c.strip())
        if node.never:
            wrappers.append(node)
        if node.name in ("article", "main"):
            articles.append((node, within))
        stack += [(c, linked, within) for c in node.children if not isinstance(c, str) and (not c.never or c.wraps)]
    for node, _ in articles:
        if node.name == "main":
            for up in _path(node):
                up.never = False
            break
    if not wrappers:
        return
    for node in reversed(order):
        if node is not root:
            text[node.parent] += text[node]
    articles = [(n, within) for n, within in articles if text[n]]
    in_sight = sum(text[n] for n, within in articles if not within)
    if in_sight and in_sight >= _TEASER * text[root]:
        return
    if articles and not in_sight:
        for up in _path(max((n for n, _ in articles), key=text.get)):
            up.never = False
    for node in wrappers:
        if text[node] >= _MOST * text[root] > 0:
            node.never = False


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _close_before(name: str, open_: _Open) -> None:
    """A new element ends an open paragraph, list item or cell that it can't be part of."""
    if name == "body":
        if (head := open_.last("head")) is not None:
            open_.close(head)
    elif name in _CLOSES:
        ends, walls = _CLOSES[name]
        wall = max((n.depth for w in walls if (n := open_.last(w)) is not None), default=0)
        ended = [found for e in ends if (nodes := open_.named.get(e)) for found in nodes[bisect.bisect_right(nodes, wall, key=_depth) :][:1]]
        if ended:
            open_.close(min(ended, key=_depth))
    elif name not in _INLINE and open_.blocks[-1].name == "p":
        open_.close(open_.blocks[-1])


def _depth(node: Node) -> int:
    return node.depth


def _measure(root: Node) -> list[Node]:
    """Fills in counts; returns all nodes, children after parents."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        linked = linked or node.name == "a"
        for child in node.children:
            if isinstance(child, str):
                n = len(child) - child.count(" ") if child.strip() else 0
                node.chars += n
                node.link_chars += n if linked else 0
            elif not child.never:
                stack.append((child, linked))
    for node in reversed(order):
        if node.parent is not None and node is not root:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.name == "a")
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node in order:
        node.density = _density(node, body_links / body_chars)
    for node in order:
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.never) + _own(node)
    return order


def _density(node: Node, linked_share: float) -> float:
    """Characters per tag, lowered by the share of linked characters and tags."""
    c, t = node.chars, max(1, node.tags)
    if not c:
        return 0.0
    lc, lt = max(1, node.link_chars), max(1, node.link_tags)
    base = math.log(c / max(1, c - node.link_chars) * node.link_chars + linked_share * c + math.e)
    return c / t * math.log(c / lc * t / lt + 1.0) / math.log(base + 1.0)  # plus one: never below or by zero


def _own(node: Node) -> float:
    """Text that stands in the node itself counts as one child."""
    own = sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str) and c.strip())
    return float(own) if node.name != "a" else 0.0


def _main(root: Node) -> tuple[Node, float]:
    """The subtree with the largest density sum and the least density on its way up to the body."""
    order = _measure(root)
    marked = [n for n in order if n.name in ("article", "main") and n.chars]
    candidates = [n for n in order if n.name not in _INLINE and n.chars]
    if not candidates:
        return root, 0.0
    best = max(candidates, key=lambda n: (n.total, -n.tags))
    # The sum peaks at the node whose children are the blocks; one that is marked as the article, or the
    # wrapper of all blocks that reach the threshold, is that node's better boundary.
    if inside := [up for up in _path(best) if up in marked]:
        return inside[-1], min(n.density for n in _to_body(inside[-1]))
    path = _to_body(best)
    threshold = min(n.density for n in path)
    places = {id(n): i for i, n in enumerate(path)}
    widest = 0
    for n in order:
        # Where the way up from here meets the path.
        place = places.setdefault(id(n), places.get(id(n.parent), 0))
        if place > widest and (_own(n) >= threshold if n is path[place] else _is_dense(n, threshold)):
            widest = place
    return path[widest], threshold


def _to_body(node: Node) -> list[Node]:
    path = []
    for up in _path(node):
        path.append(up)
        if up.name == "body":
            break
    return path


def _is_dense(node: Node, threshold: float) -> bool:
    return node.name not in _INLINE and node.chars > 0 and node.density >= threshold and node.link_chars * 2 <= node.chars


def _blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    done: list[str] = []
    open_: list[str] = []

    def end() -> None:
        if text := " ".join("".join(open_).split()):
            done.append(text)
        open_.clear()

    stack: list[tuple[Node | str | None, bool]] = [(node, True)]
    while stack:
        at, enter = stack.pop()
        if isinstance(at, str):
            open_.append(at)
            continue
        if not enter:
            end()
            continue
        block = at.name not in _INLINE
        if at is not node:
            if at.never:
                if block:
                    end()
                continue
            # A dense page keeps all but lists of links.
            if block and at.density < threshold and at.chars and at.link_chars * 2 > at.chars and at.link_tags > 1:
                end()
                continue
        if block:
            end()
            stack.append((at, False))
        stack += [(c, True) for c in reversed(at.children)]
    end()
    return done


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by newlines; empty for a null or empty page."""
    if not page:
        return ""
    root = parse(page)
    best, threshold = _main(root)
    return "\n".join(_blocks(best, threshold))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages``.

    A null page, or one without text, gives an empty text. Rows are read one by one: nulls in other
    columns and repeated rows are carried as they are, an empty table gives an empty one, further
    columns are not read.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").alias("html"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
