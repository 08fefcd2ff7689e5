"""Main text of html pages by composite text density.

Every node of the page tree gets a density: characters per tag, cut down where the characters sit in
links. The density sum of a node adds the densities of its children; the subtree with the largest sum is
the core of the article, and the smallest density on the way from it to the body is the threshold. The
article element round the core is the article; without one, each other subtree that reaches the threshold
belongs to it as well. Trees are built page by page inside the tasks; pages never meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from .common import whole_text_batches

# --- fixed values: html element names by kind ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template title svg math object iframe canvas audio video select option textarea button".split())
FURNITURE = frozenset("nav footer header aside form dialog menu fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id or role that mark parts which are not the article.
NOTICE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead comment comments disqus reply replies cookie cookies "
    "consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended pagination pager toolbar complementary contentinfo search skip".split()
)
#: Those of them that say where a part stands, not what its text is: layouts use them for the article as well.
PLACES = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead overlay social "
    "related recommended toolbar complementary contentinfo search skip".split()
)
# --- end of fixed values ---

#: A place name that covers more than this share of a page's text names its layout; any other name, the second share.
MOST_TEXT, ALL_TEXT = 0.5, 0.9
#: Characters from which a part of the article with a place name can be prose.
PROSE_CHARS = 140


class Node:
    __slots__ = ("tag", "parent", "parts", "aside", "named", "holds_article", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False):
        self.tag, self.parent, self.aside, self.named, self.holds_article = tag, parent, aside, frozenset(), False
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names(attrs) -> set[str]:
    """Words of class, id and role; a word denied or merely mentioned (no-sidebar, has-comments) does not count."""
    if not attrs:
        return set()
    said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()) if w]
    return {w for before, w in zip(["", *words], words) if before not in ("no", "has", "with", "without")}


#: A tag from its name to the > that ends it: quoted values may hold one, a quote that never closes is a plain character.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>"'=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_COMMENT_END = re.compile(r"--!?>")
RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}
LIST_PARTS = frozenset(("li", "dt", "dd", "tr", "td", "th"))
LIST_BOUNDS = frozenset(("ul", "ol", "dl", "table", "tr"))


class _Tree:
    """A forgiving tree of what the body holds, read in one pass.

    Unknown end tags are ignored, open paragraphs and items close by themselves; html, head and body are no
    nodes: whatever stands in them is the page. Declarations, processing instructions and damaged ones end at
    the next >, comments at their end or with the page, and so does a tag that is never finished.
    """

    def __init__(self, page: str):
        self.root = Node("#body", None)
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                break
            after = page[lt + 1 : lt + 2]
            if after == "!" or after == "?" or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
                self._text(page[at:lt])
                at = self._skipped(page, lt)
            elif after.isascii() and after.isalpha() or after == "/":
                self._text(page[at:lt])
                tag = _TAG.match(page, lt)
                if tag is None:
                    if after == "/" and not page[lt + 2].isascii():
                        at = self._skipped(page, lt)
                        continue
                    break  # it reaches to the end of the page
                at = tag.end()
                name = tag[1].lower()
                if after == "/":
                    self._end(name)
                else:
                    self._start(name, tag[2])
                    if name in RAW_TEXT:
                        end = _RAW_END[name].search(page, at)
                        self._text(page[at : end.start() if end else size])
                        at = end.start() if end else size
            else:
                self._text(page[at : lt + 1])
                at = lt + 1

    @staticmethod
    def _skipped(page: str, lt: int) -> int:
        """Where a comment or declaration at ``lt`` ends."""
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                return page.index(">", lt) + 1
            end = _COMMENT_END.search(page, lt + 4)
            return end.end() if end else len(page)
        gt = page.find(">", lt)
        return gt + 1 if gt >= 0 else len(page)

    def _text(self, data: str) -> None:
        if data:
            self.stack[-1].parts.append(unescape(data) if "&" in data else data)

    def _depth(self, tag: str) -> int:
        """Depth of the innermost open ``tag``, 0 if there is none."""
        held = self.depths.get(tag)
        return held[-1] if held else 0

    def _close(self, tag: str, stops: frozenset = frozenset()) -> None:
        depth = self._depth(tag)
        if depth and depth >= max((self._depth(s) for s in stops), default=0):
            while len(self.stack) > depth:
                self.depths[self.stack.pop().tag].pop()

    def _start(self, tag: str, said: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        elif tag in LIST_PARTS:
            self._close(tag, LIST_BOUNDS - {tag})
        in_article = self._depth("article") or self._depth("main")
        if tag in ("article", "main"):
            # a part that holds the article is none of the furniture, whatever it is called
            for node in reversed(self.stack):
                if node.holds_article:
                    break
                node.named, node.holds_article = frozenset(), True
        attrs = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(said)] if said.strip() else []
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        furniture = tag in FURNITURE and not (tag == "header" and in_article)
        node = Node(tag, self.stack[-1], hidden or furniture or tag in NO_TEXT)
        if tag not in ("article", "main") and tag not in HEADINGS and not node.aside:
            node.named = frozenset(_names(attrs) & NOTICE)
        self.stack[-1].parts.append(node)
        if tag not in VOID and not said.endswith("/"):
            self.stack.append(node)
            self.depths.setdefault(tag, []).append(len(self.stack) - 1)

    def _end(self, tag: str) -> None:
        if tag not in VOID:
            self._close(tag)


def _set_runs(root: Node) -> None:
    """Text and inline parts that stand beside blocks, or in the body itself, become blocks of their own."""
    for node in _inside_out(root):
        blocks = [isinstance(p, Node) and not (p.tag in INLINE or p.tag in VOID or p.tag in NO_TEXT) for p in node.parts]
        if node.tag in INLINE or not (any(blocks) or node is root):
            continue
        parts, run = [], None
        for part, block in zip(node.parts, blocks):
            if block:
                run = None
                parts.append(part)
            elif run is not None or isinstance(part, Node) or part.strip():
                if run is None:
                    run = Node("#run", node)
                    parts.append(run)
                run.parts.append(part)
                if isinstance(part, Node):
                    part.parent = run
        node.parts = parts


def _inside_out(root: Node) -> list[Node]:
    """Nodes with every child after its parent; without recursion, as pages nest as deep as they like."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.aside)
    return found


def _name_furniture(root: Node) -> None:
    """Set aside what its name and its text mark as furniture.

    A name that covers the text of a page says nothing about a part of it. Inside an article or main element,
    a part that is named for its place stays if it is prose: long enough and not mostly links.
    """
    nodes = _inside_out(root)
    if not any(n.named for n in nodes):
        return
    chars: dict[int, list[int]] = {}
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        inner = [chars[id(p)] for p in node.parts if isinstance(p, Node) and not p.aside]
        every, linked = own + sum(c for c, _ in inner), sum(x for _, x in inner)
        chars[id(node)] = [every, every if node.tag == "a" else linked]
    plain = {k: every - linked for k, (every, linked) in chars.items()}
    covered: dict[str, int] = {}
    stack: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while stack:
        node, above = stack.pop()
        for name in node.named - above:
            covered[name] = covered.get(name, 0) + plain[id(node)]
        above = above | node.named
        stack.extend((p, above) for p in node.parts if isinstance(p, Node) and not p.aside)
    layout = {x for x, n in covered.items() if n > (MOST_TEXT if x in PLACES else ALL_TEXT) * plain[id(root)]}
    walk = [(root, False)]
    while walk:
        node, inside = walk.pop()
        inside = inside or node.tag in ("article", "main")
        every, linked = chars[id(node)]
        names = node.named
        if not 2 * linked > every:
            names = names - layout
            if inside and plain[id(node)] >= PROSE_CHARS:
                names = names - PLACES
        node.aside = node.aside or bool(names)
        walk.extend((p, inside) for p in node.parts if isinstance(p, Node) and not p.aside)


def _measure(root: Node) -> list[Node]:
    nodes = _inside_out(root)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.aside:
                node.chars += part.chars
                node.tags += part.tags + (part.tag not in VOID)
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        if node.chars:
            tags, links = max(node.tags, 1), max(node.link_tags, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars * node.link_chars / plain + ratio * node.chars + math.e)
            inner = (node.chars / max(node.link_chars, 1)) * (tags / links)
            node.density = node.chars / tags * math.log(max(inner, 1.0)) / base
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.aside)
    return nodes


def _dense_parts(nodes: list[Node], body: Node, best: Node, threshold: float) -> list[Node]:
    """In page order, the subtree with the largest sum inside each block of ``body`` that reaches ``threshold``."""
    top: dict[int, Node] = {}
    for node in reversed(nodes):
        inner = [top[id(p)] for p in node.parts if isinstance(p, Node) and not p.aside]
        top[id(node)] = max([node, *inner], key=lambda n: (n.total, n.chars))
    dense, stack = {id(best)}, [body]
    while stack:
        node = stack.pop()
        if node is best:
            continue
        if node is not body and node.chars and node.density >= threshold:
            dense.add(id(top[id(node)]))
            if top[id(node)] is node:
                continue
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.aside and p.tag not in INLINE)
    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in dense:
            found.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.aside)
    return found


def _articles(body: Node, best: Node, threshold: float) -> list[Node]:
    """In page order, ``best`` and every outermost article element that reaches the threshold and is not mostly links."""
    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if node is best or (node.tag == "article" and node.density >= threshold and 2 * node.link_chars <= node.chars):
            found.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.aside)
    return found


def main_text(html: str) -> str:
    """The article of a page: blocks in page order, joined by one space."""
    body = _Tree(html).root
    _set_runs(body)
    _name_furniture(body)
    nodes = _measure(body)
    # the subtree with the largest sum, the body if its own parts have it; it grows to the article element around it
    best = max(nodes, key=lambda n: (n.total, n.chars))
    if best.total <= 0.0:
        best = body
    in_article, at = False, best
    while at is not None:
        if at.tag in ("article", "main"):
            best, in_article = at, True
        at = at.parent
    threshold, at = best.density, best
    while at is not None:
        if at.chars and at.density:
            threshold = min(threshold, at.density)
        at = at.parent if at is not body else None
    # outside an article element, mostly linked parts whose density is below all of the body path are menus
    blocks, current = [], []

    def end_block():
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    if in_article:
        roots = _articles(body, best, threshold)
    else:
        roots = [best] if best is body else _dense_parts(nodes, body, best, threshold)
    chosen = set(roots)
    stack: list = [x for part in reversed(roots) for x in (None, part)]
    while stack:
        part = stack.pop()
        if part is None:
            end_block()
        elif isinstance(part, str):
            current.append(part)
        elif not part.aside:
            if not in_article and part not in chosen and part.tag != "a" and part.tag not in INLINE and part.chars:
                if part.density < threshold and 2 * part.link_chars > part.chars:
                    continue
            if part.tag in INLINE:
                stack.extend(reversed(part.parts))
            else:
                end_block()
                stack.append(None)
                stack.extend(reversed(part.parts))
    end_block()
    return " ".join(blocks)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    Null or empty html gives an empty text. Nothing is cut; equal rows give equal rows; an empty table
    stays empty. Of the input only page_id, url and html are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) if isinstance(h, str) else "" for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    whole_text_batches(pages)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
