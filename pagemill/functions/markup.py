"""Small markup helper for the Python side of selector jobs: a tree and a selector subset.

Selectors: ``tag``, ``*``, ``#id``, ``.class``, ``[attr]``, ``[attr=value]``, descendant,
``>`` and ``,``. Spark spreads the pages; one page is handled at a time.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_BLOCKS = f"address article aside blockquote div dl fieldset footer form {_HEADINGS} header hr main nav ol pre section table ul"
# a start tag on the left ends an open element on the right when that is innermost
IMPLIED_END = {
    **{block: frozenset({"p"}) for block in _BLOCKS.split()},
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"td", "th", "tr"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
    "body": frozenset({"head"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """Elements below this one, in document order."""
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                yield item
                stack.extend(reversed(item.children))

    def text(self) -> str:
        """Non-blank text pieces, each trimmed, one per line; no script or style."""
        parts, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    parts.append(item.strip())
            elif item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))
        return "\n".join(parts)

    def outer_html(self) -> str:
        out, stack = [], [(self, False)]
        while stack:
            item, closing = stack.pop()
            if closing:
                out.append(f"</{item.tag}>")
            elif isinstance(item, str):
                out.append(item)
            else:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in item.attrs.items())
                out.append(f"<{item.tag}{attrs}>")
                if item.tag in VOID:
                    continue
                stack.append((item, True))
                raw = item.tag in ("script", "style")
                stack.extend(
                    (c if isinstance(c, Node) or raw else escape(c, quote=False), False)
                    for c in reversed(item.children)
                )
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("")

    def handle_starttag(self, tag, attrs):
        while self.open.tag in IMPLIED_END.get(tag, ()):
            self.open = self.open.parent
        node = Node(tag, {}, self.open)
        for name, value in attrs:
            node.attrs.setdefault(name, value or "")
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None:
            if node.tag == tag:
                self.open = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[\w-]+))\s*)?\]"""
)


def compile_selector(selector: str) -> list:
    """Alternatives, each a list of (combinator, tests) from right to left. ValueError if unsupported."""
    alternatives = []
    for part in selector.split(","):
        steps, link, pos, part = [], " ", 0, part.strip()
        tests: list = []
        while pos < len(part):
            gap = re.match(r"\s*>\s*|\s+", part[pos:])
            if gap:
                if not tests:
                    raise ValueError(f"bad selector {selector!r}")
                steps.append((link, tests))
                link, tests = (">" if ">" in gap.group() else " "), []
                pos += gap.end()
                continue
            m = _SIMPLE.match(part, pos)
            if not m or (m["tag"] and tests):
                raise ValueError(f"bad selector {selector!r}")
            if m["tag"]:
                tests.append(("tag", m["tag"].lower(), None))
            elif m["id"]:
                tests.append(("eq", "id", m["id"]))
            elif m["cls"]:
                tests.append(("class", m["cls"], None))
            else:
                value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), None)
                tests.append(("eq" if value is not None else "has", m["attr"].lower(), value))
            pos = m.end()
        if not tests:
            raise ValueError(f"bad selector {selector!r}")
        steps.append((link, tests))
        alternatives.append(steps[::-1])
    return alternatives


def _passes(node: Node, tests: list) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", node.tag)
        elif kind == "class":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "has":
            ok = name in node.attrs
        else:
            ok = node.attrs.get(name) == value
        if not ok:
            return False
    return True


def _matches(node: Node, steps: list, at: int = 0) -> bool:
    link, tests = steps[at]
    if not node.tag or not _passes(node, tests):
        return False
    if at + 1 == len(steps):
        return True
    up = node.parent
    while up is not None:
        if _matches(up, steps, at + 1):
            return True
        if link == ">":
            return False
        up = up.parent
    return False


def select(node: Node, alternatives: list):
    """Matching elements below ``node``, in document order."""
    for candidate in node.walk():
        if any(_matches(candidate, steps) for steps in alternatives):
            yield candidate
