"""Pages to paragraphs, with the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements that are dropped, that hold content, and that never have an end tag.
DROPPED = frozenset(["script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe"])
CONTENT = frozenset(["article", "main", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "code", "figcaption", "summary", "details"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):  # noqa: ANN201 - the nodes below, in document order
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self, between: str) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if c.strip():
                    out.append(c.strip())
            else:
                stack += reversed(c.children)
        return between.join(out)


class _Tree(HTMLParser):
    """Repairs as browsers do for the common faults: a block ends an open paragraph, an item the item before, an end tag everything opened inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("document", {}, None)

    def _close(self, tags: set[str], until: frozenset[str] | set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "article", "section", "main", "div", "body"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        if tag in ("td", "th", "tr"):
            self._close({"td", "th"} if tag != "tr" else {"tr"}, {"table"})
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def extract(html: str | None, least: int = 20) -> tuple[str, list[str]]:
    """(title, paragraphs): texts of the content elements under the page's root, in order, of more than ``least`` characters.

    The root is the first article, else main, else a div of role main, else body, else the document.  Nested content elements
    give their text each, so text inside two of them comes twice.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in DROPPED]
        stack += [c for c in node.children if isinstance(c, _Node)]
    nodes = list(tree.root.walk())

    def first(test):  # noqa: ANN001, ANN202
        return next((n for n in nodes if test(n)), None)

    title = first(lambda n: n.tag == "title")
    root = first(lambda n: n.tag == "article") or first(lambda n: n.tag == "main") or first(lambda n: n.tag == "div" and n.attrs.get("role") == "main") or first(lambda n: n.tag == "body") or tree.root
    texts = (n.text(" ") for n in root.walk() if n.tag in CONTENT)
    return (title.text("") if title else "", [t for t in texts if len(t) > least])


@pandas_udf(StructType([StructField("title", StringType()), StructField("paragraphs", ArrayType(StringType()))]))
def _extracted(html: pd.Series) -> pd.DataFrame:
    found = [extract(h) for h in html]
    return pd.DataFrame({"title": [t for t, _ in found], "paragraphs": [p for _, p in found]})


def page_content(html: Column) -> Column:
    """title, paragraphs and text (paragraphs joined by blank lines) of a page's HTML."""
    found = _extracted(html)
    return F.struct(found["title"].alias("title"), found["paragraphs"].alias("paragraphs"), F.array_join(found["paragraphs"], "\n\n").alias("text"))
