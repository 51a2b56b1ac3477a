"""HTML to structs: the one step that needs Python. It parses and selects; all rules on the result are columns.

A small tree on the standard library's tokenizer, which never fails on broken nesting: an end tag closes the nearest open
element of its name, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TEXT, _FLAG = T.StringType(), T.BooleanType()
# types, not DDL: executors import this module without a session
PAGE_SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("text", "title")]
    + [T.StructField(n, _FLAG) for n in ("has_viewport", "has_description", "has_review_type")]
    + [T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", _TEXT), T.StructField("text", _TEXT)])))]
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node | str]:
        """All nodes and strings below, in document order, without recursion."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def find_all(self, tag: str, cls: str | None = None, **attrs: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag == tag and (cls is None or cls in x.attrs.get("class", "").split()) and all(x.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items())]

    def text(self, separator: str = "", skip: frozenset[str] = frozenset(), strip: bool = False) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                x = x.strip() if strip else x
                if x or not strip:
                    out.append(x)
            elif x.tag not in skip:
                stack.extend(reversed(x.children))
        return separator.join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            closed = self.at
            self.open[closed.tag] -= 1
            self.at = closed.parent
            if closed.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def page_facts(html: str | None) -> dict:
    root = parse(html or "")
    titles = root.find_all("title")
    metas = {m.attrs.get("name", "") for m in root.find_all("meta")}
    return {
        "text": root.text(" | ", skip=frozenset(("script", "style", "noscript"))),
        "title": titles[0].text().strip() if titles else "",
        "has_viewport": "viewport" in metas,
        "has_description": "description" in metas,
        "has_review_type": any("review" in x.attrs.get("itemtype", "").lower() for x in root.walk() if isinstance(x, Node)),
        "links": [{"href": a.attrs["href"], "text": a.text()} for a in root.find_all("a") if "href" in a.attrs],
    }


@F.pandas_udf(PAGE_SCHEMA)
def page_struct(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_facts(x) for x in html], columns=["text", "title", "has_viewport", "has_description", "has_review_type", "links"])
