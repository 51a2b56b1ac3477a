"""Result pages to business cards: a table function that reads a page's tokens once.

Elements are ranges of the page's text pieces, not nodes of a tree: an end tag closes the nearest open element of its
name, which ends those opened inside it too. So a page costs time in proportion to its length, however broken its nesting.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import VOID

FIELDS = ("text", "href", "label", "title", "website", "reviews", "rating", "phone")
CARD_ROW = "card_no int, " + ", ".join(f"{n} string" for n in FIELDS) + ", info array<string>, error string"
#: Fixed values: (element, class) of the listing's markup whose text tells a fact.
MARKS = {("div", "qBF1Pd"): "title", ("span", "UY7F9"): "reviews", ("span", "MW4etd"): "rating", ("span", "UsdlK"): "phone"}
CARD_CLASS, LINK_CLASS, INFO_CLASS = "Nv2PK", "hfpxzc", "W4Efsd"


class Element:
    """Where an element starts and ends among the text pieces; ``closed``: by an end tag of its own."""

    __slots__ = ("tag", "start", "end", "closed", "parent", "value")

    def __init__(self, tag: str, start: int, parent: Element | None, value: tuple[str, ...] = ()):
        self.tag, self.start, self.end, self.closed, self.parent, self.value = tag, start, None, False, parent, value


class CardReader(HTMLParser):
    """Text pieces of a page, and the elements that cards are made of, in the order of their start."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.found: dict[str, list[Element]] = {k: [] for k in ("card", "article", "link", "site", "info", *MARKS.values())}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        classes = given.get("class", "").split()
        # each element starts at a piece of its own, so that equal positions don't mix up two elements
        self.pieces.append("")
        up = self.stack[-1] if self.stack else None
        element = Element(tag, len(self.pieces) - 1, up)
        for (name, cls), kind in MARKS.items():
            if tag == name and cls in classes:
                self.found[kind].append(element)
        if tag == "div":
            for kind, hit in (("card", CARD_CLASS in classes), ("article", given.get("role") == "article")):
                if hit:
                    self.found[kind].append(element)
            if INFO_CLASS in classes:
                element.value = ("info",)
        elif tag == "a":
            if LINK_CLASS in classes:
                element.value = (given.get("href", ""), given.get("aria-label", ""))
                self.found["link"].append(element)
            if given.get("data-value") == "Website":
                self.found["site"].append(Element(tag, element.start, up, (given.get("href", ""),)))
        elif tag == "span" and up is not None and up.value == ("info",):
            self.found["info"].append(element)
        if tag in VOID:
            element.end = len(self.pieces)
        else:
            self.stack.append(element)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            element = self.stack.pop()
            self.open[element.tag] -= 1
            element.end = len(self.pieces)
            if element.tag == tag:
                element.closed = True
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append(data.strip())


def _span(reader: CardReader, element: Element, end: int) -> list[str]:
    return [p for p in reader.pieces[element.start : min(end, len(reader.pieces) if element.end is None else element.end)] if p]


def card_rows(html: str | None) -> Iterator[tuple]:
    """CARD_ROW of each card of a page, in order.

    A card that no end tag of its own closes ends where the next one starts. A card that can't be read gives a row with
    its number and an error, the others aren't touched.
    """
    reader = CardReader()
    reader.feed(html or "")
    reader.close()
    cards = reader.found["card"] or reader.found["article"]
    starts = {kind: [e.start for e in found] for kind, found in reader.found.items()}
    for k, card in enumerate(cards):
        try:
            end = card.end if card.closed else min(cards[k + 1].start if k + 1 < len(cards) else len(reader.pieces), len(reader.pieces) if card.end is None else card.end)

            def inside(kind: str) -> list[Element]:
                return reader.found[kind][bisect_left(starts[kind], card.start + 1) : bisect_left(starts[kind], end)]

            text = lambda kind: next(("".join(_span(reader, e, end)) for e in inside(kind)[:1]), None)
            link, site = inside("link")[:1], inside("site")[:1]
            href, label = link[0].value if link else ("", "")
            info = ["".join(_span(reader, e, end)) for e in inside("info")]
            yield (k, " ".join(_span(reader, card, end)).lower(), href, label, text("title"), site[0].value[0] if site else "", text("reviews"), text("rating"), text("phone"), info, None)
        except Exception as problem:  # noqa: BLE001  whatever a card does, it must not cost the page
            yield (k, *[None] * len(FIELDS), None, f"{type(problem).__name__}: {problem}")


@F.udtf(returnType=CARD_ROW)
class BusinessCards:
    """Rows of CARD_ROW for one page."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from card_rows(html)


def page_cards(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` but html, with one row and CARD_ROW's columns in ``c`` for each card of its html."""
    kept = [c for c in pages.columns if c != "html"]
    joined = pages.alias("p").lateralJoin(BusinessCards(F.col("p.html").outer()).alias("t"))
    names = ["card_no", *FIELDS, "info", "error"]
    return joined.select(*[F.col(f"p.`{c}`").alias(c) for c in kept], F.struct(*[F.col(f"t.{n}").alias(n) for n in names]).alias("c"))
