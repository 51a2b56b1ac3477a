"""HTML extraction by line-block distribution: surges and dives of text length over windows of lines."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines whose weights are summed, and the sum at which text is taken to begin.
WINDOW = 3
SURGE = 80.0
#: How much more a character weighs inside an element that the page calls its article or main part.
MARKED = 2.0
#: Shares of the page's typical line below which a line is light: in a row of light ones, and next to a marked article.
DIVE = 0.15
BESIDE = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/>]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
#: Elements whose content is no text at all; it ends at the end tag only.
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"))
#: Elements around the article, whose lines weigh against it; the second kind stands inside lines and goes.
_ASIDE = frozenset(("head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"))
_CONTROL = frozenset(("button", "select", "datalist", "label"))
#: Words in a class, id or role that tell of something around the article, and words that may follow them.
_ODD = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related recommended search share sharing sidebar sidenav skip social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo replies reply respond".split()
)
_PLAIN = frozenset("area articles bar block body bottom box button buttons container content group holder icons inner item items left link links list main menu outer panel posts right row section slot stories text top unit wrap wrapper".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_CLOSED_BY = {"p": frozenset("p div section article h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr form header footer nav aside main address figure".split()), "li": frozenset(["li"]), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(["tr"]), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(["option"]), "head": frozenset("body p div section article main h1 h2 h3 h4 h5 h6 ul ol table header nav footer".split())}
_BODY = frozenset(("article", "main"))
#: What a sentence ends with; menus and labels don't.
_SENTENCE_END = tuple(".!?…:;。！？»”\"")
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a line's place tells: around the article, nothing, a heading, inside the article, a heading inside it.
AROUND, PLAIN, HEADING, INSIDE, TITLE = -1, 0, 1, 2, 3


def _odd_label(label: str) -> bool:
    """Whether one class or id names something around the article: its last words are odd, or odd and then plain ones."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower()) if w]
    while words and words[-1] in _PLAIN and words[-1] not in _ODD:
        words.pop()
    return bool(words) and words[-1] in _ODD


def _odd(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element stands around the article. A header inside an article is its heading unless its class says otherwise."""
    if (name in _ASIDE or name in _CONTROL) and not (inside and name == "header"):
        return True
    if not attributes or name in ("body", "html", *_BODY):
        return False
    return bool(_HIDDEN.search(attributes)) or any(_odd_label(x) for a, b, c in _CLASS.findall(attributes) for x in (a or b or c).split())


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of it in links, place) of each block in page order; only what is never text is left out.

    Inline markup doesn't break a block, nor do controls inside it; an inline element that its name or class puts around
    the article goes out of its line. Takes time in proportion to the page, whatever its nesting.
    """
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, odd, body
    open_: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    endless: set[str] = set()
    odd = muted = body = links = heads = 0
    at = 0

    def clean(parts: list[str]) -> str:
        return " ".join(html.unescape("".join(parts)).split())

    def flush() -> None:
        line = clean(text)
        if line:
            place = AROUND if odd else (INSIDE if body else PLAIN) + (1 if heads else 0)
            out.append((line, len(clean(linked)), place))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        if not muted and piece:
            text.append(piece)
            if links:
                linked.append(piece)

    def count(name: str, was_odd: bool, was_body: bool, step: int) -> None:
        nonlocal odd, muted, body, links, heads
        open_[name] = open_.get(name, 0) + step
        if was_odd and (name in _INLINE or name in _CONTROL):
            muted += step
        elif was_odd:
            odd += step
        body += step * was_body
        links += step * (name == "a")
        heads += step * (name in _HEADING)

    def pop() -> str:
        name, was_odd, was_body = stack.pop()
        if name not in _INLINE and name not in _CONTROL:
            flush()
        count(name, was_odd, was_body, -1)
        return name

    def pop_inline(name: str) -> None:
        # an inline end tag closes its own element, not a block that was opened since
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] not in _INLINE:
                return

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _TOKEN.match(page, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(html.escape(re.sub(r"\]\]>\Z", "", m[0][9:])))
            continue
        if m[1]:
            if not open_.get(name):
                if name == "p":
                    flush()
            elif name in _INLINE:
                pop_inline(name)
            else:
                while pop() != name:
                    pass
            continue
        if name in _RAW:
            if not m[0].rstrip(">").endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    continue
                endless.add(name)
                if name in ("script", "style"):
                    at = len(page)
                elif name in ("title", "textarea"):
                    after = page.find("<", at)
                    at = after if after >= 0 else len(page)
            continue
        if name in ("br", "hr"):
            flush()
            continue
        if name in _VOID:
            continue
        is_odd = _odd(name, m[3] or "", body > 0)
        if name in _INLINE and not is_odd and name != "a":
            continue
        if name == "a" and open_.get("a"):  # links don't nest
            pop_inline("a")
        if name not in _INLINE and name not in _CONTROL:
            while stack and (name in _CLOSED_BY.get(stack[-1][0], ()) or stack[-1][0] in _INLINE and not stack[-1][1] and any(name in _CLOSED_BY.get(x[0], ()) for x in stack[-2:-1])):
                pop()
            flush()
        stack.append((name, is_odd, name in _BODY))
        count(name, is_odd, name in _BODY, 1)
    flush()
    return out


def weights_of(lines: list[tuple[str, int, int]]) -> list[float]:
    """A line weighs its characters outside links, more where the page marks its article; around it they weigh against it.

    A heading belongs to what follows it, so it weighs as much as the next line, if that is more.
    """
    out = [(-1.0 if place == AROUND else MARKED if place >= INSIDE else 1.0) * (len(text) - linked) for text, linked, place in lines]
    for k in range(len(out) - 2, -1, -1):
        if lines[k][2] in (HEADING, TITLE) and out[k] > 0:
            out[k] = max(out[k], out[k + 1])
    return out


def typical(weights: list[float]) -> float:
    """The weight of which lines at least as heavy make up half of the page."""
    heavy = sorted((w for w in weights if w > 0), reverse=True)
    half, held = sum(heavy) / 2, 0.0
    for w in heavy:
        held += w
        if held >= half:
            return w
    return 0.0


def dives(lines: list[tuple[str, int, int]], weights: list[float], window: int = WINDOW) -> list[bool]:
    """Lines that a dive takes out of the distribution.

    Around the article: all that weigh against it. Before the first and behind the last heavy line of the page: ``window``
    or more light lines in a row that end no sentence, which is what menus without links look like. Beside a marked article that holds most of
    the page: lines outside it that are light for it, which is what adverts and footers look like.
    """
    usual, places = typical(weights), [place for *_, place in lines]
    out = [w < 0 or place == AROUND for w, place in zip(weights, places)]
    heavy = [k for k, w in enumerate(weights) if w >= DIVE * usual and w > 0]
    marked = [k for k, place in enumerate(places) if place >= INSIDE and weights[k] > 0]
    if not heavy:
        return out

    def edge(step: int) -> None:
        k, run = (0 if step > 0 else len(weights) - 1), []
        while weights[k] < DIVE * usual and places[k] < INSIDE and (weights[k] <= 0 or not lines[k][0].endswith(_SENTENCE_END)):
            if weights[k] > 0:
                run.append(k)
            k += step
        if len(run) >= window:
            for i in run:
                out[i] = True

    edge(1)
    edge(-1)
    if marked and 2 * sum(weights[k] for k in marked) >= sum(w for w in weights if w > 0):
        for k in [*range(marked[0]), *range(marked[-1] + 1, len(weights))]:
            if places[k] == PLAIN and weights[k] < BESIDE * usual:
                out[k] = True
    return out


def stretches(weights: list[float], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """(first, end) of the stretches of text in a distribution of line weights.

    The sum over ``window`` lines from each line on is the distribution. Text surges where a sum reaches ``surge`` (or
    the largest sum of the page, if that is less): the stretch reaches back and on to the dives, where a whole window
    weighs nothing, without the weightless lines at its ends.
    """
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    least = min(surge, max(sums, default=0.0))
    out, k = [], 0
    while k < len(sums):
        end = k
        while end < len(sums) and sums[end] > 0:
            end += 1
        if end > k and max(sums[k:end]) >= least > 0:
            heavy = [i for i in range(k, end) if weights[i] > 0]
            out.append((heavy[0], heavy[-1] + 1))
        k = max(end, k + 1)
    return out


def kept_lines(lines: list[tuple[str, int, int]], window: int = WINDOW, surge: float = SURGE) -> list[int]:
    """Numbers of the lines that belong to the article: those of all stretches of what the dives leave."""
    weights = weights_of(lines)
    left = [k for k, gone in enumerate(dives(lines, weights, window)) if not gone]
    return [left[i] for first, end in stretches([weights[k] for k in left], window, surge) for i in range(first, end)]


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's text: the lines that the line-block distribution keeps, joined by newlines.

    Whole pages of any length; markup that never closes runs to the end of its parent. Null, empty and textless pages
    give the empty text.
    """
    lines = lines_of(page) if page else []
    return "\n".join(lines[i][0] for i in kept_lines(lines, window, surge))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``, in the rows' own columns only.

    Null and empty html give the empty text; ids and urls pass through, null and repeated ones too. Each page is read
    alone and whole. An empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
