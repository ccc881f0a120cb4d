"""The element tree of captured pages: cards with their nested fields, by CSS selectors, one call of a UDTF a page.

A page is read once by the standard tokenizer with a stack of open elements. An element ends at its own end tag, with
its parent, or where a sibling begins that can't stand inside (li, td, p and the like); an end tag without a start is
nothing. So elements of one kind may be nested, and end tags may lack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.runtime import ship

# Fixed values of HTML: elements without content; those that a start tag ends, up to those that keep it from doing so.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | dict.fromkeys(BLOCKS, {"p"})
KEEPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}} | dict.fromkeys(BLOCKS, BLOCKS - {"p"} | {"li", "td", "th"})

_STEP = re.compile(r"\s*([\w*-]*)((?:[.#][\w-]+|\[[^\]]*\])*)")
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:([*^$]?)=\"([^\"]*)\")?\]")
_BLANKS = re.compile(r"\s+")

Step = tuple[str, tuple[tuple[str, str, str], ...]]


class Element:
    """last: the number of elements before its end; text: its share of the page's pieces."""

    __slots__ = ("tag", "attrs", "classes", "parent", "number", "last", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, number: int, piece: int) -> None:
        self.tag, self.attrs, self.parent, self.number, self.last, self.text = tag, attrs, parent, number, number, slice(piece, piece)
        self.classes = frozenset(attrs.get("class", "").split())

    def is_(self, step: Step) -> bool:
        tag, tests = step
        if tag not in ("", "*", self.tag):
            return False
        for kind, name, value in tests:
            if kind == ".":
                ok = name in self.classes
            elif name not in self.attrs:
                ok = False
            else:
                own = self.attrs[name]
                ok = {"": True, "=": own == value, "*=": value in own, "^=": own.startswith(value), "$=": own.endswith(value)}[kind]
            if not ok:
                return False
        return True


@cache
def steps(selector: str) -> tuple[tuple[Step, ...], ...]:
    """Alternatives (comma) of steps (blank: somewhere below). A step: tag, .class, #id, [attr], [attr="x"], also *=, ^=, $=."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        path, at = [], 0
        one = one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if m.end() == at:
                raise ValueError(f"not a selector: {selector}")
            tests = [("=", "id", t[2]) if t[1] == "#" else (".", t[2], "") if t[1] else ((t[4] or "") + "=" if t[5] is not None else "", t[3], t[5] or "") for t in _TEST.finditer(m[2])]
            path.append((m[1].lower(), tuple(tests)))
            at = m.end()
        out.append(tuple(path))
    return tuple(out)


class Page(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self.open: list[Element] = []
        self.feed(html)
        self.close()
        self.end(0)

    def end(self, depth: int) -> None:
        for e in self.open[depth:]:
            e.last, e.text = len(self.elements), slice(e.text.start, len(self.pieces))
        del self.open[depth:]

    def ended(self, tags: set[str], keeps: set[str]) -> int | None:
        """Depth of the outermost open element of these tags above one that keeps it."""
        found = None
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag in tags:
                found = depth
            elif self.open[depth].tag in keeps:
                break
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS and (depth := self.ended(ENDS[tag], KEEPS[tag])) is not None:
            self.end(depth)
        self.open.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None, len(self.elements), len(self.pieces)))
        self.elements.append(self.open[-1])
        if tag in VOID:
            self.end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        keeps = KEEPS.get(tag, ()) if tag not in BLOCKS else ()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                return self.end(depth)
            if self.open[depth].tag in keeps:
                return None
        return None

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def root(self) -> Element:
        """What holds the whole page."""
        out = Element("", {}, None, -1, 0)
        out.last, out.text = len(self.elements), slice(0, len(self.pieces))
        return out

    def select(self, selector: str, below: Element | None = None) -> Iterator[Element]:
        """Elements in the page's order, those inside another only if one is given (whose own ancestors count, too)."""
        paths = steps(selector)
        for e in self.elements if below is None else self.elements[below.number + 1 : below.last]:
            if any(_fits(e, p) for p in paths):
                yield e

    def text_of(self, e: Element) -> str:
        return _BLANKS.sub(" ", "".join(self.pieces[e.text])).strip()


def _fits(e: Element, path: tuple[Step, ...]) -> bool:
    if not e.is_(path[-1]):
        return False
    left, up = len(path) - 2, e.parent
    while left >= 0 and up is not None:
        left -= up.is_(path[left])
        up = up.parent
    return left < 0


class CardReader:
    """The UDTF: (html, spec) -> a row for each card: its number on the page, and for each field all values found."""

    def eval(self, html: str | None, spec: str) -> Iterator[tuple[int, dict[str, list[str]]]]:
        if not html:
            return
        own, page = json.loads(spec), Page(html)
        for nth, card in enumerate(page.select(own["card"]), 1) if own["card"] else [(0, page.root())]:
            found = {}
            for name, (selector, what) in own["fields"].items():
                hits = page.select(selector, card) if selector else (card,)
                if what.startswith("text:"):
                    inner = (next(page.select(what[5:], e), None) for e in hits)
                    found[name] = [page.text_of(e) if e else "" for e in inner]
                else:
                    found[name] = [page.text_of(e) for e in hits] if what == "text" else [e.attrs[what] for e in hits if what in e.attrs]
            yield nth, found


def cards(pages: DataFrame, card: str, per_page: int, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns of pages (ord, html) but html, with ord made the card's (ord * per_page + its number on the page), and an
    array<string> for each field: the texts ("text"), texts of the first element inside ("text:" and its selector, '' without
    one) or attributes (their name) of all elements inside the card that its selector finds, in their order; '' is the card
    itself. A card '' is the whole page, number 0. Pages that are null, empty or without a card give no row."""
    ship(pages.sparkSession)
    reader = F.udtf(CardReader, returnType="_nth int, _found map<string, array<string>>")
    spec = json.dumps({"card": card, "fields": fields})
    rows = pages.lateralJoin(reader(F.col("html").outer(), F.lit(spec)))
    rest = [c for c in pages.columns if c not in ("ord", "html")]
    return rows.select((F.col("ord") * per_page + F.col("_nth")).alias("ord"), *rest, *(F.col("_found")[n].alias(n) for n in fields))


def first(c: str | Column) -> Column:
    """The first value of a field; '' where there is none."""
    return F.coalesce(F.get(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(""))


def filled(c: str) -> Column:
    """The first value that isn't ''; null where there is none."""
    return F.get(F.filter(c, lambda x: x != ""), F.lit(0))


# Braces.

_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}]', re.S)


def balanced(text: str | None) -> str | None:
    """From the first opening brace to the one that closes it; braces in strings and after escapes don't count. Null where
    it isn't closed, or a string isn't."""
    depth, begin = 0, -1
    for m in _BRACE.finditer(text or "", max(0, (text or "").find("{"))):
        if m[0] == "{":
            begin, depth = m.start() if begin < 0 else begin, depth + 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                return text[begin : m.end()]
        elif m[0] == '"' and depth:
            return None
    return None


def balanced_after(html: Column, marker: str) -> Column:
    """The first balanced object after a marker and an equals sign; null where there is none."""

    def run(column):  # noqa: ANN001, ANN202
        import pyarrow as pa

        out = []
        for t in column.to_pylist():
            at = (t or "").find(marker)
            at = t.find("=", at) if at >= 0 else -1
            out.append(balanced(t[at:]) if at >= 0 else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(html)
