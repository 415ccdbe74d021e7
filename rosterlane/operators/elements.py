"""Pages as trees of elements: one linear pass over each page, then columns that select elements as a DOM does.

element_tree() replaces a page's markup by its text and the list of its elements in document order. An element names its
tag, its attributes, its parent, its last descendant and the range of the page's text that it covers; so the text of all elements is kept
once, the subtree of an element is a slice of the list, and selections are filters on arrays, a page to a row.

Rules of the pass, those of the HTML standard but for what is named last: void elements hold nothing; an end tag closes its own element and
what is still open in it, and is passed over where its element is not open or lies outside the table cell (for tags of the line:
outside the block) that it stands in; items, terms, options, rows, cells and paragraphs end where the next of their kind, or a block after a paragraph,
begins; attribute values may be in quotes or without; character references are resolved; comments and the contents of script and style are no text. Not built:
moving misplaced content out of tables, and reopening <b>, <i> .. around blocks that cross them.

Cases. A null page has a null text and no elements. What is open at the end of a page ends there. A page of unclosed tags takes time in proportion to
its length: open elements are found by their name, not by a search.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlane.functions import text as t

#: Fixed values of the HTML standard: elements without contents, with contents that are not markup, and blocks.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_PARTS = frozenset("body button caption dd dt html li object option td template th tbody tfoot thead tr".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: The same: what an opening tag closes, and what hides it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
} | {b: (("p",), ("button", "table", "td", "th", "caption", "object", "template")) for b in _BLOCKS}
_CELL = ("td", "th", "caption", "table", "object", "template")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?")
#: Stands in a page's text where a line breaks: at <br> and at the ends of blocks.
BREAK = "\x1e"
_BREAKS = frozenset("div p li dd dt".split())


class _Page:
    """The pass over one page."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.lasts: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[str] = []
        self.size = 0
        self.open: list[int] = []  # elements
        self.where: dict[str, list[int]] = {}  # by tag, its places in open
        self.blocks: list[int] = []  # places in open of blocks and parts

    def at(self, tags: tuple[str, ...]) -> int:
        """The highest place in open of one of the tags, -1 if there is none."""
        return max((self.where[x][-1] for x in tags if self.where.get(x)), default=-1)

    def say(self, piece: str) -> None:
        if piece:
            self.pieces.append(piece)
            self.size += len(piece)

    def begin(self, tag: str, attributes: dict[str, str]) -> None:
        closed, hidden_by = _ENDS.get(tag, ((), ()))
        limit = self.at(hidden_by)
        self.pop(min((self.where[x][-1] for x in closed if self.where.get(x) and self.where[x][-1] > limit), default=len(self.open)))
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.parents.append(self.open[-1] if self.open else -1)
        self.lasts.append(len(self.tags) - 1)
        self.starts.append(self.size)
        self.ends.append(self.size)
        if tag == "br":
            self.say(BREAK)
        if tag not in _VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            if tag in _BLOCKS or tag in _PARTS:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def end(self, tag: str) -> None:
        places = self.where.get(tag)
        if not places:
            return
        if tag in _TABLE:
            hidden = self.at(("table",)) if tag != "table" else -1
        elif tag in _BLOCKS or tag in _PARTS:
            hidden = self.at(_CELL)
        else:
            hidden = self.blocks[-1] if self.blocks else -1
        if places[-1] > hidden or tag == "table":
            self.pop(places[-1])

    def pop(self, place: int) -> None:
        """Ends all open elements from this place on."""
        while len(self.open) > place:
            element = self.open.pop()
            tag = self.tags[element]
            self.where[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.ends[element], self.lasts[element] = self.size, len(self.tags) - 1
            if tag in _BREAKS:
                self.say(BREAK)


def parsed(page: str) -> _Page:
    """One pass from tag to tag."""
    out, at, n = _Page(), 0, len(page)
    while at < n:
        tag = page.find("<", at)
        tag = n if tag < 0 else tag
        out.say(markup.unescape(page[at:tag]).replace(BREAK, " "))
        if tag == n:
            break
        ahead = page[tag + 1 : tag + 2]
        if ahead == "!" or ahead == "?":
            mark, skip = ("-->", 4) if page.startswith("<!--", tag) else (">", 2)
            stop = page.find(mark, tag + (2 if mark == "-->" else skip))  # <!--> is a whole comment
            at = n if stop < 0 else stop + len(mark)
        elif ahead == "/" and (m := _NAME.match(page, tag + 2)):
            out.end(m[0].lower())
            stop = page.find(">", m.end())
            at = n if stop < 0 else stop + 1
        elif m := _NAME.match(page, tag + 1):
            name, attributes, at = m[0].lower(), {}, m.end()
            while a := _ATTRIBUTE.match(page, at):
                value = next((x for x in a.groups()[1:] if x is not None), "")
                attributes.setdefault(a[1].lower(), markup.unescape(value))
                at = a.end()
            stop = page.find(">", at)
            at = n if stop < 0 else stop + 1
            if stop >= 0:
                out.begin(name, attributes)
                if name in _RAW:
                    close = re.compile(rf"(?i)</{name}(?=[\s/>])").search(page, at)
                    inside = page[at : close.start() if close else n]
                    if name not in ("script", "style"):
                        out.say(markup.unescape(inside).replace(BREAK, " "))
                    at = close.start() if close else n
        else:
            out.say("<")
            at = tag + 1
    out.pop(0)
    return out


ELEMENT = "struct<at: int, tag: string, attributes: map<string, string>, parent: int, last: int, start: int, end: int>"


def element_tree(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with (page_text, elements) in place of their markup."""
    others = [c for c in pages.columns if c != html_col]
    kept = pages.select(F.struct(*[pages[c] for c in others]).alias("kept"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [None if x is None else parsed(x) for x in batch.column("html").to_pylist()]
            every = [x for x in told if x is not None]
            flat = lambda name: [v for x in every for v in getattr(x, name)]  # noqa: B023,E731
            pairs = flat("attributes")
            offsets = [0]
            for x in pairs:
                offsets.append(offsets[-1] + len(x))
            attributes = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([k for x in pairs for k in x], pa.string()), pa.array([v for x in pairs for v in x.values()], pa.string()))
            numbers = lambda values: pa.array(values, pa.int32())
            elements = pa.StructArray.from_arrays(
                [numbers([i for x in every for i in range(len(x.tags))]), pa.array(flat("tags"), pa.string()), attributes, numbers(flat("parents")), numbers(flat("lasts")), numbers(flat("starts")), numbers(flat("ends"))],
                ["at", "tag", "attributes", "parent", "last", "start", "end"],
            )
            sizes = [0]
            for x in told:
                sizes.append(sizes[-1] + (0 if x is None else len(x.tags)))
            lists = pa.ListArray.from_arrays(numbers(sizes), elements)
            texts = pa.array([None if x is None else "".join(x.pieces) for x in told], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), texts, lists], ["kept", "page_text", "elements"])

    schema = f"kept {kept.schema['kept'].dataType.simpleString()}, page_text string, elements array<{ELEMENT}>"
    return kept.mapInArrow(run, schema).select("kept.*", "page_text", "elements")


def _covered(element: Column) -> Column:
    return F.substring(F.col("page_text"), element["start"] + 1, element["end"] - element["start"])


def text_of(element: Column) -> Column:
    """An element's text as a DOM has it, without the blanks at its ends."""
    return t.trim(F.translate(_covered(element), BREAK, ""))


def lines_of(element: Column) -> Column:
    """An element's text with a line break at each <br> and after each block; blanks around breaks go."""
    return t.trim(F.regexp_replace(F.translate(_covered(element), BREAK, "\n"), r"[ \t]*\n[ \t]*", "\n"))


def attribute(element: Column, name: str) -> Column:
    """An attribute's value, empty without one."""
    return F.coalesce(element["attributes"][name], F.lit(""))


def tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def below(element: Column, *tags: str) -> Column:
    """The descendants of an element with one of the tags."""
    return tagged(F.slice(F.col("elements"), element["at"] + 2, element["last"] - element["at"]), *tags)


def children(element: Column, *tags: str) -> Column:
    return F.filter(below(element, *tags), lambda e: e["parent"] == element["at"])


def inside(outer: tuple[str, ...], *tags: str) -> Column:
    """The elements with one of the tags that have an ancestor with one of the outer tags, each once and in order."""
    places = F.flatten(F.transform(tagged(F.col("elements"), *outer), lambda o: F.transform(below(o, *tags), lambda e: e["at"])))
    return F.transform(F.array_sort(F.array_distinct(places)), lambda i: F.get(F.col("elements"), i))
