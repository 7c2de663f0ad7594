"""HTML as an array of tree events: the one step built-in functions cannot do.

``html_events`` turns a page into one array of events in document order (an
element opens, an element closes, a piece of text).  Python does no more than
that: selectors, cleaning, blocks, Markdown and result extraction are column
expressions on the array (``functions.selectors``, ``functions.render``), so
nothing is shuffled and nothing else leaves the JVM.

An event's ``id`` is its place in the array.  ``open`` is the element it
belongs to, ``last`` the id of that element's last event, so an element covers
the events with ``open <= id <= last``; ``parent`` is the enclosing element.
``edge`` marks a block's boundary; ``block``, ``item``, ``lists``, ``quotes``
and ``pre`` say in which block, list item, list depth, quotation depth and
preformatted element the text after the event stands.  ``quiet``: the event is
in an element whose text nobody reads; ``linked``: it is inside a link.  ``number`` counts items
of an ordered list, rows of a table and cells of a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("html head body title meta link base script style noscript template".split())
SILENT_HEAD = HEAD - {"html", "head", "body"}
RAW = frozenset(("script", "style", "title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CELL = frozenset(("td", "th"))
QUIET = frozenset("script style noscript svg canvas template".split())
BLOCK = CELL | frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section select summary "
    "table tbody tfoot thead tr ul caption".split()
)
# start tag -> (open elements it closes, elements that stop the search)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
}

# Fixed patterns: comments and declarations, end tags, start tags (the second
# form takes tags with an unbalanced quote), and attributes.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Pages whose events are built at a time: events take several times the page's
# size, and a page may have more than a million characters.
PART = 32

EVENT = pa.struct(
    [
        ("kind", pa.string()),
        ("id", pa.int32()),
        ("open", pa.int32()),
        ("last", pa.int32()),
        ("parent", pa.int32()),
        ("edge", pa.bool_()),
        ("block", pa.int32()),
        ("item", pa.int32()),
        ("lists", pa.int32()),
        ("quotes", pa.int32()),
        ("pre", pa.bool_()),
        ("quiet", pa.bool_()),
        ("linked", pa.bool_()),
        ("number", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
    ]
)
EVENTS_TYPE = (
    "array<struct<kind:string,id:int,open:int,last:int,parent:int,edge:boolean,block:int,item:int,"
    "lists:int,quotes:int,pre:boolean,quiet:boolean,linked:boolean,number:int,tag:string,attrs:map<string,string>,text:string>>"
)


class _Element:
    """An open element, and the context of the text inside it."""

    __slots__ = ("tag", "attrs", "id", "block", "item", "lists", "quotes", "pre", "quiet", "linked", "cell", "count")

    def __init__(self, tag, attrs, ident, around, is_edge):
        self.tag, self.attrs, self.id = tag, attrs, ident
        self.block = ident if is_edge else around.block
        self.item = ident if tag == "li" else around.item if around else -1
        self.lists = (around.lists if around else 0) + (tag in ("ul", "ol"))
        self.quotes = (around.quotes if around else 0) + (tag == "blockquote")
        self.pre = bool(around and around.pre) or tag == "pre"
        self.quiet = bool(around and around.quiet) or tag in QUIET
        # an element's own events are not inside it
        self.linked = bool(around and (around.linked or around.tag == "a"))
        self.cell = bool(around and around.cell) or tag in CELL
        self.count = 0


class _Events:
    """Walks the markup of one page and keeps the stack of open elements."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.lasts: dict[int, int] = {}
        self.stack: list[_Element] = []
        self.cut: list[tuple] = []  # formatting elements a block's end cut short
        self.in_body = False
        self._push("#root", {})

    def walk(self, html):
        at = 0
        for found in _MARKUP.finditer(html):
            if found.start() < at:
                continue  # inside a script or the like
            if found.start() > at:
                self._text(unescape(html[at : found.start()]))
            at = found.end()
            end_tag, tag, attrs = found.group(1), found.group(2) or found.group(4), found.group(3) or found.group(5)
            if end_tag:
                self._end(end_tag.lower())
            elif tag:
                tag = tag.lower()
                values = {}
                for name, a, b, c in _ATTRIBUTE.findall(attrs) if attrs else ():
                    values.setdefault(name.lower(), unescape(a or b or c))
                self._start(tag, values, attrs)
                if tag in RAW:
                    close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    stop = close.start() if close else len(html)
                    if stop > at:
                        raw = html[at:stop]
                        self._text(unescape(raw) if tag in ("title", "textarea") else raw)
                    at = stop
        if at < len(html):
            self._text(unescape(html[at:]))
        while len(self.stack) > 1:
            self._pop(False)
        self.lasts[0] = len(self.rows) - 1

    def _emit(self, kind, tag, edge, attrs=None, text=None, element=None, number=0):
        ident, top = len(self.rows), self.stack[-1]
        owner = element or top
        parent = top.id if element is not top else (self.stack[-2].id if len(self.stack) > 1 else -1)
        own = element or top
        quiet = own.quiet or tag in QUIET
        linked = own.linked or (element is None and top.tag == "a")
        self.rows.append(
            (kind, ident, ident if kind == "text" or not element else owner.id, parent, edge, top.block,
             top.item, top.lists, top.quotes, top.pre, quiet, linked, number, tag, attrs, text)
        )

    def _number(self, tag, attrs):
        holder = {"li": ("ol", "ul"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(tag)
        near = next((e for e in reversed(self.stack) if e.tag in holder), None) if holder else None
        if near is None or near.tag == "ul":
            return 0
        if near.tag == "ol" and not near.count and near.attrs.get("start", "").isdigit():
            near.count = int(near.attrs["start"]) - 1
        near.count += 1
        return near.count

    def _push(self, tag, attrs):
        around = self.stack[-1] if self.stack else None
        number = self._number(tag, attrs)
        is_edge = around is None or (tag in BLOCK and not around.cell)
        element = _Element(tag, attrs, len(self.rows), around, is_edge)
        self.stack.append(element)
        self._emit("open", tag, is_edge, attrs, element=element, number=number)

    def _pop(self, cut_short):
        element = self.stack.pop()
        self.lasts[element.id] = len(self.rows)
        is_edge = element.block == element.id
        self._emit("close", element.tag, is_edge, element.attrs, element=element)
        kept = (element.tag, element.attrs)
        if cut_short and element.tag in FORMATTING and kept not in self.cut:
            self.cut.append(kept)

    def _close(self, depth):
        """Close the element at a depth and, before it, those left open inside."""
        before = len(self.cut)
        while len(self.stack) > depth + 1:
            self._pop(True)
        self.cut[before:] = reversed(self.cut[before:])
        self._pop(False)

    def _close_nearest(self, tags, stops):
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                return self._close(depth)
            if self.stack[depth].tag in stops:
                return

    def _resume(self):
        pending, self.cut = self.cut, []
        for tag, attrs in pending:
            self._push(tag, attrs)

    def _ensure_body(self):
        if not self.in_body:
            self._open_body({})

    def _open_body(self, attrs):
        self._close_nearest({"head"}, ())
        self.in_body = True
        self._push("body", attrs)

    def _start(self, tag, attrs, raw_attrs):
        if tag in ("html", "head", "body") and (self.in_body or any(e.tag == tag for e in self.stack)):
            return
        if tag == "body":
            return self._open_body(attrs)
        if tag not in HEAD:
            self._ensure_body()
        if tag in BLOCK:
            self._close_nearest({"p"}, BLOCK - {"p"})
        if tag in IMPLIED_END:
            self._close_nearest(*IMPLIED_END[tag])
        if self.cut and (tag in FORMATTING or tag in ("br", "img")):
            self._resume()
        if tag in VOID:
            self.lasts[len(self.rows)] = len(self.rows)
            self._emit("void", tag, tag == "hr" and not self.stack[-1].cell, attrs)
        else:
            self._push(tag, attrs)
            if raw_attrs and raw_attrs.endswith("/") and tag not in HEAD | BLOCK | FORMATTING:
                self._pop(False)  # foreign content such as svg paths

    def _end(self, tag):
        if tag in ("html", "body"):
            return
        before = len(self.stack)
        # an inline end tag does not reach out of its block, a block's not out of its cell
        table_part = tag in IMPLIED_END or tag == "table"
        self._close_nearest({tag}, () if table_part else CELL if tag in BLOCK else BLOCK)
        if len(self.stack) == before and tag in FORMATTING:
            self.cut = [c for c in self.cut if c[0] != tag]

    def _text(self, data):
        if not data.isspace() and self.stack[-1].tag not in SILENT_HEAD:
            if self.stack[-1].tag != "body":
                self._ensure_body()
            if self.cut:
                self._resume()
        self._emit("text", "#text", False, text=data)


def _events(batch: pa.Array) -> pa.Array:
    offsets, rows, lasts = [0], [], []
    for html in batch.to_pylist():
        page = _Events()
        page.walk(html or "")
        rows.extend(page.rows)
        lasts.extend([page.lasts.get(r[2], r[1]) for r in page.rows])
        offsets.append(len(rows))
    columns = list(zip(*rows)) if rows else [()] * 16
    columns.insert(3, lasts)
    columns[15] = [list(a.items()) if a else [] for a in columns[15]]
    flat = pa.StructArray.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, EVENT)], fields=list(EVENT)
    )
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)


def _events_in_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for start in range(0, len(batch), PART):
            yield _events(batch.slice(start, PART))


def html_events(html: Column) -> Column:
    """Events of a page's tree, in document order."""
    return F.arrow_udf(_events_in_parts, EVENTS_TYPE)(html)
