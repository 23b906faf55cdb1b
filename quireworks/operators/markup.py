"""Web pages as ordered blocks, read as a stream of tags and text with a stack of open elements, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions import text as T

#: Elements that are left out with all they hold; elements that begin and end a block; elements without an end
IGNORED = set("script style iframe object embed head title template audio video canvas svg math rt rp applet noscript select datalist textarea".split())
BLOCKS = set(
    "p div section article header footer aside main figure figcaption address details summary dl dt dd center fieldset form caption nav hgroup body "
    "h1 h2 h3 h4 h5 h6 ul ol li blockquote pre hr table thead tbody tfoot tr td th".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is not markup; bullets by level; number formats by a list's type
RAW = set("script style iframe noscript textarea title".split())
BULLETS = "•◦▪"
NUMBERS = {"a": "lowerLetter", "A": "upperLetter", "i": "lowerRoman", "I": "upperRoman"}
#: Elements that a next one of their kind ends (the first of each group: a paragraph, by any block)
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": BLOCKS - {"body"}}
#: What bounds the search for such an element
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "table", "li", "blockquote", "div", "section", "article"}}
ENDS = {name: [inner for inner, enders in ENDED_BY.items() if name in enders] for name in BLOCKS}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
MOST_LEVEL, MOST_INDENT, MOST_SPAN, MOST_ALT = 8, 6, 64, 200

CELLS = "array<struct<row_no:int,column:int,colspan:int,rowspan:int,text:string>>"
LINKS = "array<struct<start:int,end:int,link:string>>"
BLOCK = f"struct<block_no:long,kind:string,level:int,marker:string,indent:int,text:string,cells:{CELLS},links:{LINKS}>"

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)> | </?[A-Za-z][^>]*+> | <[!?][^>]*+>""", re.S | re.X
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile("[ \t\n\r\f]+")
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def _decoded(text: str) -> str:
    """F28's rule: references with their semicolon; unknown ones stay."""
    def sign(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else 39 if m[3] == "apos" else name2codepoint.get(m[3], 0)
        return chr(code) if 0 < code < 0xD800 or 0xDFFF < code <= 0x10FFFF else m[0]

    return _REFERENCE.sub(sign, text) if "&" in text else text


def _attributes(source: str) -> dict[str, str]:
    """Attributes by exact name in lower case; of equal names the first."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), _decoded(m[2] or m[3] or m[4] or ""))
    return found


def _whole(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", value) else other


def _label(n: int, style: str) -> str:
    """A list number, as F15 shows it."""
    if style.endswith("Letter") and n > 0:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(97 + rest) + out
    elif style.endswith("Roman") and 0 < n < 4000:
        out = "".join(T.ROMAN[k][n // 10**k % 10] for k in (3, 2, 1, 0))
    else:
        return str(n)
    return out.upper() if style.startswith("upper") else out


def grid(rows: list[list[tuple[int, int, str]]]) -> Iterator[tuple[int, int, int, int, str]]:
    """Cells (colspan, rowspan, text) of a table's rows on its grid: a cell stands in the first column that neither the
    cells before it nor cells from above that reach down take."""
    free_from: dict[int, int] = {}
    for row_no, cells in enumerate(rows):
        column = 0
        for colspan, rowspan, text in cells:
            while free_from.get(column, 0) > row_no:
                column += 1
            yield row_no, column, colspan, rowspan, text
            for taken in range(column, column + colspan):
                free_from[taken] = max(free_from.get(taken, 0), row_no + rowspan)
            column += colspan


class _Page:
    """The state of reading one page: open elements, the block (or cell) being filled, and the blocks so far."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.headings: list[int] = []
        self.lists: list[list] = []  # [number format or None, next number]
        self.items: list[list] = []  # [level, marker not shown yet]
        self.links: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.size, self.spans = 0, []
        self.table: list | None = None
        self.cell: tuple[int, int] | None = None

    # --- text ---

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def last(self) -> str:
        return self.parts[-1][-1] if self.parts else "\n"

    def text(self, raw: str) -> None:
        if self.count["pre"]:
            kept = _decoded(raw.replace("\r\n", "\n").replace("\r", "\n"))
        else:
            kept = _SPACE.sub(" ", raw)
            kept = _decoded(kept[1:] if kept[:1] == " " and self.last() in " \n" else kept)
        if kept:
            self.add(kept)

    def line_end(self) -> None:
        if not self.count["pre"] and self.parts and self.parts[-1].endswith(" "):
            self.parts[-1] = self.parts[-1][:-1]
            self.size -= 1
            if not self.parts[-1]:
                self.parts.pop()
        self.add("\n")

    def taken(self) -> tuple[str, list]:
        """The text filled in so far, trimmed, with its links; what comes next begins anew."""
        whole, trim = "".join(self.parts), "\n" if self.count["pre"] else " \n"
        if self.links:
            self.spans.append((self.links[-1][0], self.size, self.links[-1][1]))
            self.links = [(0, link) for _, link in self.links]
        lead = len(whole) - len(whole.lstrip(trim))
        text = whole.strip(trim).replace("\xa0", " ")
        cut = lambda at: min(max(at - lead, 0), len(text))
        spans = [{"start": cut(a), "end": cut(b), "link": link} for a, b, link in self.spans if cut(b) > cut(a)]
        self.parts, self.size, self.spans = [], 0, []
        return text, spans

    def emit(self, kind: str, text: str = "", level: int = 0, marker: str = "", indent: int = 0, cells: list | None = None, links: list | None = None) -> None:
        self.blocks.append({"block_no": len(self.blocks), "kind": kind, "level": level, "marker": marker, "indent": indent, "text": text, "cells": cells or [], "links": links or []})

    def flush(self) -> None:
        """End of a block; inside a cell, of a line of it."""
        if self.cell:
            if self.parts and self.last() != "\n":
                self.line_end()
            return
        text, spans = self.taken()
        if not text.strip():
            return
        if self.headings:
            self.emit("HEADING", text, self.headings[-1], links=spans)
        elif self.items:
            level, marker = self.items[-1]
            self.items[-1][1] = ""
            self.emit("LIST_ITEM", text, level, marker, links=spans)
        else:
            self.emit("PARAGRAPH", text, indent=min(self.count["blockquote"], MOST_INDENT), links=spans)

    # --- tags ---

    def start(self, name: str, attrs: str) -> None:
        a = _attributes(attrs) if attrs else {}
        for inner in ENDS.get(name, ()):
            if self.count[inner] and self.within(inner):
                # a link that was not closed goes on behind the element that this one ends
                going_on = self.links[-1][1] if self.links and self.innermost(inner, "a") else None
                self.end(inner)
                if going_on is not None:
                    self.open.append("a")
                    self.count["a"] += 1
                    self.links.append((self.size, going_on))
        nested = self.count["table"] > 1 or (name == "table" and self.count["table"])
        if nested and self.table is not None and name in ("table", "tr", "td", "th"):
            if self.parts and self.last() not in " \n":
                self.add(" ")
        elif name in BLOCKS:
            self.flush()
        if name == "br":
            self.line_end()
        elif name == "hr":
            if not self.cell:
                self.emit("DIVIDER")
        elif name == "img":
            about = (a.get("alt") or a.get("title") or "").strip()[:MOST_ALT]
            if not self.cell and (about or a.get("src")):
                self.flush()
                self.emit("IMAGE", about)
        if name in VOID:
            return
        self.open.append(name)
        self.count[name] += 1
        if name in HEADINGS:
            self.headings.append(HEADINGS[name])
        elif name in ("ul", "ol"):
            self.lists.append([NUMBERS.get(a.get("type", "").strip(), "decimal") if name == "ol" else None, _whole(a.get("start"), 1)])
        elif name == "li":
            level = min(max(len(self.lists) - 1, 0), MOST_LEVEL)
            if self.lists and self.lists[-1][0]:
                n = _whole(a.get("value"), self.lists[-1][1])
                marker, self.lists[-1][1] = _label(n, self.lists[-1][0]) + ".", n + 1
            else:
                marker = BULLETS[level % len(BULLETS)]
            self.items.append([level, "" if self.cell else marker])
            if self.cell:
                self.add(marker + " ")
        elif name == "a":
            self.links.append((self.size, a.get("href", "").strip()))
        elif name == "table" and not nested:
            self.table = []
        elif name == "tr" and not nested and self.table is not None:
            self.table.append([])
        elif name in ("td", "th") and not nested and self.table is not None:
            if not self.table:
                self.table.append([])
            span = lambda which: min(max(_whole(a.get(which), 1), 1), MOST_SPAN)
            self.cell = span("colspan"), span("rowspan")

    def innermost(self, outer: str, name: str) -> bool:
        """Whether an element of this name is open inside the innermost one of the outer name."""
        for other in reversed(self.open):
            if other in (outer, name):
                return other == name
        return False

    def within(self, name: str) -> bool:
        """Whether an open element is not shut off by one that bounds it."""
        for other in reversed(self.open):
            if other == name:
                return True
            if other in SCOPE[name]:
                return False
        return False

    def end(self, name: str) -> None:
        """Close the innermost open element of this name, and what is still open inside it; another end only breaks blocks."""
        if not self.count[name]:
            if name in BLOCKS and not self.cell:
                self.flush()
            return
        if name not in BLOCKS:
            # the end of an inline element does not end the blocks begun inside it
            at = len(self.open) - 1
            while self.open[at] != name:
                at -= 1
            if any(other in BLOCKS for other in self.open[at:]):
                self.closed(name)
                del self.open[at]
                self.count[name] -= 1
                return
        while True:
            top = self.open[-1]
            self.closed(top)
            self.open.pop()
            self.count[top] -= 1
            if top == name:
                return

    def closed(self, name: str) -> None:
        nested = self.count["table"] > 1 and name in ("table", "tr", "td", "th")
        if name == "a":
            start, link = self.links.pop()
            if self.size > start:
                self.spans.append((start, self.size, link))
            return
        if nested:
            if self.parts and self.last() not in " \n":
                self.add(" ")
            return
        if name in ("td", "th") and self.cell and self.table:
            text, _ = self.taken()
            self.table[-1].append((*self.cell, text))
            self.cell = None
            return
        if name in BLOCKS:
            self.flush()
        if name in HEADINGS:
            self.headings.pop()
        elif name in ("ul", "ol"):
            self.lists.pop()
        elif name == "li":
            self.items.pop()
        elif name == "table":
            rows, self.table = [r for r in self.table or [] if r], None
            if rows:
                cells = [dict(zip(("row_no", "column", "colspan", "rowspan", "text"), c, strict=True)) for c in grid(rows)]
                self.emit("TABLE", "\n".join(" ".join(c[2] for c in r) for r in rows), cells=cells)


def page_blocks(html: str) -> list[dict]:
    """The blocks of one page, in one pass over its tags."""
    page, at, n = _Page(), 0, len(html)
    skipping, inside, inner = "", [], Counter()  # the element that is left out, and what is open inside it
    while at < n:
        m = _TOKEN.search(html, at)
        if not skipping and (m is None or m.start() > at):
            page.text(html[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower().rpartition(":")[2]
        if not name:
            continue
        if skipping:
            if m["end"]:
                if inner[name]:
                    while inside:
                        top = inside.pop()
                        inner[top] -= 1
                        if top == name:
                            break
                    continue
                if name != skipping and not page.count[name]:
                    continue
                own, skipping = name == skipping, ""
                if own:
                    continue
            elif skipping in ENDED_BY and name in ENDED_BY[skipping] and not any(inner[x] for x in SCOPE[skipping]):
                skipping = ""
            else:
                if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                    inside.append(name)
                    inner[name] += 1
                continue
        if m["end"]:
            page.end(name)
            continue
        a = _attributes(m["attrs"]) if "hidden" in m["attrs"].lower() or "display" in m["attrs"].lower() else {}
        if name in IGNORED or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
            if name in BLOCKS and not page.cell:
                page.flush()
            if name in VOID or m["attrs"].rstrip().endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            skipping, inside, inner = name, [], Counter()
            continue
        page.start(name, m["attrs"])
    while page.open:
        page.end(page.open[-1])
    page.flush()
    return page.blocks


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = pa.list_(pa.struct([("row_no", pa.int32()), ("column", pa.int32()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("text", pa.string())]))
    links = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("link", pa.string())]))
    types = {"block_no": pa.int64(), "kind": pa.string(), "level": pa.int32(), "marker": pa.string(), "indent": pa.int32(), "text": pa.string(), "cells": cells, "links": links}
    shape = pa.list_(pa.struct(list(types.items())))
    for batch in batches:
        # a page's blocks hold its text once more, so pages go on one by one
        for page_id, html in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()], pa.int64()), pa.array([page_blocks(html.as_py() or "")], shape)], ["page_id", "blocks"])


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with their blocks as an array: page_id, blocks.  See html_blocks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_read, f"page_id long, blocks array<{BLOCK}>")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Pages as ordered blocks: page_id, block_no, kind, level, marker, indent, text, cells, links.  No shuffle.

    Kinds: HEADING (level 1 to 6), PARAGRAPH (indent: quotes around it, 6 at most), LIST_ITEM (level of its list from 0,
    marker of its first block), TABLE (cells on its grid; text: rows as lines), IMAGE (its description), DIVIDER.
    Ignored elements, and those with an attribute named `hidden` or with display:none, go with all they hold, however
    deep.  White space is collapsed outside `pre`, `br` is a line end.  A link covers start to end of its block's text.
    A null page has no blocks.
    """
    return page_rows(pages).select("page_id", F.inline("blocks"))


def lay_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (page_id, table_no, cells: rows of cells) as cells on their grid."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for page, table, rows in zip(*[batch.column(c).to_pylist() for c in ("page_id", "table_no", "cells")], strict=True):
            for cell in grid([[(c["colspan"], c["rowspan"], c["text"]) for c in cells] for cells in rows]):
                for held, value in zip(out, (page, table, *cell), strict=True):
                    held.append(value)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["page_id", "table_no", "row_no", "column", "colspan", "rowspan", "text"])
