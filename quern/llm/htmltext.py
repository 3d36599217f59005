"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied tags (``p``, ``li``, ``dd``,
``tr``, ``td``, ``option``, the end of ``head``) and puts misnested ends right.  Its
opened and closed elements drive a renderer that drops what isn't displayed, collapses
white space outside ``pre``, sets blocks on lines of their own and paragraphs,
headings, lists and tables apart by an empty line, marks list items and indents
nested ones, and pads table cells to their column's width.  Formulas (``math``) and
diagrams (``svg``) are inline; their annotations, titles and definitions aren't shown,
and a space parts the labels of a diagram and the cells of a formula.

Everything is a loop over one page with explicit stacks, so depth is bounded by
memory alone and time grows with the page's length.

Scale: one scan, no shuffle, nothing that grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import documents, field

#: Cells longer than this are neither padded nor counted for their column's width.
WIDEST_CELL = 80

#: Levels beyond which nested blocks are indented no further.
DEEPEST = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist rp noembed noframes".split())
FOREIGN = frozenset(("svg", "math"))
#: What isn't displayed inside these, besides what is hidden anyway, and what stands apart from its neighbours.
HIDDEN_FOREIGN = frozenset("annotation annotation-xml desc metadata defs symbol marker pattern mask clippath".split())
LABEL = frozenset("text mtd".split())
#: Elements that stand apart by an empty line, and others that begin and end a line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl menu figure xmp".split())
BLOCK = APART | frozenset("html body div section article header footer nav main aside address fieldset form li dt dd tr caption details summary figcaption legend hgroup center dir option optgroup textarea search dialog hr".split())
CLOSES_P = (BLOCK - frozenset("html body caption tr option optgroup textarea legend".split())) | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELL = frozenset(("td", "th"))
SECTION = frozenset(("thead", "tbody", "tfoot"))
SCOPE = frozenset("table td th caption html template object".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) with kind ``text``, ``raw``, ``start`` or ``end``; comments and declarations are left out."""
    at, n, loose, foreign = 0, len(html), False, 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        m = _NAME.match(html, lt)
        if not m:
            follows = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif follows in ("!", "?", "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        rest = None if loose else _REST.match(html, m.end())
        if rest:
            end = rest.end()
        else:
            # a quote is never closed: from here on tags end at the first '>'
            loose = True
            end = html.find(">", m.end()) + 1
            if not end:
                return
        name, raw = m[2].lower(), html[m.end() : end - 1]
        at = end
        if name in FOREIGN:
            foreign = max(0, foreign - 1) if m[1] else foreign + (not raw.endswith("/"))
        if m[1]:
            yield "end", name, ""
            continue
        yield "start", name, raw
        if name in RAW and not (foreign and raw.endswith("/")):
            close = RAW[name].search(html, end)
            stop = close.start() if close else n
            if name in ("textarea", "title", "xmp"):
                yield "raw", html[end:stop], name
            yield "end", name, ""
            at = n if not close else (html.find(">", stop) + 1 or n)


class _Box:
    """Lines of a flow: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []
        self.marker = ""
        self.space = self.gap = False

    def text(self, text: str) -> None:
        parts = _WHITE.split(text)
        lead, trail = parts[0] == "", parts[-1] == ""
        words = " ".join(p for p in parts if p)
        if not words:
            self.space = self.space or bool(self.line)
            return
        if self.line and (self.space or lead):
            self.line.append(" ")
        self.line.append(words)
        self.space = trail

    def end(self) -> None:
        """End the line, if there is anything on it."""
        if self.line:
            self.put("".join(self.line))
            self.line.clear()
        self.space = False

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        levels = self.indent[:-1] if self.marker else self.indent
        lead = "".join(levels[:DEEPEST]) + self.marker
        self.marker = ""
        self.lines.append((lead + text).rstrip(" "))

    def apart(self) -> None:
        self.end()
        if not self.marker:
            self.gap = True


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.captions: list[str] = []

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    widths[at] = max([widths.get(at, 0), *(len(x) for x in lines if len(x) <= WIDEST_CELL)])
                at += span
        out = list(self.captions)
        for row in self.rows:
            for k in range(max([0, *(len(lines) for lines, _ in row)])):
                at, cells = 0, []
                for lines, span in row:
                    width = sum(widths.get(i, 0) for i in range(at, at + min(span, 64))) + 2 * (min(span, 64) - 1)
                    cells.append((lines[k] if k < len(lines) else "").ljust(width))
                    at += span
                out.append("  ".join(cells).rstrip(" "))
        return out


class _Renderer:
    def __init__(self) -> None:
        self.root = _Box()
        self.boxes = [self.root]
        self.tables: list[_Table] = []
        self.lists: list[list] = []
        self.pre = 0
        self.off = 0
        self.foreign = 0

    def open(self, tag: str, raw: str) -> None:
        if self.off or self._hidden(tag, raw):
            self.off += 1
            return
        box = self.boxes[-1]
        self.foreign += tag in FOREIGN
        if self.foreign and tag in LABEL:
            box.space = bool(box.line)
        if tag == "br":
            if box.line:
                box.end()
            else:
                box.gap = box.gap or bool(box.lines)
        elif tag == "hr":
            box.apart()
            box.put("---")
            box.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            if self.lists:
                box.end()
            else:
                box.apart()
            start = _attributes(raw).get("start", "1") if tag == "ol" and "start" in raw else "1"
            self.lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            box.end()
            marker = "- "
            if self.lists and self.lists[-1][0] == "ol":
                marker = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            box.indent.append(" " * len(marker))
            box.marker = marker
        elif tag == "dd" or tag == "blockquote":
            box.apart() if tag == "blockquote" else box.end()
            box.indent.append("  ")
        elif tag == "table":
            box.apart()
            self.tables.append(_Table())
        elif tag == "tr":
            if self.tables:
                self.tables[-1].rows.append([])
        elif tag in CELL or tag == "caption":
            self.boxes.append(_Box())
        elif tag in ("pre", "xmp", "textarea"):
            box.apart() if tag != "textarea" else box.end()
            self.pre += 1
        elif tag in APART:
            box.apart()
        elif tag in BLOCK:
            box.end()

    def _hidden(self, tag: str, raw: str) -> bool:
        if tag in HIDDEN or self.foreign and tag in HIDDEN_FOREIGN:
            return True
        if tag == "dialog" or (tag == "input" and "hidden" in raw):
            return tag == "input" or "open" not in _attributes(raw)
        if "hidden" in raw.lower() or "style" in raw.lower():
            found = _attributes(raw)
            return "hidden" in found or bool(_NOT_SHOWN.search(found.get("style", "")))
        return False

    def close(self, tag: str, raw: str) -> None:
        if self.off:
            self.off -= 1
            return
        box = self.boxes[-1]
        if self.foreign and tag in LABEL:
            box.space = bool(box.line)
        self.foreign -= tag in FOREIGN
        if tag in ("ul", "ol", "menu", "dir"):
            box.end()
            if self.lists:
                self.lists.pop()
            box.gap = box.gap or not self.lists
        elif tag == "li":
            box.end()
            if box.marker:
                box.put("")
            box.indent.pop()
        elif tag == "dd" or tag == "blockquote":
            box.apart() if tag == "blockquote" else box.end()
            box.indent.pop()
        elif tag in CELL or tag == "caption":
            box.end()
            self.boxes.pop()
            if not self.tables:
                for line in box.lines:
                    self.boxes[-1].put(line)
            elif tag == "caption":
                self.tables[-1].captions += box.lines
            else:
                span = _attributes(raw).get("colspan", "1") if "colspan" in raw.lower() else "1"
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((box.lines, max(1, int(span)) if re.fullmatch(r"[0-9]{1,3}", span) else 1))
        elif tag == "table":
            for line in self.tables.pop().lines() if self.tables else ():
                box.put(line)
            box.gap = True
        elif tag in ("pre", "xmp", "textarea"):
            box.end()
            self.pre -= 1
            box.gap = box.gap or tag != "textarea"
        elif tag in APART:
            box.apart()
        elif tag in BLOCK:
            box.end()

    def text(self, text: str) -> None:
        if self.off:
            return
        if "&" in text:
            text = unescape(text)
        box = self.boxes[-1]
        if not self.pre:
            box.text(text)
            return
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            box.line.append(first)
        for line in more:
            if box.line:
                box.end()
            elif box.lines and not box.gap:
                box.lines.append("")
            if line:
                box.line.append(line)


class _Tree:
    """Open elements; decides which ends and starts a tag implies."""

    def __init__(self, out: _Renderer) -> None:
        self.out = out
        self.open: list[tuple[str, str]] = []
        self.count: dict[str, int] = {}

    def pop(self) -> str:
        tag, raw = self.open.pop()
        self.count[tag] -= 1
        self.out.close(tag, raw)
        return tag

    def push(self, tag: str, raw: str = "") -> None:
        self.open.append((tag, raw))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.out.open(tag, raw)

    def has(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str]) -> bool:
        """Whether one of the tags is open and no ``stop`` element lies inside it."""
        if not any(self.count.get(t) for t in tags):
            return False
        for tag, _ in reversed(self.open):
            if tag in tags:
                return True
            if tag in stop:
                return False
        return False

    def close(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str]) -> bool:
        if not self.has(tags, stop):
            return False
        while self.pop() not in tags:
            pass
        return True

    def start(self, tag: str, raw: str) -> None:
        if self.count.get("head") and tag not in HEAD:
            self.close(("head",), frozenset())
        if tag in ("html", "body", "head") and self.count.get(tag):
            return
        if tag in CLOSES_P:
            self.close(("p",), SCOPE | {"button"})
        if tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), SCOPE | {"dl"})
        elif tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        elif tag in ("option", "optgroup"):
            self.close(("option",), SCOPE | {"select"})
            if tag == "optgroup":
                self.close(("optgroup",), SCOPE | {"select"})
        elif tag in CELL or tag == "tr" or tag in SECTION or tag == "caption" or tag in ("colgroup", "col"):
            if not self.count.get("table"):
                return
            table = frozenset(("table",))
            if tag in CELL:
                self.close(("td", "th", "caption"), table | {"tr"})
                if not self.has(("tr",), table):
                    self.push("tr")
            else:
                self.close(("td", "th", "caption"), table)
                self.close(("tr",), table)
                if tag in SECTION:
                    self.close(tuple(SECTION), table)
        self.push(tag, raw)
        foreign = tag in FOREIGN or any(self.count.get(t) for t in FOREIGN)
        if tag in VOID or foreign and raw.endswith("/") and not self.count.get("foreignobject"):
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag in ("html", "body"):
            return
        elif tag in HEADINGS:
            self.close(tuple(HEADINGS), SCOPE)
        elif tag in ("table", "tr", "td", "th", "caption") or tag in SECTION:
            self.close((tag,), frozenset(("table",)) - {tag})
        else:
            self.close((tag,), SCOPE - {tag})

    def text(self, text: str) -> None:
        if self.count.get("head") and self.open[-1][0] == "head" and not text.isspace():
            self.pop()
        self.out.text(text)


def render(html: str | None) -> str | None:
    """The page's visible text; None for None."""
    if html is None:
        return None
    out = _Renderer()
    tree = _Tree(out)
    for kind, value, raw in tokens(html):
        if kind == "text":
            tree.text(value)
        elif kind == "raw":
            out.text(value)
        elif kind == "start":
            tree.start(value, raw)
        else:
            tree.end(value)
    while tree.open:
        tree.pop()
    out.root.end()
    lines = out.root.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).replace("\xa0", " ").lstrip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for each row.

    A null page gives a null text, an empty one an empty text.  Repeated rows stay
    separate; other columns are ignored.
    """
    src = documents(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return src.mapInArrow(run, T.StructType([field(src, "doc_id", "page_id"), T.StructField("text", T.StringType())]))
