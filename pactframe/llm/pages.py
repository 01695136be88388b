"""Visible text of web pages: a tree with implied tags, rendered with its layout."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown.
UNSEEN = frozenset("head title script style template noscript datalist object iframe audio video canvas annotation annotation-xml".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th tbody thead tfoot").split())
#: Parts of a drawing that are never shown as they stand; of the others only text and embedded HTML hold words.
_UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker".split())
_DRAWN = frozenset("text foreignobject".split())
_FOREIGN = frozenset("svg math".split())
#: Inside these a drawing or formula holds HTML again.
_HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: HTML elements that end a drawing or formula they open in.
_BREAKS_OUT = frozenset((
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var").split())
#: Parts of a formula set apart from each other.
_APART = frozenset("mfrac mroot mtr mlabeledtr".split())
#: Blocks with an empty line around them.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: An opening tag that closes these open elements, looked for up to a boundary.
_P = frozenset(["p"])
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Parts of a table: what each is put in, and what is opened for it where that is left out.
_PLACE = {
    **{t: (frozenset(["tr"]), "tr") for t in ("td", "th")}, "tr": (SECTIONS, "tbody"), "col": (frozenset(["colgroup"]), "colgroup"),
    **{t: (frozenset(["table"]), "") for t in ("tbody", "thead", "tfoot", "colgroup", "caption")},
}
#: Open elements that only hold parts of a table; anything else inside them goes before the table.
_GRID = frozenset("table tbody thead tfoot tr colgroup".split())
_CELLS = frozenset("td th caption".split())
#: A part of a table ends or finds its place inside the nearest of these.
_TABLE = frozenset("table template".split())
_ENDS_P = BLOCK - frozenset("html body li dd dt tr td th tbody thead tfoot caption legend".split())
_SCOPE = frozenset("table td th caption html button".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
#: The white space that HTML collapses; a no-break space is a character like any other.
SPACE = " \t\n\f\r"
_SPACES = re.compile(f"[{SPACE}]+")
#: Columns a line is indented by at most: deeper lists and quotes stay there.
WIDEST_INDENT = 240
_CUT_TAG = re.compile(r"</?[a-zA-Z][^>]*\Z")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class TreeBuilder(HTMLParser):
    """Elements as a browser would nest them: end tags that are left out are implied."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: Where the open elements of a tag are, outermost first.
        self.at: dict[str, list[int]] = {}

    def close_up_to(self, depth: int) -> None:
        for node in self.open[max(depth, 1):]:
            self.at[node.tag].pop()
        del self.open[max(depth, 1):]

    def nearest(self, tags: frozenset[str]) -> int:
        """Depth of the innermost open element of ``tags``; 0 where none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def imply(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Close the outermost of ``tags`` that is open inside the nearest of ``bounds``."""
        bound = self.nearest(bounds)
        inside = [depths[bisect_right(depths, bound)] for t in tags if (depths := self.at.get(t)) and depths[-1] > bound]
        if inside:
            self.close_up_to(min(inside))

    def place(self, tag: str) -> None:
        """Close what is open beyond the place of a part of the innermost table, and open what it is put in."""
        table = self.nearest(_TABLE)
        if self.open[table].tag != "table":
            return
        within, implied = _PLACE[tag]
        depth = self.nearest(within)
        if depth < table:
            self.place(implied)
            self.add(Node(implied, {}), True)
        else:
            self.close_up_to(depth + 1)

    def add(self, node: Node, opened: bool, fostered: bool = False) -> None:
        if fostered:
            self.foster(node)
        else:
            self.open[-1].children.append(node)
        if opened:
            self.at.setdefault(node.tag, []).append(len(self.open))
            self.open.append(node)

    def fosters(self) -> bool:
        """Whether the current element is a table or a part of it that cannot hold other content."""
        return self.open[-1].tag in _GRID and self.open[self.nearest(_TABLE)].tag == "table"

    def foster(self, child: Node | str) -> None:
        """Put a child before the innermost table, which is its parent's last child."""
        self.open[self.nearest(_TABLE) - 1].children.insert(-1, child)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in _HEAD:
            self.close_up_to(len(self.open) - 1)
        if tag in _BREAKS_OUT and (at := self.nearest(_FOREIGN)) > self.nearest(_HTML_INSIDE):
            self.close_up_to(at)
        if tag == "select":
            self.imply(frozenset([tag]), _SCOPE)
        if tag == "table" and self.open[at := self.nearest(_TABLE | _CELLS)].tag == "table":
            self.close_up_to(at)
        if tag in _ENDS_P:
            self.imply(_P, _SCOPE)
        if tag in _CLOSES:
            self.imply(*_CLOSES[tag])
        if tag in _PLACE:
            self.place(tag)
        node, opened = Node(tag, dict(attrs)), tag not in VOID
        fostered = tag not in _PLACE and tag not in _HEAD and self.fosters()
        # A form between the parts of a table is closed at once.
        self.add(node, opened and not (fostered and tag == "form"), fostered)
        if opened and tag == "textarea":  # its tags are text
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag != "textarea" and (tag in _FOREIGN or self.nearest(_FOREIGN) > self.nearest(_HTML_INSIDE - {tag})):
            self.close_up_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.at.get("p"):
            self.handle_starttag("p", [])
        depth = self.nearest(frozenset([tag]))
        stop = _TABLE if tag in _PLACE or tag in _TABLE else _TABLE | _CELLS
        if depth and depth >= self.nearest(stop):
            self.close_up_to(depth)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "textarea":
            data = unescape(data)
        if self.open[-1].tag == "head" and data.strip(SPACE):
            self.close_up_to(len(self.open) - 1)
        if data.strip(SPACE) and self.fosters():
            self.foster(data)
        else:
            self.open[-1].children.append(data)


# -- what is shown -----------------------------------------------------------

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: A type or *, then ids and classes: the selectors that are looked at, alone or in lists.
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_PART = re.compile(r"[.#][\w-]+")
_STYLED = frozenset("display visibility white-space".split())


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """The last value of each property that matters here, and whether it is important."""
    found: dict[str, tuple[bool, str]] = {}
    for item in _COMMENT.sub("", text).split(";"):
        name, colon, value = item.partition(":")
        name, value = name.strip(SPACE).lower(), value.strip(SPACE).lower()
        if colon and name in _STYLED:
            important = value.endswith("important") and value[:-9].rstrip(SPACE).endswith("!")
            value = value[:-9].rstrip(SPACE)[:-1].rstrip(SPACE) if important else value
            if important or name not in found or not found[name][0]:
                found[name] = important, value
    return found


def rules_of(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the plain rules of a style sheet; at-rules and what they hold are left out."""
    sheet = _COMMENT.sub("", sheet)
    at = 0
    while (open_ := sheet.find("{", at)) >= 0:
        head = sheet[at:open_].rpartition(";")[2].strip(SPACE)
        if head.startswith("@"):
            depth, end = 1, open_ + 1
            while depth and end < len(sheet):
                depth += (sheet[end] == "{") - (sheet[end] == "}")
                end += 1
            at = end
            continue
        close = sheet.find("}", open_)
        close = len(sheet) if close < 0 else close
        yield head, sheet[open_ + 1:close]
        at = close + 1


class Styles:
    """The style sheets of a page: rules by the id, class or type that their selector needs."""

    def __init__(self, sheets: list[str]) -> None:
        self.rules: dict[str, list[tuple[tuple[int, int, int, int], str, frozenset[str], dict[str, tuple[bool, str]]]]] = {}
        n = 0
        for sheet in sheets:
            for selectors, body in rules_of(sheet):
                said = declarations(body)
                for selector in selectors.split(",") if said else ():
                    if not (match := _SELECTOR.fullmatch(selector.strip(SPACE))) or not match[0]:
                        continue
                    kind, parts = (match[1] or "*").lower(), frozenset(_PART.findall(match[2]))
                    n += 1
                    weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), int(kind != "*"), n)
                    self.rules.setdefault(min(parts, default=kind), []).append((weight, kind, parts, said))

    def of(self, node: Node) -> dict[str, str]:
        """The winning values of an element's own properties: important ones, its style attribute, then the heaviest rule."""
        best: dict[str, tuple[tuple, str]] = {}
        if self.rules:
            names = {f".{c}" for c in _SPACES.split(node.attrs.get("class") or "") if c}
            if node.attrs.get("id"):
                names.add(f"#{node.attrs['id']}")
            for key in (node.tag, "*", *names):
                for weight, kind, parts, said in self.rules.get(key, ()):
                    if kind in ("*", node.tag) and parts <= names:
                        for name, (important, value) in said.items():
                            rank = (important, False, weight)
                            if name not in best or best[name][0] < rank:
                                best[name] = rank, value
        if node.attrs.get("style"):
            for name, (important, value) in declarations(node.attrs["style"]).items():
                rank = (important, True, ())
                if name not in best or best[name][0][:2] <= rank[:2]:
                    best[name] = rank, value
        return {name: value for name, (_, value) in best.items()}


#: A step of the rendering: it yields the steps it has to wait for.
Step = Iterator["Step"]


def run(step: Step) -> None:
    """Carry a step out with all it waits for, on a stack of its own: pages may nest as deep as they like."""
    stack = [step]
    while stack:
        deeper = next(stack[-1], None)
        if deeper is None:
            stack.pop()
        else:
            stack.append(deeper)


class Writer:
    """Lines of text with pending breaks and collapsed white space."""

    def __init__(self, styles: Styles, shown: bool = True) -> None:
        self.styles, self.shown = styles, shown
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = 0
        self.mark = ""

    def text(self, data: str) -> None:
        if not self.shown:
            return
        parts = [p for p in _SPACES.split(data) if p]
        if data[:1] in SPACE or not parts:
            self.space = True
        for part in parts:
            if self.words and not self.space:
                self.words[-1] += part
            else:
                self.words.append(part)
            self.space = True
        if parts:
            self.space = data[-1:] in SPACE

    def flush(self) -> None:
        if self.words:
            self.put(" ".join(self.words))
        self.words, self.space = [], False

    def put(self, line: str) -> None:
        """A finished line, after the empty lines that are due."""
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        before = " " * (min(self.indent, WIDEST_INDENT) - len(self.mark)) + self.mark
        self.lines.append(before + line)
        self.mark = ""

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap) if self.lines else 0

    def done(self) -> str:
        self.flush()
        return "\n".join(line.rstrip(SPACE) for line in self.lines)

    def style(self, node: Node) -> dict[str, str] | None:
        """An element's own style; None where neither it nor anything in it is shown."""
        if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attrs:
            return None
        found = self.styles.of(node)
        if found.get("display", "none" if "hidden" in node.attrs else "") == "none":
            return None
        return found

    def show(self, style: dict[str, str]) -> bool:
        """Take over an element's visibility, which its content inherits; returns what was before."""
        was = self.shown
        said = style.get("visibility")
        if said in ("hidden", "collapse"):
            self.shown = False
        elif said == "visible" or said == "initial":
            self.shown = True
        return was


def write(node: Node, out: Writer) -> Step:
    """Append an element's visible text to the writer."""
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        style = out.style(child)
        if style is None:
            continue
        was = out.show(style)
        yield element(child, style, out)
        out.shown = was


def element(child: Node, style: dict[str, str], out: Writer) -> Step:
    tag = child.tag
    if tag == "br":
        if out.words:
            out.flush()
        elif out.lines:
            out.gap = max(out.gap, 1)
    elif tag == "pre" or tag in BLOCK and tag not in ("table", "ul", "ol", "menu", "dir") and style.get("white-space") in ("pre", "pre-wrap", "break-spaces"):
        preformatted(child, out, 1 if tag in SPACED else 0)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield listed(child, out)
    elif tag == "table":
        yield tabled(child, out)
    elif tag == "svg":
        yield drawn(child, out)
    elif tag == "textarea":
        preformatted(child, out, 0)
    elif tag == "details" and "open" not in child.attrs:
        out.block(0)
        first = next((c for c in child.children if isinstance(c, Node) and c.tag == "summary"), None)
        if first is not None:
            yield write(wrapped(first), out)
        out.block(0)
    elif tag in _APART:
        if tag in ("mtr", "mlabeledtr"):
            out.block(0)
        for part in child.children:
            out.space = True
            yield write(wrapped(part), out)
        out.space = True
    elif tag in BLOCK or tag in ("option", "optgroup", "select", "mtable"):
        gap = 1 if tag in SPACED else 0
        out.block(gap)
        deeper = 4 if tag in ("blockquote", "dd") else 0
        out.indent += deeper
        if tag == "hr" and out.shown:
            out.put("---")
        yield write(child, out)
        out.block(gap)
        out.indent -= deeper
    else:
        yield write(child, out)


def drawn(node: Node, out: Writer) -> Step:
    """The texts of a drawing, each on lines of its own."""
    for child in node.children:
        if isinstance(child, str) or child.tag in _UNDRAWN or (style := out.style(child)) is None:
            continue
        was = out.show(style)
        if child.tag in _DRAWN:
            out.block(0)
            inner = Node("div", {})
            inner.children = [c for c in child.children if isinstance(c, str) or c.tag not in _UNDRAWN]
            yield write(inner, out)
            out.block(0)
        else:
            yield drawn(child, out)
        out.shown = was


def plain(node: Node, out: Writer) -> str:
    """The shown text below an element, white space as it stands."""
    parts: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(c, out.shown) for c in reversed(node.children)]
    was = out.shown
    while stack:
        child, out.shown = stack.pop()
        if isinstance(child, str):
            parts.append(child if out.shown else "")
        elif child.tag == "br":
            parts.append("\n")
        elif (style := out.style(child)) is not None:
            out.show(style)
            stack.extend((c, out.shown) for c in reversed(child.children))
    out.shown = was
    return "".join(parts)


def preformatted(node: Node, out: Writer, gap: int) -> None:
    """Lines as they stand; an element without any leaves only its spacing."""
    out.block(gap)
    text = plain(node, out).removeprefix("\n").rstrip("\n")
    for line in text.split("\n") if text or out.shown else ():
        out.put(line)
    out.block(gap)


def whole(value: str | None, most: int = 9) -> int | None:
    """An attribute's integer, if it is one of at most ``most`` digits."""
    text = (value or "").strip(SPACE)
    digits = text[1:] if text[:1] == "-" else text
    return int(text) if digits.isascii() and digits.isdecimal() and len(digits) <= most else None


def listed(node: Node, out: Writer) -> Step:
    """Items with bullets or numbers, nested lists indented below their item."""
    out.flush()
    inside = out.indent > 0 and out.mark == ""
    out.block(0 if inside else 1)
    items = [out.style(c) if isinstance(c, Node) and c.tag == "li" else None for c in node.children]
    step = -1 if "reversed" in node.attrs else 1
    start = whole(node.attrs.get("start"))
    number = start if start is not None else sum(i is not None for i in items) if step < 0 else 1
    for child, style in zip(node.children, items):
        if style is not None:
            if (own := whole(child.attrs.get("value"))) is not None:
                number = own
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            was, before, above = out.mark, out.show(style), out.indent
            out.block(0)
            if out.shown:
                out.indent = min(above, WIDEST_INDENT) + len(mark)
                out.mark = was + mark if out.indent <= WIDEST_INDENT else mark
                out.indent = min(out.indent, WIDEST_INDENT)
            yield write(child, out)
            out.block(0)
            if out.mark and out.shown:
                out.put("")
            out.indent, out.shown = above, before
        elif isinstance(child, str) and child.strip(SPACE) or isinstance(child, Node) and child.tag != "li":
            yield write(wrapped(child), out)
    out.block(0 if inside else 1)


def groups_of(node: Node, out: Writer) -> list[list[tuple[Node, bool]]]:
    """The rows of a table by row group, each with its visibility."""
    groups: list[list[tuple[Node, bool]]] = []
    loose: list[tuple[Node, bool]] = []
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", *SECTIONS) or (style := out.style(child)) is None:
            continue
        was = out.show(style)
        if child.tag == "tr":
            if not loose:
                groups.append(loose)
            loose.append((child, out.shown))
        else:
            loose = []
            rows = []
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr" and (own := out.style(row)) is not None:
                    before = out.show(own)
                    rows.append((row, out.shown))
                    out.shown = before
            groups.append(rows)
        out.shown = was
    return groups


def strays_of(node: Node, out: Writer) -> Iterator[Node | str]:
    """What is in a table or a section of it and is no part of the grid."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", *SECTIONS, "colgroup", "col"):
            yield child
        elif child.tag in SECTIONS and out.style(child) is not None:
            yield from (c for c in child.children if isinstance(c, str) or c.tag not in ("tr", *SECTIONS))


def tabled(node: Node, out: Writer) -> Step:
    """Cells padded to the width of their column; a cell of several lines takes several lines.

    A cell that spans columns or rows keeps the places it spans empty, so what
    follows stands in its own column.
    """
    out.block(1)
    strays = Node("div", {})
    strays.children.extend(strays_of(node, out))
    yield write(strays, out)
    out.block(0)
    grid: list[dict[int, list[str]]] = []
    for group in groups_of(node, out):
        taken: dict[int, int] = {}  # column to the rows that a cell above still spans
        for n, (row, shown) in enumerate(group):
            cells: dict[int, list[str]] = {}
            spans: dict[int, int] = {}
            at = 0
            for cell in row.children:
                style = {} if isinstance(cell, str) else out.style(cell)
                if style is None or isinstance(cell, str) and not cell.strip(SPACE):
                    continue
                while at in taken:
                    at += 1
                own = isinstance(cell, Node) and cell.tag in ("td", "th")
                inner = Writer(out.styles, shown)
                if own:
                    inner.show(style)
                yield write(cell if own else wrapped(cell), inner)
                cells[at] = inner.done().split("\n")
                attrs = cell.attrs if own else {}
                wide, deep = whole(attrs.get("colspan"), 5) or 1, whole(attrs.get("rowspan"), 5)
                deep = len(group) - n if deep == 0 else min(max(deep or 1, 1), len(group) - n)
                for _ in range(min(max(wide, 1), 1000)):
                    if deep > 1:
                        spans[at] = deep
                    at += 1
            for c, deep in spans.items():
                taken[c] = max(taken.get(c, 1), deep)
            taken = {c: left - 1 for c, left in taken.items() if left > 1}
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for i, lines in cells.items():
            widths[i] = max(widths.get(i, 0), *map(len, lines))
    order = sorted(widths)
    for cells in grid:
        for n in range(max(map(len, cells.values()), default=0)):
            line = "  ".join((cells[i][n] if i in cells and n < len(cells[i]) else "").ljust(widths[i]) for i in order).rstrip(SPACE)
            if line:
                out.put(line)
    out.block(1)


def wrapped(child: Node | str) -> Node:
    node = Node("div", {})
    node.children = [child]
    return node


def sheets_of(root: Node) -> list[str]:
    """The texts of all style elements in order; those in templates and scripts' fallbacks do not count."""
    found: list[str] = []
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if node.tag == "style":
            found.append("".join(c for c in node.children if isinstance(c, str)))
        elif node.tag not in ("template", "noscript"):
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def visible_text(html: str) -> str:
    """All visible text of a page, laid out in lines."""
    builder = TreeBuilder()
    builder.feed(html)
    if _CUT_TAG.match(builder.rawdata):  # the page ends inside a tag
        builder.rawdata = ""
    builder.close()
    out = Writer(Styles(sheets_of(builder.root)))
    run(write(builder.root, out))
    return out.done()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_lines`` of every page.

    Defined results: a null page has a null text and no lines; an empty page,
    or one without visible text, an empty text and no lines; repeated rows are
    rendered alike; other columns are not looked at. Broken mark-up never fails:
    what a browser would show as text is text, however deep it is nested. Of style
    sheets, rules whose selector is a type with ids and classes decide what is
    shown; rules with combinators or inside at-rules are not looked at.
    """
    small_batches(pages.sparkSession)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else visible_text(h) for h in map(lambda v: v.as_py(), batch.column(2))]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(apply, schema)
