"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer that
keeps block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, table

#: Cells are padded to their column's widest as long as a table's padding stays within so many times
#: its text; beyond that the widest columns are padded only as far as fits, but up to PADDED at
#: least: one very long cell would else make every row of its table as long.
MOST_PADDING = 8
PADDED = 60
GAP = "  "
#: Lists and quotations indent their lines up to this depth; what is deeper is as far in, and its items
#: keep their markers. So a line is never longer than its text by more than a bound.
INDENTS = 24

# The classes of elements in the HTML standard that matter to text and its layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title base link meta style script template noembed noframes iframe object video audio canvas datalist rp area param source track colgroup col".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul xmp listing plaintext".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir fieldset xmp listing plaintext hr".split())
CLOSES_P = BLOCKS - {"body", "html", "optgroup", "legend", "dd", "dt", "li"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
KEEPS_SPACE = frozenset("pre textarea xmp listing plaintext".split())
HEAD_ONLY = frozenset("base link meta title style script template noembed noframes".split())
#: A new one of these ends an open one of those, unless a list or block of its own is between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
BARRIERS = (BLOCKS - {"address", "div", "p", "li", "dt", "dd", "optgroup"}) | {"select", "button"}

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?)?")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_VISIBILITY = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?(?=;|$)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT_RULE = re.compile(r"@[^{};]*+(?:;|\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}?|\Z)")
_RULE = re.compile(r"([^{}]++)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"[.#]?-?[A-Za-z_][\w-]*")
_SHOWN = re.compile(r"[^ \t\n\f\r]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Flow:
    """Lines of text in the making: one for the page, and one for each cell and caption."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.space = self.blank = False
        self.prefixes: list[list[str | None]] = []  # [marker of the first line, of the others]
        self.late: list[list[str | None]] = []  # of those deeper than INDENTS the ones whose marker is still to come

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._add(first)
            for line in more:
                self.end_line(force=True)
                self._add(line)
            return
        parts = _SPACES.sub(" ", text)
        if parts[:1] == " ":
            self.space = self.space or bool(self.run)
            parts = parts[1:]
        if not parts:
            return
        trailing = parts[-1] == " "
        self._add(parts[:-1] if trailing else parts)
        self.space = trailing

    def _add(self, text: str) -> None:
        if text:
            if self.space and self.run:
                self.run.append(" ")
            self.space = False
            self.run.append(text)

    def end_line(self, force: bool = False) -> None:
        """End the line if there is one; force: also an empty one."""
        line = "".join(self.run).replace("\xa0", " ").rstrip()
        self.run, self.space = [], False
        if line or force:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if not line:
            self.lines.append("")
            return
        marks = []
        for prefix in self.prefixes[:INDENTS]:
            marks.append(prefix[1] if prefix[0] is None else prefix[0])
            prefix[0] = None
        marks += [prefix[0] for prefix in self.late]
        self.late.clear()
        self.lines.append("".join(marks) + line)

    def indent(self, marker: str | None, others: str) -> None:
        self.prefixes.append([marker, others])
        if len(self.prefixes) > INDENTS and marker is not None:
            self.late.append(self.prefixes[-1])

    def outdent(self) -> None:
        if self.prefixes:
            gone = self.prefixes.pop()
            if self.late and self.late[-1] is gone:
                self.late.pop()

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Grid:
    """A table: cells come by rows; lines() aligns them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.caption: list[str] = []
        self.cell: tuple[int, int, Flow] | None = None
        self.group: Element | None = None  # the open row group and row
        self.row: Element | None = None

    def end_cell(self) -> None:
        if self.cell:
            self.rows[-1].append((self.cell[0], self.cell[1], self.cell[2].done()))
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        self.row = None

    def end_group(self) -> None:
        self.end_row()
        self.group = None

    def start_row(self, row: Element) -> None:
        self.row = row
        if not row.hidden or row.collapsed:
            self.rows.append([])

    @staticmethod
    def _most(widths: dict[int, int], ends: dict[int, int], room: int) -> int:
        """The width up to which all columns can be padded within room: a column costs its width
        in each line that goes on after it."""
        beyond, lines = [], 0
        for c in sorted(widths, reverse=True):
            beyond.append((widths[c], lines))
            lines += ends.get(c, 0)
        over = sum(n for _, n in beyond)
        for width, n in sorted(beyond):
            if width * over > room:
                return max(PADDED, room // over)
            room -= width * n
            over -= n
        return max(widths.values(), default=0)

    def lines(self) -> list[str]:
        placed, taken, widths = [], {}, {}  # taken: column to the rows that a cell above still holds
        size, ends = 0, {}  # of the text without spaces; last column to the number of lines
        for cells in self.rows:
            column, row, last = 0, [], {}
            for across, down, lines in cells:
                while taken.get(column, 0) > 0:
                    column += 1
                row.append((column, lines))
                if across == 1:
                    widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
                for k, line in enumerate(lines):
                    if line:
                        size += len(line) - line.count(" ")
                        last[k] = column
                for c in range(column, column + across):
                    taken[c] = max(taken.get(c, 0), down)
                    widths.setdefault(c, 0)
                column += across
            placed.append(row)
            for c in last.values():
                ends[c] = ends.get(c, 0) + 1
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
        most = self._most(widths, ends, MOST_PADDING * size)
        offsets, at = {}, 0
        for c in sorted(widths):
            offsets[c] = at
            at += min(most, widths[c]) + len(GAP) if widths[c] else 0
        out = list(self.caption)
        for row in placed:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                line = ""
                for column, lines in row:
                    if k < len(lines) and lines[k]:
                        if line:
                            line = line.ljust(offsets[column]) if len(line) + len(GAP) <= offsets[column] else line + GAP
                        else:
                            line = " " * offsets[column]
                        line += lines[k]
                out.append(line.rstrip())
        return out


class Element:
    """hidden: neither it nor what is in it shows; unseen: its own text doesn't but takes its room,
    and what is in it may show; collapsed: a hidden row whose cells take their columns."""

    __slots__ = ("name", "hidden", "unseen", "collapsed", "keep", "flow", "own", "count", "option", "select", "outer", "rank", "chosen", "shown")

    def __init__(self, name: str, hidden: bool, unseen: bool, keep: bool = False, flow: Flow | None = None) -> None:
        self.name, self.hidden, self.unseen, self.keep, self.flow = name, hidden, unseen, keep, flow
        self.collapsed = False
        self.count: int | None = None  # of an ordered list
        self.option: str | None = None
        self.select: Element | None = None  # of an option


def _style(style: str) -> dict[str, tuple[bool, str]]:
    """The properties of a style that decide on visibility, and whether they are important; of
    several the last important one, else the last, holds."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in _VISIBILITY.findall(style):
        if important or not found.get(name.lower(), (False, ""))[0]:
            found[name.lower()] = (bool(important), value.lower())
    return found


def _number(text: str | None, least: int, most: int, default: int) -> int:
    match = re.match(r"\s*\+?(-?[0-9]{1,9})", text or "")
    return min(most, max(least, int(match[1]))) if match else default


class Page:
    """The tree builder. Only the open elements are held; text goes to the flow that it is in as
    it comes, so memory and time follow the page's length however deep it is nested. What hides an element
    is its `hidden` attribute, its style, and the rules of style elements before it (Page.stylesheet)."""

    def __init__(self) -> None:
        self.flow = Flow()
        self.open: list[Element] = []
        self.scopes: list[dict[str, int]] = [{}]  # names open since the last table cell or caption
        self.grids: list[Grid] = []
        self.places: dict[str, list[int]] = {name: [] for names in SIBLINGS.values() for name in names}
        self.barriers: list[int] = []  # where such elements and barriers are open, innermost last
        self.styles: dict[str, dict[str, tuple[bool, int, str]]] = {}  # selector to property: important, order, value
        self.rules = 0
        self.lists: list[Element] = []  # the open lists and selects, innermost last
        self.selects: list[Element] = []

    # Elements.

    def _push(self, element: Element) -> None:
        if element.name in self.places:
            self.places[element.name].append(len(self.open))
        if element.name in BARRIERS or element.flow is not None:
            self.barriers.append(len(self.open))
        self.open.append(element)
        self.scopes[-1][element.name] = self.scopes[-1].get(element.name, 0) + 1
        if element.name in LISTS:
            self.lists.append(element)
        elif element.name == "select":
            self.selects.append(element)

    def _pop(self) -> Element:
        element = self.open.pop()
        name = element.name
        for held in (self.places.get(name), self.barriers):
            if held and held[-1] == len(self.open):
                held.pop()
        if element.flow is not None:  # a cell or caption: back to the flow around it
            self.scopes.pop()
            self.flow = element.flow
        self.scopes[-1][name] -= 1
        if name in LISTS:
            self.lists.pop()
        elif name == "select":
            self.selects.pop()
        if name == "table":
            self._end_table()
        elif name in LISTS and not element.hidden:
            self.flow.end_line()
            if not (self.flow.prefixes and self._depth()):  # lists within lists have no space around
                self.flow.gap()
        elif name in ("li", "dd", "blockquote"):
            self.flow.end_line()
            self.flow.outdent()
            if name == "blockquote" and not element.hidden:
                self.flow.gap()
        elif name == "option" and element.select is not None:
            self._end_option(element, element.select)
        elif name == "select" and element.option == "one":
            if element.shown:  # in a box of its own
                self.flow.text(f" {element.shown} ", False)
        elif not element.hidden and name in BLOCKS:
            self.flow.gap() if name in SPACED else self.flow.end_line()
        return element

    def _depth(self) -> int:
        return sum(self.scopes[-1].get(name, 0) for name in LISTS)

    def _pop_to(self, name: str) -> None:
        while self._pop().name != name:
            pass

    def _is_open(self, name: str) -> bool:
        return self.scopes[-1].get(name, 0) > 0

    # Options.

    def _start_option(self, element: Element, select: Element, attributes: dict[str, str]) -> None:
        """Of a list every option shows in a line; of a closed one the last that is selected, else
        the first that isn't disabled, else the first, even if it is hidden in the opened list."""
        element.select = select
        if select.option == "list":
            if not element.hidden:
                self.flow.end_line()
            return
        disabled = "disabled" in attributes or self.open[-1].name == "optgroup" and self.open[-1].option == "disabled"
        rank = 3 if "selected" in attributes else 1 if disabled else 2
        if rank > select.rank or rank == 3:
            select.rank, select.chosen = rank, element
        element.hidden, element.unseen = select.hidden, select.unseen
        element.outer, self.flow = self.flow, Flow()

    def _end_option(self, element: Element, select: Element) -> None:
        if select.option == "list":
            if not element.hidden:
                self.flow.end_line()
            return
        lines = self.flow.done()
        self.flow = element.outer
        if select.chosen is element:
            select.shown = " ".join(line.strip() for line in lines)

    # Tables.

    def _end_table(self) -> None:
        grid = self.grids.pop()
        grid.end_group()
        lines = grid.lines()
        hidden = bool(self.open) and self.open[-1].hidden
        if lines and not hidden:
            self.flow.gap()
            for line in lines:
                self.flow.put(line)
            self.flow.blank = True

    def _to_table(self) -> Grid | None:
        """End what is open in the innermost table; None outside of tables."""
        if not self.grids:
            return None
        while self.open[-1].name != "table":
            element = self._pop()
            if element.name == "caption" and not element.hidden:
                self.grids[-1].caption += element.own.done()
        self.grids[-1].end_cell()
        return self.grids[-1]

    def _inner(self, element: Element) -> Flow:
        """Open a cell or caption with a flow of its own."""
        element.flow = self.flow
        self._push(element)
        self.scopes.append({})
        self.flow = element.own = Flow()
        return self.flow

    def _table_part(self, name: str, attributes: dict[str, str]) -> None:
        """Visibility comes from what the part is in once the cell or caption before it has ended."""
        if name == "table":
            if self.open and self.open[-1].name == "table":  # a table can't be directly in a table
                self._pop()
            self.flow.gap()
            self._push(self._made(name, attributes, self.open[-1] if self.open else None))
            self.grids.append(Grid())
            return
        grid = self._to_table()
        if grid is None:
            return
        around = self.open[-1]
        if name == "caption":
            grid.end_group()
            self._inner(self._made(name, attributes, around))
        elif name in ("td", "th"):
            if grid.row is None:
                grid.group = grid.group or self._made("tbody", {}, around)
                grid.start_row(self._made("tr", {}, grid.group))
            element = self._made(name, attributes, grid.row)
            across = _number(attributes.get("colspan"), 1, 1000, 1)
            down = _number(attributes.get("rowspan"), 0, 65534, 1) or 65534
            flow = self._inner(element)
            if not element.hidden or element.collapsed:
                grid.cell = (across, down, flow)
        elif name == "tr":
            grid.end_row()
            grid.group = grid.group or self._made("tbody", {}, around)
            grid.start_row(self._made(name, attributes, grid.group))
        else:
            grid.end_group()
            grid.group = self._made(name, attributes, around)

    # Styles.

    def stylesheet(self, text: str) -> None:
        """Take the rules of a style element whose selectors are a name, a class or an id alone. They hold
        for what follows it; at-rules and other selectors are passed over. Of each selector only what
        holds in the end is kept, so an element asks for its name, id and classes once."""
        text = _AT_RULE.sub(" ", _COMMENT.sub(" ", text))
        for selectors, body in _RULE.findall(text):
            declared = _style(body)
            for selector in selectors.split(",") if declared else ():
                selector = selector.strip()
                if _SELECTOR.fullmatch(selector):
                    key = selector if selector[0] in ".#" else selector.lower()
                    held = self.styles.setdefault(key, {})
                    for name, (important, value) in declared.items():
                        if important or name not in held or not held[name][0]:
                            self.rules += 1
                            held[name] = (important, self.rules, value)

    def _styled(self, name: str, attributes: dict[str, str]) -> dict[str, str]:
        """The properties that hold for an element: important ones first, then its own style, its id's,
        its classes' and its name's; of equal rank the last."""
        found: dict[str, tuple[tuple, str]] = {}
        if self.styles:
            keys = [(0, name), *((1, f".{c}") for c in attributes.get("class", "").split()), (2, f"#{attributes.get('id', '')}")]
            for level, key in keys:
                for name_, (important, order, value) in self.styles.get(key, {}).items():
                    rank = (important, level, order)
                    if name_ not in found or rank > found[name_][0]:
                        found[name_] = (rank, value)
        if attributes.get("style"):
            for name_, (important, value) in _style(attributes["style"]).items():
                rank = (important, 3, 0)
                if name_ not in found or rank > found[name_][0]:
                    found[name_] = (rank, value)
        return {name_: value for name_, (_, value) in found.items()}

    # Events.

    def _made(self, name: str, attributes: dict[str, str], around: Element | None) -> Element:
        """An element in around (not yet open), with what shows of it."""
        gone = name in UNSEEN or "hidden" in attributes and attributes["hidden"].lower() != "until-found"
        gone = gone or name == "dialog" and "open" not in attributes
        unseen = collapsed = inside = False  # inside: what is around is hidden
        if around is not None:
            inside = around.hidden or around.name == "details" and around.option == "closed" and name != "summary"
            unseen, collapsed = around.unseen, around.collapsed
        style = self._styled(name, attributes)
        if style:
            gone = gone or style.get("display") == "none" or style.get("content-visibility") == "hidden"
            visibility = style.get("visibility")
            if visibility == "collapse" and name in ("tr", "tbody", "thead", "tfoot"):
                collapsed = collapsed or not inside
            if visibility in ("hidden", "collapse", "visible", "initial"):
                unseen = visibility in ("hidden", "collapse")
        element = Element(name, inside or gone or collapsed, unseen)
        element.collapsed = collapsed and not gone and name in ("tr", "tbody", "thead", "tfoot", "td", "th")
        return element

    def start(self, name: str, attributes: dict[str, str]) -> Element | None:
        around = self.open[-1] if self.open else None
        if name == "head" and around is not None and (around.name != "html" or self.flow.lines or self.flow.run):
            return None
        if name in ("html", "body") and self._is_open(name) or name == "form" and self._is_open("form"):
            return None
        if around is not None and around.name == "head" and name not in HEAD_ONLY and name not in ("noscript", "head"):
            self._pop()
            around = self.open[-1] if self.open else None
        if name in CLOSES_P and self._is_open("p"):
            self._pop_to("p")
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self._pop()
        for sibling in SIBLINGS.get(name, ()):
            held = self.places[sibling]
            if held and (not self.barriers or held[-1] > self.barriers[-1]):
                self._pop_to(sibling)
        if name in ("table", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"):
            self._table_part(name, attributes)
            return None
        around = self.open[-1] if self.open else None
        element = self._made(name, attributes, around)
        hidden = element.hidden
        if name == "br":
            if not hidden:
                self.flow.end_line(force=not self.flow.blank)
            return None
        if name == "hr" and not hidden:
            self.flow.gap()
        if name == "input" and not hidden and not element.unseen and attributes.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "file", "password", "image", "color", "range"):
            self.flow.text(attributes.get("value", ""), False)
        if name in VOID:
            return None
        element.keep = name in KEEPS_SPACE or bool(around and around.keep and name not in BLOCKS)
        if not hidden:
            nested = name in LISTS and self._is_open("li")
            if name in SPACED and not nested:
                self.flow.gap()
            elif name in BLOCKS:
                self.flow.end_line()
        if name == "ol":
            element.count = _number(attributes.get("start"), -(10**9), 10**9, 1)
        if name == "details":
            element.option = "open" if "open" in attributes else "closed"
        if name in ("li", "dd", "blockquote"):
            self._indent(element, name, attributes)
        if name == "select":
            element.option = "list" if "multiple" in attributes or _number(attributes.get("size"), 0, 10**9, 0) > 1 else "one"
            element.rank, element.chosen, element.shown = 0, None, ""
            if element.option == "list" and not hidden:
                self.flow.end_line()
        if name == "optgroup" and "disabled" in attributes:
            element.option = "disabled"
        if name == "option" and self.selects:
            self._start_option(element, self.selects[-1], attributes)
        self._push(element)
        return element

    def _indent(self, element: Element, name: str, attributes: dict[str, str]) -> None:
        marker: str | None = None
        width = 4
        if name == "li":
            owner = self.lists[-1] if self.lists else None
            marker = "- "
            if owner is not None and owner.name == "ol":
                if "value" in attributes:
                    owner.count = _number(attributes["value"], -(10**9), 10**9, owner.count or 1)
                marker = f"{owner.count}. "
                owner.count = (owner.count or 0) + 1
            width = len(marker)
            if element.unseen:
                marker = None
        self.flow.indent(marker, " " * width)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name == "p" and not self._is_open("p"):
            self.start("p", {})
            self._pop()
        elif name in ("table", "tr", "td", "th", "caption", "tbody", "thead", "tfoot"):
            if self.grids:
                group = self.grids[-1].group
                if name in ("tbody", "thead", "tfoot") and group is not None and group.name != name:
                    return  # not the end of the open one
                grid = self._to_table()
                if name == "table":
                    self._pop()
                elif name == "tr" and grid is not None:
                    grid.end_row()
                elif name not in ("td", "th", "caption") and grid is not None:
                    grid.end_group()
        elif name in HEADINGS:
            if any(self._is_open(h) for h in HEADINGS):
                while self._pop().name not in HEADINGS:
                    pass
        elif name not in ("html", "body") and self._is_open(name):
            self._pop_to(name)

    def text(self, text: str) -> None:
        around = self.open[-1] if self.open else None
        if around is not None and around.name == "head" and not text.isspace():
            self._pop()
            around = self.open[-1] if self.open else None
        if around is not None and (around.hidden or around.name == "details" and around.option == "closed"):
            return
        keep = around is not None and around.keep
        if around is not None and around.name == "table" and text.isspace():
            return
        text = unescape(text) if "&" in text else text
        if around is not None and around.unseen:
            text = _SHOWN.sub(" ", text)
        self.flow.text(text, keep)

    def close(self) -> str:
        while self.open:
            if self.open[-1].flow is not None:  # a cell or caption
                self._to_table()
            else:
                self._pop()
        return "\n".join(self.flow.done())


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from at on, and the place behind the tag; -1 if the tag doesn't end."""
    found: dict[str, str] = {}
    while True:
        match = _ATTRIBUTE.match(html, at)
        at = match.end()
        name = match[1]
        if name is not None:
            value = next((v for v in match.group(2, 3, 4) if v is not None), "")
            found.setdefault(name.lower(), unescape(value) if "&" in value else value)
        if at >= len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        if name is None or html[at] in "\"'":  # a quote that isn't closed takes the rest
            if html[at] in "\"'" and html.find(html[at], at + 1) < 0:
                return found, -1
            at += 1


def render(html: str) -> str:
    """The visible text of a page, laid out in lines."""
    page, at, n = Page(), 0, len(html)
    bang = -1  # the next "--!>" once a comment has looked for it; n: there is none
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            page.text(html[at:])
            break
        after = html[tag + 1 : tag + 2]
        if not (after.isalpha() and after.isascii() or after in ("/", "!", "?") and after):
            end = html.find("<", tag + 1)
            end = n if end < 0 else end
            page.text(html[at:end])
            at = end
            continue
        if tag > at:
            page.text(html[at:tag])
        if after == "!" and html.startswith("<!--", tag):
            if html.startswith((">", "->"), tag + 4):
                at = html.index(">", tag + 4) + 1
                continue
            if bang < tag + 4:
                bang = html.find("--!>", tag + 4)
                bang = n if bang < 0 else bang
            end = html.find("-->", tag + 4, bang)  # no further than needed, so that time stays linear
            at = end + 3 if end >= 0 else min(n, bang + 4)
            continue
        closing = after == "/"
        name_at = tag + 1 + closing
        first = html[name_at : name_at + 1]
        if closing and not first:
            page.text("</")
            break
        if after in "!?" or not (first.isalpha() and first.isascii()):
            end = html.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        match = _NAME.match(html, name_at)
        name = match.group().lower()
        at = match.end()
        if html[at : at + 1] == ">":
            attributes, at = {}, at + 1
        else:
            attributes, at = _attributes(html, at)
            if at < 0:
                break
        if closing:
            page.end(name)
            continue
        element = page.start(name, attributes)
        if name in ("pre", "textarea", "listing") and html[at : at + 1] == "\n":
            at += 1
        if name in RAW and element is not None:
            end = _RAW_END[name].search(html, at) if name != "plaintext" else None
            stop = end.start() if end else n
            if name == "style":
                page.stylesheet(html[at:stop])
            if not element.hidden:
                raw = html[at:stop]
                page.text(raw if name in ESCAPABLE else raw.replace("&", "&amp;"))
            at = stop
    return page.close()


def with_rendered(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with the visible text of each whole page; a null or empty page has the empty text. Rows
    are independent: repeated ones repeat their texts, an empty table gives no rows. Other columns
    pass through, but for one that already has the new name."""

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([render(h or "") for h in column.to_pylist()], pa.string())]

    return append_columns(pages, [html_col], run, [T.StructField(name, T.StringType())])


def op8_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_rendered(pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
