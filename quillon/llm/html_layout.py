"""Visible text of web pages, laid out: block spacing, list markers, aligned table cells.

A tree builder turns tags into properly nested elements: it closes paragraphs, list items, cells and rows that HTML leaves open,
opens rows that it leaves out, and ignores end tags that match nothing. A renderer takes the elements in order and writes all text
that is visible. Not visible are the head, scripts, styles and templates; what noscript, frames, players, canvases and objects hold
for browsers without them; suggestions of a datalist; elements that are hidden by attribute, by their style or by a simple selector of
the page's own style sheet; and what closed details hold besides their summary. Of a drawing its text elements are visible, of a formula
all but its annotations, of a drop-down its chosen option and of a list box all options. Both parts work on a stack, so depth is bounded
by memory alone.

Rules of a style sheet hold outside at-blocks, in @layer, and in an @media that holds for a screen of `SCREEN` pixels; a condition that
is not understood does not hold, so that its rules hide nothing.

Cells of a table column start in one place. A cell that others follow is broken at spaces into lines of `WIDEST` characters at most,
as a screen would, so that one long cell doesn't pad every row; a longer word stays whole and moves what follows it in its own row.
The last cell of a row is never broken.

Defined cases: null and empty pages give empty text; unclosed tags and quotes end with the page; a lone < is text; elements may be
nested to any depth, in time that grows with the page; repeated rows are each rendered; null page_ids are kept; an empty table gives
no rows; columns other than page_id and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: Characters of a line in a cell that others follow, by default.
WIDEST = 60
SCREEN = {"width": 1280, "height": 720}

# Element names of the HTML standard by their part in layout and parsing.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object".split())
_FOREIGN = frozenset("svg math select".split())
_FORM = frozenset("select option optgroup".split())
#: Parts of a drawing that are not drawn where they stand.
_SVG_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient".split())
_SVG_TEXT, _SVG_HTML, _MATH_HTML = frozenset(("text",)), frozenset(("foreignobject",)), frozenset("mi mo mn ms mtext annotation-xml".split())
_MATH_UNSEEN = frozenset(("annotation", "annotation-xml"))
#: Start tags that end a drawing or formula.
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: States of Element.foreign.
_HTML, _DRAWN, _LABEL, _FORMULA = range(4)
_KEPT = frozenset(("pre", "textarea", "xmp"))
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
_BLOCK = _SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav section summary caption tr td th thead tbody tfoot option".split())
_ENDS_P = (_SPACED | frozenset("address article aside center details dialog dd div dt figcaption footer form header hgroup li main menu nav section summary".split())) - {"table"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS, _SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NEEDS_ATTRIBUTES = re.compile(r"hidden|style|class|id|start|value|colspan|open|reversed", re.IGNORECASE)
_DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*[a-z]", re.IGNORECASE)
#: What stands before a block of a style sheet or ends one: a statement, a block's beginning, its end.
_CSS = re.compile(r"([^{};]*)([{};]|\Z)")
_CSS_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_FEATURE = re.compile(r"\(\s*(?:(min|max)-)?(width|height)\s*:\s*([0-9.]+)(px|em|rem)\s*\)")
_ORIENTATION = re.compile(r"\(\s*orientation\s*:\s*(landscape|portrait)\s*\)")
_SIMPLE = re.compile(r"[a-zA-Z][\w-]*|[.#][\w-]+")
_WHITE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)


def rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on a screen."""
    css, holds, selectors = _CSS_STRING.sub("''", _COMMENT.sub("", css)), [True], ""
    body: list[str] | None = None
    for m in _CSS.finditer(css):
        before, mark = m[1].strip(), m[2]
        if body is not None:  # in a rule; blocks nested in it are passed over
            depth += (mark == "{") - (mark == "}")
            if depth == 1 and mark == ";" or depth == 0 or not mark:
                body.append(before)
            if depth == 0 or not mark:
                if holds[-1]:
                    yield selectors, ";".join(body)
                body = None
        elif mark == "{" and before.startswith("@"):
            name, _, condition = before[1:].replace("(", " (", 1).partition(" ")
            name = name.lower()
            holds.append(holds[-1] and (name == "layer" or (name == "media" and _media(condition.lower()))))
        elif mark == "{":
            selectors, body, depth = before, [], 1
        elif mark == "}" and len(holds) > 1:
            holds.pop()


def _media(condition: str) -> bool:
    """Whether a list of media queries is known to hold on a screen of SCREEN pixels."""
    return not condition.strip() or any(_query(q.strip()) for q in condition.split(","))


def _query(query: str) -> bool:
    known = [_known(part.strip()) for part in re.split(r"\band\b", re.sub(r"^(?:not|only)\s+", "", query))]
    if re.match(r"not\s", query):  # holds if a part is known not to
        return False in known
    return all(known)


def _known(part: str) -> bool | None:
    """Whether one condition holds; None if it is not understood."""
    if part in ("all", "screen"):
        return True
    if re.fullmatch(r"print|speech|aural|braille|embossed|handheld|projection|tty|tv", part):
        return False
    if m := _ORIENTATION.fullmatch(part):
        return (m[1] == "landscape") == (SCREEN["width"] >= SCREEN["height"])
    if (m := _FEATURE.fullmatch(part)) and re.fullmatch(r"[0-9]+(?:\.[0-9]+)?|\.[0-9]+", m[3]):
        own, value = SCREEN[m[2]], float(m[3]) * (1 if m[4] == "px" else 16)
        return own >= value if m[1] == "min" else own <= value if m[1] == "max" else own == value
    return None


class Flow:
    """Lines of one containing block."""

    def __init__(self) -> None:
        self.lines: list[str | _Nested] = []
        self.now: list[str] = []
        self.blank_before_text = False
        self.gap = False

    def _open(self) -> None:
        if self.gap and self.lines and not self.now:
            self.lines.append("")
        self.gap = False

    def text(self, text: str) -> None:
        words = _WHITE.sub(" ", text)
        if words == " " or not words:
            self.blank_before_text |= words == " "
            return
        self._open()
        if (self.blank_before_text or words[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.blank_before_text = words[-1] == " "

    def kept(self, text: str) -> None:
        """Text of which white space stays."""
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line_break()
            if line:
                self._open()
                self.now.append(line)

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
        self.now, self.blank_before_text = [], False

    def line_break(self) -> None:
        self._open()
        self.lines.append("".join(self.now))
        self.now, self.blank_before_text = [], False

    def edge(self, spaced: bool) -> None:
        """The border of a block; spaced ones keep an empty line from what is around them."""
        self.end_line()
        self.gap |= spaced

    def add(self, lines: list, first: str = "", rest: str = "") -> None:
        """Lines of an inner block; indented ones are laid out only when the outermost block is done."""
        self.end_line()
        if lines:
            self._open()
            if first or rest:
                self.lines.append(_Nested(first, rest, lines))
            else:
                self.lines += lines

    def done(self) -> list:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Nested:
    """Lines with what goes before the first of them and before the others; empty lines but the first stay empty."""

    __slots__ = ("first", "rest", "lines", "begun")

    def __init__(self, first: str, rest: str, lines: list):
        self.first, self.rest, self.lines, self.begun = first, rest, lines, False


def flat(lines: list) -> list[str]:
    """Plain lines of a block, in time that grows with their length."""
    out: list[str] = []
    inside: list[_Nested] = []
    todo = [iter(lines)]
    while todo:
        line = next(todo[-1], None)
        if line is None:
            todo.pop()
            if inside:
                inside.pop()
        elif isinstance(line, _Nested):
            line.begun = False
            inside.append(line)
            todo.append(iter(line.lines))
        else:
            before = []
            for block in reversed(inside):
                if line or before or not block.begun:
                    before.append(block.rest if block.begun else block.first)
                block.begun = True
            out.append("".join(reversed(before)) + line)
    return out


class Element:
    __slots__ = ("name", "gone", "unseen", "flow", "rows", "number", "step", "marker", "span", "closed", "kept", "foreign", "options", "label", "chosen")

    def __init__(self, name: str, gone: bool, unseen: bool):
        self.name, self.gone, self.unseen = name, gone, unseen
        self.flow, self.rows, self.number, self.step, self.marker, self.span, self.closed = None, None, None, 1, "", 1, False
        self.kept, self.foreign, self.options, self.label, self.chosen = False, _HTML, None, None, None


class Page:
    def __init__(self, widest: int = WIDEST) -> None:
        self.widest = widest
        self.stack = [Element("#page", False, False)]
        self.stack[0].flow = Flow()
        self.flows = [self.stack[0].flow]
        self.hide: dict[str, str] = {}
        #: Where in the stack elements of a name are, and where blocks are, so that no search walks the stack.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    # Style sheets.
    def sheet(self, css: str) -> None:
        for selectors, body in rules(css):
            rule = "gone" if _DISPLAY_NONE.search(body) else (m[1].lower() if (m := _VISIBILITY.search(body)) else "")
            shown = not rule and _DISPLAY.search(body)
            if rule or shown:
                for s in selectors.split(","):
                    if _SIMPLE.fullmatch(s := s.strip()):
                        key = s if s[0] in ".#" else s.lower()
                        if rule:
                            self.hide[key] = rule
                        elif self.hide.get(key) == "gone":  # a later rule shows it again
                            del self.hide[key]

    def _seen(self, name: str, attributes: dict[str, str]) -> tuple[bool, bool]:
        """Whether a new element is gone, and whether it is unseen but may hold visible ones."""
        up = self.stack[-1]
        gone, unseen = up.gone or name in _UNSEEN or "hidden" in attributes, up.unseen
        if up.closed and name != "summary":
            gone = True
        rules = []
        if self.hide:
            rules = [self.hide.get(k) for k in (name, *("." + c for c in attributes.get("class", "").split()), "#" + attributes.get("id", ""))]
        style = attributes.get("style", "")
        if style:
            rules += ["gone" if _DISPLAY_NONE.search(style) else None, m[1].lower() if (m := _VISIBILITY.search(style)) else None]
        for rule in rules:
            if rule == "gone":
                gone = True
            elif rule:
                unseen = rule != "visible"
        return gone, unseen

    # The tree.
    def _last(self, names: frozenset | set) -> int:
        """Where the innermost open element of one of these names is; 0 if there is none."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=0)

    def _find(self, names: frozenset | set, stop: frozenset | set) -> int:
        at = self._last(names)
        return at if at >= self._last(stop) else 0

    def _push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        if element.name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def _pop(self) -> None:
        element = self.stack.pop()
        self.places[element.name].pop()
        if element.name in _BLOCK:
            self.blocks.pop()
        self._leave(element)

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def _close(self, names: frozenset | set, stop: frozenset | set) -> None:
        if at := self._find(names, stop):
            self._close_to(at)

    _BOUNDS = frozenset(("table", "td", "th", "caption", "button"))

    def start(self, name: str, attributes: dict[str, str], empty: bool = False) -> None:
        if self.stack[-1].foreign and name in _BREAKS:
            while self.stack[-1].foreign:
                self._pop()
        if name in _ENDS_P:
            self._close({"p"}, self._BOUNDS)
        if name in _HEADINGS and self.stack[-1].name in _HEADINGS:
            self._close_to(len(self.stack) - 1)
        elif name == "li":
            self._close({"li"}, self._BOUNDS | {"ul", "ol", "menu"})
        elif name in ("dt", "dd"):
            self._close({"dt", "dd"}, self._BOUNDS | {"dl"})
        elif name in _CELLS:
            self._close(_CELLS, {"table"})
            if not self._find({"tr"}, {"table"}) and self._find({"table"}, set()):
                self.start("tr", {})
        elif name == "tr":
            self._close({"tr"}, {"table"})
        elif name in _SECTIONS:
            self._close(_SECTIONS | {"caption"}, {"table"})
        elif name == "option":
            self._close({"option"}, {"select", "datalist"})
        elif name == "optgroup":
            self._close({"optgroup"}, {"select"})
        elif name in ("select", "input", "textarea"):
            self._close({"select"}, self._BOUNDS)
        elif name == "body":
            self._close({"head"}, set())
        elif name not in _UNSEEN and name in _BLOCK and name not in ("html", "head"):
            self._close({"head"}, {"body"})
        element = Element(name, *self._seen(name, attributes))
        if name in _VOID:
            if not element.gone:
                if name == "br":
                    self.flows[-1].line_break()
                elif name == "hr":
                    self.flows[-1].edge(True)
                    self.flows[-1].add(["---"])
                    self.flows[-1].edge(True)
            return
        up = self.stack[-1]
        element.kept = up.kept or name in _KEPT
        element.foreign = self._foreign(up.foreign, name)
        if up.foreign:
            element.gone |= name in (_MATH_UNSEEN if up.foreign == _FORMULA else _SVG_UNSEEN)
        if empty and (up.foreign or name in ("svg", "math")):
            return
        self._push(element)
        if element.gone:
            return
        flow = self.flows[-1]
        if element.foreign == _LABEL and up.foreign == _DRAWN:
            flow.edge(False)
        if name == "select":
            size = _number(attributes.get("size"), 1)
            element.options, element.chosen = [], "multiple" in attributes or size > 1
        elif name in ("option", "optgroup") and (owner := self._owner("select")):
            element.label = None if element.unseen else attributes.get("label")
            if name == "optgroup":
                owner.options.append(([element.label or ""], None))
                return
            element.flow, element.chosen = Flow(), (2 if "selected" in attributes else 0 if "disabled" in attributes else 1)
            self.flows.append(element.flow)
            return
        if name in _BLOCK:
            nested = name in ("ul", "ol") and bool(self.places.get("li"))
            flow.edge(name in _SPACED and not nested)
        if name == "ol":
            element.step = -1 if "reversed" in attributes else 1
            element.number = _number(attributes.get("start"), 1)
        elif name == "table":
            element.rows = []
        elif name == "tr":
            if owner := self._owner("table"):
                owner.rows.append([])
        elif name == "details":
            element.closed = "open" not in attributes
        elif name in ("li", "blockquote", "dd") or (name in _CELLS and self._owner("table")):
            element.flow = Flow()
            self.flows.append(element.flow)
            if name == "li":
                owner = self.stack[self._last({"ul", "ol", "menu"})]
                element.marker = "- "
                if owner.number is not None:
                    number = _number(attributes.get("value"), owner.number)
                    element.marker, owner.number = f"{number}. ", number + owner.step
            elif name in _CELLS:
                element.span = max(1, min(_number(attributes.get("colspan"), 1), 1000))

    @staticmethod
    def _foreign(up: int, name: str) -> int:
        """Whether an element is part of a drawing, its text or a formula."""
        if name == "svg":
            return _DRAWN
        if up in (_DRAWN, _LABEL):
            return _HTML if name in _SVG_HTML else _LABEL if name in _SVG_TEXT else up
        if name == "math":
            return _FORMULA
        return _HTML if up == _FORMULA and name in _MATH_HTML else up

    def _choose(self, element: Element) -> None:
        """Write what a drop-down or list box shows."""
        if element.chosen:
            for lines, _ in element.options:
                self.flows[-1].edge(False)
                self.flows[-1].add([line for line in lines if line])
            return
        best = max((k or 0 for _, k in element.options), default=0)
        found = [lines for lines, k in element.options if k == best and best]
        if found:
            self.flows[-1].text(" ".join(found[-1] if best == 2 else found[0]))

    def _owner(self, name: str) -> Element | None:
        """The innermost open element of a name that isn't the newest; an element that is seen has none that are gone around it."""
        return next((self.stack[at] for at in reversed(self.places.get(name, [])[-2:]) if at < len(self.stack) - 1), None)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
            return
        if name == "p" and not self._find({"p"}, self._BOUNDS):
            if not self.stack[-1].gone:
                self.flows[-1].edge(True)
            return
        stop = {"table"} if name in _CELLS | _SECTIONS | {"tr", "caption"} else set() if name in ("table", "body", "html") else set(self._BOUNDS)
        at = self._find({name}, stop - {name})
        if at and (name in _BLOCK or name in _UNSEEN or name in _FOREIGN or not (self.blocks and self.blocks[-1] > at)):
            self._close_to(at)

    def _leave(self, element: Element) -> None:
        if element.gone:
            return
        if element.flow is not None:
            self.flows.pop()
            lines = element.flow.done()
            if element.name == "option":
                if at := self._last({"select"}):
                    self.stack[at].options.append(([element.label] if element.label else flat(lines), element.chosen))
                return
            if element.name in _CELLS:
                if at := self._last({"table"}):
                    owner = self.stack[at]
                    if not owner.rows:
                        owner.rows.append([])
                    owner.rows[-1].append((flat(lines), element.span))
                return
            marker = element.marker or "  "
            self.flows[-1].add(lines, marker, " " * len(marker))
        elif element.rows is not None:
            self.flows[-1].add(aligned(element.rows, self.widest))
        elif element.options is not None:
            self._choose(element)
        elif element.foreign == _LABEL and element.name in _SVG_TEXT:
            self.flows[-1].edge(False)
        if element.name in _BLOCK:
            nested = element.name in ("ul", "ol") and bool(self.places.get("li"))
            self.flows[-1].edge(element.name in _SPACED and not nested)

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.gone or top.closed or top.unseen or top.foreign == _DRAWN or not text:
            return
        text = html.unescape(text) if "&" in text else text
        if top.kept:
            self.flows[-1].kept(text)
        elif top.name in ("table", "tr", "thead", "tbody", "tfoot") and not text.strip() or top.name in ("select", "optgroup"):
            return
        else:
            self.flows[-1].text(text)


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", text) else otherwise


def broken(line: str, widest: int) -> Iterator[str]:
    """A line in parts of at most so many characters, cut at spaces; a longer word stays whole."""
    at = 0
    while len(line) - at > widest:
        cut = line.rfind(" ", at + 1, at + widest + 1)
        cut = cut if cut > 0 else line.find(" ", at + widest)
        if cut < 0:
            break
        yield line[at:cut]
        at = cut + 1
    yield line[at:]


def aligned(rows: list[list[tuple[list[str], int]]], widest: int = WIDEST) -> list[str]:
    """Lines of a table whose cells start in columns."""
    rows = [[(cell[0] if k == len(row) - 1 else [part for line in cell[0] for part in broken(line, widest)], cell[1]) for k, cell in enumerate(row)] for row in rows]
    width: dict[int, int] = {}
    for row in rows:
        column = 0
        for k, (lines, span) in enumerate(row):
            if span == 1 and k < len(row) - 1:
                width[column] = max(width.get(column, 0), min(max((len(x) for x in lines), default=0), widest))
            column += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            line, column = "", 0
            for k, (lines, span) in enumerate(row):
                room = sum(width.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                line += lines[i] if i < len(lines) else ""
                column += span
                if k < len(row) - 1:
                    line = line + "  " if len(line_part := lines[i] if i < len(lines) else "") > room else line + " " * (room - len(line_part) + 2)
            out.append(line.rstrip())
    return out


def render(source: str | None, widest: int = WIDEST) -> str:
    """The visible text of one page."""
    page, source = Page(widest), source or ""
    at = 0
    for m in iter(lambda: _TOKEN.search(source, at), None):
        page.text(source[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                page.text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if closing:
            page.end(name)
            continue
        attributes = {}
        if rest and (name in _FORM or _NEEDS_ATTRIBUTES.search(rest)):
            attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(rest))}
        page.start(name, attributes, rest.endswith("/"))
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.IGNORECASE).search(source, at)
            raw = source[at : end.start()]
            at = end.start()
            if name == "style":
                page.sheet(raw)
            elif name in ("textarea", "xmp"):
                page.text(raw.removeprefix("\n"))
    page.text(source[at:])
    page._close_to(1)
    return "\n".join(flat(page.flows[0].done()))


def visible_text(pages: DataFrame, widest: int = WIDEST) -> DataFrame:
    """page_id and the page's laid-out text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py(), widest) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(lean(run), "page_id bigint, text string")


def op6_layout_aware_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid-out text of all pages."""
    found = visible_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
