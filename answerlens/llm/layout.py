"""Visible text of HTML pages, laid out: block spacing, lists, aligned table cells."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_WORDS = str.split
VOID = frozenset(_WORDS("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(_WORDS("script style textarea title iframe noembed noframes xmp"))
HEAD = frozenset(_WORDS("head title base link meta style script template"))
UNSEEN = frozenset(_WORDS(
    "head title base link meta style script template noscript iframe noembed noframes object video audio canvas svg "
    "datalist map rp annotation annotation-xml"
))
#: Blocks with an empty line around them, and those that only begin a line.
SPACED = frozenset(_WORDS("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu"))
LINED = frozenset(_WORDS(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html "
    "legend li main nav option optgroup search section select summary textarea tr thead tbody tfoot"
))
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
_BLOCKS_END_P = frozenset(_WORDS(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul"
))
_CELLS, _GROUPS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
_TABLE = frozenset(("table",))
_SCOPE = frozenset(_WORDS("table td th caption button html template object"))
_LISTS = frozenset(_WORDS("ul ol menu dir")) | _SCOPE
_IMPLIED_END: dict[str, list[tuple[frozenset[str], frozenset[str]]]] = {
    "li": [(frozenset(("li",)), _LISTS)],
    "dt": [(frozenset(("dt", "dd")), frozenset(("dl",)) | _SCOPE)],
    "dd": [(frozenset(("dt", "dd")), frozenset(("dl",)) | _SCOPE)],
    "option": [(frozenset(("option",)), frozenset(("select",)) | _SCOPE)],
    "optgroup": [(frozenset(("option", "optgroup")), frozenset(("select",)) | _SCOPE)],
    "td": [(_CELLS, frozenset(("tr",)) | _TABLE)],
    "th": [(_CELLS, frozenset(("tr",)) | _TABLE)],
    "tr": [(frozenset(("tr", "caption", "colgroup")), _TABLE)],
    **{g: [(_GROUPS | frozenset(("caption", "colgroup")), _TABLE)] for g in ("thead", "tbody", "tfoot", "colgroup", "caption")},
    "a": [(frozenset(("a",)), _SCOPE)],
    "body": [(frozenset(("head",)), frozenset())],
}
#: An end tag looks no further than these for its element.
_END_SCOPE = {"table": frozenset(), "p": _SCOPE, "li": _LISTS, **{t: _TABLE for t in _CELLS | _GROUPS | {"tr", "caption"}}}
_INLINE_END_STOPS = frozenset(_WORDS("table td th caption body html"))

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_CSS_ASIDE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(/\*.*?(?:\*/|\Z)|<!--|-->)", re.S)
_BRACE = re.compile(r"([{}])")
_AT = re.compile(r"@([\w-]+)\s*(.*)", re.S)
_SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_MARK = re.compile(r"[.#][\w-]+")
#: Media queries that hold on every screen.
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?:print|speech)|", re.I)
_VALUE = re.compile(r"([^!]*?)\s*(!\s*important)?", re.I)
_DISPLAYS = frozenset(_WORDS(
    "none block inline inline-block flow flow-root list-item contents flex inline-flex grid inline-grid table inline-table "
    "table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group "
    "table-caption ruby ruby-base ruby-text math run-in initial inherit unset revert revert-layer -webkit-box "
    "-webkit-inline-box -webkit-flex -webkit-inline-flex"
))
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, *values in _ATTRIBUTE.findall(raw):
            out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def build(source: str) -> tuple[Node, list[str]]:
    """Tree of a page with implied tags put in, and the text of the style sheets that apply on every screen."""
    root = Node("html", {})
    stack, sheets, at = [root], [], 0

    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of the elements above the root

    def leave(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag].pop()
        del stack[k:]

    def last(tags: frozenset[str]) -> int:
        return max((opened[tag][-1] for tag in tags if opened.get(tag)), default=0)

    def close(tags: frozenset[str], stops: frozenset[str]) -> bool:
        k = last(tags)
        if not k or last(stops) > k:
            return False
        leave(k)
        return True

    def push(tag: str, attributes: dict[str, str]) -> Node:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            opened[tag].append(len(stack))
            stack.append(node)
        return node

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag == "head" and not piece.isspace():
                leave(len(stack) - 1)
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    find = _TOKEN.search
    while (m := find(source, at)) is not None:
        text(source[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                push("br", {})
            elif not close(frozenset((tag,)), _END_SCOPE.get(tag, _INLINE_END_STOPS)) and tag == "p":
                push("p", {})
                leave(len(stack) - 1)
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD and tag != "noscript":
            leave(len(stack) - 1)
        if tag in _BLOCKS_END_P:
            close(frozenset(("p",)), _SCOPE)
        for tags, stops in _IMPLIED_END.get(tag, ()):
            close(tags, stops)
        if tag == "tr" and stack[-1].tag == "table":
            push("tbody", {})
        elif tag in _CELLS and stack[-1].tag in _GROUPS | _TABLE:
            if stack[-1].tag == "table":
                push("tbody", {})
            push("tr", {})
        node = push(tag, _attributes(m[3] or m[6] or ""))
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            body = source[at:end.start() if end else len(source)]
            at = end.start() if end else len(source)
            if tag == "style":
                if on_screen(node.attributes.get("media", "")) and not (opened.get("noscript") or opened.get("template")):
                    sheets.append(body)
            elif tag in ("textarea", "title"):
                node.children.append(html.unescape(body))
            else:
                node.children.append(body)
    text(source[at:])
    return root, sheets


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen."""
    return any(_SCREEN.fullmatch(query.strip()) for query in media.split(","))


def _without_asides(css: str) -> str:
    """Style text without comments and the contents of strings."""
    return _CSS_ASIDE.sub(lambda m: " " if m[1] else '""', css)


def _display(declarations: str) -> tuple[bool, bool] | None:
    """Of the last valid ``display``: whether it is important, and whether it shows."""
    best = None
    for part in declarations.split(";"):
        name, _, value = part.partition(":")
        if name.strip().lower() == "display":
            m = _VALUE.fullmatch(value.strip().lower())
            words = m[1].split() if m else []
            if words and (m[1].startswith("var(") or _DISPLAYS.issuperset(words)):
                if best is None or m[2] or not best[0]:
                    best = bool(m[2]), words != ["none"]
    return best


#: By the mark of a selector that the fewest selectors have, or its tag: its tag, marks, weight in the cascade, and whether it shows.
Styles = dict[str, list[tuple[str, frozenset[str], tuple, bool]]]


def display_rules(sheets: list[str]) -> Styles:
    """The rules of style sheets that say how elements with simple selectors are displayed, outside conditions."""
    strongest: dict[tuple[str, frozenset[str]], tuple[tuple, bool]] = {}
    layers: dict[str, int] = {}
    turn = 0
    for sheet in sheets:
        if "display" not in sheet.lower():
            continue
        # Open blocks: whether rules in them apply, the layer, and of a rule its selectors and declarations.
        blocks: list[tuple[bool, str, str | None, list[str]]] = [(True, "", None, [])]

        def end() -> None:
            nonlocal turn
            turn += 1
            applies, layer, selectors, declared = blocks.pop()
            display = _display(";".join(declared)) if applies and selectors is not None else None
            for selector in selectors.split(",") if display else ():
                m = _SIMPLE.fullmatch(selector.strip())
                if m and m[0]:
                    tag, marks = (m[1] or "*").lower(), _MARK.findall(m[2])
                    # Layers come before what is in none, and the other way round if important.
                    place = layers[layer] if layer else 1 << 30
                    ids = sum(x[0] == "#" for x in marks)
                    weight = (display[0], -place if display[0] else place, ids, len(marks) - ids, tag != "*", turn)
                    own = tag, frozenset(marks)
                    if own not in strongest or weight > strongest[own][0]:
                        strongest[own] = weight, display[1]

        text = ""
        for piece in _BRACE.split(_without_asides(sheet)):
            applies, layer, selectors, declared = blocks[-1]
            if piece == "{":
                before, _, prelude = text.rpartition(";")
                declared.append(before)
                prelude, at = prelude.strip(), _AT.match(prelude.strip())
                if at is None:
                    # A rule inside a rule has a selector of more than one element.
                    blocks.append((applies and selectors is None, layer, prelude, []))
                elif at[1].lower() == "layer":
                    layer = layer or at[2].strip().split(".")[0] or f"/{len(layers)}"
                    layers.setdefault(layer, len(layers))
                    blocks.append((applies and selectors is None, layer, None, []))
                else:
                    holds = at[1].lower() == "media" and on_screen(at[2])
                    blocks.append((applies and holds and selectors is None, layer, None, []))
            elif piece == "}":
                declared.append(text)
                if len(blocks) > 1:
                    end()
            else:
                text = piece
                if selectors is None and applies:
                    for statement in piece.split(";")[:-1]:
                        at = _AT.match(statement.strip())
                        if at and at[1].lower() == "layer" and not layer:
                            for name in at[2].split(","):
                                layers.setdefault(name.strip().split(".")[0], len(layers))
                continue
            text = ""
        blocks[-1][3].append(text)
        while len(blocks) > 1:
            end()
    held = Counter(mark for _, marks in strongest for mark in marks)
    out: Styles = {}
    for (tag, marks), (weight, shows) in strongest.items():
        out.setdefault(min(marks, key=lambda m: (held[m], m)) if marks else tag, []).append((tag, marks, weight, shows))
    return out


def displayed(node: Node, styles: Styles) -> bool:
    """Whether an element takes part in the layout."""
    tag, own = node.tag, node.attributes
    if tag in UNSEEN or (tag == "input" and own.get("type", "").lower() == "hidden"):
        return False
    # What style sheets and the style attribute say goes before the browser's own rules.
    best, shown = None, "hidden" not in own and not (tag == "dialog" and "open" not in own)
    if styles:
        marks = {*("." + c for c in own.get("class", "").split()), *(["#" + own["id"]] if "id" in own else [])}
        for key in (tag, "*", *marks):
            for name, needed, weight, shows in styles.get(key, ()):
                if name in (tag, "*") and needed <= marks and (best is None or weight > best):
                    best, shown = weight, shows
    if "style" in own and (display := _display(_without_asides(own["style"]))):
        if best is None or display[0] or not best[0]:
            shown = display[1]
    return shown


class Writer:
    """Lines of one flow of text; collapses white space and empty lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap = False, 0
        self.indent, self.marker = "", ""

    def feed(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first, True)
            for part in rest:
                self.end_line(force=True)
                self._put(part, True)
            return
        text = _BLANK.sub(" ", text)
        if not text:  # a reference to a control character alone
            return
        if text == " ":
            self.space = self.space or bool(self.line)
            return
        if text[0] == " ":
            self.space = self.space or bool(self.line)
            text = text[1:]
        tail = text[-1] == " "
        self._put(text[:-1] if tail else text, False)
        self.space = tail

    def _put(self, text: str, pre: bool) -> None:
        if not text:
            return
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent + self.marker)
            self.marker = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def end_line(self, force: bool = False) -> None:
        self.space = False
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif force and self.lines:
            self.gap = max(self.gap, 2)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


class Grid:
    """Cells of a table being read."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.below: dict[int, int] = {}

    def start_row(self) -> None:
        self.rows.append([])
        self.column = 0

    def _skip(self) -> None:
        while self.below.get(self.column, 0) > 0:
            self.below[self.column] -= 1
            self.rows[-1].append(([], 1))
            self.column += 1

    def add(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.start_row()
        self._skip()
        self.rows[-1].append((lines, across))
        for k in range(across):
            if down > 1:
                self.below[self.column + k] = down - 1
        self.column += across

    def end_row(self) -> None:
        if self.rows:
            self._skip()

    def lines(self) -> list[str]:
        """Rows with each column as wide as its widest cell, two spaces apart; a cell of several lines keeps them."""
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, across in row:
                if across == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
                at += across
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                line, at, target = "", 0, 0
                for lines, across in row:
                    if k < len(lines):
                        line = line.ljust(target) + lines[k]
                    target = max(target, 0) + sum(widths.get(at + j, 0) + 2 for j in range(across))
                    if k < len(lines) and len(line) + 2 > target:
                        target = len(line) + 2
                    at += across
                out.append(line.rstrip(" "))
        return out


def _number(value: str | None, default: int, most: int = 1000) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(int(m[1]), most) if m else default


def render(source: str | None) -> str:
    """All visible text of a page."""
    if not source:
        return ""
    root, sheets = build(source)
    styles = display_rules(sheets)
    writers, grids, lists = [Writer()], [], []
    # (node or text or closing step, visible, preformatted)
    todo: list = [("open", root, True, False)]
    while todo:
        step, node, seen, pre = todo.pop()
        writer = writers[-1]
        if step == "text":
            if seen:
                writer.feed(node, pre)
            continue
        tag = node.tag
        if step == "open":
            if not displayed(node, styles):
                continue
            shown = _VISIBILITY.search(node.attributes.get("style", "")) if "style" in node.attributes else None
            if shown:
                seen = shown[1].lower() == "visible"
            elif tag == "mphantom":
                seen = False
            if tag == "br":
                if writer.line:
                    writer.end_line()
                else:
                    writer.gap = max(writer.gap, 2)
                continue
            pre = pre or tag in ("pre", "textarea", "xmp")
            if tag in SPACED or tag in LINED:
                writer.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(node.attributes.get("start"), 1, 1 << 30), writer.indent])
                writer.indent += "  " if len(lists) > 1 else ""
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    lists[-1][1] = _number(node.attributes.get("value"), lists[-1][1], 1 << 30)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                writer.marker = mark
            elif tag == "dd" or tag == "blockquote":
                writer.indent += "  "
            elif tag == "table":
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].start_row()
            elif tag in _CELLS and grids:
                writers.append(Writer())
                lists.append([False, 1, ""])
            if tag == "details" and "open" not in node.attributes:
                inside = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif tag in ("semantics", "maction"):
                inside = [c for c in node.children if isinstance(c, Node)][:1]
            else:
                inside = node.children
            todo.append(("close", node, seen, pre))
            for child in reversed(inside):
                todo.append(("text" if isinstance(child, str) else "open", child, seen, pre))
            continue
        if tag in _CELLS and grids:
            lists.pop()
            lines = writers.pop().result()
            across = max(1, _number(node.attributes.get("colspan"), 1))
            grids[-1].add(lines, across, max(1, _number(node.attributes.get("rowspan"), 1)))
            continue
        if tag == "tr" and grids:
            grids[-1].end_row()
            continue
        if tag == "table":
            lines = grids.pop().lines()
            for line in lines:
                if line:
                    writer._put(line, True)
                    writer.end_line()
        elif tag in ("ul", "ol", "menu", "dir"):
            writer.indent = lists.pop()[2]
        elif tag == "li":
            writer.marker = ""
        elif tag == "dd" or tag == "blockquote":
            writer.indent = writer.indent[:-2]
        if tag in SPACED or tag in LINED:
            writer.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
    return "\n".join(writers[0].result()).replace("\xa0", " ")


def page_texts(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: its visible text and the number of characters.

    The tree builder puts in the tags that HTML implies (ends of paragraphs, items, rows and cells; table bodies and
    rows) and ignores end tags without a start.  Out of display are the head, scripts, styles, templates, embedded
    media, ``hidden``, ``display: none`` inline or by the page's own style sheets, closed dialogs and the closed part of
    details; ``visibility: hidden`` hides text until a descendant is visible again.  MathML is text, without its
    annotations.

    Of the style sheets count the selectors of one element by tag, classes and id, in the order of the cascade (layers,
    importance, specificity, place), outside conditions: rules for print, widths, features or containers are left out
    whether they hide or show, as are those inside noscript and template.

    Null or empty html gives an empty text.  Repeated rows are rendered each for itself, null ids pass through,
    further columns are ignored.  Work is per page, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [render(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [id_column, "text", "n_chars"],
                )

    source = pages.select(id_column, html_column)
    kind = pages.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"{id_column} {kind}, text string, n_chars long")
