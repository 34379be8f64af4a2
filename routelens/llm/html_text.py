"""Layout-aware text of HTML pages.

A tree builder reads tags as browsers do: void elements, raw text, and implied tags (a paragraph ends before a block, a list item
before the next, cells imply rows and rows imply table bodies, text out of place in a table moves before it). Visibility rules drop
what is not shown: head, script, style, template, noscript, closed details and dialogs, and what hidden attributes, inline styles
and style sheets hide by display or visibility. Of style sheets the rules count that hold on a screen SCREEN_WIDTH pixels wide (not
those for print, or under conditions on anything but widths), with selectors of tags, classes and ids and of descendants and children
of such, by their usual precedence; selectors with siblings, attributes or pseudo-classes are not followed. Visibility is inherited, and a visible element within a hidden one is shown. The
rest, values of text fields and texts of math and svg among it, is rendered: blank lines around paragraphs, headings, lists and
tables, line breaks between other blocks, markers and indents of lists, `> ` before quotations, preformatted text as it is, and
table cells aligned in columns, spans included.

No text is cut and none shown that these rules hide, however large or deep the page. Layout alone has limits: cells with others behind them are
wrapped between words at WIDEST characters, a cell that reaches into the next column moves what follows to another line, rows of
tables wider than WIDE_TABLE have a line for each cell, tables within DEEPEST others are rendered as blocks, and indents stop at
INDENTS levels. Spans count up to the bounds of the HTML standard. So time and output are linear in the page, but for rows under
many open row spans, which are gone through in each row.

Null html: null text and title. Empty html: empty text. Malformed html never fails. Very long pages are rendered whole, one at a time.
Repeated rows get equal results, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks, text_buffer

WIDEST, WIDE_TABLE, DEEPEST, INDENTS = 60, 1000, 12, 40
#: The largest column and row spans. Fixed values of the HTML standard.
COLUMN_SPAN, ROW_SPAN = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object video audio canvas map".split())
#: Not shown within svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript head".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section select summary tr td th thead tbody tfoot caption".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split()
)
#: A start tag closes these open elements, unless one of the others lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot", "caption")},
}
#: Within these only parts of tables stand where they are.
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
#: Inputs that show no text.
NO_TEXT = frozenset("hidden password checkbox radio file image range color".split())
SCOPE = frozenset({"table", "td", "th", "caption", "html", "button"})
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"""(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT_END = re.compile(r"--!?>")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
#: Pixels, and pixels of a unit of length, for conditions on the width of the screen.
SCREEN_WIDTH, PIXELS = 1280, {"px": 1, "em": 16, "rem": 16}
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9]*\.?[0-9]+)(px|em|rem)\s*\)")
_COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][A-Za-z_-][\w-]*)*)")


class Node:
    __slots__ = ("tag", "attrs", "children", "rules")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.rules: list[tuple] = []  # of selectors that look at elements around this one


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is text, raw, start or end."""
    at, n, lower = 0, len(page), None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        if page.startswith("<!--", lt):
            end = _COMMENT_END.search(page, lt + 2)
            at = n if end is None else end.end()
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            yield "text", page[lt + 9 : n if end < 0 else end], {}
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?") and lt + 1 < n:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            yield "text", "<", {}
            at = lt + 1
            continue
        name, at, attrs, closed = m[0].lower(), m.end(), {}, False
        while True:
            skipped = _SKIP.match(page, at).end()
            closed, at = skipped > at and page[skipped - 1] == "/", skipped
            if at >= n or page[at] == ">":
                break
            a = _ATTR.match(page, at)
            if a[1]:
                attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            at = max(a.end(), at + 1)
        at = min(n, at + 1)
        if closed:
            attrs["/"] = ""
        yield ("end" if closing else "start"), name, attrs
        if not closing and name in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != n:  # a letter whose lower case is longer
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find("</" + name, at)
            end = n if end < 0 else end
            yield "raw", page[at:end], {}
            at = end


class Open:
    """The open elements, and where each kind of them stands last."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.at = [], {}
        for node in nodes:
            self.push(node)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, index: int) -> None:
        while len(self.nodes) > index:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags: frozenset[str] | set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def find(self, tags: frozenset[str] | set[str], stop: frozenset[str] | set[str]) -> int:
        """The last open element of these tags with none of the others behind it; -1 if there is none below the body."""
        i = self.last(tags)
        return i if i > 1 and i >= self.last(stop) else -1


def build(page: str) -> tuple[Node, list[str], str | None]:
    """The tree, the texts of style sheets, and the title."""
    root = Node("html", {})
    body, head = Node("body", {}), Node("head", {})
    root.children = [head, body]
    open_, styles, title = Open([root, body]), [], None
    in_head = False

    def append(item: object, moves: bool) -> None:
        """Adds to the innermost open element, or before the table if it can't stand within one."""
        nodes = open_.nodes
        if moves and nodes[-1].tag in IN_TABLE:
            table = open_.last({"table"})
            if table > 0:
                before = nodes[table - 1].children
                before.insert(len(before) - 1, item)
                return
        nodes[-1].children.append(item)

    def put(node: Node) -> None:
        open_.nodes[-1].children.append(node)
        open_.push(node)

    for kind, name, attrs in tokens(page):
        inner = open_.nodes[-1]
        if kind in ("text", "raw"):
            value = name if kind == "raw" and inner.tag in ("script", "style") else html.unescape(name)
            if inner.tag == "style":
                styles.append(value)
            elif inner.tag == "title" and title is None:
                title = _SPACE.sub(" ", value).strip()
            blank = not value.strip()
            if not (in_head and inner is body and blank):
                append(value, not blank)
            continue
        if kind == "end":
            if name in ("head", "html", "body"):
                in_head = False
                continue
            if name == "br":
                append(Node("br", {}), True)
                continue
            tags = {name}
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                tags = {"h1", "h2", "h3", "h4", "h5", "h6"}
            i = open_.find(tags, frozenset({"html"}) if name in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else SCOPE - {name})
            if i > 0:
                open_.cut(i)
            elif name == "p":
                append(Node("p", {}), True)
            continue
        if name in ("html", "body"):
            node = root if name == "html" else body
            node.attrs.update({k: v for k, v in attrs.items() if k not in node.attrs})
            in_head = False
            continue
        if name == "head":
            in_head = True
            continue
        if name in CLOSES_P and (i := open_.find({"p"}, SCOPE)) > 0:
            open_.cut(i)
        if name in CLOSES:
            tags, stop = CLOSES[name]
            while (i := open_.find(tags, stop)) > 0:
                open_.cut(i)
            if name in ("td", "th", "tr"):
                inner = open_.nodes[-1].tag
                if name != "tr" and inner in ("table", "thead", "tbody", "tfoot"):
                    if inner == "table":
                        put(Node("tbody", {}))
                    put(Node("tr", {}))
                elif name == "tr" and inner == "table":
                    put(Node("tbody", {}))
                elif not open_.at.get("table"):
                    continue  # a row or cell outside any table
        if name == "form" and open_.nodes[-1].tag in IN_TABLE:
            continue  # its fields stay where they are
        node = Node(name, attrs)
        append(node, name not in TABLE_PARTS)
        if "/" in attrs and name not in RAW and (open_.at.get("svg") or open_.at.get("math")):
            continue
        if name not in VOID:
            open_.push(node)
    return root, styles, title


def css_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on any screen, in one pass."""
    css = _CSS_COMMENT.sub(" ", sheet)
    blocks, begin = [], 0  # of open blocks: whether rules within count, or the start of a rule's declarations
    for m in re.finditer(r"[{};]", css):
        in_rule = bool(blocks) and not isinstance(blocks[-1], bool)
        if m[0] == "{":
            prelude = css[begin : m.start()].strip()
            counts = all(b is True for b in blocks)
            if in_rule:
                blocks.append(False)
            elif not prelude.startswith("@"):
                blocks.append((prelude if counts else None, m.end()))
            else:
                name = re.match(r"@[\w-]*", prelude)[0].lower()
                blocks.append(counts and (name in ("@layer", "@supports") or name == "@media" and _on_screen(prelude[6:])))
            begin = m.end()
        elif m[0] == "}":
            if blocks:
                block = blocks.pop()
                if not isinstance(block, bool) and block[0] is not None:
                    yield block[0], css[block[1] : m.start()]
            begin = m.end()
        elif not in_rule:
            begin = m.end()


def _on_screen(queries: str) -> bool:
    return any(_holds([part.strip() for part in re.split(r"\band\b", q.lower())]) for q in queries.split(","))


def _holds(parts: list[str]) -> bool:
    """Whether all parts of a media query hold on the screen."""
    if parts[0] == "not print":
        return True
    widths = parts[1:] if parts[0] in ("", "all", "screen", "only screen", "only all") else parts
    found = [_WIDTH.fullmatch(part) for part in widths]
    return all(m is not None and (float(m[2]) * PIXELS[m[3]] <= SCREEN_WIDTH if m[1] == "min" else float(m[2]) * PIXELS[m[3]] >= SCREEN_WIDTH) for m in found)


def _declared(declarations: str) -> dict[str, tuple[bool, str]]:
    """Of display and visibility, where declared: whether important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for part in declarations.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, important, _ = value.lower().partition("!important")
            if bool(important) >= out.get(name, (False, ""))[0]:
                out[name] = bool(important), value.strip()
    return out


def _names(node: Node) -> set[str]:
    """Classes and id of an element, as selectors name them."""
    return {"." + c for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if "id" in node.attrs else set())


class Styles:
    """Rules of style sheets about display and visibility."""

    def __init__(self, sheets: list[str]):
        self.simple: dict[str, dict[str, tuple]] = {}
        self.compound: dict[str, list[tuple]] = {}
        self.chains: list[tuple] = []
        self.starts: dict[str, list[int]] = {}
        order = 0
        for selectors, declarations in (r for s in sheets for r in css_rules(s)):
            declared = _declared(declarations)
            for selector in selectors.split(",") if declared else ():
                steps = re.split(r"\s*(>)\s*|\s+", selector.strip())
                found = [_COMPOUND.fullmatch(step) for step in steps[::2]]
                if not all(m is not None and m[0] for m in found):
                    continue
                order += 1
                chain = [((m[1] or "").lower().replace("*", ""), frozenset(re.findall(r"[.#][^.#]+", m[2]))) for m in found]
                every = [p for _, parts in chain for p in parts]
                weight = (sum(p[0] == "#" for p in every), sum(p[0] == "." for p in every), sum(bool(tag) for tag, _ in chain))
                rules = [(name, ((important, *weight, order), value)) for name, (important, value) in declared.items()]
                tag, parts = chain[0]
                key = max(sorted(parts), key=lambda p: p[0] == "#", default=tag or "*")
                if len(chain) > 1:
                    self.starts.setdefault(key, []).append(len(self.chains))
                    self.chains.append((chain, [sign == ">" for sign in steps[1::2]], rules))
                    continue
                for name, rule in rules:
                    if len(parts) + bool(tag) <= 1:
                        held = self.simple.setdefault(key, {})
                        held[name] = max(held.get(name, rule), rule)
                    else:
                        self.compound.setdefault(key, []).append((tag, parts, name, rule))

    def follow(self, root: Node) -> None:
        """Gives each element the rules whose selectors look at the elements that it lies in.

        One walk down the tree carries how far each selector has been met: by any element above, or by the parent for a child. An element
        is asked about those states and the selectors that may begin with it, however deep it lies.
        """
        stack: list[tuple[Node, frozenset, set]] = [(root, frozenset(), set())] if self.chains else []
        while stack:
            node, below, of_parent = stack.pop()
            names, of_node = _names(node), set()
            begin = {(i, 0) for key in (node.tag, "*", *names) for i in self.starts.get(key, ())}
            for i, k in begin | below | of_parent:
                chain, direct, rules = self.chains[i]
                tag, parts = chain[k]
                if (tag and tag != node.tag) or not parts <= names:
                    continue
                if k + 1 == len(chain):
                    node.rules.extend(rules)
                elif direct[k]:
                    of_node.add((i, k + 1))
                elif (i, k + 1) not in below:
                    below = below | {(i, k + 1)}
            stack += [(child, below, of_node) for child in node.children if not isinstance(child, str)]

    def of(self, node: Node) -> tuple[bool, str | None]:
        """Whether the element is displayed, and its own visibility, if it has one."""
        a, best = node.attrs, {}
        if self.simple or self.compound:
            names = _names(node)
            for key in (node.tag, "*", *names):
                for name, rule in self.simple.get(key, {}).items():
                    best[name] = max(best.get(name, rule), rule)
                for tag, parts, name, rule in self.compound.get(key, ()):
                    if (not tag or tag == node.tag) and parts <= names:
                        best[name] = max(best.get(name, rule), rule)
        for name, rule in node.rules:
            best[name] = max(best.get(name, rule), rule)
        if "style" in a:
            for name, (important, value) in _declared(a["style"]).items():
                rule = ((important, 1 << 30), value)
                best[name] = max(best.get(name, rule), rule)
        display = best["display"][1] if "display" in best else "none" if "hidden" in a else ""
        return display != "none", best["visibility"][1] if "visibility" in best else None


class Frame:
    """An element that is being rendered."""

    __slots__ = ("node", "children", "pre", "shown", "in_item", "drawing", "number", "gap", "indented")

    def __init__(self, node: Node, above: Frame | None, shown: bool):
        tag = node.tag
        self.node, self.children, self.shown = node, iter(node.children), shown
        self.pre = tag in ("pre", "textarea", "xmp") or above is not None and above.pre
        self.in_item = tag == "li" or above is not None and above.in_item
        self.drawing = tag in ("svg", "math") or above is not None and above.drawing
        self.number = None if above is None else above.number  # of the list's last item; None in a list without numbers
        self.gap, self.indented = 1, False


class Renderer:
    """Lines of text with pending breaks, indents and list markers."""

    def __init__(self, styles: Styles, depth: int = 0, shown: bool = True):
        self.styles, self.depth, self.shown = styles, depth, shown
        self.lines, self.parts, self.gap, self.indents, self.marker, self.as_is = [], [], 0, [], "", False

    def displayed(self, node: Node, shown: bool) -> tuple[bool, bool]:
        """Whether the element takes part in the layout, and whether its text is shown."""
        a = node.attrs
        if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a):
            return False, False
        displayed, visibility = self.styles.of(node)
        return displayed, shown if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")

    def text(self, value: str, pre: bool) -> None:
        if pre:
            self.as_is = True
            first, *rest = value.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in rest:
                self.flush(True)
                self.as_is = True
                self.parts.append(line)
            return
        value = _SPACE.sub(" ", value)
        if value[:1] == " " and (not self.parts or self.parts[-1].endswith(" ")):
            value = value[1:]
        if value:
            self.parts.append(value)

    def flush(self, keep_empty: bool = False) -> None:
        """Ends the current line."""
        line = "".join(self.parts)
        line = line.rstrip() if keep_empty or self.as_is else line.strip(" ")
        self.parts, self.as_is = [], False
        if line or (keep_empty and self.lines):
            self.put(line.replace("\xa0", " "))

    def put(self, line: str) -> None:
        if self.lines and self.gap == 2 and self.lines[-1] != "":
            self.lines.append("".join(self.indents).rstrip() if any(i.startswith(">") for i in self.indents) else "")
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((indent + line).rstrip())
        self.gap = 0

    def break_(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def render(self, root: Node) -> None:
        stack = [Frame(root, None, self.shown)]
        while stack:
            frame = stack[-1]
            child = next(frame.children, None)
            if child is None:
                stack.pop()
                self.leave(frame)
                continue
            node = frame.node
            if node.tag == "details" and "open" not in node.attrs and (isinstance(child, str) or child.tag != "summary"):
                continue
            if isinstance(child, str):
                if frame.shown:
                    self.text(child, frame.pre)
                continue
            displayed, shown = self.displayed(child, frame.shown)
            if not displayed or (frame.drawing and child.tag in UNDRAWN):
                continue
            tag = child.tag
            if tag == "br":
                self.flush(True)
            elif tag == "hr":
                self.break_(2)
            elif tag == "wbr" or tag == "img":
                continue
            elif tag == "input":
                if shown and child.attrs.get("type", "text").lower() not in NO_TEXT:
                    self.text(child.attrs.get("value", ""), False)
            elif tag == "table" and self.depth < DEEPEST:
                self.break_(2)
                self.table(child, shown)
                self.break_(2)
            else:
                inner = Frame(child, frame, shown)
                self.enter(inner, frame)
                stack.append(inner)
        self.flush()

    def indent(self, frame: Frame, by: str) -> None:
        if len(self.indents) < INDENTS:
            self.indents.append(by)
            frame.indented = True

    def enter(self, frame: Frame, above: Frame) -> None:
        node, tag = frame.node, frame.node.tag
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and above.in_item
            frame.gap = 1 if nested or tag not in SPACED else 2
            if not (self.marker and not self.parts):  # a block that opens an item stands beside its marker
                self.break_(frame.gap)
        if tag == "blockquote":
            self.indent(frame, "> ")
        elif tag == "dd":
            self.indent(frame, "  ")
        elif tag == "li":
            mark = "- "
            if above.number is not None:
                value = node.attrs.get("value", "").strip()
                above.number[0] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else above.number[0] + 1
                mark = f"{above.number[0]}. "
            self.indent(frame, " " * len(mark))
            self.marker = mark
        elif tag == "ol":
            start = node.attrs.get("start", "").strip()
            frame.number = [int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0]
        elif tag in ("ul", "menu"):
            frame.number = None

    def leave(self, frame: Frame) -> None:
        tag = frame.node.tag
        if tag in BLOCK and tag != "html":
            self.break_(frame.gap)
        if tag == "li":
            if self.marker:  # an empty item
                self.put("")
            self.marker = ""
        if frame.indented:
            self.indents.pop()

    def cell(self, node: Node, shown: bool) -> list[str]:
        inner = Renderer(self.styles, self.depth + 1, shown)
        shell = Node("html", {})
        shell.children = node.children
        inner.render(shell)
        return inner.lines or [""]

    def table(self, table: Node, shown: bool) -> None:
        rows, captions = [], []
        for child in table.children:
            if isinstance(child, str):
                continue
            displayed, seen = self.displayed(child, shown)
            if displayed and child.tag == "caption":
                captions.append((child, seen))
            elif displayed and child.tag == "tr":
                rows.append((child, seen))
            elif displayed and child.tag in ("thead", "tbody", "tfoot"):
                for row in child.children:
                    if not isinstance(row, str) and row.tag == "tr":
                        displayed, of_row = self.displayed(row, seen)
                        if displayed:
                            rows.append((row, of_row))
        for caption, seen in captions:
            for line in self.cell(caption, seen):
                self.put(line)
        grid, taken = [], []  # taken: first and last (exclusive) column and rows left of row spans, in order
        for row, seen in rows:
            cells, column, spans, k = [], 0, [], 0
            for node in row.children:
                if isinstance(node, str) or node.tag not in ("td", "th"):
                    continue
                displayed, of_cell = self.displayed(node, seen)
                if not displayed:
                    continue
                while k < len(taken) and taken[k][0] <= column:
                    column = max(column, taken[k][1])
                    k += 1
                wide, tall = _span(node.attrs.get("colspan", ""), COLUMN_SPAN), _span(node.attrs.get("rowspan", ""), ROW_SPAN)
                cells.append((column, wide, self.cell(node, of_cell)))
                if tall > 1:
                    spans.append((column, column + wide, tall))
                column += wide
            taken = sorted([(a, b, left - 1) for a, b, left in (*taken, *spans) if left > 1])
            if cells:
                grid.append(cells)
        self.rows(grid)

    def rows(self, grid: list[list[tuple[int, int, list[str]]]]) -> None:
        """Lines of a table whose cells have a column, a width in columns, and lines. The last cell of a row may be as long as it likes."""
        width: dict[int, int] = {}
        for cells in grid:
            for k, (column, wide, lines) in enumerate(cells[:-1]):
                if max(map(len, lines)) > WIDEST:
                    lines = [part for line in lines for part in (textwrap.wrap(line, WIDEST, break_long_words=False, break_on_hyphens=False) if len(line) > WIDEST else [line])]
                    cells[k] = column, wide, lines
                if wide == 1:
                    width[column] = max(width.get(column, 0), max(map(len, lines)))
        used = sorted(width)
        offsets = list(itertools.accumulate((width[c] + 2 for c in used), initial=0))
        wider: dict[int, int] = {}  # what cells over several columns lack
        for cells in grid:
            for column, wide, lines in cells[:-1]:
                if wide > 1:
                    first, last = bisect.bisect_left(used, column), bisect.bisect_left(used, column + wide)
                    at = used[last - 1] if last > first else column + wide - 1
                    wider[at] = max(wider.get(at, 0), max(map(len, lines)) - max(0, offsets[last] - offsets[first] - 2))
        width = {c: width.get(c, 0) + wider.get(c, 0) for c in (*width, *wider)}
        used = sorted(width)
        offsets = list(itertools.accumulate((width[c] + 2 for c in used), initial=0))
        if offsets[-1] > WIDE_TABLE:
            for line in (line for cells in grid for _, _, lines in cells for line in lines):
                self.put(line)
            return
        for cells in grid:
            starts = [offsets[bisect.bisect_left(used, column)] for column, _, _ in cells]
            for k in range(max(len(lines) for _, _, lines in cells)):
                out, at = [], 0
                for start, (_, _, lines) in zip(starts, cells, strict=True):
                    line = lines[k] if k < len(lines) else ""
                    if not line:
                        continue
                    if out and start < at + 2:
                        self.put("".join(out))
                        out, at = [], 0
                    out.append(" " * (start - at) + line)
                    at = start + len(line)
                self.put("".join(out))


def _span(value: str, most: int) -> int:
    value = value.strip()
    return min(most, max(1, int(value))) if re.fullmatch(r"[0-9]{1,6}", value) else 1


def page_text(page: str) -> tuple[str, str | None]:
    """Visible text with its layout, and the title."""
    root, sheets, title = build(page)
    styles = Styles(sheets)
    styles.follow(root)
    displayed, visibility = styles.of(root)
    renderer = Renderer(styles, shown=visibility not in ("hidden", "collapse"))
    if displayed:
        renderer.render(root)
    return "\n".join(renderer.lines).strip("\n"), title


def extract(pages: DataFrame, html_col: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, title and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(text_buffer(b.column(2))[1]):
                part = b.slice(lo, hi - lo)
                found = [(None, None) if x is None else page_text(x) for x in part.column(2).to_pylist()]
                text, title = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), title, text], names=["page_id", "url", "title", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url, html_col).mapInArrow(run, f"page_id {kind}, url string, title string, text string")
