"""Layout-aware text of HTML pages: a tree with its implied tags, then a rendering of all that a reader would see.

The tree builder closes paragraphs, list items, cells and the like where HTML implies it, adds missing table rows, and moves text
and elements that stand loose in a table before it; elements of svg and math nest as they are written. The renderer leaves out what is not shown (head, scripts, ``hidden``, inline or
page styles with ``display:none`` or ``visibility:hidden``, closed details and dialogs), collapses white space outside ``pre``, sets
blocks on lines of their own with a blank line around paragraphs, numbers and indents lists, and aligns table cells in columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import parts

# fixed values of the HTML standard: element names by how they behave
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title script style template noscript".split())
NOT_SHOWN = frozenset("head script style template iframe noembed noframes object audio video canvas datalist rp title map svg:title svg:desc svg:metadata svg:defs svg:symbol svg:clippath svg:mask svg:pattern svg:marker svg:style svg:script math:annotation math:annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr fieldset xmp listing".split())
BLOCK = MARGIN | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav option optgroup section summary search tr td th thead tbody tfoot caption svg:text svg:foreignobject".split())
CLOSES_P = MARGIN | frozenset("address article aside center details dialog dir div dd dt figcaption footer form header hgroup li main nav section summary search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: What stays where it stands between the rows and cells of a table.
TABLE_PARTS = SECTIONS | CELLS | frozenset("tr caption colgroup col script style template".split())
#: Inside svg and math: where HTML begins again, HTML elements that end them, where svg shows text, and what math sets apart.
INTEGRATION = frozenset("svg:foreignobject svg:desc svg:title math:mi math:mo math:mn math:ms math:mtext math:annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_TEXT = frozenset("svg:text svg:tspan svg:textpath svg:a svg:foreignobject".split())
MATH_APART = frozenset("math:mfrac math:msup math:msub math:msubsup math:munder math:mover math:munderover math:mroot math:mtable math:mtr".split())
SCOPE = frozenset("html table td th caption template".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLOSES_ITSELF = re.compile(r"(?<!=)(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/\Z")
_WHITE = re.compile(r"[ \t\n\f\r]+")
_COMPOUND = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)


class Node:
    __slots__ = ("attributes", "children", "parent", "style", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None):
        self.tag, self.attributes, self.children, self.parent, self.style = tag, attributes, [], parent, None


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``("text" | "start" | "end", name or text, attributes)``"""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), {}
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), {}
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, {}
            continue
        rest = m[3].rstrip(">")
        attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(rest)} if rest else {}
        if rest.endswith("/") and _CLOSES_ITSELF.search(rest):
            # a name that no attribute can have; it counts in svg and math only
            attributes["/"] = ""
        yield "start", name, attributes
        if name in RAW or name in ESCAPABLE_RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : stop.start() if stop else n]
            if raw:
                yield "text", html.unescape(raw) if name in ESCAPABLE_RAW else raw, {}
            yield "end", name, {}
            close = page.find(">", stop.end()) if stop else -1
            at = n if close < 0 else close + 1


class _Builder:
    """``n_open``: of each tag how many elements are open; ``tables``: where the open tables are. They spare looking through a deep page."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.n_open: Counter[str] = Counter(["html"])
        self.tables: list[int] = []
        self.body: Node | None = None

    def push(self, tag: str, attributes: dict[str, str]) -> Node:
        node = Node(tag, attributes, self.open[-1])
        if self.loose() and tag not in TABLE_PARTS:
            self.before_table(node)
        else:
            self.open[-1].children.append(node)
        if tag not in VOID:
            if tag == "table":
                self.tables.append(len(self.open))
            self.open.append(node)
            self.n_open[tag] += 1
        return node

    def drop(self, i: int) -> None:
        """Closes the open elements from the i-th on."""
        for x in self.open[i:]:
            self.n_open[x.tag] -= 1
        del self.open[i:]
        while self.tables and self.tables[-1] >= i:
            self.tables.pop()

    def pop(self) -> None:
        self.drop(len(self.open) - 1)

    def before_table(self, item: Node | str) -> None:
        i = self.tables[-1] if self.tables else 0
        holder = self.open[max(i - 1, 0)]
        if isinstance(item, Node):
            item.parent = holder
        before = holder.children
        before.insert(len(before) - 1, item) if i else before.append(item)

    def clear(self, names: frozenset) -> None:
        """Closes all that stands open inside the nearest element of these names."""
        while self.open[-1].tag not in names and len(self.open) > 1:
            self.pop()

    def foreign(self, i: int = -1) -> str:
        """``svg`` or ``math`` where an open element is of theirs, else nothing."""
        kind = self.open[i].tag.partition(":")[0]
        return kind if kind in ("svg", "math") else ""

    def close(self, names: frozenset | tuple, within: frozenset = SCOPE) -> bool:
        """Closes up to the nearest open element of these names, if none of ``within`` lies between."""
        if not any(self.n_open[x] for x in names):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                self.drop(i)
                return True
            if tag in within:
                return False
        return False

    def in_body(self) -> None:
        if self.body is None:
            self.close(("head",), frozenset())
            self.body = self.push("body", {})

    def loose(self) -> bool:
        return self.open[-1].tag in SECTIONS or self.open[-1].tag in ("table", "tr")

    def text(self, s: str) -> None:
        blank = not s.strip(" \t\n\f\r")
        if self.body is None and self.open[-1].tag not in NOT_SHOWN:
            if blank:
                return
            self.in_body()
        if self.open[-1].tag == "colgroup" and not blank:
            self.pop()
        if self.loose():
            if not blank:
                self.before_table(s)
            return
        self.open[-1].children.append(s)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        kind = self.foreign()
        if kind and self.open[-1].tag not in INTEGRATION:
            if tag not in BREAKOUT:
                self.push(f"{kind}:{tag}", attributes)
                if "/" in attributes:
                    self.pop()
                return
            while self.foreign() and self.open[-1].tag not in INTEGRATION:
                self.pop()
        if tag == "html":
            self.root.attributes = attributes | self.root.attributes
            return
        if tag == "head":
            if self.body is None and len(self.open) == 1:
                self.push(tag, attributes)
            return
        if tag in ("body", "frameset"):
            if self.body is None:
                self.close(("head",), frozenset())
                self.body = self.push("body", attributes)
            return
        if self.body is None and not (tag in HEAD_ONLY or self.n_open["template"] or self.n_open["noscript"]):
            self.in_body()
        if tag in ("svg", "math"):
            self.push(tag, attributes)
            if "/" in attributes:
                self.pop()
            return
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.pop()
        if self.loose() and tag == "table":
            self.close(("table",), frozenset())
        elif self.loose() and tag == "form":
            # it stays empty: what follows is the table's
            self.open[-1].children.append(Node(tag, attributes, self.open[-1]))
            return
        if tag in CLOSES_P:
            self.close(("p",), SCOPE | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag == "li":
            self.close(("li",), SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), SCOPE | {"dl"})
        elif tag == "option":
            self.close(("option",), SCOPE | {"select", "optgroup", "datalist"})
        elif tag == "optgroup":
            self.close(("optgroup", "option"), SCOPE | {"select"})
        elif tag in ("rt", "rp"):
            self.close(("rt", "rp"), SCOPE | {"ruby"})
        elif tag == "a":
            self.close(("a",), SCOPE | BLOCK)
        elif tag == "button":
            self.close(("button",))
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("caption", "colgroup"):
            if not self.tables:
                return
            stop = frozenset({"table"})
            self.close(CELLS | {"caption"}, stop | {"tr"})
            if tag not in CELLS:
                self.close(("tr",), stop)
            if tag in SECTIONS or tag in ("caption", "colgroup"):
                self.close(SECTIONS | {"caption", "colgroup"}, stop)
            self.clear(stop | SECTIONS | {"tr"} if tag in CELLS else stop | SECTIONS if tag == "tr" else stop)
            if tag in CELLS and self.open[-1].tag != "tr":
                self.push("tr", {})
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        i = len(self.open) - 1
        while i > 0 and self.foreign(i):
            if self.open[i].tag.rpartition(":")[2] == tag:
                self.drop(i)
                return
            i -= 1
        if tag == "br":
            self.start("br", {})
        elif tag in ("html", "body") or tag in VOID:
            return
        elif tag == "p":
            if not self.close(("p",), SCOPE | {"button"}):
                self.in_body()
                self.push("p", {})
                self.pop()
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag == "li":
            self.close(("li",), SCOPE | LISTS)
        elif tag == "table" or tag in SECTIONS or tag == "tr" or tag in CELLS:
            self.close((tag,), frozenset() if tag == "table" else frozenset({"table"}))
        else:
            self.close((tag,), SCOPE - {"caption"} if tag == "caption" else SCOPE)


def parse(page: str) -> Node:
    b = _Builder()
    for kind, name, attributes in tokens(page):
        b.text(name) if kind == "text" else b.start(name, attributes) if kind == "start" else b.end(name)
    return b.root


def _style(text: str) -> dict[str, tuple[bool, str]]:
    """Whether important, and the value, of each property that matters here."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        name, plain = name.strip(), value.replace("!important", "").strip()
        if name in ("display", "visibility", "white-space") and (plain != value.strip() or not out.get(name, (False,))[0]):
            out[name] = (plain != value.strip(), plain)
    return out


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """``(selectors, declarations)`` of the rules that hold on a screen: those in ``@media`` blocks for screens or all media too."""
    at = 0
    while (start := css.find("{", at)) >= 0:
        head = css[at:start].rpartition(";")[2].strip()
        depth, end = 1, start + 1
        while end < len(css) and depth:
            depth += (css[end] == "{") - (css[end] == "}")
            end += 1
        body = css[start + 1 : end - 1 if not depth else end]
        if head.lower().startswith("@media"):
            media = head[6:].lower()
            if "(" not in media and any(x.split()[:1] in ([], ["all"], ["screen"], ["only"]) for x in media.split(",")):
                yield from _rules(body)
        elif head.lower().startswith(("@supports", "@layer")):
            yield from _rules(body)
        elif not head.startswith("@"):
            yield head, body
        at = end


class Sheet:
    """A page's own styles: rules of tags, classes and ids, also inside others (``.a .b``, ``.a > .b``), the more specific before the later.
    Rules with other selectors are left out, and so are those that depend on the size of a screen."""

    def __init__(self, root: Node):
        self.keyed: dict[str, list] = defaultdict(list)
        self.count = 0
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag in ("style", "svg:style"):
                self._read(re.sub(r"/\*.*?\*/", "", "".join(x for x in node.children if isinstance(x, str)), flags=re.S))
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def _read(self, css: str) -> None:
        for selectors, body in _rules(css):
            said = _style(body)
            for s in selectors.split(",") if said else ():
                steps = [x for x in re.split(r"\s*(>)\s*|\s+", s.strip()) if x]
                chain, near = [], False
                for step in steps:
                    if step == ">":
                        near = True
                        continue
                    m = _COMPOUND.fullmatch(step)
                    if not m or not step:
                        chain = []
                        break
                    marks = re.findall(r"[.#][\w-]+", m[2] or "")
                    chain.append((near, "" if m[1] in (None, "*") else m[1].lower(), frozenset(x[1:] for x in marks if x[0] == "."), frozenset(x[1:] for x in marks if x[0] == "#")))
                    near = False
                if not chain:
                    continue
                _, tag, classes, ids = chain[-1]
                weight = (sum(len(c[3]) for c in chain), sum(len(c[2]) for c in chain), sum(bool(c[1]) for c in chain))
                key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
                self.count += 1
                self.keyed[key].append((weight, self.count, chain, said))

    @staticmethod
    def _is(node: Node, step: tuple) -> bool:
        _, tag, classes, ids = step
        return (not tag or tag == node.tag) and ids <= {node.attributes.get("id")} and (not classes or classes <= set(node.attributes.get("class", "").split()))

    def _holds(self, node: Node, chain: list) -> bool:
        """Whether the last step is the node and those before it are elements around it."""
        if not self._is(node, chain[-1]):
            return False
        if len(chain) == 1:
            return True
        up = node.parent
        while up is not None:
            if self._holds(up, chain[:-1]):
                return True
            up = None if chain[-1][0] else up.parent
        return False

    def of(self, node: Node) -> dict[str, str]:
        if node.style is None:
            a = node.attributes
            keys = [node.tag, "", *(["#" + a["id"]] if "id" in a else ()), *("." + x for x in set(a.get("class", "").split()))] if self.keyed else []
            found = [(weight, order, said) for key in keys for weight, order, chain, said in self.keyed.get(key, ()) if self._holds(node, chain)]
            found.sort(key=lambda x: x[:2])
            said = [x[2] for x in found] + ([_style(a["style"])] if "style" in a else [])
            node.style = {k: v for important in (False, True) for one in said for k, (i, v) in one.items() if i == important}
        return node.style


def shown(node: Node, style: dict[str, str], parent: Node | None) -> bool:
    """Whether a node takes part in the layout."""
    if node.tag in NOT_SHOWN or node.tag == "dialog" and "open" not in node.attributes:
        return False
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False
    display = style.get("display")
    return display != "none" and ("hidden" not in node.attributes or bool(display))


class _Page:
    """Lines of text, filled from left to right."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, blank: bool) -> None:
        self.flush()
        self.gap = max(self.gap, 2 if blank else 1)

    def begin(self) -> None:
        if self.line:
            return
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.line = [lead] if lead else [""]

    def text(self, s: str) -> None:
        s = _WHITE.sub(" ", s)
        if not s:
            return
        if s[0] == " ":
            self.space = True
            s = s[1:]
        if not s:
            return
        tail = s[-1] == " "
        s = s.rstrip(" ")
        fresh = not self.line
        self.begin()
        if self.space and not fresh:
            self.line.append(" ")
        self.line.append(s)
        self.space = tail

    def raw(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self.begin()
                self.line.append(part)
                self.space = False

    def newline(self) -> None:
        if self.line:
            self.flush()
        else:
            self.begin()
            self.flush()

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        first = next((i for i, x in enumerate(lines) if x), 0)
        return lines[first:]


def _number(text: str | None, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(text or "")))
    except ValueError:
        return low


def _seen(style: dict[str, str], seen: bool) -> bool:
    """Whether text is visible under an element of this style, in one where it was ``seen``."""
    return style["visibility"] not in ("hidden", "collapse") if "visibility" in style else seen


def _table(node: Node, sheet: Sheet, visible: bool, tables: dict[int, list[str]]) -> list[str]:
    """A table's lines: the caption, then its rows with the cells of a column under each other."""
    out, grid, widths, hangs = [], [], {}, {}
    groups = []
    for child in node.children:
        if isinstance(child, Node) and shown(child, sheet.of(child), node):
            seen = _seen(sheet.of(child), visible)
            if child.tag in SECTIONS:
                groups.append((child.tag, [(r, _seen(sheet.of(r), seen)) for r in child.children if isinstance(r, Node) and r.tag == "tr" and shown(r, sheet.of(r), child)]))
            elif child.tag == "tr":
                groups.append(("tbody", [(child, seen)]))
            elif child.tag == "caption":
                out += render(child, sheet, seen, tables)
    order = {"thead": 0, "tbody": 1, "tfoot": 2}
    for _, rows in sorted(groups, key=lambda g: order[g[0]]):
        for tr, seen in rows:
            cells, column = [], 0
            for td in tr.children:
                if not isinstance(td, Node) or td.tag not in CELLS or not shown(td, sheet.of(td), tr):
                    continue
                while hangs.get(column, 0) > 0:
                    hangs[column] -= 1
                    column += 1
                span = _number(td.attributes.get("colspan"), 1, 1000)
                down = _number(td.attributes.get("rowspan"), 1, 65534)
                lines = render(td, sheet, _seen(sheet.of(td), seen), tables)
                cells.append((column, span, lines))
                if span == 1:
                    widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
                if down > 1:
                    for c in range(column, column + span):
                        hangs[c] = down - 1
                column += span
            for c in [c for c in hangs if c >= column and hangs[c] > 0]:
                hangs[c] -= 1
            grid.append(cells)
    columns = sorted({c for cells in grid for c, _, _ in cells} | set(widths))
    left, at = {}, 0
    for c in columns:
        left[c] = at
        at += widths.get(c, 0) + 2 if widths.get(c, 0) else 0
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            row = ""
            for c, _, lines in cells:
                if k < len(lines) and lines[k]:
                    row = row.ljust(left[c]) if len(row) <= left[c] else row + "  "
                    row += lines[k]
            out.append(row.rstrip())
    return out


def _tables(root: Node, sheet: Sheet) -> dict[int, list[str]]:
    """The lines of each table in a page. Inner tables come first, so however deep they nest nothing calls itself."""
    found, stack = [], [(root, True)]
    while stack:
        node, seen = stack.pop()
        for x in node.children:
            if isinstance(x, Node) and shown(x, sheet.of(x), node):
                inner = _seen(sheet.of(x), seen)
                if x.tag == "table":
                    found.append((x, inner))
                stack.append((x, inner))
    # an element is met before those inside of it
    out: dict[int, list[str]] = {}
    for node, seen in reversed(found):
        out[id(node)] = _table(node, sheet, seen, out)
    return out


def render(root: Node, sheet: Sheet, visible: bool, tables: dict[int, list[str]]) -> list[str]:
    """The lines of everything below ``root``, with those of its ``tables``."""
    page = _Page()
    # (node, parent, visible, in pre, list state); a tuple ("end", node) leaves it
    stack: list = [(x, root, visible, root.tag in ("pre", "listing", "xmp")) for x in reversed(root.children)]
    counters: list[list] = []
    while stack:
        item = stack.pop()
        if item[0] is None:
            node = item[1]
            if node.tag in LISTS:
                counters.pop()
            if node.tag in ("li", "dd", "blockquote"):
                page.flush()
                page.indent.pop()
                page.marker = ""
            page.block(node.tag in MARGIN and not (node.tag in LISTS and counters))
            continue
        node, parent, seen, pre = item
        if isinstance(node, str):
            if seen and (parent.tag in SVG_TEXT or not parent.tag.startswith("svg")):
                page.raw(node) if pre else page.text(node)
            continue
        style = sheet.of(node)
        if not shown(node, style, parent):
            continue
        seen = _seen(style, seen)
        tag = node.tag
        if tag == "br":
            page.newline() if seen else None
            continue
        if tag == "wbr":
            continue
        if tag == "table":
            page.block(True)
            for line in tables[id(node)]:
                page.raw(line) if line else None
                page.newline()
            page.block(True)
            continue
        display = style.get("display", "")
        boxed = tag in BLOCK or display in ("block", "flex", "grid", "list-item", "table")
        if tag in BLOCK and display in ("inline", "inline-block", "inline-flex"):
            boxed = False
        if boxed:
            page.block(tag in MARGIN and not (tag in LISTS and counters))
            stack.append((None, node))
            if tag in LISTS:
                counters.append([tag, _number(node.attributes.get("start"), -(10**9), 10**9) if "start" in node.attributes else 1])
            elif tag == "li":
                if "value" in node.attributes and counters:
                    counters[-1][1] = _number(node.attributes["value"], -(10**9), 10**9)
                mark = f"{counters[-1][1]}. " if counters and counters[-1][0] == "ol" else "- "
                if counters:
                    counters[-1][1] += 1
                page.indent.append(" " * len(mark))
                page.marker = mark
            elif tag in ("dd", "blockquote"):
                page.indent.append("  ")
        elif tag in LISTS or tag in ("li", "dd", "blockquote"):
            stack.append((None, node))
            counters.append([tag, 1]) if tag in LISTS else page.indent.append("")
        children = node.children
        pre = pre or tag in ("pre", "listing", "xmp", "textarea") or style.get("white-space", "").startswith("pre")
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        if tag in MATH_APART:
            children = [y for x in children for y in (x, " ")]
        stack += [(x, node, seen, pre) for x in reversed(children)]
    return page.done()


def html_text(page: str | None) -> str:
    """All that a reader of the page would see; empty for a null or empty page."""
    if not page:
        return ""
    root = parse(page)
    sheet = Sheet(root)
    return "\n".join(render(root, sheet, True, _tables(root, sheet)))


def _texts(batches):
    for batch in parts(batches, column="html"):
        texts = [html_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages`` (page_id, url, html; other columns are left alone).

    Null or empty html gives an empty text; null ids and addresses stay null; repeated rows each return a row; pages of any length are
    read whole. An empty table gives an empty result.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_texts, "page_id long, url string, text string")
