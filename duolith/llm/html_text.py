"""Visible text of HTML pages, laid out as a browser without styling would.

A tolerant tree builder closes implied tags; visibility rules, for a screen, drop
what is not shown; the renderer keeps block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame

from duolith.llm.common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd figcaption form details summary tr caption center legend option search hgroup menu dir dialog".split())
CLOSES_P = BLOCKS - frozenset("html body tr caption dt dd option".split())
#: An opening tag closes these, looking up to the limits.
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
} | {t: (frozenset("tr td th caption colgroup thead tbody tfoot".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")}
#: Elements that a stray closing tag inside cannot reach over.
WALLS = frozenset("td th table caption html body template".split())
TABULAR = frozenset("table tr td th thead tbody tfoot caption".split())
DEEPEST = 200

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CSS_MARK = re.compile(r"[{}]")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
SIMPLE = re.compile(r"(?P<tag>[a-z][\w-]*)?(?P<mark>[.#][\w-]+)?")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Width of the screen, in pixels, for which style sheets are read.
SCREEN = 1280


class Node:
    """gone: not laid out, with all inside it; seen: its own text shows."""

    __slots__ = ("tag", "attrs", "children", "gone", "seen")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.gone, self.seen = tag, attrs, [], False, True


def attributes(told: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(told):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Tags:
    """The tags of a page, one after the other, in time linear in its length.

    A quoted value may hold a closing bracket. Where that leaves a tag without end,
    quotes don't count from there on; a tag without any closing bracket is text.
    """

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def end(self, at: int) -> int:
        """Place after the bracket that closes a tag whose name ends at `at`."""
        html, place = self.html, at
        while self.quotes:
            m = STOP.search(html, place)
            if not m:
                self.quotes = False
                break
            place = m.end()
            if m[0] == ">":
                return place
            if html[at : m.start()].rstrip().endswith("=") if m.start() - at < 64 else html[m.start() - 64 : m.start()].rstrip().endswith("="):
                closing = html.find(m[0], place)
                if closing < 0:
                    self.quotes = False
                    break
                place = closing + 1
        return html.find(">", at) + 1

    def next(self, place: int) -> tuple[int, int, str, bool, str] | None:
        """Start and end, name (none for comments and declarations), whether it closes, and attributes of the next tag."""
        html = self.html
        while 0 <= (at := html.find("<", place)) <= self.last or at >= 0 and html.startswith("<!--", at):
            if html.startswith("<!--", at):
                closing = html.find("-->", at + 4)
                return at, closing + 3 if closing >= 0 else len(html), "", False, ""
            if html.startswith(("<!", "<?"), at):
                return at, html.find(">", at) + 1, "", False, ""
            closes = html.startswith("/", at + 1)
            if m := NAME.match(html, at + 1 + closes):
                end = self.end(m.end())
                return at, end, m[0].lower(), closes, html[m.end() : end - 1]
            place = at + 1
        return None


def build(html: str) -> tuple[Node, str]:
    """The tree and the text of its style sheets."""
    root = Node("html", {})
    open_: list[Node] = [root]
    styles: list[str] = []
    place = 0

    def close(tags: frozenset, walls: frozenset) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in walls:
                return
            if open_[i].tag in tags:
                del open_[i:]
                if tags & {"tr", "thead"}:  # further ones of a table may be open
                    return close(tags, walls)
                return

    tags = Tags(html)
    while found := tags.next(place):
        start, end, tag, closes, told = found
        if start > place:
            open_[-1].children.append(unescape(html[place:start]))
        place = end
        if not tag:
            continue
        if closes:
            if tag == "p" and all(n.tag != "p" for n in open_):
                open_[-1].children.append(Node("p", {}))
            elif tag == "br":
                open_[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                close(frozenset([tag]), (frozenset(["table"]) if tag in TABULAR else WALLS) - {tag})
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), WALLS | {"button"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        attrs = attributes(told) if told and not told.isspace() else {}
        if tag in ("html", "body"):
            continue
        if tag == "head":
            attrs = {}
        if open_[-1].tag == "head" and tag not in RAW and tag not in VOID and tag not in ("noscript", "template"):
            open_.pop()
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, place)
            inner = html[place : end.start() if end else len(html)]
            place = min(len(html), html.find(">", end.start()) + 1 or len(html)) if end else len(html)
            if tag == "style":
                styles.append(inner)
            elif tag == "textarea":
                node.children.append(unescape(inner))
        elif tag not in VOID and not (told.endswith("/") and any(n.tag in ("svg", "math") for n in [*open_, node])) and len(open_) < DEEPEST:
            open_.append(node)
    if place < len(html):
        open_[-1].children.append(unescape(html[place:]))
    return root, "\n".join(styles)


def applies(condition: str) -> bool:
    """Whether the block of a media rule counts on a screen of SCREEN pixels; unknown conditions don't."""
    for query in condition.lower().split(","):
        words = re.sub(r"\(\s*(min|max)-width\s*:\s*([\d.]+)px\s*\)", lambda m: "all" if (float(m[2]) <= SCREEN) == (m[1] == "min") or float(m[2]) == SCREEN else "never", query).split()
        if words and all(w in ("screen", "all", "only", "and") for w in words):
            return True
    return False


class Sheet:
    """What a page's style sheets say of display and visibility, for single selectors (tag, .class, #id, tag.class, tag#id).

    The more special selector wins, then the later rule; !important comes before both.
    """

    def __init__(self, css: str):
        self.rules: dict[str, list[tuple[tuple, str, str, bool]]] = {}  # by mark or tag: weight, tag, property, whether it shows
        self.count = 0
        stack: list[bool] = []  # of each open block, whether what it holds counts
        head, place, css = None, 0, COMMENT.sub(" ", css)
        for m in CSS_MARK.finditer(css):
            told, place = css[place : m.start()], m.end()
            if m[0] == "}":
                if stack and stack.pop() and head is not None:
                    self.add(head, told)
                head = None
                continue
            head = told.rsplit(";", 1)[-1].strip().lower()
            outer = not stack or stack[-1]
            if head.startswith("@"):
                stack.append(outer and (head.startswith("@media") and applies(head[6:]) or head.startswith("@supports") or head.startswith("@layer")))
                head = None
            else:
                stack.append(outer)

    def add(self, head: str, body: str) -> None:
        said = declarations(body)
        if not said:
            return
        for selector in head.split(","):
            m = SIMPLE.fullmatch(selector.strip())
            if m and m[0]:
                mark = m["mark"] or ""
                weight = (mark.startswith("#"), mark.startswith("."), bool(m["tag"]))
                self.count += 1
                for name, (shows, urgent) in said.items():
                    self.rules.setdefault(mark or m["tag"], []).append(((urgent, *weight, self.count), m["tag"] or "", name, shows))

    def of(self, node: Node) -> dict[str, bool]:
        """display and visibility of an element, as far as something is said of them: true if it shows."""
        a = node.attrs
        names = [node.tag, *(f".{c}" for c in a.get("class", "").lower().split()), *([f"#{a['id'].lower()}"] if a.get("id") else [])]
        best: dict[str, tuple[tuple, bool]] = {}
        for name in names:
            for weight, tag, what, shows in self.rules.get(name, ()):
                if (not tag or tag == node.tag) and (what not in best or weight > best[what][0]):
                    best[what] = weight, shows
        if "style" in a:
            for what, (shows, urgent) in declarations(a["style"]).items():
                if what not in best or urgent or not best[what][0][0]:
                    best[what] = (True,), shows
        return {what: shows for what, (_, shows) in best.items()}


def declarations(body: str) -> dict[str, tuple[bool, bool]]:
    """display and visibility in a list of declarations: whether it shows, and whether it is important."""
    out = {}
    for part in body.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if name in ("display", "visibility") and value:
            urgent = value.endswith("!important")
            value = value.removesuffix("!important").strip()
            if urgent or not out.get(name, (0, False))[1]:
                out[name] = value not in ("none", "hidden", "collapse"), urgent
    return out


def style(root: Node, sheet: Sheet) -> None:
    """Marks what isn't laid out, and whose own text doesn't show: visibility is inherited and may be turned on again inside."""
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            told = sheet.of(c)
            kept = c.tag not in HIDDEN and "hidden" not in c.attrs and not (c.tag == "input" and c.attrs.get("type", "").lower() == "hidden") and not (c.tag == "dialog" and "open" not in c.attrs)
            c.gone = not (kept and told.get("display", True))
            c.seen = told.get("visibility", node.seen)
            if not c.gone:
                todo.append(c)


class Writer:
    """Lines of text; margins between blocks collapse to the larger one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def _begin(self) -> None:
        if self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        if s:
            self._begin()
            self.line.append(s)

    def exact(self, s: str) -> None:
        """Preformatted text."""
        first, *rest = s.split("\n")
        self._begin()
        self.line.append(first)
        for x in rest:
            self.lines.append("".join(self.line))
            self.line = [x]

    def end(self, strip: bool = True) -> None:
        if self.line:
            made = "".join(self.line)
            self.lines.append(made.rstrip(" ") if strip else made)
            self.line = []

    def block(self, margin: int) -> None:
        self.end()
        self.gap = max(self.gap, margin)

    def put(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.end()
        self._begin()
        self.lines += [((first if i == 0 else rest) + x).rstrip(" ") for i, x in enumerate(lines)]

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Cell(NamedTuple):
    row: int
    column: int
    rows: int
    columns: int
    lines: list[str]


def rows_of(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """What stands before a table (captions, and what is outside its cells) and its rows of cells."""
    before, rows, todo = [], [], list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if not n.isspace():
                before.append(Node("div", {}))
                before[-1].children.append(n)
                before[-1].seen = table.seen
        elif n.gone:
            continue
        elif n.tag == "tr":
            cells = [c for c in n.children if not isinstance(c, str) and c.tag in ("td", "th")]
            rows.append([c for c in cells if not c.gone])
            todo += [c for c in reversed(n.children) if c not in cells]
        elif n.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += reversed(n.children)
        else:
            before.append(n)
    return before, rows


def whole(value: str | None, least: int = 1, most: int = 1000) -> int:
    try:
        return max(least, min(most, int(value or least)))
    except ValueError:
        return least


def cells_of(rows: list[list[Node]]) -> list[Cell]:
    """The places of a table's cells: one that spans rows keeps its columns in those below."""
    taken: dict[int, int] = {}  # of each column, the first row that is free again
    out = []
    for r, row in enumerate(rows):
        at = 0
        for c in row:
            while taken.get(at, 0) > r:
                at += 1
            wide, deep = whole(c.attrs.get("colspan")), whole(c.attrs.get("rowspan") or "1", 0)
            deep = min(deep or len(rows), len(rows) - r)
            out.append(Cell(r, at, deep, wide, render(c, False)))
            for k in range(at, at + wide):
                taken[k] = max(taken.get(k, 0), r + deep)
            at += wide
    return out


def put_table(node: Node, out: Writer) -> None:
    """Columns are as wide as their widest cell; a cell that spans columns may widen the last of them."""
    before, rows = rows_of(node)
    for n in before:
        put(n, out, False)
    cells = cells_of(rows)
    wide = [0] * max((c.column + (c.columns if c.lines else 1) for c in cells), default=0)
    for c in sorted(cells, key=lambda c: c.columns):
        if c.lines:
            last = c.column + c.columns - 1
            wide[last] = max(wide[last], max(map(len, c.lines)) - sum(w + 2 for w in wide[c.column : last]))
    starts = [sum(w + 2 for w in wide[:k]) for k in range(len(wide))]
    held: list[list[Cell]] = [[] for _ in rows]
    for c in cells:
        held[c.row].append(c)
    for row in held:
        for k in range(max((len(c.lines) for c in row), default=0)):
            line = ""
            for c in row:
                if k < len(c.lines):
                    line = line.ljust(starts[c.column]) + c.lines[k]
            out.put([line])
        out.block(1)


def put_svg(node: Node, out: Writer) -> None:
    """Of a drawing only its text shows."""
    for c in node.children:
        if not isinstance(c, str) and not c.gone:
            if c.tag in ("text", "foreignobject"):
                children(c, out, False)
                out.text(" ")
            elif c.tag not in ("desc", "metadata", "defs", "symbol"):
                put_svg(c, out)


def put(node: Node, out: Writer, exact: bool) -> None:
    tag = node.tag
    if node.gone:
        return
    if tag == "br":
        out._begin()
        out.line.append("")
        out.end()
        return
    if tag == "hr":
        out.block(2)
        return
    if tag in ("img", "input"):
        shown = node.attrs.get("alt" if tag == "img" else "value", "") if node.seen else ""
        if shown and (tag == "img" or node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number")):
            out.text(shown)
        return
    margin = 2 if tag in SPACED else 1 if tag in BLOCKS else 0
    if margin:
        out.block(margin)
    if tag == "table":
        put_table(node, out)
    elif tag == "svg":
        put_svg(node, out)
    elif tag in ("ul", "ol", "menu", "dir"):
        number = whole(node.attrs.get("start"), -(10**6), 10**6) if node.attrs.get("start") else 1
        for c in node.children:
            if isinstance(c, str):
                if node.seen:
                    out.text(c)
            elif c.tag == "li" and not c.gone:
                if c.attrs.get("value"):
                    number = whole(c.attrs["value"], -(10**6), 10**6)
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                lines = render(c, exact)
                out.block(1)
                if lines or c.seen:
                    out.put(lines or [""], mark if c.seen else "", " " * len(mark))
                out.block(1)
            else:
                put(c, out, exact)
    elif tag in ("blockquote", "dd"):
        out.put(render(node, exact), "    ", "    ")
    elif tag == "details" and "open" not in node.attrs:
        for c in node.children:
            if not isinstance(c, str) and c.tag == "summary":
                put(c, out, exact)
    elif tag in ("pre", "textarea", "xmp"):
        children(node, out, True, drop_first_newline=True)
        out.end(strip=False)
    else:
        quote = tag == "q" and node.seen
        if quote:
            out.text('"')
        children(node, out, exact)
        if quote:
            out.text('"')
        elif tag in ("td", "th"):
            out.text(" ")
    if margin:
        out.block(margin)


def children(node: Node, out: Writer, exact: bool, drop_first_newline: bool = False) -> None:
    for i, c in enumerate(node.children):
        if not isinstance(c, str):
            put(c, out, exact)
        elif not node.seen:
            continue
        elif exact:
            out.exact(c[1:] if drop_first_newline and i == 0 and c[:1] == "\n" else c)
        else:
            out.text(c)


def render(node: Node, exact: bool) -> list[str]:
    out = Writer()
    children(node, out, exact)
    return out.done()


def visible_text(html: str) -> str:
    root, css = build(html.replace("\r\n", "\n").replace("\r", "\n"))
    style(root, Sheet(css))
    return "\n".join(render(root, False))


def extract(pages: DataFrame) -> DataFrame:
    """Visible text of each page: page_id, text, n_chars, n_lines.

    Takes page_id and html; a row for each row. Null and empty pages, and pages that
    show nothing, give the empty text with no lines; repeated rows stay; an empty
    table gives an empty table; other columns are not read. Elements nested deeper
    than DEEPEST become siblings at that depth, and none of their text is lost.
    """

    def make(texts: list[str]) -> dict[str, list]:
        out = [visible_text(t) for t in texts]
        return {"text": out, "n_chars": [len(t) for t in out], "n_lines": [t.count("\n") + 1 if t else 0 for t in out]}

    return map_texts(pages, make, "text string, n_chars bigint, n_lines bigint", text="html", key="page_id")
