"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, block layout."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, with raw text, that are never shown, laid out as blocks, and with a blank line around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video object canvas meta link base param source track area defs desc metadata symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu dir fieldset".split())
#: Start tags that end an open paragraph; and for elements with optional end tags, the open elements that a start tag ends, up to a fence.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
#: Start tags that leave an open head open; any other ends it.
IN_HEAD = frozenset("head base link meta title style script noscript template noframes".split())
#: Elements that an end tag of something outside does not reach through; end tags of a table and its parts reach through open cells.
SCOPE = frozenset("table td th caption html template object".split())
TABLE_PARTS = frozenset("tr thead tbody tfoot".split())
#: Fixed values of HTML: the most columns and rows that a cell may span.
SPAN, ROWS_SPAN = 1000, 65534
#: Width in pixels of the screen for which media queries are answered.
SCREEN = 1280
#: Columns of indentation and quotation marks before a line, at most.
INDENT = 40

#: White space inside a tag is HTML's own, not Unicode's.
_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_GAP = re.compile(r"[ \t\n\r\f/]*")
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)
_COMBINATOR = re.compile(r"\s*>\s*|\s+")
_QUERY = re.compile(r"^(?:only\s+)?(all|screen)?(?:\s*(?:and\s*)?(\(.*))?$", re.I | re.S)
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)px\s*\)", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent


def tags(page: str) -> Iterator[tuple[str, str, dict | None]]:
    """('text', text), ('open', name, attributes), ('close', name); comments and declarations are passed over."""
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], None
            return
        if less > at:
            yield "text", page[at:less], None
        after = page[less + 1 : less + 2]
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
        elif after == "/":
            name = _NAME.match(page, less + 2)
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            if name:
                yield "close", name[0].lower(), None
        elif name := _NAME.match(page, less + 1):
            attrs: dict = {}
            at = _GAP.match(page, name.end()).end()
            while at < n and page[at] != ">":
                m = _ATTRIBUTE.match(page, at)
                attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
                at = _GAP.match(page, m.end()).end()
            at = min(n, at + 1)
            tag = name[0].lower()
            yield "open", tag, attrs
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I | re.A).search(page, at)
                if body := page[at : end.start() if end else n]:
                    yield "raw", body, None
                at = end.start() if end else n
        else:
            yield "text", "<", None
            at = less + 1


def build(page: str) -> Node:
    """The element tree of a page."""
    root = Node("html")
    stack = [root]
    is_open: dict[str, int] = {}  # open elements by name, so that nothing is looked for in vain in a deep stack

    def push(node: Node) -> None:
        stack.append(node)
        is_open[node.tag] = is_open.get(node.tag, 0) + 1

    def pop() -> None:
        is_open[stack.pop().tag] -= 1

    def close_to(names: set | frozenset, fences: set | frozenset) -> None:
        if not any(is_open.get(x) for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in fences:
                return

    for kind, what, attrs in tags(page):
        if kind == "text":
            top = stack[-1]
            if top.tag == "head" and what.strip(" \t\n\r\f"):
                pop()
                top = stack[-1]
            top.children.append(unescape(what) if "&" in what else what)
        elif kind == "raw":
            stack[-1].children.append(unescape(what) if stack[-1].tag in ("title", "textarea") else what)
        elif kind == "open":
            if what == "html":
                root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
                continue
            if stack[-1].tag == "head" and what not in IN_HEAD:
                pop()
            if what in ENDS_P:
                close_to({"p"}, SCOPE)
            if what in IMPLIED_END:
                ended, fences = IMPLIED_END[what]
                for _ in range(3):
                    before = len(stack)
                    close_to(ended, fences)
                    if len(stack) == before:
                        break
            if what in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                stack[-1].children.append(row := Node("tr", None, stack[-1]))
                push(row)
            node = Node(what, attrs, stack[-1])
            stack[-1].children.append(node)
            if what not in VOID:
                push(node)
        elif what == "br":
            stack[-1].children.append(Node("br"))
        elif what == "p" and not is_open.get("p"):
            stack[-1].children.append(Node("p"))
        elif what == "table":
            close_to({what}, {"template", "object"})
        elif what in TABLE_PARTS:
            close_to({what}, {"table", "template", "object"})
        elif what not in ("html", "body"):
            close_to({what}, SCOPE - {what})
    return root


def _applies(query: str) -> bool:
    """Whether a media query list holds for a screen SCREEN pixels wide; a feature other than its width makes a query fail."""
    for one in query.split(","):
        m = _QUERY.match(one.strip())
        if not m:
            continue
        features = m[2] or ""
        wide = all(SCREEN >= float(x) if side.lower() == "min" else SCREEN <= float(x) for side, x in _WIDTH.findall(features))
        if wide and not re.sub(r"\band\b|\s", "", _WIDTH.sub("", features), flags=re.I):
            return True
    return False


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen: those outside at-rules, and inside @media that applies, @supports and @layer."""
    css, at, n = re.sub(r"/\*.*?\*/", "", css, flags=re.S), 0, len(css)
    fence: list[bool] = []  # of each open block of rules: whether it applies
    while at < len(css):
        m = re.compile(r"[^{};]*").match(css, at)
        head, at = m[0].strip(), m.end() + 1
        mark = css[m.end() : m.end() + 1]
        if mark == "}":
            if fence:
                fence.pop()
        elif mark == "{":
            name = re.match(r"@([\w-]+)", head)
            if name and name[1].lower() in ("media", "supports", "layer", "container"):
                fence.append(_applies(head[6:]) if name[1].lower() == "media" else name[1].lower() != "container")
                continue
            depth, end = 1, at
            while end < len(css) and depth:
                depth += {"{": 1, "}": -1}.get(css[end], 0)
                end += 1
            if not name and all(fence):
                yield head, css[at : end - 1 if not depth else end]
            at = end


Compound = tuple[str, frozenset, frozenset]
Shown = dict[str, list[tuple]]


def selector(said: str) -> list[tuple[str, Compound]] | None:
    """The compounds of a selector from its last to its first, each as (tag or *, classes, ids), with what stands before it: '>', ' ' or nothing. Null where it has other parts."""
    out, at = [], 0
    said = said.strip()
    between = ""
    while at < len(said):
        m = _COMPOUND.match(said, at)
        if m.end() == at:
            return None
        marks = re.findall(r"[.#][\w-]+", m[2].lower())
        out.append((between, ((m[1] or "*").lower(), frozenset(x[1:] for x in marks if x[0] == "."), frozenset(x[1:] for x in marks if x[0] == "#"))))
        at = m.end()
        if at < len(said):
            gap = _COMBINATOR.match(said, at)
            if not gap or gap.end() == len(said):
                return None
            between, at = gap[0].strip() or " ", gap.end()
    return out[::-1] or None


def hiding_rules(root: Node) -> Shown:
    """What style elements say about display and visibility by selectors of names, classes and ids, one inside another too: for an id, class or name of the
    last compound, (selector, property, hides, rank); the greatest rank wins: important, ids, classes, names, place."""
    found: Shown = {}
    todo, place = [root], 0
    styles = []
    while todo:
        node = todo.pop()
        if node.tag == "style":
            styles.append("".join(x for x in node.children if isinstance(x, str)))
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    for names, body in (rule for css in styles for rule in css_rules(css)):
        said = [(p.lower(), v.lower() in ("none", "hidden", "collapse"), bool(important)) for p, v, important in _DECLARED.findall(body)]
        for one in names.split(",") if said else ():
            if chain := selector(one):
                tag, classes, ids = chain[0][1]
                own = "#" + min(ids) if ids else "." + min(classes) if classes else tag
                weight = (sum(len(c[2]) for _, c in chain), sum(len(c[1]) for _, c in chain), sum(c[0] != "*" for _, c in chain))
                for p, hides, important in said:
                    place += 1
                    found.setdefault(own, []).append((chain, p, hides, (important, *weight, place)))
    return found if any(hides for rules in found.values() for _, _, hides, _ in rules) else {}


def _fits(node: Node, compound: Compound) -> bool:
    tag, classes, ids = compound
    a = node.attrs
    return tag in ("*", node.tag) and (not ids or ids == {a.get("id", "").lower()}) and (not classes or classes <= set(a.get("class", "").lower().split()))


def _matches(node: Node | None, chain: list[tuple[str, Compound]], k: int = 0) -> bool:
    if node is None or not _fits(node, chain[k][1]):
        return False
    if k + 1 == len(chain):
        return True
    around = node.parent
    if chain[k][0] == ">":
        return _matches(around, chain, k + 1)
    while around is not None:
        if _matches(around, chain, k + 1):
            return True
        around = around.parent
    return False


def _said(node: Node, rules: Shown) -> tuple[bool, bool | None]:
    """Whether an element is not displayed; whether it says that it is hidden or visible, null where it says nothing."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or node.tag == "input":
        return True, None
    best: dict = {"display": ((False,), "hidden" in a), "visibility": ((False,), None)}
    if rules:
        names = ["*", node.tag] + ["." + c for c in set(a.get("class", "").lower().split())] + (["#" + a["id"].lower()] if a.get("id") else [])
        for name in names:
            for chain, p, hides, rank in rules.get(name, ()):
                if rank > best[p][0] and _matches(node, chain):
                    best[p] = rank, hides
    for p, v, important in _DECLARED.findall(a["style"]) if "style" in a else ():
        rank = (bool(important), float("inf"))
        if rank >= best[p.lower()][0]:
            best[p.lower()] = rank, v.lower() in ("none", "hidden", "collapse")
    return best["display"][1], best["visibility"][1]


def visible(node: Node, rules: Shown) -> bool:
    """Whether an element is shown where the one around it is: by its kind, its hidden attribute, and the rule of the greatest rank."""
    gone, hidden = _said(node, rules)
    return not gone and not hidden


def _shown(node: Node, out: Page, rules: Shown, pre: bool = False) -> bool:
    """Whether an element is shown. Of one that is hidden but displayed, what says inside that it is visible is laid out instead."""
    gone, hidden = _said(node, rules)
    if hidden and not gone:
        todo = node.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                away, again = _said(x, rules)
                if again is False and not away:
                    _render([x], out, rules, pre)
                elif not away:
                    todo.extend(x.children[::-1])
    return not gone and not hidden


class Page:
    """Lines of laid-out text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def say(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(words[:-1] if words.endswith(" ") else words)
            self.space = words.endswith(" ")

    def keep(self, text: str) -> None:
        first, *more = text.expandtabs(8).replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.break_line(True)
            self.now.append(line)

    def break_line(self, even_empty: bool = False) -> None:
        if self.now or even_empty:
            self.put("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def leave_gap(self) -> None:
        self.break_line()
        self.gap = True

    def inside(self, lines: list[str], first: str, rest: str) -> None:
        for i, line in enumerate(lines):
            deep = len(line) - len(line.lstrip(" >")) >= INDENT
            self.put(line if deep else ((rest if i else first) + line).rstrip())


def _trim(lines: list[str]) -> list[str]:
    full = [i for i, line in enumerate(lines) if line]
    return lines[full[0] : full[-1] + 1] if full else []


def _flow(node: Node, rules: Shown, pre: bool = False) -> list[str]:
    out = Page()
    _render(node.children, out, rules, pre)
    out.break_line()
    return _trim(out.lines)


def _span(node: Node, name: str, most: int) -> int:
    said = node.attrs.get(name, "1").strip()
    return min(most, max(1, int(said))) if re.fullmatch("[0-9]{1,9}", said) else 1


def _whole(said: str | None, otherwise: int) -> int:
    return int(said) if said and re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", said) else otherwise


def _table(table: Node, out: Page, rules: Shown) -> None:
    """Cells stand in the columns that colspan and rowspan give them; a column is as wide as its widest line."""
    rows: list[list[tuple[int, list[str], int]]] = []  # cells of each row: column, lines, columns spanned
    taken: dict[int, int] = {}  # rows that a cell from above still takes of each column

    def collect(node: Node) -> None:
        for x in node.children:
            if isinstance(x, str):
                if x.strip():
                    out.say(x)
            elif not _shown(x, out, rules):
                continue
            elif x.tag in ("thead", "tbody", "tfoot"):
                taken.clear()
                collect(x)
                taken.clear()
            elif x.tag == "tr":
                cells, at, ahead = [], 0, {}
                for c in x.children:
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        if _shown(c, out, rules):
                            while taken.get(at):
                                at += 1
                            wide, high = _span(c, "colspan", SPAN), _span(c, "rowspan", ROWS_SPAN)
                            cells.append((at, _flow(c, rules), wide))
                            if high > 1:
                                ahead.update(dict.fromkeys(range(at, at + wide), high - 1))
                            at += wide
                    else:
                        _render([c], out, rules)
                for k in [k for k in taken if not ahead.get(k)]:
                    taken[k] -= 1
                    if not taken[k]:
                        del taken[k]
                taken.update(ahead)
                rows.append(cells)
            elif x.tag not in ("colgroup", "col"):
                _render([x], out, rules)

    collect(table)
    out.leave_gap()
    widths: dict[int, int] = {}
    for cells in rows:
        for at, lines, wide in cells:
            if wide == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
    for cells in rows:  # what a spanning cell lacks goes to its last column
        for at, lines, wide in cells:
            if wide > 1 and len(cells) > 1:
                have = sum(widths.get(i, 0) for i in range(at, at + wide)) + 2 * (wide - 1)
                if (most := max(map(len, lines), default=0)) > have:
                    widths[at + wide - 1] = widths.get(at + wide - 1, 0) + most - have
    starts, used = {}, 0
    for k in range(max((at + wide for cells in rows for at, _, wide in cells), default=0)):
        starts[k] = used
        used += widths.get(k, 0) + 2
    for cells in rows:
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            parts, used = [], 0
            for at, lines, _ in cells:
                if k < len(lines) and lines[k]:
                    parts.append(" " * (starts[at] - used) + lines[k])
                    used = starts[at] + len(lines[k])
            out.put("".join(parts).rstrip())


def _render(children: list, out: Page, rules: Shown, pre: bool = False) -> None:
    for x in children:
        if isinstance(x, str):
            (out.keep if pre else out.say)(x)
            continue
        tag = x.tag
        if tag == "br":
            out.break_line(True)
        elif not _shown(x, out, rules, pre):
            continue
        elif tag == "hr":
            out.leave_gap()
            out.put("---")
            out.leave_gap()
        elif tag == "table":
            out.leave_gap()
            _table(x, out, rules)
            out.leave_gap()
        elif tag in ("ul", "ol", "menu", "dir"):
            out.leave_gap()
            back = tag == "ol" and "reversed" in x.attrs
            items = sum(isinstance(y, Node) and y.tag == "li" and visible(y, rules) for y in x.children) if back else 1
            number, step = _whole(x.attrs.get("start"), items), -1 if back else 1
            for item in x.children:
                if isinstance(item, Node) and item.tag == "li":
                    if _shown(item, out, rules):
                        number = _whole(item.attrs.get("value"), number)
                        mark = f"{number}. " if tag == "ol" else "- "
                        number += step
                        out.break_line()
                        out.inside(_flow(item, rules) or [""], mark, " " * len(mark))
                else:
                    _render([item], out, rules)
            out.leave_gap()
        elif tag == "blockquote":
            out.leave_gap()
            out.inside(_flow(x, rules), "> ", "> ")
            out.leave_gap()
        elif tag == "dd":
            out.break_line()
            out.inside(_flow(x, rules), "  ", "  ")
        elif tag == "pre":
            out.leave_gap()
            if x.children and isinstance(x.children[0], str):
                x.children[0] = x.children[0].removeprefix("\n")
            out.inside(_flow(x, rules, True), "", "")
            out.leave_gap()
        elif tag == "details" and "open" not in x.attrs:
            out.break_line()
            _render([c for c in x.children if isinstance(c, Node) and c.tag == "summary"], out, rules)
            out.break_line()
        elif tag == "q":
            out.say("“")
            _render(x.children, out, rules, pre)
            out.now.append("”")
        elif tag in BLOCK:
            (out.leave_gap if tag in SPACED else out.break_line)()
            _render(x.children, out, rules, pre)
            (out.leave_gap if tag in SPACED else out.break_line)()
        else:
            _render(x.children, out, rules, pre)


def text_of(page: str | None) -> str:
    """All visible text of a page, laid out: blocks on lines of their own, blank lines around paragraphs, headings, lists and tables,
    list marks with indented continuation, table cells in aligned columns, preformatted text as it is. Null and empty pages give ''.
    Elements nest to any depth; a line is indented by INDENT columns at most. What an element hides by visibility, its descendants may show again."""
    if not page:
        return ""
    root = build(page)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * page.count("<") + 1000))  # frames of Python functions take no stack of the machine
    try:
        return "\n".join(_flow(root, hiding_rules(root)))
    finally:
        sys.setrecursionlimit(limit)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Each page's visible text: key, the columns `keep`, text, n_chars, n_lines. A row for every row, in place, without a shuffle.

    Null pages count as empty, null keys and repeated rows are rows like others, an empty table gives no row, and pages of any length are
    laid out whole; columns that are not named are not read. Broken markup never fails: unclosed elements end with the page,
    stray end tags are passed over, a lone '<' is text.
    """
    known = [c for c in keep if c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [text_of(x) for x in part.column(len(known) + 1).to_pylist()]
                cols = [*part.columns[: len(known) + 1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [key, *known, "text", "n_chars", "n_lines"])

    kinds = dict(pages.dtypes)
    return pages.select(key, *known, html).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *known)) + ", text string, n_chars long, n_lines long")
