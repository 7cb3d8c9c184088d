"""Layout-aware HTML rendering: all visible text of a page, as a text browser would lay it out.

A tree builder scans tags, closes what HTML lets authors leave open (paragraphs, list items, table
rows and cells, options, head and body), ignores end tags that match nothing, and yields the tree in
document order as open, text and close events. A renderer walks the events: it skips what isn't shown,
collapses white space outside ``pre``, puts line breaks around blocks and a blank line around
paragraphs, numbers or dashes list items, and lays table cells out in aligned columns.

Not shown: head, scripts, styles, templates, noscript and the like, titles and definitions of SVG and annotations
of MathML, inputs but for the captions of buttons; elements with ``hidden``, an inline
``display:none`` or ``visibility:hidden`` (which a descendant may lift with ``visible``), those a style
sheet of the page hides on a screen by a plain ``tag``, ``.class`` or ``#id`` rule, closed details, closed dialogs.

Neither uses recursion, so depth is no limit. Columns are as wide as their widest cell. So that text stays in
proportion to the page, a table's padding is at most ``PADDING`` times its text and ``PADDING_LEAST`` characters: a table
that would need more (very many rows beside a very long cell) has its widest columns narrowed until it fits, and a
cell beyond its column is followed by two spaces. Spans count as in browsers, to 1000 columns and 65534 rows. Cases: null html gives null, an empty page an empty text; rows
that repeat give equal rows; other columns of the input are kept in ``extract`` under their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table

# Fixed values of the HTML standard: void elements, raw text elements, elements that are never shown,
# elements that end an open paragraph, elements laid out as blocks, and those with a blank line around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist rp meta link base".split())
#: Elements that SVG and MathML never show, and the types of input that show their value as a caption.
FOREIGN = frozenset("svg math".split())
UNSEEN_FOREIGN = frozenset("title desc defs metadata symbol annotation annotation-xml".split())
CAPTIONED = frozenset("button submit reset".split())
HEAD_ONLY = frozenset("html head title meta link base script style template noscript".split())
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
BLOCK = ENDS_P | frozenset("body html caption legend optgroup option".split())
BLANK_LINE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
WALLS = frozenset("table td th caption template object html".split())
#: What a start tag closes, and the elements at which the search upward stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | WALLS),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | WALLS),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | WALLS),
    "option": (frozenset(["option"]), frozenset("select datalist".split()) | WALLS),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"]) | WALLS),
    "td": (CELLS, frozenset("tr table".split())),
    "th": (CELLS, frozenset("tr table".split())),
    "tr": (frozenset("tr caption".split()), frozenset(["table"])),
    **dict.fromkeys(SECTIONS | {"caption", "colgroup"}, (SECTIONS | {"caption", "colgroup"}, frozenset(["table"]))),
}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
SHEET = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{};]", re.S)
#: A media query of a screen and of widths in pixels; its width is taken as ``SCREEN``.
MEDIA = re.compile(r"(?:only\s+)?(?:(all|screen)(?:\s+and\s+(?=\())?)?((?:\(\s*(?:min|max)-width\s*:\s*[\d.]+px\s*\)(?:\s+and\s+(?=\())?)*)", re.I)
WIDTH = re.compile(r"(min|max)-width\s*:\s*([\d.]+)px", re.I)
SCREEN = 1280
HIDES = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
PADDING, PADDING_LEAST = 50, 100_000
NO_ATTRIBUTES: dict[str, str] = {}


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace() or source == "/":
        return NO_ATTRIBUTES
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def tree(html: str):
    """The page's tree in document order: ("open", tag, attributes), ("text", text, None), ("close", tag, None)."""
    out: list[tuple] = []
    stack: list[str] = []
    count: Counter = Counter()
    at, size = 0, len(html)

    def close_top() -> None:
        tag = stack.pop()
        count[tag] -= 1
        out.append(("close", tag, None))

    def close_to(tags, walls=()) -> bool:
        """Close up to and with the innermost of ``tags``; nothing if a wall comes first."""
        if not any(count[t] for t in tags):
            return False
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] in tags:
                while len(stack) > depth:
                    close_top()
                return True
            if stack[depth] in walls:
                return False
        return False

    def open_tag(tag: str, attrs: dict) -> None:
        out.append(("open", tag, attrs))
        stack.append(tag)
        count[tag] += 1

    def text(part: str) -> None:
        if "&" in part:
            part = entities.unescape(part)
        if count["head"] and not part.isspace():
            close_to(("head",))
        out.append(("text", part, None))

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        m = TAG.match(html, lt)
        if not m:
            if nxt.isalpha() and nxt.isascii():  # a tag that never ends
                break
            if nxt == "/":
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                out += [("open", "br", NO_ATTRIBUTES), ("close", "br", None)]
            elif tag == "p" and not close_to(("p",), WALLS):
                out += [("open", "p", NO_ATTRIBUTES), ("close", "p", None)]
            elif tag in HEADINGS:
                close_to(HEADINGS, WALLS)
            elif tag in ("table", "tr") or tag in SECTIONS:
                close_to((tag,), ("table",) if tag != "table" else ())
            elif tag in CELLS or tag == "caption":
                close_to((tag,), ("table",))
            elif tag in BLOCK and tag not in ("html", "body", "p"):
                close_to((tag,), WALLS)
            elif tag not in ("html", "body", "p"):
                close_to((tag,), WALLS | BLOCK)
            continue
        if tag in ("html", "body") and count[tag]:
            continue
        if count["head"] and tag not in HEAD_ONLY:
            close_to(("head",))
        if tag in ENDS_P and count["p"]:
            close_to(("p",), WALLS | {"button"})
        if tag in IMPLIED:
            if tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("caption", "colgroup"):
                if not count["table"]:
                    continue
                if tag in CELLS and not close_to(CELLS, ("tr", "table")):
                    close_to(("caption",), ("table",))
                elif tag not in CELLS:
                    close_to(("tr",) if tag == "tr" else (), ("table",))
                    close_to(*IMPLIED[tag])
                if tag in CELLS:
                    inner = next(t for t in reversed(stack) if t in ("tr", "table"))
                    if inner == "table":
                        open_tag("tr", NO_ATTRIBUTES)
            else:
                close_to(*IMPLIED[tag])
        elif tag in HEADINGS and stack and stack[-1] in HEADINGS:
            close_top()
        attrs = attributes(m[3])
        open_tag(tag, attrs)
        if tag in VOID or m[3].endswith("/") and (count["svg"] or count["math"] or tag in FOREIGN):
            close_top()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            body = html[at : end.start() if end else size]
            if body:
                out.append(("text", entities.unescape(body) if tag in ("textarea", "title") else body, None))
            at = size if not end else (html.find(">", end.end()) + 1 or size)
            close_top()
    while stack:
        close_top()
    return out


class Flow:
    """Lines of text under way: pending line breaks and spaces are written only before more text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.space, self.marker, self.indent = 0, False, "", ""

    def lines(self, n: int) -> None:
        self.gap, self.space = max(self.gap, n), False

    def _begin(self) -> None:
        fresh = not self.out
        if self.gap and not fresh:
            self.out.append("\n" * self.gap)
        if self.gap or fresh:
            lead = self.indent
            if self.marker:
                lead = lead[: -len(self.marker)] + self.marker if len(lead) >= len(self.marker) else self.marker
                self.marker = ""
            if lead:
                self.out.append(lead)
        self.gap = 0

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        words = s.strip(" ")
        if not words:
            self.space = self.space or bool(s)
            return
        middle = bool(self.out) and not self.gap
        if middle and (self.space or s[0] == " "):
            words = " " + words
        self._begin()
        self.out.append(words)
        self.space = s[-1] == " "

    def exact(self, s: str) -> None:
        for n, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if n:
                self.gap += 1
            if line:
                self._begin()
                self.out.append(line)
        self.space = False

    def result(self) -> str:
        return "".join(self.out)


class Table:
    """Rows of (text, columns, rows spanned), and their layout."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []

    def layout(self) -> list[str]:
        grid, down = [], {}
        for row in self.rows:
            line, col, below = {}, 0, {c: n - 1 for c, n in down.items() if n > 1}
            for words, across, spanned in row:
                while down.get(col, 0) > 0:
                    col += 1
                line[col] = words.split("\n"), across
                if spanned > 1:
                    below |= dict.fromkeys(range(col, col + across), spanned - 1)
                col += across
            down = below
            grid.append(line)
        wide: dict[int, int] = {}
        lines = characters = 0
        for line in grid:
            lines += max((len(cell) for cell, _ in line.values()), default=0)
            for col, (cell, across) in line.items():
                characters += sum(map(len, cell))
                if across == 1:
                    wide[col] = max(wide.get(col, 0), max(map(len, cell)))
        cap = max(wide.values(), default=0)
        while lines * sum(min(w, cap) for w in wide.values()) > PADDING * characters + PADDING_LEAST and cap > 1:
            cap //= 2
        columns = sorted(wide)
        starts = [0, *accumulate(min(wide[c], cap) + 2 for c in columns)]
        out = []
        for line in grid:
            for n in range(max((len(cell) for cell, _ in line.values()), default=0)):
                done, length = [], 0
                for col in sorted(line):
                    cell = line[col][0][n] if n < len(line[col][0]) else ""
                    if cell:
                        start = starts[bisect_left(columns, col)]
                        pad = start - length if length < start else 2 if length else 0
                        done += [" " * pad, cell]
                        length += pad + len(cell)
                if done:
                    out.append("".join(done).rstrip())
        return out


def number(value: str | None, least: int, most: int) -> int:
    return max(least, min(most, int(value))) if value and value.strip().isdecimal() and len(value) < 9 else least


def integer(value: str | None, default: int) -> int:
    """An integer as HTML reads it: white space, a sign, digits, then anything."""
    m = re.match(r"[ \t\n\f\r]*([+-]?[0-9]{1,18})", value or "")
    return int(m[1]) if m else default


def on_screen(media: str) -> bool:
    """True if a list of media queries applies to a screen; queries of anything but type and width don't."""
    for query in media.split(","):
        m = MEDIA.fullmatch(query.strip())
        if m and all((SCREEN >= float(w)) == (side.lower() == "min") or SCREEN == float(w) for side, w in WIDTH.findall(m[2])):
            return True
    return False


def plain_rules(sheet: str) -> list[tuple[str, str]]:
    """The (selectors, body) of a style sheet's rules that apply to a screen: at the top, in ``@media`` and in ``@layer``."""
    out: list[tuple[str, str]] = []
    open_blocks: list[tuple[str, bool]] = []  # what stands before the brace, and whether rules inside count
    at = 0
    sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    for m in SHEET.finditer(sheet):
        mark = m[0]
        if mark == "{":
            name = sheet[at : m.start()].strip()
            counts = not open_blocks or open_blocks[-1][1] and open_blocks[-1][0].startswith("@")
            if name.startswith("@"):
                kind, _, rest = name.replace("(", " (", 1).partition(" ")
                counts = counts and (kind.lower() == "@layer" or kind.lower() == "@media" and on_screen(rest))
            open_blocks.append((name, counts))
        elif mark == "}":
            if open_blocks:
                name, counts = open_blocks.pop()
                if counts and not name.startswith("@"):
                    out.append((name, sheet[at : m.start()]))
        elif mark != ";" or open_blocks and not open_blocks[-1][0].startswith("@"):
            continue
        at = m.end()
    return out


def sheet_rules(events: list[tuple]) -> dict[str, bool]:
    """Selectors of one tag, class or id that the page's style elements hide."""
    found: dict[str, bool] = {}
    for n, (kind, tag, attrs) in enumerate(events):
        if kind == "open" and tag == "style" and events[n + 1][0] == "text" and "none" in events[n + 1][1] and on_screen(attrs.get("media") or "all"):
            for names, body in plain_rules(events[n + 1][1]):
                if "display" in body.lower():
                    found |= {s.strip().lower(): bool(HIDES.search(body)) for s in names.split(",")}
    return {s: True for s, hides in found.items() if hides}


def render(html: str) -> str:
    """The visible text of a page."""
    events = tree(html)
    rules = sheet_rules(events)
    flow = Flow()
    foreign = 0  # open svg and math elements
    gone = 0  # open elements inside one that isn't shown
    unseen: list[bool] = [False]  # visibility of the open elements
    pre = 0
    lists: list[list] = []
    tables: list[tuple[Table, Flow]] = []
    cells: list[tuple[Flow, int, int, list, int]] = []
    details: list[bool] = []
    for kind, tag, attrs in events:
        if kind == "text":
            if gone or unseen[-1] or details and details[-1] and not tag.isspace():
                continue
            if pre:
                flow.exact(tag)
            else:
                flow.text(tag)
            continue
        if kind == "open":
            style = attrs.get("style", "") if attrs else ""
            if gone:
                gone += 1
                continue
            if (
                tag in UNSEEN
                or foreign and tag in UNSEEN_FOREIGN
                or attrs and ("hidden" in attrs or style and HIDES.search(style))
                or tag == "dialog" and "open" not in attrs
                or rules and (tag in rules or "#" + attrs.get("id", "").lower() in rules or any("." + c.lower() in rules for c in attrs.get("class", "").split()))
            ):
                gone = 1
                continue
            if details and details[-1] and tag != "summary":
                gone = 1
                continue
            state = VISIBILITY.search(style) if style else None
            unseen.append(unseen[-1] if not state else state[1].lower() != "visible")
            foreign += tag in FOREIGN
            if tag == "input" and not unseen[-1] and attrs.get("type", "").strip().lower() in CAPTIONED:
                flow.text(attrs.get("value", ""))
            elif tag == "text" and foreign:
                flow.lines(1)
            if tag == "details":
                details.append("open" not in attrs)
            elif tag == "summary" and details:
                details.append(False)
            if tag == "br":
                flow.gap, flow.space = flow.gap + 1, False
            elif tag == "table":
                tables.append((Table(), flow))
            elif tag == "tr" and tables:
                tables[-1][0].rows.append([])
            elif tag in CELLS and tables and tables[-1][0].rows:
                cells.append((flow, number(attrs.get("colspan"), 1, 1000), number(attrs.get("rowspan"), 1, 65534), lists, pre))
                flow, lists, pre = Flow(), [], 0
            elif tag in BLOCK:
                flow.lines(1 if tag not in BLANK_LINE or tag in ("ul", "ol", "menu", "dir") and lists else 2)
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag, integer(attrs.get("start"), 1)])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] = integer(attrs.get("value"), lists[-1][1])
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    flow.indent += " " * len(mark)
                    flow.marker = mark
                    lists.append(["li", len(mark)])
                elif tag in ("dd", "blockquote"):
                    flow.indent += "  "
                elif tag in ("pre", "listing", "xmp"):
                    pre += 1
            elif tag == "textarea":
                pre += 1
            continue
        if gone:
            gone -= 1
            continue
        if len(unseen) > 1:
            unseen.pop()
        foreign -= tag in FOREIGN
        if tag == "text" and foreign:
            flow.lines(1)
        if tag in ("details", "summary") and details and len(details) > (tag == "summary"):
            details.pop()
        if tag == "table" and tables:
            done, flow = tables.pop()
            flow.lines(2)
            for line in done.layout():
                flow.exact(line)
                flow.lines(1)
            flow.lines(2)
        elif tag in CELLS and cells:
            inside = flow.result()
            flow, across, down, lists, pre = cells.pop()
            tables[-1][0].rows[-1].append((inside, across, down))
        elif tag in BLOCK:
            if tag in ("pre", "listing", "xmp"):
                pre -= 1
            elif tag in ("dd", "blockquote"):
                flow.indent = flow.indent[:-2]
            elif tag == "li":
                while lists and lists[-1][0] != "li":
                    lists.pop()
                if lists:
                    flow.indent = flow.indent[: len(flow.indent) - lists.pop()[1]]
                flow.marker = ""
            elif tag in ("ul", "ol", "menu", "dir") and lists and lists[-1][0] != "li":
                lists.pop()
            flow.lines(1 if tag not in BLANK_LINE or tag in ("ul", "ol", "menu", "dir") and lists else 2)
        elif tag == "textarea":
            pre -= 1
    return flow.result()


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by its visible text ``out``."""
    columns = [c for c in pages.columns if c not in (html, out)]
    rows = pages.select(*(F.col(f"`{c}`") for c in columns), F.col(html).alias(out))

    def run(batches):
        for batch in batches:
            texts = [None if x is None else render(x) for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string())], names=[*columns, out])

    return rows.mapInArrow(run, rows.schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"), (F.size(F.split("text", "\n")) - 0).cast("long").alias("n_lines"))
