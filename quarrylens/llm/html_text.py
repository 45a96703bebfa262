"""Layout-aware HTML to text: a tree builder with implied tags and visibility rules renders all visible text.

Pages are split into tags and text once; a stack of open elements closes what HTML closes by implication (p before a block,
li before li, cells and rows of tables, options). Elements that a browser doesn't draw (script, style, head, the hidden attribute,
display:none in a style, closed dialogs) give no text; visibility:hidden can be lifted by an inner visibility:visible. Attributes are parsed into names and
values, so a class or title with such a word hides nothing, and aria-hidden, which only screen readers follow, hides nothing either. Blocks are
set apart by new lines, list items get a bullet or number and an indent, pre and textarea keep their white space, a drop-down shows its chosen
option and an open list all of them, buttons and filled fields their value. Table cells keep their lines and stand in aligned columns over colspan and rowspan; tables may be nested.

Defined cases: null or empty html gives empty text; unclosed and stray tags, comments that never end and a `<` without a tag
are taken as browsers do (text goes on, the rest of the page stays visible); any nesting depth works in linear time, for the builder keeps its own
stack and the places of each open name; repeated rows are rendered one by one; other columns are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylens.llm.common import table

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody textarea tfoot thead tr caption ul".split())
SPACED = frozenset("article aside blockquote dl figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist title desc metadata defs annotation".split())
RAW = frozenset("script style textarea title".split())
# An opening tag on the left closes these open elements, up to the nearest element of the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "body": ({"head"}, {"html"}),
}
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())
CELL_SCOPE = ("table", "td", "th")
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # largest spans of the HTML standard
GAPS = re.compile(r"[ \t\r\n\f]+")


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def span(attrs: dict[str, str], name: str, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", attrs.get(name, ""))
    return min(most, max(1, int(m[1]))) if m else 1


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of (lines, colspan, rowspan) cells: columns are as wide as their widest cell, a row as high as its highest."""
    placed, held = [], []  # cells as (start, end, lines) of each row; (start, end, last row) of cells that reach down
    for r, row in enumerate(rows):
        held = sorted(h for h in held if h[2] >= r)
        cells, at, k = [], 0, 0
        for lines, wide, high in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            cells.append((at, at + wide, lines))
            at += wide
        held += [(a, z, r + high - 1) for (a, z, _), (_, _, high) in zip(cells, row, strict=True) if high > 1]
        placed.append(cells)
    starts = sorted({a for cells in placed for a, _, _ in cells})
    width, after = [0] * len(starts), []
    for cells in placed:
        for a, z, lines in cells:
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, z - 1)
            most = max(map(len, lines), default=0)
            if j - i == 1:
                width[i] = max(width[i], most)
            else:
                after.append((i, j, most))
    for i, j, most in after:
        width[j - 1] += max(0, most - sum(width[i:j]) - 3 * (j - i - 1))
    out = []
    for cells in placed:
        for n in range(max((len(lines) for _, _, lines in cells), default=0)):
            parts, i = [], 0
            for a, z, lines in cells:
                k, j = bisect_right(starts, a) - 1, bisect_right(starts, z - 1)
                parts += [" " * w for w in width[i:k]]
                parts.append((lines[n] if n < len(lines) else "").ljust(sum(width[k:j]) + 3 * (j - k - 1)))
                i = j
            out.append(" | ".join(parts).rstrip())
    return out


class Page:
    """Renders one page: feed tags and text in order, then read text()."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, object]] = []  # name, not drawn, veiled, what pop needs
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each name in open
        self.lines: list[str] = []
        self.line: list[str] = []
        self.lists: list[list] = []  # [name, counter]
        self.tables: list[list[list[tuple]]] = []
        self.selects: list[tuple[bool, list[tuple[bool, str]]]] = []  # whether all options show; (chosen, text)
        self.sinks: list[tuple[list[str], list[str], str]] = []  # lines, line, margin outside of a cell or select
        self.margin = ""
        self.pre = 0

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def text_in(self, s: str) -> None:
        if self.open and (self.open[-1][1] or self.open[-1][2]):
            return
        if self.pre:
            first, *more = html.unescape(s).split("\n")
            self.line.append(first)
            for x in more:
                self.end_line(keep=True)
                self.line.append(x)
        else:
            self.line.append(GAPS.sub(" ", html.unescape(s)))

    def end_line(self, keep: bool = False) -> None:
        s = "".join(self.line)
        if not self.pre:
            s = re.sub(" +", " ", s).strip(" ")
        if s.strip() or (keep and self.pre):
            self.lines.append(self.margin + s)
        self.line.clear()

    def gap(self) -> None:
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def block_edge(self, name: str) -> None:
        self.end_line()
        if name in SPACED and not (name in ("ul", "ol") and len(self.lists) > 1):
            self.gap()

    def inside(self) -> None:
        """Lines go to a place of their own until outside() gives them."""
        self.sinks.append((self.lines, self.line, self.margin))
        self.lines, self.line, self.margin = [], [], ""

    def outside(self) -> list[str]:
        self.end_line()
        got = [x.rstrip() for x in self.lines]
        self.lines, self.line, self.margin = self.sinks.pop()
        while got and not got[-1]:
            got.pop()
        return got

    def start(self, name: str, source: str) -> None:
        rule = CLOSES.get(name)
        if rule:
            self.close_to(*rule)
        if name in BLOCK:
            self.close_to({"p"}, {"button", "td", "th", "table", "caption", "object"})
        attrs = attributes(source) if source else {}
        styles = {k.lower(): v.lower() for k, v in DECLARATION.findall(attrs.get("style", ""))}
        gone = self.hidden() or name in HIDDEN or "hidden" in attrs or styles.get("display") == "none" or (name == "dialog" and "open" not in attrs)
        veiled = styles["visibility"] in ("hidden", "collapse") if "visibility" in styles else bool(self.open) and self.open[-1][2]
        if name in VOID:
            if not gone:
                if name == "br":
                    self.end_line(keep=True)
                elif name == "hr":
                    self.block_edge("p")
                elif name == "input" and not veiled and attrs.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "color", "range", "image"):
                    self.line.append(attrs.get("value", ""))
            return
        more = None
        if not gone:
            if name == "option" and self.selects:
                self.end_line()
                self.lines.clear()
                more = "selected" in attrs
            elif name in BLOCK:
                self.block_edge(name)
            if name in ("ul", "ol"):
                self.lists.append([name, 0])
            elif name == "li":
                depth = max(1, len(self.lists))
                mark = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    self.lists[-1][1] += 1
                    mark = f"{self.lists[-1][1]}. "
                if not veiled:
                    self.line.append("  " * (depth - 1) + mark if not self.margin else mark)
            elif name in ("pre", "textarea"):
                self.pre += 1
            elif name == "blockquote":
                self.margin += "> "
            elif name == "table":
                self.tables.append([])
            elif name == "tr" and self.tables:
                self.tables[-1].append([])
            elif name in ("td", "th") and self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                more = (span(attrs, "colspan", MOST_COLUMNS), span(attrs, "rowspan", MOST_ROWS))
                self.inside()
            elif name == "select":
                self.selects.append(("multiple" in attrs or span(attrs, "size", MOST_ROWS) > 1, []))
                self.inside()
        self.at[name].append(len(self.open))
        self.open.append((name, gone, veiled, more))

    def last(self, names) -> int:
        """Place of the innermost open element with one of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close_to(self, names: set[str], scope: set[str]) -> None:
        """Close open elements down to the outermost of names above the nearest of scope."""
        if not any(self.at.get(n) for n in names):
            return
        top = self.last(scope)
        found = [self.at[n][k] for n in names if self.at.get(n) and (k := bisect_right(self.at[n], top)) < len(self.at[n])]
        self.cut(min(found, default=len(self.open)))

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.pop()

    def end(self, name: str) -> None:
        k = self.last((name,))
        if k >= 0 and (name in TABLE_PARTS or self.last(CELL_SCOPE) <= k):
            self.cut(k)
        elif k < 0 and name in ("p", "br") and not self.hidden():
            self.end_line()

    def pop(self) -> None:
        name, gone, veiled, more = self.open.pop()
        self.at[name].pop()
        if gone:
            return
        if name in ("td", "th") and more:
            self.tables[-1][-1].append((self.outside(), *more))
            return
        if name == "option" and self.selects:
            self.end_line()
            self.selects[-1][1].append((bool(more), " ".join(x.strip() for x in self.lines if x.strip())))
            self.lines.clear()
            return
        if name == "select":
            self.outside()
            every, got = self.selects.pop()
            if every:
                self.end_line()
                self.lines += [self.margin + x for _, x in got if x]
            elif got and not veiled:
                self.line.append(next((x for chosen, x in reversed(got) if chosen), got[0][1]))
            return
        if name == "table" and self.tables:
            self.end_line()
            self.lines += [self.margin + x for x in grid([r for r in self.tables.pop() if r])]
            self.gap()
            return
        if name in BLOCK:
            self.block_edge(name)
        if name in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif name in ("pre", "textarea"):
            self.pre = max(0, self.pre - 1)
        elif name == "blockquote":
            self.margin = self.margin[:-2]

    def text(self) -> str:
        self.cut(0)
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(source: str) -> str:
    """The visible text of one page."""
    page, at, n = Page(), 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            page.text_in(source[at:])
            break
        if m.start() > at:
            page.text_in(source[at : m.start()])
        at = m.end()
        if m[1] is not None:
            page.text_in(m[1])
        elif m[3]:
            name = m[3].lower()
            if m[2]:
                page.end(name)
            else:
                page.start(name, m[4])
                if name in RAW and not m[4].endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    to = stop.start() if stop else n
                    if name == "textarea":
                        page.text_in(source[at:to])
                    at = to
    return page.text()


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages, then page_text."""
    kept = [f for f in pages.schema.fields if f.name != "page_text"]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            out = [render(x or "") for x in b.column(b.schema.names.index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in names], pa.array(out, pa.string())], names=[*names, "page_text"])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField("page_text", T.StringType())]))


def op2_html(spark, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("page_text").alias("text"), F.length("page_text").cast("long").alias("n_chars"))
