"""HTML extraction: a tree builder with implied tags, visibility rules and a layout-aware renderer.

Parsing: tags, comments, declarations and raw-text elements are told apart as in HTML; a tree is
built with implied end tags (p, li, dt, dd, option, table parts) and implied cells and rows; an
end tag closes what is open inside its element and is ignored if nothing matches.

Visibility: these yield nothing: head, title, script, style, template, noscript, comments; elements with
`hidden` or an inline style display:none or visibility:hidden or collapse; what a browser shows only where it lacks
the element (iframe, noframes, object, audio, video, canvas) and datalist; annotation, annotation-xml and mphantom of
formulas; desc, metadata, defs, symbol, clipPath, mask, marker, pattern, gradients, filter and elements with
display="none" or visibility="hidden" or "collapse" of svg; values of inputs of type hidden, password, checkbox, radio,
file, image, color and range. All other text is kept: navigation and advertisements, formulas, labels of
svg, and the values of all other inputs. A space parts labels of svg and cells of formulas.

Layout: white space collapses outside pre and textarea; blocks begin on their own line, paragraphs,
headings, lists and tables have a blank line around them; br and hr break; list items get `- ` or their
number and are indented under it; the cells of a table's rows begin at common columns. A cell of several
columns or rows takes them as in a browser: the next cells stand beside it, in the free columns, and its lines in its
first row. Columns are as wide as their widest cell, up to WIDE characters; nothing is cut: what stands
after a longer line goes on in its own column on the next line. A page has FAR characters of columns at most, beyond
which cells are parted by two spaces; so a page's text is at most about FAR times its number of cells longer than its visible text.

The work of a page stays in its task and neither parser nor renderer recurses, so nesting of any
depth is fine. Cases: null html gives null, a page without visible text an empty string; broken markup is
text or ignored, never an error; repeated rows and null ids are passed through; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

WIDE, FAR = 80, 1000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
UNSEEN = frozenset("head script style template noscript title iframe noframes datalist object audio video canvas".split())
#: Inside svg and math only.
UNSEEN_FOREIGN = frozenset("annotation annotation-xml mphantom desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split())
UNSEEN_INPUT = frozenset("hidden password checkbox radio file image color range".split())
#: Inside svg and math, what begins apart from the text before it.
APART = frozenset("text mtr mtd svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption optgroup option select tr td th thead tbody tfoot".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
PARTS = frozenset("thead tbody tfoot".split())
#: For a start tag: the open elements that it ends, and those beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
SPACES = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source) if source.strip(" /\n\t\r") else ():
        out.setdefault(name.lower(), entities.unescape("".join(values)))
    return out


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("", {})
    open_ = [root]
    count: dict[str, int] = {}  # of open elements, so that a search that finds nothing costs nothing

    def pop() -> None:
        count[open_.pop().tag] -= 1

    def close(tags, stops) -> None:
        if not any(count.get(t) for t in tags):
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                while len(open_) > k:
                    pop()
                return
            if open_[k].tag in stops:
                return

    def start(tag: str, attributes: dict[str, str]) -> Node:
        if tag in ENDS_P:
            close(("p",), ("table", "td", "th", "li", "button", "caption"))
        if tag in ENDS:
            tags, stops = ENDS[tag]
            before = 0
            while before != len(open_):
                before = len(open_)
                close(tags, stops)
        if tag in ("td", "th") and open_[-1].tag in ("table", *PARTS):
            start("tr", {})
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID:
            open_.append(node)
            count[tag] = count.get(tag, 0) + 1
        return node

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            open_[-1].children.append(source[at:lt])
            at = lt
            continue
        follows = source[at + 1 : at + 2]
        if follows.isascii() and follows.isalpha():
            hit = TAG.match(source, at)
            if hit:
                tag, rest, at = hit[1].lower(), hit[2], hit.end()
            else:  # an open quote: the tag ends at the next bracket
                end = source.find(">", at)
                if end < 0:
                    break
                tag, _, rest = source[at + 1 : end].partition(" ")
                tag, at = tag.strip("/").lower(), end + 1
            node = start(tag, _attributes(rest))
            # inside svg and math a slash closes any element, and no element is raw; foreignObject holds HTML again
            foreign = count.get("svg", 0) + count.get("math", 0) > count.get("foreignobject", 0)
            if foreign:
                a = node.attributes
                if tag in UNSEEN_FOREIGN or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse"):
                    a["hidden"] = ""
                if tag in APART or tag == "tspan" and ("x" in a or "dy" in a):
                    node.children.append(" ")
            if foreign and tag not in VOID:
                if rest.endswith("/"):
                    pop()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else n
                if stop > at:
                    node.children.append(source[at:stop])
                pop()
                close_at = source.find(">", stop) if end else -1
                at = close_at + 1 if close_at >= 0 else n
        elif follows == "/" and source[at + 2 : at + 3].isascii() and source[at + 2 : at + 3].isalpha():
            end = source.find(">", at)
            end = n if end < 0 else end
            tag = re.split(r"[\s/]", source[at + 2 : end], maxsplit=1)[0].lower()
            at = end + 1
            if tag == "br":
                open_[-1].children.append(Node("br", {}))
            else:
                close((tag,), ("table",) if tag not in ("table", "body", "html") else ())
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif follows in ("!", "?", "/"):
            end = source.find(">", at)
            at = n if end < 0 else end + 1
        else:
            open_[-1].children.append("<")
            at += 1
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in UNSEEN or a and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or HIDING.search(a.get("style", ""))))


class Lines:
    """Text as it is laid out: finished lines, the current one and the space owed before more."""

    __slots__ = ("done", "now", "space", "gap")

    def __init__(self):
        self.done, self.now, self.space, self.gap = [], [], False, 0

    def end(self, blank: int = 0) -> None:
        if self.now:
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, blank)

    def line(self, text: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = 0
        self.done.append(text)

    def text(self, text: str) -> None:
        flat = SPACES.sub(" ", text)
        if flat == " ":
            self.space = bool(self.now)
            return
        if flat.startswith(" "):
            self.space, flat = bool(self.now), flat[1:]
        if not flat:
            return
        tail = flat.endswith(" ")
        if not self.now and self.gap:
            if self.done:
                self.done.append("")
            self.gap = 0
        if self.space:
            self.now.append(" ")
        self.now.append(flat[:-1] if tail else flat)
        self.space = tail

    def kept(self, text: str) -> None:
        """White space as it is."""
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                if not self.now:
                    self.done.append("")
                self.end()
            if part:
                if not self.now and self.gap:
                    if self.done:
                        self.done.append("")
                    self.gap = 0
                self.now.append(part)

    def finish(self) -> list[str]:
        self.end()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def _placed(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (first column, columns, lines) from rows of (columns, rows, lines)."""
    taken: dict[int, int] = {}  # by column: the row up to which a cell from above holds it
    out = []
    for r, row in enumerate(rows):
        c, placed = 0, []
        for across, down, lines in row:
            while taken.get(c, 0) > r:
                c += 1
            placed.append((c, across, lines))
            if down > 1:
                taken.update(dict.fromkeys(range(c, c + across), r + down))
            c += across
        out.append(placed)
    return out


def _grid(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of cells (columns, rows, lines) as aligned lines."""
    placed = _placed(rows)
    cells = [(across, c, max(map(len, lines), default=0)) for row in placed for c, across, lines in row]
    widths: dict[int, int] = {}
    for across, c, width in sorted(cells):
        # what a cell of several columns lacks goes to its first one
        have = widths.get(c, 0) if across == 1 else sum(widths[i] + 2 for i in range(c, c + across) if i in widths) - 2
        if width > have:
            widths[c] = min(WIDE, widths.get(c, 0) + width - max(0, have))
    columns = sorted(widths)
    begins = [0]
    for c in columns:
        begins.append(begins[-1] + widths[c] + 2)
    out = []
    for row in placed:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                if k >= len(lines) or not lines[k]:
                    continue
                at = begins[bisect_left(columns, c)]
                if at > FAR:
                    at = len(line) + 2 if line else FAR
                elif line and at < len(line) + 2:
                    out.append(line)
                    line = ""
                line = line.ljust(at) + lines[k]
            out.append(line)
    return out


def _span(node: Node, name: str, most: int) -> int:
    """A number of columns or rows; none below 1 and, as rows go, 0 for all that follow."""
    said = node.attributes.get(name, "1").strip()
    if not (said.isascii() and said.isdigit()):
        return 1
    n = min(most, int(said[:6]))
    return n or (most if name == "rowspan" else 1)


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = Lines()
    held: list[Lines] = []
    tables: list[list] = []  # of the open tables: rows
    lists: list[list] = []  # of the open lists: next number or None
    keep = 0
    work: list[tuple[bool, Node | str]] = [(True, root)]
    while work:
        enter, node = work.pop()
        if isinstance(node, str):
            text = entities.unescape(node).replace("\xa0", " ") if "&" in node else node.replace("\xa0", " ")
            out.kept(text) if keep else out.text(text)
            continue
        tag = node.tag
        if enter:
            if not visible(node):
                continue
            if tag == "br":
                if out.now:
                    out.end()
                elif out.done:
                    out.done.append("")
                continue
            if tag == "hr":
                out.end(1)
                continue
            if tag == "input" and node.attributes.get("type", "text").lower() not in UNSEEN_INPUT:
                out.text(" " + node.attributes.get("value", "") + " ")
                continue
            if tag in BLOCK:
                out.end(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
            if tag in ("pre", "textarea"):
                keep += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                first = node.attributes.get("start", "1")
                lists.append([int(first) if first.isascii() and first.isdigit() and len(first) < 10 else 1] if tag == "ol" else [None])
            elif tag == "table":
                tables.append([])
                held.append(out)
                out = Lines()
            elif tag == "tr" and tables:
                tables[-1].append([])
            if tag == "li" or tag in ("td", "th") and tables or tag in ("blockquote", "dd"):
                held.append(out)
                out = Lines()
            work.append((False, node))
            work.extend((True, c) for c in reversed(node.children))
            continue
        if tag in ("pre", "textarea"):
            keep -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        if tag == "li":
            lines, out = out.finish(), held.pop()
            mark = "- "
            if lists and lists[-1][0] is not None:
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            for k, line in enumerate(lines):
                out.line((mark if k == 0 else " " * len(mark)) + line if line else "")
        elif tag in ("blockquote", "dd"):
            lines, out = out.finish(), held.pop()
            for line in lines:
                out.line("  " + line if line else "")
        elif tag in ("td", "th") and tables:
            lines, out = out.finish(), held.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((_span(node, "colspan", 1000), _span(node, "rowspan", 65534), lines))
        elif tag == "table":
            inner, out = out.finish(), held.pop()  # captions and stray text
            for line in inner:
                out.line(line)
            for line in _grid(tables.pop()):
                out.line(line)
        if tag in BLOCK:
            out.end(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
        elif tag in ("button", "label", "textarea", "svg"):
            out.text(" ")
    return "\n".join(out.finish()).strip("\n")


def extract(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html")
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [extract(x.as_py()) for x in pages[at : at + 64]]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, text."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(_run, f"page_id {kind}, text string")


def op9_html(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
