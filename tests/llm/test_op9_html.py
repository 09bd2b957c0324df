import html.parser
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticework.llm import op9_html as m

CASES = [
    (None, None),
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "- x\n- y\n  - z\n\nend"),
    ('<ol start="3"><li>x</li><li>y</li></ol>', "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ('<table><tr><td colspan=2>wide cell<td>x</tr><tr><td>aaaaaa<td>b<td>y</table>', "wide cell  x\naaaaaa  b  y"),
    ("<head><title>t</title></head><body>x<script>var a='<p>';</script><style>p{}</style><!-- c -->y", "xy"),
    ('<div hidden>no</div><span style="color:red; display : none">no</span><p style="visibility:hidden">no</p>yes', "yes"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("1 < 2 &amp; 3 &lt; 4 <3", "1 < 2 & 3 < 4 <3"),
    ("<a href='x>y'>link</a> tail", "link tail"),
    ('<a href="open>text</a> more', "text more"),
    ("<b>bold<br><p>para", "bold\n\npara"),
    ("<div><div>a</div> <div>b</div></div>", "a\nb"),
    ("</p></div>x</span>", "x"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>a <b>b</b> c</p>", "a b c"),
    ("a&nbsp;b", "a b"),
    ("<textarea>x <b></textarea>z", "x <b> z"),
    ("<table><caption>cap</caption><tr><td><p>a<p>b<td>c</table>", "cap\na  c\n\nb"),
]


LONG = "long " * 30 + "end"
TABLES = [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td rowspan=9>a</table>x", "a\n\nx"),
    (f"<table><tr><td>{LONG}<td>b<td>c<tr><td>d<td>e<td>f</table>", f"{LONG}\n{' ' * 82}b  c\n{'d'.ljust(82)}e  f"),
    ("<table><tr><td>a<td>" + "x" * 60 + "<td>b<tr><td>c<td>d<td>e</table>", "a  " + "x" * 60 + "  b\nc  " + "d".ljust(62) + "e"),
    ("<table><tr><td colspan=2>aaaa<td colspan=2>b<tr><td colspan=2>c<td colspan=2>d</table>", "aaaa  b\nc     d"),
    ("<table><tr><td colspan=3>a wide cell<td>x<tr><td>b<td>c<td>d<td>y</table>", "a wide cell  x\nb      c  d  y"),
    ("<table><tr><td rowspan=-1>a<td colspan=x>b</table>", "a  b"),
]


@pytest.mark.parametrize("source,text", TABLES)
def test_tables(source, text):
    assert m.extract(source) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 30)), min_size=1, max_size=5), min_size=1, max_size=6))
def test_cells_of_a_column_begin_together(rows):
    """Against a grid that is filled cell by cell: cells that begin in one column stand at one place, those of later columns no further left, on a line for each row."""
    held, names, source = {}, {}, "<table>"
    for r, row in enumerate(rows):
        source += "<tr>"
        c = 0
        for n, (across, down, width) in enumerate(row):
            while (r, c) in held:
                c += 1
            name = f"r{r}n{n}" + "x" * width
            names[name] = (r, c)
            for i in range(r, r + down):
                for j in range(c, c + across):
                    held[i, j] = name
            source += f"<td colspan={across} rowspan={down}>{name}"
            c += across
    lines = m.extract(source + "</table>").split("\n")
    assert len(lines) == len(rows)
    at = {}
    for name, (r, c) in names.items():
        at.setdefault(c, set()).add(lines[r].index(name))
    places = [at[c] for c in sorted(at)]
    assert all(len(x) == 1 for x in places)
    assert all(min(x) <= min(y) for x, y in zip(places, places[1:]))


def test_wide_tables_stay_small():
    page = "<table><tr>" + "<td>" + "<td>".join(["x" * 90] * 300) + "<tr><td colspan=299><td>y" * 3000 + "</table>"
    text = m.extract(page)
    assert text.count("y") == 3000 and text.count("x") == 27_000 and len(text) < 4_000_000
    assert m.extract("<table><tr>" + "<td colspan=1000 rowspan=9>a" * 50 + "<tr><td>b" * 9).count("b") == 9


FOREIGN = [
    ("so <math><mi>x</mi><mo>+</mo><mn>1</mn></math>, yes", "so x+1, yes"),
    ("<math><semantics><mi>y</mi><annotation encoding='TeX'>no</annotation></semantics></math>.", "y."),
    ("<math><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr></mtable></math>", "a b"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><rect/><text>north</text><text x=1>south</text></svg>end", "north south end"),
    ("<svg><defs/><path d='m0'/><title/><text>a<tspan x='0' dy='1'>b</tspan></text></svg><title>no</title>c", "a b c"),
    ("<svg><style/><style>p > q {}</style><text display='none'>no</text><g visibility='hidden'><text>no</text></g><text>yes</text></svg>", "yes"),
    ("<svg><foreignObject><div>in<script>if (a<b) no</script></div></foreignObject></svg>out", "in\nout"),
    ("<svg/>a<math/>b <desc>shown</desc>", "ab shown"),
    ('<input type="email" value="a@b.org"><input type=number value=7><input type="TEL" value="123"><input type=url value=u><input type=search value=s>', "a@b.org 7 123 u s"),
    ('<input value="x"><input type="hidden" value="no"><input type=password value=no><input type="checkbox" value="on"><input type=range value=3>', "x"),
]


@pytest.mark.parametrize("source,text", FOREIGN)
def test_formulas_svg_and_inputs(source, text):
    assert m.extract(source) == text


@pytest.mark.parametrize("source,text", CASES)
def test_cases(source, text):
    assert m.extract(source) == text


def test_deep_and_long():
    assert m.extract("<div>" * 30_000 + "x") == "x"
    assert m.extract("<ul><li>" * 300 + "x").strip(" -") == "x"
    assert m.extract("<" * 50_000).count("<") == 50_000
    assert m.extract('<a b="' * 20_000) == ""


class Plain(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title", "head") and tag != "head"

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_all_visible_text_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = m.op9_html(spark, d).collect()
    assert len(rows) == len(pages)
    for row in rows:
        p = Plain()
        p.feed(pages[row.page_id])
        squash = lambda s: re.sub(r"\s+", "", s)
        marks = re.sub(r"(?m)^(\s*)(?:- |\d+\. )+", r"\1", row.text)
        assert squash(marks) == squash("".join(p.out))


def test_frames(spark):
    pages = spark.createDataFrame([(1, None, 7), (1, "<p>x", 7), (None, "<p>x", 7)], "page_id long, html string, text int")
    assert sorted((r.text or "") for r in m.extracted(pages).collect()) == ["", "x", "x"]
    assert m.extracted(pages.limit(0)).count() == 0
