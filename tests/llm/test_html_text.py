import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import html_text as m

CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("a<br>b", "a\nb"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("x <b>b</b><i>i</i> y", "x bi y"), ("a\n\t  b", "a b"), ("<h1>T</h1>body", "T\n\nbody"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>Qty<tr><td>apples<td>3</table>", "Name    Qty\napples  3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "wide cell\nx          y"),
    ("<td>cell", "cell"), ("<pre>\n a  b\n  c</pre>", " a  b\n  c"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<script>x='<p>no</p>'</script>yes<style>p{}</style>", "yes"), ("<!-- no -->yes<!-- open", "yes"), ("<p hidden>no</p>yes", "yes"), ("<p style='display: none'>no</p>yes", "yes"),
    ("<style>.x, #y {display:none} b{visibility:hidden}</style><i class='a x'>no</i><i id=y>no</i><b>no</b>yes", "yes"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<head><title>no</title></head><body>yes</body>", "yes"), ("<template>no</template><noscript>no</noscript>yes", "yes"), ("<img alt='pic'>", "pic"), ("a</p>b", "a\n\nb"), ("</div></b>x", "x"),
    ("<a href='1>2'>x</a>", "x"), ("<select><option>no<option>no</select>yes", "yes"), ("&#x41;&nbsp;&lt;b&gt;", "A <b>"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_rendering(page, want):
    assert m.extract(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<td>" * 5000 + "x", "<b><i>" * 9000 + "x", "<ul><li>" * 3000 + "x", "<table><tr><td>" * 900 + "x", "<a " + 'b="' * 3000 + ">x", "<" * 50_000 + "x", "<p " * 3000 + ">x"])
def test_hostile_pages_end(page):
    assert isinstance(m.extract(page), str)


SHOWN = [
    ("<p>a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b", "a x= 1 2 b"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>axis</text><text>tick</text><path d='M0 0'/></svg>", "axis tick"),
    ("a<textarea>x &amp; y\n  z</textarea>b", "a\n\nx & y\n  z\n\nb"), ("<textarea hidden>no</textarea>yes", "yes"),
    ("<select multiple><optgroup label=G><option>a<option>b</select>c", "G\na\nb\nc"), ("<select size=2><option>a<option>b</select>", "a\nb"),
    ("<select><option>no<option selected>a</select>", "a"),
    ("<style>@media print{.x{display:none}}</style><p class=x>a", "a"), ("<style media=print>.x{display:none}</style><p class=x>a", "a"),
    ("<style>@media (max-width: 600px){.x{display:none}} .y{display:none}</style><p class=x>a<p class=y>no", "a"),
    ("<style>@media screen and (min-width:40em){.x{display:none}}</style><p class=x>no</p>yes", "yes"),
    ("<style>@media not print{.x{display:none}}</style><p class=x>no</p>yes", "yes"), ("<style>@media not screen, (width < 900px){.x{display:none}}</style><p class=x>a", "a"),
    ("<style>@import 'a.css'; @charset 'x'; .x{display:none}</style><p class=x>no</p>yes", "yes"),
    ("<style>@supports (display:grid){@media all{.x{display:none}}}</style><p class=x>no</p>yes", "yes"), ("<style>@keyframes k{from{display:none}}</style><from>a</from>", "a"),
    ("<style>.a::after{content:'}'} .x{color:red;display:none</style><p class=x>no</p>yes", "yes"),
]


@pytest.mark.parametrize("page,want", SHOWN)
def test_all_that_a_screen_shows(page, want):
    assert m.extract(page) == want


def test_deep_text_stays():
    assert m.extract("<div>" * 5000 + "deep" + "</div>" * 5000 + "end").split() == ["deep", "end"]


@pytest.mark.parametrize("depth", [150, 20_000])
def test_structure_at_any_depth(depth):
    soup = "<font><b>" * depth
    assert m.extract(soup + "<p hidden>no</p><i style='display:none'>no <u>no</u></i>yes") == "yes"
    assert m.extract(soup + "<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>long<td>e</table><pre>x\n y</pre>") == "- a\n- b\n\nc     d\nlong  e\n\nx\n y"
    assert m.extract("<div><style>.x>u{}</style><i hidden>" + soup + "<div>no</div>no</i></div>yes") == "yes"


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "</i>" * 50_000 + "x", "<li><table>" + "<b>" * 50_000 + "</li>" * 50_000 + "x", "<b>" * 50_000 + "<p>" * 20_000 + "x"])
def test_deep_soup_takes_no_quadratic_time(page):
    assert m.extract(page).split()[-1:] == ["x"]


def test_wide_cells_leave_columns_aligned():
    words, url = " ".join(["word"] * 40), "u" * 90
    lines = m.extract(f"<table><tr><td>{words}<td>b<tr><td>c<td>d<tr><td>e<td>{words}</table>").split("\n")
    at = lines[0].index("b")
    assert max(map(len, lines[:4])) <= m.WIDEST + 3 and " ".join(lines).split().count("word") == 80
    assert [x.index(y) for x in lines for y in "d" if x.startswith("c ")] == [at] and [x.index("word") for x in lines if x.startswith("e ")] == [at]
    lines = m.extract(f"<table><tr><td>{url}<td>b<tr><td>c<td>d</table>").split("\n")
    assert lines[0] == url + "  b" and lines[1] == "c".ljust(92) + "d"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<br>", "<pre>", "</pre>", "alpha", "beta", " ", "\n", "<h2>", "</h2>", "<ol>", "</ol>", "<blockquote>", "</blockquote>", "<dd>"]), max_size=25))
def test_all_words_come_through(parts):
    page = "".join(p if p.startswith("<") else p + " " for p in parts)
    found = re.findall("alpha|beta", m.extract(page))
    assert sorted(found) == sorted(p for p in parts if p in ("alpha", "beta"))


def test_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = m.op5_html_text(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == {k: m.extract(v) for k, v in pages.items()}
    for r in rows:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "<p>" not in r.text


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "<p>x", "a"), (2, "y " * 200_000, "b"), (2, "y " * 200_000, "b")], "page_id long, html string, text string")
    assert sorted(r.n_chars for r in m.extract_pages(df).collect()) == [0, 1, 399_999, 399_999]
    assert m.extract_pages(df.limit(0)).count() == 0
