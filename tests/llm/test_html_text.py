import pytest
from pyspark.sql import functions as F

from ordinate.llm import html_text as m

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>x</b> <i>y</i>\n z", "x y z"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<table><tr><td>1<td>long cell<tr><th>xx<td>é</table>", "1  | long cell\nxx | é"),
    ("<table><thead><tr><th>h<th>i</thead><tfoot><tr><td>f<td>g</tfoot><tbody><tr><td colspan=2>wide<tr><td rowspan=2>r<td>1<tr><td>2</table>", "h    | i\nwide |\nr    | 1\n     | 2\nf    | g"),
    ("<pre>\n a\n  b\n</pre>t", " a\n  b\n\nt"), ("x<script>var a = '</p>';</script><style>p{}</style><!-- c -->y", "xy"), ("<head><title>t</title></head><body>b", "b"),
    ("<div hidden>no</div><span style='DISPLAY: none'>no</span><p style=visibility:hidden>no</p>yes", "yes"), ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("a<p>b</p>c<h1>d</h1>", "a\n\nb\n\nc\n\nd"), ("<a href='x>y'>link</a> 1 < 2 & 3", "link 1 < 2 & 3"), ("</p></div>stray", "stray"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a  | b\n   |\nin |"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("<textarea><b>raw</b></textarea>", "<b>raw</b>"), ("<p>unclosed <b>bold", "unclosed bold"), ("<table><tr><td>漢字<td>x<tr><td>abcd<td>y</table>", "漢字 | x\nabcd | y"), ("a<hr>b", "a\n\n---\n\nb"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rendering(page, text):
    assert m.to_text(page) == text


def test_deep_and_long_pages():
    assert m.to_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "end").split() == ["deep", "end"]
    assert m.to_text("<b>x" * 3000).replace(" ", "") == "x" * 3000
    assert len(m.to_text("<p>w</p>" * 20_000).split()) == 20_000
    assert m.to_text("<" * 3000).count("<") >= 1


@pytest.mark.parametrize("page, text", [
    ("<p>a<div>b</div>c</p>d", "a\n\nb\nc\n\nd"), ("<html hidden><body>no", ""), ("<html style='display:none'>no", ""),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>end", "yes\nend"), ("<p style='content-visibility:hidden'>yes", "yes"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><title>no</title><text>drawn</text></svg>", "x=2 drawn"),
    ("<ul style=visibility:hidden><li>no<li style=visibility:visible>yes</ul>", "- yes"),
])
def test_implied_paragraphs_and_visibility(page, text):
    assert m.to_text(page) == text


def test_large_tables_stay_in_proportion():
    """Nothing is lost, and the text is no more than ten times the page."""
    cells = [f"c{i}" for i in range(40_000)]
    long = "<table>" + "".join(f"<tr><td>{c}<td>x" for c in cells) + f"<tr><td>{'w ' * 300_000}<td>y</table>"
    spans = "<table>" + "".join(f"<tr><td colspan=1000>{c}" for c in cells[:5000]) + "</table>"
    down = "<table><tr>" + "".join(f"<td rowspan=60000>{c}" for c in cells[:3000]) + "".join(f"<tr><td>{c}" for c in cells[3000:9000]) + "</table>"
    ragged = "<table><tr>" + "".join(f"<td>{c}" for c in cells[:20_000]) + "".join(f"<tr><td colspan=999>{c}<td>z" for c in cells[20_000:30_000]) + "</table>"
    for page in (long, spans, down, ragged):
        text = m.to_text(page)
        assert len(text) < 10 * len(page)
        assert sorted(w for w in text.replace("|", " ").split() if w[0] == "c") == sorted(c for c in cells if f">{c}" in page)


def brute_words(page):
    """Visible words by the standard library's parser and a stack of open tags."""
    from html.parser import HTMLParser

    out = []

    class Words(HTMLParser):
        off = 0

        def handle_starttag(self, tag, attrs):
            if self.off or tag in ("head", "script", "style", "template", "noscript"):
                self.off += tag not in m.VOID

        def handle_endtag(self, tag):
            self.off -= bool(self.off) and tag not in m.VOID

        def handle_data(self, data):
            if not self.off:
                out.append(data)

    own = Words()
    own.feed(page)
    own.close()
    return out


def test_words_are_the_plain_parsers(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        if r.html and "hidden" not in r.html and "display" not in r.html:
            assert "".join(re.findall(r"\w+", m.to_text(r.html))) == "".join(re.findall(r"\w+", " ".join(brute_words(r.html))))


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None), (2, "")], "page_id long, html string").withColumns({"text": F.lit("clash"), "url": F.lit("u")})
    assert sorted(map(tuple, m.extract(df).collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, ""), (2, "")], key=str)
    assert m.extract(df.limit(0)).collect() == []


def test_query_keeps_every_visible_word(spark, sf_dir):
    """Against tags cut out by a plain pattern: same words, in the same order."""
    import html
    import re

    found = {r.page_id: r.text for r in m.op5_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        plain = html.unescape(re.sub(r"<[^>]*>", " ", plain))
        words = [w for w in re.findall(r"\w+", found[r.page_id])]
        assert "".join(words) == "".join(re.findall(r"\w+", plain))
