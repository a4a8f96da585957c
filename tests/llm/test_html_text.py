from html.parser import HTMLParser

from svgloom.llm import html_text as ht
from svgloom.llm.common import table


def t(html):
    return ht.visible_text(html)


def test_blocks_and_inline():
    assert t("<p>One <b>two</b>\n three<p>Four<br>five</p>six") == "One two three\n\nFour\nfive\n\nsix"
    assert t("<div>a</div><div>b</div>c<div><div>d</div></div>") == "a\nb\nc\nd"
    assert t("x &amp; y &lt;b&gt; &eacute;&nbsp;z 1 < 2") == "x & y <b> é z 1 < 2"
    assert t("<pre>a  b\n   c</pre>d") == "a  b\n   c\n\nd"
    assert t("<h1>H<h2>I</h2>p<hr>q") == "H\n\nI\n\np\n\n---\n\nq"


def test_visibility():
    assert t("<head><title>no</title><style>p{}</style></head><body>a<script>if (1<2) x()</script><!-- no --><p hidden>no<p style='display: none'>no</p><p data-x=hidden>b</p>") == "a\n\nb"
    assert t('<div style="visibility:hidden">no<span style="visibility:visible">yes</span>no</div>') == "yes"
    assert t("<template>no</template><noscript>no</noscript><textarea>in</textarea><input type=hidden value=no><input value='v'>") == "in v"


def test_foreign_and_embedded():
    assert t("a<svg viewBox='0 0 9 9'><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text>one</text><path d='M0 0'/><text>two <tspan>three</tspan></text></svg>b") == "a one two threeb"
    assert t("<p>x <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='TeX'>no</annotation></semantics></math> y") == "x E=m y"
    assert t("<svg><defs/><title/><text>seen</text></svg><desc>known nowhere</desc>") == "seenknown nowhere"
    assert t("<object data=x><p>fallback</object><map name=m><area alt=no>in map</map>") == "fallback\n\nin map"


def test_lists():
    assert t("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n\n  - c\n- d"
    assert t("<ol start=3><li>a<li value=7>b<li><p>c<p>d</ol>e") == "3. a\n7. b\n8. c\n\n   d\n\ne"
    assert t("<dl><dt>k<dd>v<dt>l<dd>w</dl>") == "k\n    v\nl\n    w"


def test_tables():
    assert t("<table><caption>C</caption><tr><th>name<th>n<tr><td>long name<td>1</table>") == "C\nname      | n\nlong name | 1"
    assert t("<table><td>a<td>b<tr><td colspan=2>wide cell<tr><td>c<td>d<br>e</table>x") == "a | b\nwide cell\nc | d\n  | e\n\nx"
    assert t("<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>") == "in | ner | o"


def test_cells_that_cover_rows():
    assert t("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>") == "aa | b\n   | c\nd  | e"
    assert t("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a | b | c\nd |   | e\nf |   | g"
    assert t("<table><thead><tr><th rowspan=9>h<th>i<tbody><tr><td>a<td>b</table>") == "h | i\na | b"
    assert t("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tr><td>c<td>d</table>") == "a | b\nc | d"


def test_odd_pages():
    for html in ("", "<", "<a", "</", "<!--", "<p", "<a b='", '<a b="' * 50, "</p>", "<![CDATA[x]]>", "<td>x", "<tr><li></table></ul>", "<script>", "<title>a"):
        assert isinstance(t(html), str)
    assert t("<div>" * 50_000 + "deep") == "deep"
    assert t("<table><tr><td>" * 300 + "deep").endswith("deep")
    assert t("</b>a</div>b</p>c") == "ab\n\nc"
    assert len(t("<p>word" * 100_000).split()) == 100_000


class Words(HTMLParser):
    """All text outside of what is never displayed, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head", "title", "template", "noscript")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head", "title", "template", "noscript") and self.off > 0

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_all_visible_words_of_the_pages_in_order(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = ht.op8_html_text(spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        w = Words()
        w.feed(html[r.page_id])
        w.close()
        strip = lambda s: "".join(s.replace("- ", " ").replace("|", " ").split()).replace("-", "")
        assert strip(r.text) == strip("".join(w.out)), r.page_id


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, "c"), (None, "<p>a", "c"), (1, "", "c")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text or "") for r in ht.extract(pages).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert ht.extract(pages.limit(0)).count() == 0


def test_the_end_of_a_phrase_ends_no_block():
    assert t("<div>one <span>two<p>three</span> four</p></div>five") == "one two\n\nthree four\n\nfive"
    assert t("<b><div>x</b> y</div>") == "x y"
