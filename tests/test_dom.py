import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.selectors import parse, tags_of
from webloom.operators import dom


def spans(spark_page):
    rows = dom.element_table(spark_page).orderBy("page_id", "start_pos").collect()
    toks = {r["page_id"]: r["t"] for r in spark_page.select("page_id", F.expr(H.tokens("html")).alias("t")).collect()}
    return [(r["tag"], "".join(toks[r["page_id"]][r["start_pos"] + 1 : r["end_pos"]]) if r["end_pos"] > r["start_pos"] else None) for r in rows]


def test_tokens_of_traps(page):
    html = '<!-- <a>no</a> --><SCRIPT>var t="</p>";</SCRIPT><a title="x>y" HREF=/z>t</A><style>p{}</style>a < b'
    rows = dom.token_table(page(html)).orderBy("pos").collect()
    assert [r["kind"] for r in rows] == ["comment", "raw", "open", "text", "close", "raw", "text", "text", "text"]
    assert "".join(r["tok"] for r in rows) == html
    assert rows[2]["tag"] == "a"


def test_long_tags_and_unterminated_tags(page):
    many = "<div " + " ".join(f'a{i}="{i}"' for i in range(6000)) + ">x</div>"
    unterminated = "<p " + 'a="b" ' * 3000
    rows = dom.dom(page(many, unterminated)).select("page_id", F.array_join("toks", "").alias("t"), F.size("els").alias("n")).orderBy("page_id").collect()
    assert rows[0]["t"] == many and rows[0]["n"] == 1
    assert rows[1]["t"] == unterminated


def test_implied_ends(page):
    assert spans(page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")) == [
        ("ul", "<li>a<li>b<ul><li>c</ul><li>d"), ("li", "a"), ("li", "b<ul><li>c</ul>"), ("ul", "<li>c"), ("li", "c"), ("li", "d"),
    ]
    assert spans(page("<div><p>a<p>b<div>c</div>d</div>")) == [("div", "<p>a<p>b<div>c</div>d"), ("p", "a"), ("p", "b"), ("div", "c")]
    assert spans(page("<table><tr><td>1<td>2<tr><td><table><tr><td>x</table>y</table>z"))[0] == ("table", "<tr><td>1<td>2<tr><td><table><tr><td>x</table>y")
    assert spans(page("<p><b>a<p>c</b>")) == [("p", "<b>a"), ("b", "a"), ("p", "c</b>")]
    assert spans(page("<select><option>a<option>b</select><dl><dt>x<dd>y</dl>")) == [
        ("select", "<option>a<option>b"), ("option", "a"), ("option", "b"), ("dl", "<dt>x<dd>y"), ("dt", "x"), ("dd", "y"),
    ]


def test_nesting_and_stray_tags(page):
    assert spans(page("<div><div>a</div>b</div></div><br>c</span>")) == [("div", "<div>a</div>b"), ("div", "a"), ("br", None)]
    assert spans(page("<svg><path d='x'/><g>t</g></svg>")) == [("svg", "<path d='x'/><g>t</g>"), ("path", None), ("g", "t")]
    assert spans(page("<a>x<a>y</a>")) == [("a", "x"), ("a", "y")]
    assert spans(page("<b><div>x</b>y</div>z")) == [("b", "<div>x</b>y</div>z"), ("div", "x</b>y")]


def test_attributes(page):
    row = dom.element_table(page("""<a href=/x HREF="/y" data-a='1 "2"' hidden title="a &amp; b" class="p  q">""")).first()
    assert row["attrs"] == {"href": "/x", "data-a": '1 "2"', "hidden": "", "title": "a & b", "class": "p  q"}
    assert row["classes"] == ["p", "q"]


def test_text_and_trim(page):
    doc = dom.dom(page("<h1>  A &lt;&#65;&#x42;&eacute;&nope;&amp;lt; \n</h1><p>x<script>s</script></p>"))
    assert [r["text"] for r in dom.text_content(doc, "h1, p").orderBy("pos").collect()] == ["A <ABé&nope;&lt;", "xs"]


def test_descendants_are_slices(page):
    doc = dom.dom(page("<div><p>a<p>b</div><span>c</span>"))
    rows = doc.select(F.explode(F.expr(f"transform(els, x -> struct(x.tag AS tag, size({H.descendants('x')}) AS n))")).alias("r")).select("r.*").collect()
    assert [(r["tag"], r["n"]) for r in rows] == [("div", 2), ("p", 0), ("p", 0), ("span", 0)]


def test_selectors(page):
    html = "<main id=m><section class='a b'><p lang=en>1<p>2</section><p class=ab>3</main><p>4"
    doc = dom.dom(page(html))

    def texts(selector):
        return [r["text"] for r in dom.text_content(doc, selector).orderBy("pos").collect()]

    assert texts("p") == ["1", "2", "3", "4"]
    assert texts("main p") == ["1", "2", "3"]
    assert texts("main > p, #m .a > [lang]") == ["1", "3"]
    assert texts(".b p:not([lang])") == ["2"]
    assert texts("[class*=ab], [lang^='e']") == ["1", "3"]
    assert texts("section.a.b") == ["12"]
    assert texts("[class~=b]") == ["12"]


def test_selector_shorthand():
    assert [s.tag for s in parse("nav > a.x [href]")[0]] == ["nav", "a", ""]
    assert tags_of("h1, nav a") == {"h1", "nav", "a"} and tags_of(".x") is None
    with pytest.raises(ValueError):
        parse("a::before")


def test_path_query_and_closest(page):
    doc = dom.dom(page("<div><ul><li><a rel=next href=/n>x</a></ul><a>y</a></div>"))
    assert [r["result"] for r in dom.path_query(doc, [("//", "div"), ("/", "a")], as_text=True).collect()] == ["y"]
    assert [r["result"] for r in dom.path_query(doc, [("//", "a[rel='next']")], attribute="href").collect()] == ["/n"]
    near = dom.closest(doc, "a", "li, a[href]").orderBy("pos").collect()
    assert [(r["closest_tag"]) for r in near] == ["a", None]


def test_nth_child(page):
    doc = dom.dom(page("<ul><li>a<li>b<li>c</ul><ol><p>x</p><li>d</ol>"))
    assert sorted(r["text"] for r in dom.nth_child(doc, "li", 2).collect()) == ["b", "d"]


def test_very_long_page(page):
    n = 20000
    html = "<ul>" + "".join(f"<li><b>{i}</b>" for i in range(n)) + "</ul>"
    doc = dom.dom(page(html), ["li"])
    assert dom.text_content(doc, "li").agg(F.count("*"), F.sum("text")).first()[:] == (n, n * (n - 1) / 2)


def test_very_deep_page_and_long_raw_text(page):
    deep = "<div>" + "<b>x" * 5000 + "</div><p>end"
    raw = "<p>a</p><script>" + "var x = '<b>';\n" * 60000 + "</script><!--" + "<i>" * 60000 + "--><p>" + "word &amp; " * 60000 + "</p>"
    p = page(deep, raw)
    doc = dom.dom(p)
    rows = doc.select("page_id", F.size("els").alias("n"), F.expr("array_max(transform(els, x -> x.d))").alias("d")).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(0, 5002, 5000), (1, 3, 0)]
    texts = dom.text_content(doc, "div, p").orderBy("page_id", "pos").select(F.length("text").alias("n")).collect()
    assert [r["n"] for r in texts] == [5000, 3, 1, 60000 * 7 - 1]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_element_invariants(page, seed):
    rng = random.Random(seed)
    tags = ["div", "p", "b", "li", "ul", "td", "tr", "table", "a", "br", "img", "option", "script"]
    docs = []
    for _ in range(40):
        docs.append("".join(rng.choice([f"<{t}>", f"</{t}>", "text", "<", f"<{t} x='>' y>"]) for t in rng.choices(tags, k=rng.randint(0, 60))))
    p = page(*docs)
    bad = dom.dom(p).where(
        "exists(els, x -> x.e < x.s OR x.z <= x.i OR x.p >= x.i OR (x.p >= 0 AND (els[x.p].e < x.e OR els[x.p].s >= x.s OR els[x.p].z < x.z OR els[x.p].d <> x.d - 1)))"
    )
    assert bad.count() == 0
    whole = p.select(F.expr(f"array_join({H.tokens('html')}, '') = html").alias("same"))
    assert whole.where("NOT same").count() == 0
