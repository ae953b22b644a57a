"""Work per page grows with the page, whatever it holds; nothing on it is lost."""

import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import text as T
from webloom.operators import content, crawl, dom, extract
from webloom.functions.urls import url_join
from webloom.functions.sqltext import lit


def seconds(df):
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


@pytest.mark.parametrize("unit", ["<!-- a", "<script", "<script>", "<a ", "<a b='", "<", "</x", "<title>", "<!x"])
def test_unfinished_constructs_are_linear(page, unit):
    extract.link_targets(page("<a href=x>")).count()
    half, whole = (page(unit * (n // len(unit))) for n in (500_000, 1_000_000))
    first, second = seconds(extract.link_targets(half)), seconds(extract.link_targets(whole))
    assert second < 5 and second < 2.5 * first + 1
    back = whole.select(F.expr(f"array_join({H.tokens('html')}, '') = html").alias("same"))
    assert back.first()["same"]


def test_text_below_many_levels_stays(page):
    doc = dom.dom(page("<div>" * 5000 + "<p>deep</p>", "<div>" * 600 + "<p>deep</p>"))
    assert [r["text"] for r in dom.text_content(doc, "p").collect()] == ["deep", "deep"]
    assert dom.select(doc, "div > p").count() == 2


def test_rendering_is_linear(page):
    content.html_to_markdown(page("<ul><li>x</ul>")).count()
    n = 20_000
    plain = seconds(content.html_to_markdown(page("<ul>" + "<li>x</li>" * n + "</ul>")))
    for html in ("<ol>" + "<li>x</li>" * n + "</ol>", "<pre>a  b</pre>" * n, "<template>x</template>y" * n):
        assert seconds(content.html_to_markdown(page(html))) < 2 * plain + 1


def test_verbatim_hidden_and_numbered(page):
    html = "<head><title>t</title>x</head><ol><li>a</li><p>-</p><li>b <pre>  k\n  l</pre> c</li></ol><template>no</template><pre>z  z</pre> e  e"
    assert content.html_to_markdown(page(html)).first()["content"] == "1. a\n\n-\n\n2. b \n\n  k\n  l\n\n c\n\nz  z\n\n e e"


@pytest.mark.parametrize(
    "ref,want",
    [("/a//b", "http://h/a//b"), (" /x ", "http://h/x"), ("a//b/./c", "http://h/d/a/b/c"), ("../z", "http://h/z"), ("//o/p", "http://o/p"), ("?q", "http://h/d/e?q"), ("", "http://h/d/e"), ("mailto:x", "mailto:x")],
)
def test_url_join(spark, ref, want):
    assert spark.sql(f"SELECT {url_join(lit('http://h/d/e'), lit(ref))} AS u").first()["u"] == want


def test_references_against_the_standard_library(spark):
    import html

    names = ["&copy 1", "&copy;", "&notin;", "&notit;", "&AMP", "&#150;", "&#x96;", "&#0;", "&#xD800;", "&#1114112;", "&NotEqualTilde;", "a & b", "&;", "&#;", "&unknown;"]
    got = spark.createDataFrame([(n,) for n in names], "s STRING").select("s", F.expr(T.decode_entities("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in got} == {n: html.unescape(n) for n in names}


def test_steps_go_to_their_page(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<h1>A</h1>"), (2, "http://h/b", "<h1>B</h1>"), (3, "http://h/b", "<h1>B2</h1>")], "page_id BIGINT, url STRING, html STRING")
    steps = [{"goto": "http://h/b"}, {"extract": {"selector": "h1"}}, {"goto": "http://other/"}, {"extract": {"selector": "h1"}}, {"hop": 1}]
    got = crawl.extract_steps(pages, steps).orderBy("step").collect()
    assert [(r["page_id"], r["step"], r["action"], r["data"], r["status"], r["error"]) for r in got] == [
        (2, 1, "goto", ["http://h/b"], "success", None), (2, 2, "extract", ["B"], None, None), (None, 3, "goto", None, "error", "page not stored: http://other/"),
    ]


def test_pattern_spelling():
    assert extract.java_pattern(r"(?P<year_1>\d+)[(?P<]x(?P=year_1)1\Z") == r"(\d+)[(?P<]x(?:\1)1\z"


def test_walk_without_a_limit_ends_where_it_comes_back(spark):
    rows = [(k, f"http://h/{k}", f"<li>{k}</li><a class=next href=/{(k + 1) % 7}>n</a>") for k in range(7)] + [(9, "http://h/9", "<li>9</li><a class=next href=/nowhere>n</a>")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    start = pages.where("page_id IN (2, 9)").select("url")
    items, counts = crawl.paginate(pages, start, "a.next", "li")
    assert [r["item"] for r in items.where("start_url = 'http://h/2'").orderBy("page_no").collect()] == ["2", "3", "4", "5", "6", "0", "1"]
    assert {r["start_url"]: (r["pages"], r["n_items"]) for r in counts.collect()} == {"http://h/2": (7, 7), "http://h/9": (1, 1)}
    some, _ = crawl.paginate(pages, start, "a.next", "li", max_pages=10)
    assert some.where("start_url = 'http://h/2'").count() == 10
