import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.sqltext import lit
from webloom.functions.text import has_date, js_trim, word_count
from webloom.operators import aria, audit, content, crawl, dom, extract, forms, recon, state, tables
from webloom.sources import readers


def one(spark, sql):
    return spark.range(1).select(F.expr(sql).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"),
        ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"),
        ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"),
        ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"),
        ("mailto:x@y", "mailto:x@y"), ("javascript:void(0)", "javascript:void(0)"), ("https://h/x", "https://h/x"), ("../a?b#c", "http://a/b/a?b#c"),
    ],
)
def test_url_join(spark, ref, want):
    assert one(spark, U.url_join(lit("http://a/b/c/d;p?q"), lit(ref))) == want


@pytest.mark.parametrize(
    ("pattern", "url", "hit"),
    [
        ("*/blog/*", "http://x/blog/1", True), ("*/blog/*", "http://x/Blog/1", False), ("a?c", "abc", True), ("a?c", "abbc", False),
        ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("100%_*", "100%_a", True), ("100%_*", "1000_a", False), ("a.c", "abc", False), ("[x", "[x", True),
    ],
)
def test_glob(spark, pattern, url, hit):
    assert one(spark, U.glob_match(lit(url), pattern)) is hit


def test_url_helpers(spark):
    assert one(spark, U.is_internal(lit("http://a.com.evil/x"), lit("http://a.com/y"))) is True
    assert one(spark, U.same_domain(lit("http://sub.a.com/"), lit("http://a.com/"))) is False
    assert one(spark, U.file_name(lit("http://a.com"))) == "index"
    assert one(spark, U.file_name(lit("http://a.com/x/y/?q"))) == "x_y_"


def test_text_functions(spark):
    assert one(spark, js_trim(lit(" \n x ﻿ "))) == "x"
    assert one(spark, word_count(lit("  a b\n\tc "))) == 3
    assert one(spark, has_date(lit("on march 3, 2024"))) is True
    assert one(spark, has_date(lit("in 2024"))) is False


def test_links(page):
    html = '<a href="/x"> X </a><a>no</a><a href="">e</a><a href="#">h</a><a href="mailto:a@b">m</a><A HREF=//h/y>y</A>'
    rows = extract.extract_links(page(html), absolute=True).orderBy("pos").collect()
    assert [r["href"] for r in rows] == ["https://www.example.com/x", "https://www.example.com/dir/page.html?q=1", "mailto:a@b", "https://h/y"]
    assert [r["href"] for r in extract.extract_links(page(html)).orderBy("pos").collect()] == ["/x", "#", "mailto:a@b", "//h/y"]
    assert [r["pos"] for r in extract.link_targets(page(html)).orderBy("pos").collect()] == [r["pos"] for r in rows]


def test_text_of_whitespace(page):
    p = page("<p> </p><p> a </p>")
    assert [r["text"] for r in extract.extract_text(p, "p").collect()] == ["a"]
    assert extract.batch_selectors(p, ["p", "h1"]).orderBy("selector").select("texts").collect() == [([],), (["", "a"],)]
    assert extract.extract_text(p, "h1", all=False).first()["text"] == ""


def test_regex(page):
    p = page("<p>a1 b22</p><script>c333</script>")
    assert [r["groups"] for r in extract.extract_regex(p, r"[a-z]\d+").orderBy("match_no").collect()] == [["a1"], ["b22"], ["c333"]]
    assert [r["groups"] for r in extract.extract_regex(p, r"([a-z])(\d+)", "p").orderBy("match_no").collect()] == [["a", "1"], ["b", "22"]]
    assert extract.extract_regex(p, r"z(\d)").count() == 0


def test_tables(page):
    html = (
        "<table><tr><th>a</th><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><th>row</th><td>3</td></tr>"
        "<tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>"
    )
    first = tables.extract_tables(page(html)).orderBy("table_no").first()
    assert first["headers"] == ["a", "a", "b"]
    assert first["rows"] == [{"a": "2", "b": ""}, {"a": "", "b": ""}, {"a": "in", "b": ""}, {"a": "", "b": ""}]
    none = tables.table_with_fallback(page("<p>x", "<table><tr><th>h</th></tr></table>"), ".x").orderBy("page_id").collect()
    assert [(r["error"], r["tables_on_page"]) for r in none] == [("No table found with selector '.x' or any fallback", n) for n in (0, 1)]
    assert tables.extract_tables(page("<table></table>")).first()["rows"] == []


def test_records_and_bad_mapping(page):
    out = tables.extract_records(page("<li><b> </b><i>x</i></li><li></li>"), "li", {"v": "b, i"}).orderBy("pos").collect()
    assert [r["v"] for r in out] == ["x", None]
    with pytest.raises(ValueError, match="valid JSON"):
        tables.extract_records(page(""), "li", "{bad")


def test_forms(page):
    html = (
        "<form><div role=form><input name=in></div><input type=CHECKBOX><select multiple><option>one<option selected>two</select></form>"
        "<x-search><div><input name=q></div></x-search><div id=g><span><textarea>t</textarea></span></div>"
    )
    rows = forms.extract_forms(page(html)).orderBy("form_no").collect()
    assert [(r["type"], r["selector"], len(r["fields"])) for r in rows] == [("form", None, 3), ("implicit", "x-search", 1), ("implicit", "div#g", 1)]
    fields = rows[0]["fields"]
    assert [f["type"] for f in fields] == ["text", "checkbox", "select-multiple"]
    assert [f["value"] for f in fields] == [None, "on", "two"] and [o["text"] for o in fields[2]["options"]] == ["one", "two"]
    assert rows[0]["action"].startswith("https://www.example.com/dir/page.html") and rows[0]["method"] == "get"


def test_form_matching(page):
    html = "<label for=z>Zip code</label><form><input id=z><input name=zip><textarea aria-label='My Notes'></textarea><input data-testid=tid-x></form>"
    rows = forms.match_form_fields(page(html), ["zip", "notes", "TID", "nothing"]).collect()
    assert {r["wanted"]: r["matched_by"] for r in rows} == {"zip": "label", "notes": "textarea aria-label", "TID": "data-testid", "nothing": None}


def test_heading_skips(page):
    rows = audit.heading_skips(page("<h2>a", "<h1>a</h1><h3>b", "<h3>b</h3><h1>a")).orderBy("page_id").collect()
    assert [(r["page_id"], r["previous_level"], r["level"]) for r in rows] == [(0, 0, 2), (1, 1, 3), (2, 0, 3)]


def test_a11y(page):
    html = (
        "<main></main><img src=x><img alt=ok><img aria-label=l><label>n <input></label><input type=hidden><input id=i><label for=i>x</label><select></select>"
        "<a>t</a><a href='#'>u</a><button> </button><div role=button>b</div>"
    )
    s = audit.a11y_summary(page(html)).first()
    assert (s["missing_alt"], s["missing_label"], s["button_no_name"], s["empty_link"], s["total_issues"]) == (1, 1, 1, 1, 4)
    assert s["has_main"] and not s["has_nav"]
    assert audit.a11y_issues(page(html)).count() == s["total_issues"]


def test_security_score(spark):
    df = spark.sql("SELECT 'u' AS url, map('Content-Security-Policy', 'x', 'x-frame-options', '') AS headers UNION ALL SELECT 'v', CAST(map() AS MAP<STRING,STRING>)")
    assert [(r["url"], r["score"], len(r["issues"])) for r in audit.security_headers(df).orderBy("url").collect()] == [("u", 40, 3), ("v", 20, 4)]


def test_checked_links_limit_comes_first(page):
    html = "<a href='mailto:x'>m</a><a href='/a'>a</a><a href='/b'>b</a>"
    p = page(html, "")
    status = p.sparkSession.createDataFrame([("https://www.example.com/a", 404)], "url STRING, status INT")
    rows = audit.broken_link_summary(p, status, max_check=2).orderBy("page_id").collect()
    assert [(r["total_links"], r["checked"], r["broken"]) for r in rows] == [(3, 1, 1), (0, 0, 0)]
    assert audit.broken_links(p, status).orderBy("href").select("href", "status").collect() == [("https://www.example.com/a", 404), ("https://www.example.com/b", None)]


def test_recon_page_types(page):
    p = page("<div id=root>", "<form></form><a href=/x>", "<table></table>", "<p>", "<script src=/react.js></script>", "<form></form>" + "<a href='http://o/'>o</a>" * 10)
    rows = recon.recon(p).orderBy("page_id").collect()
    assert [r["page_type"] for r in rows] == ["spa", "form", "data", "static", "spa", "static"]
    assert (rows[5]["links_internal"], rows[5]["links_external"]) == (0, 10)


def test_collapsed_elements_skip_navigation(page):
    html = "<nav><details></details><button aria-expanded=false aria-controls=x>b</button></nav><details><summary>s</summary></details>"
    r = content.collapsible_census(page(html)).first()
    assert (r["details_closed"], r["summary_closed"], r["aria_collapsed"], r["aria_controls"], r["container"]) == (2, 1, 0, 0, "body")


def test_aria_blocks(spark):
    text = "- list:\n  - article:\n    - heading \"a\"\n\n    - article:\n      - link \"l\"\n  - text: x\n- article \"z\":\n  - paragraph: p"
    df = spark.createDataFrame([(1, text), (2, "- listitem:\n  - text: a"), (3, "- row:\n  - text: a"), (4, "- generic:\n  - heading \"h\"\n  - link \"l\"\n- generic:\n  - text: t"), (5, "")], "page_id BIGINT, snapshot STRING")
    rows = aria.aria_blocks(df, "ARTICLE").orderBy("page_id", "block_no").collect()
    assert [len(r["lines"]) for r in rows] == [3, 2, 2]
    used = aria.container_blocks(df).orderBy("page_id", "block_no").select("page_id", "container_used").collect()
    assert [tuple(r) for r in used] == [(1, "article")] * 3 + [(2, "listitem"), (3, "row"), (4, "generic")]


def test_markdown(page):
    md = content.html_to_markdown(page("<h1>T</h1><p>a <b>b</b> <a href=/x>c</a></p><ul><li>1<li>2</ul><pre> k\n  v</pre><script>no</script>")).first()["content"]
    assert md == "# T\n\na **b** [c](/x)\n\n* 1\n* 2\n\n k\n  v"


def test_sitemaps(spark):
    docs = [
        ("a", "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>1</loc></url><url><priority>0.5</priority></url></urlset>"),
        ("b", "<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>"),
        ("c", "not xml"),
        ("d", "<sm:urlset xmlns:sm='x'><sm:url><sm:loc>2</sm:loc></sm:url></sm:urlset>"),
        ("e", "<urlset></urlset>"),
    ]
    rows = readers.sitemap_urls(spark.createDataFrame(docs, "url STRING, xml STRING")).orderBy("url", "entry_no").collect()
    assert [(r["url"], r["type"], r["loc"], r["priority"]) for r in rows] == [
        ("a", "url", "1", None), ("a", "url", None, "0.5"), ("b", "sitemap", "m", None), ("c", None, None, None), ("d", "url", "2", None),
    ]
    assert rows[3]["error"] is not None


def test_feeds(spark):
    docs = [("r", "<rss><channel><item><link>l</link></item></channel></rss>"), ("a", "<feed><entry><title>t</title></entry><entry><link href='h'/></entry></feed>")]
    df = spark.createDataFrame(docs, "url STRING, xml STRING")
    assert [(r["type"], r["title"]) for r in readers.feed_info(df).orderBy("url").collect()] == [("atom", None), ("rss", None)]
    items = readers.feed_items(df).orderBy("url", "item_no").collect()
    assert [(r["title"], r["link"]) for r in items] == [("t", None), (None, "h"), (None, "l")]


def test_crawl_cycles_and_missing_pages(spark):
    def html(*links):
        return "<title>t</title>" + "".join(f"<a href='{u}'>x</a>" for u in links)

    pages = spark.createDataFrame(
        [(1, "http://h/a", html("/b", "/c", "http://o/x")), (2, "http://h/b", html("/a", "/d")), (3, "http://h/d", html("/e")), (4, "http://h/a", html("/zzz"))],
        "page_id BIGINT, url STRING, html STRING",
    )
    rows = crawl.crawl(pages, "http://h/a", depth=2).orderBy("url").collect()
    assert [(r["url"][-1], r["depth"], r["error"]) for r in rows] == [("a", 0, None), ("b", 1, None), ("c", 1, "page not stored"), ("d", 2, None)]


def test_collect_until_matches_plain_loop(spark):
    import random

    rng = random.Random(5)
    data = [(s, r, p, f"i{rng.randint(0, 6 + s)}") for s in range(6) for r in range(1, 16) for p in range(rng.randint(0, 3))]
    want = set()
    for s in range(6):
        seen, flat = [], 0
        for r in range(1, 16):
            before = len(seen)
            for row in sorted(x for x in data if x[0] == s and x[1] == r):
                if row[3] not in seen:
                    seen.append(row[3])
            flat = flat + 1 if len(seen) == before else 0
            if flat >= 3 or len(seen) >= 5:
                break
        want |= {(s, i) for i in seen[:5]}
    df = spark.createDataFrame(data, "stream_id BIGINT, round INT, pos INT, item STRING")
    assert {(r["stream_id"], r["item"]) for r in state.collect_until(df, 5).collect()} == want


def test_first_text_of_each_selector_kind(page):
    p = page("<div class=box style='color:red; COLOR: blue;x'>a</div>")
    assert extract.inline_styles(p, ".box").first()["styles"] == {"color": "blue"}
    assert dom.inner_html(dom.dom(p), ".box").first()["html"] == "a"
    assert recon.element_selectors(p, "div", "overview").first()["selector"] == "div.box"


def test_flat_selectors_equal_the_element_list(page):
    p = page("<!-- <a> --><script>'<a>'</script><a class='x y' href=/1><A CLASS=x>t</A></p><style>a{}</style>", "")
    for selector in ("a", ".x", "a.x[href], script", "style, [class~=y]", "*"):
        tree = dom.dom(p, [selector]).select("page_id", F.expr(dom.count_of(selector)).alias("n"))
        assert content.count_elements(p, selector).exceptAll(tree).count() == 0
    assert content.count_elements(p, "a").orderBy("page_id").collect() == [(0, 2), (1, 0)]
    assert [r["value"] for r in extract.extract_attr(p, "a", "class").orderBy("pos").collect()] == ["x y", "x"]


def test_large_har_keys_are_split_by_seq(spark):
    from webloom.sources import readers

    rows = [(s, "hot" if s % 4 else "cold" if s % 8 else None, f"http://h/{s}", "GET") for s in range(-20, 60)]
    docs = readers.har_documents(spark.createDataFrame(rows, "seq BIGINT, page STRING, url STRING, method STRING"), "page", most=16).cache()
    entries = [(r["page"], r["part"], r["entry_no"], r["url"]) for r in readers.har_entries(docs).collect()]
    for key in ("hot", "cold", None):
        mine = sorted(e[1:] for e in entries if e[0] == key)
        assert [u for _, _, u in mine] == [u for _, k, u, _ in rows if k == key]
        assert {p for p, _, _ in mine} == ({-2, -1, 0, 1, 2, 3} if key == "hot" else {0}) and max(n for _, n, _ in mine) < 16
    assert docs.count() == 8
