"""HTML, XML and logs written from the star tables, so that extraction can be checked against the tables.

Every document comes from one source row, so nothing is grouped and a very frequent key makes no large document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.plans.registry import table
from webloom.session import dealt

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def esc(expr: str) -> str:
    return f"replace(replace(replace({expr}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


def _pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return dealt(df).selectExpr(f"CAST({key} AS BIGINT) AS page_id", f"{url} AS url", f"{html} AS html")


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes as a field/value table; every second page leaves out all optional end tags."""
    closed = (
        "concat('<table class=\"data\"><tr><th>field</th><th>value</th></tr>"
        "<tr><td>name</td><td> ', {n}, ' </td></tr><tr><td>brand</td><td>', p_brand, '</td></tr>"
        "<tr><td>type</td><td>', p_type, '</td></tr><tr><td>size</td><td>', p_size, '</td></tr></table>')"
    )
    loose = (
        "concat('<TABLE class=data><TR><TH>field<TH>value<TR><TD>name<TD>', {n}, '<TR><TD>brand<TD>', p_brand, "
        "'<TR><TD>type<TD>', p_type, '<TR><TD>size<TD>', p_size, '</TABLE>')"
    )
    name = esc("p_name")
    html = (
        "concat('<html><body><h1>Part</h1>', "
        f"IF(p_partkey % 2 = 0, {closed.format(n=name)}, {loose.format(n=name)}), '<table><tr><td>only</td></tr></table></body></html>')"
    )
    return _pages(table(spark, sf_dir, "part"), "p_partkey", "concat('https://shop.example.com/part/', p_partkey)", html)


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two articles per part: a full one, and one whose only text is a fallback field."""
    html = (
        f"concat('<html><body><main><article class=\"card\" id=\"a', p_partkey, '\"><h2><a href=\"/p/', p_partkey, '\">', {esc('p_name')}, "
        "'</a></h2><p>', p_type, '</p><span class=\"price\">', p_size, '</span></article>"
        "<article class=\"card\"><h2> </h2><div><span class=\"alt\">', p_brand, '</span></div></article></main>"
        "<article><p>other</p></article></body></html>')"
    )
    return _pages(table(spark, sf_dir, "part"), "p_partkey", "concat('https://shop.example.com/list/', p_partkey)", html)


def head_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, meta tags, canonical links, JSON-LD (every third one broken) and microdata from customers."""
    html = (
        "concat('<html><head><title> ', c_name, ' &amp;  Co</title><meta name=\"description\" content=\"', c_mktsegment, "
        "'\"><meta name=description content=\"', c_mktsegment, ' customer of nation number ', c_nationkey, ' in the long list of customers\">"
        "<meta property=\"og:title\" content=\"', c_name, '\"><meta name=\"\" itemprop=\"rank\" content=\"', c_nationkey, '\">"
        "<meta name=\"twitter:card\" content=\"summary\"><meta name=\"empty\" content=\"\">', "
        "IF(c_custkey % 2 = 0, concat('<link rel=\"canonical\" href=\"/c/', c_custkey, '\">'), ''), "
        "'<script type=\"application/ld+json\">{\"@type\":\"Person\",\"name\":\"', c_name, '\"', IF(c_custkey % 3 = 0, '', '}'), '</script>"
        "<script type=\"application/ld+json\">', IF(c_custkey % 5 = 0, 'null', concat('{\"id\":', c_custkey, '}')), '</script></head><body>"
        "<div itemscope itemtype=\"https://schema.org/Person\"><span itemprop=\"name\">', c_name, '</span>"
        "<div itemprop=\"address\" itemscope><b itemprop=\"segment\">', c_mktsegment, '</b></div><meta itemprop=\"nation\" content=\"', c_nationkey, '\"></div>', "
        "repeat('<h1>Hello</h1>', CAST(c_custkey % 3 AS INT)), '</body></html>')"
    )
    return _pages(table(spark, sf_dir, "customer"), "c_custkey", "concat('https://crm.example.com/customer/', c_custkey, '?v=1')", html)


def color(seed: str) -> str:
    return f"concat('rgb(', ({seed} * 37) % 256, ', ', ({seed} * 91) % 256, ', ', ({seed} * 53) % 256, ')')"


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with and without alt text, http resources, frames, inline styles and font faces from parts."""
    html = (
        "concat('<html><head><style>@font-face{font-family:\"F', p_size, '\";src:url(f', p_size, '.woff);font-weight:700;font-style:normal}</style>"
        "<link rel=\"stylesheet\" href=\"', IF(p_partkey % 4 = 0, 'http', 'https'), '://cdn.example.com/a.css\"></head><body>"
        "<img src=\"/img/', p_partkey, '.png\" width=\"', p_size, '\" height=\"10\"', IF(p_partkey % 2 = 0, concat(' alt=\"', p_name, '\"'), ''), '>"
        "<img src=\"http://cdn.example.com/', p_partkey, '.jpg\" alt=\"\" loading=\"lazy\" aria-label=\"x\"><img alt=\"none\"><img src=\"data:image/png;base64,AA\" alt=\"d\">"
        "<iframe src=\"/frame/', p_partkey, '\" id=\"', IF(p_partkey % 3 = 0, concat('f', p_partkey), ''), '\"></iframe><iframe name=\"n', p_size, '\"></iframe><iframe></iframe>"
        f"<div class=\"box\" style=\"color: ', {color('p_partkey')}, '; background-color:', {color('(p_partkey + 7)')}, ';font-family: Arial, F', p_size, '; color\">"
        "', p_name, '</div><button></button><a>no target</a></body></html>')"
    )
    url = "concat(IF(p_partkey % 5 = 0, 'http', 'https'), '://media.example.com/m/', p_partkey)"
    return _pages(table(spark, sf_dir, "part"), "p_partkey", url, html)


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form, a role=form and stray inputs per customer."""
    html = (
        "concat('<html><body><form id=\"f', c_custkey, '\" action=\"/save\" method=\"POST\"><label for=\"e', c_custkey, '\">Your E-mail</label>"
        "<input type=\"email\" id=\"e', c_custkey, '\" name=\"mail\" value=\"', c_custkey, '@example.com\" required>"
        "<label>Note <textarea name=\"note\">', c_mktsegment, '</textarea></label>"
        "<select name=\"nation\"><option value=\"0\">zero<option value=\"', c_nationkey, '\" selected>nation ', c_nationkey, '</select>"
        "<input type=\"hidden\" name=\"token\" value=\"t\"></form>"
        "<div role=\"form\" aria-label=\"search\"><input name=\"q\" placeholder=\"Find things\"></div>"
        "<x-box><div><span><input name=\"a\"></span><input name=\"b\" aria-label=\"B\"></div></x-box><div><p><input type=\"checkbox\" name=\"c\"></p></div>"
        "<button></button><button aria-label=\"ok\"></button><div role=\"button\">Go</div></body></html>')"
    )
    return _pages(table(spark, sf_dir, "customer"), "c_custkey", "concat('https://crm.example.com/form/', c_custkey)", html)


SITE = "https://site.example.com"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host: customer c links to customers 8c+1 to 8c+8, back to its parent and to the start, and off the site."""
    links = "array_join(transform(sequence(1, 8), k -> concat('<li><a href=\"', IF(k % 2 = 0, concat('/c/', 8 * c_custkey + k), concat('../c/', 8 * c_custkey + k)), '\">next</a></li>')), '')"
    html = (
        f"concat('<html><head><title>', c_name, '</title></head><body><h1>', c_mktsegment, '</h1><ul>', {links}, '</ul>"
        "<a href=\"/c/', c_custkey DIV 8, '\">up</a><a href=\"/c/0\">home</a><a href=\"https://other.example.org/x\">off</a>"
        "<a href=\"mailto:a@example.com\">mail</a><a href=\"javascript:void(0)\">js</a><a href=\"/private/', c_custkey, '\">private</a></body></html>')"
    )
    return _pages(table(spark, sf_dir, "customer"), "c_custkey", f"concat('{SITE}/c/', c_custkey)", html)


def chain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in chains of 12 pages: each links to the next, the last of every second chain has a disabled link."""
    link = (
        "CASE WHEN o_orderkey % 12 < 11 THEN concat('<a class=\"next\" href=\"/o/', o_orderkey + 1, '\">next</a>') "
        "WHEN o_orderkey % 24 < 12 THEN concat('<a class=\"next disabled\" href=\"/o/', o_orderkey + 1, '\">next</a>') ELSE '' END"
    )
    html = f"concat('<html><body', IF(o_orderkey % 12 = 0, ' class=\"first\"', ''), '><ul><li>', o_orderstatus, '</li><li>', o_orderpriority, '</li><li> </li></ul>', {link}, '</body></html>')"
    return _pages(table(spark, sf_dir, "orders"), "o_orderkey", "concat('https://orders.example.com/o/', o_orderkey)", html)


def day(ts: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd')"


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, xml): one sitemap per order, every tenth an index, every hundredth broken."""
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    xml = (
        f"CASE WHEN o_orderkey % 100 = 99 THEN '<urlset><url>' WHEN o_orderkey % 10 = 0 THEN concat('<?xml version=\"1.0\"?><sitemapindex {ns}><sitemap><loc>https://s.example.com/', o_orderkey, '.xml</loc></sitemap></sitemapindex>') "
        f"ELSE concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?><urlset {ns}><url><loc>https://s.example.com/', o_orderkey, '</loc><lastmod>', {day('o_orderdate')}, '</lastmod>"
        "<priority>0.', o_orderkey % 10, '</priority></url><url><loc>https://s.example.com/', o_orderkey, '/b</loc><changefreq>daily</changefreq></url></urlset>') END"
    )
    return table(spark, sf_dir, "orders").selectExpr("concat('https://s.example.com/map/', o_orderkey) AS url", "200 AS status", f"{xml} AS xml")


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, xml): an RSS or Atom feed with two entries per order."""
    rss = (
        "concat('<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>Orders ', o_orderkey, '</title><link>https://f.example.com/', o_orderkey, "
        "'</link><description>about ', o_orderstatus, '</description><item><title>', o_orderpriority, '</title><link>https://f.example.com/i/', o_orderkey, '</link><description>a &amp;amp; b</description><pubDate>', "
        f"{day('o_orderdate')}, '</pubDate><guid isPermaLink=\"false\">', o_orderkey, '</guid></item><item><title>second</title></item></channel></rss>')"
    )
    atom = (
        "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>Orders ', o_orderkey, '</title><link href=\"https://f.example.com/', o_orderkey, "
        "'\"/><entry><title type=\"text\">', o_orderpriority, '</title><link href=\"https://f.example.com/i/', o_orderkey, '\"/><id>', o_orderkey, "
        f"'</id><published>', {day('o_orderdate')}, '</published><summary>', o_orderstatus, '</summary></entry><entry><id>x</id></entry></feed>')"
    )
    return table(spark, sf_dir, "orders").selectExpr("concat('https://f.example.com/', o_orderkey) AS url", f"IF(o_orderkey % 2 = 0, {rss}, {atom}) AS xml")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us``, the time in microseconds, and ``k`` from the JSON properties."""
    return table(spark, sf_dir, "events").selectExpr(
        "*", f"timestampdiff(MICROSECOND, {EPOCH}, ts) AS us", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "us", "ts", "event_id AS seq", "concat('https://app.example.com/u/', user_id) AS page_url",
        "concat('https://api.example.com/', event_type, '/', user_id) AS url",
        "IF(event_type IN ('click', 'view'), 'GET', 'POST') AS method",
        "map('accept', event_type, 'x-user', CAST(user_id AS STRING)) AS headers", "props AS post_data",
        "CASE event_type WHEN 'click' THEN 'fetch' WHEN 'view' THEN 'img' WHEN 'error' THEN '' ELSE 'script' END AS initiator_type",
        "CAST(floor(value) AS BIGINT) AS transfer_size", "us DIV 86400000000 AS bucket",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = (
        "map('Content-Security-Policy', IF(user_id % 2 = 0, 'default-src', ''), IF(user_id % 3 = 0, 'X-Frame-Options', 'X-Other'), 'DENY', "
        "IF(user_id % 5 = 0, 'strict-transport-security', 'server'), 'max-age=1')"
    )
    return _events(spark, sf_dir).selectExpr(
        "us AS ts", "event_id AS seq", "concat('https://api.example.com/', event_type, '/', user_id) AS url",
        "IF(event_type = 'error', 500, 200) AS status", "IF(event_type = 'error', 'Server Error', concat('OK ', event_id)) AS status_text",
        f"{headers} AS headers", "IF(event_id % 4 = 0, concat('plain ', k), props) AS body",
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "CAST(floor(value) AS BIGINT)"
    return _events(spark, sf_dir).selectExpr(
        "event_id", "concat('https://app.example.com/e/', event_id) AS page_url", "us DIV 1000 AS navigation_start",
        "us DIV 1000 + 5 AS request_start", f"us DIV 1000 + 5 + {v} * 10 AS response_start", f"us DIV 1000 + 100 + {v} * 20 AS dom_interactive",
        f"us DIV 1000 + 120 + {v} * 20 AS dcl_end", f"us DIV 1000 + 200 + {v} * 50 AS load_end", "IF(event_type = 'error', NULL, value) AS fcp",
        "CASE WHEN event_id % 3 = 0 THEN CAST(array() AS array<struct<render_time: double, load_time: double>>) "
        "ELSE array(struct(1.0D AS render_time, 1.0D AS load_time), struct(IF(event_id % 3 = 1, 0.0D, value) AS render_time, value + 1 AS load_time)) END AS lcp",
        f"{v} AS transfer_size",
    )


def ws_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "ts", "us", "concat('wss://live.example.com/', user_id) AS url",
        "CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'sent' WHEN 'signup' THEN 'opened' WHEN 'error' THEN 'error' ELSE 'closed' END AS type",
        "repeat(props, 30) AS payload", "event_id",
    )


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id AS seq", "ts", "concat('s', user_id) AS store", "IF(event_type = 'signup', 'clear', 'set') AS op",
        "concat('k', k % 10) AS key", "CAST(value AS STRING) AS value", "event_type", "k", "user_id",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "CAST(user_id AS STRING) AS session_id", "event_id AS seq", "us AS ts_us", "CAST(us DIV 1000 AS DOUBLE) AS ts", "us DIV 86400000000 AS bucket",
        "CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'input' ELSE 'keypress' END AS type",
        "CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN k % 4 = 0 THEN 'Enter' WHEN k % 4 = 1 THEN 'Shift' ELSE 'a' END AS key",
        "concat('https://app.example.com/', event_type, '/', k) AS url", "event_type",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tries per event, the first ones failing by rule."""
    return _events(spark, sf_dir).selectExpr("event_id AS job_id", "event_type", "k", "explode(sequence(1, 5)) AS attempt").selectExpr(
        "job_id", "attempt", "attempt > k % 6 AND event_type <> 'error' AS ok", "concat('out ', attempt, '/', k) AS output", "concat('failed ', attempt) AS error"
    )


def scroll_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round per day and user; what a user saw that day are the items."""
    return _events(spark, sf_dir).selectExpr(
        "user_id AS stream_id", "CAST(us DIV 86400000000 - 19722 AS INT) AS round", "event_id AS pos", "concat(event_type, k % 12) AS item"
    )


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, emphasis, links, images, nested and numbered lists per part."""
    html = (
        f"concat('<html><head><title>t</title></head><body><nav><a href=\"/n\">n</a></nav><main><h2>', {esc('p_name')}, '</h2><p>A  <b>', p_brand, "
        "'</b>\\n<em>of</em> <a href=\"/p/', p_partkey, '\">type</a> ', p_type, '<br>next<p>second<ul><li>one<li>two<ul><li>deep</ul></ul><ol><li>first<li>', p_size, "
        "'</ol><img src=\"/i.png\" alt=\"pic\"><p>', repeat('word ', 60), '</p></main><script>var x = 1;</script></body></html>')"
    )
    return _pages(table(spark, sf_dir, "part"), "p_partkey", "concat('https://shop.example.com/article/', p_partkey)", html)


def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three headings per customer, their levels from the key."""
    html = (
        "concat('<h', c_custkey % 6 + 1, '>', c_name, '</h', c_custkey % 6 + 1, '><div><h', c_custkey % 4 + 1, '>b</h', c_custkey % 4 + 1, "
        "'></div><h', c_custkey % 5 + 1, '>', c_mktsegment, '</h', c_custkey % 5 + 1, '>')"
    )
    return _pages(table(spark, sf_dir, "customer"), "c_custkey", "'https://crm.example.com/h'", html)


def folded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed elements inside and outside navigation, as many as the key says."""
    html = (
        "concat('<main>', repeat('long text ', 30), repeat('<details><summary>s</summary>x</details>', CAST(c_custkey % 3 AS INT)), "
        "'<details open><summary>o</summary></details><div aria-expanded=\"false\">d</div><a aria-expanded=\"false\">a</a>"
        "<nav><button aria-controls=\"m\" aria-expanded=\"false\">menu</button><p class=\"collapsed\">n</p></nav>"
        "<button aria-controls=\"p\" aria-expanded=\"', IF(c_custkey % 2 = 0, 'false', 'true'), '\">p</button>"
        "<div class=\"x collapsible\">c</div><div class=\"collapsible active\">c</div><button>Show more</button><button>please read more</button>"
        "<a href=\"/x\"><button>load more</button></a><button>showing more</button></main><details><summary>outside</summary></details>')"
    )
    return _pages(table(spark, sf_dir, "customer"), "c_custkey", "'https://crm.example.com/f'", html)


def aria_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, snapshot): accessibility text with a full record, a nested one and lines that belong to none."""
    snapshot = (
        "concat('- main:\\n  - article:\\n    - heading \"', p_name, '\" [level=2]\\n    - link \"/p/', p_partkey, '\"\\n    - paragraph: A long description of part ', p_partkey, "
        "' that goes on for a while\\n\\n    - text: Star\\n    - text: Python\\n    - link \"', p_size, ' stars\"\\n    - text: Updated on Mar ', p_size % 28 + 1, ', 2024\\n  - contentinfo: end\\n    - text: lost\\n"
        "  - article:\\n    - text: \"', p_size, 'k\"\\n    - article:\\n      - heading \"inner\"\\n      - text: 2 today\\n    - text: \"tail\"')"
    )
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{snapshot} AS snapshot")
