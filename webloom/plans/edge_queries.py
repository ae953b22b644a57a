"""Constructs that ordinary pages seldom hold, written from the star tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions.intervals import enclosing, nearest
from webloom.functions.selectors import predicate
from webloom.operators import aria, audit, content, dom, extract, forms, netlog, recon, tables
from webloom.plans import fixtures as fx
from webloom.plans.registry import query, table
from webloom.session import checkpointed, dealt, shared_folder
from webloom.sources import readers, sinks


def _parts(spark: SparkSession, sf_dir: str, html: str, url: str = "'http://h.example/x/y'") -> DataFrame:
    return dealt(table(spark, sf_dir, "part")).selectExpr("p_partkey AS page_id", f"{url} AS url", f"{html} AS html")


@query("edge_titles", """
SELECT p_partkey AS page_id, p_name || ' < ' || p_size || ' <b>x</b>' AS title FROM part""")
def edge_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, "concat('<html><title\\n id=t>', p_name, ' < ', p_size, ' <b>x</b></title><body>z')")
    return dom.with_tokens(pages).select("page_id", F.expr(H.title("toks")).alias("title"))


@query("edge_raw_text", """
SELECT p_partkey AS page_id, 'textarea' AS tag, '<p>' || p_name || '</p>&' AS text FROM part
UNION ALL SELECT p_partkey, 'p', p_brand FROM part""")
def edge_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, "concat('<textarea><p>', p_name, '</p>&amp;</textarea><p>', p_brand, '</p><script>var a = \\'<p>no</p>')")
    return dom.select(dom.dom(pages), "p, textarea", {"tag": "x.tag", "text": dom.text()}).select("page_id", "tag", "text")


@query("edge_custom_elements", """
SELECT p_partkey AS page_id, unnest([p_name, p_brand, p_type]) AS text FROM part""")
def edge_custom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, "concat('<bodyx>q</bodyx><script-x><p>', p_name, '</p></script-x><p>', p_brand, '</p><script>1</script><p>', p_type)")
    return dom.select(dom.dom(pages), "p", {"text": dom.text()}).select("page_id", "text")


@query("edge_deep_nesting_all", """
SELECT p_partkey AS page_id, p_name AS text, CAST(1 AS BIGINT) AS direct, CAST(1 AS BIGINT) AS outer FROM part""")
def edge_deep_nesting_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(_parts(spark, sf_dir, "concat('<section>', repeat('<div>', 520), '<p>', p_name)"))
    counts = {"direct": dom.count_of("div > p"), "outer": dom.count_of("section p")}
    return doc.select("page_id", dom.doc_expr(dom.first_of("p", dom.text())).alias("text"), *[dom.doc_expr(e).alias(n) for n, e in counts.items()])


@query("edge_deep_ancestors", """
SELECT p_partkey AS page_id, p_name AS text, CAST(300 AS INT) AS section_pos, CAST(601 AS INT) AS depth, CAST(1 AS BIGINT) AS under_section, CAST(1 AS BIGINT) AS under_id FROM part""")
def edge_deep_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ancestor in the middle of 600 levels, asked on every row of part."""
    html = "concat(repeat('<div>', 300), '<section id=\"s', p_partkey, '\">', repeat('<div>', 300), '<p>', p_name)"
    # matches and counts of one parse, written; ``place`` tells pages apart
    doc = dom.dom(_parts(spark, sf_dir, html).withColumn("place", F.monotonically_increasing_id()))
    near = "get(els, " + nearest("x.i", enclosing(predicate("section", "a"))) + ")"
    counts = {"under_section": dom.count_of("div > section p"), "under_id": dom.count_of("[id^=s] p")}
    doc = doc.withColumns({n: dom.doc_expr(e) for n, e in counts.items()})
    rows = checkpointed(dom.select(doc, "section p", {"text": dom.text(), "section_pos": f"{near}.s", "depth": "x.d"}, keep=("page_id", "place", *counts), outer=True))
    found = rows.where("pos IS NOT NULL").select("page_id", "text", "section_pos", "depth")
    counted = rows.dropDuplicates(["place"]).select("page_id", *counts)
    return found.join(counted, "page_id").select("page_id", "text", "section_pos", "depth", "under_section", "under_id")


@query("edge_attributes", """
SELECT p_partkey AS page_id, 'it''s' AS alt, 'a>b ' || p_size AS title, 'a&copy=1' AS href FROM part""")
def edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, """concat("<a alt=it's title='a>b ", p_size, "' href=a&copy=1 disabled>t</a>")""")
    return dom.select(dom.dom(pages), "a", {n: dom.attr(n) for n in ("alt", "title", "href")}).select("page_id", "alt", "title", "href")


@query("nth_child_fields", """
SELECT p_partkey AS page_id, unnest(['name', 'brand', 'size']) AS "na`me", unnest([trim(p_name), p_brand, CAST(p_size AS VARCHAR)]) AS value FROM part""")
def nth_child_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "<tr><td>name</td><td>', p_name, '</td></tr><tr><td>brand<td data-x=\"a,b\">', p_brand, '<tr><td>size<td>', p_size, '</table>"
    pages = _parts(spark, sf_dir, f"concat('<table>{rows}')")
    fields = {"na`me": "td:nth-child(1)", "value": "i[title='a,b'], td[data-x='a,b'], td:nth-child(2)"}
    return tables.extract_records(pages, "tr", fields).drop("pos")


@query("nth_child_places", """
SELECT p_partkey AS page_id, unnest(['1', '3', '5', '1', '2', '1', '4', '5']) AS text, unnest(['odd', 'odd', 'odd', 'to2', 'to2', 'first', '3n+1', 'last']) AS rule FROM part
EXCEPT ALL SELECT p_partkey, '5', 'last' FROM part UNION ALL SELECT p_partkey, '1', '3n+1' FROM part""")
def nth_child_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(_parts(spark, sf_dir, "'<ul><li>1<li>2<li>3</li><li>4<li>5</ul>'"))
    rules = {"odd": "li:nth-child(odd)", "to2": "ul > li:nth-child(-n+2)", "first": "li:first-child", "3n+1": "li:nth-child(3n + 1)"}
    rows = [dom.select(doc, s, {"text": dom.text()}).select("page_id", "text", F.lit(n).alias("rule")) for n, s in rules.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("edge_entities", """
SELECT p_partkey AS page_id, '© 2024 ' || p_name || ' ≠ [ – ' || chr(65533) || ' ¬it; & <' AS text FROM part""")
def edge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, "concat('&copy 2024 ', p_name, ' &NotEqual; &lbrack; &#150; &#0; &notit; &AMP; &lt')")
    return pages.select("page_id", F.expr(T.decode_entities("html")).alias("text"))


@query("edge_urls", """
SELECT p_partkey AS page_id, unnest(['http://h.example/a//' || p_size, 'http://h.example/x/b', 'http://h.example/x/c/d', 'http://h.example/web/http://o/' || p_size]) AS href FROM part
UNION ALL SELECT -p_partkey, unnest(['/a//' || p_size, 'b', 'c//d', '/web/http://o/' || p_size]) FROM part""")
def edge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "concat('<a href=\"/a//', p_size, '\">1</a><a href=\" b \">2</a><a href=\"c//d\">3</a><a href=\"/web/http://o/', p_size, '\">4</a>')"
    mail = _parts(spark, sf_dir, html, "'mailto:x@h.example'").withColumn("page_id", -F.col("page_id"))
    return extract.link_targets(_parts(spark, sf_dir, html).unionByName(mail)).select("page_id", "href")


@query("path_query_rooted", """
SELECT p_partkey AS page_id, p_brand AS result FROM part""")
def path_query_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(_parts(spark, sf_dir, "concat('<div><section><div><p>', p_name, '</p></div></section><p>', p_brand, '</p></div>')"))
    return dom.path_query(doc, [("/", "div"), ("/", "p")], as_text=True).select("page_id", "result")


@query("regex_named_groups", """
SELECT p_partkey AS page_id, CAST(p_size AS VARCHAR) AS y, p_brand AS b FROM part""")
def regex_named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, "concat('<body>', p_size, 'x', p_size, '|', p_brand, '|')")
    out = extract.extract_regex(pages, r"(?P<size>\b\d+)x(?P=size)\|(?P<brand_name>[^|\[]+)\|")
    return out.select("page_id", F.col("groups")[0].alias("y"), F.col("groups")[1].alias("b"))


LONG_PAGE = (
    "concat('<form id=f>', array_join(transform(sequence(1, 10), k -> concat('<input name=n', k, '>')), ''), '</form>', "
    "array_join(transform(sequence(1, 25), k -> concat('<h2>', k, ' ', repeat(p_name, 5), '</h2>')), ''), "
    "array_join(transform(sequence(1, 60), k -> concat('<a href=/', k, '>', k, '</a>')), ''))"
)


@query("recon_everything", """
SELECT p_partkey AS page_id, CAST(25 AS BIGINT) AS headings, CAST(10 AS BIGINT) AS fields, CAST(length('25 ' || trim(repeat(p_name, 5))) AS BIGINT) AS longest FROM part""")
def recon_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_sizes(recon.recon(_parts(spark, sf_dir, LONG_PAGE)))


@query("recon_limits", """
SELECT p_partkey AS page_id, CAST(20 AS BIGINT) AS headings, CAST(8 AS BIGINT) AS fields, CAST(least(120, length('20 ' || trim(repeat(p_name, 5)))) AS BIGINT) AS longest FROM part""")
def recon_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_sizes(recon.recon(_parts(spark, sf_dir, LONG_PAGE), max_fields=8, max_headings=20, heading_length=120))


def _recon_sizes(df: DataFrame) -> DataFrame:
    longest = F.array_max(F.transform("headings", lambda h: F.length(h["text"])))
    return df.select("page_id", F.size("headings").cast("bigint").alias("headings"), F.size(F.col("forms")[0]["field_names"]).cast("bigint").alias("fields"), longest.cast("bigint").alias("longest"))


@query("links_checked_in_full", """
SELECT p_partkey AS page_id, CAST(60 AS BIGINT) AS total_links, CAST(60 AS BIGINT) AS checked, CAST(59 AS BIGINT) AS broken FROM part""")
def links_checked_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = spark.createDataFrame([("http://h.example/7", 200)], "url STRING, status INT")
    return audit.broken_link_summary(_parts(spark, sf_dir, LONG_PAGE), status)


@query("dates_found", """
SELECT p_partkey AS page_id, p_partkey % 4 <> 3 AS dated FROM part""")
def dates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE p_partkey % 4 WHEN 0 THEN 'Posted January 5, 2024' WHEN 1 THEN '5 Mar 2021 news' WHEN 2 THEN '2020-01-31' ELSE 'May be 12 20245' END"
    return dealt(table(spark, sf_dir, "part")).selectExpr("p_partkey AS page_id", f"{T.has_date(text)} AS dated")


@query("har_documents", """
SELECT CAST(page_no AS BIGINT) AS page_no, count(*) AS entries, min(url) AS first_url, max(url) AS last_url FROM (
  SELECT o_custkey % 7 AS page_no, 'http://h/' || o_orderkey AS url FROM orders) GROUP BY 1""")
def har_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sent = orders.selectExpr("o_orderkey AS seq", "o_custkey AS customer", "concat('http://h/', o_orderkey) AS url", "'GET' AS method", "map('a', 'b') AS headers")
    got = orders.selectExpr("o_orderkey AS seq", "o_orderkey AS ts", "concat('http://h/', o_orderkey) AS url", "200 AS status", "'OK' AS status_text", "map('c', 'd') AS headers")
    entries = readers.har_entries(readers.har_documents(netlog.har_join(sent, got), "customer"))
    whole = entries.where("status = 200 AND response_headers['c'] = 'd' AND headers['a'] = 'b'")
    return whole.groupBy((F.col("customer") % 7).cast("bigint").alias("page_no")).agg(F.count("*").alias("entries"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


@query("har_round_trip", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS session, 'https://api.example.com/' || event_type || '/' || event_id AS url, props, value, user_id, event_type FROM events)
SELECT session, CASE WHEN session = 'hot' AND (SELECT count(*) FROM e WHERE session = 'hot') > 500 THEN event_id // 500 ELSE 0 END AS part,
  row_number() OVER (PARTITION BY session, CASE WHEN session = 'hot' AND (SELECT count(*) FROM e WHERE session = 'hot') > 500 THEN event_id // 500 ELSE 0 END ORDER BY event_id) - 1 AS entry_no,
  url, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, CAST(user_id AS VARCHAR) AS user, props AS post_data, value AS ts,
  CASE WHEN event_type <> 'view' THEN 200 + event_id % 5 END AS status, CASE WHEN event_type <> 'view' THEN 'OK "' || event_id || '"' END AS status_text,
  CASE WHEN event_type <> 'view' THEN props END AS etag FROM e""")
def har_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its place, headers, body and response; the session with a third of all entries is cut into parts."""
    answered = "event_type <> 'view'"
    sent = table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "IF(event_id % 3 = 0, 'hot', concat('u', user_id)) AS session", "concat('https://api.example.com/', event_type, '/', event_id) AS url",
        "IF(event_type = 'purchase', 'POST', 'GET') AS method", "map('x-user', CAST(user_id AS STRING), 'a', 'b') AS headers", "props AS post_data", "value AS ts",
        f"IF({answered}, CAST(200 + event_id % 5 AS INT), NULL) AS status", f"IF({answered}, concat('OK \"', event_id, '\"'), NULL) AS status_text",
        f"IF({answered}, map('etag', props), NULL) AS response_headers",
    )
    out = readers.har_entries(readers.har_documents(sent, "session", most=500))
    entry = F.col("entry_no").cast("bigint").alias("entry_no")
    return out.select("session", "part", entry, "url", "method", F.expr("headers['x-user']").alias("user"), "post_data", "ts", "status", "status_text", F.expr("response_headers['etag']").alias("etag"))


MIXED = """WITH m AS (SELECT p_partkey AS page_id, p_partkey % 5 <> 0 AS is_https, 1 + CAST(p_partkey % 4 = 0 AS BIGINT) AS n FROM part)"""


@query("mixed_content_found", MIXED + """
SELECT page_id, is_https, CASE WHEN is_https THEN n END AS count, CASE WHEN is_https THEN true END AS has_mixed_content FROM m""")
def mixed_content_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.mixed_content(fx.media_pages(spark, sf_dir)).drop("resources")


@query("a11y_counts", """
SELECT p_partkey AS page_id, CAST(3 + p_partkey % 2 AS BIGINT) AS total_issues, CAST(p_partkey % 2 AS BIGINT) AS missing_alt, CAST(1 AS BIGINT) AS missing_label, CAST(0 AS BIGINT) AS heading_skip,
  CAST(1 AS BIGINT) AS button_no_name, CAST(1 AS BIGINT) AS empty_link, p_size % 2 = 0 AS has_main, p_size % 3 = 0 AS has_nav FROM part""")
def a11y_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = (
        "concat('<img src=x', IF(p_partkey % 2 = 0, ' alt=y', ''), '><input name=q><label>n <input></label><button></button><a>t</a>', "
        "IF(p_size % 2 = 0, '<main></main>', ''), IF(p_size % 3 = 0, '<nav></nav>', ''))"
    )
    return audit.a11y_summary(_parts(spark, sf_dir, html))


@query("count_elements_some", """
SELECT p_partkey AS page_id, CAST(p_size % 4 AS BIGINT) AS n FROM part""")
def count_elements_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.count_elements(_parts(spark, sf_dir, "concat('<p>a</p>', repeat('<table><tr><td>1</table>', CAST(p_size % 4 AS INT)))"), "table")


@query("export_images_whole", """
SELECT p_partkey AS page_id, 'http://h.example/i/' || p_partkey || '.png' AS src, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS alt FROM part""")
def export_images_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    pages = _parts(spark, sf_dir, "concat('<img src=\"/i/', p_partkey, '.png\"', IF(p_partkey % 2 = 0, concat(' alt=\"', p_name, '\"'), ''), '>')")
    sinks.write_export(pages, "images", folder)
    return spark.read.schema("page_id BIGINT, src STRING, alt STRING").json(folder)


@query("documents_as_text", """
SELECT p_partkey AS page_id, '# ' || trim(p_name) AS first_line FROM part""")
def documents_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    pages = _parts(spark, sf_dir, "concat('<h1>', p_name, '</h1><p>', p_partkey, '</p>')")
    sinks.write_documents(content.html_to_markdown(pages), folder, "text")
    read = spark.read.text(folder, lineSep="\n\f\n").select(F.split("value", "\n\n").alias("p"))
    return read.select(F.col("p")[1].cast("bigint").alias("page_id"), F.col("p")[0].alias("first_line"))


@query("form_fields_named", """
SELECT p_partkey AS page_id, unnest(['a' || p_size, 'b', 'c']) AS name, unnest(['text', 'textarea', 'select']) AS tag FROM part""")
def form_fields_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "concat('<form id=f><input name=a', p_size, '><textarea name=b><i>x</i></textarea><select name=c><option>1</select></form>')"
    out = forms.extract_forms(_parts(spark, sf_dir, html)).select("page_id", F.explode("fields").alias("f"))
    return out.select("page_id", "f.name", F.when(F.col("f.name").startswith("a"), "text").when(F.col("f.name") == "b", "textarea").otherwise("select").alias("tag"))


@query("actions_in_order", """
SELECT event_id AS seq, row_number() OVER (ORDER BY ts, event_id) AS place FROM events""")
def actions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.actions(spark, sf_dir).select("seq", "ts", "event_type")
    merged = netlog.merged_actions(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"))
    # places from the order of the partitions, checked against the order of the times
    placed = merged.select("seq", F.monotonically_increasing_id().alias("id"))
    counts = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n"))
    before = counts.join(counts.select(F.col("part").alias("p_"), F.col("n").alias("m_")), F.col("p_") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m_"), F.lit(0)).alias("before"))
    out = placed.withColumn("part", F.shiftright("id", 33)).join(before, "part")
    return out.select("seq", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@query("aria_text_fallback", """
SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'listitem' WHEN 1 THEN 'row' ELSE 'generic' END AS container_used, CAST(1 AS BIGINT) AS n FROM part""")
def aria_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "concat('- main:\\n  - ', CASE p_partkey % 3 WHEN 0 THEN 'listitem' WHEN 1 THEN 'row' ELSE 'generic' END, "
        "':\\n    - heading \"', p_name, '\"\\n    - link \"x\"\\n  - generic:\\n    - text: no')"
    )
    snapshots = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{text} AS snapshot")
    return aria.container_blocks(snapshots).groupBy("page_id", "container_used").agg(F.count("*").alias("n"))
