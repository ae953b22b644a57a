"""Queries over the stored pages: tokens, elements, extraction, filters, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.sqltext import lit
from webloom.operators import aria, audit, content, crawl, dom, extract, recon
from webloom.plans.registry import query, table
from webloom.session import spread
from webloom.sources import readers, sinks

# The token pattern as the checking engine spells it, and the token table built with it.
PATTERN = (
    r"""(?si)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|<[!?][^>]*>"""
    r"""|</?[a-z][^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*>|[^<]+|<"""
)
TOKS = f"""toks AS (
  SELECT page_id, url, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '{PATTERN}', 0) AS t FROM pages))"""
DECODE = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
TAG = "lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1))"
LINKS = """links AS (
  SELECT page_id, url, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS n
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>', 0) AS m FROM pages))"""
HREF = "regexp_extract(m, 'href=\"([^\"]*)\"', 1)"
ORIGIN = "regexp_extract(url, '^https?://[^/?#]*', 0)"
ARTICLE_TEXT = "regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')"
BODY_TEXT = DECODE.format("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")
TITLE = DECODE.format("regexp_extract(html, '(?s)<title>([^<]*)</title>', 1)")
TITLE_SQL = f"trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(readers.pages(spark, sf_dir))


@query("links_per_host", f"""
WITH {LINKS}
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, count(*) AS n_links, count(DISTINCT {ORIGIN} || {HREF}) AS n_targets
FROM links GROUP BY 1""")
def links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_targets(pages(spark, sf_dir)).withColumn("host", F.expr(U.netloc("url")))
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query("source_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("dom_tokens", f"""
WITH {TOKS}
SELECT page_id, pos, tok, {TAG} AS tag,
  CASE WHEN tok NOT LIKE '<%' OR tok = '<' THEN 'text' WHEN tok LIKE '<!--%' THEN 'comment' WHEN tok LIKE '<!%' THEN 'decl'
       WHEN tok LIKE '</%' THEN 'close' WHEN tok LIKE '<script%' OR tok LIKE '<style%' OR tok LIKE '<title%' THEN 'raw'
       WHEN {TAG} IN ('br', 'meta', 'img', 'link', 'hr') THEN 'void' ELSE 'open' END AS kind
FROM toks""")
def dom_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.token_table(pages(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query("dom_lossless", "SELECT page_id, length(html) AS n_chars, true AS same FROM pages")
def dom_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("back", F.expr(f"array_join({H.tokens('html')}, '')"))
    return df.select("page_id", F.length("back").cast("bigint").alias("n_chars"), (F.col("back") == F.col("html")).alias("same"))


@query("dom_elements", f"""
WITH {TOKS}, tags AS (SELECT page_id, pos, tok, {TAG} AS tag, tok LIKE '</%' AS closing FROM toks
  WHERE regexp_matches(tok, '^</?[a-zA-Z]')),
 starts AS (SELECT * FROM tags WHERE NOT closing),
 ends AS (SELECT page_id, pos, CASE WHEN closing THEN '/' ELSE '' END || tag AS what FROM tags),
 own AS (SELECT s.page_id, s.pos, s.tag, min(e.pos) AS end_pos FROM starts s LEFT JOIN ends e ON e.page_id = s.page_id AND e.pos > s.pos AND
   CASE WHEN s.tag = 'p' THEN e.what IN ('p', '/p', '/article') WHEN s.tag = 'b' THEN e.what IN ('/b', 'p', '/p', '/article') ELSE e.what = '/' || s.tag END
   GROUP BY ALL)
SELECT page_id, tag, pos AS start_pos, CASE WHEN tag IN ('br', 'meta', 'script', 'style', 'title') THEN pos ELSE coalesce(end_pos, (SELECT count(*) FROM toks t WHERE t.page_id = own.page_id)) END AS end_pos FROM own""")
def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = dom.element_table(pages(spark, sf_dir))
    return els.select("page_id", "tag", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


@query("dom_depth", f"""
WITH {TOKS}
SELECT page_id, count(*) AS n_elements,
  count(*) FILTER (tok LIKE '<a %') AS n_links, count(*) FILTER (tok = '<li>') AS n_items, 0 AS min_depth FROM toks
WHERE regexp_matches(tok, '^<[a-zA-Z]') GROUP BY page_id""")
def dom_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = dom.element_table(pages(spark, sf_dir))
    return els.groupBy("page_id").agg(
        F.count("*").alias("n_elements"),
        F.count_if((F.col("tag") == "a") & (F.col("depth") == 5)).alias("n_links"),
        F.count_if((F.col("tag") == "li") & (F.col("depth") == 4)).alias("n_items"),
        F.min("depth").cast("bigint").alias("min_depth"),
    )


@query("dom_attributes", f"""
WITH {TOKS}, t AS (SELECT page_id, pos, unnest(regexp_extract_all(tok, ' ([a-z]+)="[^"]*"', 1)) AS name, unnest(regexp_extract_all(tok, ' [a-z]+="([^"]*)"', 1)) AS value
  FROM toks WHERE regexp_matches(tok, '^<[a-z]') AND tok NOT LIKE '<script%' AND tok NOT LIKE '<style%')
SELECT page_id, pos AS start_pos, name, {DECODE.format('value')} AS value FROM t""")
def dom_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = dom.element_table(pages(spark, sf_dir))
    rows = els.select("page_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.explode_outer("attrs").alias("name", "value"))
    return rows.where("name IS NOT NULL")


@query("dom_text_content", f"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:h1|li|div class="ad"|footer)>(.*?)</(?:h1|li|div|footer)>', 1)) AS inner_html FROM pages)
SELECT page_id, trim({DECODE.format("regexp_replace(inner_html, '<[^>]*>', '', 'g')")}) AS text FROM h""")
def dom_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(pages(spark, sf_dir), ["h1", "li", "div.ad", "footer"])
    return dom.text_content(doc, "h1, li, div.ad, footer").select("page_id", "text")


@query("dom_select_descendant", f"""
WITH {LINKS} SELECT page_id, {HREF} AS href FROM links""")
def dom_select_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(pages(spark, sf_dir), ["nav > ul li a[href]"])
    return dom.select(doc, "nav > ul li a[href]", {"href": dom.attr("href")}).select("page_id", "href")


@query("dom_nth_child", f"""
WITH {LINKS} SELECT page_id, {DECODE.format("regexp_extract(m, '>([^<]*)<', 1)")} AS text FROM links WHERE n = 1""")
def dom_nth_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.nth_child(dom.dom(pages(spark, sf_dir)), "li", 2).select("page_id", "text")


@query("dom_closest", f"""
WITH {TOKS}, a AS (SELECT page_id, pos, max(pos) FILTER (tok = '<li>') OVER (PARTITION BY page_id ORDER BY pos) AS closest_pos, tok FROM toks)
SELECT page_id, pos, closest_pos FROM a WHERE tok LIKE '<a %'""")
def dom_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dom.closest(dom.dom(pages(spark, sf_dir), ["a", "li"]), "a", "li")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("closest_pos").cast("bigint").alias("closest_pos"))


@query("dom_path_query", f"""
WITH {LINKS} SELECT page_id, {HREF} AS result FROM links""")
def dom_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(pages(spark, sf_dir), ["nav ul li a"])
    return dom.path_query(doc, [("//", "nav"), ("/", "ul"), ("/", "li"), ("//", "a")], attribute="href").select("page_id", "result")


@query("dom_inner_outer_html", """
SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inner_html, regexp_extract(html, '(?s)<nav>.*?</nav>', 0) AS nav_html,
  html AS page_html FROM pages""")
def dom_inner_outer_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(pages(spark, sf_dir), ["article", "nav"])
    inner = dom.first_of("article", H.inner_html("toks", "x"))
    nav = dom.first_of("nav", H.outer_html("toks", "x"))
    return doc.select("page_id", F.expr(inner).alias("inner_html"), F.expr(nav).alias("nav_html"), F.expr("array_join(toks, '')").alias("page_html"))


@query("decode_entities", f"""
SELECT page_id, {DECODE.format("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS footer FROM pages""")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("f", F.regexp_extract("html", "(?s)<footer>(.*?)</footer>", 1))
    return df.select("page_id", F.expr(T.decode_entities("f")).alias("footer"))


P_TEXT = f"""
WITH {TOKS}, s AS (SELECT page_id, pos, tok, sum(CASE WHEN tok = '<p>' THEN 1 ELSE 0 END) OVER w AS p_no,
   max(CASE WHEN tok = '<p>' THEN pos END) OVER w AS p_pos, max(CASE WHEN tok IN ('</p>', '</article>') THEN pos END) OVER w AS end_pos
   FROM toks WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
 p AS (SELECT page_id, p_pos AS pos, string_agg(CASE WHEN tok NOT LIKE '<%' THEN tok ELSE '' END, '' ORDER BY s.pos) AS t
   FROM s WHERE p_pos IS NOT NULL AND (end_pos IS NULL OR end_pos < p_pos) GROUP BY page_id, p_pos)
"""


@query("extract_text_all", P_TEXT + f"SELECT page_id, pos, trim({DECODE.format('t')}) AS text FROM p WHERE trim({DECODE.format('t')}) <> ''")
def extract_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(pages(spark, sf_dir), "article p").withColumn("pos", F.col("pos").cast("bigint"))


@query("extract_text_first", P_TEXT + f"""
SELECT g.page_id, coalesce(trim({DECODE.format('f.t')}), '') AS text FROM pages g LEFT JOIN (
  SELECT page_id, arg_min(t, pos) AS t FROM p GROUP BY page_id) f USING (page_id)""")
def extract_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(pages(spark, sf_dir), "p", all=False)


@query("extract_links", f"""
WITH {LINKS} SELECT page_id, {DECODE.format(HREF)} AS href, trim({DECODE.format("regexp_extract(m, '>([^<]*)<', 1)")}) AS text FROM links WHERE {HREF} <> ''""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_links(pages(spark, sf_dir)).select("page_id", "href", "text")


@query("extract_links_absolute", f"""
WITH {LINKS} SELECT page_id, {ORIGIN} || {DECODE.format(HREF)} AS href FROM links WHERE {HREF} <> ''""")
def extract_links_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_links(pages(spark, sf_dir), absolute=True).select("page_id", "href")


@query("extract_attr", """
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS value FROM pages WHERE regexp_extract(html, '<html lang="([^"]*)"', 1) <> ''""")
def extract_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_attr(pages(spark, sf_dir), "html", "lang").select("page_id", "value")


@query("extract_attr_first", f"""
SELECT page_id, {DECODE.format("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")} AS value FROM pages""")
def extract_attr_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_attr(pages(spark, sf_dir), "a", "href", all=False)


@query("page_info", f"SELECT page_id, url, {TITLE_SQL} AS title FROM pages")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_info(pages(spark, sf_dir))


@query("extract_regex_body", f"""
WITH t AS (SELECT page_id, {BODY_TEXT} AS body FROM pages), m AS (SELECT page_id, regexp_extract_all(body, '(?ms)[A-Z][a-z]+', 0) AS ms FROM t)
SELECT page_id, unnest(ms) AS match, generate_subscripts(ms, 1) - 1 AS match_no FROM m""")
def extract_regex_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_regex(pages(spark, sf_dir), r"[A-Z][a-z]+")
    return out.select("page_id", F.expr("groups[0]").alias("match"), F.col("match_no").cast("bigint").alias("match_no"))


@query("extract_regex_groups", r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?ms)(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}', 1) AS a, regexp_extract_all(text, '(?ms)(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}', 2) AS b FROM documents)
SELECT doc_id, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) - 1 AS match_no FROM m""")
def extract_regex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.regex_matches(table(spark, sf_dir, "documents"), "text", r"(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}", 2, "doc_id")
    return out.select("doc_id", F.expr("groups[0]").alias("a"), F.expr("groups[1]").alias("b"), F.col("match_no").cast("bigint").alias("match_no"))


@query("batch_selectors", f"""
SELECT page_id, 'h1' AS selector, 1 AS n_matches, trim({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS joined FROM pages
UNION ALL SELECT page_id, '.ad', 1, trim({DECODE.format("regexp_extract(html, '(?s)<div class=\"ad\">([^<]*)</div>', 1)")}) FROM pages
UNION ALL SELECT page_id, 'table td', 0, '' FROM pages""")
def batch_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.batch_selectors(pages(spark, sf_dir), ["h1", ".ad", "table td"])
    return out.select("page_id", "selector", F.size("texts").cast("bigint").alias("n_matches"), F.array_join("texts", "|").alias("joined"))


@query("text_range", f"""
SELECT page_id, substr({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, 4, 20) AS text FROM pages""")
def text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_range(pages(spark, sf_dir), "h1", 3, 23)


@query("has_selector", """
SELECT page_id FROM pages WHERE html LIKE '%<div class="ad">%' AND html LIKE '%<article>%<b>%'""")
def has_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.has_selector(content.has_selector(pages(spark, sf_dir), "div.ad"), "article b").select("page_id")


@query("has_text", f"SELECT page_id FROM pages WHERE contains({BODY_TEXT}, ' the ')")
def has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.has_text(pages(spark, sf_dir), " the ").select("page_id")


@query("glob_filter", """
SELECT page_id, url FROM pages WHERE url LIKE 'https://blog.%/en/%' AND NOT regexp_matches(url, '^.*/[0-4][0-9].(\\?.*)?$')""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).select("page_id", "url").where(F.expr(U.glob_match("url", "https://blog.*/en/*")))
    return df.where(~F.expr(U.glob_match("url", "*/[0-4][0-9]?")) & ~F.expr(U.glob_match("url", "*/[0-4][0-9]?[?]*")))


@query("follow_exclude", f"""
WITH {LINKS} SELECT page_id, {ORIGIN} || {DECODE.format(HREF)} AS href FROM links
WHERE {ORIGIN} || {DECODE.format(HREF)} LIKE 'https:%' AND {ORIGIN} || {DECODE.format(HREF)} NOT LIKE '%.' AND {HREF} NOT LIKE 'mailto:%'""")
def follow_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_targets(pages(spark, sf_dir)).where("NOT startswith(href, 'mailto:') AND NOT startswith(href, 'javascript:')")
    kept = links.where(F.expr(U.glob_match("href", "https:*"))).where(~F.expr(U.glob_match("href", "*.")))
    return kept.select("page_id", "href")


@query("same_domain", """
SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/?#]*)', 1) = (SELECT regexp_extract(min(url), '^https?://([^/?#]*)', 1) FROM pages)""")
def same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).select("page_id", "url")
    base = df.agg(F.min("url").alias("base"))
    return df.withColumn("base", base.scalar()).where(F.expr(U.same_domain("url", "base"))).select("page_id")


@query("url_parts", """
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^/?#]*', 0) AS origin,
  CASE WHEN length(replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', '_')) < 2 THEN 'index' ELSE substr(replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', '_'), 2) END AS file
FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr(
        "page_id", f"{U.scheme('url')} AS scheme", f"{U.netloc('url')} AS netloc", f"{U.path('url')} AS path", f"{U.origin('url')} AS origin", f"{U.file_name('url')} AS file"
    )


@query("url_join", """
SELECT page_id, regexp_extract(url, '^https?://[^/?#]*', 0) || '/a/c' AS dotted, regexp_extract(url, '^https?://[^?#]*/', 0) || 'x.html?q=1' AS relative,
  regexp_extract(url, '^[^?#]*', 0) || '?z=1' AS query_only, regexp_extract(url, '^(https?):', 1) || '://cdn.example.com/a.js' AS scheme_relative,
  regexp_extract(url, '^[^#]*', 0) || '#top' AS fragment_only, url AS empty_ref FROM pages""")
def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = {
        "dotted": "/a/./b/../c", "relative": "./x.html?q=1", "query_only": "?z=1", "scheme_relative": "//cdn.example.com/a.js",
        "fragment_only": "#top", "empty_ref": "",
    }
    return pages(spark, sf_dir).selectExpr("page_id", *[f"{U.url_join('url', lit(r))} AS {n}" for n, r in refs.items()])


@query("internal_links", f"""
WITH {LINKS} SELECT page_id, count(*) AS n, count(*) FILTER (starts_with({ORIGIN} || {HREF}, {ORIGIN})) AS internal FROM links GROUP BY page_id""")
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_targets(pages(spark, sf_dir))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.expr(U.is_internal("href", "url"))).alias("internal"))


@query("count_elements", """
SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages""")
def count_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.count_elements(pages(spark, sf_dir), "nav li")


@query("count_elements_zero", "SELECT page_id, 0 AS n FROM pages")
def count_elements_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.count_elements(pages(spark, sf_dir), "table")


MAIN = f"length(trim({DECODE.format(ARTICLE_TEXT)})) > 200"


@query("main_content", f"""
SELECT page_id, CASE WHEN {MAIN} THEN 'article' ELSE 'body' END AS selector_used,
  CASE WHEN {MAIN} THEN regexp_extract(html, '(?s)<article>(.*)</article>', 1) ELSE html END AS html FROM pages""")
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.main_content(pages(spark, sf_dir)).select("page_id", "selector_used", "html")


WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


MARKDOWN_STEPS = [
    ("<!--.*?-->", ""), ("[ \\t\\r\\n\\f]+", " "), ('<a href="([^"]*)">([^<]*)</a>', "[\\2](\\1)"), ("<b>([^<]*(?:<br>[^<]*)*)(?:</b>)?", "**\\1**"),
    ("<br>", "  @"), ("<h1>", "@@# "), ("<li>", "@{bullet}"), ("</li>", ""), ("</?(?:nav|ul|div|article|footer|h1|p)(?: [^>]*)?>", "@@"), ("<[^>]*>", ""),
    ("@([ ]+@)+", "@@"), ("@{3,}", "@@"),
]


def _rendered(html: str, bullet: str) -> str:
    """SQL of the readable form of a part of a page, '@' for a line end."""
    sql = f"replace({html}, '@', '{{at}}')"
    for pattern, into in MARKDOWN_STEPS:
        sql = f"regexp_replace({sql}, '(?s){pattern}', '{into.replace('{bullet}', bullet)}', 'g')"
    return sql


def _lines(rendered: str, decode: str = DECODE) -> str:
    return f"trim(replace(replace({decode.format(rendered)}, '@', chr(10)), '{{at}}', '@'), ' ' || chr(10))"


# a heading that was cut within a reference ends in one without its semicolon, which counts too
OPEN_DECODE = "{0}"
for _name, _char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    OPEN_DECODE = f"regexp_replace({OPEN_DECODE}, '&{_name};?', '{_char}', 'g')"


ARTICLE, BODY = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)", "regexp_extract(html, '(?s)<body>(.*)', 1)"


@query("smart_document", f"""
WITH m AS (SELECT page_id, url, {TITLE_SQL} AS title, CASE WHEN {MAIN} THEN 'article' ELSE 'body' END AS selector_used, html FROM pages),
 t AS (SELECT page_id, url, title, selector_used, CASE WHEN selector_used = 'article' THEN {_lines(_rendered(ARTICLE, '  * '), OPEN_DECODE)} ELSE {_lines(_rendered(BODY, '  * '), OPEN_DECODE)} END AS content FROM m)
SELECT *, length(content) AS content_length, {WORDS.format('content')} AS word_count FROM t""")
def smart_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.smart_document(pages(spark, sf_dir))


@query("html_to_text_words", f"""
WITH t AS (SELECT page_id, {DECODE.format("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<h1>', '# ', 'g'), '</?(?:p|br|h1)>', ' ', 'g'), '<[^>]*>', '', 'g')")} AS txt FROM pages)
SELECT page_id, {WORDS.format('txt')} AS n_words FROM t""")
def html_to_text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    article = dom.dom(df, ["article"]).select("page_id", F.expr(f"coalesce({dom.first_of('article', H.inner_html('toks', 'x'))}, '')").alias("html"))
    # emphasis marks are glued to words, so they do not change the word count
    plain = content.html_to_text(article.withColumn("url", F.lit("")))
    words = F.expr(T.word_count("regexp_replace(content, '(^|\\\\s)[*_]+(?=\\\\s|$)', '$1')"))
    return plain.select("page_id", words.alias("n_words"))


@query("html_to_markdown", f"""
SELECT page_id, {_lines(_rendered(BODY, '* '))} AS content FROM pages""")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.html_to_markdown(pages(spark, sf_dir))


@query("word_counts", f"SELECT doc_id, {WORDS.format('text')} AS words, length(text) AS chars FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.expr(T.word_count("text")).alias("words"), F.length("text").cast("bigint").alias("chars"))


@query("has_date", r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b')
 OR regexp_matches(text, '(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b')
 OR regexp_matches(text, '\b\d{4}-\d{2}-\d{2}\b') OR regexp_matches(text, '(?i)\bon\s+[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}\b')""")
def has_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.expr(T.has_date("text"))).select("doc_id")


@query("trim_functions", r"""
SELECT doc_id, length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279))) AS n, lower(substr(text, 1, 5)) AS head,
  starts_with(text, 'A') AS starts, contains(text, 'the') AS has_the, len(string_split(text, chr(10))) AS n_lines FROM documents""")
def trim_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"CAST(length({T.js_trim('text')}) AS BIGINT) AS n", "lower(substr(text, 1, 5)) AS head", "startswith(text, 'A') AS starts",
        "contains(text, 'the') AS has_the", "CAST(size(split(text, '\\n')) AS BIGINT) AS n_lines",
    )


@query("heading_skips", f"""
SELECT page_id, 'h2' AS tag, 0 AS previous_level FROM pages WHERE false""")
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.heading_skips(pages(spark, sf_dir)).select("page_id", "tag", F.col("previous_level").cast("int").alias("previous_level"))


@query("a11y_summary", """
SELECT page_id, 0 AS total_issues, 0 AS missing_alt, 0 AS missing_label, 0 AS heading_skip, 0 AS button_no_name, 0 AS empty_link,
  false AS has_main, html LIKE '%<nav>%' AS has_nav FROM pages""")
def a11y_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.a11y_summary(pages(spark, sf_dir))


@query("seo_audit", f"""
SELECT page_id, {TITLE_SQL} AS title, len(regexp_extract_all(html, '<h1>')) AS h1_count,
  substr({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, 1, 100) AS h1_text,
  CASE WHEN length({TITLE_SQL}) < 10 THEN 'Title too short or missing|' ELSE '' END || 'Meta description too short or missing|No canonical URL' AS issues FROM pages""")
def seo_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.seo_audit(pages(spark, sf_dir)).select("page_id", "title", "h1_count", "h1_text", F.array_join("issues", "|").alias("issues"))


@query("mixed_content_pages", """
SELECT page_id, url LIKE 'https:%' AS is_https, CASE WHEN url LIKE 'https:%' THEN 0 END AS count, CASE WHEN url LIKE 'https:%' THEN false END AS has_mixed_content FROM pages""")
def mixed_content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.mixed_content(pages(spark, sf_dir)).drop("resources")


@query("page_checks", f"""
WITH {TOKS}
SELECT page_id, 0 AS total_images, 0 AS images_without_alt, count(*) FILTER (tok LIKE '<a href%') AS total_links,
  count(*) FILTER (tok LIKE '<a href%' AND url LIKE 'https:%') AS https_links, count(*) FILTER (regexp_matches(tok, '^<[a-zA-Z]')) AS node_count FROM toks GROUP BY page_id""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_checks(pages(spark, sf_dir)).drop("url")


@query("node_counts", f"WITH {TOKS} SELECT page_id, count(*) AS dom_nodes FROM toks WHERE regexp_matches(tok, '^<[a-zA-Z]') GROUP BY page_id")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.node_counts(pages(spark, sf_dir))


@query("recon", f"""
SELECT page_id, url, {TITLE_SQL} AS title, 'static' AS page_type, false AS spa_indicators, len(regexp_extract_all(html, '<a href')) AS links_total,
  len(regexp_extract_all(html, '<a href')) AS links_internal, 0 AS links_external, 0 AS images_total, 0 AS images_missing_alt,
  'H1:' || substr(trim({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), 1, 120) AS headings FROM pages""")
def recon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recon.recon(pages(spark, sf_dir)).drop("forms", "tables")
    return out.withColumn("headings", F.expr("array_join(transform(headings, h -> concat(h.tag, ':', h.text)), '|')"))


@query("key_selectors", f"""
WITH {TOKS}, c AS (SELECT page_id, unnest(['h1', 'p', 'nav', 'article', 'footer', 'ul li']) AS selector, unnest(['<h1>', '<p>', '<nav>', '<article>', '<footer>', '<li>']) AS what,
  unnest([0, 3, 8, 10, 13, 19]) AS probe_no FROM pages)
SELECT c.page_id, probe_no, selector, count(*) AS n FROM c JOIN toks t ON t.page_id = c.page_id AND t.tok = c.what GROUP BY ALL""")
def key_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.key_selectors(pages(spark, sf_dir)).withColumn("probe_no", F.col("probe_no").cast("bigint"))


@query("broken_links", f"""
WITH {LINKS} SELECT page_id, {ORIGIN} || {DECODE.format(HREF)} AS href, CAST(NULL AS INTEGER) AS status, substr({DECODE.format("regexp_extract(m, '>([^<]*)<', 1)")}, 1, 50) AS text FROM links
WHERE {ORIGIN} || {DECODE.format(HREF)} NOT IN (SELECT url FROM pages)""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    stored = df.select("url", F.lit(200).alias("status"))
    return audit.broken_links(df, stored, max_check=50, text_length=50)


@query("broken_link_summary", f"""
WITH {LINKS} SELECT g.page_id, count(l.m) AS total_links, least(count(l.m), 3) AS checked, least(count(l.m), 3) AS broken FROM pages g LEFT JOIN links l USING (page_id) GROUP BY 1""")
def broken_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    return audit.broken_link_summary(df, df.select("url", F.lit(200).alias("status")), max_check=3)


@query("links_outside_corpus", f"""
WITH {LINKS} SELECT DISTINCT {ORIGIN} || {DECODE.format(HREF)} AS href FROM links WHERE {ORIGIN} || {DECODE.format(HREF)} NOT IN (SELECT url FROM pages)""")
def links_outside_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    return crawl.in_corpus(extract.link_targets(df), df)


@query("batch_urls", f"""
WITH u AS (SELECT page_id AS line_no, url FROM pages UNION ALL SELECT -1 - page_id, (SELECT min(url) FROM pages) FROM pages UNION ALL SELECT 1000000000 + page_id, url || '/missing' FROM pages)
SELECT u.line_no, u.url, CASE WHEN g.url IS NOT NULL THEN trim({DECODE.format("regexp_extract(g.html, '<h1>([^<]*)</h1>', 1)")}) END AS texts,
  CASE WHEN g.url IS NULL THEN 'page not stored' END AS error FROM u LEFT JOIN pages g ON g.url = u.url""")
def batch_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    ids = df.select("page_id", "url")
    hot = ids.agg(F.min("url").alias("u"))
    urls = ids.select(F.col("page_id").alias("line_no"), "url")
    urls = urls.unionByName(ids.select((-1 - F.col("page_id")).alias("line_no"), hot.scalar().alias("url")))
    urls = urls.unionByName(ids.select((1000000000 + F.col("page_id")).alias("line_no"), F.concat("url", F.lit("/missing")).alias("url")))
    out = crawl.batch_urls(urls, df, "h1")
    return out.select("line_no", "url", F.array_join("texts", "|").alias("texts"), "error")


@query("batch_titles", f"SELECT page_id AS line_no, url, {TITLE_SQL} AS title FROM pages")
def batch_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    return crawl.batch_urls(df.select(F.col("page_id").alias("line_no"), "url"), df).select("line_no", "url", "title")


@query("extract_steps", f"""
WITH u AS (SELECT min(page_id) AS page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages) GROUP BY url)
SELECT page_id, 1 AS step, 'extract' AS action, 'h1' AS selector, trim({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS data, NULL AS status, NULL AS error FROM pages
UNION ALL SELECT page_id, 2, 'wait', NULL, NULL, 'success', NULL FROM pages
UNION ALL SELECT page_id, 3, 'unknown', NULL, NULL, 'error', 'Unknown action: hop' FROM pages
UNION ALL SELECT page_id, 4, 'goto', NULL, url, 'success', NULL FROM u
UNION ALL SELECT page_id, 5, 'extract', 'h1', trim({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), NULL, NULL FROM pages JOIN u USING (page_id)
UNION ALL SELECT NULL, 6, 'goto', NULL, NULL, 'error', 'page not stored: http://nowhere.invalid/'""")
def extract_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"extract": {"selector": "h1"}}, {"wait": {"selector": "h1"}}, {"hop": 1}]
    df = pages(spark, sf_dir)
    steps += [{"goto": df.agg(F.min("url")).first()[0]}, {"extract": {"selector": "h1"}}, {"goto": "http://nowhere.invalid/"}]
    out = crawl.extract_steps(df, steps)
    return out.withColumn("data", F.array_join("data", "|")).withColumn("step", F.col("step").cast("bigint"))


@query("eval_expr", """
SELECT page_id, upper(substr(url, 1, 8)) AS u, length(html) * 2 AS n FROM pages""")
def eval_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", "upper(substr(url, 1, 8)) AS u", "CAST(length(html) * 2 AS BIGINT) AS n")


@query("export_links", f"""
WITH {LINKS} SELECT page_id, {ORIGIN} || {DECODE.format(HREF)} AS href, trim({DECODE.format("regexp_extract(m, '>([^<]*)<', 1)")}) AS text FROM links""")
def export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export(pages(spark, sf_dir), "links").select("page_id", "href", "text")


@query("limit_per_page", f"""
WITH {LINKS} SELECT page_id, {DECODE.format(HREF)} AS href FROM links WHERE n < 2""")
def limit_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.select(dom.dom(pages(spark, sf_dir), ["a"]), "a", {"href": dom.attr("href")}, limit=2).select("page_id", "href")


@query("limit_rows", f"""
WITH {LINKS} SELECT page_id, {DECODE.format(HREF)} AS href FROM links WHERE n < 3""")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.limit(extract.extract_links(pages(spark, sf_dir)), 3).select("page_id", "href")


@query("document_order", f"""
WITH {TOKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ordinal, {TAG} AS tag FROM toks WHERE regexp_matches(tok, '^<(?:li|h1|p)>')""")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(pages(spark, sf_dir), ["li", "h1", "p"])
    hits = f"transform(filter(els, x -> x.tag IN ('li', 'h1', 'p')), (x, n) -> struct(CAST(n AS BIGINT) AS ordinal, x.tag AS tag))"
    return dom.rows_of(doc, hits, "page_id")


@query("heading_order", f"""
SELECT page_id, 0 AS ordinal, 'h1' AS tag, trim({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS text FROM pages""")
def heading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.heading_order(pages(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("distinct_links", f"WITH {LINKS} SELECT DISTINCT {DECODE.format(HREF)} AS href FROM links")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_links(pages(spark, sf_dir)).select("href").distinct()


@query("append_links", f"""
WITH {LINKS} SELECT {HREF} AS href, count(*) * 2 AS n FROM links GROUP BY 1""")
def append_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_targets(pages(spark, sf_dir)).select(F.expr(U.path("href")).alias("href"))
    return links.union(links).groupBy("href").agg(F.count("*").alias("n"))


@query("aria_snapshot", f"""
SELECT page_id, 2 * len(regexp_extract_all(html, '<li>')) + len(regexp_extract_all(html, '<p>')) + 5 AS n_lines FROM pages""")
def aria_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = aria.aria_snapshot(pages(spark, sf_dir))
    return snaps.select("page_id", F.expr("CAST(size(split(snapshot, '\\n')) AS BIGINT)").alias("n_lines"))


@query("aria_blocks", f"""
SELECT page_id, 0 AS block_no, len(regexp_extract_all(html, '<p>')) + 2 AS n_lines FROM pages""")
def aria_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = aria.aria_blocks(aria.aria_snapshot(pages(spark, sf_dir)), "article")
    return blocks.select("page_id", F.col("block_no").cast("bigint").alias("block_no"), F.size("lines").cast("bigint").alias("n_lines"))


@query("smart_records", f"""
SELECT page_id, 0 AS block_no, nullif(replace(trim(regexp_replace({DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')), '"', ''''), '') AS name FROM pages""")
def smart_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.smart_records(aria.aria_snapshot(pages(spark, sf_dir)))
    return out.select("page_id", F.col("block_no").cast("bigint").alias("block_no"), "name")


@query("collapsible_census", f"""
SELECT page_id, CASE WHEN {MAIN} THEN 'article' ELSE 'body' END AS container, 0 AS expanded FROM pages""")
def collapsible_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.collapsible_census(pages(spark, sf_dir)).select("page_id", "container", "expanded")


@query("crawl_file_names", """
WITH f AS (SELECT url, CASE WHEN length(replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', '_')) < 2 THEN 'index'
   ELSE substr(replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', '_'), 2) END AS file FROM pages)
SELECT file, max(url) AS url FROM f GROUP BY file""")
def crawl_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = pages(spark, sf_dir).select("url", F.lit(0).alias("depth"))
    return crawl.crawl_documents(crawled).select("file", "url")
