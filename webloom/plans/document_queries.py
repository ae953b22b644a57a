"""Queries over documents written from the star tables; the SQL reads the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import aria, audit, content, crawl, dom, extract, forms, recon, state, tables
from webloom.plans import fixtures as fx
from webloom.plans.registry import query, table
from webloom.sources import readers, sinks


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c.endswith(("_no", "pos", "count")) else F.col(c) for c in columns])


FIELD_ROWS = """
SELECT p_partkey AS page_id, 0 AS row_no, 'name' AS field, p_name AS value FROM part
UNION ALL SELECT p_partkey, 1, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 2, 'type', p_type FROM part
UNION ALL SELECT p_partkey, 3, 'size', CAST(p_size AS VARCHAR) FROM part"""


@query("table_cells", f"""
WITH r AS ({FIELD_ROWS}) SELECT page_id, 0 AS table_no, row_no, 'field' AS header, field AS cell FROM r UNION ALL SELECT page_id, 0, row_no, 'value', value FROM r""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.table_cells(fx.table_pages(spark, sf_dir), "table.data")
    return _long(out, "page_id", "table_no", "row_no", "header", "cell")


@query("table_all", """
SELECT p_partkey AS page_id, 0 AS table_no, 'field|value' AS headers, 4 AS n_rows FROM part UNION ALL SELECT p_partkey, 1, 'only', 0 FROM part""")
def table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.extract_tables(fx.table_pages(spark, sf_dir))
    return out.select("page_id", F.col("table_no").cast("bigint").alias("table_no"), F.array_join("headers", "|").alias("headers"), F.size("rows").cast("bigint").alias("n_rows"))


@query("table_fallback", """
SELECT p_partkey AS page_id, 'table.data' AS selector_used, 'Selector ''.prices'' not found — used auto-detected ''table.data'' instead' AS note,
  'field|value' AS headers, p_brand AS brand, 2 AS tables_on_page FROM part""")
def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.table_with_fallback(fx.table_pages(spark, sf_dir), ".prices")
    return out.select("page_id", "selector_used", "note", F.array_join("headers", "|").alias("headers"), F.expr("rows[1]['value']").alias("brand"), "tables_on_page")


@query("table_missing", """
SELECT page_id, 'No table found on page' AS error, 0 AS tables_on_page FROM pages""")
def table_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_with_fallback(readers.pages(spark, sf_dir)).select("page_id", "error", "tables_on_page")


@query("table_override_headers", """
SELECT p_partkey AS page_id, 'A|B' AS headers, p_type AS by_old_key FROM part""")
def table_override_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.extract_tables(fx.table_pages(spark, sf_dir), "table.data", headers=["A", "B"])
    return out.select("page_id", F.array_join("headers", "|").alias("headers"), F.expr("rows[2]['value']").alias("by_old_key"))


@query("table_rows_export", f"""
WITH r AS ({FIELD_ROWS}) SELECT page_id, row_no + 1 AS row_no, field || ',' || value AS line FROM r UNION ALL SELECT p_partkey, 0, 'field,value' FROM part""")
def table_rows_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table_rows(fx.table_pages(spark, sf_dir), "table.data")
    return rows.select("page_id", F.col("row_no").cast("bigint").alias("row_no"), F.expr(sinks.csv_line()).alias("line"))


@query("extract_records", """
SELECT p_partkey AS page_id, p_name AS name, p_type AS kind, CAST(p_size AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS label FROM part
UNION ALL SELECT p_partkey, NULL, NULL, NULL, p_brand FROM part""")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = '{"name": "h2 a", "kind": "p", "price": "span.price", "label": ".missing, .price, .alt"}'
    return tables.extract_records(fx.record_pages(spark, sf_dir), "article.card", fields).drop("pos")


@query("select_child_union", """
SELECT p_partkey AS page_id, p_name AS text FROM part UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, p_brand FROM part""")
def select_child_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(fx.record_pages(spark, sf_dir))
    return dom.text_content(doc, "article[id^=a] > h2, main span.price, div > [class*=al]").select("page_id", "text")


@query("nth_child_records", "SELECT p_partkey AS page_id, p_type AS text FROM part")
def nth_child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.nth_child(dom.dom(fx.record_pages(spark, sf_dir)), "main p", 2).select("page_id", "text")


@query("closest_record", "SELECT p_partkey AS page_id, 'article' AS closest_tag, p_name AS text FROM part")
def closest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(fx.record_pages(spark, sf_dir))
    near = dom.closest(doc, "h2 > a", ".card")
    return near.join(dom.text_content(doc, "h2 > a"), ["page_id", "pos"]).select("page_id", "closest_tag", "text")


@query("path_text", "SELECT p_partkey AS page_id, p_name AS result FROM part")
def path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(fx.record_pages(spark, sf_dir))
    return dom.path_query(doc, [("//", "main"), ("/", "article"), ("//", "a[href]")], as_text=True).select("page_id", "result")


@query("path_html", """
SELECT p_partkey AS page_id, '<span class="price">' || p_size || '</span>' AS result FROM part""")
def path_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = dom.dom(fx.record_pages(spark, sf_dir))
    return dom.path_query(doc, [("//", "span[class='price']")]).select("page_id", "result")


@query("extract_meta", """
SELECT c_custkey AS page_id, unnest(['title', 'description', 'og:title', 'rank', 'twitter:card', 'nation']) AS key, unnest([c_name || ' & Co',
  c_mktsegment || ' customer of nation number ' || c_nationkey || ' in the long list of customers', c_name, CAST(c_nationkey AS VARCHAR), 'summary', CAST(c_nationkey AS VARCHAR)]) AS content FROM customer""")
def extract_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_meta(fx.head_pages(spark, sf_dir))
    return out.select("page_id", F.explode_outer("meta").alias("key", "content"))


@query("extract_jsonld", """
SELECT c_custkey AS page_id, c_name AS name, NULL AS id FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, NULL, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END FROM customer""")
def extract_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_jsonld(fx.head_pages(spark, sf_dir))
    return out.select("page_id", F.expr("try_variant_get(data, '$.name', 'string')").alias("name"), F.expr("try_variant_get(data, '$.id', 'bigint')").alias("id"))


@query("extract_microdata", """
SELECT c_custkey AS page_id, 'https://schema.org/Person' AS type, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS address FROM customer
UNION ALL SELECT c_custkey, NULL, NULL, c_mktsegment, NULL, NULL FROM customer""")
def extract_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_microdata(fx.head_pages(spark, sf_dir))
    return out.select("page_id", "type", *[F.expr(f"props['{n}']").alias(n) for n in ("name", "segment", "nation", "address")])


@query("seo_audit_heads", """
SELECT c_custkey AS page_id, c_name || ' & Co' AS title, c_mktsegment AS description, CASE WHEN c_custkey % 2 = 0 THEN 'https://crm.example.com/c/' || c_custkey END AS canonical,
  c_name AS og_title, 'summary' AS twitter_card, c_custkey % 3 AS h1_count, CASE WHEN c_custkey % 3 > 0 THEN 'Hello' END AS h1_text,
  CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS n_structured,
  'Meta description too short or missing' || CASE c_custkey % 3 WHEN 0 THEN '|No H1 heading found' WHEN 2 THEN '|Multiple H1 headings found' ELSE '' END
  || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '|No canonical URL' END AS issues FROM customer""")
def seo_audit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.seo_audit(fx.head_pages(spark, sf_dir))
    return out.select(
        "page_id", "title", "description", "canonical", "og_title", "twitter_card", "h1_count", "h1_text",
        F.size("structured_data").cast("bigint").alias("n_structured"), F.array_join("issues", "|").alias("issues"),
    )


MEDIA_ORIGIN = "CASE WHEN p_partkey % 5 = 0 THEN 'http' ELSE 'https' END || '://media.example.com'"


@query("extract_images", f"""
SELECT p_partkey AS page_id, {MEDIA_ORIGIN} || '/img/' || p_partkey || '.png' AS src, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS alt FROM part
UNION ALL SELECT p_partkey, 'http://cdn.example.com/' || p_partkey || '.jpg', '' FROM part UNION ALL SELECT p_partkey, 'data:image/png;base64,AA', 'd' FROM part""")
def extract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_images(fx.media_pages(spark, sf_dir)).select("page_id", "src", "alt")


@query("list_frames", """
SELECT p_partkey AS page_id, 0 AS frame_no, '/frame/' || p_partkey AS src, CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_partkey ELSE '' END AS id, '' AS name,
  CASE WHEN p_partkey % 3 = 0 THEN '#f' || p_partkey ELSE 'iframe:nth-of-type(1)' END AS selector FROM part
UNION ALL SELECT p_partkey, 1, '', '', 'n' || p_size, '[name="n' || p_size || '"]' FROM part
UNION ALL SELECT p_partkey, 2, '', '', '', 'iframe:nth-of-type(3)' FROM part""")
def list_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.list_frames(fx.media_pages(spark, sf_dir)).withColumn("frame_no", F.col("frame_no").cast("bigint"))


RGB = "'rgb(' || ({0} * 37) % 256 || ', ' || ({0} * 91) % 256 || ', ' || ({0} * 53) % 256 || ')'"


@query("inline_styles", f"""
SELECT p_partkey AS page_id, {RGB.format('p_partkey')} AS color, {RGB.format('(p_partkey + 7)')} AS background, 'Arial, F' || p_size AS font FROM part""")
def inline_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.inline_styles(fx.media_pages(spark, sf_dir), ".box", ["color", "background-color", "font-family"])
    return out.selectExpr("page_id", "styles['color'] AS color", "styles['background-color'] AS background", "styles['font-family'] AS font")


@query("fonts", """
SELECT p_partkey AS page_id, 'Arial, F' || p_size AS used, 'F' || p_size AS family, 'url(f' || p_size || '.woff)' AS src, '700' AS weight, 'normal' AS style FROM part""")
def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.fonts(fx.media_pages(spark, sf_dir))
    return out.select("page_id", F.array_join("used", "|").alias("used"), F.explode_outer("faces").alias("face")).select("page_id", "used", "face.*")


def _luminance(seed: str) -> str:
    def channel(k: int) -> str:
        c = f"((({seed} * {k}) % 256) / 255.0)"
        return f"CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END"

    return f"(0.2126 * {channel(37)} + 0.7152 * {channel(91)} + 0.0722 * {channel(53)})"


@query("wcag_contrast", f"""
WITH l AS (SELECT p_partkey AS page_id, {_luminance('p_partkey')} AS a, {_luminance('(p_partkey + 7)')} AS b FROM part),
 r AS (SELECT page_id, (greatest(a, b) + 0.05) / (least(a, b) + 0.05) AS ratio FROM l)
SELECT page_id, round(ratio, 2) AS contrast_ratio, ratio >= 4.5 AS wcag_aa, ratio >= 7 AS wcag_aaa, ratio >= 3 AS wcag_aa_large, ratio >= 4.5 AS wcag_aaa_large FROM r""")
def wcag_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = extract.inline_styles(fx.media_pages(spark, sf_dir), ".box").selectExpr("page_id", "styles['color'] AS fg", "styles['background-color'] AS bg")
    return state.wcag_contrast(styles, "fg", "bg").drop("fg", "bg")


@query("mixed_content", """
SELECT p_partkey AS page_id, p_partkey % 5 <> 0 AS is_https, CASE WHEN p_partkey % 5 <> 0 THEN 1 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END END AS count,
  CASE WHEN p_partkey % 5 <> 0 THEN true END AS has_mixed_content,
  CASE WHEN p_partkey % 5 <> 0 THEN 'image' || CASE WHEN p_partkey % 4 = 0 THEN '|stylesheet' ELSE '' END END AS types FROM part""")
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.mixed_content(fx.media_pages(spark, sf_dir))
    return out.withColumn("types", F.expr("array_join(transform(resources, r -> r.type), '|')")).drop("resources")


@query("image_audit", f"""
SELECT p_partkey AS page_id, {MEDIA_ORIGIN} || '/img/' || p_partkey || '.png' AS src, false AS lazy,
  concat_ws('|', CASE WHEN p_partkey % 2 = 1 THEN 'missing_alt' END, CASE WHEN 60 > 2 * p_size OR p_partkey % 30 > 20 THEN 'oversized' END) AS issues
FROM part WHERE p_partkey % 2 = 1 OR 60 > 2 * p_size OR p_partkey % 30 > 20""")
def image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.media_pages(spark, sf_dir)
    sizes = table(spark, sf_dir, "part").selectExpr(
        "concat(IF(p_partkey % 5 = 0, 'http', 'https'), '://media.example.com/img/', p_partkey, '.png') AS src", "60 AS natural_width", "CAST(p_partkey % 30 AS INT) AS natural_height"
    )
    out = audit.image_audit(pages, sizes).where("size(issues) > 0")
    return out.select("page_id", "src", "lazy", F.array_join("issues", "|").alias("issues"))


@query("image_summary", """
SELECT p_partkey AS page_id, 4 AS total_images, p_partkey % 2 AS images_with_issues, p_partkey % 2 AS missing_alt, 0 AS oversized FROM part""")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.image_summary(fx.media_pages(spark, sf_dir))


@query("a11y_issues", """
SELECT p_partkey AS page_id, unnest(['button_no_name', 'empty_link'] || CASE WHEN p_partkey % 2 = 1 THEN ['missing_alt'] ELSE [] END) AS type FROM part""")
def a11y_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.a11y_issues(fx.media_pages(spark, sf_dir)).select("page_id", "type")


@query("a11y_form_issues", """
SELECT c_custkey AS page_id, 'missing_label' AS type, 'select' AS element, 'nation' AS detail FROM customer
UNION ALL SELECT c_custkey, 'missing_label', 'input', unnest(['q', 'a', 'c']) FROM customer
UNION ALL SELECT c_custkey, 'button_no_name', 'button', '' FROM customer""")
def a11y_form_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.a11y_issues(fx.form_pages(spark, sf_dir)).select("page_id", "type", "element", "detail")


@query("extract_forms", """
SELECT c_custkey AS page_id, 0 AS form_no, 'f' || c_custkey AS id, NULL AS name, 'https://crm.example.com/save' AS action, 'post' AS method, 'form' AS type, NULL AS selector, 4 AS n_fields FROM customer
UNION ALL SELECT c_custkey, 1, NULL, 'search', NULL, NULL, 'role-form', 'div', 1 FROM customer
UNION ALL SELECT c_custkey, 2, NULL, NULL, NULL, NULL, 'implicit', 'div', 2 FROM customer
UNION ALL SELECT c_custkey, 3, NULL, NULL, NULL, NULL, 'implicit', 'p', 1 FROM customer""")
def extract_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forms.extract_forms(fx.form_pages(spark, sf_dir)).withColumn("n_fields", F.size("fields").cast("bigint")).drop("fields")
    return out.withColumn("form_no", F.col("form_no").cast("bigint"))


@query("form_fields", """
SELECT c_custkey AS page_id, 0 AS form_no, 'mail' AS name, 'email' AS type, c_custkey || '@example.com' AS value, true AS required, 0 AS n_options, 'e' || c_custkey AS id FROM customer
UNION ALL SELECT c_custkey, 0, 'note', 'textarea', c_mktsegment, false, 0, NULL FROM customer
UNION ALL SELECT c_custkey, 0, 'nation', 'select-one', CAST(c_nationkey AS VARCHAR), false, 2, NULL FROM customer
UNION ALL SELECT c_custkey, 0, 'token', 'hidden', 't', false, 0, NULL FROM customer
UNION ALL SELECT c_custkey, 1, 'q', 'text', NULL, false, 0, NULL FROM customer
UNION ALL SELECT c_custkey, 2, unnest(['a', 'b']), 'text', NULL, false, 0, NULL FROM customer
UNION ALL SELECT c_custkey, 3, 'c', 'checkbox', 'on', false, 0, NULL FROM customer""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forms.form_fields(fx.form_pages(spark, sf_dir))
    return out.select(
        "page_id", F.col("form_no").cast("bigint").alias("form_no"), "name", "type", "value", "required",
        F.expr("CAST(IF(options IS NULL, 0, size(options)) AS BIGINT)").alias("n_options"), "id",
    )


@query("match_form_fields", """
SELECT c_custkey AS page_id, unnest(['e-mail', 'note', 'nation', 'token', 'zip']) AS wanted, unnest(['label', 'textarea name', 'select name', 'input name', NULL]) AS matched_by,
  unnest(['input', 'textarea', 'select', 'input', NULL]) AS tag FROM customer""")
def match_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.match_form_fields(fx.form_pages(spark, sf_dir), ["e-mail", "note", "nation", "token", "zip"]).drop("pos")


@query("input_labels", """
SELECT c_custkey AS page_id, CASE n WHEN 0 THEN 'e' || c_custkey ELSE '' END AS id, n < 2 AS has_label FROM customer, (SELECT unnest(range(7)) AS n)""")
def input_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.input_labels(fx.form_pages(spark, sf_dir)).select("page_id", "id", "has_label")


@query("element_selectors", """
SELECT c_custkey AS page_id, unnest(['#e' || c_custkey, '[name="token"]', '[name="q"]', '[name="a"]', '[name="b"]', '[name="c"]']) AS selector FROM customer""")
def element_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.element_selectors(fx.form_pages(spark, sf_dir), "input", "input").select("page_id", "selector")


@query("click_selectors", """
SELECT p_partkey AS page_id, unnest(['#a' || p_partkey, '.card', 'article']) AS selector FROM part""")
def click_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.element_selectors(fx.record_pages(spark, sf_dir), "article", "click").select("page_id", "selector")


@query("recon_forms", """
SELECT c_custkey AS page_id, 'form' AS page_type, 0 AS form_no, 'form#f' || c_custkey AS selector, 'POST' AS method, 4 AS field_count, 'mail,note,nation,token' AS field_names FROM customer
UNION ALL SELECT c_custkey, 'form', 1, 'div', 'GET', 1, 'q' FROM customer""")
def recon_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recon.recon(fx.form_pages(spark, sf_dir)).select("page_id", "page_type", F.explode_outer("forms").alias("f"))
    return out.select(
        "page_id", "page_type", F.col("f.index").cast("bigint").alias("form_no"), "f.selector", "f.method", F.col("f.field_count").cast("bigint").alias("field_count"),
        F.array_join("f.field_names", ",").alias("field_names"),
    )


@query("recon_tables", """
SELECT p_partkey AS page_id, 'data' AS page_type, 0 AS table_no, 'table.data' AS selector, 5 AS rows, 2 AS cols FROM part
UNION ALL SELECT p_partkey, 'data', 1, 'table', 1, 1 FROM part""")
def recon_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recon.recon(fx.table_pages(spark, sf_dir)).select("page_id", "page_type", F.explode_outer("tables").alias("t"))
    return out.select("page_id", "page_type", F.col("t.index").cast("bigint").alias("table_no"), "t.selector", "t.rows", "t.cols")


@query("aria_records", """
SELECT p_partkey AS page_id, 0 AS block_no, p_name AS name, p_name AS url FROM part
UNION ALL SELECT p_partkey, 1, NULL, NULL FROM part UNION ALL SELECT p_partkey, 2, NULL, NULL FROM part""")
def aria_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.smart_records(aria.aria_snapshot(fx.record_pages(spark, sf_dir)), "article", ["name", "url"])
    return out.withColumn("block_no", F.col("block_no").cast("bigint"))


@query("aria_fallback", """
SELECT c_custkey AS page_id, 'listitem' AS container_used, unnest(range(8)) AS block_no FROM customer""")
def aria_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.container_blocks(aria.aria_snapshot(fx.site_pages(spark, sf_dir)), "article")
    return out.select("page_id", "container_used", F.col("block_no").cast("bigint").alias("block_no"))


@query("smart_records_limit", "SELECT c_custkey AS page_id, unnest([0, 1]) AS block_no, 'next' AS url FROM customer")
def smart_records_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.smart_records(aria.aria_snapshot(fx.site_pages(spark, sf_dir)), "listitem", ["url"], limit=2)
    return out.withColumn("block_no", F.col("block_no").cast("bigint"))


DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query("sitemap_urls", f"""
SELECT 'https://s.example.com/map/' || o_orderkey AS url, 'sitemap' AS type, 'https://s.example.com/' || o_orderkey || '.xml' AS loc, NULL AS lastmod, NULL AS changefreq, NULL AS priority, NULL AS error FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT 'https://s.example.com/map/' || o_orderkey, 'url', 'https://s.example.com/' || o_orderkey, {DAY}, NULL, '0.' || o_orderkey % 10, NULL FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 100 <> 99
UNION ALL SELECT 'https://s.example.com/map/' || o_orderkey, 'url', 'https://s.example.com/' || o_orderkey || '/b', NULL, 'daily', NULL, NULL FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 100 <> 99
UNION ALL SELECT 'https://s.example.com/map/' || o_orderkey, NULL, NULL, NULL, NULL, NULL, 'Failed to parse sitemap' FROM orders WHERE o_orderkey % 100 = 99""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sitemap_urls(fx.sitemap_documents(spark, sf_dir)).drop("entry_no")


@query("sitemap_pick", """
SELECT 'https://h' || c_custkey || '.example.com' AS url, CASE WHEN c_custkey % 4 = 1 THEN 'https://h' || c_custkey || '.example.com/sitemap.xml'
  WHEN c_custkey % 4 = 2 THEN 'https://h' || c_custkey || '.example.com/sitemap-index.xml' END AS sitemap_url,
  CASE WHEN c_custkey % 4 NOT IN (1, 2) THEN 'Sitemap not found' END AS error FROM customer""")
def sitemap_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('https://h', c_custkey, '.example.com') AS url")
    # 1: found at the first place; 2: only at the last; 3: an empty answer at the first place hides the next; 0: none
    places = (
        "CASE k % 4 WHEN 1 THEN array(struct('/sitemap.xml' AS p, 200 AS s, '<a/>' AS x)) "
        "WHEN 2 THEN array(struct('/sitemap.xml' AS p, 404 AS s, 'no' AS x), struct('/sitemap-index.xml' AS p, 200 AS s, '<c/>' AS x)) "
        "WHEN 3 THEN array(struct('/sitemap.xml' AS p, 200 AS s, '' AS x), struct('/sitemap_index.xml' AS p, 200 AS s, '<b/>' AS x)) END"
    )
    responses = base.select("url", F.explode(F.expr(places)).alias("a")).selectExpr("concat(url, a.p) AS url", "a.s AS status", "a.x AS xml")
    return readers.sitemap_pick(base.select("url"), responses).drop("xml")


@query("feed_info", """
SELECT 'https://f.example.com/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'rss' ELSE 'atom' END AS type, 'Orders ' || o_orderkey AS title,
  'https://f.example.com/' || o_orderkey AS link, CASE WHEN o_orderkey % 2 = 0 THEN 'about ' || o_orderstatus END AS description FROM orders""")
def feed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.feed_info(fx.feed_documents(spark, sf_dir))


@query("feed_items", f"""
SELECT 'https://f.example.com/' || o_orderkey AS url, 0 AS item_no, o_orderpriority AS title, 'https://f.example.com/i/' || o_orderkey AS link,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a &amp; b' END AS description, CASE WHEN o_orderkey % 2 = 0 THEN {DAY} END AS pub_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS guid,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS summary, CASE WHEN o_orderkey % 2 = 1 THEN {DAY} END AS published, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders
UNION ALL SELECT 'https://f.example.com/' || o_orderkey, 1, CASE WHEN o_orderkey % 2 = 0 THEN 'second' END, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 2 = 1 THEN 'x' END FROM orders""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.feed_items(fx.feed_documents(spark, sf_dir)).drop("type").withColumn("item_no", F.col("item_no").cast("bigint"))


SITE_LEVELS = """
WITH RECURSIVE n AS (SELECT count(*) AS c FROM customer), site AS (SELECT 0 AS k, 0 AS depth UNION ALL
  SELECT 8 * k + s, depth + 1 FROM site, (SELECT unnest(range(1, 9)) AS s) WHERE depth < {depth} AND k < (SELECT c FROM n))"""


@query("crawl_site", SITE_LEVELS.format(depth=3) + f"""
SELECT '{fx.SITE}/c/' || k AS url, depth, c_name AS title, c_mktsegment AS extracted, CASE WHEN c_custkey IS NULL THEN 'page not stored' END AS error
FROM site LEFT JOIN customer ON c_custkey = k""")
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl.crawl(fx.site_pages(spark, sf_dir), f"{fx.SITE}/c/0", depth=3, extract="h1", exclude="*/private/*")
    return out.select("url", F.col("depth").cast("bigint").alias("depth"), "title", F.array_join("extracted", "|").alias("extracted"), "error")


@query("crawl_follow", """
WITH RECURSIVE site AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION ALL SELECT 8 * k + s, depth + 1 FROM site, (SELECT unnest(range(1, 9)) AS s)
  WHERE depth < 2 AND k IN (SELECT c_custkey FROM customer) AND (8 * k + s) % 10 = 4)
SELECT depth, count(*) AS n FROM site GROUP BY depth""")
def crawl_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl.crawl(fx.site_pages(spark, sf_dir), f"{fx.SITE}/c/0", depth=2, follow=f"{fx.SITE}/c/*4")
    return out.groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


@query("link_edges", f"""
SELECT 'c' || c_custkey AS src, count(*) AS n FROM (SELECT DISTINCT c_custkey, t FROM (
  SELECT c_custkey, 8 * c_custkey + s AS t FROM customer, (SELECT unnest(range(1, 9)) AS s) UNION ALL SELECT c_custkey, c_custkey // 8 FROM customer UNION ALL SELECT c_custkey, 0 FROM customer)) GROUP BY 1""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = crawl.link_edges(fx.site_pages(spark, sf_dir), exclude="*/private/*", domain="site.example.com")
    return edges.groupBy(F.expr("concat('c', regexp_extract(src_url, '/c/([0-9]+)', 1))").alias("src")).agg(F.count("*").alias("n"))


@query("broken_links_site", f"""
WITH t AS (SELECT c_custkey AS page_id, 8 * c_custkey + s AS k FROM customer, (SELECT unnest(range(1, 9)) AS s))
SELECT page_id, '{fx.SITE}/c/' || k AS href, CASE WHEN c_custkey IS NOT NULL THEN 404 END AS status FROM t LEFT JOIN customer ON c_custkey = k WHERE c_custkey IS NULL OR c_custkey % 7 = 0
UNION ALL SELECT c_custkey, '{fx.SITE}/c/' || c_custkey // 8, 404 FROM customer WHERE (c_custkey // 8) % 7 = 0 UNION ALL SELECT c_custkey, '{fx.SITE}/c/0', 404 FROM customer
UNION ALL SELECT c_custkey, 'https://other.example.org/x', NULL FROM customer UNION ALL SELECT c_custkey, '{fx.SITE}/private/' || c_custkey, NULL FROM customer""")
def broken_links_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.site_pages(spark, sf_dir)
    status = pages.select("url", F.expr("IF(page_id % 7 = 0, 404, 200)").alias("status"))
    return audit.broken_links(pages, status).drop("text")


CHAINS = """
WITH s AS (SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, o_orderkey - o_orderkey % 12 AS first, o_orderkey % 12 AS n FROM orders)"""


@query("paginate_items", CHAINS + """
SELECT 'https://orders.example.com/o/' || first AS start_url, n + 1 AS page_no, 0 AS pos, o_orderstatus AS item FROM s WHERE n < 10
UNION ALL SELECT 'https://orders.example.com/o/' || first, n + 1, 1, o_orderpriority FROM s WHERE n < 10""")
def paginate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _paginate(spark, sf_dir, 10)
    return _long(items, "start_url", "page_no", "pos", "item")


def _paginate(spark: SparkSession, sf_dir: str, max_pages: int) -> tuple[DataFrame, DataFrame]:
    pages = fx.chain_pages(spark, sf_dir)
    starts = content.has_selector(pages, "body.first").select("url")
    return crawl.paginate(pages, starts, "a.next", "li", max_pages)


@query("paginate_counts", CHAINS + """, m AS (SELECT max(k) AS top FROM s)
SELECT 'https://orders.example.com/o/' || first AS start_url, count(*) FILTER (n < 11) AS pages, 2 * count(*) AS n_items FROM s GROUP BY first""")
def paginate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paginate(spark, sf_dir, 20)[1]


@query("array_diff_pct", """
WITH e AS (SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS other FROM embeddings),
 d AS (SELECT vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: (embedding[i] > 0) <> (other[i] > 0))) * 100.0 / len(embedding) AS pct FROM e WHERE other IS NOT NULL)
SELECT vec_id, round(pct, 2) AS difference_percentage, pct < 50 AS images_match FROM d""")
def array_diff_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, v -> v > 0)").alias("bits"))
    after = signs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return state.array_diff_pct(signs.join(after, "vec_id"), "bits", "other", 0.5).select("vec_id", "difference_percentage", "images_match")


@query("csv_union", """
SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, '' AS segment FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '', c_mktsegment FROM customer""")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name")
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_mktsegment AS segment")
    return sinks.csv_union([a, b])


@query("plain_lines", """
SELECT 'n_name: ' || n_name AS value FROM nation UNION ALL SELECT 'n_regionkey: ' || n_regionkey FROM nation""")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.plain_lines(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


@query("shadow_select", """
SELECT c_custkey AS page_id, 'b' AS tag, c_name AS text, c_name AS html FROM customer""")
def shadow_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS page_id", "'' AS url",
        "concat('<my-card><template shadowrootmode=\"open\"><p><b>', c_name, '</b></p></template><b>light</b></my-card><template><b>no</b></template>') AS html",
    )
    return extract.shadow_select(pages, "my-card", "b").drop("host_pos", "pos")


@query("typed_sitemap", f"""
SELECT o_orderkey AS k, {DAY} AS day, (o_orderkey % 10) / 10.0 AS priority_value FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 100 <> 99""")
def typed_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.typed_sitemap(readers.sitemap_urls(fx.sitemap_documents(spark, sf_dir))).where("lastmod IS NOT NULL")
    return out.select(
        F.expr("CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT)").alias("k"), F.date_format("lastmod_ts", "yyyy-MM-dd").alias("day"), "priority_value"
    )


