"""Queries over richer documents, and writers read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import aria, audit, content, state, tables
from webloom.plans import fixtures as fx
from webloom.plans.page_queries import pages
from webloom.plans.registry import query, table
from webloom.session import checkpointed, dealt, shared_folder
from webloom.sources import documents_sink, readers, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


def _article(strong: str, em: str, bullet: str) -> str:
    body = (
        f"'## ' || p_name || chr(10) || chr(10) || 'A {strong}' || p_brand || '{strong} {em}of{em} [type](/p/' || p_partkey || ') ' || p_type || '  ' || chr(10) || 'next' || chr(10) || chr(10) || 'second'"
        f" || chr(10) || chr(10) || '{bullet}one' || chr(10) || '{bullet}two' || chr(10) || chr(10) || '  {bullet}deep'"
        " || chr(10) || chr(10) || '1. first' || chr(10) || '2. ' || p_size || chr(10) || chr(10) || '![pic](/i.png)' || chr(10) || chr(10) || rtrim(repeat('word ', 60))"
    )
    return body


@query("html_to_markdown_articles", f"SELECT p_partkey AS page_id, '[n](/n)' || chr(10) || chr(10) || {_article('**', '*', '* ')} AS content FROM part")
def html_to_markdown_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.html_to_markdown(fx.article_pages(spark, sf_dir))


@query("html_to_text_articles", f"SELECT p_partkey AS page_id, '[n](/n)' || chr(10) || chr(10) || {_article('**', '_', '  * ')} AS content FROM part")
def html_to_text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.html_to_text(fx.article_pages(spark, sf_dir))


@query("smart_document_articles", f"""
WITH t AS (SELECT p_partkey AS page_id, {_article('**', '_', '  * ')} AS content FROM part)
SELECT page_id, 'main' AS selector_used, content, length(content) AS content_length, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS word_count FROM t""")
def smart_document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.smart_document(fx.article_pages(spark, sf_dir)).drop("url", "title")


@query("heading_skips_levels", """
WITH l AS (SELECT c_custkey AS page_id, unnest([0, c_custkey % 6 + 1, c_custkey % 4 + 1]) AS previous_level, unnest([c_custkey % 6 + 1, c_custkey % 4 + 1, c_custkey % 5 + 1]) AS level,
  unnest([c_name, 'b', c_mktsegment]) AS text FROM customer)
SELECT page_id, CAST(previous_level AS BIGINT) AS previous_level, CAST(level AS BIGINT) AS level, text FROM l WHERE level - previous_level > 1""")
def heading_skips_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.heading_skips(fx.heading_pages(spark, sf_dir))
    return out.select("page_id", F.col("previous_level").cast("bigint").alias("previous_level"), F.col("level").cast("bigint").alias("level"), "text")


@query("a11y_heading_issues", """
WITH l AS (SELECT c_custkey AS page_id, unnest([0, c_custkey % 6 + 1, c_custkey % 4 + 1]) AS a, unnest([c_custkey % 6 + 1, c_custkey % 4 + 1, c_custkey % 5 + 1]) AS b FROM customer)
SELECT page_id, 'heading_skip' AS type, 'Heading level skipped from h' || a || ' to h' || b AS message FROM l WHERE b - a > 1""")
def a11y_heading_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.a11y_issues(fx.heading_pages(spark, sf_dir)).select("page_id", "type", "message")


@query("collapsible_details", """
SELECT c_custkey AS page_id, 'main' AS container, c_custkey % 3 AS details_closed, 1 AS aria_collapsed_blocks, c_custkey % 3 AS summary_closed, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS aria_controls,
  1 AS collapse_class, 2 AS more_button FROM customer""")
def collapsible_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.collapsible_census(fx.folded_pages(spark, sf_dir))
    # a collapsed button counts for its aria-expanded state as well as for its aria-controls
    return out.withColumn("aria_collapsed_blocks", F.col("aria_collapsed") - F.col("aria_controls")).drop("expanded", "aria_collapsed")


@query("aria_text_blocks", """
SELECT p_partkey AS page_id, unnest([0, 1, 2]) AS block_no, unnest([9, 2, 3]) AS n_lines FROM part""")
def aria_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.aria_blocks(fx.aria_texts(spark, sf_dir), "article")
    return out.select("page_id", F.col("block_no").cast("bigint").alias("block_no"), F.size("lines").cast("bigint").alias("n_lines"))


@query("aria_text_records", """
SELECT p_partkey AS page_id, 0 AS block_no, p_name AS name, '/p/' || p_partkey AS url, p_size || ' stars' AS stars, 'Python' AS language,
  'Updated on Mar ' || (p_size % 28 + 1) || ', 2024' AS updated, 'A long description of part ' || p_partkey || ' that goes on for a while' AS description FROM part
UNION ALL SELECT p_partkey, 1, NULL, NULL, p_size || 'k', NULL, NULL, NULL FROM part
UNION ALL SELECT p_partkey, 2, 'inner', NULL, NULL, NULL, '2 today', NULL FROM part""")
def aria_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aria.smart_records(fx.aria_texts(spark, sf_dir))
    return out.withColumn("block_no", F.col("block_no").cast("bigint"))


@query("url_list", "SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages) GROUP BY url")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    urls = pages(spark, sf_dir).select("url")
    lines = urls.unionByName(urls.select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("url"))).unionByName(urls.select(F.lit("  ").alias("url")))
    lines.write.text(folder)
    return readers.url_list(spark, folder).groupBy("url").agg(F.count("*").alias("n"))


@query("url_list_order", "SELECT url, 2 * row_number() OVER (ORDER BY page_id) - 1 AS line_no FROM pages")
def url_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one file, a blank one before each URL, keep their places over many splits of it."""
    folder = _folder(spark)
    lines = pages(spark, sf_dir).select("page_id", "url").coalesce(1).sortWithinPartitions("page_id")
    lines.select(F.explode(F.array(F.lit("  "), "url")).alias("line")).write.text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        return checkpointed(readers.url_list(spark, folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query("sink_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_json(table(spark, sf_dir, "customer"), folder)
    return spark.read.schema("c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE").json(folder)


@query("sink_csv_union", """
SELECT s_name AS name, '' AS note, '' AS segment FROM supplier UNION ALL SELECT '', 'say "hi", twice', c_mktsegment FROM customer""")
def sink_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    a = table(spark, sf_dir, "supplier").selectExpr("s_name AS name")
    b = table(spark, sf_dir, "customer").selectExpr("'say \"hi\", twice' AS note", "c_mktsegment AS segment")
    sinks.write_csv_union([a, b], folder)
    return spark.read.option("escape", '"').csv(folder, header=True, schema="name STRING, note STRING, segment STRING").na.fill("")


@query("sink_plain", "SELECT 'n_name: ' || n_name AS value FROM nation UNION ALL SELECT 'n_nationkey: ' || n_nationkey FROM nation")
def sink_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_plain(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), folder)
    return spark.read.text(folder)


@query("sink_crawl_pages", """
SELECT 'c_' || s_suppkey AS file, s_name AS title, s_suppkey % 3 AS depth FROM supplier
UNION ALL SELECT 'index', 'home', 1""")
def sink_crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = table(spark, sf_dir, "supplier").selectExpr("concat('https://a.example.com/c/', s_suppkey) AS url", "CAST(s_suppkey % 3 AS INT) AS depth", "s_name AS title")
    homes = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("k")).selectExpr("'https://a.example.com' AS url", "0 AS depth", "'first' AS title")
    again = homes.selectExpr("'https://a.example.com/' AS url", "1 AS depth", "'home' AS title")
    sinks.write_crawl_pages(rows.unionByName(homes).unionByName(again), folder)
    out = spark.read.schema("url STRING, depth BIGINT, title STRING, file STRING").json(folder)
    return out.select("file", "title", "depth")


@query("sink_named_documents", """
SELECT 'c_' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' ä+%' ELSE '' END AS file, '<h1>' || c_name || '</h1>' || chr(10) || c_mktsegment AS content FROM customer""")
def sink_named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer, written twice; the second job takes the place of the first."""
    folder = _folder(spark)
    name = "concat('c_', c_custkey, IF(c_custkey % 3 = 0, ' ä+%', ''))"
    rows = table(spark, sf_dir, "customer").selectExpr(f"{name} AS file", "concat('<h1>', c_name, '</h1>\n', c_mktsegment) AS content")
    rows = dealt(rows, "file")
    documents_sink.write_named(rows.withColumn("content", F.lit("old")), folder)
    documents_sink.write_named(rows, folder, overwrite=True)
    return documents_sink.read_named(spark, folder)


@query("sink_table_rows", """
SELECT s_suppkey || ',name,balance' AS value FROM supplier UNION ALL SELECT s_suppkey || ',' || s_name || ',"1,' || s_nationkey || '"' FROM supplier""")
def sink_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    html = "concat('<table><tr><th>name</th><th>balance</th></tr><tr><td>', s_name, '<td>1,', s_nationkey, '</table>')"
    docs = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS page_id", "'' AS url", f"{html} AS html")
    sinks.write_table_rows(tables.table_rows(docs, "table"), folder)
    return spark.read.text(folder)


@query("sink_export", """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS alt FROM part UNION ALL SELECT p_partkey, '' FROM part UNION ALL SELECT p_partkey, 'd' FROM part""")
def sink_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_export(fx.media_pages(spark, sf_dir), "images", folder)
    return spark.read.schema("page_id BIGINT, alt STRING").json(folder)


@query("sink_documents", "SELECT page_id, html FROM pages")
def sink_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_documents(pages(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("page_id", "html")


@query("map_pages", "SELECT page_id, length(url) AS n FROM pages")
def map_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lengths(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": batch["page_id"], "n": batch["url"].str.len()})

    return state.map_pages(pages(spark, sf_dir).select("page_id", "url"), lengths, "page_id BIGINT, n BIGINT")
