"""Writers for records, tables, crawl results and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.crawl import crawl_documents
from webloom.operators.dom import dom, select, attr, text
from webloom.operators.extract import extract_images, extract_text
from webloom.functions.sqltext import let
from webloom.functions.urls import url_join


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def csv_union(parts: list[DataFrame]) -> DataFrame:
    """All rows with the union of the columns in first-seen order, as text, missing values ''."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.select([F.col(c).cast("string").alias(c) for c in merged.columns]).na.fill("")


def write_csv_union(parts: list[DataFrame], path: str, mode: str = "error") -> None:
    """The union as CSV with a header; nothing is written when there are no columns."""
    merged = csv_union(parts)
    if merged.columns:
        merged.write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def plain_lines(df: DataFrame) -> DataFrame:
    """(value): 'column: value' lines of a record set, or the items alone for a single column."""
    if len(df.columns) == 1:
        return df.select(F.col(df.columns[0]).cast("string").alias("value"))
    lines = F.array(*[F.concat_ws(": ", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns])
    return df.select(F.explode(lines).alias("value"))


def write_plain(df: DataFrame, path: str, mode: str = "error") -> None:
    plain_lines(df).write.mode(mode).text(path)


def write_crawl_pages(crawled: DataFrame, path: str, mode: str = "error", folders: bool = False) -> None:
    """The JSON document of each crawled page with its file name; ``folders`` gives every name a folder of its own.

    Folders are for small crawls: a large corpus is better kept as one dataset with the name as a column.
    """
    writer = crawl_documents(crawled).write.mode(mode)
    (writer.partitionBy("file") if folders else writer).json(path)


def csv_line(cells: str = "cells") -> str:
    """One CSV line from an array of cells, quoted where a cell needs it."""
    quoted = "concat('\"', replace(c, '\"', '\"\"'), '\"')"
    return f"array_join(transform({cells}, c -> IF(c RLIKE '[\",\\\\r\\\\n]', {quoted}, c)), ',')"


def write_table_rows(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Rows of table_rows as CSV text, the page_id in front, ragged rows as they are and in order per page."""
    lines = rows.withColumn("value", F.expr(f"concat(page_id, ',', {csv_line()})"))
    lines.repartition("page_id").sortWithinPartitions("page_id", "row_no").select("value").write.mode(mode).text(path)


def export(pages: DataFrame, kind: str, selector: str | None = None) -> DataFrame:
    """Rows to export: 'links' (absolute href, text), 'images' (absolute src, alt) or 'text' of a selector."""
    if kind == "links":
        href = let("ref", attr("href"), url_join("url", "ref"))
        return select(dom(pages, ["a"]), "a[href]", {"href": href, "text": text()})
    if kind == "images":
        return extract_images(pages)
    if kind == "text":
        return extract_text(pages, selector or "body")
    raise ValueError(f"unknown export kind: {kind!r}")


def write_export(pages: DataFrame, kind: str, path: str, format: str = "json", selector: str | None = None, mode: str = "error") -> None:
    rows = export(pages, kind, selector)
    if format == "csv":
        write_csv_union([rows], path, mode)
    elif format == "json":
        write_json(rows, path, mode)
    else:
        raise ValueError(f"unknown export format: {format!r}")


def write_documents(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """HTML, text or Markdown documents, one row per page; ``text`` writes the column ``content`` alone, a form feed line behind each."""
    if format == "text":
        df.select(F.concat("content", F.lit("\n\f")).alias("value")).where("value IS NOT NULL").write.mode(mode).text(path)
        return
    if format not in ("parquet", "json"):
        raise ValueError(f"unknown document format: {format!r}")
    df.write.mode(mode).format(format).save(path)
