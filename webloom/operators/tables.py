"""HTML tables and repeated records as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.selectors import alternatives, predicate
from webloom.functions.sqltext import doc_expr, let, lit, quoted
from webloom.operators.dom import count_of, dom, rows_of, text

# Selectors tried in this order when a table selector gives no data rows.
TABLE_FALLBACKS = [
    ".wikitable",
    ".sortable",
    ".dataframe",
    "table.data",
    "[role='table']",
    ".table",
    "table[class]",
    "table",
]


def _is_cell(v: str, tags: str = "'th', 'td'") -> str:
    return f"{v}.tag IN ({tags})"


def _table(x: str) -> str:
    """STRUCT<headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>>: body rows hold their td cells only."""
    cells = f"transform(filter({H.descendants('tr')}, c -> {_is_cell('c')}), c -> struct(c.tag AS tag, {text('c')} AS text))"
    rows = f"transform(filter({H.descendants(x)}, y -> y.tag = 'tr'), tr -> {cells})"
    return let(
        "rs",
        rows,
        "struct(coalesce(transform(get(rs, 0), c -> c.text), CAST(array() AS array<string>)) AS headers, "
        "transform(slice(rs, 2, size(rs)), r -> transform(filter(r, c -> c.tag = 'td'), c -> c.text)) AS rows)",
    )


def extract_tables(pages: DataFrame, selector: str = "table", headers: list[str] | None = None) -> DataFrame:
    """(page_id, table_no, headers, rows ARRAY<MAP>) for every match, empty tables included.

    Body cells are named by position; missing ones are '', the last of duplicate headers wins.  ``headers`` replaces
    the header list only, the row keys stay as detected.
    """
    tables = f"transform(filter(els, x -> {predicate(selector)}), x -> {_table('x')})"
    doc = dom(pages)
    out = doc.select("page_id", F.posexplode_outer(doc_expr(tables)).alias("table_no", "t")).where("t IS NOT NULL")
    shown = doc_expr("t.headers") if headers is None else F.array(*[F.lit(h) for h in headers])
    return out.select("page_id", "table_no", shown.alias("headers"), doc_expr(_row_maps("t")).alias("rows"))


def _row_maps(t: str) -> str:
    keys = f"array_distinct({t}.headers)"
    last = f"size({t}.headers) - array_position(reverse({t}.headers), k)"
    return (
        f"transform({t}.rows, r -> map_from_arrays({keys}, "
        f"transform({keys}, k -> coalesce(get(r, CAST({last} AS INT)), ''))))"
    )


def table_cells(pages: DataFrame, selector: str = "table") -> DataFrame:
    """(page_id, table_no, row_no, header, cell): the tables in long form."""
    tables = extract_tables(pages, selector)
    rows = tables.select("page_id", "table_no", F.posexplode_outer("rows").alias("row_no", "row")).where("row IS NOT NULL")
    return rows.select("page_id", "table_no", "row_no", F.explode_outer("row").alias("header", "cell")).where("header IS NOT NULL")


def table_with_fallback(pages: DataFrame, selector: str | None = None, headers: list[str] | None = None) -> DataFrame:
    """The first table with a data row per page: the selector's first match, else the fallbacks in order.

    (page_id, selector_used, note, headers, rows, error, tables_on_page); one row per page, ``error`` set where none fits.
    """
    tried = ([selector] if selector else []) + TABLE_FALLBACKS

    def candidate(sel: str) -> str:
        hit = f"slice(filter(els, x -> {predicate(sel)}), 1, 1)"
        return f"get(filter(transform({hit}, x -> struct({lit(sel)} AS sel, {_table('x')} AS t)), c -> size(c.t.rows) > 0), 0)"

    chosen = dom(pages).select(
        "page_id", doc_expr(f"coalesce({', '.join(candidate(s) for s in tried)})").alias("c"), doc_expr(count_of("table")).alias("tables_on_page")
    )
    note, missing = "CAST(NULL AS STRING)", "'No table found on page'"
    if selector:
        note = f"IF(c.sel <> {lit(selector)}, concat({lit(f"Selector '{selector}' not found — used auto-detected '")}, c.sel, {lit("' instead")}), NULL)"
        missing = lit(f"No table found with selector '{selector}' or any fallback")
    shown = doc_expr("c.t.headers") if headers is None else F.when(doc_expr("c IS NOT NULL"), F.array(*[F.lit(h) for h in headers]))
    return chosen.select(
        "page_id",
        doc_expr("c.sel").alias("selector_used"),
        doc_expr(note).alias("note"),
        shown.alias("headers"),
        doc_expr(_row_maps("c.t")).alias("rows"),
        doc_expr(f"IF(c IS NULL, {missing}, NULL)").alias("error"),
        "tables_on_page",
    )


def table_rows(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, row_no, cells ARRAY): every row of the first match, header row included, ragged rows as they are."""
    cells = f"transform(filter({H.descendants('tr')}, c -> {_is_cell('c')}), c -> {text('c')})"
    rows = (
        f"flatten(transform(slice(filter(els, x -> {predicate(selector)}), 1, 1), "
        f"x -> transform(filter({H.descendants('x')}, y -> y.tag = 'tr'), tr -> {cells})))"
    )
    return dom(pages).select("page_id", F.posexplode_outer(doc_expr(rows)).alias("row_no", "cells")).where("cells IS NOT NULL")


def extract_records(pages: DataFrame, container: str, fields: dict[str, str] | str) -> DataFrame:
    """(page_id, pos, one column per field): a record per container, containers without any field kept.

    A field is a comma-separated list of selectors tried in order: the first whose first match inside the container has
    text gives the value, else NULL.  ``fields`` may be the JSON text of the mapping.
    """
    if isinstance(fields, str):
        try:
            fields = json.loads(fields)
        except json.JSONDecodeError as error:
            raise ValueError(f"fields must be valid JSON: {error}") from error

    def value(chain: str) -> str:
        tries = [
            f"nullif(get(transform(slice(filter({H.descendants('x')}, y -> {predicate(s, 'y')}), 1, 1), y -> {text('y')}), 0), '')"
            for s in alternatives(chain)
        ]
        return f"coalesce({', '.join(tries)})"

    record = ", ".join(f"{value(chain)} AS {quoted(name)}" for name, chain in fields.items())
    records = f"transform(filter(els, x -> {predicate(container)}), x -> struct(x.s AS pos, {record}))"
    return rows_of(dom(pages), records, "page_id")
