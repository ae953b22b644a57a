"""One-look overview of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webloom.functions import html as H
from webloom.functions.selectors import predicate
from webloom.functions.sqltext import cut, doc_expr, first_few, in_list, let, lit
from webloom.functions.text import js_trim
from webloom.functions.urls import is_internal, url_join
from webloom.operators.dom import attr, count_of, dom, has, rows_of, tagged, text
from webloom.operators.forms import field_type

# Selectors whose presence is reported.
KEY_SELECTORS = [
    "h1", "h2", "h3", "p", "table", "form", "input", "button", "nav", "main", "article", "section", "aside", "footer",
    ".content", "#content", "#main", "[role='main']", ".container", "ul li", "ol li", ".card", ".item", ".row",
]
# Marks of single-page applications.
SPA_ROOTS = "#root, #app, #__next, [data-reactroot], [ng-app], [data-v-app]"
SPA_SCRIPTS = "script[src*='react'], script[src*='vue'], script[src*='angular']"
SPA_GLOBALS = ["__NEXT_DATA__", "__nuxt"]


def _css(x: str, with_id: bool = True) -> str:
    """tag#id or tag.firstClass"""
    first_class = f"get(split({js_trim(f'coalesce({attr("class", x)}, {lit("")})')}, '[ \\\\t\\\\r\\\\n\\\\f]+'), 0)"
    by_class = f"IF(coalesce({attr('class', x)}, '') <> '', concat('.', {first_class}), '')"
    if not with_id:
        return f"concat({x}.tag, {by_class})"
    return f"concat({x}.tag, IF(coalesce({attr('id', x)}, '') <> '', concat('#', {attr('id', x)}), {by_class}))"


def recon(pages: DataFrame, max_fields: int | None = None, max_headings: int | None = None, heading_length: int | None = None) -> DataFrame:
    """One row per page: title, page type, headings, forms, tables, link and image counts; limits apply only where given."""
    doc = dom(pages)
    field_name = (
        f"coalesce(nullif({attr('name', 'y')}, ''), nullif({attr('id', 'y')}, ''), nullif({attr('placeholder', 'y')}, ''), {field_type('y')})"
    )
    fields = f"filter({H.descendants('x')}, y -> y.tag IN ('input', 'textarea', 'select'))"
    action = let("ref", f"coalesce({attr('action')}, '')", url_join("url", "ref"))
    method = f"upper(CASE WHEN lower({attr('method')}) IN ('post', 'dialog') THEN lower({attr('method')}) ELSE 'get' END)"
    forms = (
        f"transform(filter(els, x -> {predicate("form, [role='form']")}), (x, n) -> struct(n AS index, {_css('x')} AS selector, "
        f"IF(x.tag = 'form', {action}, NULL) AS action, IF(x.tag = 'form', {method}, 'GET') AS method, size({fields}) AS field_count, "
        f"transform({first_few(fields, max_fields)}, y -> {field_name}) AS field_names))"
    )
    first_row = f"get(filter({H.descendants('x')}, y -> y.tag = 'tr'), 0)"
    tables = (
        f"transform(filter(els, x -> x.tag = 'table'), (x, n) -> struct(n AS index, {_css('x', False)} AS selector, "
        f"CAST(size(filter({H.descendants('x')}, y -> y.tag = 'tr')) AS BIGINT) AS rows, "
        + let("r", first_row, f"CAST(IF(r IS NULL, 0, size(filter({H.descendants('r')}, y -> y.tag IN ('th', 'td')))) AS BIGINT)")
        + " AS cols))"
    )
    headings = (
        f"transform({first_few('filter(els, x -> ' + predicate('h1, h2, h3') + ')', max_headings)}, "
        f"x -> struct(upper(x.tag) AS tag, {cut(text(), heading_length)} AS text))"
    )
    hrefs = let("ref", attr("href"), url_join("url", "ref"))
    globals_ = " OR ".join(f"contains(t, {lit(g)})" for g in SPA_GLOBALS)
    spa = f"({has(SPA_ROOTS)} OR {has(SPA_SCRIPTS)} OR exists(toks, t -> {in_list('lower(substr(t, 1, 7))', ['<script'])} AND ({globals_})))"
    out = doc.select(
        "page_id",
        "url",
        doc_expr(H.title("toks")).alias("title"),
        doc_expr(spa).alias("spa_indicators"),
        doc_expr(headings).alias("headings"),
        doc_expr(forms).alias("forms"),
        doc_expr(tables).alias("tables"),
        doc_expr(f"transform(filter(els, x -> x.tag = 'a' AND {attr('href')} IS NOT NULL), x -> {hrefs})").alias("hrefs"),
        doc_expr(count_of("img")).alias("images_total"),
        doc_expr(f"CAST(size(filter(els, x -> x.tag = 'img' AND coalesce({attr('alt')}, '') = '')) AS BIGINT)").alias("images_missing_alt"),
    )
    internal = is_internal("h", "url")
    out = out.withColumns(
        {
            "links_total": doc_expr("CAST(size(hrefs) AS BIGINT)"),
            "links_internal": doc_expr(f"CAST(size(filter(hrefs, h -> {internal})) AS BIGINT)"),
            "links_external": doc_expr(f"CAST(size(filter(hrefs, h -> NOT {internal} AND NOT startswith(h, 'javascript:'))) AS BIGINT)"),
            "page_type": doc_expr(
                "CASE WHEN spa_indicators THEN 'spa' WHEN size(forms) > 0 AND size(hrefs) < 10 THEN 'form' "
                "WHEN size(tables) > 0 THEN 'data' ELSE 'static' END"
            ),
        }
    )
    return out.drop("hrefs")


def key_selectors(pages: DataFrame) -> DataFrame:
    """(page_id, probe_no, selector, n): the probe selectors that match, in probe order."""
    probes = ", ".join(f"struct({i} AS probe_no, {lit(s)} AS selector, {count_of(s)} AS n)" for i, s in enumerate(KEY_SELECTORS))
    return rows_of(dom(pages), f"array({probes})", "page_id").where("n > 0")


def element_selectors(pages: DataFrame, selector: str, kind: str) -> DataFrame:
    """(page_id, pos, selector): a short selector per match.

    ``click`` prefers the id, then the first class, then the tag; ``input`` the id, then the name, then the tag; ``overview``
    puts the id or first class behind the tag.
    """
    first_class = f"get(split({attr('class')}, ' '), 0)"
    by_id = f"coalesce({attr('id')}, '') <> ''"
    derived = {
        "click": f"CASE WHEN {by_id} THEN concat('#', {attr('id')}) WHEN coalesce({attr('class')}, '') <> '' THEN concat('.', {first_class}) ELSE x.tag END",
        "input": f"CASE WHEN {by_id} THEN concat('#', {attr('id')}) WHEN coalesce({attr('name')}, '') <> '' THEN concat('[name=\"', {attr('name')}, '\"]') ELSE x.tag END",
        "overview": _css("x"),
    }[kind]
    rows = f"transform(filter(els, x -> {predicate(selector)}), x -> struct(x.s AS pos, {derived} AS selector))"
    return rows_of(tagged(pages, selector), rows, "page_id")
