"""Forms and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.intervals import enclosing, last_reaching, nearest
from webloom.functions.selectors import enclosed_by, predicate
from webloom.functions.sqltext import doc_expr, let, lit
from webloom.functions.text import collapse_space, js_trim
from webloom.functions.urls import url_join
from webloom.operators.dom import attr, dom, rows_of, text

FIELDS = "input, textarea, select"


def _or_null(expr: str) -> str:
    return f"nullif({expr}, '')"


def field_type(y: str) -> str:
    multiple = f"IF({attr('multiple', y)} IS NULL, 'select-one', 'select-multiple')"
    return (
        f"CASE {y}.tag WHEN 'select' THEN {multiple} WHEN 'textarea' THEN 'textarea' "
        f"ELSE lower(coalesce({_or_null(attr('type', y))}, 'text')) END"
    )


def _field(y: str) -> str:
    options = (
        f"transform(filter({H.descendants(y)}, o -> o.tag = 'option'), o -> "
        + let(
            "label",
            js_trim(collapse_space(H.text_content("o"))),
            f"struct(coalesce({attr('value', 'o')}, label) AS value, label AS text)",
        )
        + ")"
    )
    chosen = (
        f"coalesce(get(filter({H.descendants(y)}, o -> o.tag = 'option' AND {attr('selected', 'o')} IS NOT NULL), 0), "
        f"get(filter({H.descendants(y)}, o -> o.tag = 'option'), 0))"
    )
    select_value = let(
        "o", chosen, f"IF(o IS NULL, NULL, coalesce({attr('value', 'o')}, {js_trim(collapse_space(H.text_content('o')))}))"
    )
    value = (
        f"CASE {y}.tag WHEN 'select' THEN {select_value} WHEN 'textarea' THEN {H.text_content(y)} "
        f"ELSE coalesce({attr('value', y)}, IF({field_type(y)} IN ('checkbox', 'radio'), 'on', '')) END"
    )
    return (
        f"struct({y}.s AS pos, {field_type(y)} AS type, {_or_null(attr('name', y))} AS name, {_or_null(attr('id', y))} AS id, "
        f"{_or_null(attr('placeholder', y))} AS placeholder, {attr('required', y)} IS NOT NULL AS required, "
        f"{_or_null(value)} AS value, IF({y}.tag = 'select', {options}, NULL) AS options)"
    )


def _fields_in(x: str) -> str:
    return f"transform(filter({H.descendants(x)}, y -> y.tag IN ('input', 'textarea', 'select')), y -> {_field('y')})"


def extract_forms(pages: DataFrame) -> DataFrame:
    """(page_id, form_no, id, name, action, method, type, selector, fields ARRAY<STRUCT>).

    Forms first, then role=form elements outside forms, then fields outside both, grouped by the nearest
    ancestor that has a name, a meaning of its own or several such fields; one running number per page.
    """
    doc = dom(pages)
    method = f"CASE WHEN lower({attr('method')}) IN ('post', 'dialog') THEN lower({attr('method')}) ELSE 'get' END"
    action = f"coalesce({_or_null(attr('action'))}, '')"
    forms = (
        f"transform(filter(els, x -> x.tag = 'form'), x -> struct({_or_null(attr('id'))} AS id, {_or_null(attr('name'))} AS name, "
        f"{let('ref', action, url_join('url', 'ref'))} AS action, {method} AS method, 'form' AS type, CAST(NULL AS STRING) AS selector, "
        f"{_fields_in('x')} AS fields))"
    )
    label = f"coalesce({_or_null(attr('aria-label'))}, {_or_null(attr('name'))})"
    by_id = f"concat(x.tag, coalesce(concat('#', {_or_null(attr('id'))}), ''))"
    none = "CAST(NULL AS STRING)"
    roles = (
        f"transform(filter(els, x -> {predicate('[role=form]')} AND x.tag <> 'form' AND NOT {enclosed_by('form')}), x -> "
        f"struct({_or_null(attr('id'))} AS id, {label} AS name, {none} AS action, {none} AS method, 'role-form' AS type, "
        f"{by_id} AS selector, {_fields_in('x')} AS fields))"
    )
    doc = doc.withColumn(
        "orphans", doc_expr(f"filter(els, x -> x.tag IN ('input', 'textarea', 'select') AND NOT {enclosed_by('form, [role=form]')})")
    )
    named = " OR ".join(f"coalesce({attr(a, 'a')}, '') <> ''" for a in ("id", "aria-label", "role"))
    every, page = enclosing("true"), enclosing("a.tag IN ('html', 'body')")
    # the innermost ancestor below the body that has a name or a meaning, or that holds the field before or the one behind as well
    telling = [
        nearest("x.i", enclosing(f"{named} OR a.tag NOT IN ('div', 'span')")),
        f"IF(j = 0, NULL, {last_reaching('get(orphans, j - 1).i', 'x.i', every)})",
        f"IF(j + 1 = size(orphans), NULL, {last_reaching('x.i', 'get(orphans, j + 1).i', every)})",
    ]
    group = let("top", f"coalesce({nearest('x.i', page)}, -1)", f"array_max(filter(array({', '.join(telling)}), u -> u > top))")
    doc = doc.withColumn(
        "grouped",
        doc_expr(f"transform(orphans, (x, j) -> struct(coalesce({group}, nullif(x.p, -1), x.i) AS g, {_field('x')} AS field))"),
    )
    first_class = f"concat('.', get(split({js_trim(f"coalesce({attr('class')}, '')")}, ' +'), 0))"
    css = (
        f"concat(x.tag, CASE WHEN coalesce({attr('id')}, '') <> '' THEN concat('#', {attr('id')}) "
        f"WHEN coalesce({attr('class')}, '') <> '' THEN {first_class} ELSE '' END)"
    )
    implicit = (
        "transform(transform(array_distinct(transform(grouped, o -> o.g)), g -> struct(els[g] AS el, "
        "transform(filter(grouped, o -> o.g = g), o -> o.field) AS fields)), w0 -> "
        + let(
            "x",
            "w0.el",
            f"struct({_or_null(attr('id'))} AS id, {label} AS name, {none} AS action, {none} AS method, 'implicit' AS type, "
            f"{css} AS selector, w0.fields AS fields)",
        )
        + ")"
    )
    out = doc.select("page_id", F.posexplode_outer(doc_expr(f"concat({forms}, {roles}, {implicit})")).alias("form_no", "f"))
    return out.where("f IS NOT NULL").select("page_id", "form_no", "f.*")


def form_fields(pages: DataFrame) -> DataFrame:
    """(page_id, form_no, form_type, field columns): one row per field."""
    out = extract_forms(pages).select("page_id", "form_no", F.col("type").alias("form_type"), F.explode_outer("fields").alias("field"))
    return out.where("field IS NOT NULL").select("page_id", "form_no", "form_type", "field.*")


def match_form_fields(pages: DataFrame, wanted: list[str], form: str = "form") -> DataFrame:
    """(page_id, wanted, matched_by, pos, tag): the field a name binds to inside the first form, first rule that hits wins.

    Rules in order: label text, input name, input id, textarea name, textarea id, select name, then aria-label,
    placeholder and data-testid containing the name in any case.  Names that bind to nothing are kept with NULLs.
    """
    def contains(name: str, w: str) -> str:
        return f"contains(lower(coalesce({attr(name, 'y')}, '')), lower({w}))"

    def equals(name: str, w: str) -> str:
        return f"coalesce({attr(name, 'y')} = {w}, false)"

    w = "want"
    label_for = (
        f"get(transform(slice(filter(els, x -> x.tag = 'label' AND contains(lower({text()}), lower({w}))), 1, 1), x -> {attr('for')}), 0)"
    )
    rules = [
        ("label", f"label_for <> '' AND {equals('id', 'label_for')}"),
        ("input name", f"y.tag = 'input' AND {equals('name', w)}"),
        ("input id", f"y.tag = 'input' AND {equals('id', w)}"),
        ("textarea name", f"y.tag = 'textarea' AND {equals('name', w)}"),
        ("textarea id", f"y.tag = 'textarea' AND {equals('id', w)}"),
        ("select name", f"y.tag = 'select' AND {equals('name', w)}"),
        ("input aria-label", f"y.tag = 'input' AND {contains('aria-label', w)}"),
        ("textarea aria-label", f"y.tag = 'textarea' AND {contains('aria-label', w)}"),
        ("input placeholder", f"y.tag = 'input' AND {contains('placeholder', w)}"),
        ("textarea placeholder", f"y.tag = 'textarea' AND {contains('placeholder', w)}"),
        ("data-testid", contains("data-testid", w)),
    ]
    inside = f"flatten(transform(slice(filter(els, x -> {predicate(form)}), 1, 1), x -> {H.descendants('x')}))"
    hits = ", ".join(
        f"get(transform(slice(filter(inside, y -> {rule}), 1, 1), y -> struct({lit(name)} AS matched_by, y.s AS pos, y.tag AS tag)), 0)"
        for name, rule in rules
    )
    hit = let("label_for", label_for, f"struct(want AS wanted, coalesce({hits}) AS h)")
    names = f"array({', '.join(lit(n) for n in wanted)})"
    out = rows_of(dom(pages).withColumn("inside", doc_expr(inside)), f"transform({names}, want -> {hit})", "page_id")
    return out.select("page_id", "wanted", "h.matched_by", "h.pos", "h.tag")


def labelled(y: str) -> str:
    """True when a label names the field: ``for`` its id, or around it.  Needs the array ``label_ids``."""
    by_for = f"coalesce({attr('id', y)}, '') <> '' AND array_contains(label_ids, {attr('id', y)})"
    return f"(({by_for}) OR {enclosed_by('label', y)})"


LABEL_IDS = f"filter(transform(filter(els, x -> x.tag = 'label'), x -> coalesce({attr('for')}, '')), f -> f <> '')"


def input_labels(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, id, has_label) per field that can carry a label."""
    doc = dom(pages).withColumn("label_ids", doc_expr(LABEL_IDS))
    rows = (
        f"transform(filter(els, y -> y.tag IN ('input', 'textarea', 'select') AND {field_type('y')} <> 'hidden'), "
        f"y -> struct(y.s AS pos, y.tag AS tag, coalesce({attr('id', 'y')}, '') AS id, {labelled('y')} AS has_label))"
    )
    return rows_of(doc, rows, "page_id")
