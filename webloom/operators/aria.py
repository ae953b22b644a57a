"""Accessibility snapshots: building them from pages, splitting them into blocks, reading records from blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.intervals import count_enclosing, enclosing
from webloom.functions.sqltext import doc_expr, let, lit
from webloom.functions.text import collapse_space, has_date, js_trim
from webloom.functions import html as H
from webloom.operators.dom import attr, dom

# Implied roles of HTML tags.
ROLES = {
    "article": "article", "nav": "navigation", "main": "main", "aside": "complementary", "header": "banner",
    "footer": "contentinfo", "form": "form", "table": "table", "tr": "row", "td": "cell", "th": "columnheader",
    "ul": "list", "ol": "list", "li": "listitem", "p": "paragraph", "a": "link", "button": "button", "img": "img",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
}
NAMED_ROLES = ["heading", "link", "button", "img"]
# Capitalised words that are not programming languages.
NOT_LANGUAGES = [
    "Star", "Sponsor", "Built", "Watch", "Fork", "Code", "Issues", "Pull", "Actions", "Projects", "Wiki", "Security", "Insights",
]
RECORD_FIELDS = ["name", "url", "stars", "language", "updated", "description"]
STARS_PATTERN = r"(?i)\b\d[\d,]*(?:\.\d+)?k?\b"


def _role(x: str) -> str:
    by_tag = "CASE " + " ".join(f"WHEN {x}.tag = {lit(t)} THEN {lit(r)}" for t, r in ROLES.items()) + " END"
    return f"coalesce(nullif({attr('role', x)}, ''), {by_tag})"


def aria_snapshot(pages: DataFrame) -> DataFrame:
    """(page_id, snapshot): indented tree of roles; headings, links, buttons and images carry their name in quotes."""
    doc = dom(pages).withColumn("roles", doc_expr(f"transform(els, x -> {_role('x')})"))
    indent = f"repeat('  ', {count_enclosing('x.i', enclosing('roles[a.i] IS NOT NULL'))})"
    name = js_trim(collapse_space(f"IF(x.tag = 'img', coalesce({attr('alt')}, ''), {H.text_content('x')})"))
    level = "IF(roles[x.i] = 'heading' AND x.tag RLIKE '^h[1-6]$', concat(' [level=', substr(x.tag, 2), ']'), '')"
    named = f"IF(n = '', '', concat(' \"', replace(n, '\"', {lit(chr(39))}), '\"'))"
    line = (
        f"concat({indent}, '- ', roles[x.i], CASE WHEN roles[x.i] IN ({', '.join(lit(r) for r in NAMED_ROLES)}) THEN "
        f"concat({let('n', name, named)}, {level}) "
        f"WHEN roles[x.i] IN ('paragraph', 'cell', 'columnheader') THEN {let('n', name, 'concat(chr(58), chr(32), n)')} ELSE ':' END)"
    )
    lines = f"transform(filter(els, x -> roles[x.i] IS NOT NULL), x -> {line})"
    return doc.select("page_id", doc_expr(f"array_join({lines}, '\\n')").alias("snapshot"))


def _indent(line: str) -> str:
    return f"(length({line}) - length(ltrim({line})))"


def _blocks(lines: str, role: str) -> str:
    """array<array<string>>: a line '- role' starts a block, deeper and blank lines continue it, any other line ends it."""
    starts_here = rf"^\s*- (?i:{role})\b"
    stop = f"filter(transform(rest, (b, j) -> IF(trim(b) <> '' AND {_indent('b')} <= {_indent('ls[st]')}, j, -1)), j -> j >= 0)"
    body = let(
        "rest",
        "slice(ls, st + 2, coalesce(get(starts, k + 1), size(ls)) - st - 1)",
        f"concat(array(ls[st]), slice(rest, 1, coalesce(get({stop}, 0), size(rest))))",
    )
    starts = f"filter(transform(ls, (l, j) -> IF(l RLIKE {lit(starts_here)}, j, -1)), j -> j >= 0)"
    return let("ls", lines, let("starts", starts, f"transform(starts, (st, k) -> {body})"))


def aria_blocks(snapshots: DataFrame, role: str) -> DataFrame:
    """(page_id, block_no, lines ARRAY) of every block of a role; a nested start closes the outer block."""
    blocks = _blocks("split(snapshot, '\\n')", role)
    out = snapshots.select("page_id", F.posexplode_outer(doc_expr(blocks)).alias("block_no", "lines"))
    return out.where("lines IS NOT NULL")


def container_blocks(snapshots: DataFrame, container: str = "article") -> DataFrame:
    """(page_id, container_used, block_no, lines): blocks of the container role, else of the usual substitutes.

    article falls back to listitem, article and listitem to row, anything to generic blocks with a heading and a paragraph or
    link.  Pages without blocks give no rows.
    """
    tries = [container]
    if container.lower() == "article":
        tries.append("listitem")
    if container.lower() in ("article", "listitem"):
        tries.append("row")

    def some(blocks: str, role: str) -> str:
        return let("bl", blocks, f"IF(size(bl) > 0, struct({lit(role)} AS container_used, bl AS blocks), NULL)")

    generic = (
        f"filter({_blocks('lines', 'generic')}, bl -> array_join(bl, '\\n') RLIKE {lit(r'(?i)\bheading\b')} "
        f"AND array_join(bl, '\\n') RLIKE {lit(r'(?i)\bparagraph\b|\blink\b')})"
    )
    picks = [some(_blocks("lines", r), r) for r in tries] + [some(generic, "generic")]
    doc = snapshots.withColumn("lines", doc_expr("split(snapshot, '\\n')")).withColumn("c", doc_expr(f"coalesce({', '.join(picks)})"))
    out = doc.select("page_id", doc_expr("c.container_used").alias("container_used"), F.posexplode_outer("c.blocks").alias("block_no", "lines"))
    return out.where("lines IS NOT NULL")


def smart_records(snapshots: DataFrame, container: str = "article", fields: list[str] | None = None, limit: int = 0) -> DataFrame:
    """(page_id, block_no, one column per field): records read from accessibility blocks by plain rules.

    ``limit`` keeps the first blocks per page before any field is read; 0 keeps all.
    """
    blocks = container_blocks(snapshots, container)
    if limit:
        blocks = blocks.where(F.col("block_no") < limit)
    quoted = lit(r'"([^"]+)"')
    plain = f"regexp_extract(l, {lit(r'^\s+-\s+\w[^:]*:\s+(.+)')}, 1)"
    texts = (
        f"flatten(transform(lines, l -> concat(transform(regexp_extract_all(l, {quoted}, 1), q -> {js_trim('q')}), "
        f"filter(array(btrim({js_trim(plain)}, '\"')), q -> q <> ''))))"
    )
    df = blocks.withColumn("texts", doc_expr(texts))

    def first_line(pattern: str) -> str:
        return f"nullif({js_trim(f"regexp_extract(get(filter(lines, l -> l RLIKE {lit(pattern)} AND l RLIKE {quoted}), 0), {quoted}, 1)")}, '')"

    language_label = f"nullif({js_trim(f"regexp_extract(get(filter(lines, l -> contains(lower(l), 'language') AND l RLIKE {quoted}), 0), {quoted}, 1)")}, '')"
    token = f"btrim({js_trim(f"regexp_extract(l, {lit(r'^\s+-\s+(?:text|generic)(?:\s+\[.*?\])?:\s*(.+)')}, 1)")}, '\"')"
    language_token = (
        f"get(filter(transform(lines, l -> {token}), v -> v RLIKE '^[A-Z][a-zA-Z0-9+#.]*$' AND length(v) <= 20 "
        f"AND NOT array_contains(array({', '.join(lit(w) for w in NOT_LANGUAGES)}), v)), 0)"
    )
    stars = (
        f"coalesce(get(filter(texts, v -> contains(lower(v), 'star') AND v RLIKE {lit(STARS_PATTERN)}), 0), "
        f"get(filter(texts, v -> trim(v) RLIKE {lit(r'(?i)^\d[\d,]*(?:\.\d+)?k?$')}), 0))"
    )
    updated = f"coalesce(get(filter(texts, v -> contains(lower(v), 'today')), 0), get(filter(texts, v -> {has_date('v')}), 0))"
    values = {
        "name": first_line(r"(?i)heading\s"),
        "url": first_line(r"(?i)^\s+-\s+link\b"),
        "stars": stars,
        "language": f"coalesce({language_label}, {language_token})",
        "updated": updated,
    }
    other = {"title": "name", "link": "url"}
    wanted = fields or RECORD_FIELDS
    for short, full in other.items():
        if short in wanted and full not in wanted:
            values[short] = values.pop(full)
    captured = [f for f in wanted if f in values]
    for f in captured:
        df = df.withColumn(f, doc_expr(values[f]))
    if "description" in wanted:
        taken = "array(" + ", ".join(f"`{f}`" for f in captured) + ")" if captured else "CAST(array() AS array<string>)"
        candidates = f"filter(texts, v -> length(v) > 30 AND NOT coalesce(array_contains({taken}, v), false))"
        longest = let("cs", candidates, "get(filter(cs, v -> length(v) = array_max(transform(cs, u -> length(u)))), 0)")
        df = df.withColumn("description", doc_expr(longest))
    for f in wanted:
        if f not in captured and f != "description":
            df = df.withColumn(f, F.lit(None).cast("string"))
    return df.select("page_id", "block_no", *wanted)
