"""Main content, readable text, Markdown and collapsed elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.intervals import count_enclosing, enclosing, inside, nearest
from webloom.functions.selectors import enclosed_by, predicate
from webloom.functions.sqltext import doc_expr, in_list, let, lit
from webloom.functions.text import collapse_space, decode_entities, js_trim, word_count
from webloom.operators.dom import attr, count_of, dom, has, keep_pages, tagged, text

# Main-content selectors in the order they are tried.
CONTENT_SELECTORS = [
    "main article", "article", "main", "[role='main']", ".main-content", "#main-content",
    ".content", "#content", ".article", "#article",
    ".post-content", ".entry-content", ".page-content",
]
# Containers, navigation areas and toggles looked at for collapsed elements.
EXPAND_CONTAINERS = ["main", "article", "[role='main']", ".main-content", "#content"]
NAVIGATION = "nav, [role='navigation'], header, aside, .sidebar, .nav, .menu"
COLLAPSE_SELECTORS = [
    ".collapsed", ".accordion-button.collapsed",
    "[data-bs-toggle='collapse']:not(.show)",
    ".collapsible:not(.active)", ".expandable:not(.expanded)",
]
EXPAND_TEXTS = ["show more", "read more", "expand all", "see all", "load more", "view all"]
MIN_CONTENT = 200


def _first_long(selectors: list[str]) -> str:
    """STRUCT<sel, x>: first selector whose first match has more than MIN_CONTENT characters of trimmed text."""
    tries = [
        f"get(filter(transform(slice(filter(els, x -> {predicate(s)}), 1, 1), x -> struct({lit(s)} AS sel, x AS x)), "
        f"c -> length({js_trim(H.text_content('c.x'))}) > {MIN_CONTENT}), 0)"
        for s in selectors
    ]
    return f"coalesce({', '.join(tries)})"


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, url, selector_used, html): inner HTML of the main content, the whole page when none is long enough."""
    doc = _with_main(pages)
    return doc.select("page_id", "url", "selector_used", doc_expr(f"coalesce({H.inner_html('toks', 'main.x')}, array_join(toks, ''))").alias("html"))


def _with_main(pages: DataFrame) -> DataFrame:
    doc = dom(pages).withColumn("main", doc_expr(_first_long(CONTENT_SELECTORS)))
    return doc.withColumn("selector_used", doc_expr("coalesce(main.sel, 'body')"))


# Text styles of the readable form and of Markdown.
_STYLE = {
    "text": {"em": "_", "strong": "**", "bullet": "  * ", "indent": "  "},
    "markdown": {"em": "*", "strong": "**", "bullet": "* ", "indent": "  "},
}


def _rendered(style: str, scope: str) -> str:
    """Readable text of the elements and text tokens inside ``scope`` (a struct with s, e, i, z).

    Every element start, element end and text token becomes a fragment with its position; the sorted fragments
    joined give the text.
    """
    st = _STYLE[style]
    heading = in_list("x.tag", ["h1", "h2", "h3", "h4", "h5", "h6"])
    blocks = in_list("x.tag", "p div section article main header footer nav aside table ul ol dl blockquote figure form address pre details fieldset center".split())
    depth = count_enclosing("x.i", enclosing("a.tag IN ('ul', 'ol')"))
    bullet = (
        f"concat(repeat({lit(st['indent'])}, greatest({depth} - 1, 0)), "
        f"IF(coalesce(get(els, x.p).tag = 'ol', false), concat(x.item, '. '), {lit(st['bullet'])}))"
    )
    image = f"concat('![', coalesce({attr('alt')}, ''), '](', coalesce({attr('src')}, ''), ')')"
    opens = (
        f"CASE WHEN {heading} THEN concat('\\n\\n', repeat('#', CAST(substr(x.tag, 2) AS INT)), ' ')"
        f" WHEN x.tag = 'li' THEN concat('\\n', {bullet})"
        f" WHEN x.tag = 'br' THEN '  \\n' WHEN x.tag = 'hr' THEN '\\n\\n---\\n\\n'"
        f" WHEN x.tag IN ('b', 'strong') THEN {lit(st['strong'])} WHEN x.tag IN ('i', 'em') THEN {lit(st['em'])}"
        f" WHEN x.tag = 'a' AND coalesce({attr('href')}, '') <> '' THEN '['"
        f" WHEN x.tag = 'img' THEN {image} WHEN x.tag = 'code' THEN '`'"
        f" WHEN x.tag = 'tr' THEN '\\n' WHEN x.tag IN ('td', 'th') THEN '| '"
        f" WHEN {blocks} THEN '\\n\\n' ELSE '' END"
    )
    closes = (
        f"CASE WHEN x.tag = 'a' AND coalesce({attr('href')}, '') <> '' THEN concat('](', {attr('href')}, ')')"
        f" WHEN x.tag IN ('b', 'strong') THEN {lit(st['strong'])} WHEN x.tag IN ('i', 'em') THEN {lit(st['em'])}"
        f" WHEN x.tag = 'code' THEN '`' WHEN x.tag IN ('td', 'th') THEN ' ' WHEN {heading} OR {blocks} THEN '\\n\\n' ELSE '' END"
    )
    inner = f"slice(els, {scope}.i + 2, {scope}.z - {scope}.i - 1)"
    # what lies inside hidden or verbatim elements: their places and the text tokens are sorted together, and a token
    # looks at its neighbours, so the work does not grow with the number of such elements times that of tokens
    def marks(tags: str, mark: int) -> str:
        outermost = f"filter({inner}, x -> x.tag IN ({tags}) AND x.e > x.s + 1 AND NOT {inside('x.i', enclosing(f'a.tag IN ({tags})'))})"
        return f"flatten(transform({outermost}, x -> transform(sequence(x.s + 1, x.e - 1), q -> struct(q AS pos, {mark} AS mark, CAST(NULL AS STRING) AS tok))))"

    tokens = (
        f"filter(transform(slice(toks, {scope}.s + 2, greatest({scope}.e - {scope}.s - 1, 0)), (t, j) -> struct({scope}.s + 1 + j AS pos, 2 AS mark, "
        f"IF({H.is_text('t')}, t, NULL) AS tok)), p -> p.tok IS NOT NULL)"
    )
    near = "(get(es, j - {0}).pos = p.pos AND get(es, j - {0}).mark = {1})"
    hidden = f"(coalesce({near.format(1, 0)}, false) OR coalesce({near.format(2, 0)}, false))"
    shown = f"IF(coalesce({near.format(1, 1)}, false), {decode_entities('p.tok')}, {collapse_space(decode_entities('p.tok'))})"
    kept = f"transform(es, (p, j) -> IF(p.mark < 2 OR {hidden}, NULL, struct(p.pos AS pos, 1 AS kind, 0 AS rank, {shown} AS f)))"
    texts = let("es", f"sort_array(concat({marks("'head', 'template'", 0)}, {marks("'pre'", 1)}, {tokens}))", f"filter({kept}, p -> p IS NOT NULL)")
    fragments = (
        "concat("
        f"transform({inner}, x -> struct(x.s AS pos, 1 AS kind, 0 AS rank, {opens} AS f)), "
        f"transform(filter({inner}, x -> x.s < x.e), x -> struct(x.e AS pos, 0 AS kind, -x.s AS rank, {closes} AS f)), "
        f"{texts})"
    )
    joined = f"array_join(transform(sort_array({fragments}), f -> f.f), '')"
    tidy = f"regexp_replace({joined}, {lit(r'\n[ \t]+(?=\n|$)')}, '\\n')"
    tidy = f"regexp_replace({tidy}, {lit(r'\n{3,}')}, '\\n\\n')"
    return js_trim(tidy)


_WHOLE = "struct(-1 AS i, size(els) AS z, -1 AS s, size(toks) AS e)"


def _main_text(style: str) -> str:
    scope = f"IF(main IS NULL, {_WHOLE}, struct(main.x.i AS i, main.x.z AS z, main.x.s AS s, main.x.e AS e))"
    return let("scope", scope, _rendered(style, "scope"))


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, content): readable text of the page, links and images kept, no wrapping."""
    return dom(pages).select("page_id", doc_expr(let("scope", _WHOLE, _rendered("text", "scope"))).alias("content"))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, content): the page as Markdown with ATX headings."""
    return dom(pages).select("page_id", doc_expr(let("scope", _WHOLE, _rendered("markdown", "scope"))).alias("content"))


def smart_document(pages: DataFrame, style: str = "text") -> DataFrame:
    """(page_id, url, title, selector_used, content, content_length, word_count) of the main content."""
    out = _with_main(pages).select(
        "page_id", "url", doc_expr(H.title("toks")).alias("title"), "selector_used", doc_expr(_main_text(style)).alias("content")
    )
    return out.withColumn("content_length", F.length("content").cast("bigint")).withColumn("word_count", doc_expr(word_count("content")))


def collapsible_census(pages: DataFrame) -> DataFrame:
    """(page_id, container, one count per rule, expanded): elements that a reader would have to open.

    Only the main container is looked at; navigation areas are left out where the rule says so.
    """
    doc = dom(pages).withColumn("main", doc_expr(_first_long(EXPAND_CONTAINERS)))
    body = f"coalesce(main.x, get(filter(els, x -> x.tag = 'body'), 0))"
    doc = doc.withColumn("box", doc_expr(body)).withColumn("scope", doc_expr(f"IF(box IS NULL, els, {H.descendants('box')})"))
    in_nav = f"({predicate(NAVIGATION)} OR {enclosed_by(NAVIGATION)})"
    in_link, in_any_link = enclosed_by("a[href]"), enclosed_by("a")
    details = nearest("x.i", enclosing("a.tag = 'details'"))
    label = f"lower({text()})"
    says_more = " OR ".join(
        f"{label} = {lit(t)} OR startswith({label}, {lit(t + ' ')}) OR endswith({label}, {lit(' ' + t)})" for t in EXPAND_TEXTS
    )

    def count(condition: str) -> str:
        return f"CAST(size(filter(scope, x -> {condition})) AS BIGINT)"

    rules = {
        "details_closed": count(predicate("details:not([open])")),
        "aria_collapsed": count(f"{predicate("[aria-expanded='false']")} AND NOT {in_nav} AND x.tag <> 'a' AND NOT {in_link}"),
        "summary_closed": count(
            f"x.tag = 'summary' AND {let('near_', details, "near_ IS NOT NULL AND ats[near_]['open'] IS NULL")}"
        ),
        "aria_controls": count(f"{predicate('button[aria-controls]')} AND NOT {in_nav} AND coalesce({attr('aria-expanded')} = 'false', false)"),
        "collapse_class": " + ".join(count(f"{predicate(s)} AND NOT {in_nav}") for s in COLLAPSE_SELECTORS),
        "more_button": count(
            f"{predicate("button, [role='button']")} AND NOT {in_nav} AND x.tag <> 'a' AND NOT {in_any_link} "
            f"AND {attr('href')} IS NULL AND ({says_more})"
        ),
    }
    out = doc.select("page_id", doc_expr("coalesce(box.tag, 'body')").alias("container"), *[doc_expr(e).alias(n) for n, e in rules.items()])
    return out.withColumn("expanded", doc_expr(" + ".join(rules)))


def has_selector(pages: DataFrame, selector: str) -> DataFrame:
    """Pages on which the selector matches; page columns unchanged."""
    return keep_pages(tagged(pages, selector), has(selector), pages.columns)


def has_text(pages: DataFrame, literal: str) -> DataFrame:
    """Pages whose body text, scripts and styles aside, contains the literal; case-sensitive."""
    doc = pages.withColumn("toks", doc_expr(H.tokens("html"))).withColumn("body", doc_expr(H.body_text("toks")))
    return keep_pages(doc, f"contains(body, {lit(literal)})", pages.columns)


def count_elements(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, n): number of matches, 0 kept."""
    return tagged(pages, selector).select("page_id", doc_expr(count_of(selector)).alias("n"))
