"""Extraction of text, links, attributes, images, metadata and structured data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.selectors import predicate
from webloom.functions.sqltext import doc_expr, let, lit
from webloom.functions.text import js_trim
from webloom.functions.urls import url_join
from webloom.operators.dom import attr, dom, first_of, rows_of, select, tagged, text, with_tokens


def extract_text(pages: DataFrame, selector: str, all: bool = True) -> DataFrame:
    """Trimmed text of the matches: every non-empty one, or the first one per page ('' without a match)."""
    doc = dom(pages, [selector])
    if all:
        return select(doc, selector, {"text": text()}).where("text <> ''")
    return doc.select("page_id", doc_expr(f"coalesce({first_of(selector, text())}, '')").alias("text"))


def extract_links(pages: DataFrame, selector: str = "a", absolute: bool = False) -> DataFrame:
    """(page_id, url, pos, href, text); links without href or with an empty one are dropped."""
    href = let("ref", attr("href"), f"IF(coalesce(ref, '') = '', NULL, {url_join('url', 'ref')})") if absolute else attr("href")
    return select(dom(pages, [selector]), selector, {"href": href, "text": text()}, ("page_id", "url")).where("href <> ''")


def link_targets(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of every non-empty link, resolved; reads tags only, so no element list is built.

    The targets are complete before the explode, so that later filters on them cost no second evaluation.
    """
    return rows_of(with_tokens(pages), _links(), "page_id", "url")


def _links() -> str:
    """array<struct<pos, href>> of the links of a page, from its tokens and its URL."""
    anchors = "filter(transform(toks, (t, i) -> IF(lower(substr(t, 1, 2)) = '<a' AND t RLIKE '^..[\\\\s]', struct(i AS pos, t AS tok), NULL)), a -> a IS NOT NULL)"
    target = let("ref", H.attribute("a.tok", "href"), f"IF(coalesce(ref, '') = '', NULL, {url_join('url', 'ref')})")
    return f"filter(transform({anchors}, a -> struct(a.pos AS pos, {target} AS href)), l -> l.href IS NOT NULL)"


def link_hrefs() -> str:
    """Resolved targets of a page's links, as SQL text over ``toks`` and ``url``."""
    return f"transform({_links()}, l -> l.href)"


def extract_attr(pages: DataFrame, selector: str, name: str, all: bool = True) -> DataFrame:
    """Attribute values of the matches: every non-empty one, or the first match's per page ('' when missing)."""
    doc = tagged(pages, selector)
    if all:
        return select(doc, selector, {"value": attr(name)}).where("value <> ''")
    return doc.select("page_id", doc_expr(f"coalesce({first_of(selector, attr(name))}, '')").alias("value"))


def extract_images(pages: DataFrame, selector: str = "img") -> DataFrame:
    """(page_id, pos, src, alt) with absolute src; images without src are dropped, data: and http(s): kept as they are."""
    out = select(dom(pages, [selector]), selector, {"src": attr("src"), "alt": f"coalesce({attr('alt')}, '')"}, ("page_id", "url"))
    src = f"CASE WHEN src RLIKE '^(https?|data):' THEN src ELSE {url_join('url', 'src')} END"
    return out.where("src <> ''").select("page_id", "pos", doc_expr(src).alias("src"), "alt")


def page_info(pages: DataFrame) -> DataFrame:
    return with_tokens(pages).select("page_id", "url", doc_expr(H.title("toks")).alias("title"))


def meta_entries() -> str:
    """Meta tags of ``toks`` as array<struct<key, content>> in document order."""
    def non_empty(name: str) -> str:
        return f"nullif({H.attribute('t', name)}, '')"

    key = f"coalesce({non_empty('name')}, {non_empty('property')}, {non_empty('itemprop')})"
    return (
        "filter(transform(filter(toks, t -> lower(substr(t, 1, 6)) RLIKE '^<meta[ \\\\t\\\\r\\\\n/]'), "
        f"t -> struct({key} AS key, {non_empty('content')} AS content)), m -> m.key IS NOT NULL AND m.content IS NOT NULL)"
    )


def extract_meta(pages: DataFrame) -> DataFrame:
    """(page_id, meta MAP): the last duplicate wins, ``title`` is the document title."""
    entries = f"concat({meta_entries()}, array(struct('title' AS key, {H.title('toks')} AS content)))"
    keys = "array_distinct(transform(e, m -> m.key))"
    as_map = let(
        "e",
        entries,
        f"map_from_arrays({keys}, transform({keys}, n -> try_element_at(filter(e, m -> m.key = n), -1).content))",
    )
    return with_tokens(pages).select("page_id", doc_expr(as_map).alias("meta"))


def extract_jsonld(pages: DataFrame, drop_falsy: bool = False) -> DataFrame:
    """(page_id, pos, data VARIANT): JSON-LD scripts that parse; ``drop_falsy`` also drops null, false, 0 and ''."""
    scripts = (
        "filter(transform(toks, (t, i) -> struct(i AS pos, t AS tok)), "
        f"s -> lower(substr(s.tok, 1, 7)) = '<script' AND coalesce({H.attribute('s.tok', 'type')} = 'application/ld+json', false))"
    )
    out = rows_of(with_tokens(pages), scripts, "page_id").withColumn("json", doc_expr(H.raw_content("tok")))
    out = out.withColumn("data", doc_expr("try_parse_json(json)")).where("data IS NOT NULL")
    if drop_falsy:
        out = out.where("NOT is_variant_null(data) AND trim(to_json(data)) NOT IN ('false', '0', '\"\"', 'null')")
    return out.select("page_id", "pos", "data")


def extract_microdata(pages: DataFrame) -> DataFrame:
    """(page_id, pos, type, props MAP) per itemscope; nested properties also count for the outer item, last one wins."""
    value = f"coalesce(nullif({attr('content', 'y')}, ''), {js_trim(H.text_content('y'))})"
    props = (
        f"filter(transform(filter({H.descendants('x')}, y -> contains(lower(toks[y.s]), 'itemprop')), "
        f"y -> struct({attr('itemprop', 'y')} AS name, {value} AS value)), m -> m.name <> '' AND m.value <> '')"
    )
    names = "array_distinct(transform(e, m -> m.name))"
    as_map = let(
        "e", props, f"map_from_arrays({names}, transform({names}, k -> try_element_at(filter(e, m -> m.name = k), -1).value))"
    )
    columns = {"type": f"nullif({attr('itemtype')}, '')", "props": as_map}
    out = select(dom(pages), "[itemscope]", columns)
    return out.where("type IS NOT NULL OR size(props) > 0")


def extract_regex(pages: DataFrame, pattern: str, selector: str | None = None) -> DataFrame:
    """(page_id, match_no, groups ARRAY): all matches in the body text or in the first match of a selector.

    Without groups the array holds the whole match; otherwise one entry per group.
    """
    n = re.compile(pattern).groups
    pattern = java_pattern(pattern)
    source = H.body_text("toks", visible=False) if selector is None else f"coalesce({first_of(selector, H.text_content('x'))}, '')"
    doc = with_tokens(pages) if selector is None else dom(pages, [selector])
    return regex_matches(doc.select("page_id", doc_expr(source).alias("text")), "text", pattern, n, "page_id")


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's spelling: named groups and their back references by number."""
    names = re.compile(pattern).groupindex
    out, i, in_class = "", 0, False
    while i < len(pattern):
        named = None if in_class else re.match(r"\(\?P<(\w+)>|\(\?P=(\w+)\)", pattern[i:])
        if named:
            out += "(" if named[1] else f"(?:\\{names[named[2]]})"
            i += named.end()
        elif pattern[i] == "\\":
            out += {"\\Z": r"\z"}.get(pattern[i : i + 2], pattern[i : i + 2])
            i += 2
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out += r"\[" if pattern[i] == "[" and out and in_class and _inside_class(pattern, i) else pattern[i]
            i += 1
    return out


def _inside_class(pattern: str, at: int) -> bool:
    """Whether the bracket at a place lies in a character class already."""
    open_, i = False, 0
    while i < at:
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            open_ = True
        elif pattern[i] == "]":
            open_ = False
        i += 1
    return open_


def regex_matches(df: DataFrame, column: str, pattern: str, n_groups: int, *keep: str) -> DataFrame:
    """(keep…, match_no, groups ARRAY): all matches of a pattern in a text column, '.' and '^$' spanning lines."""
    wanted = [0] if n_groups == 0 else list(range(1, n_groups + 1))
    regex = lit("(?ms)" + pattern)
    parts = [f"regexp_extract_all({column}, {regex}, {g})" for g in wanted]
    if len(parts) == 1:
        zipped = f"transform({parts[0]}, m -> array(m))"
    else:
        zipped = let("g", f"array({', '.join(parts)})", "transform(sequence(1, size(g[0])), j -> transform(g, a -> a[j - 1]))")
        zipped = zipped.replace("sequence(1, size(g[0]))", "slice(sequence(1, size(g[0]) + 1), 1, size(g[0]))")
    out = df.select(*keep, F.posexplode_outer(doc_expr(zipped)).alias("match_no", "groups")).where("match_no IS NOT NULL")
    return out.select(*keep, "match_no", "groups")


def list_frames(pages: DataFrame) -> DataFrame:
    """(page_id, frame_no, src, id, name, selector) per iframe."""
    def value(name: str) -> str:
        return f"coalesce({attr(name)}, '')"

    frames = (
        "transform(filter(els, x -> x.tag = 'iframe'), (x, n) -> "
        f"struct(n AS frame_no, {value('src')} AS src, {value('id')} AS id, {value('name')} AS name))"
    )
    out = rows_of(dom(pages, ["iframe"]), frames, "page_id")
    selector = (
        "CASE WHEN id <> '' THEN concat('#', id) WHEN name <> '' THEN concat('[name=\"', name, '\"]') "
        "ELSE concat('iframe:nth-of-type(', frame_no + 1, ')') END"
    )
    return out.withColumn("selector", doc_expr(selector))


def shadow_select(pages: DataFrame, host: str, inner: str) -> DataFrame:
    """(page_id, host_pos, pos, tag, text, html) of matches inside the declarative shadow root of a host."""
    roots = f"filter({H.descendants('h')}, r -> r.tag = 'template' AND {attr('shadowrootmode', 'r')} IS NOT NULL AND r.p = h.i)"
    hits = (
        f"transform(filter({H.descendants('root')}, x -> {predicate(inner)}), x -> "
        f"struct(h.s AS host_pos, x.s AS pos, x.tag AS tag, {text()} AS text, {H.inner_html('toks', 'x')} AS html))"
    )
    per_host = f"flatten(transform(filter(els, h -> {predicate(host, 'h')}), h -> flatten(transform({roots}, root -> {hits}))))"
    return rows_of(dom(pages), per_host, "page_id")


def batch_selectors(pages: DataFrame, selectors: list[str]) -> DataFrame:
    """(page_id, selector, texts ARRAY): several selectors in one pass over the same element list."""
    def texts(selector: str) -> str:
        raw = H.text_content("x")
        inner = f"filter(transform(filter(els, x -> {predicate(selector)}), x -> {raw}), s -> s <> '')"
        return f"struct({lit(selector)} AS selector, transform({inner}, s -> {js_trim('s')}) AS texts)"

    return rows_of(dom(pages, selectors), f"array({', '.join(texts(s) for s in selectors)})", "page_id")


def inline_styles(pages: DataFrame, selector: str, properties: list[str] | None = None) -> DataFrame:
    """(page_id, styles MAP) declared on the first match; the last declaration of a property wins."""
    style = f"coalesce({first_of(selector, attr('style'))}, '')"
    pairs = (
        f"filter(transform(filter(split({style}, ';'), d -> contains(d, ':')), d -> struct(lower({js_trim('substring_index(d, chr(58), 1)')}) AS k, "
        f"{js_trim('substr(d, instr(d, chr(58)) + 1)')} AS v)), m -> m.k <> '' AND m.v <> '')"
    )
    keys = "array_distinct(transform(e, m -> m.k))"
    as_map = let("e", pairs, f"map_from_arrays({keys}, transform({keys}, n -> try_element_at(filter(e, m -> m.k = n), -1).v))")
    if properties:
        as_map = f"map_filter({as_map}, (k, v) -> array_contains(array({', '.join(lit(p) for p in properties)}), k))"
    return tagged(pages, selector).select("page_id", doc_expr(as_map).alias("styles"))


def fonts(pages: DataFrame) -> DataFrame:
    """(page_id, used ARRAY, faces ARRAY<STRUCT>): inline font families and @font-face rules."""
    doc = with_tokens(pages)
    declared = (
        "array_sort(array_distinct(filter(transform(filter(toks, t -> startswith(t, '<') AND contains(t, 'font-family')), t -> "
        f"{js_trim(f'regexp_extract({H.attribute("t", "style")}, {lit(r"(?i)font-family\s*:\s*([^;]+)")}, 1)')}), f -> f <> '')))"
    )
    rules = (
        "flatten(transform(filter(toks, t -> lower(substr(t, 1, 6)) = '<style'), "
        f"t -> regexp_extract_all(t, {lit(r'(?is)@font-face\s*\{([^}]*)\}')}, 1)))"
    )

    def value(name: str) -> str:
        return js_trim(f"regexp_extract(r, {lit(rf'(?i)(?:^|[;\s]){name}\s*:\s*([^;]+)')}, 1)")

    faces = (
        f"transform({rules}, r -> struct(regexp_replace({value('font-family')}, {lit('''^["']|["']$''')}, '') AS family, "
        f"{value('src')} AS src, {value('font-weight')} AS weight, {value('font-style')} AS style))"
    )
    return doc.select("page_id", doc_expr(declared).alias("used"), doc_expr(faces).alias("faces"))


def text_range(pages: DataFrame, selector: str, start: int, end: int | None = None) -> DataFrame:
    """(page_id, text): a range of the first text child of the first match, bounds clamped to its length."""
    first = f"get(filter({H.inner_tokens('toks', 'x')}, t -> {H.is_text('t')}), 0)"
    value = first_of(selector, f"coalesce({first}, '')")
    stop = "length(t0)" if end is None else f"least({int(end)}, length(t0))"
    out = dom(pages, [selector]).select("page_id", doc_expr(value).alias("t0")).withColumn("t0", doc_expr(H.decode_entities("t0")))
    begin = f"least({int(start)}, length(t0))"
    return out.select("page_id", doc_expr(f"substring(t0, {begin} + 1, greatest({stop} - {begin}, 0))").alias("text"))
