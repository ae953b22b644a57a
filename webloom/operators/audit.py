"""Page audits: accessibility, search engines, security headers, mixed content, links, images, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.selectors import predicate
from webloom.functions.sqltext import cut, doc_expr, first_few, let, lit
from webloom.functions.urls import scheme, url_join
from webloom.operators.dom import attr, count_of, dom, first_of, has, rows_of, tagged, text, with_tokens
from webloom.operators.forms import LABEL_IDS, field_type, labelled
from webloom.operators.skew import salted_join
from webloom.session import checkpointed

HEADINGS = "h1, h2, h3, h4, h5, h6"
ISSUE_TYPES = ["missing_alt", "missing_label", "heading_skip", "button_no_name", "empty_link"]
# Response headers that are reported; the first four are required.
SECURITY_HEADERS = [
    "content-security-policy", "strict-transport-security", "x-frame-options", "x-content-type-options",
    "x-xss-protection", "referrer-policy", "permissions-policy",
]
REQUIRED_HEADERS = {
    "content-security-policy": "Missing Content-Security-Policy header",
    "strict-transport-security": "Missing Strict-Transport-Security header (HSTS)",
    "x-frame-options": "Missing X-Frame-Options header (clickjacking protection)",
    "x-content-type-options": "Missing X-Content-Type-Options header",
}


def _empty(name: str, x: str = "x") -> str:
    return f"coalesce({attr(name, x)}, '') = ''"


def heading_skips(pages: DataFrame, text_length: int | None = None) -> DataFrame:
    """(page_id, pos, tag, previous_level, level, text): headings more than one level below the one before (0 at the start)."""
    return rows_of(dom(pages, [HEADINGS]), _heading_skips(text_length), "page_id")


def _heading_skips(text_length: int | None) -> str:
    heads = f"filter(els, x -> {predicate(HEADINGS)})"
    level = "CAST(substr(x.tag, 2) AS INT)"
    before = "IF(j = 0, 0, CAST(substr(get(hs, j - 1).tag, 2) AS INT))"
    rows = (
        f"transform(hs, (x, j) -> struct(x.s AS pos, x.tag AS tag, {before} AS previous_level, {level} AS level, "
        f"IF({level} - {before} > 1, {cut(H.text_content('x'), text_length)}, '') AS text))"
    )
    return let("hs", heads, f"filter({rows}, r -> r.level - r.previous_level > 1)")


def _issues(text_length: int | None = None) -> str:
    def issues(kind: str, condition: str, element: str, detail: str, message: str) -> str:
        return (
            f"transform(filter(els, x -> {condition}), x -> struct(x.s AS pos, {lit(kind)} AS type, {element} AS element, "
            f"{detail} AS detail, {lit(message)} AS message))"
        )

    unnamed = f"{_empty('aria-label')} AND {_empty('aria-labelledby')}"
    skips = (
        f"transform({_heading_skips(text_length)}, r -> struct(r.pos AS pos, 'heading_skip' AS type, r.tag AS element, r.text AS detail, "
        "concat('Heading level skipped from h', r.previous_level, ' to h', r.level) AS message))"
    )
    parts = [
        issues("missing_alt", f"x.tag = 'img' AND {_empty('alt')} AND {_empty('aria-label')}", "'img'", f"coalesce({attr('src')}, '')", "Image missing alt text"),
        issues(
            "missing_label",
            f"x.tag IN ('input', 'textarea', 'select') AND {unnamed} AND {field_type('x')} <> 'hidden' AND NOT {labelled('x')}",
            "x.tag",
            f"coalesce({attr('name')}, '')",
            "Form input missing label",
        ),
        skips,
        issues(
            "button_no_name",
            f"{predicate("button, [role='button']")} AND {unnamed} AND {text()} = ''",
            "'button'",
            "''",
            "Button has no accessible name",
        ),
        issues("empty_link", f"x.tag = 'a' AND {attr('href')} IS NULL", "'a'", cut(H.text_content('x'), text_length), "Link has no href or empty href"),
    ]
    return f"concat({', '.join(parts)})"


def a11y_issues(pages: DataFrame, text_length: int | None = None) -> DataFrame:
    """(page_id, pos, type, element, detail, message): one row per accessibility issue, five rules."""
    return rows_of(dom(pages).withColumn("label_ids", doc_expr(LABEL_IDS)), _issues(text_length), "page_id")


def a11y_summary(pages: DataFrame) -> DataFrame:
    """(page_id, total_issues, one count per type, has_main, has_nav); clean pages kept."""
    doc = dom(pages).withColumn("label_ids", doc_expr(LABEL_IDS)).withColumn("kinds", doc_expr(f"transform({_issues()}, r -> r.type)"))
    counts = [doc_expr(f"CAST(size(filter(kinds, k -> k = {lit(t)})) AS BIGINT)").alias(t) for t in ISSUE_TYPES]
    return doc.select(
        "page_id",
        doc_expr("CAST(size(kinds) AS BIGINT)").alias("total_issues"),
        *counts,
        doc_expr(has("main, [role='main']")).alias("has_main"),
        doc_expr(has("nav, [role='navigation']")).alias("has_nav"),
    )


def seo_audit(pages: DataFrame, h1_length: int | None = None) -> DataFrame:
    """One row per page: title, meta, Open Graph and Twitter tags, canonical, headings, structured data and issues."""
    doc = dom(pages, ["h1", "link", "title"]).withColumn("title", doc_expr(H.title("toks"))).withColumn("metas", doc_expr(_named_metas()))

    def meta(name: str) -> str:
        return f"get(filter(metas, m -> m.key = {lit(name)}), 0).content"

    jsonld = (
        f"filter(transform(filter(toks, t -> lower(substr(t, 1, 7)) = '<script' AND coalesce({H.attribute('t', 'type')} = 'application/ld+json', false)), "
        f"t -> try_parse_json({H.raw_content('t')})), v -> v IS NOT NULL AND NOT is_variant_null(v) AND to_json(v) NOT IN ('false', '0', '\"\"'))"
    )
    columns = {
        "description": meta("description"),
        "keywords": meta("keywords"),
        "robots": meta("robots"),
        "canonical": let("ref", first_of("link[rel='canonical']", f"coalesce({attr('href')}, '')"), url_join("url", "ref")),
        "og_title": meta("og:title"),
        "og_description": meta("og:description"),
        "og_image": meta("og:image"),
        "og_url": meta("og:url"),
        "twitter_card": meta("twitter:card"),
        "twitter_title": meta("twitter:title"),
        "twitter_description": meta("twitter:description"),
        "twitter_image": meta("twitter:image"),
        "h1_count": count_of("h1"),
        "h1_text": first_of("h1", cut(H.text_content('x'), h1_length)),
        "structured_data": f"transform({jsonld}, v -> to_json(v))",
    }
    out = doc.select("page_id", "url", "title", doc_expr("CAST(length(title) AS BIGINT)").alias("title_length"), *[doc_expr(e).alias(n) for n, e in columns.items()])
    out = out.withColumn("description_length", doc_expr("CAST(coalesce(length(description), 0) AS BIGINT)"))
    issues = (
        "filter(array(IF(title_length < 10, 'Title too short or missing', NULL), "
        "IF(description_length < 50, 'Meta description too short or missing', NULL), IF(h1_count = 0, 'No H1 heading found', NULL), "
        "IF(h1_count > 1, 'Multiple H1 headings found', NULL), IF(canonical IS NULL, 'No canonical URL', NULL)), i -> i IS NOT NULL)"
    )
    return out.withColumn("issues", doc_expr(issues))


def _named_metas() -> str:
    """Meta tags that can be asked for by name or property, empty contents kept."""
    key = f"coalesce({H.attribute('t', 'name')}, {H.attribute('t', 'property')})"
    return (
        "filter(transform(filter(toks, t -> lower(substr(t, 1, 6)) RLIKE '^<meta[ \\\\t\\\\r\\\\n/]'), "
        f"t -> struct({key} AS key, coalesce({H.attribute('t', 'content')}, '') AS content)), m -> m.key IS NOT NULL)"
    )


def security_headers(responses: DataFrame) -> DataFrame:
    """(url, header columns, issues ARRAY, score) from (url, headers MAP): 20 points off per missing required header."""
    lower = doc_expr("transform_keys(headers, (k, v) -> lower(k))")
    out = responses.select("*", lower.alias("h_"))
    for name in SECURITY_HEADERS:
        out = out.withColumn(name.replace("-", "_"), doc_expr(f"h_[{lit(name)}]"))
    missing = ", ".join(f"IF(coalesce({n.replace('-', '_')}, '') = '', {lit(m)}, NULL)" for n, m in REQUIRED_HEADERS.items())
    out = out.withColumn("issues", doc_expr(f"filter(array({missing}), i -> i IS NOT NULL)"))
    return out.withColumn("score", doc_expr("CAST(greatest(0, 100 - size(issues) * 20) AS BIGINT)")).drop("h_", "headers")


def mixed_content(pages: DataFrame) -> DataFrame:
    """(page_id, is_https, count, has_mixed_content, resources ARRAY<STRUCT>): http:// resources on https pages."""
    kinds = {
        "image": ("x.tag = 'img'", "src"),
        "script": ("x.tag = 'script'", "src"),
        "stylesheet": (predicate("link[rel~='stylesheet']"), "href"),
        "iframe": ("x.tag = 'iframe'", "src"),
    }
    found = ", ".join(
        f"transform(filter(els, x -> {cond} AND startswith(coalesce({attr(a)}, ''), 'http://')), x -> struct({lit(k)} AS type, {attr(a)} AS src))"
        for k, (cond, a) in kinds.items()
    )
    doc = dom(pages, ["img", "script", "link", "iframe"]).withColumn("is_https", doc_expr(f"{scheme('url')} = 'https'"))
    doc = doc.withColumn("resources", doc_expr(f"CASE WHEN is_https THEN concat({found}) END"))
    return doc.select(
        "page_id",
        "is_https",
        doc_expr("CAST(IF(is_https, size(resources), NULL) AS BIGINT)").alias("count"),
        doc_expr("IF(is_https, size(resources) > 0, NULL)").alias("has_mixed_content"),
        "resources",
    )


def checked_links(pages: DataFrame, max_check: int | None = None, text_length: int | None = None, texts: bool = True) -> DataFrame:
    """(page_id, link_no, href, text, total_links): the links that a link check looks at.

    With ``max_check`` only that many links of a page are looked at, counted before javascript:, mailto: and tel: links are left out.
    Without ``texts`` there is no text, and start tags are enough to find the links.
    """
    ref = f"coalesce({attr('href')}, '')"
    text_field = f", {cut(H.text_content('x'), text_length)} AS text" if texts else ""
    links = (
        f"transform(filter(els, x -> x.tag IN ('a', 'area') AND {attr('href')} IS NOT NULL), x -> "
        f"struct({let('ref', ref, url_join('url', 'ref'))} AS href{text_field}))"
    )
    doc = (dom(pages, ["a", "area"]) if texts else tagged(pages, "a, area")).withColumn("links", doc_expr(links)).withColumn("total_links", doc_expr("CAST(size(links) AS BIGINT)"))
    out = doc.select("page_id", "total_links", F.posexplode_outer(doc_expr(first_few("links", max_check))).alias("link_no", "l"))
    kept = "l IS NULL OR NOT (l.href = '' OR startswith(l.href, 'javascript:') OR startswith(l.href, 'mailto:') OR startswith(l.href, 'tel:'))"
    return out.select("page_id", "total_links", "link_no", doc_expr(f"IF({kept}, l.href, NULL)").alias("href"), *(["l.text"] if texts else []))


def broken_links(pages: DataFrame, status: DataFrame, max_check: int | None = None, text_length: int | None = None) -> DataFrame:
    """(page_id, href, status, text): checked links that answer with 400 or more, or not at all (status NULL); ``status`` is (url, status)."""
    links = checkpointed(checked_links(pages, max_check, text_length).where("href IS NOT NULL"))
    return _with_status(links, status).where("status IS NULL OR status >= 400").select("page_id", "href", "status", "text")


def _with_status(links: DataFrame, status: DataFrame) -> DataFrame:
    """Links, written before, with the status of their target; targets that very many links name are spread out."""
    answers = status.groupBy(F.col("url").alias("href")).agg(F.min("status").alias("status"))
    return salted_join(links, answers, "href", ["page_id", "link_no"])


def broken_link_summary(pages: DataFrame, status: DataFrame, max_check: int | None = None) -> DataFrame:
    """(page_id, total_links, checked, broken); pages without links kept."""
    links = checkpointed(checked_links(pages, max_check, texts=False))
    joined = _with_status(links, status)
    return joined.groupBy("page_id").agg(
        F.max("total_links").alias("total_links"),
        F.count("href").alias("checked"),
        F.count_if(F.col("href").isNotNull() & (F.col("status").isNull() | (F.col("status") >= 400))).alias("broken"),
    )


def image_audit(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, src, alt, natural and display sizes, lazy, issues): images that miss alt text or are oversized.

    ``sizes`` is (src, natural_width, natural_height); display sizes are the width and height attributes.
    """
    images = _images(pages)
    if sizes is not None:
        known = sizes.groupBy("src").agg(F.max("natural_width").alias("natural_width"), F.max("natural_height").alias("natural_height"))
        images = salted_join(checkpointed(images), known, "src", ["page_id", "pos"])
    else:
        images = images.withColumn("natural_width", F.lit(None).cast("int")).withColumn("natural_height", F.lit(None).cast("int"))
    issues = (
        "filter(array(IF(alt = '' AND aria = '', 'missing_alt', NULL), IF(coalesce(natural_width > 2 * display_width, false) "
        "OR coalesce(natural_height > 2 * display_height, false), 'oversized', NULL)), i -> i IS NOT NULL)"
    )
    return images.withColumn("issues", doc_expr(issues)).drop("aria")


def _images(pages: DataFrame) -> DataFrame:
    struct = {
        "pos": "x.s",
        "src": let("ref", f"coalesce({attr('src')}, '')", f"IF(ref = '', '', {url_join('url', 'ref')})"),
        "alt": f"coalesce({attr('alt')}, '')",
        "aria": f"coalesce({attr('aria-label')}, '')",
        "display_width": f"try_cast({attr('width')} AS INT)",
        "display_height": f"try_cast({attr('height')} AS INT)",
        "lazy": f"(coalesce(lower({attr('loading')}) = 'lazy', false) OR NOT ({_empty('data-src')}))",
    }
    fields = ", ".join(f"{e} AS {n}" for n, e in struct.items())
    return rows_of(dom(pages, ["img"]), f"transform(filter(els, x -> x.tag = 'img'), x -> struct({fields}))", "page_id")


def image_summary(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(page_id, total_images, images_with_issues, missing_alt, oversized); pages without images kept."""
    found = image_audit(pages, sizes).groupBy("page_id").agg(
        F.count("*").alias("total_images"),
        F.count_if(F.size("issues") > 0).alias("images_with_issues"),
        F.count_if(F.array_contains("issues", "missing_alt")).alias("missing_alt"),
        F.count_if(F.array_contains("issues", "oversized")).alias("oversized"),
    )
    return pages.select("page_id").join(found, "page_id", "left").na.fill(0)


def web_vitals(timings: DataFrame) -> DataFrame:
    """Core timings per navigation from a timing table; lcp is the last entry's render time, else its load time."""
    last = "try_element_at(lcp, -1)"
    return timings.select(
        "page_url",
        doc_expr("response_start - request_start").alias("ttfb"),
        "fcp",
        doc_expr(f"coalesce(nullif({last}.render_time, 0), {last}.load_time)").alias("lcp"),
        doc_expr("dcl_end - navigation_start").alias("dom_content_loaded"),
        doc_expr("load_end - navigation_start").alias("load_complete"),
        "transfer_size",
        doc_expr("dom_interactive - navigation_start").alias("dom_interactive"),
    )


VITALS = ["ttfb", "fcp", "lcp", "dom_content_loaded", "load_complete", "dom_interactive"]


def vitals_sketches(vitals: DataFrame, by: list[str], accuracy: int = 400, metrics: list[str] | None = None) -> DataFrame:
    """(by…, metric, n, sketch): a quantile sketch of every metric per group, for instance per host and hour.

    Sketches have a size that ``accuracy`` bounds, whatever they sum up, and are made before rows move; rank errors are about 2 / accuracy with
    99 % confidence, and groups of fewer values than ``accuracy`` are exact.  NULL values do not count; a group without any has no row.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics or VITALS])
    long = vitals.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").where("value IS NOT NULL")
    return long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(accuracy)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by…, metric, n, sketch): sketches of larger groups from those of ``vitals_sketches``; no value is read again."""
    return sketches.groupBy(*by, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def vitals_quantile(sketches: DataFrame, share: float = 0.75) -> DataFrame:
    """The sketches with ``value``, the value that ``share`` of a group's values do not exceed."""
    return sketches.withColumn("value", F.kll_sketch_get_quantile_double("sketch", F.lit(share))).drop("sketch")


def resource_summary(requests: DataFrame) -> DataFrame:
    """(page_url, initiator_type, n, bytes); an empty initiator type counts as 'other'."""
    kind = doc_expr("coalesce(nullif(initiator_type, ''), 'other')")
    return requests.groupBy("page_url", kind.alias("initiator_type")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("transfer_size", F.lit(0))).cast("bigint").alias("bytes")
    )


def page_checks(pages: DataFrame) -> DataFrame:
    """(page_id, url, image, link and node counts): the page part of the performance audit."""
    href = let("ref", f"coalesce({attr('href')}, '')", url_join("url", "ref"))
    links = f"transform(filter(els, x -> x.tag IN ('a', 'area') AND {attr('href')} IS NOT NULL), x -> {href})"
    doc = tagged(pages, "*").withColumn("links", doc_expr(links))
    return doc.select(
        "page_id",
        "url",
        doc_expr(count_of("img")).alias("total_images"),
        doc_expr(f"CAST(size(filter(els, x -> x.tag = 'img' AND {_empty('alt')})) AS BIGINT)").alias("images_without_alt"),
        doc_expr("CAST(size(links) AS BIGINT)").alias("total_links"),
        doc_expr("CAST(size(filter(links, l -> startswith(l, 'https://'))) AS BIGINT)").alias("https_links"),
        doc_expr("CAST(size(els) AS BIGINT)").alias("node_count"),
    )


def performance_scores(checks: DataFrame, vitals: DataFrame) -> DataFrame:
    """(page_id, performance, accessibility) from page_checks and web_vitals of the same URLs."""
    joined = checks.join(vitals, checks.url == vitals.page_url, "left")
    performance = "100 - IF(coalesce(load_complete, 0) > 3000, 30, 0) - IF(coalesce(ttfb, 0) > 600, 20, 0)"
    ratio = "images_without_alt / greatest(total_images, 1)"
    return joined.select(
        "page_id",
        doc_expr(f"CAST(greatest(0, {performance}) AS BIGINT)").alias("performance"),
        doc_expr(f"CAST(greatest(0, 100 - CAST(floor({ratio} * 50) AS BIGINT)) AS BIGINT)").alias("accessibility"),
    )


def node_counts(pages: DataFrame) -> DataFrame:
    """(page_id, dom_nodes): start tags counted from the tokens alone."""
    starts = f"size(filter(toks, t -> {H.tag_name('t')} <> '' AND NOT startswith(t, '</')))"
    return with_tokens(pages).select("page_id", doc_expr(f"CAST({starts} AS BIGINT)").alias("dom_nodes"))


def memory_report(samples: DataFrame) -> DataFrame:
    """Heap sizes in MB and the used share, two decimals, from (…, heap_limit, heap_total, heap_used) in bytes."""
    out = samples
    for name in ("heap_limit", "heap_total", "heap_used"):
        out = out.withColumn(f"{name}_mb", F.round(F.col(name) / 1048576, 2))
    return out.withColumn("heap_usage_percent", F.round(F.col("heap_used") / F.col("heap_limit") * 100, 2))


def heading_order(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, tag, text): headings numbered per page."""
    heads = f"transform(filter(els, x -> {predicate(HEADINGS)}), (x, j) -> struct(j AS ordinal, x.tag AS tag, {text()} AS text))"
    return rows_of(dom(pages, [HEADINGS]), heads, "page_id").select("page_id", "tag", "text", "ordinal")
