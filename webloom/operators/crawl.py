"""Traversal of stored pages: link edges, crawling, pagination, batch look-up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.selectors import predicate
from webloom.functions.sqltext import doc_expr, lit
from webloom.functions.text import js_trim
from webloom.functions.urls import RFC3986, file_name, glob_match, netloc, url_join
from webloom.operators.dom import attr, dom, text
from webloom.operators.extract import link_hrefs, link_targets
from webloom.operators.skew import salted_join
from webloom.session import bucketed, checkpointed, forget

HEAD_EVERY = 16  # pages from one head of a list to the next, about


def captures(pages: DataFrame) -> DataFrame:
    """(url, page_id): the stored page that counts for each URL, the one with the lowest page_id."""
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


def one_per_url(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, …) of the page that counts for each URL.

    Works on rows already narrowed to what is needed, so that no HTML moves; copies are reduced map-side.
    """
    return rows.join(captures(pages), ["url", "page_id"], "left_semi")


def of_domain(pages: DataFrame, domain: str) -> DataFrame:
    """Pages of one authority; two narrow columns decide before any HTML is parsed."""
    return pages.where(doc_expr(f"{netloc('url')} IN ({lit(domain)}, '')"))


def link_edges(pages: DataFrame, follow: str | None = None, exclude: str | None = None, domain: str | None = None) -> DataFrame:
    """(src_url, dst_url): distinct links that a crawl may follow; with ``domain`` from and to its pages only."""
    source = pages if domain is None else of_domain(pages, domain)
    edges = _followed(link_targets(source).select("page_id", "url", F.col("href").alias("dst_url")), follow, exclude, domain)
    return one_per_url(source, edges.distinct()).select(F.col("url").alias("src_url"), "dst_url")


def _followed(edges: DataFrame, follow: str | None, exclude: str | None, domain: str | None) -> DataFrame:
    return edges.where(doc_expr(_follows("dst_url", follow, exclude, domain)))


def _follows(url: str, follow: str | None, exclude: str | None, domain: str | None) -> str:
    tests = [f"NOT startswith({url}, 'javascript:')", f"NOT startswith({url}, 'mailto:')"]
    if follow:
        tests.append(glob_match(url, follow))
    if exclude:
        tests.append(f"NOT {glob_match(url, exclude)}")
    if domain is not None:
        tests.append(f"{netloc(url)} IN ({lit(domain)}, '')")
    return " AND ".join(f"({t})" for t in tests)


def _texts(selector: str | None) -> str:
    return f"filter(transform(filter(els, x -> {predicate(selector)}), x -> {text()}), s -> s <> '')" if selector else "CAST(NULL AS array<string>)"


def crawl(
    pages: DataFrame,
    seed: str,
    depth: int = 2,
    extract: str | None = None,
    follow: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """(url, depth, title, extracted, error): breadth-first from ``seed`` within its domain.

    A URL counts once, at the first level it is seen; only the exact string identifies it.  URLs without a
    stored page give an ``error`` row.  The pages of the domain are parsed once, to targets, title and texts, and lie in buckets of their URL
    with their targets, as do the URLs visited.  A level joins the frontier with the pages, takes the distinct targets and
    leaves out the visited ones: only the frontier and its targets move.
    """
    spark = pages.sparkSession
    domain = re.match(RFC3986, seed)[4] or ""
    stored, names = site(pages, domain, extract, follow, exclude)
    first = spark.createDataFrame([(seed, 0)], "url string, depth int")
    visited, visits = bucketed(first, "url")
    for level in range(1, depth + 1):
        new = next_level(stored, visited, level)
        before = visited.count()
        visited, _ = bucketed(new, "url", name=visits)
        if visited.count() == before:
            break
    out = visited.join(stored.drop("targets"), "url", "left").withColumn("error", F.when(F.col("title").isNull(), F.lit("page not stored")))
    forget(spark, names, visits)
    return out


def site(pages: DataFrame, domain: str, extract: str | None = None, follow: str | None = None, exclude: str | None = None) -> tuple[DataFrame, str]:
    """(url, targets, title, extracted) of the pages of a domain in buckets of the URL, and the table's name; targets are those a crawl may follow."""
    doc = dom(of_domain(pages, domain), ["title"] if extract is None else [extract, "title"])
    page = [doc_expr(f"array_distinct({link_hrefs()})").alias("hrefs"), doc_expr(H.title("toks")).alias("title"), doc_expr(_texts(extract)).alias("extracted")]
    doc = doc.select("page_id", "url", *page)
    # the page with the lowest page_id counts; copies are reduced before they move
    doc = doc.groupBy("url").agg(F.min_by(F.struct("hrefs", "title", "extracted"), "page_id").alias("d"))
    kept = doc_expr(f"filter(d.hrefs, h -> {_follows('h', follow, exclude, domain)})")
    return bucketed(doc.select("url", kept.alias("targets"), "d.title", "d.extracted"), "url")


def next_level(stored: DataFrame, visited: DataFrame, level: int) -> DataFrame:
    """(url, depth): targets of the pages that ``visited`` reached at the level before and that it does not hold yet."""
    frontier = visited.where(F.col("depth") == level - 1).select("url")
    reached = stored.join(frontier, "url", "left_semi").select(F.explode("targets").alias("url")).distinct()
    return reached.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))


def crawl_documents(crawled: DataFrame) -> DataFrame:
    """(file, url, depth, title, …): the document each file name ends up with; on a clash the last URL wins."""
    named = crawled.withColumn("file", doc_expr(file_name("url")))
    row = F.struct(*[c for c in named.columns if c != "file"])
    return named.groupBy("file").agg(F.max_by(row, F.struct("depth", "url")).alias("r")).select("file", "r.*")


def paginate(pages: DataFrame, start: DataFrame, next_selector: str, extract: str, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Follow the first next-link of a page until it is missing, disabled, leads nowhere or back, or ``max_pages`` is reached.

    ``start`` is (url); any number of chains run side by side.  Returns the items (start_url, page_no, pos, item), duplicates
    kept, and the counts (start_url, pages, n_items); ``pages`` counts the next-links taken.

    A page has one next page at most, so the stored pages are lists.  Some of them are heads: the starts, pages without one page before
    them, and one in ``HEAD_EVERY`` by hash.  Every other page finds the head before it by pointers that jump twice as far each time, a number of rounds that the
    distance of heads bounds, whatever the length of the lists; the walks are then made over the heads alone and spread out over the pages behind each.
    A chain that comes back to a page goes on up to ``max_pages``; without a limit it ends there.
    """
    doc = dom(pages, [next_selector, extract])
    nxt = f"get(filter(els, x -> {predicate(next_selector)}), 0)"
    disabled = "x.d IS NOT NULL OR array_contains(split(coalesce(x.c, ''), ' +'), 'disabled')"
    link = f"get(transform(array({nxt}), x -> IF(x IS NULL, NULL, struct({attr('disabled')} AS d, {attr('class')} AS c, {attr('href')} AS h))), 0)"
    doc = doc.select("page_id", "url", doc_expr(_texts(extract)).alias("items"), doc_expr(link).alias("x"))
    doc = doc.withColumn("next_url", doc_expr(f"IF(x IS NULL OR {disabled} OR x.h IS NULL, NULL, {url_join('url', 'x.h')})"))
    # the page with the lowest page_id counts; copies are reduced before they move
    doc = doc.groupBy("url").agg(F.min_by(F.struct("items", "next_url"), "page_id").alias("d")).select("url", "d.*")
    doc = checkpointed(doc)
    starts = checkpointed(start.select("url").distinct())
    segments, hops = _segments(doc, starts)
    walked = checkpointed(starts.join(doc.select("url"), "url", "left_semi").select(F.col("url").alias("start_url"), F.col("url").alias("head"), F.lit(1).cast("bigint").alias("page_no")))
    newest, all_heads = walked, walked
    while True:  # what is known of every walk is put behind itself with jumps over twice as many heads
        more = all_heads.join(hops, "head").select("start_url", F.col("far").alias("head"), (F.col("page_no") + F.col("len")).alias("page_no"))
        if max_pages is None:  # a chain that comes back ends where it does
            more = more.join(all_heads.select("start_url", "head"), ["start_url", "head"], "left_anti").groupBy("start_url", "head").agg(F.min("page_no").alias("page_no"))
        else:
            more = more.where(F.col("page_no") <= max_pages)
        newest = checkpointed(more)
        if newest.isEmpty():
            break
        all_heads = all_heads.unionByName(newest)
        onward = hops.select(F.col("head").alias("far"), F.col("far").alias("further"), F.col("len").alias("more_"))
        hops = checkpointed(hops.join(onward, "far").select("head", F.col("further").alias("far"), (F.col("len") + F.col("more_")).alias("len")))
    rows = salted_join(all_heads, segments, "head", "start_url", how="inner").withColumn("page_no", F.col("page_no") + F.col("behind"))
    if max_pages is not None:
        rows = rows.where(F.col("page_no") <= max_pages)
    out = rows.select("start_url", "page_no", F.posexplode_outer("items").alias("pos", "item")).where("item IS NOT NULL")
    clicks = F.sum(F.col("next_url").isNotNull().cast("bigint"))
    counts = rows.groupBy("start_url").agg(clicks.alias("pages"), F.sum(F.size("items")).cast("bigint").alias("n_items"))
    return out.withColumn("page_no", F.col("page_no").cast("int")), counts


def _segments(doc: DataFrame, starts: DataFrame, every: int = HEAD_EVERY) -> tuple[DataFrame, DataFrame]:
    """((head, behind, url, items, next_url), (head, far, len)): the pages from each head to the one before the next, and the jump there.

    Pages before which no head stands lie on rounds that no start leads to; they are left out.
    """
    links = doc.where("next_url IS NOT NULL").select("url", "next_url").join(doc.select(F.col("url").alias("next_url")), "next_url", "left_semi")
    links = checkpointed(links)
    before = links.groupBy(F.col("next_url").alias("url")).agg(F.count("*").alias("n_"), F.min("url").alias("before_"))
    nodes = doc.select("url").join(before, "url", "left").join(starts.withColumn("start_", F.lit(True)), "url", "left")
    head = F.coalesce(F.col("n_") != 1, F.lit(True)) | F.coalesce("start_", F.lit(False)) | (F.pmod(F.xxhash64("url"), F.lit(every)) == 0)
    known = checkpointed(nodes.select("url", F.when(head, F.col("url")).otherwise(F.col("before_")).alias("to"), F.when(head, 0).otherwise(1).cast("bigint").alias("behind"), head.alias("done")))
    left = None
    while True:
        open_ = known.where("NOT done")
        now = open_.count()
        if now in (0, left):  # as many as before: what is left never meets a head
            break
        left = now
        on = known.select(F.col("url").alias("to"), F.col("to").alias("further"), F.col("behind").alias("more_"), F.col("done").alias("ends_"))
        moved = open_.join(on, "to").select("url", F.col("further").alias("to"), (F.col("behind") + F.col("more_")).alias("behind"), F.col("ends_").alias("done"))
        known = checkpointed(known.where("done").unionByName(moved))
    segments = checkpointed(known.where("done").select("url", F.col("to").alias("head"), "behind").join(doc, "url"))
    last = segments.groupBy("head").agg(F.max_by("url", "behind").alias("url"), (F.max("behind") + 1).alias("len"))
    hops = checkpointed(last.join(links, "url").select("head", F.col("next_url").alias("far"), "len"))
    return segments, hops


def batch_urls(urls: DataFrame, pages: DataFrame, extract: str | None = None) -> DataFrame:
    """(line_no, url, texts, title, error): one row per requested URL, duplicates included.

    ``urls`` is (line_no, url).  With a selector the texts of its matches, else the title; URLs without a page give an error.
    Pages are narrowed to that before they meet the URLs, so no HTML moves.
    """
    title = H.title("toks") if not extract else "CAST(NULL AS STRING)"
    doc = dom(pages, [extract] if extract else ["title"]).select("page_id", "url", doc_expr(_texts(extract)).alias("texts"), doc_expr(title).alias("title"))
    # one row per URL, the lowest page_id, reduced before it moves
    found = doc.groupBy("url").agg(F.min_by(F.struct("texts", "title", F.lit(True).alias("ok")), "page_id").alias("f")).select("url", "f.*")
    out = salted_join(urls, found, "url", "line_no")
    return out.withColumn("error", F.when(F.col("ok").isNull(), F.lit("page not stored"))).drop("ok")


def in_corpus(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct link targets without a stored page: (href)."""
    return links.select("href").distinct().join(pages.select(F.col("url").alias("href")), "href", "left_anti")


def extract_steps(pages: DataFrame, steps: list[dict]) -> DataFrame:
    """(page_id, step, action, selector, data ARRAY, status, error): ordered steps, all on one element list per page.

    A step is {'goto': url}, {'extract': {'selector': s}} or {'wait': {…}}.  Steps before the first ``goto`` run on every page; a
    ``goto`` selects the stored page of its URL (the lowest page_id) for the steps behind it, and an unknown URL is an error row without a page.
    Anything else is an unknown action with status 'error'.
    """
    selectors = [s["extract"]["selector"] for s in steps if "extract" in s]
    targets = [s["goto"] for s in steps if "goto" in s]
    structs, here = [], "true"
    for n, step in enumerate(steps, 1):
        action = next((a for a in ("goto", "extract", "wait") if a in step), "unknown")
        selector, data, status, error = "CAST(NULL AS STRING)", "CAST(NULL AS array<string>)", "'success'", "CAST(NULL AS STRING)"
        if action == "goto":
            here = f"url = {lit(step['goto'])} AND counts"
            data = "array(url)"
        elif action == "extract":
            path = step["extract"]["selector"]
            inner = f"filter(transform(filter(els, x -> {predicate(path)}), x -> {H.text_content('x')}), s -> s <> '')"
            selector, data, status = lit(path), f"transform({inner}, s -> {js_trim('s')})", "CAST(NULL AS STRING)"
        elif action == "unknown":
            status, error = "'error'", lit(f"Unknown action: {next(iter(step), '')}")
        row = f"struct({n} AS step, {lit(action)} AS action, {selector} AS selector, {data} AS data, {status} AS status, {error} AS error)"
        structs.append(f"IF({here}, {row}, NULL)")
    first = captures(pages.where(F.col("url").isin(targets))) if targets else None
    source = pages if targets and "goto" not in steps[0] else pages.where(F.col("url").isin(targets)) if targets else pages
    doc = dom(source, selectors or ["title"])
    if first is None:
        doc = doc.withColumn("counts", F.lit(True))
    else:  # one row per goto: as long as the list of steps
        doc = doc.join(F.broadcast(first.withColumnRenamed("page_id", "first_")), "url", "left").withColumn("counts", F.col("page_id").eqNullSafe(F.col("first_")))
    out = doc.select("page_id", F.explode_outer(doc_expr(f"filter(array({', '.join(structs)}), r -> r IS NOT NULL)")).alias("r")).where("r IS NOT NULL")
    out = out.select("page_id", "r.*")
    if first is None:
        return out
    asked = pages.sparkSession.createDataFrame([(n, s["goto"]) for n, s in enumerate(steps, 1) if "goto" in s], "step int, url string")
    lost = asked.join(F.broadcast(first), "url", "left_anti")
    missing = lost.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "step", F.lit("goto").alias("action"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("array<string>").alias("data"), F.lit("error").alias("status"), F.concat(F.lit("page not stored: "), F.col("url")).alias("error"))
    return out.unionByName(missing)
