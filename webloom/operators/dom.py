"""Pages as token and element tables, and selection on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.intervals import enclosing, nearest
from webloom.functions.selectors import attribute_of, inline_tags, is_flat, predicate, tags_of
from webloom.functions.sqltext import doc_expr, first_few, lit
from webloom.functions.text import js_trim


def dom(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """``pages`` with the parsed columns in place of ``html``; one row per page, no shuffle.

    ``toks`` are the tokens, ``txt`` the text of each token, ``els`` the elements, ``ats`` the attributes of each
    element; Catalyst drops the ones a query does not read.  With ``selectors`` given, elements that none of them can touch are left out.
    """
    return parsed(pages, selectors).drop("html")


def parsed(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    inline = None if selectors is None else inline_tags(selectors)
    doc = pages.withColumn("toks", doc_expr(H.tokens("html")))
    doc = doc.withColumn("txt", doc_expr(H.texts("toks"))).withColumn("els", doc_expr(H.elements("toks", inline)))
    return doc.withColumn("ats", doc_expr(H.attribute_maps("toks", "els")))


def tagged(pages: DataFrame, selector: str) -> DataFrame:
    """Like ``parsed`` for questions about tags and attributes: a selector of single steps is tested on start tags alone."""
    if not is_flat(selector):
        return parsed(pages, [selector])
    names = tags_of(selector)
    doc = pages.withColumn("toks", doc_expr(H.tokens("html")))
    doc = doc.withColumn("els", doc_expr(H.start_tags("toks", sorted(names) if names else None)))
    return doc.withColumn("ats", doc_expr(H.attribute_maps("toks", "els")))


def with_tokens(pages: DataFrame) -> DataFrame:
    """``pages`` with ``toks`` in place of ``html``, for operators that need no element ends."""
    return pages.withColumn("toks", doc_expr(H.tokens("html"))).drop("html")


def rows_of(df: DataFrame, array: str, *keep: str, outer: bool = False) -> DataFrame:
    """One row per struct of the array expression, plus the kept columns; with ``outer`` a row of NULLs for an empty array.

    The outer form keeps the optimiser from repeating the array expression in a filter below the explode.
    """
    out = df.select(*keep, F.explode_outer(doc_expr(array)).alias("r_"))
    return (out if outer else out.where("r_ IS NOT NULL")).select(*keep, "r_.*")


def keep_pages(doc: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """Rows of ``doc`` that meet a condition on parsed columns.

    The condition passes through a one-row explode, which keeps the optimiser from moving it below the parsed columns
    and computing them again for it.
    """
    return rows_of(doc, f"array(struct({condition} AS keep_))", *columns).where("keep_").drop("keep_")


def select(doc: DataFrame, selector: str, columns: dict[str, str] | None = None, keep: tuple[str, ...] = ("page_id",), rooted: bool = False, limit: int | None = None, outer: bool = False) -> DataFrame:
    """One row per matching element in document order.

    ``columns`` maps a name to SQL text over ``x`` (the element) and the parsed columns.  ``rooted``: the first step has no parent.
    ``limit``: the first so many matches of a page only.  ``outer``: pages without a match stay, with NULLs.
    """
    fields = {"pos": "x.s", **({"tag": "x.tag"} if columns is None else columns)}
    struct = "struct(" + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + ")"
    found = first_few(f"filter(els, x -> {predicate(selector, rooted=rooted)})", limit)
    return rows_of(doc, f"transform({found}, x -> {struct})", *keep, outer=outer)


def limit(rows: DataFrame, n: int, order: str = "pos", by: str = "page_id") -> DataFrame:
    """The first ``n`` rows of every page in ``order``, all of them for 0; for the rows of any operator.

    The rank is cut off in front of the exchange as well, so no page sends more than ``n`` rows from a task.  Rows equal in ``order`` are taken in any order.
    ``select`` has a limit of its own, which costs no exchange.
    """
    if n < 0:
        raise ValueError("a limit is 0 or more")
    if not n:
        return rows
    ranked = rows.withColumn("rank_in_page_", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.where(F.col("rank_in_page_") <= n).drop("rank_in_page_")


def text(x: str = "x") -> str:
    return js_trim(H.text_content(x))


def attr(name: str, x: str = "x") -> str:
    return attribute_of(x, name)


def first_of(selector: str, value: str) -> str:
    """Value of the first matching element, NULL when nothing matches."""
    return f"get(transform(slice(filter(els, x -> {predicate(selector)}), 1, 1), x -> {value}), 0)"


def count_of(selector: str) -> str:
    return f"CAST(size(filter(els, x -> {predicate(selector)})) AS BIGINT)"


def has(selector: str) -> str:
    return f"exists(els, x -> {predicate(selector)})"


def token_table(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tok, kind, tag): the lossless token table."""
    out = with_tokens(pages).select("page_id", F.posexplode_outer("toks").alias("pos", "tok")).where("pos IS NOT NULL")
    return out.select("page_id", "pos", "tok", doc_expr(H.token_kind("tok")).alias("kind"), doc_expr(H.tag_name("tok")).alias("tag"))


def element_table(pages: DataFrame) -> DataFrame:
    """(page_id, start_pos, end_pos, own_end, tag, id, classes, attrs, depth, parent_start)"""
    struct = (
        "struct(x.s AS start_pos, x.e AS end_pos, x.own AS own_end, x.tag AS tag, ats[x.i] AS attrs, x.d AS depth, get(els, x.p).s AS parent_start)"
    )
    out = rows_of(dom(pages), f"transform(els, x -> {struct})", "page_id")
    classes = doc_expr(f"filter(split(coalesce(attrs['class'], ''), {lit(r'[ \t\r\n\f]+')}), c -> c <> '')")
    return out.withColumn("id", doc_expr("attrs['id']")).withColumn("classes", classes)


def text_content(doc: DataFrame, selector: str) -> DataFrame:
    """(page_id, pos, text): trimmed text of every match."""
    return select(doc, selector, {"text": text()})


def closest(doc: DataFrame, selector: str, ancestor: str) -> DataFrame:
    """(page_id, pos, closest_pos, closest_tag): nearest ancestor-or-self that matches, NULL when there is none."""
    near = f"IF({predicate(ancestor)}, x, get(els, {nearest('x.i', enclosing(predicate(ancestor, 'a')))}))"
    return select(doc, selector, {"closest_pos": f"{near}.s", "closest_tag": f"{near}.tag"})


def nth_child(doc: DataFrame, selector: str, n: int, value: str | None = None) -> DataFrame:
    """Matches that are the n-th child of their parent, 1-based: (page_id, pos, text)."""
    out = select(doc, selector, {"text": value or text(), "nth": "x.nth"})
    return out.where(F.col("nth") == n).drop("nth")


def path_query(doc: DataFrame, steps: list[tuple[str, str]], attribute: str | None = None, as_text: bool = False) -> DataFrame:
    """XPath-style steps [(axis, test)], axis '/' (child) or '//' (descendant), test such as ``div`` or ``a[rel=next]``.

    The result is the attribute ('' when missing), the trimmed text, or the outer HTML, in document order.
    """
    if not steps:
        raise ValueError("a path needs at least one step")
    selector = ""
    for axis, test in steps:
        if axis not in ("/", "//"):
            raise ValueError(f"unknown axis: {axis!r}")
        selector += (" > " if axis == "/" else " ") + test if selector else test
    value = f"coalesce({attr(attribute)}, '')" if attribute else text() if as_text else H.outer_html("toks", "x")
    return select(doc, selector, {"result": value}, rooted=steps[0][0] == "/")


def inner_html(doc: DataFrame, selector: str) -> DataFrame:
    """Inner HTML of the first match per page, NULL without a match."""
    return doc.select("page_id", doc_expr(first_of(selector, H.inner_html("toks", "x"))).alias("html"))


def outer_html(doc: DataFrame, selector: str | None = None) -> DataFrame:
    """Outer HTML of the first match per page; the whole document without a selector."""
    value = "array_join(toks, '')" if selector is None else first_of(selector, H.outer_html("toks", "x"))
    return doc.select("page_id", doc_expr(value).alias("html"))
