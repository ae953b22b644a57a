"""The fold over the tags takes one step for an element without elements, and nothing is sorted by a lambda."""

from webloom.functions import html as H
from webloom.functions.sqltext import doc_expr
from webloom.operators import content


def test_a_start_tag_and_its_own_end_tag_are_one_step(page):
    def tag(place, name, closes="false", sc="false", void="false"):
        return f"struct({place} AS s, {closes} AS closes, '{name}' AS tag, {sc} AS sc, 0 AS cls, {void} AS void)"

    tags = [tag(0, "div"), tag(1, "b"), tag(3, "b", "true"), tag(4, "br", void="true"), tag(5, "br", "true"), tag(6, "a", sc="true"), tag(7, "a", "true"), tag(8, "i", "true")]
    rows = page("").selectExpr(f"array({', '.join(tags)}) AS g").selectExpr(f"explode({H._whole('g')}) AS t").select("t.s", "t.void", "t.e").collect()
    assert [tuple(r) for r in rows] == [(0, False, 0), (1, True, 7), (4, True, 8), (5, False, 10), (6, False, 12), (7, False, 14), (8, False, 16)]


def test_such_an_element_still_ends_others_and_counts_as_a_child(page):
    doc = page("<p>a<div></div>b", "<ul><li></li><li>x<li></li></ul>", "<svg><g/></g></svg>").withColumn("toks", doc_expr(H.tokens("html")))
    rows = doc.select("page_id", doc_expr(f"transform({H.elements('toks')}, x -> struct(x.tag, x.z, x.s, x.e, x.own, x.p, x.nth, x.item))").alias("els")).orderBy("page_id").collect()
    assert [[tuple(x) for x in r["els"]] for r in rows] == [
        [("p", 1, 0, 2, False, -1, 1, 0), ("div", 2, 2, 3, True, -1, 2, 0)],
        [("ul", 4, 0, 7, True, -1, 1, 0), ("li", 2, 1, 2, True, 0, 1, 1), ("li", 3, 3, 5, False, 0, 2, 2), ("li", 4, 5, 6, True, 0, 3, 3)],
        [("svg", 2, 0, 3, True, -1, 1, 0), ("g", 2, 1, 1, False, 0, 1, 0)],
    ]


def test_fragments_and_ends_are_not_sorted_by_a_lambda(page):
    plan = content.html_to_markdown(page("<ul><li>x</ul>"))._jdf.queryExecution().analyzed().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
