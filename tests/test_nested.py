"""Pages whose tags end the innermost element only are folded by runs of tags; the element list is that of the full fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.sqltext import doc_expr

TAGS = "div p span a ul li table tr td th tbody caption select option optgroup dl dt dd br hr img section button body svg path template x-box object".split()


def full_fold(monkeypatch, toks="toks"):
    with monkeypatch.context() as m:
        m.setattr(H, "_TAGS", -1)
        return H.elements(toks)


def nested_only(monkeypatch, toks="toks"):
    """Whether the fold by runs gives the list."""
    real, asked = H._nested, []
    with monkeypatch.context() as m:
        m.setattr(H, "_nested", lambda t: asked.append(f"IF({real(t)} IS NULL, array(0), array(1))") or "NESTED")
        text = H.elements(toks)
    full = text[text.index("coalesce(NESTED, "):]
    return f"{text.replace(full, asked[0])}) = array(1)"


def some_html(rnd, depth, tags):
    out = ""
    for _ in range(rnd.randint(0, 4)):
        case, tag = rnd.random(), rnd.choice(tags)
        if case < 0.2 or depth > 8:
            out += "x"
        elif case < 0.3:
            out += rnd.choice([f"<{tag}>", f"</{tag}>", f"<{tag}/>", "<br><title>a<b></title>"])
        elif case < 0.45:
            out += rnd.choice(["<select><option>1<option>2</select>", "<ul><li>1<li>2<li><b>3</b></ul>", "<table><tr><td>1<td>2<tr><td>3</table>"])
        else:
            out += f"<{tag}>{some_html(rnd, depth + 1, tags)}</{tag}>"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_elements_as_the_full_fold(page, monkeypatch, seed):
    monkeypatch.setattr(H, "_FEW", 0)
    rnd = random.Random(seed)
    pages = ["", "<div>" * 1100, "<ul>" + "<li>x</li>" * 300 + "<p>y</ul>", "<div><div/></div>", "</a><b>", "<svg><path/><g>t</g></svg>"]
    pages += [some_html(rnd, 0, rnd.sample(TAGS, rnd.randint(1, 6))) for _ in range(600)]
    doc = page(*pages).repartition(8).withColumn("toks", doc_expr(H.tokens("html")))
    doc = doc.select("html", doc_expr(H.elements("toks")).alias("els"), doc_expr(full_fold(monkeypatch)).alias("full"))
    assert [r["html"] for r in doc.where("NOT (els <=> full)").select("html").limit(3).collect()] == []


def test_pages_that_need_no_search_are_folded_by_runs(page, monkeypatch):
    row = "<tr><td>1</td><td>2<td>3</tr>"
    plain = ["<section>" + "<div>" * 520 + "<p>x", f"<table><tbody>{row * 30}</tbody></table>", "<ul>" + "<li><a href=x>y</a><br></li>" * 40 + "</ul>"]
    searched = ["<div>" * 70 + "</p>", "<p><b>" * 40, "<table>" + "<tr><td>1<td>2" * 30 + "</table>"]
    doc = page(*plain, *searched).withColumn("toks", doc_expr(H.tokens("html")))
    rows = doc.select("page_id", doc_expr(nested_only(monkeypatch)).alias("n")).orderBy("page_id").collect()
    assert [r["n"] for r in rows] == [True] * 3 + [False] * 3


def test_deep_pages_cost_less_than_a_step_per_tag(spark, monkeypatch):
    doc = spark.range(0, 2400, 1, 8).select(F.expr("concat('<section>', repeat('<div>', 520), '<p>', id)").alias("html"))
    doc = doc.withColumn("toks", doc_expr(H.tokens("html")))

    def seconds(els):
        start = time.time()
        doc.select(doc_expr(f"size({els})")).write.format("noop").mode("overwrite").save()
        return time.time() - start

    new, full = H.elements("toks"), full_fold(monkeypatch)
    assert min(seconds(new) for _ in range(3)) < 0.8 * min(seconds(full) for _ in range(3))
