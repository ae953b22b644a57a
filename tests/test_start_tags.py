"""Questions about tags and attributes are answered from start tags; the list of elements is not built for them."""

from webloom.operators import audit, extract, recon

HTML = "<title><a href=/no></title><ul><li><a href=/1>x<a href=/2 style='color: red; COLOR:blue'>y<img alt=''><img alt=z></ul><svg><a href=https://o/3 /></svg><p id=i><area href=mailto:b><a name=n>w<div class='c d' style=color:green><script><a href=/no></script><p"


def _ends(df) -> bool:
    """Whether the plan holds the fold over the tags that finds where elements end."""
    return "flatten(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_a_check_are_found_without_element_ends(page):
    pages = page(HTML, "", None, url="https://h/d/")
    bare, whole = audit.checked_links(pages, texts=False), audit.checked_links(pages)
    assert not _ends(bare) and _ends(whole)
    assert sorted(map(repr, bare.collect())) == sorted(map(repr, whole.drop("text").collect()))
    status = pages.sparkSession.createDataFrame([("https://h/1", 200), ("https://h/2", 404)], "url STRING, status INT")
    rows = [tuple(r) for r in audit.broken_link_summary(pages, status).orderBy("page_id").collect()]
    assert rows == [(0, 4, 3, 2), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_page_checks_count_start_tags(page):
    pages = page(HTML, "", None, url="https://h/d/")
    checks = audit.page_checks(pages)
    assert not _ends(checks)
    assert [tuple(r)[2:] for r in checks.orderBy("page_id").collect()] == [(2, 1, 4, 3, 14), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_styles_of_single_steps_need_no_element_ends(page):
    styles = extract.inline_styles(page(HTML, "<i>"), "a[style], .c")
    assert not _ends(styles)
    assert [r["styles"] for r in styles.orderBy("page_id").collect()] == [{"color": "blue"}, {}]


def test_selectors_of_single_steps_need_no_element_ends(page):
    found = recon.element_selectors(page(HTML, "<i>"), "p, div, area", "click")
    assert not _ends(found)
    assert [r["selector"] for r in found.orderBy("pos").collect()] == ["#i", "area", ".c"]


def test_paths_still_find_ancestors(page):
    styles = extract.inline_styles(page(HTML), "li > a[style]")
    assert _ends(styles) and styles.first()["styles"] == {"color": "blue"}
    assert [r["selector"] for r in recon.element_selectors(page(HTML), "p div", "click").collect()] == []
