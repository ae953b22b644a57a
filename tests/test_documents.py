"""The document query gives the whole document: text, length and words beside title and selector."""

from oracle import compare, connect
from webloom.plans import load_queries


def test_smart_document_gives_text_length_and_words(spark, tmp_path):
    def html(page_id, words):
        head = f"<!DOCTYPE html><html><head><title>T {page_id} &amp; x</title><style>p{{}}</style></head><body><nav><ul><li><a href=\"/a\">one</a></li></ul></nav><!-- ad -->"
        return f"{head}<article><h1>T {page_id}</h1><p><b>bold<br><p>{'word ' * words}end.</p></article><footer>&copy; h@x</footer></body></html>"

    rows = [(1, "https://h.example/1", html(1, 60)), (2, "https://h.example/2", html(2, 3)), (2, "https://h.example/2", html(2, 3))]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    queries, sql = load_queries()
    got = {r["page_id"]: r for r in queries["smart_document"](spark, str(tmp_path)).collect()}
    article = "# T 1\n\n**bold  \n**\n\n" + "word " * 60 + "end."
    assert got[1]["selector_used"] == "article" and got[2]["selector_used"] == "body"
    assert (got[1]["content"], got[1]["content_length"], got[1]["word_count"]) == (article, len(article), len(article.split()))
    assert got[2]["content"].startswith("* [one](/a)\n\n# T 2\n\n") and got[2]["content"].endswith("© h@x")
    assert got[2]["word_count"] == len(got[2]["content"].split())
    files = f"{tmp_path}/pages.parquet/*.parquet"
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{files}'")
    assert compare(spark, con, str(tmp_path), queries["smart_document"], sql["smart_document"]) == ""
