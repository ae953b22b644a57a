"""Small files that become large documents, and tables that are folders of files."""

from webloom import plans
from webloom.operators import dom
from webloom.operators.extract import link_targets
from webloom.plans import fixtures as fx
from webloom.session import DEALT_ROWS, SPREAD, dealt

QUERIES = plans.load_queries()[0]


def test_a_stream_reads_a_table_of_several_files(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('<a href=/x', id, '>x</a>') AS html")
    for folder in ("several", "one"):
        (tmp_path / folder).mkdir()
    rows.repartition(3).write.parquet(str(tmp_path / "several" / "pages.parquet"))
    rows.toPandas().to_parquet(tmp_path / "one" / "pages.parquet")
    want = sorted((r["page_id"], r["href"]) for r in link_targets(rows).collect())
    for folder in ("several", "one"):
        assert sorted(tuple(r) for r in QUERIES["stream_extract_links"](spark, str(tmp_path / folder)).collect()) == want


def test_an_event_stream_reads_a_table_of_several_files(spark, tmp_path):
    rows = spark.range(30).selectExpr(
        "id AS event_id", "to_timestamp_ntz(concat('2024-01-01 00:00:', lpad(id, 2, '0'))) AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props"
    )
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert {r["n"] for r in QUERIES["stream_monitor"](spark, str(tmp_path)).collect()} == {10}


def test_documents_of_a_small_file_are_written_by_many_tasks(spark, sf_dir):
    before = spark.conf.get(SPREAD)
    spark.conf.unset(SPREAD)
    try:
        assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
        for written in (fx.table_pages, fx.form_pages):
            assert written(spark, sf_dir).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        rows = spark.range(DEALT_ROWS * 20 + 1, numPartitions=1)
        assert dealt(rows).rdd.getNumPartitions() == 21 and dealt(rows).exceptAll(rows).count() == 0
    finally:
        spark.conf.set(SPREAD, before)


def test_deep_ancestors_are_parsed_once(spark, tmp_path):
    # page numbers that come twice meet each other's counts, and a page without text has none
    rows = spark.range(6).selectExpr("IF(id = 5, NULL, id DIV 2) AS p_partkey", "IF(id = 3, NULL, concat('n', id)) AS p_name")
    rows.toPandas().astype({"p_partkey": "Int64"}).to_parquet(tmp_path / "part.parquet")
    found = QUERIES["edge_deep_ancestors"](spark, str(tmp_path))
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    got = sorted((r["page_id"], r["text"], r["section_pos"], r["depth"], r["under_section"], r["under_id"]) for r in found.collect())
    one = (300, 601, 1, 1)
    assert got == sorted([(0, "n0", *one), (0, "n0", *one), (0, "n1", *one), (0, "n1", *one), (1, "n2", *one), (1, "n2", 300, 601, 0, 0), (2, "n4", *one)])


def test_outer_selection_keeps_pages_without_a_match(page):
    doc = dom.dom(page("<p>a<p>b", "<i>c"))
    assert [tuple(r) for r in dom.select(doc, "p", {"text": dom.text()}, outer=True).orderBy("page_id", "pos").select("page_id", "text").collect()] == [(0, "a"), (0, "b"), (1, None)]
    assert dom.select(doc, "p").count() == 2
