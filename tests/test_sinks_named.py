"""Named documents: what failed and repeated tasks have written is never seen."""

import os

import pyarrow as pa
import pytest

from webloom.sources.documents_sink import DocumentsWriter, read_named, safe_name, write_named


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["file", "content"])


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files)


def test_a_failed_and_repeated_task_leaves_no_stray_file(tmp_path):
    writer = DocumentsWriter(str(tmp_path), False)

    def broken():
        yield batch(("a", "half"), ("stray", "x"))
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(broken())
    messages = [writer.write(iter([batch(("a", "whole"), ("b", None))])), writer.write(iter([])), None, writer.write(iter([batch(("c", "é"))]))]
    writer.commit(messages)
    assert [f.split("/")[1] for f in tree(tmp_path)] == ["a", "b", "c"] and len(os.listdir(tmp_path)) == 2
    assert sorted(open(tmp_path / f, encoding="utf-8").read() for f in tree(tmp_path)) == ["", "whole", "é"]


def test_a_failed_job_leaves_nothing_and_keeps_what_was_there(tmp_path):
    first = DocumentsWriter(str(tmp_path), False)
    first.commit([first.write(iter([batch(("a", "1"))]))])
    before = tree(tmp_path)
    second = DocumentsWriter(str(tmp_path), True)
    second.abort([second.write(iter([batch(("b", "2"))])), None])
    assert tree(tmp_path) == before and len(os.listdir(tmp_path)) == 1
    third = DocumentsWriter(str(tmp_path), True)
    third.commit([third.write(iter([batch(("b", "2"))]))])
    assert [f.split("/")[1] for f in tree(tmp_path)] == ["b"]


def test_names(spark, tmp_path):
    names = ["plain", "a/b", ".hidden", "_under", "50%", "x" * 400, "x" * 399 + "y", "ü+ö ?&", "line\nbreak", ""]
    assert len({safe_name(n) for n in names}) == len(names)
    assert all(len(safe_name(n).encode()) <= 255 and "/" not in safe_name(n) and safe_name(n)[0] not in "._" for n in names)
    rows = [(n, f"text of {k}\n\nend") for k, n in enumerate(names) if len(n) < 300 and n]
    write_named(spark.createDataFrame(rows, "file STRING, content STRING").repartition(3), f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in read_named(spark, str(tmp_path / "out")).collect()) == sorted(rows)


def test_a_task_reads_the_folder_of_a_task(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('n', id, IF(id % 3 = 0, ' ä+%', '')) AS file", "IF(id % 10 = 9, NULL, concat('text\n', id)) AS content")
    write_named(rows.repartition(5, "file"), str(tmp_path))
    write_named(rows.repartition(7, "file"), str(tmp_path), overwrite=True)
    (tmp_path / "_pending-x").mkdir()
    (tmp_path / "_pending-x" / "stray").write_text("x")
    got = read_named(spark, str(tmp_path))
    # by bytes of files, all of them would be a hundred tasks of 32 files each, listed by the driver
    assert got.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where("content IS NOT NULL").collect()))
    assert read_named(spark, str(tmp_path / "_pending-x")).count() == 1
    (tmp_path / "none").mkdir()
    assert read_named(spark, str(tmp_path / "none")).count() == 0
