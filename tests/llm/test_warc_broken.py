"""Archives with broken parts, many members and long chains of links."""

import base64
import gzip
import hashlib

import pytest

from webloom.llm import warc


def record(kind, rid, block, *more, size=None):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block) if size is None else size}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


A, B, LARGE = record("resource", "a", b"one"), record("resource", "b", b"two"), record("resource", "l", bytes(range(256)) * 3000)


@pytest.mark.parametrize(
    "content,ids,error",
    [
        (A + B, ["<a>", "<b>"], None),
        (gzip.compress(A) + gzip.compress(B), ["<a>", "<b>"], None),
        (gzip.compress(A + LARGE) + gzip.compress(b"") + gzip.compress(LARGE + B), ["<a>", "<l>", "<l>", "<b>"], None),
        (gzip.compress(A) + bytes(8), ["<a>"], None),
        (gzip.compress(A) + b"junk", ["<a>"], "no gzip member"),
        (gzip.compress(A) + gzip.compress(LARGE)[:-900], ["<a>"], "cut short"),
        (A + record("resource", "b", b"two", size=10), ["<a>"], "record cut short: 7 of 10 bytes"),
        (A + b"no header here\r\n\r\n", ["<a>"], "no WARC record header"),
        (A + b"WARC/1.0\r\nWARC-Type: x", ["<a>"], "no WARC record header"),
        (A + record("resource", "b", b"two", size="ten"), ["<a>"], "no valid Content-Length"),
        (b"", [], None),
        (b"\r\n\r\n", [], None),
    ],
)
def test_parts_that_cannot_be_read_end_in_an_error(content, ids, error):
    found = list(warc._parsed(content))
    assert [f["warc-record-id"][0] for f, _, _ in found if f] == ids
    broken = [e for f, _, e in found if f is None]
    assert (not broken) if error is None else len(broken) == 1 and error in broken[0]


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_pieces_of_any_size_give_the_same_bytes(piece):
    content = gzip.compress(A + LARGE[:9000]) + gzip.compress(b"tail\r\n\r\nend")
    source = warc.Source(content, piece)
    got = source.until(b"\r\n\r\n") + b"\r\n\r\n" + source.take(5000)
    rest = source.until(b"tail\r\n\r\n") + b"tail\r\n\r\n" + source.take(100)
    assert got + rest == A + LARGE[:9000] + b"tail\r\n\r\nend" and not source.more()


def test_reading_a_folder_with_broken_files(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    files = {
        "good": gzip.compress(record("resource", "a", b"one", f"WARC-Block-Digest: sha1:{digest}", f"WARC-Payload-Digest: sha1:{digest}")) + bytes(8),
        "short": B + record("resource", "c", b"three", size=99),
        "wrong": record("resource", "d", b"four", f"WARC-Block-Digest: sha1:{digest}"),
        "date": record("metadata", "e", b"").replace(b"2024-01-01T", b"2024-13-99T"),
        "length": record("revisit", "f", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n", "Content-Type: application/http"),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = warc.read_records(spark, str(tmp_path)).select("record_id", "error").collect()
    got = {r["record_id"]: r["error"] for r in rows}
    assert got == {"<a>": None, "<b>": None, None: "record cut short: 9 of 99 bytes", "<d>": "warc-block-digest differs", "<e>": "no valid WARC-Date", "<f>": None}
    assert len(rows) == 6


def links(spark, *rows):
    made = [(rid, kind, list(to), None, None, None, None, b"", 0, None) for rid, kind, to in rows]
    got = warc.captures(spark.createDataFrame(made, warc.RECORD_SCHEMA)).collect()
    return {r["capture_id"]: sorted(x["record_id"] for x in [*r["requests"], *r["metadata"]]) for r in got}


def test_every_link_counts_over_any_number_of_records(spark):
    chain = [(f"m{k}", "metadata", [f"m{k - 1}"] if k else ["R"]) for k in range(9)]
    got = links(
        spark,
        ("R", "response", []), *chain,
        ("Y", "response", []), ("Z", "revisit", ["Y"]), ("both", "metadata", ["Y", "Z"]),
        ("A-req", "request", []), ("M", "metadata", ["A-req", "Z"]),
        ("o1", "metadata", ["o2"]), ("o2", "metadata", ["o1", "W"]), ("W", "resource", ["o2"]), ("self", "metadata", ["self"]),
    )
    assert got == {"R": [f"m{k}" for k in range(9)], "Y": ["both"], "Z": ["M", "both"], "W": ["o1", "o2"]}
