"""Line repeats against a plain version, on planted passages and on odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from test_training_data import ODD, odd  # noqa: F401
from webloom.llm import line_repeats
from webloom.llm import textops as X


def plain_units(text):
    """(first line, last line) of every unit."""
    lines = text.encode().split(b"\n")
    hashes = [int(X.span_hash(X.prefix_sums(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]) for x in lines]
    mix = lambda v: int(X.mixed(np.array([v % 2**64], np.uint64))[0])
    marks = [False] + [mix(hashes[k - 1] * 0x9E3779B97F4A7C15 + hashes[k]) % 2 == 0 for k in range(1, len(lines))]
    cuts = [k for k in range(len(lines) - 1) if marks[k] and not marks[k - 1]]
    if cuts and cuts[-1] == len(lines) - 2:
        cuts.pop()
    bounds = [0, *[c + 1 for c in cuts], len(lines)]
    chunks = {(a, b - 1) for a, b in zip(bounds, bounds[1:]) if b - a > 1}
    words = [len(x.split()) for x in lines]
    pairs = {(k, k + 1) for k in range(len(lines) - 1) if words[k] + words[k + 1] >= 8}
    return lines, chunks | pairs | {(k, k) for k, n in enumerate(words) if n >= 50}


def plain(spark, rows):
    """(doc_id, removed lines, hash of the rest) of distinct rows."""
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.where("text IS NOT NULL").select("doc_id", "text", X.row_key().alias("k")).collect()}
    order = sorted(keys, key=lambda x: (x[0] is not None, x[0] or 0, keys[x]))
    first, units = {}, {}
    for doc in order:
        units[doc] = plain_units(doc[1])
        for a, b in sorted(units[doc][1]):
            first.setdefault(b"\n".join(units[doc][0][a : b + 1]), (doc, a, b))
    out = []
    for doc in rows:
        if doc[1] is None:
            out.append((doc[0], 0, hashlib.sha256(b"").hexdigest()))
            continue
        lines, mine = units[doc]
        gone = {k for a, b in mine if first[b"\n".join(lines[a : b + 1])] != (doc, a, b) for k in range(a, b + 1)}
        out.append((doc[0], len(gone), hashlib.sha256(b"\n".join(x for k, x in enumerate(lines) if k not in gone)).hexdigest()))
    return out


def made_rows():
    rng = random.Random(3)
    pool = [f"line {k} " * rng.choice([1, 2, 3, 30]) for k in range(60)] + ["", "x"]
    rows = [*ODD, *[(100 + k, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 12, 40])))) for k in range(150)]]
    return rows + rows[-10:] + [(900 + k, rows[-1][1]) for k in range(5)]


def test_repeats_equal_plain(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("low", F.lit(1)).repartition(4)
    got = [tuple(r) for r in line_repeats.report(docs).select("doc_id", "n_removed", "kept_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain(spark, rows), key=key)


def test_blocks_shorter_than_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 64)
    monkeypatch.setattr(X.blocks, "__defaults__", (64,))
    rows = [(k, t) for k, (_, t) in enumerate(made_rows()) if t is not None and len(t) < 4000]
    batches = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("key_", X.row_key()).toArrow().to_batches()
    found = [r for b in line_repeats._found(batches, 8, 50) for r in b.to_pylist()]
    want = {(d, a, b): b"\n".join(lines[a : b + 1]) for d, t in rows for lines, units in [plain_units(t)] for a, b in units}
    assert sorted((r["doc_id_"], r["low"], r["high"]) for r in found) == sorted(want)
    assert len({(r["h1"], r["h2"]) for r in found}) == len(set(want.values()))
    for batch in batches:
        units = [[{"low": a, "high": b, "h1": 0, "h2": 0, "leads": True} for e, a, b in want if e == d] for d in batch.column("doc_id").to_pylist()]
        asked = batch.append_column("units", pa.array(units, pa.list_(pa.struct([(n, pa.int32()) for n in ("low", "high")] + [(n, pa.int64()) for n in ("h1", "h2")] + [("leads", pa.bool_())]))))
        bodies = [r for b in line_repeats._bodies([asked], 8, 50) for r in b.to_pylist()]
        assert all(r["body"] == want[r["doc_id_"], r["low"], r["high"]] for r in bodies) and len(bodies) == sum(map(len, units))


def test_planted_passages_go_whole(spark):
    """Passages of over 50 words, on 1 to 12 lines, between other lines: later ones go to the last line, and nothing else goes."""
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for k in range(120):
        size = rng.choice([1, 2, 3, 4, 6, 8, 12])
        passage = [own(-(-60 // size)) for _ in range(size)]
        for copy in range(2):
            head, tail = ([own(9) for _ in range(rng.randrange(6))] for _ in range(2))
            rows.append((2 * k + copy, "\n".join(head + passage + tail)))
            want[2 * k + copy] = "\n".join(head + tail if copy else head + passage + tail)
    got = {r["doc_id"]: r["text"] for r in line_repeats.dedupe(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == {d: t for d, t in want.items() if t}


def test_repeats_on_odd_rows(spark, odd):  # noqa: F811
    out = line_repeats.dedupe(odd)
    assert out.columns == odd.columns
    assert out.where("doc_id = 1 AND text IS NULL").count() == 1
    assert line_repeats.dedupe(odd.where("doc_id < 0")).count() == 0
