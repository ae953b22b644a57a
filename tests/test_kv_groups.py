"""Key/value state in groups of many stores: the same rows with a long list of keys, with one group for all, and from several files a micro-batch."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators.state import kv_fold
from webloom.plans import stream_queries
from webloom.streaming import jobs, kv_store
from webloom.streaming.kv_store import KeyValueStore


class _Map:
    """Map state without Spark; counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def iterator(self):
        self.calls += 1
        return iter(list(self.rows.items()))


def _processor(ttl=None):
    store = KeyValueStore(ttl)
    store.live, store.stores = _Map(), _Map()
    return store


def _row(store, seq, op, key=None):
    return {"store": store, "seq": seq, "op": op, "key": key, "value": f"v{seq}"}


@pytest.mark.parametrize("keys,ttl", [(5, None), (150, None), (400, None), (150, 1000)])
def test_any_order_gives_the_live_keys(keys, ttl):
    dice = random.Random(keys)
    ops = [_row(f"s{dice.randrange(3)}", seq, "clear" if dice.random() < 3 / keys / 4 else "set", f"k{dice.randrange(keys)}") for seq in range(3000)]
    came = sorted(ops, key=lambda r: r["seq"] + dice.random() * 800)
    processor, changes, done = _processor(ttl), {}, []
    for at in range(0, len(came), 200):
        done += came[at : at + 200]
        for r in processor.handleInputRows(("g",), iter(came[at : at + 200]), None):
            changes[r["store"], r["key"]] = r
        cleared = {s: max([r["seq"] for r in done if r["store"] == s and r["op"] == "clear"], default=-1) for s in ("s0", "s1", "s2")}
        want = {}
        for r in done:
            if r["op"] == "set" and r["seq"] > max(cleared[r["store"]], want.get((r["store"], r["key"]), ("", -1))[1]):
                want[r["store"], r["key"]] = (r["value"], r["seq"])
        assert processor.live.rows == want
        assert {k: (r["value"], r["seq"]) for k, r in changes.items() if not r["gone"]} == want


def test_a_store_costs_two_calls_and_its_changes():
    processor = _processor()
    list(processor.handleInputRows(("g",), iter([_row(f"s{n}", n, "clear") for n in range(100)]), None))
    assert (processor.stores.calls, processor.live.calls) == (200, 0)


def test_stores_share_groups_and_files_make_micro_batches(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(kv_store, "GROUPS", 1)
    monkeypatch.setattr(kv_store, "NEAR", 2)
    start = jobs.start
    monkeypatch.setattr(jobs, "start", lambda *a, **k: calls.append(start(*a, **k)) or calls[-1])
    rows = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_micros(id * 1000000) AS ts", "id % 3 AS user_id", "IF(id % 61 = 60, 'signup', 'view') AS event_type", "CAST(id AS DOUBLE) AS value", "concat('{\"k\": ', id % 31, '}') AS props"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    ops = rows.selectExpr("concat('s', user_id) AS store", "event_id AS seq", "IF(event_type = 'signup', 'clear', 'set') AS op", "concat('k', CAST(get_json_object(props, '$.k') AS BIGINT) % 10) AS key", "CAST(value AS STRING) AS value")
    want = {tuple(r) for r in kv_fold(ops).groupBy("store").agg(F.count("*")).collect()}
    whole = stream_queries._kv_stream
    monkeypatch.setattr(stream_queries, "_kv_stream", lambda s, d: whole(s, d, 40))
    got = {tuple(r) for r in stream_queries.stream_kv_state_size(spark, str(tmp_path)).collect()}
    assert got == want
    batches = [p.numInputRows for p in calls[0].recentProgress if p.numInputRows]
    assert batches == [100] * 4
