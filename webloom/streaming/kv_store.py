"""Key/value stores kept as map state: a clear frees the keys, and a time to live bounds what nothing clears."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 16  # groups over which the keys of one store are dealt
GROUPS = 1 << 14  # groups over which all parts of all stores are dealt
NEAR = 64  # keys in one entry of a list of keys


class KeyValueStore(StatefulProcessor):
    """Live keys of some parts of stores: ``live`` is (store, key) -> (value, seq), ``stores`` says what was cleared and lists the keys.

    Operations may come late and in any order: the one with the highest seq counts, and nothing from before a clear comes back.
    A group costs more than a look into the state, and each look is a call to another process, so a group holds many stores and asks once for each that has
    operations: the entry 0 of a store is the seq of its last clear, the number of further entries, and its first keys with their seq; the further entries
    are keys only, looked up in ``live``.  Keys with a time to live are not listed, as they go by themselves.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "store STRING, key STRING", "value STRING, seq BIGINT", ttlDurationMs=self.ttl_ms)
        self.stores = handle.getMapState("stores", "store STRING, entry INT", "cleared BIGINT, more INT, keys ARRAY<STRING>, seqs ARRAY<BIGINT>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came: dict = {}
        for row in rows:
            seq, ops = row["seq"], came.setdefault(row["store"], [None, {}])
            if row["op"] == "clear":
                ops[0] = seq if ops[0] is None else max(ops[0], seq)
            elif row["key"] is not None and (row["key"] not in ops[1] or ops[1][row["key"]][1] < seq):
                ops[1][row["key"]] = (row["value"], seq)
        for store, (clear, newest) in came.items():
            yield from self.changes(store, clear, newest)

    def changes(self, store: str, clear: int | None, newest: dict) -> Iterator[Row]:
        before, more, keys, seqs = self.stores.getValue((store, 0)) or (None, 0, [], [])
        cleared = before if clear is None else clear if before is None else max(before, clear)
        first, entries = dict(zip(keys, seqs, strict=True)), more
        changed, gone = cleared != before, set()
        if changed:
            far = self.further(store, more)
            gone = {name for held in (first, far) for name, seq in held.items() if seq <= cleared}
            for name in gone:
                if name not in newest or newest[name][1] <= cleared:
                    self.live.removeKey((store, name))
                    yield Row(store=store, key=name, value=None, seq=cleared, gone=True)
            first = {name: seq for name, seq in first.items() if name not in gone}
            if more and not gone.isdisjoint(far):
                kept = [name for name in far if name not in gone]
                entries = -(-len(kept) // NEAR)
                for n in range(entries):
                    self.stores.updateValue((store, n + 1), (None, None, kept[n * NEAR : (n + 1) * NEAR], None))
                for n in range(entries, more):
                    self.stores.removeKey((store, n + 1))
        last = None  # keys of the last entry, once it is added to
        for name, (value, seq) in newest.items():
            if cleared is not None and seq <= cleared:
                continue
            held = None if name in gone else first.get(name)
            if held is None and name not in gone and (entries or self.ttl_ms):
                found = self.live.getValue((store, name))
                held = None if found is None else found[1]
            if held is not None and held >= seq:
                continue
            self.live.updateValue((store, name), (value, seq))
            yield Row(store=store, key=name, value=value, seq=seq, gone=False)
            if self.ttl_ms:
                continue
            if name in first or held is None and len(first) < NEAR:
                first[name], changed = seq, True
            elif held is None:
                if last is None and entries:
                    last = list(self.stores.getValue((store, entries))[2])
                if last is None or len(last) == NEAR:
                    if last is not None:
                        self.stores.updateValue((store, entries), (None, None, last, None))
                    last, entries, changed = [], entries + 1, True
                last.append(name)
        if last is not None:
            self.stores.updateValue((store, entries), (None, None, last, None))
        if changed or entries != more:
            self.stores.updateValue((store, 0), (cleared, entries, list(first), list(first.values())))

    def further(self, store: str, more: int) -> dict:
        """Keys of a store with their seq, those of its first entry aside."""
        if self.ttl_ms:
            return {k[1]: v[1] for k, v in self.live.iterator() if k[0] == store}
        names = [name for n in range(more) for name in self.stores.getValue((store, n + 1))[2]]
        return {name: self.live.getValue((store, name))[1] for name in names}

    def close(self) -> None:
        pass


def kv_live(ops: DataFrame, ttl_ms: int | None = None, parts: int = PARTS) -> DataFrame:
    """(store, key, value, seq, gone): changes of the live keys of every store, from (store, seq, op, key, value) with op set or clear.

    Update mode.  The state holds the live keys only; with ``ttl_ms`` a key that is not set again goes after that time.  The keys of a
    store are dealt over ``parts`` parts, to each of which its clears go, so a busy store is not one group; the parts of all stores are dealt over ``GROUPS`` groups
    (with ``ttl_ms`` each is its own).  What a group holds of a micro-batch is one operation per key.  Needs the state store provider ``PROVIDER`` (``with_map_state``).
    """
    part = F.when(F.col("op") == "clear", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.hash("key"), F.lit(parts))))
    dealt = ops.select("store", "seq", "op", "key", "value", F.explode(part).alias("part"))
    group = F.pmod(F.hash("store", "part"), F.lit(GROUPS)).cast("string") if ttl_ms is None else F.concat("part", F.lit(":"), F.coalesce("store", F.lit("")))
    dealt = dealt.select(group.alias("group"), "store", "seq", "op", "key", "value")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return dealt.groupBy("group").transformWithState(KeyValueStore(ttl_ms), "store STRING, key STRING, value STRING, seq BIGINT, gone BOOLEAN", "Update", mode)


class with_map_state:
    """Streams started inside keep their state where map state can live."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def __exit__(self, *error: object) -> None:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", self.before)


def live_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(store, key): what the state of a ``kv_live`` stream started with ``jobs.start`` in ``folder`` holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "live").load()
    return state.select(F.col("user_map_key.store").alias("store"), F.col("user_map_key.key").alias("key"))
