"""Mixing, prefix intervals and structure repair against plain versions, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import mixing, prefix_intervals, structure_repair
from webloom.session import checkpointed

CONVERSATION = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"



# mixing


def plain_targets(sizes, weights, most):
    """Source sizes in order -> targets, by fixing what is above its limit until nothing is."""
    share = [weights[k % len(weights)] for k in range(len(sizes))]
    held, total = set(), sum(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in held]
        left, mass = total - sum(most * sizes[k] for k in held), sum(share[k] for k in free)
        out = [most * sizes[k] if k in held else left * share[k] / mass for k in range(len(sizes))]
        over = [k for k in free if out[k] > most * sizes[k]]
        if not over:
            return out
        held |= set(over)


def mixture_rows(docs, **how):
    return [r.asDict() for r in mixing.mixture(docs, **how).collect()]


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "é", "Z", None])) for k in range(3000)]
    rows += [(9000, "same words here", "b")] * 4000 + [(None, "no id", "a"), (None, None, None), (5, "", "empty"), (6, None, "empty"), (7, "x y z " * 20000, "small")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(5)
    return checkpointed(docs.withColumns({c: F.lit(c) for c in ("size", "q", "bin", "row_", "level", "target", "place_")}))


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_comes_near_its_targets(odd_documents, weighted):
    rows = mixture_rows(odd_documents, odds=mixing.fuller_first() if weighted else None)
    assert len(rows) == odd_documents.count()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = plain_targets([sum(r["size"] for r in by_source[s]) for s in order], (5, 2, 1), 3)
    for source, target in zip(order, want, strict=True):
        given = by_source[source]
        assert {r["source_size"] for r in given} == {sum(r["size"] for r in given)}
        assert all(math.isclose(r["target"], target, abs_tol=1e-6) for r in given)
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in given)
        sizes = [r["size"] for r in given if r["size"]]
        # no closer than the smallest document allows
        assert abs(sum(r["taken"] for r in given) - target) <= (min(sizes) if sizes else 0) + 1e-6 or source == "small"
        # certain copies are there, and one more at most
        assert all(math.floor(r["expected"] + 1e-9) <= r["copies"] <= math.ceil(r["expected"] - 1e-9) for r in given)


def test_mix_follows_the_plain_ranking(spark):
    """One source and bin: the ranking by random odds over inclusion odds, taken while it fits, is the plain one."""
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(1, 80)), "ab"[k % 3 > 0]) for k in range(900)]
    docs = checkpointed(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING"))
    u = {r["row_"]: r["u"] for r in mixing.sizes(docs, 13).collect()}
    got = mixture_rows(docs, odds=mixing.fuller_first())
    for source in "ab":
        given = [r for r in got if r["source"] == source]
        words, low, high = given[0]["target"], 0.0, 1e9
        for _ in range(200):  # the level by halving
            level = (low + high) / 2
            low, high = (level, high) if sum(r["size"] * min(3, level * math.log10(10 + r["size"])) for r in given) < words else (low, level)
        ranking, taken = [], {}
        for r in given:
            expected = min(3, level * math.log10(10 + r["size"]))
            assert math.isclose(expected, r["expected"], rel_tol=1e-6)
            whole = math.floor(expected + 1e-9)
            taken[r["row_"]] = whole
            part = expected - whole
            if part > 1e-9:
                x = u[r["row_"]]
                ranking.append((x / (1 - x) * (1 - part) / part, r["size"], r["row_"]))
        gap = words - sum(taken[r["row_"]] * r["size"] for r in given)
        left = []
        for _, size, row in sorted(ranking):
            if size <= gap:
                taken[row], gap = taken[row] + 1, gap - size
            else:
                left.append((size, row))
        if left and min(left)[0] < 2 * gap:
            taken[min(left)[1]] += 1
        assert {r["row_"]: r["copies"] for r in given} == taken


def test_mix_of_many_bins_and_reruns(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 97 AS INT)) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    docs = checkpointed(docs)
    key = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    first, again = mixture_rows(docs), mixture_rows(docs.repartition(3))
    assert key(first) == key(again)
    words = Counter()
    for r in first:
        words[r["source"], r["target"]] += r["taken"]
    # as near as the documents of the deciding bins allow
    assert all(abs(taken - target) <= 3 for (_, target), taken in words.items())
    # an equal share of documents of every size
    for low in range(1, 97, 24):
        part = [r for r in first if r["source"] == "hot" and low <= r["size"] < low + 24]
        assert abs(np.mean([r["copies"] - r["expected"] for r in part])) < 0.06


def test_mix_repeats_documents(odd_documents):
    want = Counter()
    for r in mixture_rows(odd_documents):
        want[r["doc_id"]] += r["copies"]
    got = mixing.mixed(odd_documents)
    assert got.columns == odd_documents.columns
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == Counter({k: n for k, n in want.items() if n})


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING")
    assert mixture_rows(empty) == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id BIGINT, text STRING, source STRING")
    assert [(r["size"], r["target"], r["taken"]) for r in mixture_rows(blank)] == [(0, 0.0, 0)] * 2


def test_mix_has_no_python(spark, odd_documents, capsys):
    mixing.mixture(odd_documents).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


# prefix intervals


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    for given in own.values():
        given.sort(key=lambda r: r[:3])
    members, whole = defaultdict(list), {}
    for conv, given in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        sequence = [r[3:] for r in own.get(conv - int(math.fmod(conv, 100)), [])[:h]] + [r[3:] for r in given[h:]]
        whole[conv] = sequence
        for depth in range(len(sequence) + 1):
            members[tuple(sequence[:depth])].append(conv)
    below = defaultdict(list)
    for prefix in members:
        if prefix:
            below[prefix[:-1]].append(prefix)
    sums, out = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        given = members[prefix]
        saved = (len(given) - 1) * len(prefix[-1][1]) if prefix else 0
        sums[prefix] = sum(sums[k][0] for k in below[prefix]) or 1, saved + sum(sums[k][1] for k in below[prefix])
        ended = ",".join(map(str, sorted(c for c in given if len(whole[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out[min(given), len(prefix)] = (parent, len(given), len(below[prefix]), *sums[prefix], hashlib.sha256(ended.encode()).hexdigest())
    return out


def trie_of(df, shard):
    rows = prefix_intervals.report(df, shard).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(5)
    pool = [[(rng.choice("ua"), rng.choice(["x", "yy", "zzz", ""])) for _ in range(rng.randint(1, 9))] for _ in range(30)]
    rows = []
    for conv in range(500):
        shared = rng.choice(pool) if conv % 3 else pool[0]  # a third are copies
        for turn, (role, text) in enumerate(shared[: rng.randint(1, 9)] + [("u", f"own {conv}")] * rng.randint(0, 2)):
            rows.append((conv * 3 - 90, turn if rng.random() > 0.05 else None, role if rng.random() > 0.05 else None, text))
    rows += [(None, 1, "u", "x"), (5000, 1, "u", None), (5000, 1, "u", None)]
    rows += [(c, t, "u", f"long {t}") for c in (6001, 6101) for t in range(700)]
    return rows


@pytest.mark.parametrize("shard", [100_000, 150, 20])
def test_trie_equals_the_plain_one(spark, conversations, shard):
    df = spark.createDataFrame(conversations, CONVERSATION).withColumn("depth", F.lit(1)).withColumn("shard", F.lit("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(df, shard) == plain_trie(conversations)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_the_stored_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert trie_of(df, 100_000) == plain_trie([tuple(r) for r in df.collect()])


def test_trie_of_few(spark):
    assert trie_of(spark.createDataFrame([], CONVERSATION), 10) == {}
    one = [(0, None, None, None)]  # its own anchor: rebuilt from itself
    assert trie_of(spark.createDataFrame(one, CONVERSATION), 10) == plain_trie(one)
    turnless = [(c, 0, "u", "x") for c in range(101, 140)]  # those with h > 0 have no anchor and no turn left
    got = trie_of(spark.createDataFrame(turnless, CONVERSATION), 10)
    assert got == plain_trie(turnless) and got[101, 0][1] == 39


def test_interval_search_against_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 200):
        values = rng.integers(0, 6, n)
        levels = prefix_intervals.range_minima(values)
        at, depth = rng.integers(0, n, 300), rng.integers(0, 7, 300)
        right, left = prefix_intervals.reach_right(levels, at, depth), prefix_intervals.reach_left(levels, at, depth)
        for p, d, r, lft in zip(at, depth, right, left, strict=True):
            want = p
            while want + 1 < n and values[want + 1] >= d:
                want += 1
            assert r == want
            want = p
            while want > 0 and values[want] >= d:
                want -= 1
            assert lft == want
        first = rng.integers(0, n, 100)
        last = np.minimum(first + rng.integers(0, n, 100), n - 1)
        assert prefix_intervals.minima_of(levels, first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]


# structure repair


def plain_repair(rows):
    """Damage, faults and a search over (rows done, last role) by (cost, audit), conversation by conversation."""
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, given in convs.items():
        kept = []
        for turn, role, text in given:
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            dark = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not dark else 2 if (role, text) in seen else 3 if dark[-1] not in ".!?" else 0)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, at, last, repaired = heapq.heappop(heap)
            if at == len(kept) and last in ("", "a"):
                break
            if (at, last) in done:
                continue
            done.add((at, last))
            initial = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
            name = {"u": "user", "a": "assistant"}[initial]
            heapq.heappush(heap, (cost + 5, audit + "I", at, initial, (*repaired, (name, ""))))
            if at == len(kept):
                continue
            _, role, text = kept[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, repaired))
            if faults[at] not in (1, 2):
                more = cost + (5 if faults[at] == 3 else 0)
                if role[:1] == initial or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (more, audit + "K", at + 1, role[0], (*repaired, (role, text))))
                heapq.heappush(heap, (more + 1, audit + "R", at + 1, initial, (*repaired, (name, text))))
        text = "\n".join(f"{r}:{x}" for r, x in repaired)
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def repaired_of(df):
    rows = structure_repair.report(df).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_repair_equals_the_plain_search(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "uXser", None, "User"], ["Yes.", "No!", "cut off", "", "  \n", "Why?\n", None, " ", "é. "]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts)) for c in range(400) for t in range(rng.randint(1, 12))]
    rows += [(None, t, "user", "Yes.") for t in range(5)] + [(1000, t % 7, "assistant", f"{t}.") for t in range(900)] + [(2000, 3, "user", "Hi.")] * 9
    df = spark.createDataFrame(rows, CONVERSATION).withColumn("audit", F.lit("x")).withColumn("kind", F.lit(3)).withColumn("signature", F.lit(""))
    assert repaired_of(df) == plain_repair(rows)


def test_repair_of_the_stored_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert repaired_of(df) == plain_repair([tuple(r) for r in df.collect()])


def test_repair_of_nothing(spark):
    assert repaired_of(spark.createDataFrame([], CONVERSATION)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired_of(spark.createDataFrame([(gone, 0, "user", "x")], CONVERSATION)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_nodes_are_made_once_for_all_conversations(spark):
    rng = random.Random(2)
    signed = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(3000)}
    df = spark.createDataFrame([(s,) for s in signed] * 2, "signature STRING").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = structure_repair.audits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r["signature"] for r in rows} == signed and len(rows) == len(signed)
    assert sum(r["new_nodes"] for r in rows) == len({s[k:] for s in signed for k in range(len(s))})
