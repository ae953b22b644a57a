"""Repair of conversation structure through a suffix-shared automaton of turn signatures.

A turn's signature is the initial of its role and its first fault, one character; a conversation is the string of them.  What repairing a
suffix costs in a state of the role grammar does not depend on what stands before it, so equal suffixes are one node, and every
node holds, per grammar state, the cost to go and the first edit of the best audit, computed once for all conversations.

Equal strings are reduced to one before they move.  The distinct ones are dealt out by ranges of their reversed spelling and sorted there, so
strings that share a suffix meet: the nodes in memory are those of one string, the next one keeps the nodes of the common suffix and makes the others.
The texts move once, to be rewritten turn by turn in order.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.tables import written

DARK = r"[^\x20\x09-\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs of edits, and of a truncated turn that stays
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"  # and any other
CHUNK = 4096  # signature characters joined at a time
# grammar states: 0 nothing yet, 1 system, 2 user, 3 assistant; a conversation may end in 0 and 3
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # initial -> state before -> state after
_NEXT = (2, 2, 3, 2)  # the state that a role fitting the grammar leads to: user, user, assistant, user
_FITTING = {2: "user", 3: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(``conv_id:turn``) % 20, for trials of the repair; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("fault_"))
    text = F.when(F.col("fault_") == 1, "").when(F.col("fault_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault_") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault_") == 3, 2).otherwise(1)
    out = rows.where("fault_ > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy_"))
    return out.drop("copy_")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


_ORDER = ["turn", "role", "digest"]


def _sorting() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature): per conversation the numbers missing between its turns and its turns' signatures in order.

    Turns are ordered by (turn, role, SHA-256 of the text), nulls first.  Texts stay where they are: a row is sent as its role's initial,
    its faults and the digest.
    """
    dark, ended = F.col("text").rlike(DARK), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    # the digest stands for the text in the order and in the test of equal turns
    narrow = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    narrow = narrow.select("conv_id", "turn", "role", _digest().alias("digest"), F.when(~dark, 1).when(~ended, 3).otherwise(0).alias("fault"))
    whole = Window.partitionBy("conv_id").orderBy(*_sorting())
    placed = narrow.withColumn("place", F.row_number().over(whole)).withColumn("before", F.lag("turn").over(whole))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    fault = F.when(F.col("fault") == 1, 1).when(seen, 2).otherwise(F.col("fault"))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    kind = F.when((F.col("role") == "") | (initial == 0), len(INITIALS)).otherwise(initial - 1)
    marked = placed.select(
        "conv_id", "turn", "place", F.char(F.lit(97) + 4 * fault + kind).alias("mark"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).cast("bigint").alias("another"),
    )
    chunks = marked.groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "mark"))), lambda x: x["mark"]), "").alias("marks"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("another").alias("turns"),
    )
    out = chunks.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "marks"))), lambda x: x["marks"]), "").alias("signature"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
    )
    return out.select("conv_id", "gaps", "signature")


class SuffixPath:
    """The nodes of one signature string, from the end: node k is the suffix of k characters, node 0 the end.

    Per node and grammar state the cost to go and the letter of the first edit; per node how many faults and illegal neighbours follow.
    Flat arrays, about 70 bytes a turn.
    """

    def __init__(self) -> None:
        self.text = ""  # reversed
        self.cost = array("q", (0, 2 * INSERT, INSERT, 0))
        self.letter = bytearray(b" II ")
        self.counts = array("q", (0, 0, 0, 0))  # blank, duplicate, truncated, illegal
        self.made = 0

    def move(self, backwards: str) -> None:
        """Keeps the nodes of the common suffix and makes those of the rest."""
        same = len(os.path.commonprefix((self.text, backwards)))
        del self.cost[4 * same + 4 :], self.letter[4 * same + 4 :], self.counts[4 * same + 4 :]
        follows = ord(backwards[same - 1]) - 97 & 3 if same else None
        for mark in backwards[same:]:
            fault, kind = divmod(ord(mark) - 97, 4)
            self._node(fault, kind)
            counts = list(self.counts[-4:])
            if fault:
                counts[fault - 1] += 1
            if follows is not None and (kind, follows) not in _LEGAL:
                counts[3] += 1
            self.counts.extend(counts)
            follows = kind
        self.made += len(backwards) - same
        self.text = backwards

    def _node(self, fault: int, kind: int) -> None:
        after = self.cost[-4:]
        best = []
        for state in range(4):
            options = [(DELETE + after[state], "D")]
            if fault not in (1, 2):
                stays = TRUNCATED if fault == 3 else 0
                if state in _KEPT[kind]:
                    options.append((stays + after[_KEPT[kind][state]], "K"))
                options.append((stays + REROLE + after[_NEXT[state]], "R"))
            best.append(min(options))
        # an inserted turn leads to another state of the same node; two of them never lead back at a gain
        user, assistant = min(best[2], (INSERT + best[3][0], "I")), min(best[3], (INSERT + best[2][0], "I"))
        best = [min(best[0], (INSERT + user[0], "I")), min(best[1], (INSERT + user[0], "I")), user, assistant]
        self.cost.extend(c for c, _ in best)
        self.letter.extend(ord(x) for _, x in best)

    def audit(self) -> str:
        """The letters of the best edits of the whole string: each node's own letter, then on to the node and state it leads to."""
        node, state, out = len(self.text), 0, []
        while True:
            letter = chr(self.letter[4 * node + state])
            if letter == " ":
                return "".join(out)
            out.append(letter)
            state = _KEPT[ord(self.text[node - 1]) - 97 & 3][state] if letter == "K" else state if letter == "D" else _NEXT[state]
            node -= letter != "I"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, made = SuffixPath(), 0
    for batch in batches:
        out = []
        for signature in batch.column("signature").to_pylist():
            path.move(signature[::-1])
            out.append((signature, *path.counts[-4:], path.cost[-4], path.audit(), path.made - made))
            made = path.made
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        names = ("signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "new_nodes")
        types = (pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def audits(signed: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit, new_nodes), one row per distinct signature.

    ``new_nodes`` are the automaton's nodes made for the string, the rest of it having been there.
    """
    distinct = signed.select("signature").distinct().withColumn("backwards", F.reverse("signature"))
    # very many strings with one long common ending are parted by hash as well
    dealt = distinct.repartitionByRange(F.substring("backwards", 1, 256), F.xxhash64("signature")).sortWithinPartitions("backwards")
    return dealt.mapInArrow(_audits, "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, new_nodes bigint")


def diagnosed(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``rows`` (conv_id, turn, role, text).

    Faults: blank (no visible character), duplicate (role and text seen earlier in the conversation), truncated (the last visible
    character ends no sentence); the first that holds counts.  Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for blank and
    duplicate turns), Insert an empty user or assistant turn 5; a truncated turn that stays adds 5.  The audit has the
    initials of the cheapest edits that make the roles system?, (user, assistant)+ or nothing; of equal cost the least in ASCII.

    A null role or text is one space; a null conv_id is a conversation.  Turns equal in ``turn`` are ordered by role and SHA-256 of the text.  Equal rows
    are duplicates.  An empty table gives an empty result.  Extra columns do not matter.  A conversation is a unit: its digests stream through
    one task, which holds its signature and audit, a few bytes a turn.
    """
    signed = written(signatures(rows))
    return signed.join(audits(signed).drop("new_nodes"), "signature").drop("signature")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns behind the audit of their conversation -> the turns the edits leave, in order."""
    audit, at, state, place = "", 0, 0, 0
    conv, known = None, False
    for batch in batches:
        ids, places, edits, roles, texts = [], [], [], [], []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place
            ids.append(conv)
            places.append(place)
            edits.append(edit)
            roles.append(role)
            texts.append(text)
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, _NEXT[state]
                put("I", _FITTING[state], "")

        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")]
        for given, kind, role, text, edits_of in zip(*columns, strict=True):
            if kind == 0:
                if known:
                    inserted()
                conv, audit, at, state, place, known = given, edits_of, 0, 0, 0, True
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = _NEXT[state]
                role = _FITTING[state]
            else:
                state = _KEPT[INITIALS.index(role[0])][state]
            put(edit, role, text)
        yield _turns(ids, places, edits, roles, texts)
    if known:
        rest = []
        while at < len(audit):
            at, state = at + 1, _NEXT[state]
            rest.append((conv, place, "I", _FITTING[state], ""))
            place += 1
        if rest:
            yield _turns(*map(list, zip(*rest, strict=True)))


def _turns(ids: list, places: list, edits: list, roles: list, texts: list) -> pa.RecordBatch:
    arrays = [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that the audits of ``diagnosed(rows)`` leave, one conversation after the other, each in order.

    ``edit`` is K, R or I; deleted turns are gone, inserted ones have an empty text.  conv_id is an integer.  A partition holds whole conversations in
    order of place.  Every text moves once; a conversation is streamed, not gathered.
    """
    heads = diagnosis.select(F.col("conv_id").cast("bigint"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    given = rows.select(F.col("conv_id").cast("bigint"), F.lit(1).alias("kind"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    given = given.withColumn("digest", _digest()).withColumn("audit", F.lit(None).cast("string"))
    dealt = heads.unionByName(given).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_sorting())
    return dealt.drop("digest", "turn").mapInArrow(_rewritten, "conv_id bigint, place bigint, edit string, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None
    for batch in batches:
        ids, hashes = [], []
        for given, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
            if place == 0:
                if digest is not None:
                    ids.append(conv)
                    hashes.append(digest.hexdigest())
                conv, digest = given, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def repair_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns of ``repaired``, hashed as they pass."""
    return turns.mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): every conversation, damaged, diagnosed and repaired.

    A conversation that has lost all rows has zeros, no audit and the hash of the empty string.
    """
    rows = damaged(conversations)
    found = written(diagnosed(rows))
    hashes = repair_digests(repaired(rows, found))
    every = conversations.select(F.col("conv_id").cast("bigint")).distinct()
    counted = found.withColumnRenamed("conv_id", "found_").join(hashes.withColumnRenamed("conv_id", "hash_"), F.col("found_").eqNullSafe(F.col("hash_")), "left").drop("hash_")
    out = every.join(counted.withColumn("is_found_", F.lit(True)), F.col("conv_id").eqNullSafe(F.col("found_")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
