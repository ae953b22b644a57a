"""Personal data: fixed rules, and a skip-chain conditional random field over the tokens that could hold it.

Rules find e-mail addresses, IP addresses, card and phone numbers (the base spans).  The field then labels every token that holds a digit or
an @; any other token is O by definition, so it cuts the chain and takes part in no message.  Factors: token features, pairs
of neighbours, and skip edges that join each token to the previous one in the document with the same key (its letters and digits without
punctuation, or the last digits of a long number).  Edges follow the chain of occurrences, never all pairs.  Loopy
sum-product messages run over all documents of a block at once; where a number is plainly a phone number once, its
other spellings in the document are drawn to the same label.  Tokens labelled with at least ``CERTAIN`` probability that no base span covers
become added spans.

Weights are fitted by pseudo-likelihood on tokens of about ``TRAIN_ROWS`` documents drawn by a hash of their id (at most
``TRAIN_TOKENS`` tokens each), labelled by the rules; the bounds hold at every table size.

All patterns are matched in linear time: addresses grow from their @, dotted and spaced digit chains are taken whole.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows get equal answers.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["o", *KINDS]
TRAIN_ROWS = 1500
TRAIN_TOKENS = 128
CERTAIN = 0.9
ROUNDS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[0x30:0x3A] = _CANDIDATE[0x40] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                out.append((1, start, start + size))
            start += size + 1
    for found in _DIGITS.finditer(text):
        if found.end() - found.start() >= 16:
            digits = found.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
                out.append((3, *found.span()))
    return out


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_STRIP = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
_SHAPE = re.compile(r"[0-9]+|[A-Za-z\x80-\U0010ffff]+")
N_SHAPES = 64
N_FEATURES = 32 + N_SHAPES


def _features(token: str, before: str, after: str) -> list[int]:
    """Places of the features that hold."""
    core = _STRIP.sub("", token)
    digits = re.sub(r"[^0-9]", "", core)
    n = len(digits)
    shape = _SHAPE.sub(lambda m: "9" if m.group()[0].isdigit() else "a", core)
    parts = core.split(".")
    flags = [
        True, "@" in core, "@" in core and "." in core.rpartition("@")[2], len(parts) == 4 and n + 3 == len(core), len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts if p.isascii()) and n > 0,
        n == 0, n == 1, n == 2, n == 3, n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n >= 20,
        core.startswith("+"), core.startswith("("), "-" in core, core.isdigit(), 16 <= n <= 19 and luhn(digits), len(core) > 24, any(c.isalpha() for c in core),
        before.startswith("+"), before.startswith("("), before[:1].isdigit(), after.startswith("("), after[:1].isdigit(), "=" in before, core[-1:] == ")", n > 0 and n < len(core) // 2, not core,
    ]
    h = int.from_bytes(hashlib.md5(shape[:24].encode()).digest()[:4], "little") % N_SHAPES
    return [k for k, f in enumerate(flags) if f] + [32 + h]


def _key(token: str) -> str:
    """What repeated and similar tokens share."""
    plain = "".join(c for c in token if c.isalnum()).lower()
    digits = "".join(c for c in plain if c.isdigit())
    return digits[-7:] if len(digits) >= 7 and len(digits) == len(plain) else plain


class Graph:
    """Candidate tokens of a block of documents with their chain and skip edges."""

    def __init__(self, block: X.Block):
        starts, ends = X.spans(block, X.DARK_BYTES)
        holds = np.concatenate([[0], np.cumsum(_CANDIDATE[block.data])])
        self.index = np.flatnonzero(holds[ends] > holds[starts]) if len(starts) else np.zeros(0, np.int64)
        row_of = np.searchsorted(block.offsets, starts, "right") - 1
        self.row = row_of[self.index]
        self.start, self.end = starts[self.index], ends[self.index]
        lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        self.place = lead[self.start] - lead[block.offsets[:-1][self.row]] if len(self.index) else np.zeros(0, np.int64)
        raw = block.data.tobytes()
        text = lambda k: raw[starts[k] : ends[k]].decode("utf-8", "replace")
        self.tokens = [text(k) for k in self.index]
        n = len(starts)
        same = lambda a, b: 0 <= b < n and row_of[a] == row_of[b]
        self.features = [_features(t, text(k - 1)[:40] if same(k, k - 1) else "", text(k + 1)[:40] if same(k, k + 1) else "") for t, k in zip(self.tokens, self.index, strict=True)]
        chain = np.flatnonzero((np.diff(self.index) == 1) & (np.diff(self.row) == 0)) if len(self.index) else np.zeros(0, np.int64)
        self.chain = np.stack([chain, chain + 1])
        seen: dict[tuple[int, str], int] = {}
        skip = []
        for k, (r, t) in enumerate(zip(self.row.tolist(), self.tokens, strict=True)):
            key = (r, _key(t))
            if key in seen and len(key[1]) > 2:
                skip.append((seen[key], k))
            seen[key] = k
        self.skip = np.array(skip, np.int64).reshape(-1, 2).T

    def gold(self, spans_of: dict[int, list[tuple[int, int, int]]]) -> np.ndarray:
        """Labels by the rules: the kind of the span that overlaps the token."""
        out = np.zeros(len(self.tokens), np.int64)
        by_row: dict[int, list[int]] = {}
        for k, r in enumerate(self.row.tolist()):
            by_row.setdefault(r, []).append(k)
        for r, places in by_row.items():
            place = self.place[places]
            size = np.array([len(self.tokens[k]) for k in places])
            for kind, a, b in spans_of.get(r, ()):
                lo, hi = np.searchsorted(place + size, a, "right"), np.searchsorted(place, b, "left")
                out[places[lo:hi]] = kind + 1
        return out


class SkipChainCRF:
    def __init__(self):
        n = len(LABELS)
        self.unary = np.zeros((N_FEATURES, n))
        self.next = np.zeros((n, n))  # left label, right label
        self.skip = np.zeros((n, n))

    def scores(self, features: list[list[int]]) -> np.ndarray:
        size = np.array([len(f) for f in features], np.int64)
        flat = self.unary[np.concatenate(features).astype(np.int64)] if len(features) else np.zeros((0, len(LABELS)))
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) if len(features) else flat

    def fit(self, rows: list[tuple[list[int], int, int, int, int, int]], epochs: int = 60, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Pseudo-likelihood over (features, label, left, right, earlier, later label or -1)."""
        if not rows:
            return
        n = len(LABELS)
        x = np.zeros((len(rows), N_FEATURES))
        for k, r in enumerate(rows):
            x[k, r[0]] = 1
        y, left, right, early, late = (np.array([r[k] for r in rows]) for k in range(1, 6))
        hot = lambda v: (v[:, None] == np.arange(n)).astype(float)
        l_, r_, e_, a_, target = hot(left), hot(right), hot(early), hot(late), hot(y)
        grads = [np.zeros_like(w) for w in (self.unary, self.next, self.skip)]
        for _ in range(epochs):
            z = x @ self.unary + l_ @ self.next + r_ @ self.next.T + (e_ + a_) @ self.skip
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target) / len(rows)
            skip = (e_ + a_).T @ d
            for w, g, s in zip((self.unary, self.next, self.skip), (x.T @ d, l_.T @ d + d.T @ r_, (skip + skip.T) / 2), grads, strict=True):
                s += g * g  # Adagrad
                w -= rate * (g / (np.sqrt(s) + 1e-8) + decay * w)

    def marginals(self, graph: Graph, rounds: int = ROUNDS, damping: float = 0.5) -> np.ndarray:
        """Beliefs after loopy sum-product over chain and skip edges, all documents at once."""
        own = self.scores(graph.features)
        a = np.concatenate([graph.chain[0], graph.skip[0]])
        b = np.concatenate([graph.chain[1], graph.skip[1]])
        pair = np.concatenate([np.broadcast_to(self.next, (graph.chain.shape[1], *self.next.shape)), np.broadcast_to(self.skip, (graph.skip.shape[1], *self.skip.shape))])
        forth, back = np.zeros((len(a), len(LABELS))), np.zeros((len(a), len(LABELS)))
        total = own
        for _ in range(rounds if len(a) else 0):
            total = own.copy()
            np.add.at(total, b, forth)
            np.add.at(total, a, back)
            new_forth = _lse((total[a] - back)[:, :, None] + pair, 1)
            new_back = _lse((total[b] - forth)[:, None, :] + pair, 2)
            forth = damping * forth + (1 - damping) * (new_forth - new_forth.max(axis=1, keepdims=True))
            back = damping * back + (1 - damping) * (new_back - new_back.max(axis=1, keepdims=True))
        if len(a):
            total = own.copy()
            np.add.at(total, b, forth)
            np.add.at(total, a, back)
        p = np.exp(total - total.max(axis=1, keepdims=True)) if len(total) else total
        return p / p.sum(axis=1, keepdims=True) if len(p) else p


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _texts(block: X.Block, rows) -> dict[int, list[tuple[int, int, int]]]:
    raw = block.data.tobytes()
    return {r: base_spans(raw[block.offsets[r] : block.offsets[r + 1]].decode("utf-8", "replace")) for r in rows}


def _training(batches):
    for batch in batches:
        out = []
        for block in X.blocks(batch.column("text")):
            graph = Graph(block)
            gold = graph.gold(_texts(block, np.unique(graph.row).tolist()))
            around = np.full((4, len(gold)), -1)
            around[0][graph.chain[1]] = gold[graph.chain[0]]
            around[1][graph.chain[0]] = gold[graph.chain[1]]
            around[2][graph.skip[1]] = gold[graph.skip[0]]
            around[3][graph.skip[0]] = gold[graph.skip[1]]
            for r in np.unique(graph.row):
                mine = np.flatnonzero(graph.row == r)
                mine = mine[np.unique(np.linspace(0, len(mine) - 1, min(len(mine), TRAIN_TOKENS)).astype(int))]
                out += [([*graph.features[k]], int(gold[k]), *map(int, around[:, k])) for k in mine]
        if out:
            names = ["features", "label", "l", "r", "e", "a"]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.int32())), *[pa.array([x[k] for x in out], pa.int32()) for k in range(1, 6)]], names)


def trained(docs: DataFrame, rows: int = TRAIN_ROWS) -> SkipChainCRF:
    """A field fitted on the tokens of about ``rows`` documents that hold a digit or an @; equal rows count once."""
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    scale = 1 << 30
    count = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("crf"), "doc_id", "text"), F.lit(scale)) < (min(scale, scale * rows // count) if count else 0))
    drawn = drawn.where("text RLIKE '[0-9@]'").select("doc_id", "text").distinct()
    got = drawn.select("text").mapInArrow(_training, "features array<int>, label int, l int, r int, e int, a int").collect()
    model = SkipChainCRF()
    model.fit(sorted((list(r["features"]), r["label"], r["l"], r["r"], r["e"], r["a"]) for r in got))
    return model


def _added(graph: Graph, p: np.ndarray, spans_of: dict[int, list[tuple[int, int, int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of neighbouring tokens with one certain label that touch no base span."""
    label = np.where(p.max(axis=1) >= CERTAIN, p.argmax(axis=1), 0) if len(p) else np.zeros(0, np.int64)
    base = graph.gold(spans_of) > 0
    linked = np.zeros(len(label), bool)
    linked[graph.chain[1]] = True
    out: dict[int, list[tuple[int, int, int]]] = {}
    k = 0
    while k < len(label):
        if not label[k]:
            k += 1
            continue
        end = k + 1
        while end < len(label) and linked[end] and label[end] == label[k]:
            end += 1
        if not base[k:end].any():
            first, last = graph.tokens[k], graph.tokens[end - 1]
            lead = len(first) - len(re.sub(r"^[^0-9A-Za-z+(]+", "", first))
            tail = len(last) - len(re.sub(r"[^0-9A-Za-z)]+$", "", last))
            a, b = int(graph.place[k]) + lead, int(graph.place[end - 1]) + len(last) - tail
            if a < b:
                out.setdefault(int(graph.row[k]), []).append((int(label[k]) - 1, a, b))
        k = end
    return out


def _find(batches, model: SkipChainCRF, keep: list[str]):
    for batch in batches:
        n = batch.num_rows
        counts, digests, spelled, extra = np.zeros((4, n), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n, np.zeros(n, np.int64)
        for block in X.blocks(batch.column("text")):
            graph = Graph(block)
            base = _texts(block, np.unique(graph.row).tolist())
            more = _added(graph, model.marginals(graph), base)
            for r, found in base.items():
                at = block.first + r
                for kind, _, _ in found:
                    counts[kind, at] += 1
                digests[at] = hashlib.sha256(_spelled(found).encode()).hexdigest()
                spelled[at] = _spelled(found + more.get(r, []))
                extra[at] = len(more.get(r, []))
        columns = [*[batch.column(c) for c in keep], *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spelled, pa.string()), pa.array(extra)]
        yield pa.RecordBatch.from_arrays(columns, [*keep, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame, model: SkipChainCRF, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``; counts and digest of the base spans; all spans as kind:start:end; how many the field added."""
    keep = list(carry)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(partial(_find, model=model, keep=keep), schema)
