"""Deep-shallow sorting of many short suffixes at once.

Shallow: multikey quicksort with eight bytes as one key.  All groups are partitioned by their next key together, and only suffixes
that still tie go on, down to ``SHALLOW`` bytes.  Deep: what still ties there shares a long prefix; each such group goes into a blind
trie, which branches on single bytes, finds its place by looking at branching bytes alone and compares one whole suffix per insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Inner nodes are [depth, {byte or -1: child}], leaves are (suffix, rows)."""

    def __init__(self, suffix: bytes, row: int):
        self.root: list | tuple = (suffix, [row])

    def add(self, suffix: bytes, row: int) -> None:
        node = self.root
        while isinstance(node, list):  # blind: only branching bytes are looked at
            key = suffix[node[0]] if node[0] < len(suffix) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        if node[0] == suffix:
            node[1].append(row)
            return
        depth = _lcp(node[0], suffix)
        seen, parent, edge, here = node[0], None, None, self.root
        while isinstance(here, list) and here[0] < depth:
            parent, edge = here, suffix[here[0]]
            here = here[1][edge]
        own = suffix[depth] if depth < len(suffix) else -1
        if isinstance(here, list) and here[0] == depth:
            here[1][own] = (suffix, [row])
            return
        inner = [depth, {own: (suffix, [row]), seen[depth] if depth < len(seen) else -1: here}]
        if parent is None:
            self.root = inner
        else:
            parent[1][edge] = inner

    def in_order(self):
        """(rows of equal suffixes, bytes shared with the suffix before; -1 for the first)."""
        todo: list = [(self.root, -1)]
        while todo:
            node, shared = todo.pop()
            if not isinstance(node, list):
                yield node[1], len(node[0]), shared
                continue
            keys = sorted(node[1])
            todo += [(node[1][k], node[0]) for k in reversed(keys[1:])] + [(node[1][keys[0]], shared)]


def sort_suffixes(group: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows by group and suffix; shared[k] is what the k-th shares with the one before, -1 across groups."""
    n = len(group)
    order = np.argsort(group, kind="stable")
    shared = np.full(n, -1, np.int64)
    if not n:
        return order, shared
    tied = np.zeros(n, bool)  # with the one before, so far
    tied[1:] = group[order][1:] == group[order][:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = ends - starts
    weight = np.arange(8)
    for depth in range(0, shallow, 8):
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rows = order[at]
        left = np.clip(size[rows] - depth, 0, 8)
        cells = padded[np.minimum(starts[rows] + depth, len(data))[:, None] + weight]
        cells = np.where(weight < left[:, None], cells, 0)
        key = np.ascontiguousarray(cells).view(">u8").ravel().astype(np.uint64)
        segment = np.cumsum(~tied)[at]
        by = np.lexsort((left, key, segment))
        order[at], key, left = rows[by], key[by], left[by]
        same = np.zeros(len(at), bool)
        same[1:] = (key[1:] == key[:-1]) & (left[1:] == left[:-1])
        was = tied[at]
        split = was & ~same
        if split.any():
            k = np.flatnonzero(split)
            differ = key[k] ^ key[k - 1]
            equal = np.full(len(k), 8)
            for b in range(8):
                equal = np.where((equal == 8) & ((differ >> np.uint64(56 - 8 * b)) & np.uint64(255) != 0), b, equal)
            shared[at[k]] = depth + np.minimum(equal, np.minimum(left[k], left[k - 1]))
            tied[at[k]] = False
        whole = was & same & (left < 8)  # both end here: equal suffixes
        k = np.flatnonzero(whole)
        shared[at[k]] = size[order[at[k]]]
    # a suffix that ended above is equal to the one before; the rest of a tied run goes deep
    ends_here = size[order] < shallow
    heads = np.flatnonzero(~tied)
    tails = np.concatenate([heads[1:], [n]])
    deep = np.flatnonzero((tails - heads > 1) & ~ends_here[heads])
    raw = data.tobytes()
    for lo, hi in zip(heads[deep].tolist(), tails[deep].tolist(), strict=True):
        rows = order[lo:hi].tolist()
        trie = BlindTrie(raw[starts[rows[0]] : ends[rows[0]]], rows[0])
        for r in rows[1:]:
            trie.add(raw[starts[r] : ends[r]], r)
        k = lo
        for equal, length, before in trie.in_order():
            for place, r in enumerate(equal):
                order[k] = r
                if k > lo:
                    shared[k] = length if place else before
                k += 1
    for lo, hi in zip(heads.tolist(), tails.tolist(), strict=True) if ends_here.any() else ():
        if hi - lo > 1 and ends_here[lo]:
            shared[lo + 1 : hi] = size[order[lo + 1 : hi]]
    return order, shared
