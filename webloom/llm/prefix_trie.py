"""Similarity join of the sets of many small groups in one prefix tree.

Within each group members are ordered from rare to common; members that only one set has are never stored, they just count as missed.
Sets sorted by their member sequences are the tree: a node is a run of rows that agree on their first members.  All sets
are probed at once, one tree level after the other, so an overlap found on a shared path is counted once for
all sets below it.  A subtree is dropped when even the most it could still share (the shorter of what remains
of the probe and of the longest set below) stays under the required overlap, when it lies before the probe in the order,
or when all of its sets are in the probe's own component already.
"""

from __future__ import annotations

import numpy as np

from webloom.llm import textops as X


def similar_pairs(group: np.ndarray, size: np.ndarray, component: np.ndarray, side: np.ndarray, members: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) pairs of one group with Jaccard at least num / den and different components.

    side: -1 all pairs of the group count, else only those of a row with 0 and a row with 1.
    """
    n = len(group)
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((members, group[row]))
    new = np.ones(len(order), bool)
    new[1:] = (members[order][1:] != members[order][:-1]) | (group[row[order]][1:] != group[row[order]][:-1])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    held = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((np.arange(len(held)), held))] = np.arange(len(held))
    keep = held[ids] > 1 if len(ids) else np.zeros(0, bool)
    row, token = row[keep], rank[ids[keep]]
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    length = np.bincount(row, minlength=n)
    start = np.concatenate([[0], np.cumsum(length)])
    width = int(length.max()) if n else 0
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    # rows in tree order
    table = np.full((n, width + 1), -1, np.int64)
    table[row, np.arange(len(row)) - start[row]] = token
    spelled = np.concatenate([group[:, None], table + 1], axis=1).astype(">u4")
    place = np.argsort(np.ascontiguousarray(spelled).view(f"V{4 * spelled.shape[1]}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
    table, length, g = table[place], length[place], group[place]
    size, component, side = size[place], component[place], side[place]
    flat = (np.repeat(np.arange(n), length) * (len(held) + 1)) + table[table >= 0]
    start = np.concatenate([[0], np.cumsum(length)])
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    shared = np.where(g[1:] == g[:-1], np.argmin(same, axis=1), -1) if n > 1 else np.zeros(0, np.int64)
    shared = np.concatenate([[-1], shared])  # members a row shares with the row before; -1: another group

    # nodes of every depth: first row, end, and what bounds need
    def nodes(depth: int):
        reach = np.flatnonzero(length >= depth)
        if not len(reach):
            return None
        opens = shared[reach] < depth
        opens[1:] |= np.diff(reach) > 1
        first = reach[opens]
        cut = np.flatnonzero(opens)
        end = reach[np.concatenate([cut[1:], [len(reach)]]) - 1] + 1
        return first, end, np.maximum.reduceat(length[reach], cut), np.minimum.reduceat(size[reach], cut), np.minimum.reduceat(component[reach], cut), np.maximum.reduceat(component[reach], cut), np.maximum.reduceat(side[reach], cut)

    first, end, *_ = level = nodes(0)
    probe = np.flatnonzero(side <= 0)
    at = np.searchsorted(first, probe, "right") - 1
    overlap = np.zeros(len(probe), np.int64)
    out_a, out_b = [], []
    depth = 0
    while len(probe):
        first, end = level[0], level[1]
        # sets that end here
        ends = np.cumsum(np.concatenate([[0], length == depth]))
        stop = ends[end[at]] - ends[first[at]]
        a = np.repeat(probe, stop)
        b = X.ranges(first[at], stop)
        common = np.repeat(overlap, stop)
        good = (den * common >= num * (size[a] + size[b] - common)) & (component[a] != component[b]) & ((b > a) | (side[b] == 1)) & (side[b] != 0)
        good |= (den * common >= num * (size[a] + size[b] - common)) & (component[a] != component[b]) & (side[a] < 0) & (b > a)
        out_a.append(a[good])
        out_b.append(b[good])
        below = nodes(depth + 1)
        if below is None:
            break
        lo, hi = np.searchsorted(below[0], first[at], "left"), np.searchsorted(below[0], end[at], "left")
        probe, overlap, at = np.repeat(probe, hi - lo), np.repeat(overlap, hi - lo), X.ranges(lo, hi - lo)
        token = table[below[0][at], depth]
        wanted = probe * (len(held) + 1) + token
        found = np.searchsorted(flat, wanted)
        hit = (found < len(flat)) & (flat[np.minimum(found, len(flat) - 1)] == wanted)
        overlap = overlap + hit
        most = overlap + np.minimum(length[probe] - (found - start[probe]) - hit, below[2][at] - depth - 1)
        keep = den * most >= num * (size[probe] + below[3][at] - most)
        keep &= ~((below[4][at] == component[probe]) & (below[5][at] == component[probe]))
        keep &= np.where(side[probe] < 0, below[1][at] - 1 > probe, below[6][at] == 1)
        probe, overlap, at = probe[keep], overlap[keep], at[keep]
        level, depth = below, depth + 1
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return place[a], place[b]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, taken in order, join two components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep[k] = True
    return keep
