"""Sets of word n-grams of whole texts as 63-bit hashes, and the prefix keys under which similar sets must meet.

A set of more than ``WHOLE`` members is split by hash into so many parts that each has about ``PART`` members at most.  If two sets have a
Jaccard similarity of t or more, one part of the one and the same part of the other have it too, since the whole ratio is a
mean of the parts' ratios.  Within a part, members stand in one global order, common ones last.  Similar parts of n members
share ``SHARED`` of their first n - ceil(t n) + ``SHARED`` members (all they must share, if that is less): these prefix
members are the keys.  A set is keyed for every number of parts that a similar smaller set could use.

Every part that keeps enough shared keys is sent, however few of a set's parts do: the one similar part may be the only one, as common
members stand last and a set's own members may fill the keys of its other parts.
"""

from __future__ import annotations

import numpy as np

from webloom.llm import textops as X

PART = 96
WHOLE = 256
SHARED = 4
BINS = 24
BINNED = 100
U = np.uint64
TOP = U(1 << 63)


def ceil_share(n, num: int, den: int):
    return -(-n * num // den)


def word_hashes(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds per row) of the lower-case words between blanks."""
    low = X.Block(block.first, block.offsets, X.LOWER[block.data])
    starts, ends = X.spans(low, X.DARK_BYTES)
    return X.span_hash(X.prefix_sums(low.data), starts, ends), np.searchsorted(starts, block.offsets)


def gram_sets(block: X.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, bounds per row): distinct n-grams of each row, ascending; a shorter row is one gram."""
    words, bounds = word_hashes(block)
    size = np.diff(bounds)
    grams = X.gram_hash(words, n) >> U(1)
    count = np.maximum(size - n + 1, 0)
    at = X.ranges(bounds[:-1], count)
    rows, members = np.repeat(np.arange(len(block)), count), grams[at]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        one = np.array([X.gram_hash(words[bounds[r] : bounds[r + 1]], size[r])[0] >> U(1) for r in short], U)
        rows, members = np.concatenate([rows, short]), np.concatenate([members, one])
    order = np.lexsort((members, rows))
    rows, members = rows[order], members[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (members[1:] != members[:-1])
    rows, members = rows[new], members[new]
    return members, np.searchsorted(rows, np.arange(len(block) + 1))


def set_id(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per set; equal sets share it."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(X.mixed(members + U(0x632BE59BD9B4E019)), dtype=U)])
    return X.mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (np.diff(bounds).astype(U) * U(0x9E3779B97F4A7C15)))


def level_of(size: int) -> int:
    """log2 of the number of parts of a set."""
    return 0 if size <= WHOLE else int(np.ceil(np.log2(size / PART)))


def minima(members: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per set): the least member of each of ``BINS`` bins, for sets that can be similar to one of ``BINNED`` members or more.

    Two sets share a bin's minimum with a chance of their similarity, so at 0.8 or more fewer than ``SHARED`` of them are shared with
    a chance below 1e-11: a set whose minima nobody shares needs no further look.
    """
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    value = X.mixed(members + U(0xA0761D6478BD642F))
    least = np.full((len(size), BINS), U(2**64 - 1))
    np.minimum.at(least, (row, (value % U(BINS)).astype(np.int64)), X.mixed(value))
    used = (least != U(2**64 - 1)) & (size >= ceil_share(BINNED, num, den))[:, None]
    return X.mixed(least + np.arange(BINS, dtype=U))[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))])


def levels(size: int, num: int, den: int) -> list[int]:
    """Levels under which a set meets similar sets: its own, for larger ones, and that of the smallest similar one."""
    return sorted({level_of(int(ceil_share(size, num, den))), level_of(size)})


def ordered(members: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Members with the common ones moved behind all others."""
    if not len(common):
        return members
    near = np.minimum(np.searchsorted(common, members), len(common) - 1)
    return members | (TOP * (common[near] == members).astype(U))


def split(members: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(members by part and order, bounds of the 2**level parts)."""
    part = (X.mixed(members & ~TOP) & U((1 << level) - 1)).astype(np.int64) if level else np.zeros(len(members), np.int64)
    order = np.lexsort((members, part))
    return members[order], np.searchsorted(part[order], np.arange((1 << level) + 1))


def keyed(members: np.ndarray, level: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(members by part and order, bounds of the parts, keys, part of each key in order)."""
    placed, bounds = split(members, level)
    size = np.diff(bounds)
    need = ceil_share(size, num, den)
    head = np.minimum(size - need + np.minimum(SHARED, need), size)
    part = np.repeat(np.arange(len(size)), head)
    return placed, bounds, X.mixed(placed[X.ranges(bounds[:-1], head)] * U(0x9E3779B97F4A7C15) + (U(level << 48) + part.astype(U) + U(1))), part


def keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """All keys of a set."""
    found = [keyed(members, level, num, den)[2] for level in levels(len(members), num, den)] if len(members) else []
    return np.concatenate(found) if found else np.zeros(0, U)


def sent(kept: np.ndarray, part: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which keys the parts are sent to, given which of them another set has too.

    A similar part shares at least ``SHARED`` of them (or all it must share); the first of those it shares has that many less one behind it.
    """
    least = np.minimum(SHARED, ceil_share(size, num, den))
    count = np.bincount(part[kept], minlength=len(size))
    order = np.cumsum(kept) - np.concatenate([[0], np.cumsum(count)])[part]  # 1 for a part's first kept key
    return kept & (order <= count[part] - least[part] + 1)
