"""Ancestors by interval: an element encloses another one when its run of list positions does.

An element with position ``i`` and ``z`` behind its last descendant encloses the element at ``k`` when i < k < z.  The elements that a
condition holds for are collected once per page, in document order, with their ends sorted as well; whether, how often or how closely one of
them encloses a given element is then two binary searches, at any depth of nesting.
"""

from __future__ import annotations

from webloom.functions.sqltext import let, once

_FEW, _BLOCK = 16, 64  # looked through without a search; entries summed up by their furthest end


def enclosing(condition: str) -> str:
    """Name of the set of elements ``a`` for which the condition holds; for the functions below."""
    few = f"size(ms_) <= {_FEW}"
    powers = "transform(sequence(CAST(floor(log2(size(ms_))) AS INT), 0, -1), k_ -> CAST(shiftleft(1, k_) AS INT))"
    furthest = f"transform(sequence(0, CAST((size(ms_) - 1) DIV {_BLOCK} AS INT)), k_ -> array_max(transform(slice(ms_, k_ * {_BLOCK} + 1, {_BLOCK}), v_ -> v_.z)))"
    found = "transform(filter(els, a -> %s), a -> struct(a.i AS i, a.z AS z))" % condition
    return once(
        let(
            "ms_",
            found,
            f"struct(ms_ AS m, IF({few}, NULL, sort_array(transform(ms_, v_ -> v_.z))) AS e, IF({few}, NULL, {powers}) AS w, "
            f"IF(size(ms_) <= {_BLOCK}, NULL, {furthest}) AS b)",
        )
    )


def _rank(m: str, test: str) -> str:
    """How many entries from the first on meet a test that holds up to some place only; ``{}`` in the test is the place."""
    return f"aggregate({m}.w, 0, (r_, w_) -> IF(r_ + w_ <= size({m}.m) AND {test.format('r_ + w_ - 1')}, r_ + w_, r_))"


def count_enclosing(i: str, m: str) -> str:
    """How many elements of the set enclose the element at position ``i``."""
    searched = f"{_rank(m, f'{m}.m[{{}}].i < {i}')} - {_rank(m, f'{m}.e[{{}}] <= {i}')}"
    return f"IF(size({m}.m) <= {_FEW}, size(filter({m}.m, v_ -> v_.i < {i} AND {i} < v_.z)), {searched})"


def inside(i: str, m: str) -> str:
    """Whether an element of the set encloses the element at position ``i``."""
    searched = f"{_rank(m, f'{m}.m[{{}}].i < {i}')} > {_rank(m, f'{m}.e[{{}}] <= {i}')}"
    return f"IF(size({m}.m) <= {_FEW}, exists({m}.m, v_ -> v_.i < {i} AND {i} < v_.z), {searched})"


def last_reaching(before: str, over: str, m: str) -> str:
    """Position of the last element of the set that starts before ``before`` and ends behind ``over``, NULL without one."""
    last = "try_element_at(filter({0}, v_ -> v_.i < b_ AND v_.z > o_), -1).i"
    block = let(
        "k_",
        f"array_max(transform(slice({m}.b, 1, at_), (y_, j_) -> IF(y_ > o_, j_, -1)))",
        f"IF(coalesce(k_, -1) < 0, NULL, {last.format(f'slice({m}.m, k_ * {_BLOCK} + 1, {_BLOCK})')})",
    )
    own = last.format(f"slice({m}.m, at_ * {_BLOCK} + 1, {_BLOCK})")
    searched = let("at_", f"CAST(greatest({_rank(m, f'{m}.m[{{}}].i < b_')} - 1, 0) DIV {_BLOCK} AS INT)", f"coalesce({own}, {block})")
    return let("b_", before, let("o_", over, f"IF(size({m}.m) <= {_BLOCK}, {last.format(f'{m}.m')}, {searched})"))


def nearest(i: str, m: str) -> str:
    """Position of the innermost element of the set that encloses the element at position ``i``, NULL without one."""
    return last_reaching(i, i, m)
