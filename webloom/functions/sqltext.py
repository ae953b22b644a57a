"""Small helpers for writing Spark SQL expression text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: str) -> str:
    """A SQL string literal; backslashes and quotes are escaped."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def in_list(expr: str, values: Iterable[str]) -> str:
    return f"{expr} IN ({', '.join(lit(v) for v in values)})"


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` to ``name`` inside ``body`` so it is evaluated once.

    An ``aggregate`` over no elements hands its start value to the finish function; unlike ``transform`` it does not
    copy the result.
    """
    return f"aggregate(CAST(array() AS array<int>), {value}, (acc_, elem_) -> acc_, {name} -> {body})"


_ONCE: dict[str, str] = {}
_ONCE_NAME = re.compile(r"\bonce_[0-9a-f]{16}\b")


def once(value: str) -> str:
    """A name for SQL text over the columns of a row, which ``doc_expr`` binds once per row however often and deep inside a lambda it stands."""
    name = "once_" + hashlib.sha256(value.encode()).hexdigest()[:16]
    _ONCE[name] = value
    return name


def with_shared(text: str) -> str:
    """Binds the names of ``once`` in front of the text, those that others need first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in sorted(set(_ONCE_NAME.findall(_ONCE[name]))):
                visit(needed)
            order.append(name)

    for name in sorted(set(_ONCE_NAME.findall(text))):
        visit(name)
    for name in reversed(order):
        text = let(name, _ONCE[name], text)
    return text


_SLICED = re.compile(r"slice\((toks|txt|els),")


def in_memory(text: str) -> str:
    """Bind the parsed columns that ``text`` slices to plain arrays.

    ``slice`` turns the whole stored array of a row into objects each time it is called; over a copy made once per row it costs
    only its own length, which keeps pages with very many elements linear.
    """
    for name in sorted(set(_SLICED.findall(text))):
        text = let(name, f"transform({name}, copy_ -> copy_)", text)
    # a column that stands in one place is put there by the optimiser, inside a lambda once per element
    return let("ats", "ats", text) if "ats[" in text else text


def doc_expr(text: str) -> Column:
    """Column of SQL text over the parsed columns of a page."""
    return F.expr(in_memory(with_shared(text)))


def first_few(array: str, n: int | None) -> str:
    """The first n entries of an array, all without a limit."""
    return array if n is None else f"slice({array}, 1, {int(n)})"


def cut(text: str, n: int | None) -> str:
    """The first n characters, all without a limit."""
    return text if n is None else f"substr({text}, 1, {int(n)})"
