"""Scalar text functions as Spark SQL expression text.

Every function takes SQL expression text and returns SQL expression text, so it can be used inside
higher-order functions as well as in a plain projection through ``F.expr``.
"""

from __future__ import annotations

from html.entities import html5

from webloom.functions.sqltext import let, lit

# The white space that String.prototype.trim removes.
JS_SPACE = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)

# The date spellings that count as a date.
DATE_PATTERN = (
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
    r"|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b"
    r"|\b\d{4}-\d{2}-\d{2}\b"
    r"|\bon\s+[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}\b"
)

# The entity names come from the standard library; str_to_map keeps the expression small and folds to one constant.
_NAMED = "str_to_map(" + lit("\x02".join(f"{k[:-1]}\x01{v}" for k, v in sorted(html5.items()) if k.endswith(";"))) + ", '\x02', '\x01')"
# names that count without a semicolon, the longest first
_OPEN_NAMES = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
# numbers that stand for a Windows character instead of a control character
_WINDOWS = "str_to_map(" + lit(",".join(f"{c}:{ord(bytes([c]).decode('cp1252'))}" for c in range(128, 160) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))) + ")"


def js_trim(s: str) -> str:
    return f"btrim({s}, {lit(JS_SPACE)})"


def collapse_space(s: str) -> str:
    return f"regexp_replace({s}, {lit(r'[ \t\r\n\f]+')}, ' ')"


def decode_entities(s: str, attribute: bool = False) -> str:
    """Named and numeric character references, each replaced once, left to right.

    Old names count without their semicolon too; in an attribute value only if no letter, digit or equals sign follows.
    """
    digits = "regexp_extract(p, '^&#([0-9]+);?$', 1)"
    hexa = "regexp_extract(p, '^&#[xX]([0-9a-fA-F]+);?$', 1)"

    def char(code: str) -> str:
        known = f"coalesce(CAST({_WINDOWS}[CAST(n AS STRING)] AS BIGINT), IF(n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111, n, 65533))"
        return let("n", f"coalesce({code}, 1114112)", f"decode(unhex(lpad(hex({known}), 8, '0')), 'UTF-32')")

    open_name = f"regexp_extract(p, {lit('^&(' + _OPEN_NAMES + ')')}, 1)"
    follows = " AND NOT p RLIKE " + lit("^&(?:" + _OPEN_NAMES + ")[a-zA-Z0-9=]") if attribute else ""
    one = (
        "CASE WHEN NOT startswith(p, '&') THEN p"
        f" WHEN {digits} <> '' THEN {char(f'try_cast({digits} AS BIGINT)')}"
        f" WHEN {hexa} <> '' THEN {char(f'IF(length({hexa}) > 15, NULL, try_cast(conv({hexa}, 16, 10) AS BIGINT))')}"
        f" ELSE coalesce({_NAMED}[regexp_extract(p, '^&([a-zA-Z0-9]+);$', 1)], "
        f"IF({open_name} <> ''{follows}, concat({_NAMED}[{open_name}], substr(p, length({open_name}) + 2)), p)) END"
    )
    pieces = lit(r"&#?[a-zA-Z0-9]+[;=]?|[^&]+|&" if attribute else r"&#?[a-zA-Z0-9]+;?|[^&]+|&")
    return (
        f"CASE WHEN contains({s}, '&') THEN "
        f"array_join(transform(regexp_extract_all({s}, {pieces}, 0), p -> {one}), '') ELSE {s} END"
    )


def words(s: str) -> str:
    """White-space separated words."""
    return rf"filter(split({s}, {lit(r'\s+')}), w -> w <> '')"


def word_count(s: str) -> str:
    return f"CAST(size({words(s)}) AS BIGINT)"


def has_date(s: str) -> str:
    return f"{s} RLIKE {lit(DATE_PATTERN)}"
