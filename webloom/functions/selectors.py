"""Element selection as a predicate over the element list.

A selector is a comma-separated union of paths; a path is tag/#id/.class/[attribute] steps joined by a blank
(descendant) or ``>`` (child).  ``predicate`` turns it into one boolean expression about an element.  A descendant step collects the elements
that the steps before it match, once per page, and looks whether one of them encloses the element; nothing is joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from webloom.functions.html import BLOCK
from webloom.functions.intervals import enclosing, inside
from webloom.functions.sqltext import lit

_PART = re.compile(
    r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w:-]+)(?:(?P<op>[*^$~]?=)["']?(?P<val>[^"'\]]*)["']?(?P<ci>\s+i)?)?\]"""
    r"""|:not\((?P<neg>[^()]+)\)"""
    r"""|:nth-child\(\s*(?P<nth>[^()]+?)\s*\)|:(?P<first>first-child)"""
)


@dataclass
class Step:
    tag: str = ""
    tests: list = field(default_factory=list)
    child: bool = False


def alternatives(selector: str) -> list[str]:
    """The selectors of a comma-separated list; commas in brackets and parentheses do not split."""
    return [s.strip() for s in re.split(r",(?![^\[\]]*\])(?![^()]*\))", selector)]


def parse(selector: str) -> list[list[Step]]:
    """'nav > a.x, h1' -> [[nav, a.x (child)], [h1]]"""
    return [[_step(w) for w in _words(path)] for path in alternatives(selector)]


def _words(path: str) -> list[str]:
    words = re.findall(r"""(?:>\s*)?(?:\[[^\]]*\]|:not\((?:[^()]|\([^()]*\))*\)|:nth-child\([^)]*\)|:first-child|[^\s>\[:])+""", path.strip())
    if not words or re.sub(r"\s", "", "".join(words)) != re.sub(r"\s", "", path):
        raise ValueError(f"unsupported selector: {path!r}")
    return words


def _step(word: str) -> Step:
    step = Step(child=word.startswith(">"))
    word = word.lstrip("> ")
    tag = re.match(r"[\w-]+|\*", word)
    if tag:
        step.tag = "" if tag.group() == "*" else tag.group().lower()
        word = word[tag.end():]
    while word:
        m = _PART.match(word)
        if not m:
            raise ValueError(f"unsupported selector part: {word!r}")
        step.tests.append(m.groupdict())
        word = word[m.end():]
    return step


def tags_of(selector: str) -> set[str] | None:
    """Tags a selector names, or None when some step matches any tag."""
    steps = [s for path in parse(selector) for s in path]
    return None if any(not s.tag for s in steps) else {s.tag for s in steps}


def predicate(selector: str, x: str = "x", rooted: bool = False) -> str:
    """Boolean SQL text about element ``x``; reads ``els`` and the attribute maps ``ats``.  ``rooted``: the first step has no parent."""
    return "(" + " OR ".join(_path(path, x, rooted) for path in parse(selector)) + ")"


def enclosed_by(selector: str, x: str = "x") -> str:
    """Boolean SQL text: some ancestor of element ``x`` matches."""
    return inside(f"{x}.i", enclosing(predicate(selector, "a")))


def _path(path: list[Step], x: str, rooted: bool = False) -> str:
    here = _matches(path[-1], x)
    if len(path) == 1:
        return f"({here} AND {x}.d = 0)" if rooted else here
    if path[-1].child:
        return f"({here} AND {x}.p >= 0 AND {_path(path[:-1], f'get(els, {x}.p)', rooted)})"
    return f"({here} AND {inside(f'{x}.i', enclosing(_path(path[:-1], 'a', rooted)))})"


def attribute_of(x: str, name: str) -> str:
    """Attribute of element ``x``: NULL when absent, '' when present without a value."""
    return f"ats[{x}.i][{lit(name.lower())}]"


def _matches(step: Step, x: str) -> str:
    tests = [f"{x}.tag = {lit(step.tag)}"] if step.tag else []
    for t in step.tests:
        if t["id"]:
            tests.append(f"coalesce({attribute_of(x, 'id')} = {lit(t['id'])}, false)")
        elif t["cls"]:
            tests.append(_has_word(attribute_of(x, "class"), lit(t["cls"])))
        elif t["nth"] or t["first"]:
            tests.append(_nth_test(x, t["nth"] or "1"))
        elif t["neg"]:
            tests.append(f"NOT {_matches(_step(t['neg']), x)}")
        else:
            tests.append(_attribute_test(x, t))
    return "(" + (" AND ".join(tests) or "true") + ")"


def _nth_test(x: str, place: str) -> str:
    """``:nth-child`` of n, odd, even or an + b."""
    found = re.fullmatch(r"(?:([+-]?\d*)n)?\s*(?:([+-]?)\s*(\d+))?", {"odd": "2n+1", "even": "2n"}.get(place.lower(), place.lower()))
    if not found or not place:
        raise ValueError(f"unsupported place: {place!r}")
    step = found[1]
    step = 0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)
    offset = int((found[2] or "") + found[3]) if found[3] else 0
    if not step:
        return f"{x}.nth = {offset}"
    return f"(({x}.nth - ({offset})) % {abs(step)} = 0 AND {x}.nth {'>=' if step > 0 else '<='} {offset})"


def _has_word(value: str, word: str) -> str:
    return f"coalesce(contains({value}, {word}) AND array_contains(split({value}, {lit(r'[ \t\r\n\f]+')}), {word}), false)"


def _attribute_test(x: str, t: dict) -> str:
    value = attribute_of(x, t["attr"])
    if not t["op"]:
        return f"({value} IS NOT NULL)"
    want = lit(t["val"])
    if t["ci"]:
        value, want = f"lower({value})", lit(t["val"].lower())
    if t["op"] == "~=":
        return _has_word(value, want)
    test = {"=": "{} = {}", "*=": "contains({}, {})", "^=": "startswith({}, {})", "$=": "endswith({}, {})"}[t["op"]]
    return f"coalesce({test.format(value, want)}, false)"


def _counts(selector: str) -> bool:
    """Whether a selector asks for places among siblings."""
    return ":nth-child" in selector or ":first-child" in selector


def inline_tags(selectors: list[str]) -> list[str] | None:
    """The non-block tags that selectors name, None when some selector needs every element."""
    out: set[str] = set()
    for s in selectors:
        tags = None if _counts(s) else tags_of(s)
        if tags is None:
            return None
        out |= tags
    return sorted(out - set(BLOCK))


def is_flat(selector: str) -> bool:
    """True when the selector looks at the element itself only, so that start tags are enough to test it."""
    return not _counts(selector) and all(len(path) == 1 for path in parse(selector))
