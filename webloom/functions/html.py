"""HTML as Spark SQL expressions: tokens, elements, attributes, text.

A page stays one row.  ``tokens`` splits the HTML into an array, ``elements`` folds that array into the
element list (start, end, parent, depth), and the rest reads slices of the two arrays.  Nothing here shuffles, so a corpus
is parsed at scan speed whatever its size; only the rows an operator asks for are exploded.
"""

from __future__ import annotations

from webloom.functions.sqltext import in_list, let, lit
from webloom.functions.text import collapse_space, decode_entities, js_trim

# Elements whose content is text up to their own end tag; in the last two character references still count.
RAW = "script style title textarea".split()
_RAW = "(?:" + "|".join(RAW) + ")"

# The rest of a start tag behind its name: quotes count only behind an equals sign.
# Possessive throughout: a match never steps back, and there is no stack growth on tags with thousands of attributes.
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"

# Comments, raw-text elements, declarations, tags, text, stray '<'.  Whatever has no end runs to the end of the document, as
# it does in browsers, so no character is looked at twice.
TOKEN_PATTERN = (
    r"(?si)<!--.*?(?:-->|\z)"
    rf"|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z)"
    r"|[^<]++|<"
)
_START_TAG = rf"(?is)^<[a-z][^\s/>]*+{_ATTRIBUTES}>"
_RAW_TOKEN = rf"(?is)^<({_RAW})(?=[\s/>]){_ATTRIBUTES}>(.*?)(?:</\1(?=[\s/>])[^>]*+>?)?\z"

# Element classes of the HTML standard.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul caption"
).split()
SCOPE = "applet caption html marquee object table td template th".split()
FOREIGN = "svg math".split()

# Which open elements a start tag closes, and the ancestors that stop the search (most frequent class first).
# class -> (start tags, closed elements, boundaries)
_TABLE_PARTS = ["td", "th", "tr", "tbody", "thead", "tfoot", "caption"]
_OWN_RULE = ["html", "head", "body", "li", "dd", "dt", *_TABLE_PARTS]
_IMPLIED = {
    1: ([t for t in BLOCK if t not in _OWN_RULE], ["p"], ["button", *SCOPE]),
    2: (["a"], ["a"], [*BLOCK, "button", "object", "template"]),
    3: (["li"], ["li", "p"], ["ul", "ol", "menu", "dir", "button", *SCOPE]),
    4: (["td", "th"], ["td", "th"], ["table", "template"]),
    5: (["tr"], ["tr", "td", "th", "caption"], ["table", "template"]),
    6: (["option"], ["option"], ["select", "optgroup", "datalist"]),
    7: (["dd", "dt"], ["dd", "dt", "p"], ["dl", "button", *SCOPE]),
    8: (["tbody", "thead", "tfoot", "caption"], [*_TABLE_PARTS, "colgroup"], ["table", "template"]),
    9: (["optgroup"], ["optgroup", "option"], ["select"]),
    10: (["body"], ["head"], ["template"]),
}
_CHUNK, _FAN = 16, 16
# The fold over pages without far-reaching implied ends: runs a chunk, and the tags and the depth for which it is tried.
_RUN, _FEW, _TAGS, _DEPTH = 16, 64, 1 << 14, 1 << 10
_ITEM = (1 << 32) + 1  # a list item counts as a child in the lower half and as an item in the upper one


def tokens(html: str) -> str:
    """Lossless token array: concatenating it gives the HTML back."""
    return f"regexp_extract_all(coalesce({html}, ''), {lit(TOKEN_PATTERN)}, 0)"


def token_kind(t: str) -> str:
    """open | close | void | raw | comment | decl | text"""
    return (
        f"CASE WHEN NOT startswith({t}, '<') OR {t} = '<' THEN 'text'"
        f" WHEN startswith({t}, '<!--') THEN 'comment'"
        f" WHEN startswith({t}, '<!') OR startswith({t}, '<?') OR {tag_name(t)} = '' THEN 'decl'"
        f" WHEN startswith({t}, '</') THEN 'close'"
        f" WHEN {_is_raw(t)} THEN 'raw'"
        f" WHEN {in_list(tag_name(t), VOID)} THEN 'void' ELSE 'open' END"
    )


def _may_be_raw(t: str) -> str:
    return f"lower(substr({t}, 1, 6)) IN ('<scrip', '<style', '<title', '<texta')"


def _is_raw(t: str) -> str:
    """A raw-text element whose start tag is complete."""
    return f"({_may_be_raw(t)} AND {t} RLIKE {lit(_RAW_TOKEN.split('(.*?)')[0])})"


def tag_name(t: str) -> str:
    """Lower-case tag name of a tag token, '' for any other token and for a tag that the document ends in."""
    return f"IF(endswith({t}, '>') OR {_is_raw(t)}, lower(regexp_extract({t}, {lit(r'^</?([a-zA-Z][^\s/>]*)')}, 1)), '')"


def is_text(t: str) -> str:
    return f"(NOT startswith({t}, '<') OR {t} = '<')"


def elements(toks: str, inline: list[str] | None = None) -> str:
    """Element list of a token array, in document order: array<struct<i, z, s, e, own, tag, p, d, nth, item>>.

    A fold over the tags keeps the stack of open elements.  ``s`` and ``e`` are token positions of the start tag and of
    the end (the end tag itself when ``own``, else the token before which the element ends); void and
    raw-text elements end where they start.  ``i`` is the element's own list position and ``z`` the one after its last
    descendant, so descendants are a slice of the list and an ancestor is an interval around (``functions.intervals``); ``p`` is the
    list position of the parent, -1 at the root, and ``d`` the number of ancestors;
    ``nth`` is the place among the children of its parent and ``item`` that among its list items, from 1, if no element was left out.
    The fold is nested three deep (runs of 16 tags, 16 runs, all), as each step copies its accumulator.  So an accumulator holds
    what its own run has opened only, and how many of the elements open before the run are left; those are read from the
    accumulators around it, so a tag costs the same at any depth.  Inline elements never change where
    other elements start or end, so with ``inline`` given all others of them are left out of the list.
    A page whose tags end nothing but the innermost open element or what stands directly in front of them needs no search of
    the open elements; above 64 tags a fold over runs of tags tries this first and leaves any other page to the full one (``_nested``).
    """
    kept = "true"
    if inline is not None:
        kept = in_list("n", sorted({*BLOCK, *SCOPE, *FOREIGN, "button", "select", "option", "optgroup", "datalist", *inline}))
    start_class = "CASE " + " ".join(f"WHEN {in_list('n', r[0])} THEN {c}" for c, r in _IMPLIED.items()) + " ELSE 0 END"
    end_class = (
        f"CASE WHEN {in_list('n', ['table', *_TABLE_PARTS])} THEN 1 WHEN n = 'li' THEN 2 WHEN n = 'p' THEN 3"
        f" WHEN {in_list('n', [*BLOCK, *SCOPE, 'button', 'select', 'svg'])} THEN 4 ELSE 5 END"
    )
    tag = (
        f"struct(i AS s, startswith(t, '</') AS closes, n AS tag, endswith(t, '/>') AS sc, IF(startswith(t, '</'), {end_class}, {start_class}) AS cls, "
        f"{in_list('n', [*VOID, *RAW])} AS void)"
    )
    no_tag = "NOT startswith(t, '<') OR t = '<' OR startswith(t, '<!') OR startswith(t, '<?')"
    tags = (
        f"filter(transform({toks}, (t, i) -> CASE WHEN {no_tag} THEN NULL ELSE "
        + let("n", tag_name("t"), f"IF(n <> '' AND {kept}, {tag}, NULL)")
        + " END), g -> g IS NOT NULL)"
    )
    step = let("k", _kept(), f"CASE WHEN t.closes THEN IF(k = {_OPEN}, a, {_after('end')}) WHEN {_leaf()} THEN {_after('leaf')} ELSE {_after('start')} END")
    none = "CAST(array() AS array<int>) AS st, CAST(array() AS array<string>) AS tg, CAST(array() AS array<bigint>) AS cn"

    def found(depth: str) -> str:
        return ", ".join(f"CAST(array() AS {depth.format(f'array<{t}>')}) AS {n}" for n, t in _FOUND.items())

    def added(to: str, value: str) -> str:
        return ", ".join(f"array_append({to}.{n}, {value.format(n)}) AS {n}" for n in _FOUND)

    def within(v: str, depth: str) -> str:
        """The accumulator of a run, before its first tag."""
        return f"struct({v} AS kb, {none}, %s.c AS c, %s.tt AS tt, %s.ti AS ti, %s.n AS n, {found(depth)})"

    def joined_to(v: str, kept: str, counted: str) -> str:
        """The accumulator around a run, after it."""
        onto = f"concat(slice({v}.%s, 1, {kept}), f.%s)"
        return f"{onto % ('st', 'st')} AS st, {onto % ('tg', 'tg')} AS tg, concat(slice({v}.cn, 1, {counted}), f.cn) AS cn, f.c AS c, f.tt AS tt, f.ti AS ti, f.n AS n"

    per_tag = (
        f"aggregate(slice(hu, w * {_CHUNK} + 1, {_CHUNK}), {within('c.kb + size(c.st)', '{}').replace('%s', 'c')}, (a, t) -> {step}, "
        f"f -> struct(least(f.kb, c.kb) AS kb, {joined_to('c', 'greatest(f.kb - c.kb, 0)', 'greatest(f.kb - c.kb, 0)')}, {added('c', 'f.{}')}))"
    )
    runs = f"sequence(0, least({_FAN - 1}, greatest(size(h) - u * {_CHUNK * _FAN} - 1, 0) DIV {_CHUNK}))"
    per_run = (
        f"aggregate({runs}, {within('size(o.st)', 'array<{}>').replace('%s', 'o')}, (c, w) -> {per_tag}, "
        f"f -> struct({joined_to('o', 'f.kb', 'f.kb - 1')}, {added('o', 'flatten(f.{})')}))"
    )
    per_run = let("hu", f"slice(h, u * {_CHUNK * _FAN} + 1, {_CHUNK * _FAN})", let("al", "array_distinct(o.tg)", per_run))
    # the document itself is the lowest entry of the stack
    start = (
        "struct(array(-1) AS st, array('') AS tg, CAST(array() AS array<bigint>) AS cn, 0L AS c, '' AS tt, -1 AS ti, 0 AS n, "
        f"{found('array<{}>')})"
    )
    fold = f"aggregate(sequence(0, greatest(size(h) - 1, 0) DIV {_CHUNK * _FAN}), {start}, (o, u) -> {per_run})"
    # ends in the order of the elements, also of those that are open at the end
    ends = f"transform(sort_array(transform(concat(flatten(r.ci), lf), (i, x) -> i * {_HIGH}L + x)), v -> ev[CAST(v & {_LOW}L AS INT)])"
    ends = let("ev", f"concat(flatten(r.ce), transform(lf, z -> r.n * {_HIGH}L + size({toks}) * 2L))", ends)
    joined = (
        f"transform(filter(h, t -> NOT t.closes), (t, i) -> struct(i AS i, CAST(shiftright(en[i], 32) AS INT) AS z, t.s AS s, CAST(shiftright(en[i] & {_LOW}L, 1) AS INT) AS e, "
        f"(en[i] & 1L) = 1L AS own, t.tag AS tag, CAST(pd[i] & {_LOW}L AS INT) - 1 AS p, CAST(shiftright(pd[i], 32) AS INT) AS d, "
        f"CAST(yy[i] & {_LOW}L AS INT) AS nth, CAST(shiftright(yy[i], 32) AS INT) AS item))"
    )
    joined = let("en", let("lf", "filter(r.st, z -> z >= 0)", ends), let("pd", "flatten(r.pd)", let("yy", "flatten(r.yy)", joined)))
    return let("g", tags, f"coalesce({_nested(toks)}, {let('h', _whole('g'), let('r', fold, joined))})")


def _whole(g: str) -> str:
    """The tags with ``e``, twice the position of the end of a whole element and 1 for an end tag of its own.

    A start tag that its own end tag follows is such an element, and the end tag is left out: it would end the top of the stack, which the start tag has put there.
    """
    def pair(start: str, end: str) -> str:
        return f"coalesce(NOT {start}.closes AND NOT {start}.void AND NOT {start}.sc AND {end}.closes AND {start}.tag = {end}.tag, false)"

    def tag(void: str, e: str) -> str:
        return f"struct(t.s AS s, t.closes AS closes, t.tag AS tag, t.sc AS sc, t.cls AS cls, {void} AS void, {e} AS e)"

    single = tag("t.void", "t.s * 2L")
    start = f"IF({pair('t', f'get({g}, j + 1)')}, {tag('true', f'get({g}, j + 1).s * 2L + 1L')}, {single})"
    return f"filter(transform({g}, (t, j) -> IF(t.closes, IF({pair(f'get({g}, j - 1)', 't')}, NULL, {single}), {start})), t -> t IS NOT NULL)"


# In the steps of the fold ``a``, ``c`` and ``o`` are the accumulators of the run, of the runs around it and of all: st, tg and cn are the positions and
# tags of the elements that a run has opened and not closed and what was counted of the children of all entries from the one they stand on to the
# one below the top; kb is how many entries of the accumulator around are left, c, tt and ti are the count, tag and position of the top, n the elements
# so far.  What was found are numbers, two to a long, as an accumulator is copied at each step: per element its depth and parent + 1 (pd) and its places among its
# siblings (yy), per end the element (ci), and the elements in front of it, its position twice and 1 for an end tag of its own (ce).  ``al`` are the distinct tags of o, ``t`` is the tag, ``k`` the number of entries that survive it.
_FOUND = {"pd": "bigint", "yy": "bigint", "ci": "int", "ce": "bigint"}
_HIGH, _LOW = 1 << 32, (1 << 32) - 1
_OPEN = "(a.kb + size(a.st))"
_FAR = "least(a.kb, c.kb)"  # entries left of o
_NEAR = "concat(slice(c.tg, 1, greatest(a.kb - c.kb, 0)), a.tg)"  # tags of the others


# where the search for the element of an end tag stops, by its class
_STOPS = {1: ["table", "template"], 2: ["ul", "ol", "menu", "dir", *SCOPE], 3: ["button", *SCOPE], 4: SCOPE, 5: [*BLOCK, *SCOPE, "button", "select"]}


def _by_class(rules: dict[int, list[str]], tag: str) -> str:
    return "CASE t.cls " + " ".join(f"WHEN {c} THEN {in_list(tag, names)}" for c, names in rules.items()) + " ELSE false END"


def _kept() -> str:
    """Number of entries that survive the tag."""
    # an end tag ends the innermost open element of its name, unless a boundary of its class lies between
    stops = _by_class(_STOPS, "z")

    def last_in(tags: str, held: str, without: str) -> str:
        found = f"IF(exists(slice({tags}, size({tags}) - m + 2, m), z -> {stops}), {_OPEN}, {held} + size({tags}) - m)"
        return let("m", f"array_position(reverse({tags}), t.tag)", f"IF(m > 0, {found}, {without})")

    far = f"IF(array_contains(al, t.tag), {let('fs', f'slice(o.tg, 1, {_FAR})', last_in('fs', '0', _OPEN))}, {_OPEN})"
    by_end = f"IF(a.tt = t.tag, {_OPEN} - 1, {let('ns', _NEAR, last_in('ns', _FAR, f'IF(exists(ns, z -> {stops}), {_OPEN}, {far})'))})"
    # a start tag ends the outermost of the elements it closes above the nearest boundary of its class
    closed = _by_class({c: r[1] for c, r in _IMPLIED.items()}, "z")
    # a block has closed the open p, so there is none to look for below it
    bounds = {c: [*r[2], *(t for t in BLOCK if c == 1 and t not in ("p", *r[2]))] for c, r in _IMPLIED.items()}
    bound = _by_class(bounds, "z")

    def outermost(tags: str, held: str) -> str:
        b = f"array_max(transform({tags}, (z, j) -> IF({bound}, j, -1)))"
        return let("b", b, f"{held} + array_min(transform({tags}, (z, j) -> IF(j > b AND {closed}, j, size({tags}))))")

    searched = (
        f"CASE WHEN exists(al, z -> {closed}) AND NOT exists(ns, z -> {bound}) THEN {let('fs', f'concat(slice(o.tg, 1, {_FAR}), ns)', outermost('fs', '0'))}"
        f" WHEN NOT exists(ns, z -> {closed}) THEN {_OPEN} ELSE {outermost('ns', _FAR)} END"
    )
    by_start = f"IF(t.cls = 0 OR a.tt = '' OR {_by_class(bounds, 'a.tt')}, {_OPEN}, {let('ns', _NEAR, searched)})"
    return f"CAST(IF(t.closes, {by_end}, {by_start}) AS INT)"


def _leaf() -> str:
    """Whether a start tag is a whole element: void, raw text, or closed in itself inside foreign content."""
    foreign = in_list("z", FOREIGN)
    around = f"exists({_NEAR}, z -> {foreign}) OR (exists(al, z -> {foreign}) AND exists(slice(o.tg, 1, {_FAR}), z -> {foreign}))"
    return f"(t.void OR (t.sc AND ({in_list('t.tag', FOREIGN)} OR {around})))"


def _after(what: str) -> str:
    """The accumulator after an end tag, a whole element or a start tag."""
    def entry(name: str) -> str:
        return f"IF(k > c.kb, c.{name}[k - 1 - c.kb], o.{name}[k - 1])"

    unchanged = "struct(a.kb AS kb, a.st AS st, a.tg AS tg, a.cn AS cn, a.c AS c, a.tt AS tt, a.ti AS ti)"
    own = "struct(a.kb AS kb, slice(a.st, 1, k - a.kb) AS st, slice(a.tg, 1, k - a.kb) AS tg, slice(a.cn, 1, k - a.kb) AS cn, a.cn[k - a.kb] AS c, a.tg[k - a.kb - 1] AS tt, a.st[k - a.kb - 1] AS ti)"
    # down to what was open before the run; the entry on which the run stands has its count in the run
    count = "CASE WHEN k = a.kb THEN a.cn[0] WHEN k >= c.kb THEN c.cn[k - c.kb] ELSE o.cn[k - 1] END"
    none = "CAST(array() AS array<int>) AS st, CAST(array() AS array<string>) AS tg, CAST(array() AS array<bigint>) AS cn"
    before = f"struct(k AS kb, {none}, {count} AS c, {entry('tg')} AS tt, {entry('st')} AS ti)"
    base = f"CASE WHEN k = {_OPEN} THEN {unchanged} WHEN k > a.kb THEN {own} ELSE {before} END"
    deep = "concat(slice(o.st, k + 1, greatest(least(a.kb, c.kb) - k, 0)), slice(c.st, greatest(k - c.kb, 0) + 1, greatest(a.kb - greatest(k, c.kb), 0)), a.st)"
    popped = f"IF(k >= a.kb, slice(a.st, k - a.kb + 1, {_OPEN} - k), {deep})"
    code = f"a.n * {_HIGH}L + t.s * 2L"
    ended = f"concat(a.ci, {popped}) AS ci, concat(a.ce, transform({popped}, (z, j) -> {code} + IF(t.closes AND j = 0, 1L, 0L))) AS ce"
    if what == "end":
        # most end tags end the top element alone
        r = "size(a.st) - 1"
        below = f"IF({r} > 0, a.%s[{r} - 1], IF(a.kb > c.kb, c.%s[a.kb - 1 - c.kb], o.%s[a.kb - 1]))"
        one = (
            f"struct(a.kb AS kb, slice(a.st, 1, {r}) AS st, slice(a.tg, 1, {r}) AS tg, slice(a.cn, 1, {r}) AS cn, a.cn[{r}] AS c, {below.replace('%s', 'tg')} AS tt, "
            f"{below.replace('%s', 'st')} AS ti, a.n AS n, a.pd AS pd, a.yy AS yy, array_append(a.ci, a.ti) AS ci, array_append(a.ce, {code} + 1L) AS ce)"
        )
        many = let("s", base, f"struct(s.kb AS kb, s.st AS st, s.tg AS tg, s.cn AS cn, s.c AS c, s.tt AS tt, s.ti AS ti, a.n AS n, a.pd AS pd, a.yy AS yy, {ended})")
        return f"IF(k = {_OPEN} - 1 AND k >= a.kb, {one}, {many})"

    def opened(v: str, ci: str, ce: str) -> str:
        """The accumulator with the element added to the entries of ``v``."""
        # children seen so far in the lower half, list items in the upper one
        seen = f"{v}.c + IF(t.tag = 'li', {_ITEM}, 1)"
        if what == "leaf":
            rest = f"{v}.st AS st, {v}.tg AS tg, {v}.cn AS cn, y AS c, {v}.tt AS tt, {v}.ti AS ti, a.n + 1 AS n"
            ci, ce = f"array_append({ci}, a.n)", f"array_append({ce}, (a.n + 1) * {_HIGH}L + t.e)"
        else:
            rest = f"array_append({v}.st, a.n) AS st, array_append({v}.tg, t.tag) AS tg, array_append({v}.cn, y) AS cn, 0L AS c, t.tag AS tt, a.n AS ti, a.n + 1 AS n"
        element = f"array_append(a.pd, (k - 1) * {_HIGH}L + {v}.ti + 1) AS pd, array_append(a.yy, y) AS yy"
        return let("y", seen, f"struct({v}.kb AS kb, {rest}, {element}, {ci} AS ci, {ce} AS ce)")

    # most start tags end nothing
    many = let("ended", f"struct({ended})", opened("s", "ended.ci", "ended.ce"))
    return f"IF(k = {_OPEN}, {opened('a', 'a.ci', 'a.ce')}, {let('s', base, many)})"


# Open elements below which a start tag finds nothing to close: those where the search stops, blocks (which have closed the open p),
# and parts of a table, which have closed the smaller parts in front of them.
_BOUNDS = {c: [*r[2], *(t for t in BLOCK if c == 1 and t not in ("p", *r[2]))] for c, r in _IMPLIED.items()}
_BOUNDS[4] += ["tr", "tbody", "thead", "tfoot"]
_BOUNDS[5] += ["tbody", "thead", "tfoot"]


def _nested(toks: str) -> str:
    """Element list of the tags ``g``, NULL when some tag reaches further than to the innermost open element.

    ``kd`` says what each tag is: 0 the end tag of the element in front of it, 1 a start tag, 2 an end tag, 3 a void or raw-text element, 4 an
    element without elements and with an end tag, 5 one that the next tag ends without being its end tag.  A run is some start tags, then
    some whole elements, then some end tags, and one step of the fold.  Its accumulator holds positions and child counts of the open elements (st, cn), the
    number of elements, and per element the parent, depth and number among its siblings (pp, dd, yy), per end tag the element and how many
    elements stand before (cl, cz).  The fold takes every end tag for that of the innermost open element; whether they all are, and whether no start tag
    ends anything, is looked at afterwards, when all parents are known.
    """
    stop = _by_class(_STOPS, "u.tag").replace("t.cls", "get(g, j + 1).cls")
    closed = {c: r[1] for c, r in _IMPLIED.items()}
    by_next = _by_class(closed, "t.tag").replace("t.cls", "get(g, j + 1).cls")
    kinds = (
        "transform(g, (t, j) -> CASE WHEN t.closes THEN IF(coalesce(NOT get(g, j - 1).closes AND NOT get(g, j - 1).void AND NOT get(g, j - 1).sc AND get(g, j - 1).tag = t.tag, false), 0, 2) "
        "WHEN t.void THEN 3 WHEN t.sc OR j + 1 = size(g) THEN 1 WHEN get(g, j + 1).closes THEN IF(get(g, j + 1).tag = t.tag, 4, 1) "
        f"WHEN {by_next} THEN 5 ELSE 1 END)"
    )
    # the last of some elements whose end tags are left out, before the end tag of their parent: all between the two are whole elements
    marks = "array_join(transform(k1, v -> IF(v = 1, 'o', IF(v = 2, 'c', '-'))), '')"
    parent = "length(trim(TRAILING '-' FROM substr(kc, 1, j))) - 1"
    last = let("q", parent, let("u", "g[j]", f"coalesce(get(k1, q) = 1 AND get(g, q).tag = get(g, j + 1).tag AND u.tag <> get(g, j + 1).tag AND NOT {stop}, false)"))
    loose = "exists(sequence(0, size(k1) - 1), j -> k1[j] = 1 AND coalesce(get(g, j + 1).closes, false))"
    ended = let("kc", marks, f"transform(k1, (v, j) -> IF(v = 1 AND coalesce(get(g, j + 1).closes, false) AND {last}, 5, v))")
    kinds = let("k1", kinds, f"IF(size(g) > 0 AND {loose}, {ended}, k1)")

    marks = "array_join(transform(kd, (v, j) -> CASE v WHEN 0 THEN '' WHEN 1 THEN 'o' WHEN 2 THEN 'c' ELSE IF(gt[j] = 'li', 'i', '-') END), '')"
    opens, closes = "length(u) - length(trim(LEADING 'o' FROM u))", "length(u) - length(trim(TRAILING 'c' FROM u))"
    runs = (
        f"transform(filter(regexp_extract_all({marks}, 'o*+(?:-++|i++)?+c*+', 0), u -> u <> ''), "
        f"u -> struct({opens} AS o, length(u) - ({opens}) - ({closes}) AS l, {closes} AS x, IF(contains(u, 'i'), {_ITEM}, 1L) AS y))"
    )
    ints, longs = "CAST(array() AS array<int>)", "CAST(array() AS array<bigint>)"
    empty = f"{ints} AS pp, {ints} AS dd, {longs} AS yy, {ints} AS cl, {ints} AS cz"
    lost = f"struct(a.st AS st, a.cn AS cn, 0 AS n, true AS bad, {empty})"
    nth = f"IF(t.o > 0, concat(array(element_at(a.cn, -1) + ic[a.n]), slice(ic, a.n + 2, t.o - 1)), {longs})"
    last_count = "IF(t.o > 0, 0L, element_at(a.cn, -1))"
    added = (
        "struct(IF(t.x > 0, slice(s1, 1, size(s1) - t.x), s1) AS st, "
        "IF(t.x > 0, slice(c1, 1, size(c1) - t.x), c1) AS cn, a.n + t.o + t.l AS n, false AS bad, "
        "concat(a.pp, slice(s1, size(a.st), t.o), array_repeat(element_at(s1, -1), t.l)) AS pp, "
        f"concat(a.dd, IF(t.o > 0, sequence(size(a.st) - 1, size(s1) - 2), {ints}), array_repeat(size(s1) - 1, t.l)) AS dd, "
        f"concat(a.yy, yo, IF(t.l > 0, sequence({last_count} + t.y, {last_count} + t.l * t.y, t.y), {longs})) AS yy, "
        "IF(t.x > 0, concat(a.cl, reverse(slice(s1, size(s1) - t.x + 1, t.x))), a.cl) AS cl, IF(t.x > 0, concat(a.cz, array_repeat(a.n + t.o + t.l, t.x)), a.cz) AS cz)"
    )
    counts = f"concat(slice(a.cn, 1, size(a.cn) - 1), yo, array({last_count} + t.l * t.y))"
    pushed = let("s1", "IF(t.o > 0, concat(a.st, sequence(a.n, a.n + t.o - 1)), a.st)", let("yo", nth, let("c1", counts, added)))
    step = f"CASE WHEN a.bad THEN a WHEN size(a.st) + t.o <= t.x OR size(a.st) + t.o > {_DEPTH} THEN {lost} ELSE {pushed} END"
    collected = ", ".join(f"array_append(o.{n}, f.{n}) AS {n}" for n in ("pp", "dd", "yy", "cl", "cz"))
    run = (
        f"aggregate(slice(rs, w * {_RUN} + 1, {_RUN}), struct(o.st AS st, o.cn AS cn, o.n AS n, o.bad AS bad, {empty}), (a, t) -> {step}, "
        f"f -> struct(f.st AS st, f.cn AS cn, f.n AS n, f.bad AS bad, {collected}))"
    )
    lists = empty.replace("array<int>", "array<array<int>>").replace("array<bigint>", "array<array<bigint>>")
    start = f"struct(array(-1) AS st, array(0L) AS cn, 0 AS n, false AS bad, {lists})"
    fold = f"aggregate(sequence(0, greatest(size(rs) - 1, 0) DIV {_RUN}), {start}, (o, w) -> IF(o.bad, o, {run}))"

    def of(rules: dict[int, list[str]], tag: str) -> str:
        return _by_class(rules, tag).replace("t.cls", "g[eo[k]].cls")

    around = f"NOT {of(closed, 'tag[p[k]]')} AND (p[p[k]] < 0 OR {of(_BOUNDS, 'tag[p[p[k]]]')})"
    simple = f"(g[eo[k]].cls = 0 OR p[k] < 0 OR {of(_BOUNDS, 'tag[p[k]]')} OR NOT exists(al, z -> {of(closed, 'z')}) OR ({around}))"
    right = f"transform(cl, k -> tag[k]) = transform(cs, j -> gt[j]) AND forall(i, k -> {simple})"
    # one number per element: position, elements before its end, which end tag (none: open at the end, or a whole element)
    none, bits = (1 << 21) - 1, 21

    def entry(k: str, z: str, x: str) -> str:
        return f"shiftleft(CAST({k} AS BIGINT), {2 * bits}) + shiftleft(CAST({z} AS BIGINT), {bits}) + {x}"

    ends = (
        f"sort_array(concat(transform(cl, (k, x) -> {entry('k', 'cz[x]', 'x')}), transform(slice(r.st, 2, size(r.st)), k -> {entry('k', 'r.n', none)}), "
        f"filter(transform(eo, (j, k) -> IF(kd[j] = 1, NULL, {entry('k', 'k + 1', none)})), v -> v IS NOT NULL)))"
    )
    z = f"transform(en, v -> CAST(shiftright(v, {bits}) & {none} AS INT))"
    end_at = f"CASE kd[j] WHEN 3 THEN gs[j] WHEN 1 THEN IF(xs[k] = {none}, size({toks}), gs[cs[xs[k]]]) ELSE gs[j + 1] END"
    fields = {
        "z": z, "s": "transform(eo, j -> gs[j])", "e": f"transform(eo, (j, k) -> {end_at})", "own": f"transform(eo, (j, k) -> kd[j] = 4 OR xs[k] < {none})",
        "d": "flatten(r.dd)", "nth": f"IF(li, transform(yy, v -> v % {1 << 32}), yy)", "item": f"IF(li, transform(yy, v -> v DIV {1 << 32}), array_repeat(0L, size(eo)))",
    }
    zipped = "CAST(arrays_zip(i, z, s, e, own, tag, p, d, nth, item) AS array<struct<i:int,z:int,s:int,e:int,own:boolean,tag:string,p:int,d:int,nth:int,item:int>>)"
    for name in reversed(fields):
        zipped = let(name, fields[name], zipped)
    zipped = let("yy", "flatten(r.yy)", let("en", ends, let("xs", f"transform(en, v -> CAST(v & {none} AS INT))", zipped)))
    checked = let("cl", "flatten(r.cl)", let("cz", "flatten(r.cz)", let("p", "flatten(r.pp)", let("i", "sequence(0, size(eo) - 1)", f"IF({right}, {zipped}, NULL)"))))
    places = "filter(transform(kd, (v, j) -> IF(%s, j, NULL)), v -> v IS NOT NULL)"
    found = let("tag", "transform(eo, j -> gt[j])", let("cs", places % "v = 2", let("rs", runs, let("r", fold, f"IF(r.bad, NULL, {checked})"))))
    counts = f"IF(li, transform(eo, j -> IF(gt[j] = 'li', {_ITEM}, 1L)), array_repeat(1L, size(eo)))"
    found = let("eo", places % "v NOT IN (0, 2)", let("ic", counts, f"IF(size(eo) = 0, NULL, {found})"))
    # what closes itself is a whole element in foreign content only, which is for the full fold
    foreign = f"(exists(g, z -> z.sc) AND exists(al, z -> {in_list('z', FOREIGN)}))"
    found = let("li", "array_contains(al, 'li')", let("gs", "g.s", let("kd", kinds, found)))
    found = let("gt", "g.tag", let("al", "array_distinct(gt)", f"IF({foreign}, NULL, {found})"))
    # a small page gains nothing
    return f"IF(size(g) BETWEEN {_FEW} AND {_TAGS}, {found}, NULL)"


def start_tags(toks: str, names: list[str] | None = None) -> str:
    """Start tags in the shape of the element list, without ends and ancestors: enough to test tags and attributes."""
    wanted = f"{tag_name('t')} <> ''" if names is None else in_list(tag_name("t"), names)
    tag = f"struct(j AS s, {tag_name('t')} AS tag)"
    found = f"filter(transform({toks}, (t, j) -> IF(startswith(t, '<') AND NOT startswith(t, '</') AND {wanted}, {tag}, NULL)), g -> g IS NOT NULL)"
    return (
        f"transform({found}, (g, j) -> struct(j AS i, j + 1 AS z, g.s AS s, g.s AS e, false AS own, g.tag AS tag, "
        "-1 AS p, 0 AS d, 0 AS nth, 0 AS item))"
    )


def attribute_list(tok: str) -> str:
    """Attributes of a tag token as array<struct<name, value>> in source order."""
    # a raw-text token holds its content too: look at the start tag only
    start_tag = f"IF({_may_be_raw(tok)}, regexp_extract({tok}, {lit(_START_TAG)}, 0), {tok})"
    body = f"regexp_replace({start_tag}, {lit(r'^<[^\s/>]+')}, '')"
    pattern = lit(_ATTRIBUTE)
    after = f"regexp_replace(substr(y, instr(y, '=') + 1), {lit(r'^\s+')}, '')"
    value = let("v", after, f"IF(substr(v, 1, 1) IN ('\"', {lit(chr(39))}), substr(v, 2, length(v) - 2), v)")
    return (
        f"transform(regexp_extract_all({body}, {pattern}, 0), y -> struct(lower(regexp_extract(y, {lit(r'^=?[^\s=]*')}, 0)) AS name, "
        f"IF(instr(y, '=') = 0, '', {value}) AS value))"
    )


def attribute(tok: str, name: str) -> str:
    """Decoded attribute value, NULL when absent, '' when present without a value."""
    found = let(
        "h",
        f"get(filter({attribute_list(tok)}, w -> w.name = {lit(name)}), 0).value",
        decode_entities("h", attribute=True),
    )
    return f"CASE WHEN contains(lower({tok}), {lit(name)}) THEN {found} END"


def attributes(tok: str) -> str:
    """Attribute map; the first of duplicate names wins."""
    names = "array_distinct(transform(l, w -> w.name))"
    return let(
        "l",
        attribute_list(tok),
        f"map_from_arrays({names}, transform({names}, n -> "
        + let("h", "get(filter(l, w -> w.name = n), 0).value", decode_entities("h", attribute=True))
        + "))",
    )


def descendants(x: str, els: str = "els") -> str:
    """Descendant elements of ``x``, a slice of the element list."""
    return f"slice({els}, {x}.i + 2, {x}.z - {x}.i - 1)"


def inner_tokens(toks: str, x: str) -> str:
    return f"slice({toks}, {x}.s + 2, greatest({x}.e - {x}.s - 1, 0))"


def raw_content(tok: str) -> str:
    """Content of a raw-text token as it stands."""
    return f"regexp_extract({tok}, {lit(_RAW_TOKEN)}, 2)"


def _raw_text(tok: str) -> str:
    """Content of a raw-text token as text."""
    return f"IF(lower(substr({tok}, 1, 2)) = '<t', {decode_entities(raw_content(tok))}, {raw_content(tok)})"


def texts(toks: str) -> str:
    """Per token: decoded text, content of a raw-text element, NULL for everything else; parallel to ``toks``."""
    return f"transform({toks}, t -> CASE WHEN {is_text('t')} THEN {decode_entities('t')} WHEN {_is_raw('t')} THEN {_raw_text('t')} END)"


def attribute_maps(toks: str, els: str) -> str:
    """Per element: its attribute map; parallel to ``els``."""
    has_any = f"{toks}[x.s] RLIKE {lit(r'^<[^\s/>]+[\s/]+[^\s/>]')}"
    return f"transform({els}, x -> IF({has_any}, {attributes(f'{toks}[x.s]')}, CAST(map() AS map<string,string>)))"


def text_content(x: str) -> str:
    """All text inside element ``x``, script and style text included; reads the array ``txt``."""
    return f"array_join(slice(txt, {x}.s + 1, greatest({x}.e - {x}.s, 1)), '')"


def inner_html(toks: str, x: str) -> str:
    is_raw = f"{x}.s = {x}.e AND {in_list(f'{x}.tag', RAW)}"
    return f"IF({is_raw}, {raw_content(f'{toks}[{x}.s]')}, array_join({inner_tokens(toks, x)}, ''))"


def outer_html(toks: str, x: str) -> str:
    return f"array_join(slice({toks}, {x}.s + 1, {x}.e - {x}.s + IF({x}.own OR {x}.s = {x}.e, 1, 0)), '')"


def title(toks: str) -> str:
    """Document title: text of the first title element, white space collapsed; '' when there is none."""
    first = f"get(filter({toks}, t -> lower(substr(t, 1, 6)) = '<title' AND {_is_raw('t')}), 0)"
    return let("c", first, f"IF(c IS NULL, '', {js_trim(collapse_space(decode_entities(raw_content('c'))))})")


def body_text(toks: str, visible: bool = True) -> str:
    """Text of the body (of the whole document when no body tag is given); scripts and styles only if not ``visible``."""
    start = f"array_position(transform({toks}, t -> lower(substr(t, 1, 5)) = '<body' AND {tag_name('t')} = 'body'), true)"
    raw = _is_raw("t") if not visible else f"(lower(substr(t, 1, 2)) = '<t' AND {_is_raw('t')})"
    return let(
        "p",
        f"CAST({start} AS INT)",
        f"array_join(transform(filter(slice({toks}, p + 1, size({toks})), t -> {is_text('t')} OR {raw}), "
        f"t -> IF({is_text('t')}, {decode_entities('t')}, {_raw_text('t')})), '')",
    )
