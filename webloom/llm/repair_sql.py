"""The check of structure repair as SQL: a fold over each conversation's rows from the end, then a walk along its audit."""

# CRC-32 of a short ASCII text, as the checking engine has none: the reversed polynomial, bit by bit
CRC = (
    "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT)), "
    "lambda c, b: list_reduce(range(0, 8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b)), 4294967295), 4294967295)"
)


def _best(*options: str) -> str:
    return "list_sort(list_filter([" + ", ".join(options) + "], lambda o: o IS NOT NULL))[1]"


def _edit(cost: str, letter: str, to: str) -> str:
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a}}"


_STAYS = "CASE WHEN x.fault = 3 THEN 5 ELSE 0 END"


def _options(state: int, fitting: int, kept: dict[str, int]) -> str:
    """Best edit of row ``x`` in a state, before insertions; ``acc`` has the best of the rows behind it per state."""
    keep = " ".join(f"WHEN x.fault NOT IN (1, 2) AND x.kind = '{kind}' THEN {_edit(_STAYS, 'K', f'acc.s{to}')}" for kind, to in kept.items())
    rerole = f"CASE WHEN x.fault NOT IN (1, 2) THEN {_edit(_STAYS + ' + 1', 'R', f'acc.s{fitting}')} END"
    return _best(_edit("2", "D", f"acc.s{state}"), f"CASE {keep} END", rerole)


def repair_sql() -> str:
    base = f"{{'b0': {_options(0, 2, {'s': 1, 'u': 2})}, 'b1': {_options(1, 2, {'u': 2})}, 'b2': {_options(2, 3, {'a': 3})}, 'b3': {_options(3, 2, {'u': 2})}}}"
    inserted = f"{{'b0': y.b0, 'b1': y.b1, 'u': {_best('y.b2', _edit('5', 'I', 'y.b3'))}, 'w': {_best('y.b3', _edit('5', 'I', 'y.b2'))}}}"
    after = f"{{'s0': {_best('z.b0', _edit('5', 'I', 'z.u'))}, 's1': {_best('z.b1', _edit('5', 'I', 'z.u'))}, 's2': z.u, 's3': z.w}}"
    fold = f"list_transform(list_transform([{base}], lambda y: {inserted}), lambda z: {after})[1]"
    end = "{'s0': {'c': 0, 'a': ''}, 's1': {'c': 10, 'a': 'II'}, 's2': {'c': 5, 'a': 'I'}, 's3': {'c': 0, 'a': ''}}"
    role, to = "CASE WHEN w.q = 2 THEN 'assistant' ELSE 'user' END", "CASE WHEN w.q = 2 THEN 3 ELSE 2 END"
    walk = (
        "CASE l WHEN 'D' THEN {'i': w.i + 1, 'q': w.q, 'o': w.o} "
        "WHEN 'K' THEN {'i': w.i + 1, 'q': CASE rows[w.i].kind WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'o': list_append(w.o, rows[w.i].role || ':' || rows[w.i].text)} "
        f"WHEN 'R' THEN {{'i': w.i + 1, 'q': {to}, 'o': list_append(w.o, {role} || ':' || rows[w.i].text)}} ELSE {{'i': w.i, 'q': {to}, 'o': list_append(w.o, {role} || ':')}} END"
    )
    named = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
    WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {named} AS named FROM conversations),
    f AS (SELECT conv_id, turn, role, text, {CRC.format('named')} % 20 AS fault FROM k),
    d AS (
      SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(0, CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM f WHERE fault > 0
    ),
    e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM d),
    g AS (
      SELECT conv_id, turn, role, text, place, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS kind,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS before
      FROM e
    ),
    h AS (
      SELECT conv_id, list({{'kind': kind, 'fault': fault, 'role': role, 'text': text}} ORDER BY place) AS rows, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (place > 1 AND coalesce(before, '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
      FROM g GROUP BY conv_id
    ),
    b AS (SELECT *, list_reduce(list_reverse(rows), lambda acc, x: {fold}, {end}).s0 AS best FROM h),
    r AS (SELECT *, sha256(array_to_string(list_reduce(string_split(best.a, ''), lambda w, l: CASE WHEN l = '' THEN w ELSE {walk} END, {{'i': 1, 'q': 0, 'o': CAST([] AS VARCHAR[])}}).o, chr(10))) AS repaired_sha256 FROM b)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
