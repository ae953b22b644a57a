"""URL functions as Spark SQL expression text."""

from __future__ import annotations

from webloom.functions.sqltext import in_list, let, lit

BLANKS = " \t\n\r\f"

# Fixed value: the splitting pattern of RFC 3986, appendix B.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_RFC = lit(RFC3986)


def _group(url: str, n: int) -> str:
    return f"regexp_extract({url}, {_RFC}, {n})"


def scheme(url: str) -> str:
    return f"lower({_group(url, 2)})"


def netloc(url: str) -> str:
    """Authority with user info and port; '' when there is none."""
    return _group(url, 4)


def path(url: str) -> str:
    return _group(url, 5)


def origin(url: str) -> str:
    return f"regexp_extract({url}, {lit('^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*')}, 0)"


def _parts(url: str) -> str:
    return (
        f"struct({_group(url, 2)} AS s, {_group(url, 3)} AS slashes, {_group(url, 4)} AS a, {_group(url, 5)} AS p, "
        f"{_group(url, 6)} AS q, {_group(url, 8)} AS f)"
    )


# The schemes whose references are resolved.
RELATIVE_SCHEMES = "ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtspu sftp svn svn+ssh ws wss".split()


def _without_dots(p: str, rooted: str) -> str:
    """Dot segments resolved; empty segments go only where the reference was relative to a folder."""
    folded = (
        f"aggregate(filter(seg, (s, i) -> s <> '' OR {rooted} OR i = 0 OR i = size(seg) - 1), CAST(array() AS array<string>), (a, s) -> CASE "
        "WHEN s = '.' THEN a WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 1)) ELSE array_append(a, s) END, "
        "a -> concat(array_join(a, '/'), IF(try_element_at(seg, -1) IN ('.', '..'), '/', '')))"
    )
    return let("seg", f"split({p}, '/')", folded)


def url_join(base: str, given: str) -> str:
    """Absolute URL of a reference: scheme-relative, rooted, relative, query-only, fragment-only, empty; blanks around it do not count."""
    ref = "ref_"
    query = "IF(r.q IN ('', '?'), '', r.q)"
    fragment = "IF(r.f IN ('', '#'), '', r.f)"
    base_query = "IF(b.q IN ('', '?'), '', b.q)"
    merged = (
        "CASE WHEN startswith(r.p, '/') THEN r.p "
        "ELSE concat(IF(b.p = '', '/', regexp_replace(b.p, '[^/]*$', '')), r.p) END"
    )
    # a reference with the scheme of the base gets it in lower case, one with another scheme stays as it is
    own = f"IF(lower(r.s) = lower(b.s), concat(lower(r.s), substr({ref}, length(r.s) + 1)), {ref})"
    full = let(
        "b",
        _parts(base),
        let(
            "r",
            _parts(ref),
            f"CASE WHEN r.s = '' AND b.s <> '' AND NOT {in_list('lower(b.s)', RELATIVE_SCHEMES)} THEN {ref} WHEN r.s <> '' AND (lower(r.s) <> lower(b.s) OR r.slashes <> '') THEN {own}"
            + " WHEN r.slashes <> '' AND r.a <> '' THEN concat(lower(b.s), ':', " + ref + ")"
            + f" WHEN r.p = '' THEN concat(lower(b.s), ':', b.slashes, b.p, IF({query} <> '', {query}, {base_query}), {fragment})"
            + f" ELSE concat(lower(b.s), ':', b.slashes, {_without_dots(merged, "startswith(r.p, '/')")}, {query}, {fragment}) END",
        ),
    )
    plain = f"{origin(base)} <> '' AND {ref} RLIKE {lit('^/[^/]')} AND NOT contains({ref}, '/.') AND NOT contains({ref}, '//') AND NOT {ref} RLIKE {lit('[?#]$')}"
    resolved = (
        f"CASE WHEN {ref} = '' THEN {base} WHEN {ref} RLIKE '^https?://' THEN {ref} "
        f"WHEN {plain} THEN concat({origin(base)}, {ref}) ELSE {full} END"
    )
    return let("ref_", f"btrim({given}, {lit(BLANKS)})", resolved)


def is_internal(url: str, page_url: str) -> str:
    """Prefix test against the page's origin."""
    return f"startswith({url}, {origin(page_url)})"


def same_domain(url: str, base: str) -> str:
    return f"({netloc(url)} = {netloc(base)} OR {netloc(url)} = '')"


def glob_regex(pattern: str) -> str:
    """Shell pattern as an anchored regular expression: * ? [seq] [!seq]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_/:&=%~@,; -" and c != "-" else "\\" + c
    return "(?s)^(?:" + out + ")$"


def glob_match(url: str, pattern: str) -> str:
    """Whole-string glob test; a pattern of plain text and ``*`` becomes LIKE, which Parquet can push down."""
    if "?" not in pattern and "[" not in pattern:
        like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return f"{url} LIKE {lit(like)}"
    return f"{url} RLIKE {lit(glob_regex(pattern))}"


def file_name(url: str) -> str:
    """Document name from the URL path: '/' becomes '_', one leading '_' dropped, 'index' when nothing is left."""
    return f"coalesce(nullif(regexp_replace(replace({path(url)}, '/', '_'), '^_', ''), ''), 'index')"
