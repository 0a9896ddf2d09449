"""Pieces of the oracle SQL: the specification's functions in DuckDB's dialect."""

from __future__ import annotations

from sverka.functions import lexicon as L
from sverka.functions import numbers as N
from sverka.functions import text as X
from sverka.functions.regexes import quoted, re2


def rep(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(re2(pattern))}, {quoted(by)}, 'g')"


def trim(x: str) -> str:
    return rep(x, "^{ws}+|{ws}+$", "")


def simple(x: str) -> str:
    return trim(rep(f"lower(coalesce({x}, ''))", "{ws}+", " "))


def light(x: str) -> str:
    return trim(rep(rep(f"replace({x}, chr(13) || chr(10), chr(10))", r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def heavy(x: str) -> str:
    """The heavy form of a text that is compatibility-composed but for full-width characters and no-break spaces."""
    s = f"lower({rep(f'nfc_normalize({x})', '[' + chr(0xFEFF) + chr(0x200B) + '-' + chr(0x200D) + chr(0x2060) + ']', '')})"
    wide, digits = ''.join(map(chr, range(0xFF01, 0xFF5F))).lower(), ''.join(map(chr, range(0x1D7CE, 0x1D800)))
    s = f"translate({s}, {quoted(wide + digits)}, {quoted(''.join(map(chr, range(0x21, 0x7F))).lower() + '0123456789' * 5)})"
    s = rep(rep(rep(s, "№", "no"), "[“”\"']", ""), "н([0-9])", "h\\1")
    return f"trim({rep(s, '[^a-z0-9а-яё]+', ' ')})"


def html(x: str) -> str:
    s = f"coalesce({x}, '')"
    for pattern, by in ((r"(?i)<br\s*/?>|</p>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&")):
        s = rep(s, pattern, by)
    return trim(rep(s, "{ws}+", " "))


def entities(x: str) -> str:
    for entity, c in X.ENTITIES:
        x = f"replace({x}, {quoted(entity)}, {quoted(c)})"
    return x


def hint(x: str) -> str:
    s = rep(rep(f"lower(regexp_replace(regexp_replace({x}, '([^/.])\\.[^./]*$', '\\1'), '^.*/', ''))", "[–—-]+|_+", " "), "[()]", " ")
    for word in X.FILE_WORDS:
        s = rep(s, word, " ")
    s = trim(rep(s, "{ws}+", " "))
    return f"CASE WHEN length({s}) >= 3 THEN {s} END"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({simple(x)}, '[^a-z0-9а-яё]+'), lambda t: t <> '')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda y: {trim('y')}), lambda y: y <> '' AND y <> chr(92))"


def squeezed(x: str) -> str:
    return rep(f"lower(coalesce({x}, ''))", "{ws}", "")


def nums(x: str) -> str:
    return rf"list_transform(regexp_extract_all({squeezed(x)}, '(-?\d+(?:[.,]\d+)?)', 1), lambda t: try_cast(replace(t, ',', '.') AS DOUBLE))"


def got(s: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(nullif(replace(regexp_extract({s}, {quoted(pattern)}, {group}), ',', '.'), '') AS DOUBLE)"


def bounds(s: str) -> tuple[str, str]:
    """SQL of the ends of a range in squeezed text s; an open end is infinite, both are null without a range."""
    low = high = ""
    for p in (N.BOTH_UP, N.BOTH_DOWN, N.SPAN):
        low += f"WHEN {got(s, p)} IS NOT NULL THEN least({got(s, p)}, {got(s, p, 2)}) "
        high += f"WHEN {got(s, p)} IS NOT NULL THEN greatest({got(s, p)}, {got(s, p, 2)}) "
    most = "coalesce(" + ", ".join(got(s, p) for p in N.AT_MOST) + ")"
    least = "coalesce(" + ", ".join(got(s, p) for p in N.AT_LEAST) + ")"
    low += f"WHEN {most} IS NOT NULL THEN '-Infinity'::DOUBLE ELSE {least} "
    high += f"WHEN {most} IS NOT NULL THEN {most} WHEN {least} IS NOT NULL THEN 'Infinity'::DOUBLE "
    return f"CASE {low} END", f"CASE {high} END"


def features(x: str, p: str) -> str:
    """SELECT list of a value's features with prefix p, over a column p||s of squeezed text."""
    low, high = bounds(f"{p}s")
    blood = "list_filter([" + ", ".join(f"CASE WHEN contains({simple(x)}, '{w}') THEN '{w}' END" for w in L.BLOOD_LEXEMES) + "], lambda w: w IS NOT NULL)"
    letters, digits = f"length({rep(f'lower(coalesce({x}, {quoted(chr(0)[:0])}))', '[^a-zа-яё]', '')})", f"length({rep(f'coalesce({x}, {quoted(chr(0)[:0])})', '[^0-9]', '')})"
    return f"""{low} AS {p}lo, {high} AS {p}hi, {nums(x)} AS {p}n, {digits} > 0 AS {p}d,
      (len({tokens(x)}) >= 8 AND {letters} >= 20 AND {digits} > 0 AND {letters} >= {digits} * 3) AS {p}t, {simple(x)} AS {p}norm, list_distinct({tokens(x)}) AS {p}tok, {blood} AS {p}b"""


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"{both}::DOUBLE / greatest(1, len({a}) + len({b}) - {both})"


def match_reason(q: str, l: str) -> str:  # noqa: E741
    """CASE that gives '1 reason' or '0 reason' for feature prefixes q and l."""
    share = jaccard(f"{q}tok", f"{l}tok")
    text = f"""CASE WHEN {q}norm = '' OR {l}norm = '' THEN '0 empty values' WHEN {q}norm = {l}norm THEN '1 exact text match'
      WHEN len({q}tok) = 0 OR len({l}tok) = 0 THEN '0 no tokens' WHEN list_has_any({q}b, {l}b) THEN '1 biological material overlap'
      WHEN {share} >= CASE WHEN length({q}norm) >= 80 AND length({l}norm) >= 80 THEN 0.12::DOUBLE ELSE 0.85::DOUBLE END THEN '1 token overlap' ELSE '0 low token overlap' END"""

    def held(n: str, r: str, yes: str, no: str) -> str:
        return f"""CASE WHEN CASE WHEN {r}hi = 'Infinity'::DOUBLE THEN list_max({n}n) >= {r}lo WHEN {r}lo = '-Infinity'::DOUBLE THEN list_max({n}n) <= {r}hi
          ELSE list_min({n}n) >= {r}lo AND list_max({n}n) <= {r}hi END THEN '1 {yes}' ELSE '0 {no}' END"""

    gap = f"abs({q}n[1] - {l}n[1])"
    return f"""CASE WHEN {q}lo IS NOT NULL AND {l}lo IS NOT NULL THEN CASE WHEN {q}lo >= {l}lo AND {q}hi <= {l}hi THEN '1 query range inside library range' ELSE '0 query range outside library range' END
      WHEN {l}lo IS NOT NULL AND len({q}n) > 0 THEN {held(q, l, "query within library range", "query outside library range")}
      WHEN {q}lo IS NOT NULL AND len({l}n) > 0 THEN {held(l, q, "library within query range", "library outside query range")}
      WHEN {q}t AND {l}t THEN {text}
      WHEN len({q}n) > 0 AND len({l}n) > 0 THEN CASE WHEN {gap} <= 0 OR CASE WHEN {l}n[1] <> 0 THEN {gap} / abs({l}n[1]) ELSE {gap} END <= 0.1::DOUBLE THEN '1 numbers within tolerance' ELSE '0 numbers differ' END
      WHEN {q}d <> {l}d THEN '0 digits mismatch' WHEN {q}d AND {l}d THEN '0 no numeric/range match' ELSE {text} END"""
