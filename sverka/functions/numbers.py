"""Numbers and ranges in text, and the comparison of two values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sverka.functions import text as X
from sverka.functions.lexicon import BLOOD_LEXEMES

_N = r"(-?\d+(?:[.,]\d+)?)"
# Words and signs of bounds; texts are lower case and without white space.
_LOW = "(?:>=|≥|неменее|нениже|от)"
_HIGH = "(?:<=|≤|неболее|довключительно|до)"
BOTH_UP = rf"{_LOW}\D*{_N}[\s\S]{{0,20}}?{_HIGH}\D*{_N}"
BOTH_DOWN = rf"{_HIGH}\D*{_N}[\s\S]{{0,20}}?{_LOW}\D*{_N}"
SPAN = rf"{_N}[-–—]{_N}"
AT_MOST = [rf"(?:<=|≤|<|неболее|невыше|непревышает|небольше|до|менее|меньше)\D*{_N}", rf"{_N}\D*(?:<=|≤|<|менее|меньше)"]
AT_LEAST = [rf"(?:>=|≥|>|более|больше|неменее|нижене|неменьше|нениже|от)\D*{_N}", rf"{_N}\D*(?:>=|≥|>|ивыше|более|больше|свыше)"]


def squeezed(col: Column) -> Column:
    """Lower case without any white space; null as an empty text."""
    return X.replaced(F.lower(F.coalesce(col, F.lit(""))), "{ws}", "")


def as_double(col: Column) -> Column:
    return F.replace(col, F.lit(","), F.lit(".")).try_cast("double")


def numbers(col: Column) -> Column:
    """All numbers of a text after its white space is dropped, so spaced digits are one number."""
    return F.transform(F.regexp_extract_all(squeezed(col), F.lit(r"(-?\d+(?:[.,]\d+)?)"), F.lit(1)), as_double)


def _got(s: Column, pattern: str, group: int = 1) -> Column:
    return as_double(F.nullif(F.regexp_extract(s, pattern, group), F.lit("")))


def value_range(col: Column) -> Column:
    """struct(min, max) of a bound or span, null without one; open ends are infinite.

    In order: both bounds, a span a-b, an upper bound, a lower bound. Bounds in the wrong
    order are swapped, strict ones count as inclusive.
    """
    inf = F.lit(float("inf"))

    def both(s: Column, p: str) -> Column:
        ends = F.struct(_got(s, p).alias("a"), _got(s, p, 2).alias("b"))
        return X.bound(ends, lambda m: F.when(m["a"].isNotNull(), F.struct(F.least(m["a"], m["b"]).alias("min"), F.greatest(m["a"], m["b"]).alias("max"))))

    def found(s: Column) -> Column:
        high = X.bound(F.coalesce(*(_got(s, p) for p in AT_MOST)), lambda x: F.when(x.isNotNull(), F.struct((-inf).alias("min"), x.alias("max"))))
        low = X.bound(F.coalesce(*(_got(s, p) for p in AT_LEAST)), lambda x: F.when(x.isNotNull(), F.struct(x.alias("min"), inf.alias("max"))))
        return F.when(s.rlike("[0-9]"), F.coalesce(*(both(s, p) for p in (BOTH_UP, BOTH_DOWN, SPAN)), high, low))

    return X.bound(squeezed(col), found)


def features(col: Column) -> Column:
    """All that a comparison needs of a value, as plain fields; computed once per row, before any join.

    low and high are the ends of its range (null without one), first, most and least those
    of its numbers (null without one).
    """
    letters = F.length(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-zа-яё]", ""))
    digits = F.length(F.regexp_replace(F.coalesce(col, F.lit("")), "[^0-9]", ""))

    def of(m: Column) -> Column:
        norm = m["norm"]
        toks = F.filter(F.split(norm, "[^a-z0-9а-яё]+"), lambda t: t != "")
        return F.struct(
            m["range"]["min"].alias("low"),
            m["range"]["max"].alias("high"),
            F.get(m["nums"], 0).alias("first"),
            F.array_max(m["nums"]).alias("most"),
            F.array_min(m["nums"]).alias("least"),
            (digits > 0).alias("digits"),
            ((F.size(toks) >= 8) & (letters >= 20) & (digits > 0) & (letters >= digits * 3)).alias("textual"),
            norm.alias("norm"),
            (F.length(norm) >= 80).alias("long"),
            F.array_distinct(toks).alias("tokens"),
            F.array_compact(F.array(*(F.when(norm.contains(w), F.lit(w)) for w in BLOOD_LEXEMES))).alias("blood"),
        )

    return X.bound(F.struct(X.norm_simple(col).alias("norm"), numbers(col).alias("nums"), value_range(col).alias("range")), of)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


#: Outcomes of a comparison; the first ones are matches.
REASONS = [
    "query range inside library range", "query within library range", "library within query range", "numbers within tolerance", "exact text match", "biological material overlap", "token overlap",
    "query range outside library range", "query outside library range", "library outside query range", "numbers differ", "digits mismatch", "no numeric/range match", "empty values", "no tokens", "low token overlap",
]
MATCHES = 7
_CODE = {r: k for k, r in enumerate(REASONS)}


def _either(ok: Column, yes: str, no: str) -> Column:
    return F.when(ok, _CODE[yes]).otherwise(_CODE[no])


def _within(n: Column, r: Column) -> Column:
    """Whether the numbers of n keep the range of r: an open range is held by the largest, a closed one by all."""
    inf = float("inf")
    return F.when(r["high"] == inf, n["most"] >= r["low"]).when(r["low"] == -inf, n["most"] <= r["high"]).otherwise((n["least"] >= r["low"]) & (n["most"] <= r["high"]))


def text_code(q: Column, l: Column) -> Column:  # noqa: E741
    """Outcome of two texts without comparable numbers."""
    shared = F.size(F.array_intersect(q["tokens"], l["tokens"]))
    share = shared / (F.size(q["tokens"]) + F.size(l["tokens"]) - shared)  # the tokens are sets
    return (
        F.when((q["norm"] == "") | (l["norm"] == ""), _CODE["empty values"])
        .when(q["norm"] == l["norm"], _CODE["exact text match"])
        .when((F.size(q["tokens"]) == 0) | (F.size(l["tokens"]) == 0), _CODE["no tokens"])
        .when(F.arrays_overlap(q["blood"], l["blood"]), _CODE["biological material overlap"])
        .otherwise(_either(share >= F.when(q["long"] & l["long"], 0.12).otherwise(0.85), "token overlap", "low token overlap"))
    )


def match_code(q: Column, l: Column, relative: float = 0.1, absolute: float = 0.0) -> Column:  # noqa: E741
    """Place in REASONS of the comparison of a query's and a library value's features, by the first rule that applies.

    The tolerance is relative to the library's number. Kept small: a method over the JIT
    compiler's limit would be interpreted for every pair.
    """
    has_q, has_l, qr, lr = q["first"].isNotNull(), l["first"].isNotNull(), q["low"].isNotNull(), l["low"].isNotNull()
    gap = F.abs(q["first"] - l["first"])
    near = (gap <= absolute) | (gap / F.when(l["first"] != 0, F.abs(l["first"])).otherwise(1.0) <= relative)
    return (
        F.when(~q["digits"] & ~l["digits"] & ~qr & ~lr, text_code(q, l))
        .when(qr & lr, _either((q["low"] >= l["low"]) & (q["high"] <= l["high"]), "query range inside library range", "query range outside library range"))
        .when(lr & has_q, _either(_within(q, l), "query within library range", "query outside library range"))
        .when(qr & has_l, _either(_within(l, q), "library within query range", "library outside query range"))
        .when(q["textual"] & l["textual"], text_code(q, l))
        .when(has_q & has_l, _either(near, "numbers within tolerance", "numbers differ"))
        .otherwise(_either(q["digits"] != l["digits"], "digits mismatch", "no numeric/range match"))
    )


def matches(q: Column, l: Column, relative: float = 0.1, absolute: float = 0.0) -> Column:  # noqa: E741
    return match_code(q, l, relative, absolute) < MATCHES


def values_match(q: Column, l: Column, relative: float = 0.1, absolute: float = 0.0) -> Column:  # noqa: E741
    """struct(match, reason) of a comparison."""
    said = F.array(*map(F.lit, REASONS))
    return X.bound(match_code(q, l, relative, absolute), lambda c: F.struct((c < MATCHES).alias("match"), F.get(said, c).alias("reason")))


def has_percent(norm: Column) -> Column:
    return norm.rlike(X.java("%|процент|{b}percent{b}"))


def has_ng_ml(norm: Column) -> Column:
    return norm.rlike("ng/?ml|нг/?мл")


def unit_tokens_match(a: Column, b: Column) -> Column:
    """Percent or ng/ml on one side must be on the other too; other units don't matter."""
    pa, pb, na, nb = has_percent(a), has_percent(b), has_ng_ml(a), has_ng_ml(b)
    return F.when(pa | pb, pa == pb).when(na | nb, na == nb).otherwise(True)


def clamp01(x: Column) -> Column:
    """Into 0..1; null, NaN and infinite values are 0."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
