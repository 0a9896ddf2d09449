"""String functions of the specification, as column expressions inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sverka.functions.regexes import java

#: Words without meaning in file names, deleted wherever they stand.
FILE_WORDS = ["тех(?:ническ[а-яё]*)?{ws}*задан[а-яё]*", "техническ[а-яё]*", "тз", "тх", "поставщик[а-яё]*", "аукцион[а-яё]*", "закупк[а-яё]*", "сайте", "zakupki", "gov", "ru", "docx", "pdf", "xlsx", "xls"]


def replaced(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, F.lit(java(pattern)), F.lit(by))


def bound(col: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(col), f), 0)


def trimmed(col: Column) -> Column:
    """Without outer white space of any kind."""
    return replaced(col, "^{ws}+|{ws}+$", "")


def norm_simple(col: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null as an empty text."""
    return trimmed(replaced(F.lower(F.coalesce(col, F.lit(""))), "{ws}+", " "))


def norm_light(col: Column) -> Column:
    """No NUL, LF line ends, at most one empty line, runs of spaces and tabs as one space, trimmed."""
    s = F.replace(F.replace(col, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return pd.Series([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in s], index=s.index, dtype=object)


def norm_heavy(col: Column) -> Column:
    """Comparable form of a product name: compatibility-composed, lower case, letters and digits of
    two alphabets in single spaces; a Cyrillic н before a digit is the Latin h it is meant as."""
    s = F.lower(F.regexp_replace(_nfkc(F.coalesce(col, F.lit(""))), "[\\uFEFF\\u200B-\\u200D\\u2060]", ""))
    s = F.regexp_replace(F.regexp_replace(s, "[“”\"']", ""), "н(?=[0-9])", "h")
    return F.trim(F.regexp_replace(s, "[^a-z0-9а-яё]+", " "))


def strip_html(col: Column) -> Column:
    """Text of markup: tags as spaces, two entities decoded, white space collapsed; null as an empty text."""
    s = F.coalesce(col, F.lit(""))
    for pattern, by in ((r"(?i)<br\s*/?>|</p>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&")):
        s = F.regexp_replace(s, pattern, by)
    return trimmed(replaced(s, "{ws}+", " "))


#: XML entities in the order they are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]


def decode_entities(col: Column) -> Column:
    for entity, c in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(c))
    return col


def repair_latin1(col: Column) -> Column:
    """UTF-8 read as Latin-1, repaired where the result is Cyrillic; other texts stay."""
    fits = col.rlike("^[\\x00-\\xFF]*$") & col.rlike("[ÐÑÒÓÖ×ØÙÚÛÜÝÞßà-ÿ]")
    back = F.try_validate_utf8(F.encode(F.when(fits, col), "ISO-8859-1").cast("string"))
    return F.when(fits & back.rlike("[\\u0400-\\u04FF]"), back).otherwise(col)


def safe_extension(col: Column) -> Column:
    """Lower-case extension with its point, an empty text without one."""
    return F.lower(F.regexp_extract(col, r"[^/.](\.[^./]+)$", 1))


def filename_hint(col: Column) -> Column:
    """What a file name tells of the product; null if under three characters."""
    s = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?<=[^/.])\.[^./]*$", "")), "^.*/", "")
    s = F.regexp_replace(F.regexp_replace(s, "[–—-]+|_+", " "), "[()]", " ")
    for word in FILE_WORDS:
        s = replaced(s, word, " ")
    s = trimmed(replaced(s, "{ws}+", " "))
    return F.when(F.length(s) >= 3, s)


def tokens(col: Column) -> Column:
    """Tokens of letters and digits of two alphabets, lower case."""
    return F.filter(F.split(norm_simple(col), "[^a-z0-9а-яё]+"), lambda t: t != "")


def name_tokens(col: Column) -> Column:
    """Words of at least three characters."""
    return F.filter(F.split(F.lower(col), java("{ws}+")), lambda t: F.length(t) >= 3)


def roots(words: Column) -> Column:
    """First five letters of the words that have as many."""
    return F.transform(F.filter(words, lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 5))


def split_delims(col: Column) -> Column:
    """Cells of a line: by bars, else tabs, else gaps of two spaces (then two cells at least); empty ones dropped."""
    cells = lambda p: F.filter(F.transform(F.split(col, p), trimmed), lambda x: x != "")
    gaps = cells(" {2,}")
    return F.when(col.contains("|"), cells(r"\|")).when(col.contains("\t"), cells("\t")).otherwise(F.when(F.size(gaps) >= 2, gaps).otherwise(F.array().cast("array<string>")))


def colon_parts(col: Column) -> Column:
    """The first two parts between colons; what follows a second colon is dropped."""
    return F.slice(F.split(col, ":"), 1, 2)


def label_number(col: Column) -> Column:
    """struct(label, value) of "label 40 units"; null without a label of three characters or a value other than zeros."""
    s = trimmed(col)
    pattern = java(r"(?s)^(.+?){ws}+(\d[\d{nws},./]*.*)$")
    left, right = trimmed(F.regexp_extract(s, pattern, 1)), trimmed(F.regexp_extract(s, pattern, 2))
    fine = (F.length(s) >= 4) & (F.length(left) >= 3) & (right != "") & ~replaced(right, "{ws}", "").rlike("^0+$")
    return F.when(fine, F.struct(left.alias("label"), right.alias("value")))


def pack_quantity(col: Column) -> Column:
    """Largest quantity told after a packing word or number sign; null without one."""
    found = F.regexp_extract_all(F.lower(col), F.lit(java(r"(?:упак(?:овк[аеуи])?|в упаковке|№){ws}*[№#]?{ws}*(\d{1,4}){b}")), F.lit(1))
    numbers = F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n > 0)
    return F.when(F.size(numbers) > 0, F.array_max(numbers))


def chunk_text(col: Column, size: int = 3500, overlap: int = 400) -> Column:
    """Chunks of whole paragraphs up to size characters; a longer paragraph is cut by a sliding window."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), r"\n{2,}"), trimmed), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("open"), empty.alias("done"))

    def pack(state: Column, p: Column) -> Column:
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        flushed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        windows = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size - overlap)), lambda i: F.substring(p, i + 1, F.lit(size)))
        return (
            F.when(F.length(joined) <= size, F.struct(joined.alias("open"), state["done"].alias("done")))
            .when(F.length(p) > size, F.struct(F.lit("").alias("open"), F.concat(flushed, windows).alias("done")))
            .otherwise(F.struct(p.alias("open"), flushed.alias("done")))
        )

    return F.aggregate(paragraphs, start, pack, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def json_slice(col: Column) -> Column:
    """From the first to the last brace of a text in a code fence or not; null without both."""
    return F.nullif(F.regexp_extract(col, r"(?s)(\{.*\})", 1), F.lit(""))


def lines(col: Column) -> Column:
    """Trimmed lines without empty ones and lone backslashes."""
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "\n"), trimmed), lambda x: (x != "") & (x != "\\"))
