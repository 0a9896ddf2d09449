"""Entity, attribute, value rows into a wide table with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sverka.functions.forms import trimmed
from sverka.operators.attributes import PLACEHOLDERS

# What a flag says.
TRUE_WORDS = ["да", "+", "имеется", "наличие", "присутствует", "есть", "yes", "true"]
FALSE_WORDS = ["нет", "не имеется", "отсутствует", "отсутствие", "no", "false"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]

#: Column type of each value type; a type not named here is kept as text.
COLUMN_TYPES = {"integer": "decimal(38,0)", "decimal": "decimal(38,18)", "flag": "boolean", "date": "date", "code": "string", "text": "string", "list": "string", "quantity": "string"}


def usable(value: Column) -> Column:
    """A value that states something; null and placeholders don't."""
    return value.isNotNull() & ~F.lower(trimmed(value)).isin(PLACEHOLDERS)


def _digits(value: Column) -> Column:
    """The first number of a text, without spaces, with a point; 1 000 is one number."""
    digits = F.regexp_extract(value, r"((?:\d{1,3}(?: \d{3})+(?!\d)|\d+)(?:[.,]\d+)?)", 1)
    return F.regexp_replace(F.regexp_replace(digits, " ", ""), ",", ".")


def cast_decimal(value: Column) -> Column:
    """First number of a text; else null."""
    return _digits(value).try_cast("decimal(38,18)")


def cast_integer(value: Column) -> Column:
    """First number of a text if it is whole, of any size up to 38 digits. Else null."""
    return F.regexp_extract(_digits(value), r"^(\d+)(?:\.0+)?$", 1).try_cast("decimal(38,0)")


def cast_flag(value: Column) -> Column:
    """True, false or null by the words of a yes and a no."""
    word = F.lower(F.regexp_replace(value, r"^[\s\-.;:]+|[\s\-.;:]+$", ""))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def cast_date(value: Column) -> Column:
    """Date of 2020-05-14, 20200514, 14.5.2020, 14/05/2020 or 14 мая 2020, day before month; else null."""
    text = F.lower(value)
    for k, name in enumerate(MONTHS):
        text = F.regexp_replace(text, rf"(\d)\s*{name}\s*(\d)", rf"$1.{k + 1}.$2")
    iso = F.regexp_extract(text, r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})(?!\d)", 1)
    packed = F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1)
    d, m, y = (F.regexp_extract(text, r"(?<!\d)(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\d)", k) for k in (1, 2, 3))
    return F.coalesce(
        F.try_to_date(iso, "yyyy-M-d"),
        F.try_to_date(packed, "yyyyMMdd"),
        F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d"),
    )


def cast_code(value: Column) -> Column:
    return F.when(usable(value), trimmed(value))


CASTS = {"integer": cast_integer, "decimal": cast_decimal, "flag": cast_flag, "date": cast_date, "code": cast_code, "text": cast_code, "list": cast_code, "quantity": cast_code}


def discover(rows: DataFrame, attributes: DataFrame) -> list[tuple[str, str]]:
    """(attr_code, value_type) of the attributes that rows state, sorted; bounded by the dictionary."""
    stated = rows.select("attr_code").distinct()
    return [(r[0], r[1]) for r in attributes.join(stated, "attr_code", "left_semi").select("attr_code", "value_type").orderBy("attr_code").collect()]


def widen(rows: DataFrame, columns: list[tuple[str, str]], entity: str = "doc_id", order: str = "row_ord") -> DataFrame:
    """One row per entity, one typed column per attribute.

    rows: entity, order, attr_code, value_raw in consistent form. If an entity states an
    attribute several times, the usable value of the largest order counts; repeated rows
    and ties take the largest value. Entities without any usable value keep a row of nulls;
    an empty table gives an empty one. One pass, one shuffle with partial aggregation:
    each attribute is one conditional max of (order, value).
    """
    picked = []
    for code, kind in columns:
        value = CASTS.get(kind, cast_code)(F.col("value_raw"))
        pair = F.struct(F.col(order).alias("o"), value.alias("v"))
        picked.append(F.max(F.when((F.col("attr_code") == code) & value.isNotNull(), pair)).alias(code))
    wide = rows.groupBy(entity).agg(*picked)
    return wide.select(entity, *(F.col(f"`{code}`.v").cast(COLUMN_TYPES.get(kind, "string")).alias(code) for code, kind in columns))


def cell_text(col: Column, kind: str) -> Column:
    """A typed cell as text: digits, a decimal without needless zeros, true or false, YYYY-MM-DD."""
    if kind == "decimal":
        whole = F.floor(col).cast("decimal(38,0)")
        part = F.regexp_replace(F.lpad(((col - whole) * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(18,0)").cast("string"), 18, "0"), "0+$", "")
        return F.concat(whole.cast("string"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    if kind == "date":
        return F.date_format(col, "yyyy-MM-dd")
    return col.cast("string")


def cells(wide: DataFrame, columns: list[tuple[str, str]], entity: str = "doc_id") -> DataFrame:
    """The filled cells of a wide table: entity, attr_code, cell."""
    parts = F.array(*(F.struct(F.lit(code).alias("attr_code"), cell_text(F.col(code), kind).alias("cell")) for code, kind in columns))
    return wide.select(entity, F.explode(parts).alias("c")).select(entity, "c.*").where("cell is not null")
