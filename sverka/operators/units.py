"""Quantities recorded in different units, converted to the unit each attribute wants.

Unit spellings aren't matched row by row. The distinct texts that follow a number, stand in
the unit column or after the indicator are collected first; each is mapped once, through an
inverted index of character n-grams and a weighted edit distance, and the resulting alias
dictionary is joined to all rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sverka.session import written

# Dimension, factor to the dimension's own unit, offset added before the factor, spellings.
UNITS = [
    ("volume", 1e-3, 0.0, ["мкл", "микролитр", "микролитров", "ul", "mkl", "µl", "microlitre", "microliter"]),
    ("volume", 1.0, 0.0, ["мл", "миллилитр", "миллилитра", "миллилитров", "ml", "millilitre", "milliliter", "см3", "см^3", "cm3", "cc", "куб. см", "кубических сантиметров", "кубический сантиметр"]),
    ("volume", 1e-6, 0.0, ["нл", "нанолитр", "нанолитров", "nl"]),
    ("volume", 10.0, 0.0, ["сл", "сантилитр", "cl"]),
    ("volume", 100.0, 0.0, ["дл", "децилитр", "децилитра", "децилитров", "dl"]),
    ("volume", 1000.0, 0.0, ["л", "литр", "литра", "литров", "l", "litre", "liter"]),
    ("concentration", 1.0, 0.0, ["нг/мл", "ng/ml", "мкг/л", "ug/l", "mkg/l", "нанограмм на миллилитр", "микрограмм на литр"]),
    ("concentration", 1e-3, 0.0, ["пг/мл", "pg/ml", "нг/л", "ng/l", "пикограмм на миллилитр", "нанограмм на литр"]),
    ("concentration", 1e3, 0.0, ["мкг/мл", "ug/ml", "мг/л", "mg/l", "микрограмм на миллилитр", "миллиграмм на литр"]),
    ("concentration", 1e4, 0.0, ["мг/дл", "mg/dl", "миллиграмм на децилитр"]),
    ("concentration", 1e1, 0.0, ["мкг/дл", "ug/dl", "микрограмм на децилитр"]),
    ("concentration", 1e6, 0.0, ["мг/мл", "mg/ml", "г/л", "g/l", "миллиграмм на миллилитр", "грамм на литр"]),
    ("time", 1 / 60, 0.0, ["с", "сек", "секунд", "секунда", "секунды", "s", "sec", "second", "seconds"]),
    ("time", 1.0, 0.0, ["мин", "минут", "минута", "минуты", "min", "minute", "minutes"]),
    ("time", 60.0, 0.0, ["ч", "час", "часа", "часов", "h", "hour", "hours", "hr"]),
    ("time", 1440.0, 0.0, ["сут", "сутки", "суток", "дн", "день", "дня", "дней", "d", "day", "days"]),
    ("length", 1e-3, 0.0, ["мкм", "микрометр", "микрометров", "микрон", "um", "µm"]),
    ("length", 1.0, 0.0, ["мм", "миллиметр", "миллиметра", "миллиметров", "mm", "millimetre", "millimeter"]),
    ("length", 10.0, 0.0, ["см", "сантиметр", "сантиметра", "сантиметров", "cm", "centimetre", "centimeter"]),
    ("length", 100.0, 0.0, ["дм", "дециметр", "дециметров", "dm"]),
    ("length", 1000.0, 0.0, ["м", "метр", "метра", "метров", "m", "metre", "meter"]),
    ("length", 25.4, 0.0, ["дюйм", "дюйма", "дюймов", "in", "inch", "inches"]),
    ("mass", 1e-6, 0.0, ["мкг", "микрограмм", "микрограмма", "ug"]),
    ("mass", 1e-3, 0.0, ["мг", "миллиграмм", "миллиграмма", "mg", "milligram"]),
    ("mass", 1.0, 0.0, ["г", "гр", "грамм", "грамма", "граммов", "g", "gram", "grams"]),
    ("mass", 1000.0, 0.0, ["кг", "килограмм", "килограмма", "килограммов", "kg", "kilogram"]),
    ("temperature", 1.0, 0.0, ["°c", "c", "°с", "с", "гр.с℃", "цельсия", "celsius", "град. c", "град. с", "градус цельсия", "градуса цельсия", "градусов цельсия", "градусов c", "градусов с"]),
    ("temperature", 5 / 9, -32.0, ["°f", "f", "фаренгейта", "град. f", "градусов фаренгейта", "градус фаренгейта"]),
    ("temperature", 1.0, -273.15, ["k", "к", "кельвин", "кельвина", "кельвинов", "kelvin", "°k", "°к"]),
]
_SMALL = set("аеиоуыэюяьъйё.")  # weight half in the edit distance: endings, vowels and points
_SHORT = 4  # spellings shorter than this must agree exactly
_PART = 0.25  # of the length that the weighted distance may be


def squeezed(text: str) -> str:
    """Lower case, no space around a slash, single spaces, no outer marks or final points."""
    text = re.sub(r"\s*/\s*", "/", text.lower())
    return re.sub(r"\s+", " ", text).strip(" \t\n.:;,()[]{}~-—–")


class UnitIndex:
    """Inverted index of the n-grams of all known spellings."""

    def __init__(self, n: int = 2):
        self.n, self.exact, self.grams = n, {}, defaultdict(set)
        for dimension, factor, offset, spellings in UNITS:
            for s in spellings:
                self.exact[(dimension, squeezed(s))] = (factor, offset)
        # the same over all dimensions, fuzzy only among spellings of as many words
        self.any: dict[str, dict[str, tuple[float, float]]] = defaultdict(dict)
        self.any_grams: dict[tuple[int, str], set] = defaultdict(set)
        for (dimension, s), unit in self.exact.items():
            self.any[s][dimension] = unit
            for g in self._grams(s) if len(s) >= _SHORT else ():
                self.any_grams[(s.count(" "), g)].add(s)
        longest = max(len(s) for _, s in self.exact)
        #: No longer spelling is within the distance of a known one: what is left over weighs at least half.
        self.longest = int(longest * (1 + 2 * _PART))
        for key in self.exact:
            for g in self._grams(key[1]):
                self.grams[(key[0], g)].add(key)

    def _grams(self, s: str) -> set[str]:
        s = f"^{s}$"
        return {s[k : k + self.n] for k in range(len(s) - self.n + 1)}

    def find(self, dimension: str, spelling: str) -> tuple[float, float] | None:
        """Factor and offset of a spelling: exact, without points, or the nearest by weighted distance."""
        for s in (spelling, spelling.replace(".", ""), spelling.replace(". ", " ")):
            if (dimension, s) in self.exact:
                return self.exact[(dimension, s)]
        if len(spelling) < _SHORT or len(spelling) > self.longest or not any(c.isalpha() for c in spelling):
            return None
        own, shared = self._grams(spelling), defaultdict(int)
        for g in own:
            for key in self.grams.get((dimension, g), ()):
                shared[key] += 1
        near = [
            (cost, key[1])
            for key, n in shared.items()
            if len(key[1]) >= _SHORT and 2 * n >= len(own) - 2 and (cost := edit_cost(spelling, key[1])) <= _PART * min(len(spelling), len(key[1]))
        ]
        return self.exact[(dimension, min(near)[1])] if near else None


    def find_any(self, spelling: str) -> dict[str, tuple[float, float]]:
        """By dimension factor and offset of a spelling, as find tells them; a near spelling must have as many words."""
        for s in (spelling, spelling.replace(".", ""), spelling.replace(". ", " ")):
            if s in self.any:
                return self.any[s]
        if len(spelling) < _SHORT or len(spelling) > self.longest or not any(c.isalpha() for c in spelling):
            return {}
        own, words, shared = self._grams(spelling), spelling.count(" "), defaultdict(int)
        for g in own:
            for s in self.any_grams.get((words, g), ()):
                shared[s] += 1
        near = [(cost, s) for s, n in shared.items() if 2 * n >= len(own) - 2 and (cost := edit_cost(spelling, s)) <= _PART * min(len(spelling), len(s))]
        return self.any[min(near)[1]] if near else {}


def edit_cost(a: str, b: str) -> float:
    """Edit distance in which vowels, endings and points weigh half."""
    weight = lambda c: 0.5 if c in _SMALL else 1.0
    row = [0.0]
    for c in b:
        row.append(row[-1] + weight(c))
    for x in a:
        above, row = row, [row[0] + weight(x)]
        for k, y in enumerate(b):
            same = 0.0 if x == y else max(weight(x), weight(y))
            row.append(min(above[k] + same, above[k + 1] + weight(x), row[k] + weight(y)))
    return row[-1]


_index: UnitIndex | None = None
_mapped: dict[tuple[str, str], tuple[float, float] | None] = {}
#: Words of the longest known unit, and one more for a slash that stands by itself.
WORDS = 1 + max(len(s.split()) for *_, spellings in UNITS for s in spellings)
#: What can follow a number as its unit: so many words, up to the next mark that no unit has.
_SPELLING = r"\s*+(?:[^\s\d,;()\[\]{}\"«»:]++\s*+){0,%d}((?<=[сc][мm])\^?3)?" % WORDS
_spelling = re.compile(_SPELLING)


def map_unit(base_unit: str, text: str, start: int = 0) -> tuple[float, float] | None:
    """(factor, offset) to base_unit of the unit at a place of a text, or None.

    amount in base_unit = (number + offset) * factor. The longest phrase that is a unit of
    base_unit's dimension counts; what follows it doesn't matter.
    """
    m = _spelling.match(text, start)
    at = (base_unit, m[0])
    if at not in _mapped:
        if len(_mapped) > 200_000:
            _mapped.clear()
        _mapped[at] = _map_unit(base_unit, m[0])
    return _mapped[at]


#: The dimensions of units, in a fixed order.
DIMENSIONS = tuple(dict.fromkeys(u[0] for u in UNITS))
_spellings: dict[str, dict[str, tuple[float, float]]] = {}
_any: dict[str, tuple[int, dict[str, tuple[float, float]]] | None] = {}
_leading = [re.compile(r"\s*(?:\S+\s+){%d}\S+" % (n - 1)) for n in range(1, WORDS + 1)]


def unit_at(text: str, start: int = 0) -> tuple[int, dict[str, tuple[float, float]]] | None:
    """Where the unit at a place of a text ends, and by dimension its factor and offset to the dimension's own unit.

    The longest phrase that is a unit of some dimension counts; None without one.
    """
    m = _spelling.match(text, start)
    if m[0] not in _any:
        if len(_any) > 200_000:
            _any.clear()
        _any[m[0]] = _unit_at(m[0])
    found = _any[m[0]]
    return None if found is None else (start + found[0], found[1])


def _unit_at(phrase: str) -> tuple[int, dict[str, tuple[float, float]]] | None:
    for words in reversed(_leading):
        m = words.match(phrase)
        if m:
            spelling = squeezed(m[0])
            if spelling not in _spellings:
                if len(_spellings) > 200_000:
                    _spellings.clear()
                _spellings[spelling] = _units().find_any(spelling)
            if _spellings[spelling]:
                return m.end(), _spellings[spelling]
    return None


def _units() -> UnitIndex:
    global _index
    _index = _index or UnitIndex()
    return _index


def _map_unit(base_unit: str, text: str) -> tuple[float, float] | None:
    index, base = _units(), squeezed(base_unit)
    dimension = next((d for d in DIMENSIONS if (d, base) in index.exact), None)
    if dimension is None:
        return None
    own = index.exact[(dimension, base)]
    words = squeezed(text).split(" ")
    for n in range(min(WORDS, len(words)), 0, -1):
        found = index.find(dimension, squeezed(" ".join(words[:n])))
        if found:
            factor, offset = found
            return (factor / own[0], offset - own[1] * own[0] / factor)
    return None


def unit_dictionary(spellings: DataFrame) -> DataFrame:
    """base_unit, spelling -> factor, offset; one row for each distinct pair that is a unit."""
    schema = T.StructType([T.StructField("base_unit", T.StringType()), T.StructField("spelling", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(b, s, *f) for b, s in zip(part["base_unit"], part["spelling"]) if (f := map_unit(b, s))]
            yield pd.DataFrame(found, columns=["base_unit", "spelling", "factor", "offset"])

    return spellings.select("base_unit", "spelling").distinct().mapInPandas(run, schema)


# A number: thousands in groups or plain, a decimal part, a power of ten, a multiplying word.
NUMBER = r"(?:\d{1,3}(?:[ ]\d{3})+(?!\d)|\d+)(?:[.,]\d+)?(?:\s*[·×xх*]\s*10\^?\d+)?(?:\s*(?:тыс(?:яч)?|млн)(?!\p{L})\.?)?"
# The text after it up to the next number; the digit of see-through units like см3 belongs to it.
_TAIL = r"(?:[^\d]|(?<=[сc][мm])\^?3(?!\d))*"
#: Words before a number that make it no amount: point, series, "for N analyses" and the like (fixed values).
NOT_AMOUNT = r"(?iu)(?<!\p{L})(?:п\.|пункт\p{L}*|серия|№|no\.?|раздел\p{L}*)\s*\d+(?:\.\d+)*"


def number_value(col: Column) -> Column:
    """Double of a text that NUMBER matches."""
    plain = F.regexp_extract(col, r"^([\d ]+(?:[.,]\d+)?)", 1)
    plain = F.regexp_replace(F.regexp_replace(plain, " ", ""), ",", ".").try_cast("double")
    power = F.regexp_extract(col, r"[·×xх*]\s*10\^?(\d{1,2})(?!\d)", 1).try_cast("double")
    powered = F.when(col.rlike(r"[·×xх*]\s*10\^?\d+"), plain * F.pow(F.lit(10.0), power)).otherwise(plain)
    return powered * F.when(col.contains("тыс"), 1e3).when(col.contains("млн"), 1e6).otherwise(1.0)


def amounts(rows: DataFrame) -> DataFrame:
    """Amount of each row in its base_unit.

    rows: doc_id, row_ord, indicator, value_raw, unit (all in consistent form), base_unit.
    Result: doc_id, row_ord, base_unit, amount double; only rows that state a number and a
    unit. The unit is the one after a number in value_raw, else the unit column's, else the
    one after the indicator's comma or bracket. Several numbers with units are summed;
    numbers without a unit don't count beside them. Nulls state nothing. Amounts of any
    size are told, as doubles.
    """
    key = ["doc_id", "row_ord", "base_unit"]
    base = rows.where(F.col("value_raw").rlike(r"\d")).select(
        *key,
        F.regexp_replace("value_raw", NOT_AMOUNT, " ").alias("text"),
        F.col("unit").alias("own_unit"),
        F.regexp_extract("indicator", r"(?s)[,(\[{](.*)$", 1).alias("tail_unit"),
    )
    # one array of (number, spelling) for each row; the two units without a number ride along under it
    pairs = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?<![\\d.,])({NUMBER}{_TAIL})"), F.lit(1)),
        lambda m: F.struct(F.regexp_extract(m, f"^({NUMBER})", 1).alias("n"), F.regexp_replace(m, f"^{NUMBER}", "").alias("spelling")),
    )
    first = F.regexp_extract("text", f"({NUMBER})", 1)
    rest = F.array(F.struct(first.alias("n"), F.coalesce("own_unit", F.lit("")).alias("spelling")), F.struct(first.alias("n"), F.coalesce("tail_unit", F.lit("")).alias("spelling")))
    sized = base.withColumn("pairs", pairs).withColumn("given", F.size("pairs")).withColumn("pairs", F.concat("pairs", rest))
    mentions = sized.select(*key, "given", F.posexplode("pairs").alias("k", "m")).select(
        *key,
        F.when(F.col("k") < F.col("given"), F.lit(0)).otherwise(F.col("k") - F.col("given") + 1).alias("place"),
        F.col("m.n").alias("n"),
        F.trim(F.regexp_extract(F.lower("m.spelling"), "^" + _SPELLING, 0)).alias("spelling"),
    )
    mentions = written(mentions.where(F.col("spelling").rlike(r"\p{L}")), "mentions")
    found = mentions.join(unit_dictionary(mentions), ["base_unit", "spelling"])
    found = found.withColumn("amount", (number_value(F.col("n")) + F.col("offset")) * F.col("factor"))
    best = found.groupBy(*key).agg(*(F.sum(F.when(F.col("place") == p, F.col("amount"))).alias(f"a{p}") for p in range(3)))
    return best.select(*key, F.coalesce("a0", "a1", "a2").alias("amount"))
