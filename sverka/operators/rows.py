"""Which texts may be values of which indicators, and product names in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions import text as X

# Phrases that no product name holds.
NO_NAME = [
    "ед изм", "единица измерения", "наименование показателя", "содержание показателя", "содержание значение показателя",
    "обоснование использования", "описание объекта закупки", "количество выполняемых", "код ктру", "специфичность",
    "чувствительность", "аналитическая чувствительность", "диагностическая специфичность", "диагностическая чувствительность",
    "время получения результата", "материал для исследования", "интерферирующие вещества", "возможность использования",
    "форма выпуска теста", "состав набора", "проведение исследования", "проведения анализа", "измерен", "показател",
    "значен", "метод", "требован", "формула", "в соответствии с контрактом", "наименование адресата",
    "адрес поставки товара", "срок дата поставки", "на основании контракта", "подпись", "ответственного лица", "телефон",
    "дата время", "заказчика",
]
# Short texts that are no product name, and those that go beside one in a table.
NO_NAME_SHORT = ["набор", "шт", "наличие", "кол во", "количество", "показатели", "показатель", "значение", "да", "нет", "объем", "поставка"]
BESIDE_NAME = ["ед изм", "единица измерения", "ед", "шт", "набор", "комплект", "уп", "упак", "упаковка", "наличие", "да", "нет"]
PRESENT = "^(?:наличие|есть|да|имеется|присутствует)$"
DOMAIN = "ивд|тест|анализ|диагност|кассет|панел|контейнер|полоск"
PRODUCT_WORDS = "ивд|тест|наркот|реагент|издел|анализ|кассет|полоск|панел|контейнер"
NARRATIVE_WORDS = "ивд|тест|наркот|панел|кассет|контейнер|индикатор|полоск"
_LETTER = "[a-zа-яё]"


def name_norm(norm: Column) -> Column:
    """Whether a text of heavy form can be a product name."""
    banned = norm.rlike("|".join(NO_NAME))  # one search: many calls of contains outgrow a compiled method
    return (F.length(norm) >= 3) & ~norm.rlike("^[0-9]+$") & ~banned & ~((F.length(norm) <= 12) & norm.isin(NO_NAME_SHORT))


def could_be_name(col: Column) -> Column:
    return name_norm(X.norm_heavy(col))


def beside_name(col: Column) -> Column:
    """Whether a text is what tables hold beside a product name: a count, a unit, a yes."""
    return beside_norm(X.norm_heavy(col), col)


def beside_norm(n: Column, col: Column) -> Column:
    """The same for a text and its heavy form."""
    code = X.trimmed(col).rlike(r"^\d{2}\.\d{2}\.\d{2}\.\d{3}-\d+$")
    return (n != "") & (n.rlike("^[0-9]+$") | code | n.isin(BESIDE_NAME) | ((F.length(n) <= 14) & n.rlike("шт|набор|ед изм")))


def is_name_column(indicator: Column) -> Column:
    return L.meets(X.norm_heavy(indicator), L.NAME_COLUMN)


def allows_text(indicator: Column) -> Column:
    """Whether values without a number are fine for an indicator."""
    return _allows(X.norm_heavy(indicator), F.lower(indicator))


def _allows(norm: Column, low: Column) -> Column:
    return L.meets(norm, L.NAME_COLUMN) | L.meets(low, L.TEXT_VALUE) | (low.contains("состав") & ~low.contains("код ктру"))


def acceptable(indicator: Column, value: Column) -> Column:
    """Whether a value can belong to an indicator: one with a digit does (in a name column with a letter too),
    a yes, a mark beside a name, or a text of the length its kind of indicator asks for.

    The heavy forms are computed once and bound, else they would stand in every branch.
    """
    forms = F.struct(X.norm_heavy(indicator).alias("n"), F.lower(X.trimmed(indicator)).alias("low"), X.norm_heavy(value).alias("w"), X.trimmed(value).alias("v"), F.lower(value).rlike(_LETTER).alias("worded"))

    def decide(m: Column) -> Column:
        low, v, worded = m["low"], m["v"], m["worded"]
        listed = L.meets(low, [[["выявляем"], ["веществ", "перечень"]]])
        long = low.rlike("состав|комплектац|описание")
        material = L.meets(low, [[["биологич"], ["материал"]], [["материал"], ["исследован"]]])
        return (
            F.when(v.rlike("[0-9]"), worded | ~L.meets(m["n"], L.NAME_COLUMN))
            .when(F.lower(v).rlike(PRESENT) & low.rlike(_LETTER) & (F.length(low) >= 5), True)
            .when(beside_norm(m["w"], v) & name_norm(m["n"]), True)
            .when(~_allows(m["n"], low), False)
            .when(listed, worded & (F.length(v) >= 8))
            .when(long, worded & (F.length(v) >= 20))
            .when(material, worded & (F.length(v) >= 5))
            .otherwise(name_norm(m["w"]))
        )

    return F.coalesce(X.bound(forms, decide), F.lit(False))


def name_candidates(col: Column) -> Column:
    """Heavy forms of a whole text and its parts between ; , | and line breaks that can be product names, each once."""
    parts = F.filter(F.transform(F.split(col, "[;,|\n]+"), X.trimmed), lambda x: x != "")
    return F.concat(F.array(col), parts)


def product_names(rows: DataFrame) -> DataFrame:
    """doc_id, ord, name: the product names of each document.

    rows: doc_id, row_ord (from 0), indicator, value_raw. Told by name columns; if there
    are none, by first columns beside a count or unit among the first 40 rows; else by
    narrative rows among the first 80. The fallbacks are ranked, only the best kind a document has
    is kept. A name once, at its first place.
    """
    forms = F.struct(X.norm_heavy(F.col("indicator")).alias("ind"), X.norm_heavy(F.col("value_raw")).alias("val"), F.col("indicator").alias("i"), F.col("value_raw").alias("v"), F.col("row_ord").alias("p"))

    def pick(m: Column) -> Column:
        ind, place = m["ind"], m["p"]
        named = L.meets(ind, L.NAME_COLUMN) & ~X.trimmed(m["v"]).rlike(r"^[\d.,\s/+-]*$") & name_norm(m["val"])
        head = ind.contains("техническое задание") | ind.contains("объект закупки")
        first = (place < 40) & ~head & ind.rlike(PRODUCT_WORDS) & beside_norm(m["val"], m["v"]) & name_norm(ind)
        told = (place < 80) & (head | ind.contains("предмет закупки"))
        raws = lambda kind, col: F.transform(name_candidates(col), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw")))
        return F.when(named, raws(1, m["v"])).when(first, raws(2, m["i"])).when(told, raws(3, m["v"]))

    picked = rows.select("doc_id", F.col("row_ord").alias("place"), F.posexplode(X.bound(forms, pick)).alias("part", "x"))
    flat = picked.select("doc_id", "place", "part", "x.kind", "x.raw")
    heavy = flat.select("doc_id", "place", "part", "kind", X.norm_heavy(F.col("raw")).alias("name"))
    names = heavy.where(name_norm(F.col("name")) & ((F.col("kind") < 3) | F.col("name").rlike(NARRATIVE_WORDS)))
    best = names.groupBy("doc_id", "kind", "name").agg(F.min(F.struct("place", "part")).alias("ord"))
    least = F.min("kind").over(Window.partitionBy("doc_id"))  # a document's names; a join would look for all names twice
    return best.withColumn("least", least).where("kind = least").select("doc_id", F.col("ord.place").alias("ord"), "name")


def product_codes(col: Column) -> Column:
    """Catalogue codes of a text: letters, then two to five digits, at least four characters, each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(X.java("({b}[a-zа-яё]{1,8}[-_ ]?[a-zа-яё]?[0-9]{2,5}(?:[-_ ]?[0-9]{1,5})?{b})")), F.lit(1))
    codes = F.transform(found, lambda c: F.regexp_replace(c, "[ _]+", "-"))
    return F.array_distinct(F.filter(codes, lambda c: F.length(F.replace(c, F.lit("-"), F.lit(""))) >= 4))


#: What tells of each disease marker.
MARKERS = {"treponema": "treponema|сифил", "hiv": "вич|hiv", "hbv": "hbsag|hbv|гепатит{ws}*в", "hcv": "hcv|гепатит{ws}*с"}


def disease_markers(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(X.java(p)), F.lit(m)) for m, p in MARKERS.items())))


def name_features(name: Column) -> Column:
    """All that comparing needs of a product name, computed once per name: key, words, roots, domain."""
    words = X.name_tokens(name)
    return F.struct(name.alias("key"), words.alias("words"), X.roots(words).alias("roots"), name.rlike(DOMAIN).alias("domain"))


def features_contain(a: Column, b: Column) -> Column:
    """names_contain of the features of two names."""
    ka, kb, ta, tb = a["key"], b["key"], a["words"], b["words"]
    held = ((F.length(ka) >= 14) & kb.contains(ka)) | ((F.length(kb) >= 14) & ka.contains(kb))
    short, long = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    cover = F.size(F.filter(short, lambda t: F.array_contains(long, t))) / F.greatest(F.lit(1), F.size(short))
    rooted = F.arrays_overlap(a["roots"], b["roots"]) & (a["domain"] | b["domain"])
    enough = (F.size(ta) >= 3) & (F.size(tb) >= 3)
    return (F.trim(ka) != "") & (F.trim(kb) != "") & (held | (enough & ((cover >= 0.75) | rooted)))


def names_contain(a: Column, b: Column) -> Column:
    """Whether two product names mean the same: one holds the other, most words are shared, or a root in the domain is."""
    return features_contain(name_features(a), name_features(b))
