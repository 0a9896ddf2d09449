"""Table functions: indicator/value rows out of text, lines, table markup and cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sverka.functions import text as X
from sverka.functions.numbers import as_double
from sverka.operators import rows as R
from sverka.operators.order import next_rows, numbered, running_last, sorted_neighbours

_NG = "(нг/?{ws}*мл|ng/?{ws}*ml)?"
# Patterns over lower-case text, and the indicator each one tells.
PACK = "колич(?:ество)?{ws}*(?:товара|набор(?:а|ов)?|устройств)?{ws}*(?:в{ws}*)?упаков[кч][а-яё]*[\\s\\S]{0,80}?(?:>=|≥|не{ws}*менее|не{ws}*более|=)?{ws}*([0-9]{1,4}){ws}*(?:шт|штук)?{b}"
PACK_BEFORE = "(?:>=|≥|не{ws}*менее|не{ws}*более|=)?{ws}*([0-9]{1,4}){ws}*(?:шт|штук){b}[\\s\\S]{0,80}?колич(?:ество)?{ws}*(?:товара|набор(?:а|ов)?|устройств)?{ws}*(?:в{ws}*)?упаков[кч][а-яё]*"
GAUGE = "(?:игл[аы]|needle)[^0-9]{0,12}([0-9]{1,2}){ws}*g{b}"
ANALYTIC = "аналитическ[а-яё{nws}]*чувствительн[а-яё{nws}]*(?:\\({ws}*концентрац[а-яё{nws}]*\\))?[^0-9]{0,24}([0-9]{1,6}(?:[.,][0-9]+)?){ws}*" + _NG
MINIMUM = "минимальн[а-яё{nws}]*определя[а-яё{nws}]*концентрац[а-яё{nws}]*[^0-9]{0,24}([0-9]{1,6}(?:[.,][0-9]+)?){ws}*" + _NG
COLOURS = ["цветн[а-яё{nws}]*шкал[а-яё{nws}]*содерж[а-яё{nws}]*?([0-9]{1,3}){ws}*цветов[а-яё{nws}]*пол", "колич[а-яё{nws}]*цветов[а-яё{nws}]*пол[а-яё{nws}]*шкал[а-яё{nws}]*(?:определяем[а-яё{nws}]*значени[а-яё{nws}]*ph)?[^0-9]{0,20}([0-9]{1,3})"]
INFECTIONS = [("гепатит B", "гепатит[а-яё{nws}]*в|hbsag|hbv"), ("гепатит C", "гепатит[а-яё{nws}]*с|hcv"), ("ВИЧ 1", "(?:вич|hiv)[-{nws}_/]*1"), ("ВИЧ 2", "(?:вич|hiv)[-{nws}_/]*2|(?:вич|hiv)[-{nws}_/]*1[-{nws},.;:/]*2"), ("сифилис", "сифил|treponema{ws}*pallidum|tp{b}")]
MATERIALS = [("Моча", "(?:^|[{nws},.;:])моч[аеиы]?(?:$|[{nws},.;:])"), ("Слюна", "(?:^|[{nws},.;:])слюн[аеиы]?(?:$|[{nws},.;:])"), ("Плазма крови", "(?:^|[{nws},.;:])плазм[аеиы]?(?:$|[{nws},.;:])"), ("Сыворотка крови", "(?:^|[{nws},.;:])сыворот[кч][аеиы]?(?:$|[{nws},.;:])")]
BLOOD = "(?:^|[{nws},.;:])кров[ьи]?(?:$|[{nws},.;:])"
LABELS = ["назначение", "описание", "определяемые параметры", "исследуемый материал", "состав набора"]
NAME_STOP = "^(?:описани[ея]|назначени[ея]|колич|определя|исследуем|время|материал|наименование показателя|содержание)"


#: A pattern can only be found in a text that holds its lexeme.
HINTS = {PACK: ["колич"], PACK_BEFORE: ["колич"], GAUGE: ["игл", "needle"], ANALYTIC: ["аналитическ"], MINIMUM: ["минимальн"], COLOURS[0]: ["цветн"], COLOURS[1]: ["цветов"]}


def _found(text: str, pattern: str, group: int = 1) -> Column:
    """All matches of a group in lower case; the search only starts where a lexeme of the pattern stands."""

    def search(low: Column) -> Column:
        held = reduce(or_, (low.contains(h) for h in HINTS[pattern]))
        return F.when(held, F.regexp_extract_all(low, F.lit(X.java(pattern)), F.lit(group))).otherwise(F.array().cast("array<string>"))

    return X.bound(F.lower(F.coalesce(F.col(text), F.lit(""))), search)


def _rows(df: DataFrame, key: str, values: Column, indicator: str) -> DataFrame:
    return df.select(key, F.posexplode(F.array_distinct(values)).alias("ord", "value_raw")).select(key, F.lit(indicator).alias("indicator"), "value_raw", "ord")


def pack_quantities(df: DataFrame, key: str, text: str) -> DataFrame:
    """"N шт." for each quantity told after or before the words for the number in a pack."""
    n = F.filter(F.transform(F.concat(_found(text, PACK), _found(text, PACK_BEFORE)), lambda x: x.cast("int")), lambda x: x > 0)
    return _rows(df, key, F.transform(n, lambda x: F.concat(x.cast("string"), F.lit(" шт."))), "Количество в упаковке")


def needle_gauges(df: DataFrame, key: str, text: str) -> DataFrame:
    n = F.filter(F.transform(_found(text, GAUGE), lambda x: x.cast("int")), lambda x: x > 0)
    return _rows(df, key, F.transform(n, lambda x: F.concat(x.cast("string"), F.lit(" G"))), "Размер иглы, G")


def colour_scales(df: DataFrame, key: str, text: str) -> DataFrame:
    """Number of colour fields of a scale; the first match of each of two phrasings."""
    first = F.array_compact(F.array(*(F.get(_found(text, p), 0) for p in COLOURS)))
    n = F.filter(F.transform(first, lambda x: x.cast("int")), lambda x: x > 0)
    return _rows(df, key, n.cast("array<string>"), "Количество цветовых полей на шкале определяемых значений pH, шт")


def sensitivities(df: DataFrame, key: str, text: str) -> DataFrame:
    """Analytical sensitivities with their unit, нг/мл if none is told."""
    out = None
    for indicator, pattern in (("Аналитическая чувствительность (концентрация)", ANALYTIC), ("Минимальная определяемая концентрация", MINIMUM)):
        pairs = F.arrays_zip(F.transform(_found(text, pattern, 1), as_double).alias("n"), _found(text, pattern, 2).alias("u"))
        unit = lambda p: F.when(p["u"] == "", "нг/мл").otherwise(X.replaced(p["u"], "{ws}", ""))
        number = lambda p: F.regexp_replace(p["n"].cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
        values = F.transform(F.filter(pairs, lambda p: p["n"] > 0), lambda p: F.concat(number(p), F.lit(" "), unit(p)))
        part = _rows(df, key, values, indicator)
        out = part if out is None else out.unionByName(part)
    return out


def infections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row that joins the infection markers of a text that names at least two."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.array_compact(F.array(*(F.when(low.rlike(X.java(p)), F.lit(m)) for m, p in INFECTIONS)))
    return df.where(F.size(named) >= 2).select(key, F.lit("Выявление маркеров инфекционных заболеваний").alias("indicator"), F.array_join(named, "; ").alias("value_raw"))


def materials(rows: DataFrame) -> DataFrame:
    """doc_id, value_raw: materials that the rows of a document name; blood only where no urine is mentioned.

    Flags per row and a bool_or per document, so no document's text is gathered.
    """
    low = F.lower(F.concat_ws(" ", F.coalesce("indicator", F.lit("")), F.coalesce("value_raw", F.lit(""))))
    flags = [F.bool_or(low.rlike(X.java(p))).alias(f"m{k}") for k, (_, p) in enumerate(MATERIALS)]
    seen = rows.groupBy("doc_id").agg(*flags, F.bool_or(low.rlike(X.java(BLOOD))).alias("blood"), F.bool_or(low.contains("моч")).alias("urine"))
    told = F.array_compact(F.array(*(F.when(F.col(f"m{k}"), F.lit(m)) for k, (m, _) in enumerate(MATERIALS)), F.when(F.col("blood") & ~F.col("urine"), F.lit("Цельная кровь"))))
    return seen.select("doc_id", F.explode(told).alias("value_raw"))


def doc_lines(rows: DataFrame) -> DataFrame:
    """doc_id, pos, line: the rows of a document as lines of text, indicator and value in turn."""
    pair = F.array(F.struct((F.col("row_ord") * 2).alias("pos"), F.col("indicator").alias("line")), F.struct((F.col("row_ord") * 2 + 1).alias("pos"), F.col("value_raw").alias("line")))
    flat = rows.select("doc_id", F.explode(pair).alias("x")).select("doc_id", "x.*").withColumn("line", X.trimmed(F.coalesce("line", F.lit(""))))
    return flat.where("line <> '' and line <> '\\\\'").distinct()


def label_next_line(lines: DataFrame) -> DataFrame:
    """A line that is one of a few labels, with the line after it as its value."""
    pairs = next_rows(lines.where(F.col("doc_id").isNotNull()), "doc_id", "pos")
    return pairs.where(X.norm_simple(F.col("a.line")).isin(LABELS)).select("a.doc_id", "a.pos", F.col("a.line").alias("indicator"), F.col("b.line").alias("value_raw"))


def names_ahead(lines: DataFrame, ahead: int = 19) -> DataFrame:
    """Lines after one that heads the product name, up to the first stop word or `ahead` lines, that can be a name.

    Running values in the order of the lines instead of a self-join: the last head and the
    last stop before a line tell whether it is still under a head.
    """
    low = F.lower("line")
    placed = numbered(lines.select("doc_id", "pos", "line", low.rlike(X.java("наименование{ws}+товар")).alias("head"), low.rlike(NAME_STOP).alias("stop")), "doc_id", "pos")
    marked = running_last(placed, "doc_id", F.when(F.col("head"), F.col("n")), "h")
    marked = running_last(marked, "doc_id", F.when(F.col("stop"), F.col("n")), "s", current=True)
    under = (F.col("n") - F.col("h") <= ahead) & (F.coalesce("s", F.lit(-1)) <= F.col("h")) & (F.length("line") >= 6)
    return marked.where(under).where(R.could_be_name(F.col("line"))).select("doc_id", "pos", F.col("line").alias("value_raw"))


# ---- producers over whole texts: a text's lines are an array, nothing is shuffled ---------


def _after_heads(text: str, head: str, stop: str, most: int) -> Column:
    """Of every line that is a head the lines after it, at most `most` and up to the first stop line."""

    def under(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda k: F.coalesce(F.lower(F.get(lines, k - 1)).rlike(X.java(head)), F.lit(False)))

        def taken(k: Column) -> Column:
            part = F.slice(lines, k + 1, most)
            at = F.array_position(F.transform(part, lambda x: F.lower(x).rlike(stop)), True)
            return F.slice(part, 1, F.when(at > 0, at - 1).otherwise(most).cast("int"))

        return F.flatten(F.transform(heads, taken))

    return X.bound(X.lines(F.col(text)), under)


def text_names(df: DataFrame, key: str, text: str, ahead: int = 19) -> DataFrame:
    """names_ahead over the lines of whole texts."""
    flat = df.select(key, F.posexplode(F.array_distinct(_after_heads(text, "наименование{ws}+товар", NAME_STOP, ahead))).alias("ord", "value_raw"))
    return flat.where((F.length(X.norm_light(F.col("value_raw"))) >= 6) & R.could_be_name(F.col("value_raw"))).select(key, F.lit("Наименование товара").alias("indicator"), "value_raw", "ord")


# What ends a block of materials, and the words that name materials in texts.
MATERIAL_STOP = "^(?:время|описани[ея]|назначени[ея]|состав|колич|наименование)"
MATERIAL_HEAD = "^исследуем[а-яё{nws}]+материал"
BLOOD_INLINE = "в{ws}+цельн[а-яё{nws}]*кров[аи],?{ws}*сыворот[к0-9a-z_{nws}]*{ws}*(?:или|и){ws}*плазм[а-яё0-9a-z_{nws}]*"


def text_materials(df: DataFrame, key: str, text: str) -> DataFrame:
    """Materials that a text names: in the block under their heading, in a list of blood products, or by urine and saliva."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    block = F.filter(F.transform(_after_heads(text, MATERIAL_HEAD, MATERIAL_STOP, 7), lambda x: X.trimmed(X.replaced(x, "{ws}+", " "))), lambda x: F.lower(x).rlike("моч|слюн|кров|сыворот|плазм"))

    def named(t: Column) -> Column:
        words = [t.contains(w) for w in ("цельн", "кров", "сыворот", "плазм")]
        blood = t.rlike(X.java(BLOOD_INLINE)) | (words[0] & words[1] & words[2] & words[3])
        # word boundaries are of Latin letters and digits, as everywhere in the specification
        urine = t.rlike(X.java("{b}в{ws}+моч[еёи]{b}|{b}моч[аеи]{b}"))
        saliva = t.rlike(X.java("{b}в{ws}+слюн[еы]{b}|{b}слюн[аеи]{b}"))
        told = [(blood, m) for m in ("Цельная кровь", "Сыворотка крови", "Плазма крови")] + [(urine, "Моча"), (saliva, "Слюна")]
        return F.array_compact(F.array(*(F.when(ok, F.lit(m)) for ok, m in told)))

    return _rows(df, key, F.concat(block, X.bound(low, named)), "Исследуемый материал")


# Fixed value: a description, as a text of some length after its word.
DESCRIPTION = "(?:^|[\\t|;,\\n\\r ])описани[ея]{ws}*[:\\-]?{ws}*([^\\n\\r]{20,400})"


def descriptions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Descriptions in a text, in lower case, each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(X.java(DESCRIPTION)), F.lit(1))
    flat = F.filter(F.transform(found, lambda v: X.trimmed(X.replaced(v, "{ws}+", " "))), lambda v: F.length(v) >= 20)
    return _rows(df, key, flat, "Описание")


def analyzers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, analyzer: the analyzers that a text says something is for, each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(X.java(ANALYZER)), F.lit(1))
    flat = df.select(key, F.explode(found).alias("a")).select(key, X.trimmed(F.col("a")).alias("analyzer"))
    return flat.where(F.length("analyzer") >= 2).distinct()


#: Fixed value: what follows the words "for" or "to an analyzer".
ANALYZER = "(?:для|к){ws}+анализатор[а-яё]*{ws}+([^.;,\\n]{2,120})"
#: Fixed value: lines that head a column and are no value of a label.
NO_VALUE = r"^(?:наименование|значение|ед\.?\s*изм|количество|№|п/п)$"


def text_labels(df: DataFrame, key: str, text: str) -> DataFrame:
    """A line that is one of a few labels with the next line as its value, if that is acceptable."""
    pairs = X.bound(X.lines(F.col(text)), lambda ls: F.arrays_zip(F.slice(ls, 1, F.greatest(F.size(ls) - 1, F.lit(0))).alias("a"), F.slice(ls, 2, F.size(ls)).alias("b")))
    flat = df.select(key, F.posexplode(pairs).alias("ord", "p")).select(key, "ord", F.col("p.a").alias("indicator"), F.col("p.b").alias("value_raw"))
    fine = X.norm_simple(F.col("indicator")).isin(LABELS) & ~F.lower("value_raw").rlike(NO_VALUE)
    return flat.where(fine).where(R.acceptable(F.col("indicator"), F.col("value_raw"))).select(key, "indicator", "value_raw", "ord")


def carry_forward(cells: DataFrame) -> DataFrame:
    """doc_id, pos, indicator, value_raw: a row without a value takes the indicator of the last row that had one."""
    full = F.length(F.coalesce("value", F.lit(""))) >= 2
    held = running_last(numbered(cells.select("doc_id", "pos", "first", "value"), "doc_id", "pos"), "doc_id", F.when(full, F.col("first")), "last")
    alone = ~full & F.col("last").isNotNull()
    return held.select("doc_id", "pos", F.when(alone, F.col("last")).otherwise(F.col("first")).alias("indicator"), F.when(alone, F.concat_ws(" \n ", F.col("first"), F.nullif("value", F.lit("")))).otherwise(F.col("value")).alias("value_raw"))


def union_first(parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Union of producers' rows (key, indicator, value_raw, ord), each pair once, by the first producer that tells it."""
    out = None
    for k, part in enumerate(parts):
        one = part.select(key, "indicator", "value_raw", F.struct(F.lit(k).alias("producer"), F.col("ord").cast("bigint").alias("ord")).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key, "indicator", "value_raw").agg(F.min("place").alias("place")).select(key, "indicator", "value_raw", "place.producer", "place.ord")


def html_table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """doc_id, pos, first, value of each table row of markup: its first cell and the others joined."""
    trs = df.select(F.col(key).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<tr.*?</tr>)"), F.lit(1))).alias("pos", "tr"))
    cells = F.filter(F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)(<t[dh][^>]*>.*?</t[dh]>)"), F.lit(1)), X.strip_html), lambda c: (c != "") & (c != "\\"))
    return trs.withColumn("cells", cells).where(F.size("cells") > 0).select("doc_id", "pos", F.get("cells", 0).alias("first"), F.array_join(F.slice("cells", 2, F.size("cells")), " \n ").alias("value"))


def word_table_rows(df: DataFrame, key: str, xml: str) -> DataFrame:
    """The same of word-processor markup: rows end with a table row mark, cells with a cell mark."""
    s = F.col(xml)
    for pattern, by in ((r"(?i)<w:tab/>", "\t"), (r"(?i)<w:br[^>]*/>", "\n"), (r"(?i)</w:p>", " "), (r"(?i)</w:tc>", " | "), (r"(?i)</w:tr>", "\n"), ("<[^>]+>", " "), ("[ \t\r\f\\x0B]+", " ")):
        s = F.regexp_replace(s, pattern, by)
    flat = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(X.decode_entities(s), "\n")).alias("pos", "line")).where(F.col("line").contains("|"))
    cells = F.filter(F.transform(F.split("line", r"\|"), X.trimmed), lambda c: (c != "") & (c != "\\"))
    return flat.withColumn("cells", cells).where(F.size("cells") > 0).select("doc_id", "pos", F.get("cells", 0).alias("first"), F.array_join(F.slice("cells", 2, F.size("cells")), " \n ").alias("value"))


#: Tokens that say yes, and texts that are no indicator.
YES = "^(?:наличие|есть|имеется|да)$"
NO_INDICATOR = "инструкция|значение характеристики|участник закупки|наименование заказчика"


def presence_pairs(tokens: DataFrame, back: int = 4) -> DataFrame:
    """doc_id, pos, indicator, value_raw: a token that says yes with the nearest of the `back` tokens before it that can be its indicator.

    tokens: doc_id, pos, line.
    """
    near = sorted_neighbours(tokens.select("doc_id", "pos", "line"), back, "doc_id", "pos").where("a.doc_id = b.doc_id")
    yes = near.where(F.lower("b.line").rlike(YES) & ~F.lower("a.line").rlike(NO_INDICATOR))
    fit = yes.select(F.col("b.doc_id").alias("doc_id"), F.col("b.pos").alias("pos"), F.col("b.line").alias("value_raw"), F.col("a.pos").alias("at"), F.col("a.line").alias("indicator"))
    fit = fit.where(R.acceptable(F.col("indicator"), F.col("value_raw")))
    return fit.groupBy("doc_id", "pos", "value_raw").agg(F.max_by("indicator", "at").alias("indicator")).select("doc_id", "pos", "indicator", "value_raw")


def word_tokens(df: DataFrame, key: str, xml: str) -> DataFrame:
    """doc_id, pos, line: the text runs of word-processor markup in order."""
    runs = F.transform(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), lambda t: X.decode_entities(X.trimmed(X.replaced(t, "{ws}+", " "))))
    flat = df.select(F.col(key).alias("doc_id"), F.posexplode(runs).alias("pos", "line"))
    return flat.where("line <> '' and line <> '\\\\'")


def purposes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that say what a product is meant for."""
    flat = df.select(key, F.posexplode(X.lines(F.col(text))).alias("ord", "value_raw"))
    low = F.lower("value_raw")
    told = (F.length("value_raw") >= 20) & low.rlike("предназначен") & F.col("value_raw").rlike("анализатор|визуал|моч[аи]|тест|полоск|использован")
    return flat.where(told & ~low.rlike("^(?:описани[ея]|наименование товара|колич|время|состав|хранить)")).select(key, F.lit("Назначение").alias("indicator"), "value_raw", "ord")


#: Producers of each kind of document, in the order in which they tell a row first.
PRODUCERS = {
    "doc": [pack_quantities, text_names, purposes, text_materials, infections, descriptions, text_labels, colour_scales, sensitivities, needle_gauges],
    "pdf": [text_materials, sensitivities, needle_gauges],
}


def document_rows(df: DataFrame, key: str, text: str, kind: str = "doc") -> DataFrame:
    """key, indicator, value_raw, producer, ord: all that a document's text tells, each pair once.

    First the line automaton, then the producers of its kind in their order, last the
    materials that the rows found name.
    """
    parts = [guess_rows(df, key, text)]
    for produce in PRODUCERS[kind]:
        part = produce(df, key, text)
        parts.append(part if "ord" in part.columns else part.withColumn("ord", F.lit(0)))
    told = union_first(parts, key)
    named = materials(told.select(F.col(key).alias("doc_id"), "indicator", "value_raw")).select(F.col("doc_id").alias(key), F.lit("Исследуемый материал").alias("indicator"), "value_raw", F.lit(len(parts)).alias("producer"), F.lit(0).cast("bigint").alias("ord"))
    new = named.join(told.select(key, "indicator", "value_raw"), [key, "indicator", "value_raw"], "left_anti")
    return told.unionByName(new)


# A quantity and a volume or length inside a text without marks: (label)(number)(unit).
BLOB_QUANTITY = "(колич[а-яёa-z{nws}]{0,40})([0-9]{1,4}){ws}*(шт|штук)"
BLOB_VOLUME = "(об[ъь]?[её]м[а-яёa-z{nws}]{0,30})([0-9]{1,4}(?:[.,][0-9]+)?){ws}*(мл|мм|см|мкм|г)"


def blob_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, indicator, value_raw: the first quantity and the first volume that stand inside a text, in its own letter case."""
    out = None
    for k, pattern in enumerate((BLOB_QUANTITY, BLOB_VOLUME)):
        whole = "(?iu)" + X.java(pattern)
        label, number, unit = (F.regexp_extract(F.coalesce(F.col(text), F.lit("")), whole, g) for g in (1, 2, 3))
        part = df.select(key, F.lit(k).alias("ord"), X.trimmed(label).alias("indicator"), F.concat_ws(" ", number, unit).alias("value_raw")).where("indicator <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def spec_blob(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, indicator, value_raw of the parts between semicolons and line breaks: "label: value" or "label 40 units"."""
    parts = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "[;\n\r]+")).alias("ord", "raw")).withColumn("part", X.trimmed(F.col("raw")))
    at = F.instr("part", ":")
    left, right = X.trimmed(F.substring("part", F.lit(1), at - 1)), X.trimmed(F.substring("part", at + 1, F.length("part")))
    coloned = (at > 1) & (at <= 120) & (left != "") & (right != "")
    pair = F.when(coloned, F.struct(left.alias("label"), right.alias("value"))).otherwise(X.label_number(F.col("part")))
    return parts.withColumn("pair", pair).where("pair is not null").select(key, "ord", F.col("pair.label").alias("indicator"), F.col("pair.value").alias("value_raw"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """doc_id, ord, indicator, value_raw of sheet rows (doc_id, row, cells): columns A and B, C and E, wide rows of a numbered list.

    A wide row (an ordinal in A) tells the product name in B and its specifications from C
    on; a row without A whose B is a long text tells what the text does. A document of which
    nothing is told so is read as lines of cells by the automaton. A pair must be acceptable.
    """
    raw = lambda k: F.coalesce(F.get("cells", k), F.lit(""))
    c = lambda k: X.norm_light(raw(k))
    wide = F.regexp_replace(raw(0), r"\s", "").rlike(r"^\d{1,4}$") & (F.size("cells") >= 3)
    pairs = F.array_compact(
        F.array(
            F.when(wide & (F.length(c(1)) > 20), F.struct(F.lit("Наименование товара").alias("indicator"), c(1).alias("value_raw"))),
            F.when(~wide & (c(0) != "") & (c(1) != ""), F.struct(c(0).alias("indicator"), c(1).alias("value_raw"))),
            F.when(~wide & (c(2) != "") & (c(4) != ""), F.struct(c(2).alias("indicator"), c(4).alias("value_raw"))),
        )
    )
    direct = cells.select("doc_id", F.col("row").alias("ord"), F.explode(pairs).alias("p")).select("doc_id", "ord", "p.*")
    long = (X.trimmed(raw(0)) == "") & (F.length(raw(1)) > 400)
    blobs = cells.where(wide).select("doc_id", F.col("row").alias("place"), F.explode(F.slice("cells", 3, F.size("cells"))).alias("blob")).where(F.length(F.trim("blob")) > 1)
    blobs = blobs.unionByName(cells.where(long).select("doc_id", F.col("row").alias("place"), raw(1).alias("blob"))).withColumn("k", F.struct("doc_id", "place"))
    specs = spec_blob(blobs, "k", "blob").drop("ord").unionByName(blob_numbers(blobs, "k", "blob").drop("ord"))
    told = cells.where(long).select(F.struct("doc_id", F.col("row").alias("place")).alias("k"), raw(1).alias("blob"))
    specs = specs.unionByName(guess_rows(told, "k", "blob").drop("ord"))
    out = direct.unionByName(specs.select("k.doc_id", F.col("k.place").alias("ord"), "indicator", "value_raw"))
    out = out.where(R.acceptable(F.col("indicator"), F.col("value_raw")))
    line = F.array_join(F.filter("cells", lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    rest = cells.join(out.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "row", line.alias("line")).where("line <> ''")
    whole = rest.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))  # one file's lines
    return out.unionByName(guess_rows(whole, "doc_id", "text"))


# ---- the line-pairing automaton -------------------------------------------------------

_HEADS = {"наименование", "значение", "показатель", "показатели"}
_digits = re.compile("[0-9]")


def pair_lines(lines: list[str], acceptable, allows_text, could_be_name, most: int | None = None) -> list[tuple[str, str]]:
    """Indicator/value pairs of the lines of a text, in order.

    An open indicator waits for a line with a digit, or for a text where its kind allows
    one. A line of cells or "label: value" is a pair by itself. Lines that head a table are
    skipped; a line that is only a heading word drops the open indicator.
    """
    out: list[tuple[str, str]] = []
    waiting: str | None = None
    for line in lines:
        if most is not None and len(out) >= most:
            break
        low, digit = line.lower(), bool(_digits.search(line))
        if "наименование" in low and "знач" in low:
            continue
        if low in _HEADS:
            waiting = None
            continue
        if waiting and not digit and allows_text(waiting) and acceptable(waiting, line):
            out.append((waiting, line))
            waiting = None
            continue
        parts = _cells(line)
        if not parts and ":" in line:
            label, value = (x.strip() for x in line.split(":")[:2])
            if label and value and acceptable(label, value):
                parts = [label, value]
        if len(parts) >= 2:
            value = " ".join(parts[1:]).strip()
            if value and acceptable(parts[0], value):
                out.append((parts[0], value))
                waiting = None
        elif digit and waiting:
            if acceptable(waiting, line):
                out.append((waiting, line))
                waiting = None
        elif not digit and len(line) >= 3 and line.strip("-–—_") and not (waiting and allows_text(waiting) and not could_be_name(line)):
            waiting = line
    return out


def _cells(line: str) -> list[str]:
    for mark in ("|", "\t"):
        if mark in line:
            return [x.strip() for x in line.split(mark) if x.strip()]
    parts = [x.strip() for x in re.split(" {2,}", line) if x.strip()]
    return parts if len(parts) >= 2 else []


def _heavy(text: str) -> str:
    import unicodedata

    s = unicodedata.normalize("NFKC", text).lower()
    s = re.sub("[“”\"'﻿​-‍⁠]", "", s)
    return re.sub("[^a-z0-9а-яё]+", " ", re.sub("н(?=[0-9])", "h", s)).strip()


class LineRules:
    """The row predicates for single strings, as pair_lines needs them."""

    _banned = re.compile("|".join(R.NO_NAME))

    def could_be_name(self, text: str) -> bool:
        n = _heavy(text)
        return len(n) >= 3 and not n.isdigit() and not self._banned.search(n) and not (len(n) <= 12 and n in R.NO_NAME_SHORT)

    def is_name_column(self, indicator: str) -> bool:
        n = _heavy(indicator)
        return "наименование товара" in n or "наименование изделия" in n or ("наименование" in n and ("товар" in n or "товра" in n))

    def allows_text(self, indicator: str) -> bool:
        low = indicator.lower()
        listed = "выявляем" in low and ("веществ" in low or "перечень" in low)
        worded = any(w in low for w in ("назначение", "комплектац", "описание")) or ("состав" in low and "код ктру" not in low)
        return self.is_name_column(indicator) or listed or worded or ("материал" in low and ("биологич" in low or "исследован" in low))

    def beside_name(self, text: str) -> bool:
        n = _heavy(text)
        return bool(n) and (n.isdigit() or n in R.BESIDE_NAME or (len(n) <= 14 and any(w in n for w in ("шт", "набор", "ед изм"))))

    def acceptable(self, indicator: str, value: str) -> bool:
        letters = bool(re.search(R._LETTER, value.lower()))
        if _digits.search(value):
            return letters or not self.is_name_column(indicator)
        v, low = value.strip(), indicator.lower()
        if re.fullmatch(R.PRESENT.strip("^$"), v.lower()) and re.search(R._LETTER, low) and len(indicator.strip()) >= 5:
            return True
        if self.could_be_name(indicator) and self.beside_name(value):
            return True
        if not self.allows_text(indicator):
            return False
        if "выявляем" in low and ("веществ" in low or "перечень" in low):
            return letters and len(v) >= 8
        if any(w in low for w in ("состав", "комплектац", "описание")):
            return letters and len(v) >= 20
        if "материал" in low and ("биологич" in low or "исследован" in low):
            return letters and len(v) >= 5
        return self.could_be_name(value)


def guess_rows(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, ord, indicator, value_raw: pairs of lines of each text by the automaton; its state can't be told by window functions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = LineRules()
        for part in parts:
            got = [(k, n, a, b) for k, t in zip(part[key], part[text]) if t for n, (a, b) in enumerate(pair_lines([x for x in (y.strip() for y in re.sub(r"[ \t]{2,}", " ", t).split("\n")) if x], rules.acceptable, rules.allows_text, rules.could_be_name, most))]
            yield pd.DataFrame(got, columns=[key, "ord", "indicator", "value_raw"]).astype({"ord": "int32"})

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ord int, indicator string, value_raw string")
