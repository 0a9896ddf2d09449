import datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sverka.operators import attributes, packed, units, wide

ROWS = "doc_id string, row_ord int, indicator string, value_raw string, unit string"
SPEC = [("parts", "list", None), ("qty", "integer", None), ("cv", "decimal", None), ("ok", "flag", None), ("day", "date", None), ("code", "code", None), ("vol", "quantity", "мл"), ("temp", "quantity", "°C"), ("time", "quantity", "мин")]
ALIASES = [("parts", "Состав"), ("qty", "Количество"), ("cv", "Вариация"), ("ok", "Стерильно"), ("day", "Дата"), ("code", "Номер"), ("vol", "Объем"), ("temp", "Температура"), ("time", "Время")]


@pytest.fixture
def spec(spark):
    return spark.createDataFrame([(a, a, t, b) for a, t, b in SPEC], "attr_code string, title string, value_type string, base_unit string"), spark.createDataFrame(ALIASES, "attr_code string, alias string")


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("1) Юстар 1,2, 2) Фориз ПК", ["Юстар 1,2", "Фориз ПК"]),
        ('"Юстар 1,2";"модель ""Тавера"" 7"', ["Юстар 1,2", 'модель "Тавера" 7']),
        ("ланцет,калибраторы (0; 5; 50)\tбуфер", ["ланцет", "калибраторы (0; 5; 50)", "буфер"]),
        ('["A-1", "A-2"]', ["A-1", "A-2"]),
        ("морфин / ВИЧ-1/2", ["морфин", "ВИЧ-1/2"]),
        ("{a; b}", ["a", "b"]),
        ("- a\n- b", ["a", "b"]),
        ("a|| b;a|", ["a", "b", "a"]),
        ("моча + мокрота", ["моча", "мокрота"]),
        ('a "b; c', ['a "b', "c"]),
        ('"a\\"; b"; c', ['a"; b', "c"]),
        ("a\\; b", ["a; b"]),
        ("c:\\dir; d", ["c:\\dir", "d"]),
        ("(a; [b; c); d]; e", ["(a; [b; c)", "d]", "e"]),
        ("a) b; (c", ["a) b", "(c"]),
        ("(" * 3000 + "; a", ["(" * 3000, "a"]),
        (";;", []),
        ("", []),
        (None, []),
    ],
)
def test_split_packed(text, items):
    assert packed.split_packed(text) == items


@given(st.lists(st.text(alphabet="абв x", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=2, max_size=8), st.sampled_from([";", "; ", "|", "\n", "\t", ", ", " • "]))
def test_joined_items_come_back(items, mark):
    assert packed.split_packed(mark.join(items)) == items


def test_unpack(spark):
    rows = spark.createDataFrame([("a", 1, "x;y", 5), ("a", 2, None, 5), ("b", 1, "z", 5), ("b", 1, "z", 5)], "doc_id string, row_ord int, value_raw string, pos int")
    got = sorted(tuple(r) for r in packed.unpack(rows).collect())
    assert got == [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 1, "z"), ("b", 1, 1, "z")]
    assert packed.unpack(rows, least=2).count() == 2
    assert packed.unpack(rows.limit(0)).count() == 0
    long = spark.createDataFrame([("a", 1, ";".join(["ab"] * 50_000))], "doc_id string, row_ord int, value_raw string")
    assert packed.unpack(long).count() == 50_000


def test_attribute_rows(spark, spec):
    rows = spark.createDataFrame([("a", 1, " КОЛИЧЕСТВO: ", "1", None, 9), ("a", 2, "Объем, мл (ТЗ)", "2", None, 9), ("a", 3, "Иное", "3", None, 9), ("a", 4, None, "4", None, 9)], ROWS + ", attr_code int")
    got = {r["row_ord"]: r["attr_code"] for r in attributes.attribute_rows(rows, *spec, ["integer", "quantity"]).collect()}
    assert got == {1: "qty", 2: "vol"}


def test_wide(spark, spec):
    values = [("Количество", "1 000 шт"), ("Вариация", "не менее 5,50 %"), ("Стерильно", "-нет-"), ("Дата", "от 06.05.2014 г."), ("Номер", " РУМ 1 "), ("Количество", "2"), ("Количество", "уточняется")]
    rows = spark.createDataFrame([("a", k, i, v, None) for k, (i, v) in enumerate(values)] + [("b", 1, "Дата", "31.02.2020", None)], ROWS)
    kinds = ["integer", "decimal", "flag", "date", "code"]
    stated = attributes.attribute_rows(rows, *spec, kinds)
    columns = wide.discover(stated, spec[0])
    table = wide.widen(stated.union(stated), columns)
    got = {r["doc_id"]: r.asDict() for r in table.collect()}
    assert got["a"] == {"doc_id": "a", "qty": 2, "cv": Decimal("5.5"), "ok": False, "day": datetime.date(2014, 5, 6), "code": "РУМ 1"}
    assert got["b"]["day"] is None
    cells = {(r["doc_id"], r["attr_code"]): r["cell"] for r in wide.cells(table, columns).collect()}
    assert cells == {("a", "qty"): "2", ("a", "cv"): "5.5", ("a", "ok"): "false", ("a", "day"): "2014-05-06", ("a", "code"): "РУМ 1"}
    assert wide.widen(stated.limit(0), columns).count() == 0


@pytest.mark.parametrize(("text", "date"), [("20210616", "2021-06-16"), ("14.4.2017", "2017-04-14"), ("16/09/2022", "2022-09-16"), ("26 ноября 2017 г.", "2017-11-26"), ("2020-05-14", "2020-05-14"), ("н/д", None)])
def test_dates(spark, text, date):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "v string").select(wide.cast_date(F.col("v")).cast("string")).first()[0] == date


def test_units(spark, spec):
    cases = [
        ("Объем", "2,5·10^3 микролитров", None, 2500), ("Объем", "п. 3.1 - 5 мл", None, 5000), ("Объем", "0.015 дл", None, 1500), ("Объем", "2 500", "мкл", 2500),
        ("Объем, куб. см", "8,5", None, 8500), ("Объем", "10 тыс.", "нл", 10), ("Объем", "120см3", None, 120000), ("Объем", "7", None, None), ("Объем", "по запросу", "мл", None),
        ("Температура", "98,6 град. F", None, 37000), ("Температура", "310.15 K", None, 37000), ("Время", "не более 1 ч. 30 мин.", None, 90000), ("Время", "7 мин. и 30 сек", "-", 7500), ("Объем", "3 миллилитр", None, 3000), ("Объем", None, "мл", None),
    ]
    rows = spark.createDataFrame([("a", k, i, v, u) for k, (i, v, u, _) in enumerate(cases)], ROWS)
    got = {r["row_ord"]: round(r["amount"] * 1000) for r in units.amounts(attributes.attribute_rows(rows, *spec, ["quantity"])).collect()}
    assert got == {k: m for k, (*_, m) in enumerate(cases) if m is not None}


def test_fuzzy_units():
    assert units.map_unit("мл", "миллилитру в пробе") == (1.0, 0.0)
    assert units.map_unit("мкл", "анализа") is None
    assert units.map_unit("мл", "нг/мл") is None
    text = "2 нанограмм на миллилитр морфин"
    end, found = units.unit_at(text, 1)
    assert text[end:] == " морфин" and found == {"concentration": (1.0, 0.0)}
    assert units.unit_at("5 тестов", 1) is None and units.unit_at("5", 1) is None
    long = "x" * 200_000
    assert units.unit_at(f"5 мл {long}", 1)[1]["volume"] == (1.0, 0.0) and units.map_unit("мл", long) is None
    assert units.edit_cost("минута", "минуты") == 0.5


def test_extremes_dont_break(spark, spec):
    values = ["9" * 400 + " мл", "1×10^999 мл", "1" * 25, "", None, "мл " * 50_000, "(" * 5000, '"' * 4999, "31.31.9999", "99999999"]
    rows = [(d, o, i, v, u) for d in ("a", None) for o in (1, None) for i in [a for _, a in ALIASES] + [None, ""] for v in values for u in (None, "мл")]
    table = spark.createDataFrame(rows, ROWS)
    assert units.amounts(attributes.attribute_rows(table, *spec, ["quantity"]).distinct()).count() >= 0
    stated = attributes.attribute_rows(table, *spec, ["integer", "decimal", "flag", "date", "code"])
    columns = wide.discover(stated, spec[0])
    assert wide.cells(wide.widen(stated, columns), columns).count() > 0
    assert packed.unpack(attributes.attribute_rows(table, *spec, ["list"])).count() > 0
