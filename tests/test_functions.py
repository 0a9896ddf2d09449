import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions import numbers as N
from sverka.functions import text as X
from sverka.functions import vectors as V

INF = math.inf


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "numbers"), [("1,5 мл", [1.5]), ("10 20", [1020]), ("1 000", [1000]), ("5-10", [5, -10]), ("1/10/20/25", [1, 10, 20, 25]), ("нет", []), (None, [])])
def test_numbers(spark, text, numbers):
    assert one(spark, text, N.numbers) == numbers


@pytest.mark.parametrize(
    ("text", "ends"),
    [("≤10", (-INF, 10)), ("≥25", (25, INF)), ("от 5 до 10", (5, 10)), ("не менее 5 и не более 9", (5, 9)), ("10-5", (5, 10)), ("5 и более", (5, INF)), ("не более 5", (-INF, 5)), ("не ниже 3", (3, INF)), ("не менее 5", (-INF, 5)), (">= -5", (5, INF)), ("H10-800", (10, 800)), ("сыворотка крови 10 мкл", (10, INF)), ("10 мл", None), (None, None)],
)
def test_ranges(spark, text, ends):
    got = one(spark, text, N.value_range)
    assert (got and tuple(got)) == ends


MATCHES = [
    ("≤10", "10", True, "library within query range"), ("≥25", "1/10/20/25", True, "library within query range"), ("5-9", "4-10", True, "query range inside library range"), ("4-10", "5-9", False, "query range outside library range"),
    ("7", "5-9", True, "query within library range"), ("100", "109", True, "numbers within tolerance"), ("100", "90", False, "numbers differ"), ("1,5", "1.5", True, "numbers within tolerance"), ("есть", "5", False, "digits mismatch"),
    ("Моча", "моча", True, "exact text match"), ("цельная кровь", "кровь; плазма", True, "biological material overlap"), ("красный", "синий", False, "low token overlap"), ("не менее 5", "10", False, "library outside query range"), (None, None, False, "empty values"),
]


def test_values_match(spark):
    df = spark.createDataFrame([(k, q, x) for k, (q, x, *_) in enumerate(MATCHES)], "k int, q string, l string")
    pairs = df.select("k", N.features(F.col("q")).alias("q"), N.features(F.col("l")).alias("l"))
    got = {r["k"]: tuple(r["m"]) for r in pairs.select("k", N.values_match(F.col("q"), F.col("l")).alias("m")).collect()}
    assert got == {k: (m, reason) for k, (_, _, m, reason) in enumerate(MATCHES)}


def test_units_and_clamp(spark):
    df = spark.createDataFrame([("95%", "95"), ("5 нг/мл", "5 ng/ml"), ("5", "6")], "a string, b string")
    assert [r[0] for r in df.select(N.unit_tokens_match(F.col("a"), F.col("b"))).collect()] == [False, True, True]
    assert [one(spark, x, N.clamp01, "double") for x in (INF, None, -1.0, 0.5, 2.0)] == [0, 0, 0, 0.5, 1]


def test_texts(spark):
    assert one(spark, "a  b\r\n\r\n\r\n\r\nc ", X.norm_light) == "a b\n\nc"
    assert one(spark, "Тест  «Н10» – ﬁ", X.norm_heavy) == "тест h10 fi"
    assert one(spark, "&amp;lt;", X.decode_entities) == "&lt;"
    assert one(spark, "<p>a</p><br/>b&nbsp;c", X.strip_html) == "a b c"
    assert one(spark, "Ð¢ÐµÑ\x81Ñ‚".replace("‚", "\x82"), X.repair_latin1) == "Тест"
    assert one(spark, "Größe", X.repair_latin1) == "Größe"
    assert one(spark, "dir/ТЗ на тест-полоски (v2).DOCX", X.safe_extension) == ".docx"
    assert one(spark, "dir/ТЗ на тест-полоски (v2).DOCX", X.filename_hint) == "на тест полоски v2"
    assert one(spark, "a:b:c", X.colon_parts) == ["a", "b"]
    assert tuple(one(spark, "Количество устройств 40 штук", X.label_number)) == ("Количество устройств", "40 штук")
    assert one(spark, "упаковка 40 шт", X.pack_quantity) == 40
    assert one(spark, "a | b |", X.split_delims) == ["a", "b"]
    assert one(spark, '```json\n{"a": {"b": 1}}\n```', X.json_slice) == '{"a": {"b": 1}}'


def chunks(text, size, overlap):
    out, open_ = [], ""
    for p in (x.strip() for x in __import__("re").split(r"\n{2,}", text) if x.strip()):
        joined = f"{open_}\n\n{p}" if open_ else p
        if len(joined) <= size:
            open_ = joined
            continue
        out += [open_] if open_ else []
        open_ = "" if len(p) > size else p
        if len(p) > size:
            out += [p[k : k + size] for k in range(0, len(p), size - overlap)]
    return out + ([open_] if open_ else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=30), max_size=8))
def test_chunks(spark, paragraphs):
    text = "\n\n".join(paragraphs)
    assert one(spark, text, lambda c: X.chunk_text(c, 20, 5)) == chunks(text, 20, 5)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.7071067811865475), 0, None]
    c = spark.createDataFrame([("k", [1.0, 3.0]), ("k", [3.0, 5.0]), ("k", None)], "k string, v array<double>")
    assert V.centroid_vectors(c, "k", "v").first()["centroid"] == [2, 4]
    assert one(spark, "", V.fnv1a) == 2166136261
    assert one(spark, "😀", V.fnv1a) == 3409036472  # two UTF-16 units
    h = 2166136261
    for ch in "тест":
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    assert one(spark, "тест", V.fnv1a) == h


def test_nearest_takes_smaller_ids_at_ties(spark):
    v = spark.createDataFrame([(k, [1.0, float(k % 3)], k % 2) for k in range(12)], "id bigint, v array<double>, g int")
    got = [(r["id"], r["rank"]) for r in V.nearest(v.where("id = 0"), v, 3).orderBy("rank").collect()]
    assert got == [(0, 1), (3, 2), (6, 3)]
    assert V.nearest(v.where("id = 0"), v, 1, group="g").count() == 2
    assert V.nearest(v.limit(0), v, 2).count() == 0


def test_lexicon(spark):
    mask = one(spark, "количество тестов", L.class_mask)
    assert mask == 1
    assert one(spark, "относительная чувствительность", L.category) == "relative_sensitivity_percent"
    assert one(spark, "количество тестов", lambda c: F.arrays_overlap(L.alias_keys(c, "a"), L.alias_keys(F.lit("комплектация"), "b")))
    assert not one(spark, "цвет", lambda c: F.arrays_overlap(L.alias_keys(c, "a"), L.alias_keys(F.lit("комплектация"), "b")))
