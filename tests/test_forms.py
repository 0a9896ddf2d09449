import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sverka.functions import forms


def test_look_alikes_take_the_script_of_unmistakable_letters():
    assert forms.consistent_text("Наимeнование товapa") == "Наименование товара"
    assert forms.consistent_text("nаïve") == "naïve"
    assert forms.consistent_text("Οбъем") == "Объем"


def test_characters():
    assert forms.consistent_text("６０，０ мес​") == "60,0 мес"
    assert forms.consistent_text("й") == "й"
    assert forms.consistent_text("a\tb\n c") == "a\tb\n c"
    assert forms.consistent_text(None) is None
    assert forms.consistent_text("") == ""


def test_preference_settles_open_words():
    assert forms.one_script("Cа", "L") == "Ca"
    assert forms.one_script("Cа", "C") == "Са"


@given(st.text(alphabet="aАеebкК1 ​ é，－", max_size=30))
def test_form_is_stable_and_composed(text):
    once = forms.consistent_text(text)
    assert forms.consistent_text(once) == once
    assert unicodedata.normalize("NFKC", once) == once


def test_column(spark):
    df = spark.createDataFrame([("товaр",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(forms.consistent(F.col("v"))).collect()] == ["товар", None, ""]
