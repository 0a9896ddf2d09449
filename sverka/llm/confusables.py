"""Visually identical text with different characters, brought to one consistent form.

The skeleton of a text is what it looks like: decomposed, every character replaced by its
prototype from the look-alike table, decomposed again. Originals of equal skeleton form a
group and look the same. The words that mix scripts are grouped with all words of the
corpus by skeleton, and the group gives their form: its spelling in the script that the
word's unmistakable letters show, or, where it has none, in the script the group is most
used in. The table is the one of Unicode's security mechanisms, as the ICU library that
comes with Spark holds it; it is a parameter everywhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sverka.functions import forms
from sverka.session import written

#: Character (as a number) -> what it looks like.
Table = dict[int, str]
#: Forms of so many different words are sent to the workers; if there are more, they are joined.
MOST_SENT = 200_000
#: Different words that a task holds before it passes their counts on.
HELD = 300_000
_word = re.compile(r"[^\W\d_]+")
_latin, _cyrillic = r"A-Za-zÀ-ÖØ-öø-ɏ", r"Ѐ-ԯ"
#: Letters of two scripts side by side: whatever doesn't hold this has no word of two scripts.
_mixed = re.compile(rf"[{_latin}][^\W\d_{_latin}]|[^\W\d_{_latin}][{_latin}]|[{_cyrillic}][^\W\d_{_cyrillic}]|[^\W\d_{_cyrillic}][{_cyrillic}]")
# Pairs that the Unicode table keeps apart but the texts here mix; fixed values of forms.
_EXTRA = dict(zip(map(ord, forms.GREEK_LOOK), forms.GREEK_AS_LATIN))


@lru_cache(maxsize=1)
def _unicode_table(_jvm) -> Table:
    """The look-alike table of the ICU library in the driver's JVM: one skeleton of all characters, one a line."""
    chars = [chr(c) for c in (*range(0x21, 0xD800), *range(0xF900, 0xFFFE), *range(0x10000, 0x11000), *range(0x1D400, 0x1F200)) if unicodedata.category(chr(c))[0] in "LMNPS"]
    looks = _jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(chars)).split("\n")
    table = {ord(c): look for c, look in zip(chars, looks) if look and look != c and not unicodedata.combining(c)}
    return {c: look for c, look in _EXTRA.items() if c not in table} | table


def look_alikes(spark: SparkSession) -> Table:
    """Unicode's table of look-alikes (a few thousand entries, many to one and one to many)."""
    return _unicode_table(spark.sparkContext._jvm)


def skeleton(text: str | None, table: Table) -> str | None:
    """What a text looks like; null stays null, an empty text empty."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", forms.plain_characters(text))
    return unicodedata.normalize("NFKD", plain.translate(table))


def long_fields(df: DataFrame, table_name: str, key: str, order: str, columns: list[str]) -> DataFrame:
    """table_name, doc_id, ord, col_name, text: one row per field; null fields are left out."""
    fields = F.array(*(F.struct(F.lit(c).alias("col_name"), F.col(c).alias("text")) for c in columns))
    long = df.select(F.lit(table_name).alias("table_name"), F.col(key).alias("doc_id"), F.col(order).cast("int").alias("ord"), F.explode(fields).alias("f"))
    return long.select("table_name", "doc_id", "ord", "f.col_name", "f.text").where("text is not null")


def mixed_words(text: str) -> list[str]:
    """The different words of two scripts of a text in plain characters."""
    plain = forms.plain_characters(text)
    return sorted({w for w in _word.findall(plain) if len(forms.scripts(w)) > 1}) if _mixed.search(plain) else []


def word_groups(fields: DataFrame, wanted: DataFrame, table: Table) -> DataFrame:
    """skeleton, script (L or C), spelling, n: the most used spelling of one script of each wanted skeleton.

    Words of all fields are grouped by skeleton; only single-script originals give a form.
    At a tie of use the least spelling counts. Each task adds up its words first.
    """
    shared = fields.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in count if len(s := forms.scripts(w)) == 1 and s <= {"L", "C"}]
            looks = [unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", w).translate(shared.value)) for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(looks, pa.string()), pa.array([forms.script(w[0]) for w in words], pa.string()), pa.array(words, pa.string()), pa.array([count[w] for w in words], pa.int64())], names=["skeleton", "script", "spelling", "n"])
            count.clear()
            return out

        for batch in batches:
            for text, times in Counter(batch.column(0).to_pylist()).items():
                for w in _word.findall(text):
                    count[w] += times
            if len(count) > HELD:
                yield flush()
        yield flush()

    own = fields.select("text").mapInArrow(run, "skeleton string, script string, spelling string, n bigint")
    near = own.join(wanted.select("skeleton").distinct(), "skeleton", "left_semi").groupBy("skeleton", "script", "spelling").agg(F.sum("n").alias("n"))
    return near.groupBy("skeleton", "script").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling")).alias("m"), F.sum("n").alias("n")).select("skeleton", "script", F.col("m.spelling").alias("spelling"), "n")


def form_of(word: str, group: dict[str, tuple[str, int]]) -> str:
    """Form of a word of two scripts from its group: script -> (spelling, uses); without a fitting spelling by its own letters.

    The group's spelling must keep every letter that is in its script already.
    """
    used = sorted(group, key=lambda s: (-group[s][1], s))
    sure = {s for c in word if c not in forms.LATIN_LOOK and c not in forms.CYRILLIC_LOOK and (s := forms.script(c)) in "LC"}
    for s in used if not sure else [s for s in used if sure == {s}]:
        spelling = group[s][0]
        if len(spelling) == len(word) and all(a == b or forms.script(a) != s for a, b in zip(word, spelling)):
            return spelling
    return forms.one_script(word, used[0] if used else None)


def word_forms(words: DataFrame, fields: DataFrame, table: Table) -> DataFrame:
    """w, form of different words of two scripts, each by its skeleton's group."""
    shared = fields.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(w, shared.value) for w in batch.column(0).to_pylist()], pa.string())], names=["w", "skeleton"])

    asked = words.mapInArrow(look, "w string, skeleton string")
    groups = word_groups(fields, asked, table).groupBy("skeleton").agg(F.collect_list(F.struct("script", "spelling", "n")).alias("spellings"))  # one a script

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            group = [{g["script"]: (g["spelling"], g["n"]) for g in x} if x is not None else {} for x in part["spellings"]]
            yield pd.DataFrame({"w": part["w"], "form": [form_of(w, g) for w, g in zip(part["w"], group)]})

    return asked.join(groups, "skeleton", "left").select("w", "spellings").mapInPandas(settle, "w string, form string")


def consistent_fields(fields: DataFrame, table: Table | None = None) -> DataFrame:
    """table_name, doc_id, ord, col_name, text, form of the fields that differ from their consistent form.

    Repeated rows count once. Empty texts stay empty, texts of any length are read whole.
    Other columns of fields are dropped. Words of two scripts take the form of their
    skeleton's group in all fields.
    """
    spark = fields.sparkSession
    table = look_alikes(spark) if table is None else table
    key = ["table_name", "doc_id", "ord", "col_name", "text"]
    kinds = ", ".join(f"{n} {fields.schema[n].dataType.simpleString()}" for n in key)

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(4).to_pylist()
            at = [k for k, t in enumerate(texts) if forms.is_suspect(t)]
            words = [mixed_words(texts[k]) for k in at]
            kept = [i for i, k in enumerate(at) if words[i] or forms.plain_characters(texts[k]) != texts[k]]
            rows = part.take(pa.array([at[i] for i in kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([words[i] for i in kept], pa.list_(pa.string()))], names=[*key, "words"])

    odd = written(fields.select(*key).mapInArrow(found, f"{kinds}, words array<string>"), "odd-fields")
    words = odd.select(F.explode("words").alias("w")).distinct()
    settled = written(word_forms(words, fields, table), "word-forms")

    def form(text: str, known: dict[str, str]) -> str:
        return _word.sub(lambda m: known.get(m[0], m[0]), forms.plain_characters(text))

    def finish(parts: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            done = [form(t, x) for t, x in zip(texts, told(part))]
            at = [k for k, f in enumerate(done) if f != texts[k]]
            yield pa.RecordBatch.from_arrays([*(part.column(n).take(pa.array(at, pa.int64())) for n in key), pa.array([done[k] for k in at], pa.string())], names=[*key, "form"])

    if settled.count() <= MOST_SENT:
        known = spark.sparkContext.broadcast({r["w"]: r["form"] for r in settled.toLocalIterator()})  # checked: at most MOST_SENT words
        out = odd.drop("words").mapInArrow(lambda parts: finish(parts, lambda part: [known.value] * part.num_rows), f"{kinds}, form string")
    else:
        asked = odd.where(F.size("words") > 0).distinct().select(*key, F.explode("words").alias("w")).join(settled, "w")
        told = asked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("w", "form"))).alias("told")).unionByName(odd.where(F.size("words") == 0).select(*key, F.lit(None).cast("map<string,string>").alias("told")))
        out = told.mapInArrow(lambda parts: finish(parts, lambda part: [dict(x or ()) for x in part.column("told").to_pylist()]), f"{kinds}, form string")
    return out.distinct()


def skeleton_groups(fields: DataFrame, table: Table | None = None) -> DataFrame:
    """Groups of texts that look the same though their characters differ.

    col_name, skeleton, form, n_texts (different spellings, 2 or more), n_fields. The
    form is that of the most frequent spelling, the smallest one at a tie. Skeletons are
    computed once per distinct text.
    """
    spark = fields.sparkSession
    shared = spark.sparkContext.broadcast(look_alikes(spark) if table is None else table)

    @F.pandas_udf(T.StringType())
    def look(values: pd.Series) -> pd.Series:
        return values.map(lambda t: skeleton(t, shared.value), na_action="ignore")

    texts = fields.groupBy("col_name", "text").agg(F.count("*").alias("n")).withColumn("skeleton", look(F.col("text")))
    groups = texts.groupBy("col_name", "skeleton").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_fields"), F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("most"))
    found = groups.where("n_texts > 1")
    return found.select("col_name", "skeleton", forms.consistent(F.col("most.text")).alias("form"), "n_texts", "n_fields")
