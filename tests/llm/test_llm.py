import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sverka.llm import confusables, grades, listings, mixture, mojibake, neighbours, tokens

# ---- nearest vectors -------------------------------------------------------------------


def brute(items, k):
    names = sorted(items)
    v = np.array([items[n] for n in names])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -9)
    return {(n, names[j]) for i, n in enumerate(names) for j in np.argsort(-s[i], kind="stable")[: min(k, len(names) - 1)]}


def near(spark, items, **more):
    df = spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None) for k, v in items], "key string, e array<double>")
    from pyspark.sql import functions as F

    return [(r["key"], r["near_key"]) for r in neighbours.neighbour_pairs(neighbours.vectors_of(df, "x", F.col("key"), "e", more.get("dim", 8)), **more).collect()]


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    items = {f"k{n}": rng.normal(size=8) for n in range(1500)}
    want, got = brute(items, 5), near(spark, items.items(), k=5, dim=8, shard=300)
    assert len(want & set(got)) / len(want) > 0.95
    assert len(got) == len(set(got))


def test_walks_against_the_exact_mode(spark):
    """Recall of the walks at two sizes, with one shard and with many; no answer is read off the graph."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    for n, shard in ((1200, 5000), (4000, 600)):
        items = {f"k{k:05}": centres[k % 40] + 0.6 * rng.normal(size=16) for k in range(n)}
        want = set(near(spark, items.items(), k=5, dim=16, shard=shard, probes=None))
        assert len(want & brute(items, 5)) / len(want) > 0.999  # vectors are held in single precision
        got = set(near(spark, items.items(), k=5, dim=16, shard=shard))
        assert len(want & got) / len(want) > 0.95


def test_inserted_graph_is_searched_by_walks():
    rng = np.random.default_rng(4)
    v = neighbours.unit_rows(rng.normal(size=(3000, 16)))
    g = neighbours.Graph.build(v)
    links = g.layers[0][1]
    assert len(g.layers) > 1 and (links[:, 0] >= 0).all() and (links != np.arange(3000)[:, None]).all()
    q = neighbours.unit_rows(rng.normal(size=(500, 16)))
    want, got = g.exact(q, 5)[0], g.search(q, 5, beam=16)[0]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(want, got)]) / 5 > 0.9


def test_many_centroids_are_fitted_in_two_levels(monkeypatch):
    monkeypatch.setattr(neighbours, "ONE_LEVEL", 10)
    rng = np.random.default_rng(6)
    sample = neighbours.unit_rows(rng.normal(size=(2000, 8)))
    c = neighbours.fit_centroids(sample, 60)
    home, sims = neighbours.nearest_centroid(sample, c)
    assert 40 <= len(c) <= 80 and np.bincount(home, minlength=len(c)).max() < 200 and sims.mean() > 0.7


def test_nearest_vectors_of_odd_tables(spark):
    v = [1.0, 2, 3, 4, 5, 6, 7, 8]
    items = [("a", v), ("a", v), ("b", [2 * x for x in v]), ("c", None), ("d", [0.0] * 8), ("e", [1.0] * 4), ("f", [math.nan] * 8), ("g", [-x for x in v])]
    assert set(near(spark, items, k=5, dim=8)) == {("a", "b"), ("a", "g"), ("b", "a"), ("b", "g"), ("g", "a"), ("g", "b")}
    assert near(spark, [], k=5, dim=8) == []
    assert near(spark, [("a", v)], k=5, dim=8) == []


def test_many_copies_of_one_vector(spark):
    v = [1.0] + [0.0] * 7
    items = [(f"c{n:03}", v) for n in range(300)] + [("z", [0.0, 1.0] + [0.0] * 6)]
    got = near(spark, items, k=3, dim=8)
    by = {}
    for a, b in got:
        by.setdefault(a, set()).add(b)
    assert by["c200"] == {"c000", "c001", "c002"} and by["c001"] == {"c000", "c002", "c003"} and by["z"] == {"c000", "c001", "c002"}
    assert len(by) == 301


def test_copies_spread_over_batches(spark):
    from pyspark.sql import functions as F

    v = [1.0] + [0.0] * 7
    items = [(f"c{n:02}", v) for n in range(20) for _ in range(2)] + [("z", [0.0, 1.0] + [0.0] * 6)]
    df = spark.createDataFrame(items, "key string, e array<double>").repartition(20)
    by = {}
    for r in neighbours.neighbour_pairs(neighbours.vectors_of(df, "x", F.col("key"), "e", 8), k=5, dim=8).collect():
        by.setdefault(r["key"], set()).add(r["near_key"])
    least = [f"c{n:02}" for n in range(6)]
    assert by == {f"c{n:02}": set([x for x in least if x != f"c{n:02}"][:5]) for n in range(20)} | {"z": set(least[:5])}


def test_copies_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    v = [1.0] + [0.0] * 7
    df = spark.createDataFrame([("a", v)] * 12 + [("b", v), ("z", [0.0, 1.0] + [0.0] * 6)], "key string, e array<double>").coalesce(1)
    got = neighbours.neighbour_pairs(neighbours.vectors_of(df, "x", F.col("key"), "e", 8), k=3, dim=8).collect()
    assert {("a", "b"), ("b", "a"), ("z", "a"), ("z", "b")} <= {(r["key"], r["near_key"]) for r in got}


def test_graph_survives_storing():
    v = neighbours.unit_rows(np.random.default_rng(1).normal(size=(900, 6)))
    g = neighbours.Graph.build(v)
    again = neighbours.Graph.load(*(g.arrays()[n] for n in ("vectors", "members", "links", "shape")), 6)
    for x, y in zip(g.search(v[:50], 4), again.search(v[:50], 4)):
        assert (x == y).all()
    assert len(g.layers) > 1


# ---- wrong encodings -------------------------------------------------------------------

CLEAN = ["Технические характеристики Игла медицинская", "Описание товара Набор реагентов", "Паспорт изделия Тест-полоска – исправленная", "Спецификация Контрольная сыворотка низкий уровень", "ТЗ на поставку Банка для анализов"]
WESTERN = ["Résumé technique", "Größentabelle", "Übersicht", "Ficha técnica ñ"]


@pytest.fixture(scope="module")
def model():
    return mojibake.ChainModel(CLEAN, WESTERN)


@pytest.mark.parametrize("chain", [(("utf-8", "cp1251"),), (("utf-8", "latin-1"),), (("cp1251", "latin-1"),), (("utf-8", "cp866"),), (("koi8-r", "cp1251"),), (("utf-8", "latin-1"), ("utf-8", "cp1252"))])
def test_every_chain_is_inverted(model, chain):
    for text in [t for t in CLEAN if "–" not in t or chain[0][0] not in ("koi8-r", "cp866")]:
        assert model.restore(mojibake._runs.sub(lambda m: mojibake.garble(m[0], chain), text)) == text


def test_clean_and_lost_texts_stay(model):
    for text in [*CLEAN, *WESTERN, "plain", "", None, "��", mojibake.garble(CLEAN[0].split()[0], (("utf-8", "cp1251"),)).replace("‡", "?")]:
        assert model.restore(text) is None
    lost = "".join(c for c in mojibake.garble("Характеристики", (("utf-8", "latin-1"),)) if not 0x80 <= ord(c) < 0xA0)
    assert model.restore(lost) is None


@given(st.text(alphabet="абвгдеёжзийклмнопрстуфхцчшщъыьэюя", min_size=1), st.sampled_from(mojibake.CHAINS))
def test_garbling_is_reversible(text, chain):
    try:
        bad = mojibake.garble(text, chain)
    except ValueError:
        return
    assert mojibake.ungarble(bad, chain) == text


def test_characters_the_sample_never_held(model):
    for text in ["Описание товара за 5 €", "Описание товара 7 ₽", "Опис товару її", "Описание товара?", "Это описание? Да, товара"]:
        bad = mojibake.garble(text, (("utf-8", "latin-1"),))
        assert model.restore(bad) == text and model.restore(text) is None


def test_columns_that_repeat_each_other(model):
    bad = mojibake.garble("Описание товара", (("utf-8", "cp1251"),))
    assert model.restore_all([f"a/b-{bad}.doc", bad, None, "", "x", f"a/{bad}?"]) == ["a/b-Описание товара.doc", "Описание товара", None, None, None, "a/Описание товара?"]


def test_restore_table(spark):
    bad = mojibake.garble("Описание", (("utf-8", "cp1251"),))
    df = spark.createDataFrame([("a", bad, "x", 1), ("a", bad, "x", 1), ("b", None, "", 2), ("c", "Описание", None, 3)], "doc_id string, f string, g string, text int")
    got = [tuple(r) for r in mojibake.restore(df, "doc_id", ["f", "g"], mojibake.ChainModel(CLEAN, WESTERN)).collect()]
    assert got == [("a", "f", "Описание")]
    assert mojibake.restore(df.limit(0), "doc_id", ["f"]).count() == 0


def test_long_texts_are_restored(model):
    text = " ".join(CLEAN[:2] * 3000)
    assert model.restore(mojibake._runs.sub(lambda m: mojibake.garble(m[0], (("utf-8", "cp1251"),)), text)) == text


# ---- look-alikes -----------------------------------------------------------------------


def test_skeletons(spark):
    table = confusables.look_alikes(spark)
    look = lambda t: confusables.skeleton(t, table)
    assert look("Cок") == look("Сок") == look("С\u200bок")
    for a, b in [("Ӏ", "l"), ("ӏ", "i"), ("ɑ", "a"), ("օ", "o"), ("ѵ", "v"), ("ԁ", "d"), ("һ", "h"), ("‐", "-"), ("’", "'"), ("rn", "m"), ("Ａ", "A"), ("é", "é"), ("α", "a")]:
        assert look(a) == look(b)
    assert look("нос") != look("сон")
    assert look(None) is None and look("") == ""
    assert confusables.skeleton("ab", {ord("a"): "xy"}) == "xyb"  # the table is a parameter


def test_forms_come_from_the_group():
    assert confusables.form_of("тoвap", {"C": ("товар", 9)}) == "товар"
    assert confusables.form_of("cа", {"C": ("са", 1), "L": ("ca", 5)}) == "ca"
    assert confusables.form_of("cа", {}) == "са"
    assert confusables.form_of("тoвap", {"C": ("товары", 9)}) == "товар"  # a spelling that doesn't fit


def test_joined_forms_equal_sent_ones(spark, monkeypatch):
    df = spark.createDataFrame([("a", k, t) for k, t in enumerate(["товaр", "товар", "Cа и тeкст", "Са", "６０", "x", "тeкст"])], "doc_id string, ord int, text string")
    fields = confusables.long_fields(df, "t", "doc_id", "ord", ["text"])
    sent = sorted(map(tuple, confusables.consistent_fields(fields).collect()))
    monkeypatch.setattr(confusables, "MOST_SENT", 0)
    assert sorted(map(tuple, confusables.consistent_fields(fields).collect())) == sent and len(sent) == 4


def test_consistent_fields(spark):
    rows = [("a", 1, "товaр"), ("a", 1, "товaр"), ("a", 2, "Cа"), ("b", 1, "Са"), ("b", 2, "Са"), ("b", 3, None), ("b", 4, ""), ("b", 5, "чистый " * 20_000 + "тeкст")]
    df = spark.createDataFrame(rows, "doc_id string, ord int, text string")
    fields = confusables.long_fields(df, "t", "doc_id", "ord", ["text"])
    got = {(r["doc_id"], r["ord"]): r["form"][-6:] for r in confusables.consistent_fields(fields).collect()}
    assert got == {("a", 1): "товар", ("a", 2): "Са", ("b", 5): " текст"}
    groups = confusables.skeleton_groups(fields).collect()
    assert [(g["form"], g["n_texts"], g["n_fields"]) for g in groups if g["form"] == "Са"] == [("Са", 2, 3)]
    assert confusables.consistent_fields(fields.limit(0)).count() == 0


# ---- listings --------------------------------------------------------------------------


def test_reading_listings():
    a = listings.read_listing("Контрольная сыворотка «Вентирулаб» ML-2607 10 шт низкий уровень 0,005 л")
    b = listings.read_listing("Контроль L1 ventirulab ml 2607 (уп/10) 5 мл")
    assert (a["code"], a["pack"], a["sizes"]) == (b["code"], b["pack"], b["sizes"]) == ("ml2607", 10, {"volume": 5_000_000})
    assert a["words"] == ["контрольная", "сыворотка", "вентирулаб", "низкий", "уровень"] and a["names"] == ["вентирулаб"]
    assert b["words"] == ["контроль", "l1", "ventirulab"]
    assert listings.sound_key("Вентирулаб") == listings.sound_key("ventirulab")
    assert listings.read_listing("VM 881 с фторидом")["code"] == "vm881"
    assert listings.read_listing(None)["words"] == [] == listings.read_listing("")["words"]
    assert listings.read_listing("слово " * 50_000)["words"] == ["слово"]


def made_listings(rng, products, docs):
    """Listings of products no code knows of: documents with a name row and a file name, and their products."""
    words = {
        "syringe": (["шприц инъекционный", "шприц одноразовый", "инъектор"], {"a": ["луер", "ls"], "b": ["луерлок", "ll"], "c": ["катетерный", "ct"]}, [("2 мл", "2000 мкл"), ("5 мл", "0,005 л"), ("10 мл", "1 сл")]),
        "glove": (["перчатки смотровые", "перчатки медицинские", "рукавицы"], {"a": ["нитриловые", "nbr"], "b": ["латексные", "ltx"], "c": ["виниловые", "pvc"]}, [("240 мм", "24 см"), ("300 мм", "0,3 м")]),
        "mask": (["маска лицевая", "повязка на лицо", "респиратор"], {"a": ["детская", "kid"], "b": ["взрослая", "ad"]}, [("175 мм", "17,5 см"), ("145 мм", "14,5 см")]),
    }
    syllables = ["ка", "ло", "ри", "мен", "тос", "ви", "дар", "пел", "зу", "гор"]
    brands = ["".join(rng.sample(syllables, 3)) for _ in range(40)]
    made = set()
    while len(made) < products:
        kind = rng.choice(sorted(words))
        made.add((rng.choice(brands), kind, rng.choice(sorted(words[kind][1])), rng.randrange(len(words[kind][2])), rng.choice([1, 10, 100])))
    made = sorted(made)
    out = []
    for d in range(docs):
        p = rng.choice(made)
        brand, kind, variant, size, pack = p
        phrases, variants, sizes = words[kind]
        name = [rng.choice(phrases), f"«{brand}»" if rng.random() < 0.6 else brand.title(), rng.choice(variants[variant]), rng.choice(sizes[size]), rng.choice([f"{pack} шт", f"(уп/{pack})"]), rng.choice(["акция", "хит сезона", "новое", ""])]
        rng.shuffle(name)
        file = f"{rng.choice(['описание', 'паспорт', 'лист'])} {rng.choice(phrases)} {rng.choice(variants[variant])}.doc"
        out.append((f"d{d:04}", " ".join(name), file, p))
    return out


def test_products_outside_any_vocabulary(spark, spec=None):
    made = made_listings(random.Random(3), 120, 900)
    spec = spark.createDataFrame([("name", "Имя", "text", None), ("qty", "Число", "integer", None)], "attr_code string, title string, value_type string, base_unit string")
    aliases = spark.createDataFrame([("name", "Имя"), ("qty", "Число")], "attr_code string, alias string")
    rows = spark.createDataFrame([(d, 0, "Имя", n, None, 1) for d, n, _, _ in made] + [("e", 0, "Имя", None, None, 1), ("f", 1, None, "x", None, 1)], "doc_id string, row_ord int, indicator string, value_raw string, unit string, code int")
    docs = spark.createDataFrame([(d, f, 2) for d, _, f, _ in made] + [("e", None, 2), ("g", "", 2)], "doc_id string, file_name string, brand int")
    fields = listings.listing_fields(docs, rows, spec, aliases)
    got = {(r["doc_a"], r["doc_b"]) for r in listings.product_pairs(listings.group_listings(fields)).collect()}
    of = {}
    for d, _, _, p in made:
        of.setdefault(p, []).append(d)
    want = {(a, b) for ds in of.values() for a in ds for b in ds if a < b}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    none = listings.listing_fields(docs.limit(0), rows.limit(0), spec, aliases)
    assert none.count() == 0


def test_grouping(spark):
    fields = "doc_id string, code string, brand string, kind string, variant string, size bigint, pack bigint"
    rows = [("a", "x1", "brandone", "serum", "p", 5, 10), ("b", None, "brandone", "serum", "p", 5, 10), ("c", None, "brandonee", "serum", "p", 5, 10), ("d", None, "brandone", "serum", "p", 6, 10), ("e", "x1", "brandone", "serum", "p", 5, None)]
    rows += [(f"n{k}", None, None, None, None, None, None) for k in range(3)] + [(f"h{k:03}", None, "hot", "tube", "fx", 1, 1) for k in range(40)]
    grouped = listings.group_listings(spark.createDataFrame(rows, fields))
    pairs = {(r["doc_a"], r["doc_b"]) for r in listings.product_pairs(grouped).collect()}
    small = {p for p in pairs if not p[0].startswith("h")}
    assert small == {(x, y) for x in "abce" for y in "abce" if x < y}
    assert len(pairs) - len(small) == 40 * 39 // 2
    assert listings.product_pairs(listings.group_listings(spark.createDataFrame([], fields))).count() == 0


def test_classes_without_variant_and_code_meet_their_product(spark):
    fields = "doc_id string, code string, brand string, kind string, variant string, size bigint, pack bigint"
    rows = [("a", None, "brandone", "serum", None, 7, 3), ("b", "x20", "brandone", "serum", "l1", 7, 3)]
    rows += [(f"n{k:02}", f"y{k:02}", "brandone", "serum", "p" if k % 2 else "n", 100 + k, 5) for k in range(40)]
    pairs = {(r["doc_a"], r["doc_b"]) for r in listings.product_pairs(listings.group_listings(spark.createDataFrame(rows, fields))).collect()}
    assert pairs == {("a", "b")}


def test_amounts_told_together_are_summed():
    volume = lambda *x: listings.read_amounts(*x).get("volume")
    assert volume("2 мл + 0,5 мл", None, None) == 2_500_000
    assert volume("3 шт по 2 мл", None, None) == 2_000_000
    assert volume("2", "мл", None) == volume("2", None, "Объем, мл") == 2_000_000
    assert volume("2 мл + " + "9" * 30 + " мл", None, None) is None
    assert listings.read_amounts(None, None, None) == {} == listings.read_amounts("5", None, None)


def test_pivots_go_on_until_no_link_is_left(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(600)], "a bigint, b bigint")
    got = {r["class_id"]: r["cluster"] for r in listings.correlation_clusters(spark.range(601).withColumnRenamed("id", "class_id"), links).collect()}
    assert all(got[k] != k or got[k + 1] in (k, k + 1) or got[k + 1] != k + 1 for k in range(600))
    alone = [k for k in range(1, 600) if list(got.values()).count(got[k]) == 1]
    # a node stays alone only beside neighbours that pivots took
    assert all(list(got.values()).count(got[k - 1]) > 1 and list(got.values()).count(got[k + 1]) > 1 for k in alone)


def test_pivots_form_stars(spark):
    nodes = spark.range(5).withColumnRenamed("id", "class_id")
    links = spark.createDataFrame([(0, 1), (1, 2), (3, 3)], "a bigint, b bigint")
    got = {r["class_id"]: r["cluster"] for r in listings.correlation_clusters(nodes, links).collect()}
    assert got[3] == 3 and got[4] == 4 and got[0] in (0, 1) and got[2] in (1, 2)


def test_listings_of_extremes(spark):
    texts = ["9" * 400 + " мл", "Контроль 1×10^999 мл уп. " + "9" * 30 + " шт", "", None, "Игла " * 20_000, "?" * 5000]
    spec = spark.createDataFrame([("name", "text", None), ("pack_qty", "integer", None), ("vial_vol", "quantity", "мл")], "attr_code string, value_type string, base_unit string")
    aliases = spark.createDataFrame([("name", "Наименование"), ("pack_qty", "Количество"), ("vial_vol", "Объем")], "attr_code string, alias string")
    rows = [(d, o, i, t, None, "x") for d in ("a", None) for o in (1, None) for i in ("Наименование", "Количество", "Объем", None) for t in texts]
    docs = spark.createDataFrame([("a", t, 1) for t in texts] + [(None, "x", 2)], "doc_id string, file_name string, class_id int")
    fields = listings.listing_fields(docs, spark.createDataFrame(rows, "doc_id string, row_ord int, indicator string, value_raw string, unit string, kind string"), spec, aliases)
    assert listings.product_pairs(listings.group_listings(fields)).count() == 0


# ---- tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library_tokenizer():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(library_tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.vocabulary().ids(text) == library_tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.vocabulary().decode(tokens.vocabulary().ids(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=10), st.integers(0, 30), st.integers(0, 5))
def test_tables_grow_and_are_edited(start, more, at, removed):
    v = tokens.vocabulary()
    table = tokens.PrefixTable(v, start).append(more)
    assert table.ids() == tokens.PrefixTable(v, start + more).ids()
    at = min(at, len(start))
    assert table.edit(at, removed, more).ids() == tokens.PrefixTable(v, (start + more)[:at] + more + (start + more)[at + removed :]).ids()


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="аб ab1.'s\n\té", max_size=60), st.integers(0, 60), st.integers(0, 8), st.text(alphabet="аб ab1.'s\n", max_size=6))
def test_edited_texts_are_encoded_anew_only_near_the_edit(text, at, removed, inserted):
    v = tokens.vocabulary()
    at = min(at, len(text))
    removed = min(removed, len(text) - at)
    table = tokens.TextTable(v, text).edit(at, removed, inserted)
    want = text[:at] + inserted + text[at + removed :]
    assert table.text == want and table.ids() == v.ids(want) == tokens.TextTable(v, want).ids()


def test_an_edit_meets_the_old_tokens_again():
    v = tokens.vocabulary()
    text = "слово и ещё слово. " * 2000
    table = tokens.TextTable(v, text).edit(19_000, 3, "замена")
    assert table.touched < 10 and table.ids() == v.ids(text[:19_000] + "замена" + text[19_003:])
    data = ("прибор" * 400).encode()
    asked = []
    piece = tokens.PrefixTable(v, data)
    own, piece._token = piece._token, lambda end: asked.append(end) or own(end)
    assert piece.edit(300, 4, b"abc").ids() == tokens.PrefixTable(v, data[:300] + b"abc" + data[304:]).ids()
    assert len(asked) < len(data) - 300


def test_token_table(spark):
    df = spark.createDataFrame([(1, "Тест набора", 7), (2, "", 7), (3, None, 7), (1, "Тест набора", 7)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in tokens.encode(df).collect())
    assert got[0] == got[1] and got[2:] == [(2, 0), (3, 0)]
    assert [r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"]).orderBy("doc_id").collect()][2:] == [0, 0]
    assert tokens.encode(df.limit(0)).count() == 0


# ---- mixture ---------------------------------------------------------------------------


@settings(deadline=None)
@given(st.lists(st.tuples(st.floats(0.05, 0.95), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 9))
def test_flight_keeps_both_sums(units, seed):
    p, size = [u[0] for u in units], [float(u[1]) for u in units]
    done = mixture.flight(p, size, random.Random(seed))
    assert sum(done) == pytest.approx(sum(p), abs=1e-5)
    assert sum(x * s for x, s in zip(done, size)) == pytest.approx(sum(x * s for x, s in zip(p, size)), rel=1e-5)
    assert sum(1e-9 < x < 1 - 1e-9 for x in done) <= 2
    assert set(mixture.landing(done, size)) <= {0, 1}


def test_mixture(spark):
    rng = random.Random(5)
    sizes = spark.createDataFrame([(k, ("a", "b", "c", None)[k % 4], rng.randint(1, 200)) for k in range(9000)] + [(9999, "a", 0)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 5.0, 1), ("b", 3.0, 2), ("c", 2.0, 3), ("none", 4.0, 9), ("a", 5.0, 1), ("c", None, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    mixed = mixture.mix(sizes, targets)
    report = {r["source"]: r for r in mixture.shares(mixed, sizes, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[source]["actual_share"] == pytest.approx(share, abs=0.001)
    assert report["none"]["docs"] == 0 and report["a"]["most_repeats"] == 1
    again = mixture.mix(sizes.repartition(7), targets)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    assert mixture.mix(sizes.limit(0), targets).count() == 0


# ---- grades ----------------------------------------------------------------------------


def test_grades_on_held_out_texts(spark):
    rng = random.Random(3)
    words = {g: [f"{c}{g_name}{d}" for c in "кмт" for d in "аоиу"] for g, g_name in zip(range(1, 6), ("ра", "вен", "троп", "имм", "прос"))}

    def text(g):
        return " ".join(rng.choice(words[g if rng.random() < 0.8 else min(5, max(1, g + rng.choice((-1, 1))))]) for _ in range(60))

    grade_of = {k: k % 5 + 1 for k in range(400)}
    df = spark.createDataFrame([(k, text(g)) for k, g in grade_of.items()] + [(900, "мало слов"), (901, None), (902, "")], "doc_id bigint, text string")
    rated = [(k, r, min(5, max(1, g + (rng.random() < 0.1)))) for k, g in grade_of.items() if k < 60 for r in (1, 2)] + [(1, 9, None), (5000, 1, 3)]
    ratings = spark.createDataFrame(rated, "doc_id bigint, rater int, grade int")
    got = {r["doc_id"]: r["grade"] for r in grades.grade(df, ratings).collect()}
    held = [k for k in grade_of if k >= 60]
    assert sum(got[k] == grade_of[k] for k in held) / len(held) > 0.9
    assert not {900, 901, 902} & set(got)
    assert {r["grade"] for r in grades.grade(df, ratings.limit(0)).collect()} == {3}
    assert grades.grade(df.limit(0), ratings).count() == 0


def test_planted_difficulties_are_recovered(spark):
    """Texts drawn from the model itself: levels and the order of difficulties come back."""
    rng = np.random.default_rng(5)
    names = ["".join(chr(0x430 + int(x)) for x in rng.integers(0, 32, 7)) for _ in range(150)]
    beta, theta = rng.normal(0, 0.8, 150), rng.uniform(-2.4, 2.4, 500)
    texts = []
    for t in theta:
        w = np.exp(beta * t)
        texts.append(" ".join(names[k] for k in rng.choice(150, 80, p=w / w.sum())))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ratings = spark.createDataFrame([(k, 1, int(np.clip(round(theta[k]) + 3, 1, 5))) for k in range(120)], "doc_id int, rater int, grade int")
    got = {r["doc_id"]: r for r in grades.grade(df, ratings).collect()}
    level = np.array([got[k]["level"] for k in range(120, 500)])
    assert np.corrcoef(level, theta[120:])[0, 1] > 0.95
    near = [abs(got[k]["grade"] - 3 - theta[k]) < 1 for k in range(120, 500)]
    assert sum(near) / len(near) > 0.95


def test_cuts_without_some_grades():
    scale = grades.Scale(1, 3)
    counts = np.zeros((3, len(scale.grid)))
    counts[1, 10] = 4
    assert np.searchsorted(grades.cuts(counts, scale), [-9.0, 0.0, 9.0]).tolist() == [1, 1, 1]
