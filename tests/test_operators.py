import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sverka.operators import documents, extract, gate, library, matching, models, scoring
from sverka.operators import rows as R
from sverka.session import written
from sverka.sources import files
from sverka.streaming import ingest

ROWS = "doc_id string, row_ord int, indicator string, value_raw string"


def test_names_and_values(spark):
    df = spark.createDataFrame([("Наименование товара", "1"), ("Наименование товара", "Тест-полоски H10"), ("Стерильность", "да"), ("Состав набора", "буфер"), ("Состав набора", "буфер промывочный, планшет"), ("Код", "мало"), ("x", None)], "i string, v string")
    got = [r[0] for r in df.select(R.acceptable(F.col("i"), F.coalesce("v", F.lit("")))).collect()]
    assert got == [False, True, True, False, True, False, False]
    names = [("шт", False), ("Тест-кассета", True), ("код КТРУ 1", False), ("12", False), ("", False)]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in df.select(R.could_be_name(F.col("n"))).collect()] == [x for _, x in names]


def test_line_rules_agree_with_columns(spark):
    texts = ["шт", "Тест-кассета", "Наименование товара", "Состав", "да", "буфер промывочный, планшет 96", "1", "Материал для исследования", "кровь"]
    rules = extract.LineRules()
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "i string, v string")
    got = {(r["i"], r["v"]): (r["a"], r["n"], r["t"]) for r in df.select("i", "v", R.acceptable(F.col("i"), F.col("v")).alias("a"), R.could_be_name(F.col("v")).alias("n"), R.allows_text(F.col("i")).alias("t")).collect()}
    for (i, v), told in got.items():
        assert told == (rules.acceptable(i, v), rules.could_be_name(v), rules.allows_text(i)), (i, v)


def test_product_names_fall_back(spark):
    rows = [("a", 1, "Наименование товара", "Тест-полоски H10; Тест-полоски Н10"), ("b", 1, "Экспресс-тест на наркотики", "шт"), ("c", 1, "Объект закупки", "Поставка: тест-кассеты"), ("d", 1, "Прочее", "1"), ("a", 2, "Экспресс-тест", "шт")]
    got = {}
    for r in R.product_names(spark.createDataFrame(rows, ROWS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["name"])
    assert got == {"a": {"тест полоски h10 тест полоски h10", "тест полоски h10"}, "b": {"экспресс тест на наркотики"}, "c": {"поставка тест кассеты"}}


def test_codes_markers_containment(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    assert one(R.product_codes(F.lit("IHIV-C41, H10-800 и тх-1"))) == ["ihiv-c41", "h10-800"]
    assert one(R.disease_markers(F.lit("ВИЧ, гепатит С"))) == ["hiv", "hcv"]
    assert one(R.names_contain(F.lit("тест полоски для анализа мочи"), F.lit("полоски для анализа мочи")))
    assert not one(R.names_contain(F.lit("стол"), F.lit("стул")))


def test_extractors(spark):
    texts = [("a", "Игла 21G, needle 0 g"), ("b", "ВИЧ-1, сифилис"), ("c", "Количество в упаковке не менее 40 шт"), ("d", "Аналитическая чувствительность (концентрация) 5,0 нг/мл"), ("e", None), ("f", ""), ("g", "цветная шкала содержит 7 цветовых полей")]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    said = lambda d: {(r["doc_id"], r["value_raw"]) for r in d.collect()}
    assert said(extract.needle_gauges(df, "doc_id", "text")) == {("a", "21 G")}
    assert said(extract.infections(df, "doc_id", "text")) == {("b", "ВИЧ 1; сифилис")}
    assert said(extract.pack_quantities(df, "doc_id", "text")) == {("c", "40 шт.")}
    assert said(extract.sensitivities(df, "doc_id", "text")) == {("d", "5 нг/мл")}
    assert said(extract.colour_scales(df, "doc_id", "text")) == {("g", "7")}


def test_row_extractors(spark):
    rows = spark.createDataFrame([("a", 0, "Наименование товара", "Тест-кассета"), ("a", 1, "Описание", "длинный текст описания"), ("a", 2, "Материал", "кровь"), ("b", 0, "Материал", "моча, кровь")], ROWS)
    assert {(r["doc_id"], r["value_raw"]) for r in extract.materials(rows).collect()} == {("a", "Цельная кровь"), ("b", "Моча")}
    lines = extract.doc_lines(rows)
    assert [(r["indicator"], r["value_raw"]) for r in extract.label_next_line(lines).collect()] == [("Описание", "длинный текст описания")]
    assert [r["value_raw"] for r in extract.names_ahead(lines).collect()] == ["Тест-кассета"]


def test_guess_rows(spark):
    text = "Показатель\nОбъем пробы\n10 мкл\nСтерильность | да\nСрок: 12 мес\nНаименование товара\nЕд. изм.\nТест-кассета ИХА"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc_id string, text string")
    got = [(r["indicator"], r["value_raw"]) for r in extract.guess_rows(df, "doc_id", "text").orderBy("ord").collect()]
    assert got == [("Объем пробы", "10 мкл"), ("Стерильность", "да"), ("Срок", "12 мес"), ("Наименование товара", "Ед. изм.")]


def test_tables(spark):
    html = "<tr><td>Объем</td><td>10</td></tr><tr><td>20</td></tr>"
    df = spark.createDataFrame([("a", html)], "doc_id string, html string")
    assert [(r["indicator"], r["value_raw"]) for r in extract.carry_forward(extract.html_table_rows(df, "doc_id", "html")).orderBy("pos").collect()] == [("Объем", "10"), ("Объем", "20")]
    cells = spark.createDataFrame([("a", 0, ["1", "Тест-кассета для анализа мочи", "Объем: 5 мл; Количество тестов 40 шт"]), ("a", 1, ["Срок", "12 мес"])], "doc_id string, row int, cells array<string>")
    got = {(r["indicator"], r["value_raw"]) for r in extract.sheet_rows(cells).collect()}
    assert got == {("Наименование товара", "Тест-кассета для анализа мочи"), ("Объем", "5 мл"), ("Количество тестов", "40 шт"), ("Срок", "12 мес")}


def test_union_first(spark):
    a = spark.createDataFrame([("d", "x", "1", 5)], "doc_id string, indicator string, value_raw string, ord int")
    b = spark.createDataFrame([("d", "x", "1", 0), ("d", "y", "2", 0)], a.schema)
    assert {(r["indicator"], r["producer"], r["ord"]) for r in extract.union_first([a, b]).collect()} == {("x", 0, 5), ("y", 1, 0)}


def test_matching(spark):
    q = spark.createDataFrame([("q", 0, "Объем пробы", "10 мкл"), ("q", 1, "Количество тестов", "25"), ("q", 2, "Код КТРУ", "1"), ("q", 3, "Цвет", "белый")], "query_id string, row_ord int, indicator string, value_raw string")
    lib = spark.createDataFrame([("a", 0, "объем  пробы", "10,5 мкл"), ("a", 1, "Комплектация", "25"), ("b", 0, "Объем пробы", "50 мкл")], ROWS)
    keys = scoring.key_rows(q)
    assert {r["row_ord"] for r in keys.collect()} == {0, 1}
    matched = scoring.matched_rows(keys, lib)
    assert {(r["doc_id"], r["row_ord"]) for r in matched.collect()} == {("a", 0), ("a", 1)}
    best = scoring.decided(scoring.ranked(scoring.scores(keys, matched), 1, [F.desc("score")])).first()
    assert (best["doc_id"], best["points"], best["percent"], best["decision"]) == ("a", 2, 100.0, "match")
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "PythonUDF" not in plan


def matched(spark):
    rows = "doc_id string, row_ord int, indicator string, value_raw string, embedding array<double>, extra int"
    e, f = [1.0] + [0.0] * 31, [0.9, 0.1] + [0.0] * 30
    lib = spark.createDataFrame(
        [("q", 0, "Объем пробы", "10 мкл", None, 1), ("q", 1, "Количество тестов", "25", None, 1), ("q", 2, "Код КТРУ", "1", None, 1), ("q", 3, "Длина", "7 мм", e, 1), ("q", 4, None, None, None, 1)]
        + [("a", 0, "объем  пробы", "10,5 мкл", None, 1), ("a", 1, "Комплектация", "25", None, 1), ("a", 2, "Протяжённость", "7 мм", f, 1), ("b", 0, "Объем пробы", "50 мкл", None, 1), ("b", 1, None, "x", [float("nan")] * 32, 1)],
        rows,
    )
    candidates = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.9)], "query_id string, doc_id string, similarity double")
    asked = lib.where("doc_id = 'q'").withColumnRenamed("doc_id", "query_id")
    return asked, candidates, matching.compared_rows(asked, lib, candidates)


def test_documents_are_matched_end_to_end(spark):
    asked, candidates, compared = matched(spark)
    scored = matching.scored(asked, compared, candidates)
    got = {r["doc_id"]: (r["points"], r["total"], r["indicators"]) for r in scored.collect()}
    assert got == {"a": (3, 3, ["Объем пробы", "Количество тестов", "Длина"]), "b": (0, 3, None)}  # the length by its vector alone
    best = matching.best_documents(scored)
    assert [(r["doc_id"], r["percent"], r["decision"]) for r in best.collect()] == [("a", 100.0, "match")]
    rows = {r["q_ord"]: (r["matched_value"], r["match"]) for r in matching.best_rows(compared, best).collect()}
    assert rows[0] == ("10,5 мкл", True) and rows[3] == ("7 мм", True)
    docs = spark.createDataFrame([("a", "a.pdf", "p", ".pdf")], "doc_id string, original_filename string, stored_path string, extension string")
    answer = json.loads(matching.answers(best, matching.best_rows(compared, best), docs).first()["answer"])
    assert answer["bestMatchFilename"] == "a.pdf" and len(answer["rowResults"]) == 3 and answer["matches"][0]["matchedCount"] == 3
    assert matching.scored(asked.limit(0), compared.limit(0), candidates.limit(0)).count() == 0
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_nearest_documents_and_the_gate(spark):
    v = lambda *x: list(map(float, x)) + [0.0] * (32 - len(x))
    docs = spark.createDataFrame([("a", 0, v(1)), ("b", 1, v(1, 1)), ("c", 2, v(0, 1)), ("d", 3, v(1)), ("e", 4, None)], "doc_id string, doc_ord bigint, v array<double>")
    near = matching.nearest_documents(docs.where("doc_id in ('a', 'c')"), docs, 2)
    assert {(r["query_id"], r["doc_id"]) for r in near.collect()} == {("a", "d"), ("a", "b"), ("c", "b"), ("c", "a")}
    gate = spark.createDataFrame([("a", "c"), ("a", "e")], "query_id string, doc_id string")
    got = {(r["query_id"], r["doc_id"]) for r in matching.gated_candidates(gate, near, docs, docs).collect()}
    assert got == {("a", "c"), ("a", "e"), ("c", "b"), ("c", "a")}


def test_markers_narrow_the_pairs(spark):
    q = spark.createDataFrame([("q", "hiv"), ("q", "hcv")], "query_id string, marker string")
    lib = spark.createDataFrame([("a", "hiv"), ("a", "hcv"), ("b", "hiv"), ("c", "hiv"), ("c", "hcv"), ("c", "hbv")], "doc_id string, marker string")
    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "a"), ("r", "b")], "query_id string, doc_id string")
    shares = matching.marker_shares(q, lib, pairs)
    assert {(r["query_id"], r["doc_id"]): (r["marker_recall"], r["marker_extra"]) for r in shares.collect()}[("q", "b")] == (0.5, 0)
    assert {(r["query_id"], r["doc_id"]) for r in matching.narrowed_by_markers(shares).collect()} == {("q", "a"), ("r", "a"), ("r", "b")}


def test_narrowed(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "query_id string, f boolean")
    assert sorted(map(tuple, scoring.narrowed(df, "f").collect())) == [("a", True), ("b", False)]


def test_top_rank_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as query_id", "id as doc_id")
    plan = scoring.ranked(df, 2, [F.col("doc_id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_library(spark, tmp_path):
    lib = library.Library(spark, f"file://{tmp_path}/lib")
    assert lib.read()[0].count() == 0
    docs = lambda *ids: spark.createDataFrame([(i, k, f"{i}.pdf", ".pdf", None, None, None, None) for k, i in enumerate(ids)], library.DOCS)
    rows = lambda *ids: spark.createDataFrame([(i, 0, "x", "1", None, None) for i in ids], library.ROWS)
    lib.add(docs("a", "b"), rows("a", "b", "b"))
    lib.add(docs("c"), rows("c"))
    lib.delete(spark.createDataFrame([("a",), ("none",)], "doc_id string"))
    got = {r["doc_id"]: r["rows_count"] for r in library.listing(*lib.read()).collect()}
    assert got == {"b": 1, "c": 1}
    lib.clear()
    assert lib.read()[1].count() == 0
    stored = spark.createDataFrame([("x/12345678-1234-1234-1234-123456789abc-имя.pdf",), ("x/имя.pdf",)], "path string")
    named = {r["file_name"]: r["doc_id"] for r in library.ids_of(stored).collect()}
    assert set(named) == {"имя.pdf"}


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
    return out.getvalue()


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Объем</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>10 мл</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:t>Объем: 10 &amp; 20</w:t></w:p><w:p><w:t>x</w:t></w:p>"))
    (tmp_path / "b.XLSX").write_bytes(xlsx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF text")
    (tmp_path / "d.txt").write_bytes(b"no")
    found = files.spec_files(spark, str(tmp_path))
    assert found.count() == 4
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.file_texts(found, {".pdf": lambda b: b.decode()[5:]}).collect()}
    assert texts["c.pdf"] == "text" and "Объем: 10 & 20" in texts["a.docx"] and texts["b.XLSX"] == "Объем |  | 10 мл" and "bad.docx" not in texts
    assert [r["cells"] for r in files.sheet_cells(found).collect()] == [["Объем", "", "10 мл"]]


def test_json_sources(spark, tmp_path):
    index = {"version": 1, "createdAt": "x", "docs": [{"id": "a", "originalFilename": "a.pdf", "rows": [{"indicator": "i", "valueRaw": "1"}], "indexedAt": "2024-01-01T00:00:00Z"}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    docs, rows = files.index_json(spark, str(tmp_path / "index.json"))
    assert docs.first()["rows_count"] == 1 and rows.first()["value_raw"] == "1"
    (tmp_path / "bad.json").write_text("{no")
    assert files.index_json(spark, str(tmp_path / "bad.json"))[0].count() == 0
    body = spark.createDataFrame([('{"data":[{"_id":"1","name":"n"},{"_id":"2"}]}',), ('[{"_id":"3","name":"m"}]',), ("no",)], "body string")
    assert {r["_id"] for r in files.rest_items(body, "body").collect()} == {"1", "3"}
    one = spark.createDataFrame([('{"data":{"href":"h","maxPrice":"5","attachments":[{"realName":"r","href":"x"}]}}',), ('{"href":"t"}',)], "body string")
    assert [(r["href"], r["max_price"], len(r["attachments"])) for r in files.rest_item(one, "body").collect()] == [("h", 5.0, 1), ("t", None, 0)]


def test_sheets_in_the_order_of_the_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>Объ</t></r><r><t>ем</t></r><rPh><t>hint</t></rPh></si></sst>")
        for k in (1, 10, 2):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>{k}</v></c></row></sheetData></worksheet>')
    assert [c for _, _, c in files.xlsx_rows(out.getvalue())] == [["Объем", "10"], ["Объем", "1"], ["Объем", "2"]]


def test_files_to_rows(spark, tmp_path):
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:p><w:t>{c}</w:t></w:p></w:tc>" for c in cells) + "</w:tr>"
    body = "<w:tbl>" + row("Длина изделия", "25 мм") + row("Стерильность иглы", "наличие") + "</w:tbl><w:p><w:t>Игла 21G</w:t></w:p>"
    (tmp_path / "a.docx").write_bytes(docx(body))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cell('Срок годности')}{cell('12 мес')}</row></sheetData></worksheet>")
    (tmp_path / "c.pdf").write_bytes("Объем: 5 мл\nИгла 18G".encode())
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.spec_files(spark, str(tmp_path))
    got = {(r["doc_id"].rsplit("/", 1)[1], r["indicator"], r["value_raw"]) for r in documents.file_rows(found, {".pdf": lambda b: b.decode()}).collect()}
    assert {("a.docx", "Длина изделия", "25 мм"), ("a.docx", "Стерильность иглы", "наличие"), ("a.docx", "Размер иглы, G", "21 G"), ("b.xlsx", "Срок годности", "12 мес"), ("c.pdf", "Объем", "5 мл"), ("c.pdf", "Размер иглы, G", "18 G")} <= got
    assert {f for f, *_ in got} == {"a.docx", "b.xlsx", "c.pdf"}
    assert documents.file_rows(found.limit(0)).count() == 0


def test_files_left_out_are_told(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 100)
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.doc").write_bytes(b"x")
    at = str(tmp_path)
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in files.skipped_files(spark, at, 50).collect()} == {("a.pdf", "too large"), ("b.txt", "unsupported type")}
    assert files.spec_files(spark, at, 50).count() == 1 and files.spec_files(spark, at, None).count() == 2


def test_missing_index_and_orders(spark, tmp_path):
    docs, rows = files.index_json(spark, str(tmp_path / "none.json"))
    assert docs.count() == 0 and rows.count() == 0
    body = spark.createDataFrame([('{"tenders":[{"_id":"1"},{"orderName":"n"},{"x":1}]}',), ('[{"_id":"3","orderName":"m"}]',), ("no",)], "body string")
    assert {tuple(r) for r in files.rest_orders(body, "body").collect()} == {("1", ""), ("", "n"), ("3", "m")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lib = library.Library(spark, f"file://{tmp_path}/lib")
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"doc_id": str(k), "text": "Объем\n10 мл"}))
        ingest.ingest(ingest.text_stream(spark, str(tmp_path / "in")), lib, f"{tmp_path}/cp").awaitTermination()
    docs, rows = lib.read()
    assert docs.count() == 2 and {(r["doc_id"], r["value_raw"]) for r in rows.collect()} == {("0", "10 мл"), ("1", "10 мл")}


def test_stream_windows(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(1, None, 1, "a", 1.0, None)], schema).selectExpr("event_id", "timestamp'2024-01-01 10:10:00' as ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    counted = ingest.event_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").first()["n"] == 1


@pytest.mark.parametrize("part", ["operators", "functions", "plans", "sources", "streaming"])
def test_nothing_but_the_entry_imports_the_optional_part(part):
    from pathlib import Path

    for path in (Path(__file__).parents[1] / "sverka" / part).glob("*.py"):
        assert "sverka.llm" not in path.read_text()


def test_name_gate(spark):
    rows = [("q", 0, "Наименование товара", "Тест-полоски для анализа мочи H10"), ("a", 0, "Наименование товара", "тест полоски для анализа мочи Н10"), ("b", 0, "Наименование товара", "Полоски для анализа мочи"), ("c", 0, "Наименование товара", "Игла медицинская AB-1234"), ("q", 1, "Код", "AB-1234"), ("d", 0, "Прочее", "x")]
    keys = gate.gate_keys(spark.createDataFrame(rows, ROWS))
    gated = gate.name_gate(keys.where("doc_id = 'q'"), keys.where("doc_id <> 'q'"))
    got = {r["doc_id"]: (r["by_name"], r["by_code"], r["contained"]) for r in gated.collect()}
    assert got == {"a": (True, False, True), "b": (False, False, True), "c": (False, True, False)}
    assert [r["doc_id"] for r in gate.candidates(gated).collect()] == ["c"]


def test_name_gate_by_root_piece_marker_and_vector(spark):
    named = "Наименование товара"
    rows = [("q", 0, named, "Экспресс-тест выявления наркотических соединений"), ("q", 1, "Назначение", "ВИЧ"), ("q2", 0, named, "полоски для мочи"), ("root", 0, named, "Кассета на наркотики быстрая"), ("marker", 0, named, "Игла медицинская"), ("marker", 1, "Прочее", "anti-HIV"), ("piece", 0, named, "Тестполоски для мочи"), ("vector", 0, named, "Банка"), ("far", 0, named, "Пробирка")]
    vector = {"q": [1.0, 0.1] + [0.0] * 30, "vector": [2.0] + [0.0] * 31, "far": [0.7, 0.9] + [0.0] * 30}
    df = spark.createDataFrame([(*r, vector.get(r[0]) if r[1] == 0 else None) for r in rows], ROWS + ", embedding array<double>")
    keys, vectors = written(gate.gate_keys(df), "keys"), written(gate.name_vectors(df), "vectors")
    asked = lambda x, yes: x.where(F.col("doc_id").isin("q", "q2") == yes)
    flags = ["by_name", "by_code", "by_marker", "contained", "by_vector"]
    got = {(r["query_id"], r["doc_id"]): [f for f in flags if r[f]] for r in gate.name_gate(asked(keys, True), asked(keys, False), (asked(vectors, True), asked(vectors, False))).collect()}
    assert got == {("q", "root"): ["contained"], ("q", "marker"): ["by_marker"], ("q2", "piece"): ["contained"], ("q", "vector"): ["by_vector"]}


def test_near_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(40, 32)), 10, 0) + 0.35 * rng.normal(size=(400, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"d{k}", x.tolist()) for k, x in enumerate(v)], "doc_id string, v array<double>")
    got = {(r["query_id"], r["doc_id"]) for r in gate.near_vectors(df.limit(100).withColumnRenamed("doc_id", "query_id"), df, cells=16).collect()}
    asked = {q for q, _ in got}
    assert len(asked) == 100
    assert got == {(q, f"d{k}") for q in asked for k in np.flatnonzero(v[int(q[1:])] @ v.T >= 0.82)}


def test_models(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    assert [tuple(r) for r in models.embed_texts(df, "t", lambda: lambda texts: [[float(len(t))] for t in texts]).collect()] == [("a", [1.0])]
    pairs = spark.createDataFrame([("q", "a", [("x", "1")], [("y", "2")])], "query_id string, doc_id string, query_rows array<struct<indicator string, value_raw string>>, library_rows array<struct<indicator string, value_raw string>>")
    got = models.judge_pairs(pairs, lambda: lambda q, l: {"decision": "match", "confidence": float("inf"), "similarity": 3}).first()
    assert (got["decision"], got["confidence"], got["similarity"]) == ("match", 0.0, 1.0)
    assert models.judge_pairs(pairs, lambda: lambda q, l: None).first()["decision"] is None


def test_presence(spark):
    xml = "<w:t>Стерильность</w:t><w:t>инструкция</w:t><w:t xml:space='preserve'> да </w:t><w:tab/><w:t>есть</w:t>"
    tokens = extract.word_tokens(spark.createDataFrame([("a", xml), ("b", None)], "doc_id string, xml string"), "doc_id", "xml")
    assert [(r["indicator"], r["value_raw"]) for r in extract.presence_pairs(tokens).orderBy("pos").collect()] == [("Стерильность", "да"), ("Стерильность", "есть")]


def test_document_rows(spark):
    df = spark.createDataFrame([("a", "Игла 21G\nСрок: 12 мес\nСрок: 12 мес\nИзделие предназначено: тест предназначен для анализатора"), ("b", None)], "doc_id string, text string")
    got = {(r["indicator"], r["value_raw"], r["producer"]) for r in extract.document_rows(df, "doc_id", "text").collect()}
    assert ("Срок", "12 мес", 0) in got and ("Размер иглы, G", "21 G", 10) in got and any(i == "Назначение" for i, *_ in got)


def texts(spark, *values):
    return spark.createDataFrame([(f"d{k}", v, 1) for k, v in enumerate(values)], "doc_id string, text string, ord int")


def told(df):
    return {(r["doc_id"], r["value_raw"]) for r in df.collect()}


def test_names_in_texts(spark):
    df = texts(spark, "Наименование товара\nТест-полоски H10\nшт\nОписание\nПолоски иные", None, "", "Наименование  товара", "Наименование товара\n" + "Иное слово\n" * 25)
    assert told(extract.text_names(df, "doc_id", "text")) == {("d0", "Тест-полоски H10"), ("d4", "Иное слово")}


def test_materials_in_texts(spark):
    df = texts(spark, "Исследуемый материал\nМоча  утренняя\nвода\nВремя\nкровь", "проба в цельной крови, сыворотке или плазме", "сыворотка", None, "плазма, сыворотка и цельная кровь")
    blood = {"Цельная кровь", "Сыворотка крови", "Плазма крови"}
    assert told(extract.text_materials(df, "doc_id", "text")) == {("d0", "Моча утренняя")} | {(d, m) for d in ("d1", "d4") for m in blood}


def test_labels_descriptions_and_analyzers(spark):
    df = texts(spark, "Назначение\nдля определения белка в моче\nОписание: полоска с реагентом на подложке\nдля анализаторов Дельмар 90; иное", None, "Описание\nколичество")
    assert told(extract.text_labels(df, "doc_id", "text")) == {("d0", "для определения белка в моче")}
    assert told(extract.descriptions(df, "doc_id", "text")) == {("d0", "полоска с реагентом на подложке")}
    assert [tuple(r) for r in extract.analyzers(df, "doc_id", "text").collect()] == [("d0", "дельмар 90")]


def test_numbers_inside_texts(spark):
    df = texts(spark, "Пакет. Количество тестов 40 шт. Объём флакона 2,5 мл. Объем 3 мл", "Объем", None)
    got = {(r["indicator"], r["value_raw"]) for r in extract.blob_numbers(df, "doc_id", "text").collect()}
    assert got == {("Количество тестов", "40 шт"), ("Объём флакона", "2,5 мл")}
    assert told(extract.pack_quantities(texts(spark, "40 штx в наборе, количество в упаковке"), "doc_id", "text")) == {("d0", "40 шт.")}


def test_sheets_of_other_shapes(spark):
    long = "Объем: 5 мл; Срок: 12 мес; " + "слово " * 80
    cells = spark.createDataFrame([("a", 0, ["", long]), ("b", 0, ["Срок", None, None]), ("b", 1, ["12 мес"]), ("c", 0, []), ("d", 0, ["1", "x"] + ["A: 1"] * 1500)], "doc_id string, row int, cells array<string>")
    got = {}
    for r in extract.sheet_rows(cells).collect():
        got.setdefault(r["doc_id"], []).append((r["indicator"], r["value_raw"]))
    assert ("Объем", "5 мл") in got["a"] and got["b"] == [("Срок", "12 мес")] and "c" not in got and len(got["d"]) == 1500


def test_pdf_rows(spark):
    df = texts(spark, "Игла 21G\nСрок: 12 мес\nупаковка", None)
    got = {(r["indicator"], r["value_raw"]) for r in extract.document_rows(df, "doc_id", "text", "pdf").collect()}
    assert ("Размер иглы, G", "21 G") in got and ("Срок", "12 мес") in got


def test_property_points(spark):
    q = spark.createDataFrame([("q", "Специфичность", "≥ 95 %"), ("q", "Чувствительность", "99 %"), ("q", "Цвет", "1")], "query_id string, indicator string, value_raw string")
    lib = spark.createDataFrame([("a", "Диагностическая специфичность", "97%"), ("a", "Чувствительность", "99"), ("b", "Специфичность", "90 %")], "doc_id string, indicator string, value_raw string")
    assert [tuple(r) for r in scoring.property_points(q, lib).collect()] == [("q", "a", 3, 6)]


def test_best_parts_of_a_large_brand(spark, tmp_path, monkeypatch):
    import duckdb

    from sverka.plans import reference

    types = ["SMALL COPPER", "LARGE STEEL", "PROMO TIN", None, ""]
    rows = [(k, "Brand#1" if k % 7 else "", types[k % 5], k * 7 % 50 + 1, 900.0 + k * 37 % 1200) for k in range(1, 3001)]
    rows += [(40, "Brand#1", "PROMO TIN", 9, 1000.0), (41, "Brand#1", "LARGE STEEL", 30, 900.0), (2020, None, "LARGE STEEL", 5, 900.0), (4000, None, "x", 1, 1.0), (4020, "Brand#9", "x", None, None), (4021, "Brand#9", "y", 3, 5.0), (4040, "Brand#8", "x", 1, 1.0), (None, "Brand#9", "x", 1, 1.0)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    for name, most in (("explain_rows_parts", (2048, 1 << 18)), ("kv_score_parts", (50, 500))):  # whole brands and blocks of them
        monkeypatch.setattr(scoring, "ASKED", most[0])
        monkeypatch.setattr(scoring, "STOCKED", most[1])
        before = moved()
        got = sorted(map(tuple, reference.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
        assert moved() - before < 1_000_000, "pairs of parts were shuffled"  # 150 queries meet 2,572 parts
        assert got == sorted(duckdb.sql(f"WITH part AS (FROM read_parquet('{tmp_path}/part.parquet/*.parquet')) SELECT * FROM ({reference.SQL[name]})").fetchall(), key=str)
    assert {r[0] for r in got} >= {40, 4020} and 4040 not in {r[0] for r in got}


def test_marker_steps_read_the_pairs_twice(spark):
    rows = [("q", f"d{k}", k % 3 / 2, k % 2 / 2, k % 4) for k in range(24)] + [("r", "d1", 0.0, 0.0, 2), ("r", "d2", 0.0, 0.0, 1)]
    pairs = spark.createDataFrame(rows, "query_id string, doc_id string, marker_recall double, marker_precision double, marker_extra int")
    out = matching.narrowed_by_markers(pairs)
    assert {(r["query_id"], r["doc_id"]) for r in out.collect()} == {("q", "d5"), ("q", "d17"), ("r", "d1"), ("r", "d2")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_gate_searches_only_for_queries_without_a_code(spark):
    words = ["наркотики", "наркотиков", "наркотических", "наркотика"]
    rows = [(f"d{k:03}", 0, "Наименование товара", f"тест {words[k % 4]} набор а{k:03}б серия в{k % 9}г{'' if k % 10 else ' ' + words[k % 4]}") for k in range(200)] + [(f"d{k:03}", 1, "Код", f"rx-{100 + k % 100}") for k in range(0, 200, 2)]
    rows += [("d001", 2, "Маркер", "вич"), ("d004", 2, "Маркер", "вич"), ("d002", 2, "Наименование товара", "h1 10"), ("d102", 2, "Наименование товара", "h1 10")]
    df = spark.createDataFrame([(*r, [1.0, k % 5 / 9] + [0.0] * 30) for k, r in enumerate(rows)], f"{ROWS}, embedding array<double>")
    named = written(R.product_names(df), "named")
    keys, vectors = written(gate.gate_keys(df, named), "keys"), written(gate.name_vectors(df, named=named), "vectors")
    asked = lambda x: x.where("doc_id < 'd100'")
    store = spark.sparkContext._jsc.sc().statusStore()
    moved, seen = [], []
    for f in (gate.passed, lambda *x: gate.candidates(gate.name_gate(*x))):
        before = store.executorList(True).apply(0).totalShuffleWrite()
        seen.append(sorted(map(tuple, f(asked(keys), keys, (asked(vectors), vectors)).collect())))
        moved.append(store.executorList(True).apply(0).totalShuffleWrite() - before)
    assert seen[0] == seen[1] and {r[3] for r in seen[0]} == {True, False}
    assert moved[0] < moved[1], moved


def _odd_documents(spark, n=90):
    """(rows with embeddings, document vectors) of documents with names that repeat words, are glued or short, with codes, markers and equal vectors."""
    import random

    r = random.Random(5)
    words = ["тест", "тест-полоски", "анализ", "анализатор", "мочи", "мочи", "для", "набор", "контрольный", "контроль", "кассета", "а1", "кровь", "наркотики", "наркотиков"]
    names = [r.choice(["", " "]).join(r.choices(words, k=r.randint(1, 7))) for _ in range(n)] + ["мочи мочи мочи мочи", "мочи мочи мочи кровь", "мочи кровь набор", "премиум", "премиум"]
    names[7:9] = [names[3] + "ы", names[4]]
    rows = [(f"d{k:03}", 0, "Наименование товара", x) for k, x in enumerate(names)] + [(f"d{k:03}", 1, "Наименование товара", r.choice(names)) for k in range(0, n, 3)]
    rows += [(f"d{k:03}", 2, "Код", f"rx-{100 + k % 17}") for k in range(0, n, 5)] + [(f"d{k:03}", 3, "Прочее", r.choice(["вич", "hbv и вич", "hcv"])) for k in range(0, n, 4)]
    v = lambda: [float(r.randint(-2, 2)) for _ in range(3)] + [1.0] + [0.0] * 28
    docs = [(f"d{k:03}", v()) for k in range(len(names)) if k % 11] + [("d001", v())]
    return spark.createDataFrame([(*x, v() if x[1] == 0 else None) for x in rows], f"{ROWS}, embedding array<double>"), spark.createDataFrame(docs, "doc_id string, v array<double>")


def _blocked(monkeypatch):
    for name, n in {"FEW": 10, "TASKS": 3, "DOCUMENTS": 40, "QUERIES": 30}.items():
        monkeypatch.setattr(gate.blocks, name, n)


def test_gate_in_blocks_against_brute_force(spark, monkeypatch):
    _blocked(monkeypatch)
    df = _odd_documents(spark)[0]
    named = written(R.product_names(df), "named")
    keys, vectors = written(gate.gate_keys(df, named), "keys"), written(gate.name_vectors(df, named=named), "vectors")
    asked = lambda x: x.where("doc_id > 'd045'")
    got = sorted(map(tuple, gate.passed(asked(keys), keys, (asked(vectors), vectors)).collect()))
    assert got == sorted(map(tuple, gate.candidates(gate.name_gate(asked(keys), keys, (asked(vectors), vectors))).collect()))
    a, b = keys.where("kind = 'name'").select(F.col("doc_id").alias("q"), F.col("key").alias("x")), keys.where("kind = 'name'").select(F.col("doc_id").alias("d"), F.col("key").alias("y"))
    same = (F.col("x") == F.col("y")) & ((F.size(gate.X.name_tokens(F.col("x"))) > 0) | (F.length("x") >= 14))
    held = {tuple(r) for r in a.where("q > 'd045'").crossJoin(b).where(same | R.names_contain(F.col("x"), F.col("y"))).select("q", "d").collect()}
    coded = {q for q, _, _, code, *_ in got if code}
    assert {(q, d) for q, d, *f in got if f[3]} == {(q, d) for q, d in held if q not in coded or (q, d) in {(x, y) for x, y, _, code, *_ in got if code}}
    assert len(got) > 300 and coded and len(held) > 300


def test_pairs_of_the_gate_are_not_shuffled(spark):
    rows = [(f"document number {k:05}", 0, "Наименование товара", f"экспресс-тест выявления наркотиков серия а{k}б") for k in range(600)]
    keys = written(gate.gate_keys(spark.createDataFrame(rows, ROWS)), "keys")
    vectors = spark.createDataFrame([], "doc_id string, v array<double>")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(True).apply(0).totalShuffleWrite()
    assert gate.passed(keys, keys, (vectors, vectors)).where("contained and not by_code").count() == 360_000
    assert store.executorList(True).apply(0).totalShuffleWrite() - before < 360_000


def test_candidates_of_the_gate_are_narrowed_in_their_blocks(spark, monkeypatch):
    _blocked(monkeypatch)
    df, docs = _odd_documents(spark)
    keys = written(gate.gate_keys(df), "keys")
    vectors, docs = written(gate.name_vectors(df), "vectors"), written(docs, "docs")
    asked = lambda x: x.where("doc_id > 'd045'")
    marked = lambda x, key: x.where("kind = 'marker'").select(F.col("doc_id").alias(key), F.col("key").alias("marker"))
    count, kept = [], []
    for given in ({}, {"documents": (asked(docs), docs), "most": 2}):
        pairs = written(gate.passed(asked(keys), keys, (asked(vectors), vectors), **given).where("query_id <> doc_id"), "passed")
        count.append(pairs.count())
        told = pairs.join(matching.marker_shares(marked(asked(keys), "query_id"), marked(keys, "doc_id"), pairs), ["query_id", "doc_id"]).withColumn("exact_name", F.col("by_name") | F.col("by_code") | F.col("by_marker") | F.col("contained"))
        gated = gate.narrowed(matching.narrowed_by_markers(told), "exact_name")
        nearest = spark.createDataFrame([], "query_id string, doc_id string, similarity double")
        kept.append(sorted(map(str, matching.gated_candidates(gated, nearest, docs, asked(docs), 2).collect())))
    assert kept[0] == kept[1] and len(kept[0]) > 60
    assert count[1] < count[0] / 2
