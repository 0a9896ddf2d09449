"""Specification files as DataFrames: office files parsed with the standard library, others by injected parsers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sverka.functions.text import safe_extension

#: Files that are read at all, and their largest size by default.
EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx"]
LARGEST = 25 * 1024 * 1024
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Parser = Callable[[bytes], str]


def spec_files(spark: SparkSession, folder: str, largest: int | None = LARGEST) -> DataFrame:
    """path, extension, content of the readable files below a folder that aren't larger than largest (None: of any size)."""
    df = _listed(spark, folder)
    fine = F.lit(True) if largest is None else F.col("length") <= largest
    return df.where(fine & F.col("extension").isin(EXTENSIONS)).select("path", "extension", "content")


def skipped_files(spark: SparkSession, folder: str, largest: int | None = LARGEST) -> DataFrame:
    """path, length, reason of the files that spec_files leaves out; their content isn't read."""
    df = _listed(spark, folder)
    reason = F.when(~F.col("extension").isin(EXTENSIONS), "unsupported type")
    if largest is not None:
        reason = reason.when(F.col("length") > largest, "too large")
    return df.select("path", "length", reason.alias("reason")).where("reason is not null")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.withColumn("extension", F.coalesce(safe_extension(F.col("path")), F.lit("")))


def docx_xml(content: bytes) -> list[tuple[str, str]]:
    """(part name, markup) of the word/*.xml parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().startswith("word/") and n.lower().endswith(".xml")]


def docx_text(content: bytes) -> str:
    """Text of all parts, paragraphs and table rows as lines, tabs kept."""
    texts = []
    for _, xml in docx_xml(content):
        s = re.sub(r"(?i)<w:tab/>", "\t", xml)
        s = re.sub(r"(?i)<w:br[^>]*/>|</w:p>|</w:tr>", "\n", s)
        s = re.sub(r"<[^>]+>", " ", s)
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
            s = s.replace(entity, c)
        if s.strip():
            texts.append(re.sub(r"[ \t]{2,}", " ", s))
    return "\n".join(texts).strip()


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number from 0, cells as text) of every row of every sheet; gaps are empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si"):
                shared.append(_string(si))
        for sheet in _sheets(z, names):
            for k, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row")):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "s" and value is not None:
                        cells.append(shared[int(value.text)])
                    elif kind == "inlineStr":
                        cells.append("".join(_string(i) for i in c.iter(f"{_S}is")))
                    else:
                        cells.append(value.text or "" if value is not None else "")
                yield sheet, k, cells


def _string(item) -> str:
    """Text of a string item: its own text or that of its runs, without phonetic hints."""
    return "".join(t.text or "" for part in item if part.tag in (f"{_S}t", f"{_S}r") for t in ([part] if part.tag == f"{_S}t" else part.iter(f"{_S}t")))


def _sheets(z: zipfile.ZipFile, names: set[str]) -> list[str]:
    """Parts of the sheets in the order of the workbook; without one in the order of their numbers."""
    found = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (int((re.search(r"(\d+)\.xml$", n) or ["", "0"])[1]), n))
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        return found
    target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    order = [target.get(s.get(_RELATION), "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    parts = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in order]
    return [p for p in parts if p in found] + [n for n in found if n not in parts]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return max(0, n - 1)


def sheet_cells(files: DataFrame) -> DataFrame:
    """path, sheet, row, cells of the .xlsx files; a damaged file gives no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    got = [(path, s, k, c) for s, k, c in xlsx_rows(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError):
                    continue
                yield pd.DataFrame(got, columns=["path", "sheet", "row", "cells"]).astype({"row": "int32"})

    return files.where("extension = '.xlsx'").select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def file_texts(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, text: text of .docx files, of .xlsx files (cells joined by bars), and of others by the given parsers.

    A file without a parser, a damaged one and one its parser fails on give no row.
    """
    known: dict[str, Parser] = {".docx": docx_text, ".xlsx": lambda b: "\n".join(" | ".join(c) for _, _, c in xlsx_rows(b))} | (parsers or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for path, ext, content in zip(part["path"], part["extension"], part["content"]):
                if ext in known:
                    try:
                        got.append((path, known[ext](bytes(content))))
                    except Exception:  # a parser may fail in any way on a damaged file
                        continue
            yield pd.DataFrame(got, columns=["path", "text"])

    return files.select("path", "extension", "content").mapInPandas(run, "path string, text string")


def index_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, rows) of an index stored as one JSON file; a missing or damaged one is empty."""
    inner = "array<struct<id:string,originalFilename:string,extension:string,storedPath:string,docEmbedding:array<double>,rowsCount:int,rows:array<struct<indicator:string,valueRaw:string,unit:string,embedding:array<double>>>,indexedAt:string>>"
    schema = f"version int, createdAt string, docs {inner}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    raw = spark.read.schema(schema).json(path, multiLine=True) if there else spark.createDataFrame([], schema)
    flat = raw.select(F.posexplode("docs").alias("doc_ord", "d"))
    docs = flat.select(F.col("d.id").alias("doc_id"), F.col("doc_ord").cast("bigint"), F.col("d.originalFilename").alias("original_filename"), F.col("d.extension").alias("extension"), F.col("d.storedPath").alias("stored_path"), F.col("d.docEmbedding").alias("doc_embedding"), F.coalesce("d.rowsCount", F.size("d.rows")).alias("rows_count"), F.try_to_timestamp("d.indexedAt").alias("indexed_at"))
    rows = flat.select(F.col("d.id").alias("doc_id"), F.posexplode("d.rows").alias("row_ord", "r")).select("doc_id", "row_ord", F.col("r.indicator").alias("indicator"), F.col("r.valueRaw").alias("value_raw"), F.col("r.unit").alias("unit"), F.col("r.embedding").alias("embedding"))
    return docs, rows


def rest_items(df: DataFrame, body: str) -> DataFrame:
    """Answers of a listing service: elements of data, or of a bare array, that have text _id and name."""
    item = "array<struct<_id:string,name:string,orderName:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object(body, "$.data"), item), F.from_json(F.col(body), item))
    return df.select(F.explode(listed).alias("i")).select("i.*").where("_id is not null and name is not null")


def rest_orders(df: DataFrame, body: str) -> DataFrame:
    """_id, orderName of an answer's elements under tenders, or of a bare array, that have one of the two; the other is empty."""
    item = "array<struct<_id:string,orderName:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object(body, "$.tenders"), item), F.from_json(F.col(body), item))
    fine = df.select(F.explode(listed).alias("i")).select("i.*").where("_id is not null or orderName is not null")
    return fine.select(F.coalesce("_id", F.lit("")).alias("_id"), F.coalesce("orderName", F.lit("")).alias("orderName"))


def rest_item(df: DataFrame, body: str) -> DataFrame:
    """href, max_price, attachments of an answer about one item, each on the top level or under data."""
    path = lambda name: F.coalesce(F.get_json_object(body, f"$.{name}"), F.get_json_object(body, f"$.data.{name}"))
    files = F.from_json(path("attachments"), "array<struct<realName:string,href:string>>")
    return df.select(path("href").alias("href"), path("maxPrice").try_cast("double").alias("max_price"), F.coalesce(files, F.array().cast("array<struct<realName:string,href:string>>")).alias("attachments"))
