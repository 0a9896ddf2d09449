"""From specification files to rows: every kind of file by its reader and the producers for it."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.operators import extract
from sverka.operators import rows as R
from sverka.session import written
from sverka.sources import files as S


def word_parts(files: DataFrame) -> DataFrame:
    """path, text, xml of the .docx files; a damaged file gives no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    got.append((path, S.docx_text(bytes(content)), "\n".join(x for _, x in S.docx_xml(bytes(content)))))
                except (zipfile.BadZipFile, KeyError, ValueError):
                    continue
            yield pd.DataFrame(got, columns=["path", "text", "xml"])

    return files.where("extension = '.docx'").select("path", "content").mapInPandas(run, "path string, text string, xml string")


def word_rows(parts: DataFrame) -> DataFrame:
    """doc_id, indicator, value_raw, producer, ord of word-processor documents (path, text, xml).

    The rows of tables come first, where an empty value continues the indicator before, then
    tokens that say yes with their indicator, then all that the text tells.
    """
    tables = extract.carry_forward(extract.word_table_rows(parts, "path", "xml")).where(R.acceptable(F.col("indicator"), F.col("value_raw")))
    present = extract.presence_pairs(extract.word_tokens(parts, "path", "xml"))
    ranked = [x.select("doc_id", "indicator", "value_raw", F.col("pos").alias("ord")) for x in (tables, present)]
    text = extract.document_rows(parts.select(F.col("path").alias("doc_id"), "text"), "doc_id", "text")
    return extract.union_first([*ranked, text.select("doc_id", "indicator", "value_raw", (F.col("producer") * F.lit(1 << 32) + F.col("ord")).alias("ord"))])


def file_rows(files: DataFrame, parsers: dict[str, S.Parser] | None = None) -> DataFrame:
    """doc_id (the path), indicator, value_raw, each pair once a file, of the files (path, extension, content).

    Sheets and word-processor files are read here; .doc, .pdf and .xls need a parser that
    gives their text. A file without a parser, a damaged one and one that tells nothing
    give no row.
    """
    sheets = extract.sheet_rows(S.sheet_cells(files).withColumnRenamed("path", "doc_id")).select("doc_id", "indicator", "value_raw")
    words = word_rows(written(word_parts(files), "word-parts")).select("doc_id", "indicator", "value_raw")
    out = sheets.unionByName(words)
    others = {e: p for e, p in (parsers or {}).items() if e not in (".docx", ".xlsx")}
    if others:
        ext = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
        texts = written(S.file_texts(files.where(F.col("extension").isin(list(others))), others), "file-texts").select(F.col("path").alias("doc_id"), "text", ext.alias("extension"))
        for kind, fits in (("pdf", F.col("extension") == ".pdf"), ("doc", F.col("extension") != ".pdf")):
            told = extract.document_rows(texts.where(fits).select("doc_id", "text"), "doc_id", "text", kind)
            out = out.unionByName(told.select("doc_id", "indicator", "value_raw"))
    return out.distinct()
