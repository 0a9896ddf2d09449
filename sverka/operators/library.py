"""The library of documents and rows as parquet tables: list, add, delete, clear."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id string, doc_ord bigint, original_filename string, extension string, stored_path string, doc_embedding array<double>, rows_count int, indexed_at timestamp"
ROWS = "doc_id string, row_ord int, indicator string, value_raw string, unit string, embedding array<double>"


def listing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents without vectors, each once; a missing row count is counted."""
    counted = rows.select("doc_id", "row_ord").distinct().groupBy("doc_id").agg(F.count("*").cast("int").alias("counted"))
    own = docs.select("doc_id", "original_filename", "extension", "rows_count").distinct()
    return own.join(counted, "doc_id", "left").select("doc_id", "original_filename", "extension", F.coalesce("rows_count", "counted", F.lit(0)).alias("rows_count"))


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that aren't among gone (doc_id)."""
    return df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def ids_of(paths: DataFrame) -> DataFrame:
    """doc_id and file_name of stored files named <uuid>-<name>; a file without an id gets a new one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    got = F.regexp_extract(name, r"^([0-9a-fA-F-]{36})-(.+)$", 1)
    rest = F.regexp_extract(name, r"^([0-9a-fA-F-]{36})-(.+)$", 2)
    return paths.withColumn("doc_id", F.coalesce(F.nullif(got, F.lit("")), F.expr("uuid()"))).withColumn("file_name", F.coalesce(F.nullif(rest, F.lit("")), name))


class Library:
    """Two tables in one folder. Adding appends; deleting writes the rest beside and moves a pointer, so readers see old or new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        jvm, fs = self._hadoop()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        return self.spark.read.text(f"{self.path}/current").first()[0] if fs.exists(at) else None

    def _point(self, version: str) -> None:
        """Writes the pointer beside and renames it, so no reader sees a part of it."""
        jvm, fs = self._hadoop()
        path = jvm.org.apache.hadoop.fs.Path
        beside, current = path(f"{self.path}/current-{uuid.uuid4().hex}"), path(f"{self.path}/current")
        stream = fs.create(beside, True)
        stream.write(version.encode())
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(files.makeQualified(beside), files.makeQualified(current), overwrite)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(docs, rows); a missing library is an empty one."""
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], DOCS), self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(DOCS).parquet(f"{self.path}/{version}/docs"), self.spark.read.schema(ROWS).parquet(f"{self.path}/{version}/rows")

    def add(self, docs: DataFrame, rows: DataFrame) -> None:
        version = self._current() or uuid.uuid4().hex
        rows.select(*(c.split(" ")[0] for c in ROWS.split(", "))).write.mode("append").parquet(f"{self.path}/{version}/rows")
        docs.select(*(c.split(" ")[0] for c in DOCS.split(", "))).write.mode("append").parquet(f"{self.path}/{version}/docs")
        self._point(version)

    def replace(self, docs: DataFrame, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        docs.write.parquet(f"{self.path}/{version}/docs")
        rows.write.parquet(f"{self.path}/{version}/rows")
        self._point(version)

    def delete(self, gone: DataFrame) -> None:
        docs, rows = self.read()
        self.replace(without(docs, gone), without(rows, gone))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], DOCS), self.spark.createDataFrame([], ROWS))
