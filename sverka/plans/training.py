"""Queries of the general training-data problems: 1, 4 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sverka.functions.forms import trimmed
from sverka.operators import attributes, packed, units, wide
from sverka.session import table


def _attribute_rows(spark: SparkSession, sf_dir: str, value_types: list[str]) -> DataFrame:
    return attributes.attribute_rows(*(table(spark, sf_dir, t) for t in ("library_rows", "spec_attributes", "attribute_aliases")), value_types)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list attributes that hold at least two, each with its position."""
    rows = _attribute_rows(spark, sf_dir, ["list"]).dropDuplicates(["doc_id", "row_ord", "value_raw"])
    return packed.unpack(rows, least=2).select("doc_id", "row_ord", "pos", trimmed(F.col("item")).alias("item"))


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, a typed column per attribute that is stated."""
    kinds = ["text", "list", "integer", "decimal", "flag", "date", "code", "quantity"]
    rows = _attribute_rows(spark, sf_dir, kinds)
    return wide.widen(rows, wide.discover(rows, table(spark, sf_dir, "spec_attributes")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled cells of the wide table for integers, decimals, flags, dates and codes."""
    rows = _attribute_rows(spark, sf_dir, ["integer", "decimal", "flag", "date", "code"])
    columns = wide.discover(rows, table(spark, sf_dir, "spec_attributes"))
    return wide.cells(wide.widen(rows, columns), columns)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of quantity rows in the attribute's base unit, in thousandths; null if no bigint holds them."""
    found = units.amounts(_attribute_rows(spark, sf_dir, ["quantity"]).distinct())
    return found.select("doc_id", "row_ord", "base_unit", F.round(F.col("amount") * 1000).try_cast("bigint").alias("amount_milli"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_wide": p4_wide, "p7_found": p7_found}

SQL: dict[str, str] = {}
