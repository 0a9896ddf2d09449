"""Queries of the training-data problems on text and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sverka.llm import confusables, grades, listings, mixture, mojibake, neighbours, tokens
from sverka.session import table, written

SQL: dict[str, str] = {}


def _p2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, chunks = (table(spark, sf_dir, t) for t in ("library_docs", "library_rows", "library_chunks"))
    key = lambda order: F.concat_ws("/", F.col("doc_id"), F.col(order).cast("string"))
    found = neighbours.vectors_of(docs, "doc", F.col("doc_id"), "doc_embedding", 32)
    found = found.unionByName(neighbours.vectors_of(rows, "row", key("row_ord"), "embedding", 32))
    return found.unionByName(neighbours.vectors_of(chunks, "chunk", key("chunk_ord"), "embedding", 32))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one is among the other's 5 nearest."""

    near = neighbours.neighbour_pairs(_p2_vectors(spark, sf_dir))
    return near.select("kind", F.least("key", "near_key").alias("key_a"), F.greatest("key", "near_key").alias("key_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled file names and paths with their originals."""
    return mojibake.restore(table(spark, sf_dir, "library_docs"), "doc_id", ["original_filename", "stored_path"])


def _p5_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = confusables.long_fields(table(spark, sf_dir, "library_rows"), "library_rows", "doc_id", "row_ord", ["indicator", "value_raw"])
    chunks = confusables.long_fields(table(spark, sf_dir, "library_chunks"), "library_chunks", "doc_id", "chunk_ord", ["text"])
    return rows.unionByName(chunks)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ from their consistent form, with it."""
    return confusables.consistent_fields(_p5_fields(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ from their consistent form."""
    return p5_forms(spark, sf_dir).select("table_name", "doc_id", "ord", "col_name").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that look the same though their characters differ."""
    return confusables.skeleton_groups(_p5_fields(spark, sf_dir))


def _p6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, spec, aliases = (table(spark, sf_dir, t) for t in ("library_docs", "library_rows", "spec_attributes", "attribute_aliases"))
    read = mojibake.restore(docs, "doc_id", ["original_filename"]).select("doc_id", "restored")
    named = docs.select("doc_id", "original_filename").distinct().join(read, "doc_id", "left").select("doc_id", F.coalesce("restored", "original_filename").alias("file_name"))
    return listings.group_listings(listings.listing_fields(named, rows, spec, aliases))


def p6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of every document."""
    return _p6_products(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that offer the same product."""
    return listings.product_pairs(_p6_products(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"))

def _p9_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null and text <> ''")
    return written(tokens.count_tokens(docs, ["doc_id", "source"]), "sizes")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is repeated."""
    return mixture.mix(_p9_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    sizes, targets = _p9_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixture.shares(mixture.mix(sizes, targets), sizes, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of every document of at least 40 words."""
    return grades.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "grade_ratings")).select("doc_id", "grade")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_forms": p5_forms, "p5_groups": p5_groups, "p6_found": p6_found, "p6_products": p6_products, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}
