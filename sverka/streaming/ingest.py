"""Incremental ingest: new indicator/value rows and texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sverka.operators.extract import guess_rows
from sverka.operators.library import Library


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text of JSON files as they appear in a folder."""
    return spark.readStream.schema("doc_id string, text string").json(folder)


def ingest(texts: DataFrame, library: Library, checkpoint: str) -> StreamingQuery:
    """Appends the rows of arriving texts to a library; each micro-batch is one append."""
    def add(batch: DataFrame, _: int) -> None:
        rows = guess_rows(batch, "doc_id", "text").selectExpr("doc_id", "ord as row_ord", "indicator", "value_raw", "cast(null as string) unit", "cast(null as array<double>) embedding")
        docs = batch.selectExpr("doc_id", "cast(null as bigint) doc_ord", "cast(null as string) original_filename", "cast(null as string) extension", "cast(null as string) stored_path", "cast(null as array<double>) doc_embedding", "cast(null as int) rows_count", "current_timestamp() indexed_at")
        library.add(docs.distinct(), rows)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events and their total value by type in windows of time; events later than `late` don't count."""
    from pyspark.sql import functions as F

    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
