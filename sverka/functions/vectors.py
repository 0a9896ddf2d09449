"""Vector functions and exact nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sverka.session import fresh_path


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 if one is all zero, null for different lengths or nulls."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


def normalized(v: Column) -> Column:
    """Unit length; a vector of almost no length stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n <= 1e-12, v).otherwise(F.transform(v, lambda x: x / n))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pos, value: mean of the vectors of each key by place; nulls don't count. Partial sums before the shuffle."""
    flat = df.select(key, F.posexplode(F.col(vector)).alias("pos", "x"))
    return flat.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: the means as vectors."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return centroids(df, key, vector).groupBy(key).agg(F.transform(ordered, lambda s: s["value"]).alias("centroid"))


def fnv1a(token: Column) -> Column:
    """FNV-1a (32 bits) over the UTF-16 units of a token: two for a character beyond the basic plane."""
    hexed = F.hex(F.encode(token, "UTF-16BE"))  # four hexadecimal digits a unit
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(1)), F.lit(4)), lambda k: k < F.length(hexed))
    units = F.transform(at, lambda k: F.conv(F.substring(hexed, k, F.lit(4)), 16, 10).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), step)


def hash_tokens(col: Column) -> Column:
    """Tokens of a text for hashed embeddings: runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """key, slot, weight: sparse unit vectors of hashed tokens; a text without tokens has none."""
    flat = df.select(key, F.explode(hash_tokens(F.col(text))).alias("t")).select(key, fnv1a(F.col("t")).alias("h"))
    counted = flat.groupBy(key, (F.col("h") % dim).alias("slot")).agg(F.sum(F.when(F.col("h").bitwiseAND(F.lit(1).cast("bigint")) == 1, 1).otherwise(-1)).alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counted.select(key, "slot", (F.col("n") / size).alias("weight"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = None, least: float | None = None) -> DataFrame:
    """query, id, similarity: the k nearest vectors by cosine of each query (and group), exact.

    queries, vectors: id (bigint), v (array of numbers of one length), vectors also group.
    The queries are a stated set, written to the shared folder in blocks; every task meets
    all blocks with its part of the vectors and keeps k a query, so what is shuffled is k
    rows a query and task. Similarities under least are dropped; ties go to the smaller id.
    """
    spark = queries.sparkSession
    path = fresh_path(spark, "queries")
    queries.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where("v is not null").write.parquet(path)
    names = ["query", *([group] if group else []), "id", "similarity"]
    kind = f", {group} {vectors.schema[group].dataType.simpleString()}" if group else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        files = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")]
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _unit(batch.column(1)), batch.column(0).to_numpy()
            labels = np.array(batch.column(2).to_pylist(), object) if group else np.zeros(len(ids), int)
            for f in files:
                with system.open_input_file(f) as opened:
                    for block in pq.ParquetFile(opened).iter_batches(1024):
                        sims = np.round(_unit(block.column(1)) @ v.T, 9)
                        q = block.column(0).to_numpy()
                        for label in set(labels):
                            at = np.flatnonzero(labels == label)
                            s = sims[:, at]
                            order = np.lexsort((np.broadcast_to(ids[at], s.shape), -s), axis=1)[:, :k]
                            rows = np.repeat(np.arange(len(q)), order.shape[1])
                            got = s[rows, order.ravel()]
                            keep = got >= least if least is not None else np.ones(len(got), bool)
                            named = [pa.array([label] * int(keep.sum()), batch.schema.field(2).type)] if group else []
                            yield pa.RecordBatch.from_arrays([pa.array(q[rows][keep]), *named, pa.array(ids[at][order.ravel()][keep]), pa.array(got[keep])], names=names)

    flat = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), *([group] if group else [])).where("v is not null")
    found = flat.mapInArrow(run, f"query bigint{kind}, id bigint, similarity double")
    w = Window.partitionBy("query", *([group] if group else [])).orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)
