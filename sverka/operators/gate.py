"""Which library documents a query document is compared with at all: by names, codes, markers and name vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.functions import text as X
from sverka.functions import vectors as V
from sverka.operators import blocks
from sverka.operators import rows as R
from sverka.operators.blocks import HELD
from sverka.operators.scoring import narrowed
from sverka.session import written


def gate_keys(rows: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """doc_id, kind (name, code or marker), key: what a document can be found by, each once.

    rows: doc_id, row_ord, indicator, value_raw. named: their product names, if known.
    """
    names = (R.product_names(rows) if named is None else named).select("doc_id", F.lit("name").alias("kind"), F.col("name").alias("key"))
    text = F.concat_ws(" ", "indicator", "value_raw")
    codes = rows.select("doc_id", F.lit("code").alias("kind"), F.explode(R.product_codes(text)).alias("key"))
    markers = rows.select("doc_id", F.lit("marker").alias("kind"), F.explode(R.disease_markers(text)).alias("key"))
    return names.unionByName(codes).unionByName(markers).distinct()


def name_vectors(rows: DataFrame, dim: int = 32, named: DataFrame | None = None) -> DataFrame:
    """doc_id, v (unit length): the embeddings of the rows that tell a document's names, each once.

    rows: doc_id, row_ord, indicator, value_raw, embedding. Vectors of another length, with a
    null, NaN or infinite number or all zero drop out. named: as in gate_keys.
    """
    if named is None:
        named = R.product_names(rows.select("doc_id", "row_ord", "indicator", "value_raw").distinct())
    named = named.select("doc_id", F.col("ord").alias("row_ord")).distinct()
    v = F.col("embedding")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    told = rows.where(fine).select("doc_id", "row_ord", "embedding").join(named, ["doc_id", "row_ord"])
    return told.select("doc_id", V.normalized(v).alias("v")).distinct()


def contained_names(queries: DataFrame, library: DataFrame, cover: float = 0.75) -> DataFrame:
    """query_id, doc_id of the pairs of which one name holds the other (query_id, key; doc_id, key).

    Names are compared once each, by a number for each different name. In one order of all
    words, the rarest first, a name that has `cover` of its words in another must have one of
    its first ones there, so each name's first words meet all words of the others. A name held
    in another as a text, if inside a word, has its rarest piece of HELD letters there. Names of
    three words that share a root meet on it if one of them has a domain word.
    """
    asked, stocked = written(_numbered(queries, "query_id"), "asked-names"), written(_numbered(library, "doc_id"), "stocked-names")
    names = written(_different(queries, library), "names")
    words = names.select("name", F.explode(F.array_distinct(F.transform("f.words", lambda w: F.xxhash64(w)))).alias("word"))  # as numbers; names that meet by chance are compared anyway
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    ranked = words.join(often, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("w"))
    needed = F.floor(F.size("f.words") * (1 - cover)).cast("int") + 1  # of all words: one that stands twice may be missing twice
    first = written(ranked.join(names, "name").select("name", F.explode(F.transform(F.slice("w", F.lit(1), needed), lambda x: x["word"])).alias("word")), "first-words")
    own = lambda df: df.join(asked.select("name").distinct(), "name", "left_semi").withColumnRenamed("name", "one")
    held = own(first).join(words.withColumnRenamed("name", "other"), "word")
    holds = own(words).join(first.withColumnRenamed("name", "other"), "word")
    pieces = names.where(F.length("f.key") >= HELD).select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("f.key") - HELD + 1), lambda i: F.xxhash64(F.substring("f.key", i, F.lit(HELD)))))).alias("word"))
    seldom = pieces.groupBy("word").agg(F.count("*").alias("often"))
    rarest = written(pieces.join(seldom, "word").groupBy("name").agg(F.min(F.struct("often", "word"))["word"].alias("word")), "rarest-pieces")
    cut = own(rarest).join(pieces.withColumnRenamed("name", "other"), "word")
    cuts = own(pieces).join(rarest.withColumnRenamed("name", "other"), "word")
    rooted = written(names.where(F.size("f.words") >= 3).select("name", F.col("f.domain").alias("domain"), F.explode(F.array_distinct("f.roots")).alias("word")), "roots")
    asks = own(rooted).select("one", "word", F.explode(F.when(F.col("domain"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("domain"))
    root = asks.join(rooted.withColumnRenamed("name", "other"), ["word", "domain"]).select("one", "other")  # these need no look at the names
    pairs = reduce(DataFrame.union, (df.select("one", "other") for df in (held, holds, cut, cuts))).distinct()
    met = _met(pairs, names).union(root).distinct()
    found = asked.withColumnRenamed("name", "one").join(met, "one").join(stocked.withColumnRenamed("name", "other"), "other")
    return found.select("query_id", "doc_id").distinct()


def _numbered(df: DataFrame, doc: str) -> DataFrame:
    return df.select(doc, F.xxhash64("key").alias("name"))


def _different(queries: DataFrame, library: DataFrame) -> DataFrame:
    """name, f (features) of each different name."""
    return queries.select("key").union(library.select("key")).distinct().select(F.xxhash64("key").alias("name"), R.name_features(F.col("key")).alias("f"))


def _met(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs of names (one, other) of which one holds the other; a name of no word and few letters doesn't hold itself."""
    told = lambda at, f: names.select(F.col("name").alias(at), F.col("f").alias(f))
    same = (F.col("one") == F.col("other")) & ((F.size("a.words") > 0) | (F.length("a.key") >= HELD))
    return pairs.join(told("one", "a"), "one").join(told("other", "b"), "other").where(same | R.features_contain(F.col("a"), F.col("b"))).select("one", "other")


def near_vectors(queries: DataFrame, library: DataFrame, least: float = 0.82, cells: int = 256, dim: int = 32) -> DataFrame:
    """query_id, doc_id of the pairs with a cosine of at least `least` (query_id, v; doc_id, v of unit length).

    Exact: a library vector lies in the cell of its nearest centre, and by the triangle
    inequality of angles a query meets every cell that can hold a vector near enough.
    Centres are at most `cells` vectors of the library; equal vectors are compared once.
    """
    numbered = lambda df, doc: df.select(doc, F.xxhash64("v").alias("n"))
    different = lambda df: df.select(F.xxhash64("v").alias("n"), "v").dropDuplicates(["n"])
    stored = written(different(library), "gate-vectors")
    centres = np.array([r["v"] for r in stored.orderBy("n").limit(cells).collect()], float).reshape(-1, dim)
    empty = queries.select("query_id").join(library.select("doc_id"), F.lit(False))
    if not len(centres):
        return empty
    angles = lambda part: np.arccos(np.clip(np.array(part["v"].tolist(), float).reshape(-1, dim) @ centres.T, -1, 1))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                a = angles(part)
                yield part.assign(cell=a.argmin(1), angle=a.min(1))

    placed = written(stored.mapInPandas(place, "n bigint, v array<double>, cell int, angle double"), "gate-cells")
    radius = np.full(len(centres), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # at most `cells` rows
        radius[r["cell"]] = r["angle"]
    reach = float(np.arccos(least)) + 1e-6

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                i, c = np.nonzero(angles(part) <= radius + reach)
                yield pd.DataFrame({"one": part["n"].to_numpy()[i], "w": part["v"].to_numpy()[i], "cell": c})

    asked = different(queries).mapInPandas(meet, "one bigint, w array<double>, cell int")
    cosine = reduce(add, (F.col("w")[k] * F.col("v")[k] for k in range(dim)))
    met = asked.join(placed, "cell").where(cosine >= least - 1e-12).select("one", "n")
    found = numbered(queries, "query_id").withColumnRenamed("n", "one").join(met, "one").join(numbered(library, "doc_id"), "n")
    return found.select("query_id", "doc_id").distinct()


def name_gate(queries: DataFrame, library: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, doc_id, by_name, by_code, by_marker, contained, by_vector of the document pairs that pass.

    queries, library: gate_keys with query_id or doc_id; vectors: name_vectors of both, if
    there are any. Equal names, codes and markers are equi-joins on the key; names of which
    one holds the other meet on a rare word, a rare piece or a root and are then compared.
    Nothing is compared with everything.
    """
    q = queries.withColumnRenamed("doc_id", "query_id")
    near = contained_names(_names(q), _names(library))
    return _told(_equal(q, library), near, near_vectors(vectors[0].withColumnRenamed("doc_id", "query_id"), vectors[1]) if vectors else None)


def _names(df: DataFrame) -> DataFrame:
    return df.where("kind = 'name'").drop("kind")


def _equal(q: DataFrame, library: DataFrame) -> DataFrame:
    return q.join(library, ["kind", "key"]).groupBy("query_id", "doc_id").agg(*(F.bool_or(F.col("kind") == k).alias(f"by_{k}") for k in ("name", "code", "marker")))


def _told(equal: DataFrame, near: DataFrame, by_vector: DataFrame | None) -> DataFrame:
    """The flags of all pairs that one of them has."""
    told = equal.join(near.withColumn("contained", F.lit(True)), ["query_id", "doc_id"], "full")
    told = told.withColumn("by_vector", F.lit(False)) if by_vector is None else told.join(by_vector.withColumn("by_vector", F.lit(True)), ["query_id", "doc_id"], "full")
    flags = ["by_name", "by_code", "by_marker", "contained", "by_vector"]
    return told.select("query_id", "doc_id", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))


def candidates(gated: DataFrame) -> DataFrame:
    """Of each query the pairs that count: those by code if there are any, else all that passed."""
    return narrowed(gated, "by_code")


def passed(queries: DataFrame, library: DataFrame, vectors: tuple[DataFrame, DataFrame], least: float = 0.82, dim: int = 32, documents: tuple[DataFrame, DataFrame] | None = None, most: int | None = None) -> DataFrame:
    """candidates(name_gate(...)), told in blocks of queries and documents; the pairs aren't shuffled.

    documents, most: doc_id, v of queries and library; then only pairs of different documents come that can be among
    the `most` of a query after narrowing by markers and by exactness, nearest by these vectors, at a tie the least doc_id.
    """
    codes = lambda df: df.where("kind = 'code'")
    told = codes(queries).join(codes(library).select("key").distinct(), "key", "left_semi").select("doc_id").distinct()
    given = {"name vector": vectors} | ({"document vector": documents} if documents else {})
    return blocks.passed(queries, library, told, given, least, dim, most=most)
