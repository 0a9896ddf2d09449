"""Matching of query documents with library documents: row joins, scores, ranks, explanations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions import numbers as N
from sverka.functions import text as X
from sverka.session import fresh_path

#: Queries and documents of one gate that a task compares.
ASKED, STOCKED = 2048, 1 << 18


def key_rows(rows: DataFrame) -> DataFrame:
    """Rows that can be criteria: not excluded, with a digit or comparison sign, or of a textual kind of indicator."""
    ind = X.norm_simple(F.col("indicator"))
    stated = F.coalesce("value_raw", F.lit("")).rlike("[0-9]|>=|<=|[≥≤<>]")
    return rows.where(~L.meets(ind, L.EXCLUDED) & (stated | L.meets(ind, L.TEXT_CRITERION)))


def with_features(rows: DataFrame) -> DataFrame:
    """Adds f, all that comparing needs of a value, and ind, the indicator's comparable form: regexes run per row, not per pair."""
    return rows.withColumn("ind", X.norm_simple(F.col("indicator"))).withColumn("f", N.features(F.col("value_raw")))


def matched_rows(queries: DataFrame, library: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, row_ord, indicator of the query rows that some row of the library document satisfies.

    queries: query_id, row_ord, indicator, value_raw; library: doc_id and the same. A pair of
    rows is compared if the indicators are equal or may stand for each other: an equi-join on
    the indicator and alias keys. gate (query_id, doc_id) restricts the document pairs.
    Units must agree; both long composition texts agree by length.
    """
    q, l = with_features(queries), with_features(library)  # noqa: E741
    keyed = lambda df, side: df.withColumn("k", F.explode(F.concat(F.array(F.concat(F.lit("="), "ind")), L.alias_keys(F.col("ind"), side))))
    a = keyed(q, "a").select("query_id", F.col("row_ord").alias("q_ord"), F.col("indicator").alias("q_indicator"), "k", F.col("f").alias("qf"), F.col("value_raw").alias("qv"))
    b = keyed(l, "b").select("doc_id", "k", F.col("f").alias("lf"), F.col("value_raw").alias("lv"))
    if gate is not None:
        a = a.join(gate, "query_id")
        pairs = a.join(b, ["doc_id", "k"])
    else:
        pairs = a.join(b, "k")
    long = (F.col("k") == "composition") & (F.length(F.col("qf.norm")) >= 80) & (F.length(F.col("lf.norm")) >= 80)
    units = N.unit_tokens_match(F.col("qf.norm"), F.col("lf.norm"))
    ok = units & (N.matches(F.col("qf"), F.col("lf")) | long)
    return pairs.where(ok).select("query_id", "doc_id", F.col("q_ord").alias("row_ord"), F.col("q_indicator").alias("indicator")).distinct()


def scores(queries: DataFrame, matched: DataFrame) -> DataFrame:
    """query_id, doc_id, points, total, score of each document pair with a match."""
    total = queries.groupBy("query_id").agg(F.count("*").alias("total"))
    points = matched.groupBy("query_id", "doc_id").agg(F.count("*").alias("points"))
    return points.join(total, "query_id").withColumn("score", F.col("points") / F.col("total"))


def agreeing_values(queries: DataFrame, library: DataFrame, values: list[str], spread: int = 16) -> DataFrame:
    """k, a, b: numbers of the values of column k in the queries that one of the library satisfies. Different values are compared once each."""
    def told(df: DataFrame, name: str) -> DataFrame:
        flat = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(values)))).alias("x")).select("x.*").distinct()
        return flat.select("k", F.xxhash64("v").alias(name), N.features(F.col("v")).alias(f"{name}f"))

    a = told(queries, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    b = told(library, "b").withColumn("part", F.pmod("b", F.lit(spread)).cast("int"))
    return a.join(b, ["k", "part"]).where(N.matches(F.col("af"), F.col("bf"))).select("k", "a", "b")


def best_by_points(queries: DataFrame, library: DataFrame, gate: str, values: list[str]) -> DataFrame:
    """query_id, doc_id, points: of each query the other document of its gate that satisfies most values; of equals the least id. Exact.

    queries, library: id (a whole number, each once), gate and the text columns `values`. An equal
    gate that satisfies itself is a point too; a document without a point is none. Whether
    two values agree is told once for all different values, so a pair of documents is a few
    look-ups, and only the best leaves its task. Documents are met by id: a query that
    has all it can get needs no more of them.
    """
    path, kind = fresh_path(library.sparkSession, "agreeing"), library.schema["id"].dataType
    agreeing_values(queries, library, values).write.parquet(path)
    held = lambda df: df.where(F.col("id").isNotNull() & F.col(gate).isNotNull())
    shape = lambda df, *more: held(df).select(F.xxhash64(gate).alias("gate"), F.col("id").cast("bigint").alias("id"), *(F.xxhash64(c).alias(f"v{k}") for k, c in enumerate(values)), *more)
    own = X.bound(N.features(F.col(gate)), lambda f: F.when(N.matches(f, f), 1).otherwise(0))
    q, l = shape(queries, own.alias("own")), shape(library)  # noqa: E741
    parts = [max(1, -(-(df.groupBy("gate").count().agg(F.max("count")).first()[0] or 0) // most)) for df, most in ((q, ASKED), (l, STOCKED))]
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("i", place(parts[0])).withColumn("j", every(parts[1]))
    l = l.withColumn("j", place(parts[1])).withColumn("i", every(parts[0]))  # noqa: E741
    names = [f"v{k}" for k in range(len(values))]

    def meet(asked: pa.Table, stocked: pa.Table) -> pa.Table:
        from pyarrow import fs

        n, ids, mine = asked.num_rows, stocked["id"].to_numpy(), asked["id"].to_numpy()
        best, found = np.zeros(n, np.uint8), np.zeros(n, np.int64)
        if n and len(ids):
            order = np.argsort(ids)
            ids = ids[order]
            qs = [np.unique(asked[c].to_numpy(), return_inverse=True) for c in names]
            ls = [np.unique(stocked[c].to_numpy()[order], return_inverse=True) for c in names]
            agree = [np.zeros((len(a), len(b)), np.uint8) for (a, _), (b, _) in zip(qs, ls)]
            system, base = fs.FileSystem.from_uri(path)
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.path.endswith(".parquet"):
                    with system.open_input_file(f.path) as opened:
                        for batch in pq.ParquetFile(opened).iter_batches():
                            k, a, b = (batch.column(c).to_numpy() for c in range(3))
                            for at, table in enumerate(agree):
                                x, y = a[k == at], b[k == at]
                                i, j = (np.minimum(np.searchsorted(u, z), len(u) - 1) for u, z in ((qs[at][0], x), (ls[at][0], y)))
                                ok = (qs[at][0][i] == x) & (ls[at][0][j] == y)
                                table[i[ok], j[ok]] = 1
            own = asked["own"].to_numpy().astype(np.uint8)
            most = own + sum(t.any(1)[i].astype(np.uint8) for t, (_, i) in zip(agree, qs))
            itself, left = np.searchsorted(ids, mine), np.flatnonzero(most)
            itself[ids[np.minimum(itself, len(ids) - 1)] != mine] = -1
            for start in range(0, len(ids), 2048):
                if not len(left):
                    break
                points = np.repeat(own[left, None], min(2048, len(ids) - start), 1)
                for t, (_, i), (_, j) in zip(agree, qs, ls):
                    points += t[i[left]][:, j[start : start + 2048]]
                here = itself[left] - start
                same = np.flatnonzero((here >= 0) & (here < points.shape[1]))
                points[same, here[same]] = 0
                first = points.argmax(1)  # of equals the first, so the least id
                got = points[np.arange(len(left)), first]
                more = got > best[left]
                best[left[more]], found[left[more]] = got[more], ids[start + first[more]]
                left = left[best[left] < most[left]]
        kept = best > 0
        return pa.table({"query_id": mine[kept], "doc_id": found[kept], "points": best[kept].astype(np.int64)})

    keys = ["gate", "i", "j"]
    met = q.groupBy(*keys).cogroup(l.groupBy(*keys)).applyInArrow(meet, "query_id bigint, doc_id bigint, points bigint")
    first = met.groupBy("query_id").agg(F.min(F.struct((-F.col("points")).alias("less"), "doc_id")).alias("b"))
    return first.select(F.col("query_id").cast(kind).alias("query_id"), F.col("b.doc_id").cast(kind).alias("doc_id"), (-F.col("b.less")).alias("points"))


def ranked(scored: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The first `most` documents of each query by an order, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def decided(scored: DataFrame, least_percent: float = 30.0, least_points: int = 1) -> DataFrame:
    """Adds percent and decision (match or no_match)."""
    percent = F.when(F.col("total") > 0, F.col("points") * 100.0 / F.col("total")).otherwise(0.0)
    ok = (percent >= least_percent) & (F.col("points") >= least_points)
    return scored.withColumn("percent", percent).withColumn("decision", F.when(ok, "match").otherwise("no_match"))


def narrowed(df: DataFrame, flag: str, key: str = "query_id") -> DataFrame:
    """Of each key the rows with the flag if it has any, else all; a partial aggregation tells which, not a window over the key."""
    met = df.where(F.col(flag)).select(key).distinct()
    with_any = df.join(met.withColumn("_any", F.lit(True)), key, "left")
    return with_any.where(F.col(flag) | F.col("_any").isNull()).drop("_any")


def property_scores(rows: DataFrame) -> DataFrame:
    """doc_id, possible, stated: weight of the property categories a document has, and of those with a number."""
    weight = F.lit(0)
    for name, w in L.WEIGHTS.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    category = X.bound(X.norm_simple(F.col("indicator")), L.category)
    have = rows.select("doc_id", category.alias("category"), F.coalesce("value_raw", F.lit("")).rlike("[0-9]").alias("told")).where("category <> 'other'")
    met = have.groupBy("doc_id", "category").agg(F.bool_or("told").alias("told")).withColumn("w", weight)
    return met.groupBy("doc_id").agg(F.sum("w").alias("possible"), F.sum(F.when(F.col("told"), F.col("w")).otherwise(0)).alias("stated"))


def property_points(queries: DataFrame, library: DataFrame) -> DataFrame:
    """query_id, doc_id, points, possible: weight of the property categories in which a library row satisfies a query row.

    queries: query_id, indicator, value_raw; library: doc_id and the same. Rows meet in
    their category (an equi-join); sensitivities must agree in their unit.
    """
    weight = F.lit(0)
    for name, w in L.WEIGHTS.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    told = lambda df, key: df.select(key, X.bound(X.norm_simple(F.col("indicator")), L.category).alias("category"), N.features(F.col("value_raw")).alias("f")).where("category <> 'other'")
    q, l = told(queries, "query_id"), told(library, "doc_id")  # noqa: E741
    pairs = q.join(l.withColumnRenamed("f", "g"), "category")
    met = pairs.where(N.unit_tokens_match(F.col("f.norm"), F.col("g.norm")) & N.matches(F.col("f"), F.col("g"))).select("query_id", "doc_id", "category").distinct()
    possible = q.select("query_id", "category").distinct().groupBy("query_id").agg(F.sum(weight).alias("possible"))
    return met.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("points")).join(possible, "query_id")
