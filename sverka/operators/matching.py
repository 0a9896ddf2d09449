"""Matching of query documents with a library, end to end: candidates, compared rows, ranks, the answer.

The candidates of a query are few (those that the name gate passes, or the nearest by
document vector), so rows are compared per candidate: the work grows with the queries, not
with the square of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions import numbers as N
from sverka.functions import text as X
from sverka.functions import vectors as V
from sverka.operators import scoring
from sverka.session import written

#: Documents compared with a query, similarity of indicators that may be compared, least percent and points of a match.
CANDIDATES, SIMILAR, LEAST_PERCENT, LEAST_POINTS = 8, 0.75, 30.0, 1


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has dim finite numbers that aren't all zero."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def document_vectors(rows: DataFrame, dim: int = 32) -> DataFrame:
    """doc_id, v: the mean of the usable indicator vectors of a document's rows that can be criteria."""
    told = rows.where(usable(F.col("embedding"), dim) & ~L.meets(X.norm_simple(F.col("indicator")), L.EXCLUDED))
    return V.centroid_vectors(told, "doc_id", "embedding").withColumnRenamed("centroid", "v")


def nearest_documents(queries: DataFrame, docs: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, similarity: the `most` documents nearest to each query by cosine, exact; never the query itself.

    queries: doc_id, doc_ord, v, a stated set; docs: the same of the whole library. At a tie
    the smaller doc_ord is nearer. Null vectors drop out.
    """
    found = V.nearest(queries.select(F.col("doc_ord").alias("id"), "v"), docs.select(F.col("doc_ord").alias("id"), "v"), most + 1)
    other = found.where("query <> id").select(F.col("query").alias("q"), F.col("id").alias("l"), "similarity", "rank")
    named = other.join(queries.select(F.col("doc_ord").alias("q"), F.col("doc_id").alias("query_id")), "q").join(docs.select(F.col("doc_ord").alias("l"), "doc_id"), "l")
    return scoring.ranked(named, most, [F.col("rank")]).select("query_id", "doc_id", "similarity")


def gated_candidates(gate: DataFrame, nearest: DataFrame, library: DataFrame, queries: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, similarity: the nearest of a query's gated documents, or of all documents if the gate passes none.

    gate: query_id, doc_id; library and queries: doc_id, v. nearest: as nearest_documents
    gives it. A document without a vector comes last.
    """
    q, l = queries.select(F.col("doc_id").alias("query_id"), F.col("v").alias("a")), library.select("doc_id", F.col("v").alias("b"))  # noqa: E741
    sized = gate.join(q, "query_id", "left").join(l, "doc_id", "left").select("query_id", "doc_id", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("similarity"))
    kept = scoring.ranked(sized, most, [F.desc_nulls_last("similarity"), F.col("doc_id")]).drop("rank")
    rest = nearest.join(gate.select("query_id").distinct(), "query_id", "left_anti")
    return kept.unionByName(rest.select("query_id", "doc_id", "similarity"))


def compared_rows(queries: DataFrame, library: DataFrame, candidates: DataFrame, least: float = SIMILAR, dim: int = 32) -> DataFrame:
    """Every compared pair of rows: query_id, doc_id, q_ord, l_ord, indicator, matched_indicator, value_raw, matched_value, similarity, units, match, reason.

    queries: query_id, row_ord, indicator, value_raw, embedding; library the same with
    doc_id. Two rows of a candidate pair (query_id, doc_id) are compared if their indicators
    are equal or may stand for each other, or if the cosine of their vectors is at least
    `least` (similarity is 1 for equal indicators, null where a vector is missing).
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        ind = X.norm_simple(F.col("indicator"))
        keys = F.concat(F.array(F.concat(F.lit("="), "ind")), L.alias_keys(F.col("ind"), name))
        fine = F.when(usable(F.col("embedding"), dim), F.col("embedding"))
        held = df.withColumn("ind", ind).where(~L.meets(F.col("ind"), L.EXCLUDED))
        return held.select(key, F.struct("row_ord", "indicator", "value_raw", "ind", keys.alias("keys"), fine.alias("v"), N.features(F.col("value_raw")).alias("f")).alias(name))

    pairs = candidates.select("query_id", "doc_id").distinct().join(side(queries, "query_id", "a"), "query_id").join(side(library, "doc_id", "b"), "doc_id")
    near = F.when(F.col("a.ind") == F.col("b.ind"), 1.0).otherwise(V.cosine(F.col("a.v"), F.col("b.v")))
    told = pairs.withColumn("similarity", near).withColumn("alias", F.arrays_overlap("a.keys", "b.keys"))
    told = told.where(F.col("alias") | (F.coalesce("similarity", F.lit(-1.0)) >= least))
    both = F.array_intersect("a.keys", "b.keys")
    long = (F.length("a.f.norm") >= 80) & (F.length("b.f.norm") >= 80) & F.array_contains(both, "composition")
    said = N.values_match(F.col("a.f"), F.col("b.f"))
    out = told.withColumn("m", said).withColumn("long", long)
    return out.select(
        "query_id", "doc_id", F.col("a.row_ord").alias("q_ord"), F.col("b.row_ord").alias("l_ord"), F.col("a.indicator").alias("indicator"), F.col("b.indicator").alias("matched_indicator"),
        F.col("a.value_raw").alias("value_raw"), F.col("b.value_raw").alias("matched_value"), "similarity", N.unit_tokens_match(F.col("a.f.norm"), F.col("b.f.norm")).alias("units"),
        (F.col("m.match") | F.col("long")).alias("match"), F.when(~F.col("m.match") & F.col("long"), "composition long-text fallback").otherwise(F.col("m.reason")).alias("reason"),
    )


def scored(queries: DataFrame, compared: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, points, total, score, similarity, indicators (of the satisfied criteria, in order) of every candidate."""
    keys = scoring.key_rows(queries).select("query_id", F.col("row_ord").alias("q_ord")).distinct()
    total = keys.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = compared.where("match and units").join(keys, ["query_id", "q_ord"], "left_semi").groupBy("query_id", "doc_id", "q_ord").agg(F.min("indicator").alias("indicator"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("q_ord", "indicator"))), lambda x: x["indicator"])  # a query's criteria at most
    points = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("points"), ordered.alias("indicators"))
    out = candidates.join(total, "query_id", "left").join(points, ["query_id", "doc_id"], "left").withColumn("points", F.coalesce("points", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    return out.withColumn("score", F.when(F.col("total") > 0, F.col("points") / F.col("total")).otherwise(0.0))


#: What ranks the candidates of a query, after score and points; a missing column doesn't count.
ORDER = ["marker_recall", "marker_precision", "exact_name", "name_similarity", "similarity"]


def best_documents(scored_docs: DataFrame) -> DataFrame:
    """The best candidate of each query by score, points, markers, names, vectors and id, with percent and decision."""
    told = [F.desc_nulls_last(c) for c in ORDER if c in scored_docs.columns]
    best = scoring.ranked(scored_docs, 1, [F.desc("score"), F.desc("points"), *told, F.col("doc_id")]).drop("rank")
    return scoring.decided(best, LEAST_PERCENT, LEAST_POINTS)


def best_rows(compared: DataFrame, best: DataFrame) -> DataFrame:
    """query_id, doc_id, q_ord and the library row that explains it best: the most similar one that satisfies it, else the most similar one.

    Only of the best document. Similarity ties go to the earlier row.
    """
    own = compared.join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    place = F.struct(F.col("match").cast("int").alias("m"), F.coalesce("similarity", F.lit(-1.0)).alias("s"), (-F.col("l_ord")).alias("o"))
    kept = F.struct("l_ord", "indicator", "matched_indicator", "value_raw", "matched_value", "similarity", "match", "reason")
    return own.groupBy("query_id", "doc_id", "q_ord").agg(F.max_by(kept, place).alias("r")).select("query_id", "doc_id", "q_ord", "r.*")


def answers(best: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, answer: the answer to each query as JSON text, with the rows that were satisfied.

    docs: doc_id, original_filename, stored_path, extension, one row each.
    """
    fields = {"indicator": "indicator", "queryValueRaw": "value_raw", "matchedLibraryIndicator": "matched_indicator", "matchedLibraryValueRaw": "matched_value", "indicatorSimilarity": "similarity", "valueMatch": "match", "valueReason": "reason"}
    one = F.struct("q_ord", *(F.col(c).alias(n) for n, c in fields.items()))
    told = rows.where("match").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(*(x[n].alias(n) for n in fields))).alias("rowResults"))
    out = best.join(told, "query_id", "left").join(docs.select("doc_id", "original_filename", "stored_path", "extension"), "doc_id", "left")
    found = F.col("decision") == "match"
    match = F.struct(F.col("doc_id").alias("id"), F.col("original_filename").alias("originalFilename"), F.col("stored_path").alias("storedPath"), "extension", "score", F.col("percent").alias("matchPercent"), F.col("points").alias("matchedCount"), F.col("total").alias("totalCount"))
    answer = F.struct(
        F.lit(True).alias("ok"), "decision", F.col("score").alias("bestScore"), F.col("percent").alias("matchPercent"), F.col("points").alias("matchedCount"), F.col("total").alias("totalCount"),
        F.col("original_filename").alias("bestMatchFilename"), F.coalesce("rowResults", F.array().cast(told.schema["rowResults"].dataType)).alias("rowResults"), F.when(found, F.array(match)).otherwise(F.array()).alias("matches"),
    )
    return out.select("query_id", F.to_json(answer, {"ignoreNullFields": "false"}).alias("answer"))


def marker_shares(queries: DataFrame, library: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, doc_id, marker_recall, marker_precision, marker_extra of document pairs.

    queries: query_id, marker; library: doc_id, marker, each pair once: sets of a few fixed markers.
    """
    a = queries.groupBy("query_id").agg(F.collect_set("marker").alias("qm"))
    b = library.groupBy("doc_id").agg(F.collect_set("marker").alias("lm"))
    none = F.array().cast("array<string>")
    held = pairs.select("query_id", "doc_id").join(a, "query_id", "left").join(b, "doc_id", "left").withColumn("qm", F.coalesce("qm", none)).withColumn("lm", F.coalesce("lm", none))
    shared = F.size(F.array_intersect("qm", "lm"))
    share = lambda n: F.when(n > 0, shared / n).otherwise(0.0)
    return held.select("query_id", "doc_id", share(F.size("qm")).alias("marker_recall"), share(F.size("lm")).alias("marker_precision"), (F.size("lm") - shared).alias("marker_extra"))


def narrowed_by_markers(pairs: DataFrame) -> DataFrame:
    """Of each query's pairs with shared markers those of greatest recall, then greatest precision, then fewest others; all if none shares any.

    Decided on the different shares of a query, which are few; no window over a query's pairs,
    and the pairs are read twice, however many steps there are.
    """
    columns = ["query_id", "marker_recall", "marker_precision", "marker_extra"]
    shares = pairs.select(columns).distinct()
    for column, most in (("marker_recall", True), ("marker_precision", True), ("marker_extra", False)):
        shares = written(shares, "marker-shares")
        best = shares.groupBy("query_id").agg((F.max if most else F.min)(column).alias("_best"), F.max("marker_recall").alias("_any"))
        near = F.col(column) >= F.col("_best") - 1e-9 if most else F.col(column) <= F.col("_best")
        shares = shares.join(best, "query_id").where((F.col("_any") <= 0) | near).drop("_best", "_any")
    return pairs.join(shares, columns, "left_semi")
