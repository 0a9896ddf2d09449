"""Queries of matching end to end: every document whose number is divisible by 20 against the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions.regexes import quoted, re2
from sverka.operators import gate, matching
from sverka.plans import oracle as D
from sverka.plans.reference import _gate_keys, _same_sql
from sverka.session import table, written

_USABLE = "coalesce(len({0}) = 32 AND len(list_filter({0}, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter({0}, lambda z: z <> 0)) > 0, false)"
_PERCENT, _NG_ML = quoted(re2("%|процент|{b}percent{b}")), quoted("ng/?ml|нг/?мл")
_HAS = {p: tuple(f"regexp_matches({s}norm, {p})" for s in "ql") for p in (_PERCENT, _NG_ML)}
_UNITS = "CASE " + " ".join(f"WHEN {a} OR {b} THEN {a} = {b}" for a, b in _HAS.values()) + " ELSE true END"
_ALIAS = _same_sql().replace("(x,", "(q.i,").replace("(y,", "(l.i,")
_LONG = f"length(qnorm) >= 80 AND length(lnorm) >= 80 AND {L.meets_sql('q.i', L.CLASSES['composition'])} AND {L.meets_sql('l.i', L.CLASSES['composition'])}"
_MATCHED = f"""WITH d AS (SELECT DISTINCT doc_id, doc_ord, doc_embedding AS e FROM library_docs WHERE {_USABLE.format("doc_embedding")}),
  c AS (SELECT q.doc_id AS query_id, d.doc_id, round(list_cosine_similarity(q.e, d.e), 9) AS similarity FROM d q JOIN d ON q.doc_ord % 20 = 0 AND q.doc_ord <> d.doc_ord
    QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY similarity DESC, d.doc_ord) <= 8),
  m AS (SELECT * FROM (SELECT doc_id, row_ord, indicator, value_raw AS v, {D.simple("indicator")} AS i, {D.squeezed("value_raw")} AS s, CASE WHEN {_USABLE.format("embedding")} THEN embedding END AS e
    FROM (SELECT DISTINCT doc_id, row_ord, indicator, value_raw, embedding FROM library_rows)) WHERE NOT {L.meets_sql("i", L.EXCLUDED)}),
  q AS (SELECT doc_id, row_ord, indicator, v, i, e, (regexp_matches(coalesce(v, ''), '[0-9]|>=|<=|[≥≤<>]') OR {L.meets_sql("i", L.TEXT_CRITERION)}) AS key, {D.features("v", "q").replace("qs", "s")} FROM m WHERE doc_id IN (SELECT query_id FROM c)),
  l AS (SELECT doc_id, row_ord, indicator, v, i, e, {D.features("v", "l").replace("ls", "s")} FROM m WHERE doc_id IN (SELECT doc_id FROM c)),
  x AS (SELECT c.query_id, c.doc_id, c.similarity AS ds, q.row_ord AS q_ord, l.row_ord AS l_ord, q.key, q.indicator, l.indicator AS matched_indicator, q.v AS value_raw, l.v AS matched_value, {_UNITS} AS units, {_LONG} AS long,
    CASE WHEN q.i = l.i THEN 1.0::DOUBLE ELSE list_cosine_similarity(q.e, l.e) END AS similarity, {D.match_reason("q", "l")} AS r
    FROM c JOIN q ON q.doc_id = c.query_id JOIN l ON l.doc_id = c.doc_id WHERE q.i = l.i OR {_ALIAS} OR coalesce(list_cosine_similarity(q.e, l.e), -1) >= 0.75::DOUBLE),
  y AS (SELECT *, r[1] = '1' OR long AS match, CASE WHEN r[1] <> '1' AND long THEN 'composition long-text fallback' ELSE substr(r, 3) END AS reason FROM x),
  t AS (SELECT doc_id AS query_id, count(DISTINCT row_ord) AS total FROM q WHERE key GROUP BY 1),
  p AS (SELECT query_id, doc_id, count(DISTINCT q_ord) AS points FROM y WHERE match AND units AND key GROUP BY ALL),
  k AS (SELECT query_id, doc_id, similarity, coalesce(points, 0) AS points, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) > 0 THEN coalesce(points, 0) / total ELSE 0.0::DOUBLE END AS score
    FROM c LEFT JOIN t USING (query_id) LEFT JOIN p USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, points DESC, similarity DESC, doc_id) = 1)"""


def _documents(spark, d) -> tuple[DataFrame, DataFrame]:
    """(queries, library): doc_id, doc_ord, v of the documents with a usable vector."""
    docs = table(spark, d, "library_docs").where(matching.usable(F.col("doc_embedding"), 32)).select("doc_id", "doc_ord", F.col("doc_embedding").alias("v")).distinct()
    return docs.where("doc_ord % 20 = 0"), docs


def _rows(spark, d, docs: DataFrame) -> DataFrame:
    """The different rows of given documents (doc_id); semi-joined first, so that rows are shuffled once, by document."""
    return table(spark, d, "library_rows").select("doc_id", "row_ord", "indicator", "value_raw", "embedding").join(docs, "doc_id", "left_semi").distinct()


def _compared(spark, d, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query rows, compared rows) of the candidates."""
    rows = _rows(spark, d, candidates.select("doc_id"))
    asked = _rows(spark, d, candidates.select(F.col("query_id").alias("doc_id"))).withColumnRenamed("doc_id", "query_id")
    return asked, written(matching.compared_rows(asked, rows, candidates), "compared")


def _nearest(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, best, compared rows) by the document vectors alone."""
    candidates = written(matching.nearest_documents(*_documents(spark, d)), "candidates")
    asked, compared = _compared(spark, d, candidates)
    return candidates, written(matching.best_documents(matching.scored(asked, compared, candidates)), "best"), compared


def match_documents_docs(spark, d) -> DataFrame:
    """The library document that satisfies each query document best, of the eight nearest by vector."""
    return _nearest(spark, d)[1].select("query_id", "doc_id", "points", "total", F.round("percent", 6).alias("percent"), "decision")


def match_rows_docs(spark, d) -> DataFrame:
    """The row of the best document that explains each query row best."""
    _, best, compared = _nearest(spark, d)
    rows = matching.best_rows(compared, best)
    return rows.select("query_id", "doc_id", "q_ord", "matched_indicator", "matched_value", "match", "reason")


def _gated(spark, d) -> tuple[DataFrame, DataFrame]:
    """(best, compared rows) of the candidates that names, codes, markers and name vectors pass; the nearest where none do."""
    asked, library = _documents(spark, d)
    mine, keys, vectors = _gate_keys(spark, d)
    placed = lambda df: df.select("doc_id", "v").join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
    passed = written(gate.passed(mine, keys, vectors, documents=(placed(asked), placed(library)), most=matching.CANDIDATES), "passed")
    markers = lambda df, key: df.where("kind = 'marker'").select(F.col("doc_id").alias(key), F.col("key").alias("marker"))
    shares = matching.marker_shares(markers(mine, "query_id"), markers(keys, "doc_id"), passed)
    told = written(passed.join(shares, ["query_id", "doc_id"]).withColumn("exact_name", F.col("by_name") | F.col("by_code") | F.col("by_marker") | F.col("contained")), "told")
    gated = written(gate.narrowed(matching.narrowed_by_markers(told), "exact_name"), "gated")
    near = matching.nearest_documents(asked, library)
    candidates = written(matching.gated_candidates(gated, near, library, asked), "candidates")
    own, compared = _compared(spark, d, candidates)
    extra = gated.select("query_id", "doc_id", "marker_recall", "marker_precision", F.col("exact_name").cast("int").alias("exact_name"))
    scored = matching.scored(own, compared, candidates).join(extra, ["query_id", "doc_id"], "left")
    return written(matching.best_documents(scored), "best"), compared


def match_answers_docs(spark, d) -> DataFrame:
    """The whole way: gate, candidates, compared rows, ranks, and the answer to each query as JSON."""
    best, compared = _gated(spark, d)
    docs = table(spark, d, "library_docs").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("original_filename", "stored_path", "extension")))
    return matching.answers(best, matching.best_rows(compared, best), docs)


QUERIES = {"match_documents_docs": match_documents_docs, "match_rows_docs": match_rows_docs, "match_answers_docs": match_answers_docs}
SQL = {
    "match_documents_docs": f"{_MATCHED} SELECT query_id, doc_id, points, total, round(points * 100.0::DOUBLE / greatest(total, 1), 6) AS percent, CASE WHEN total > 0 AND points * 100.0 / total >= 30 AND points >= 1 THEN 'match' ELSE 'no_match' END AS decision FROM k",
    "match_rows_docs": f"{_MATCHED} SELECT query_id, doc_id, q_ord, matched_indicator, matched_value, match, reason FROM y SEMI JOIN k USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, q_ord ORDER BY match DESC, coalesce(similarity, -1) DESC, l_ord) = 1",
}
