"""Queries of the specification-matching operators and the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sverka.functions import lexicon as L
from sverka.functions import numbers as N
from sverka.functions import text as X
from sverka.functions import vectors as V
from sverka.functions.regexes import quoted, re2
from sverka.operators import extract, gate, library, scoring
from sverka.operators import rows as R
from sverka.operators.order import next_rows
from sverka.plans import oracle as D
from sverka.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- text ------------------------------------------------------------------------------


@query(f"SELECT doc_id, {D.light('text')} AS norm FROM documents")
def norm_light_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.norm_light(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, row_ord, {D.simple('indicator')} AS ind, {D.simple('value_raw')} AS val FROM library_rows")
def norm_simple_rows(spark, d):
    return table(spark, d, "library_rows").select("doc_id", "row_ord", X.norm_simple(F.col("indicator")).alias("ind"), X.norm_simple(F.col("value_raw")).alias("val"))


@query()
def norm_heavy_rows(spark, d):
    return table(spark, d, "library_rows").select("doc_id", "row_ord", X.norm_heavy(F.col("value_raw")).alias("val"))


@query(f"SELECT doc_id, len({D.tokens('text')}) AS n, len(list_distinct({D.tokens('text')})) AS n_distinct FROM documents")
def tokenize_docs(spark, d):
    counts = X.bound(X.tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct")))
    return table(spark, d, "documents").select("doc_id", counts.alias("c")).select("doc_id", "c.*")


@query(f"SELECT doc_id, {D.html('text')} AS plain FROM documents")
def strip_html_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_html(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {D.entities('text')} AS decoded FROM documents")
def decode_entities_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.decode_entities(F.col("text")).alias("decoded"))


@query()
def repair_latin1_names(spark, d):
    return table(spark, d, "library_docs").select("doc_id", X.repair_latin1(F.col("original_filename")).alias("name"), X.repair_latin1(F.col("stored_path")).alias("path"))


@query(f"SELECT doc_id, lower(regexp_extract(original_filename, '[^/.](\\.[^./]+)$', 1)) AS ext, {D.hint('original_filename')} AS hint FROM library_docs")
def file_name_hints(spark, d):
    return table(spark, d, "library_docs").select("doc_id", X.safe_extension(F.col("original_filename")).alias("ext"), X.filename_hint(F.col("original_filename")).alias("hint"))


_CELL = lambda p: f"list_filter(list_transform({p}, lambda y: {D.trim('y')}), lambda y: y <> '')"


@query(f"""SELECT doc_id, row_ord, array_to_string(c, '¦') AS cells, len(c) AS n FROM (SELECT doc_id, row_ord,
  CASE WHEN contains(value_raw, '|') THEN {_CELL("string_split(value_raw, '|')")} WHEN contains(value_raw, chr(9)) THEN {_CELL("string_split(value_raw, chr(9))")}
  WHEN len({_CELL("string_split_regex(value_raw, ' {2,}')")}) >= 2 THEN {_CELL("string_split_regex(value_raw, ' {2,}')")} ELSE [] END AS c FROM library_rows WHERE value_raw IS NOT NULL)""")
def split_cells_rows(spark, d):
    df = table(spark, d, "library_rows").where("value_raw is not null").select("doc_id", "row_ord", X.split_delims(F.col("value_raw")).alias("c"))
    return df.select("doc_id", "row_ord", F.array_join("c", "¦").alias("cells"), F.size("c").alias("n"))


_LABEL = quoted(re2(r"(?s)^(.+?){ws}+(\d[\d{nws},./]*.*)$"))
_LEFT, _RIGHT = D.trim(f"regexp_extract(s, {_LABEL}, 1)"), D.trim(f"regexp_extract(s, {_LABEL}, 2)")


@query(f"""SELECT doc_id, row_ord, a AS label, b AS value FROM (SELECT doc_id, row_ord, s, {_LEFT} AS a, {_RIGHT} AS b FROM (SELECT doc_id, row_ord, {D.trim("value_raw")} AS s FROM library_rows))
  WHERE length(s) >= 4 AND length(a) >= 3 AND b <> '' AND NOT regexp_matches({D.rep("b", "{ws}", "")}, '^0+$')""")
def label_number_rows(spark, d):
    df = table(spark, d, "library_rows").select("doc_id", "row_ord", X.label_number(F.col("value_raw")).alias("p"))
    return df.where("p is not null").select("doc_id", "row_ord", "p.label", "p.value")


@query(f"""SELECT doc_id, pos, p[1] AS label, p[2] AS value FROM (SELECT doc_id, (pos - 1)::INT AS pos, string_split(line, ':')[1:2] AS p FROM
  (SELECT doc_id, unnest({D.lines("text")}) AS line, generate_subscripts({D.lines("text")}, 1) AS pos FROM documents)) WHERE len(p) = 2""")
def colon_parts_docs(spark, d):
    flat = table(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return flat.withColumn("p", X.colon_parts(F.col("line"))).where(F.size("p") == 2).select("doc_id", "pos", F.col("p")[0].alias("label"), F.col("p")[1].alias("value"))


@query()
def chunk_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("chunk", "text"))


@query(f"""SELECT doc_id, row_ord, max(n) AS quantity FROM (SELECT doc_id, row_ord, unnest(list_transform(regexp_extract_all(lower(value_raw), {quoted(re2("(?:упак(?:овк[аеуи])?|в упаковке|№){ws}*[№#]?{ws}*([0-9]{1,4}){b}"))}, 1), lambda x: x::INT)) AS n
  FROM (SELECT DISTINCT doc_id, row_ord, value_raw FROM library_rows)) WHERE n > 0 GROUP BY ALL""")
def pack_quantity_rows(spark, d):
    df = table(spark, d, "library_rows").select("doc_id", "row_ord", X.pack_quantity(F.col("value_raw")).alias("quantity"))
    return df.where("quantity is not null").distinct()


# ---- numbers and values ----------------------------------------------------------------


@query(f"""SELECT doc_id, row_ord, len(n) AS n, n[1] AS first, list_max(n) AS most, list_min(n) AS least FROM (SELECT doc_id, row_ord, {D.nums("value_raw")} AS n FROM library_rows)""")
def parse_numbers_rows(spark, d):
    df = table(spark, d, "library_rows").select("doc_id", "row_ord", N.numbers(F.col("value_raw")).alias("n"))
    return df.select("doc_id", "row_ord", F.size("n").alias("n"), F.get("n", 0).alias("first"), F.array_max("n").alias("most"), F.array_min("n").alias("least"))


_LO, _HI = D.bounds("s")


@query(f"""SELECT doc_id, row_ord, CASE WHEN isinf(lo) THEN NULL ELSE lo END AS low, CASE WHEN isinf(hi) THEN NULL ELSE hi END AS high FROM
  (SELECT doc_id, row_ord, {_LO} AS lo, {_HI} AS hi FROM (SELECT doc_id, row_ord, {D.squeezed("value_raw")} AS s FROM library_rows)) WHERE lo IS NOT NULL""")
def ranges_rows(spark, d):
    df = table(spark, d, "library_rows").select("doc_id", "row_ord", N.value_range(F.col("value_raw")).alias("r")).where("r is not null")
    end = lambda x: F.when(F.abs(F.col(x)) < float("inf"), F.col(x))
    return df.select("doc_id", "row_ord", end("r.min").alias("low"), end("r.max").alias("high"))


@query(f"""WITH p AS (SELECT doc_id, row_ord, value_raw AS qv, lead(value_raw) OVER (PARTITION BY indicator ORDER BY doc_id, row_ord) AS lv FROM (SELECT DISTINCT doc_id, row_ord, indicator, value_raw FROM library_rows)),
  s AS (SELECT *, {D.squeezed("qv")} AS qs, {D.squeezed("lv")} AS ls FROM p), f AS (SELECT doc_id, row_ord, {D.features("qv", "q")}, {D.features("lv", "l")} FROM s WHERE lv IS NOT NULL),
  r AS (SELECT doc_id, row_ord, {D.match_reason("q", "l")} AS r FROM f) SELECT doc_id, row_ord, r[1] = '1' AS match, substr(r, 3) AS reason FROM r""")
def values_match_rows(spark, d):
    """Each value against the next one of its indicator."""
    rows = table(spark, d, "library_rows").select("doc_id", "row_ord", "indicator", F.col("value_raw").alias("v")).distinct()
    both = next_rows(rows, "indicator", "doc_id", "row_ord").where("b.v is not null")
    pairs = both.select("a.doc_id", "a.row_ord", N.features(F.col("a.v")).alias("q"), N.features(F.col("b.v")).alias("l"))
    return pairs.select("doc_id", "row_ord", N.values_match(F.col("q"), F.col("l")).alias("m")).select("doc_id", "row_ord", "m.match", "m.reason")


@query(f"""WITH c AS (SELECT doc_id, chunk_ord, text, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_ord) AS after FROM (SELECT DISTINCT doc_id, chunk_ord, text FROM library_chunks)),
  t AS (SELECT doc_id, chunk_ord, list_distinct({D.tokens("text")}) AS a, list_distinct({D.tokens("after")}) AS b FROM c WHERE after IS NOT NULL)
  SELECT doc_id, chunk_ord, round({D.jaccard("a", "b")}, 6) AS share FROM t""")
def jaccard_chunks(spark, d):
    chunks = table(spark, d, "library_chunks").select("doc_id", "chunk_ord", "text").distinct()
    both = next_rows(chunks, "doc_id", "chunk_ord").where("b.text is not null")
    sets = both.select("a.doc_id", "a.chunk_ord", F.array_distinct(X.tokens(F.col("a.text"))).alias("a"), F.array_distinct(X.tokens(F.col("b.text"))).alias("b"))
    return sets.select("doc_id", "chunk_ord", F.round(N.jaccard(F.col("a"), F.col("b")), 6).alias("share"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_retailprice <> 0 THEN abs(l_extendedprice / l_quantity - p_retailprice) / abs(p_retailprice) ELSE abs(l_extendedprice / l_quantity) END <= 0.1::DOUBLE AS near
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0""")
def tolerance_prices(spark, d):
    item = table(spark, d, "lineitem").where("l_quantity <> 0").join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    gap = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))
    near = F.when(F.col("p_retailprice") != 0, gap / F.abs("p_retailprice")).otherwise(F.abs(F.col("l_extendedprice") / F.col("l_quantity"))) <= 0.1
    return item.select("l_orderkey", "l_linenumber", near.alias("near"))


# ---- vectors ---------------------------------------------------------------------------

_COS = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9)"
_VECS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"""{_VECS} SELECT query, id, round(s, 6) AS similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
  FROM e a, e b WHERE a.vec_id % 20 = 0) WHERE rank <= 8""")
def cosine_topk(spark, d):
    """The 8 nearest of all vectors for every vector whose id is divisible by 20."""
    v = _vectors(spark, d)
    return V.nearest(v.where("id % 20 = 0"), v, 8).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""{_VECS} SELECT query, label, id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query, b.label, b.vec_id AS id, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY {_COS} DESC, b.vec_id) AS rank
  FROM e a, e b WHERE a.vec_id % 20 = 0) WHERE rank = 1""")
def best_per_label(spark, d):
    """The best partner in each label."""
    v = _vectors(spark, d)
    return V.nearest(v.where("id % 20 = 0"), v, 1, group="label").select("query", "label", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""{_VECS} SELECT label, p - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1)::INT AS p FROM e) GROUP BY ALL""")
def centroid_by_label(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query(f"""{_VECS}, c AS (SELECT label, list(value ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) GROUP BY ALL) GROUP BY label)
  SELECT vec_id, label, rank, round(s, 6) AS similarity FROM (SELECT a.vec_id, a.label, {_COS} AS s, row_number() OVER (PARTITION BY a.label ORDER BY {_COS} DESC, a.vec_id) AS rank FROM e a JOIN c b ON a.label = b.label) WHERE rank <= 300""")
def prefilter_rows(spark, d):
    """The 300 vectors of each label nearest to its centroid (a top-k report)."""
    e = table(spark, d, "embeddings")
    joined = e.join(V.centroid_vectors(e, "label", "embedding"), "label").withColumn("s", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 9))
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    return joined.withColumn("rank", F.row_number().over(w)).where("rank <= 300").select("vec_id", "label", "rank", F.round("s", 6).alias("similarity"))


_HTOK = "list_filter(string_split_regex(lower(coalesce(p_name, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619::BIGINT) & 4294967295::BIGINT)"


@query(f"SELECT p_partkey, t AS token, {_FNV} AS h FROM (SELECT p_partkey, unnest(list_distinct({_HTOK})) AS t FROM part)")
def fnv_tokens_part(spark, d):
    flat = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(V.hash_tokens(F.col("p_name")))).alias("token"))
    return flat.withColumn("h", V.fnv1a(F.col("token")))


@query(f"""WITH n AS (SELECT p_partkey, h % 384 AS slot, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END) AS n FROM (SELECT p_partkey, {_FNV} AS h FROM (SELECT p_partkey, unnest({_HTOK}) AS t FROM part)) GROUP BY ALL),
  v AS (SELECT p_partkey, slot, n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)) AS w FROM n)
  SELECT a.p_partkey, round(sum(a.w * b.w), 6) AS similarity FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 1 AND a.slot = b.slot GROUP BY a.p_partkey""")
def hash_similarity_part(spark, d):
    """Similarity of the hashed names of neighbouring parts, as a sparse join."""
    v = V.hash_embedding(table(spark, d, "part"), "p_partkey", "p_name")
    other = v.select((F.col("p_partkey") - 1).alias("p_partkey"), "slot", F.col("weight").alias("w"))
    return v.join(other, ["p_partkey", "slot"]).groupBy("p_partkey").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("similarity"))


# ---- predicates ------------------------------------------------------------------------

_IND = D.simple("indicator")
_RAW = "coalesce(value_raw, '')"


@query(f"""SELECT doc_id, row_ord, {L.class_mask_sql("i")} AS mask, {L.meets_sql("i", L.TEXT_CRITERION)} AS textual, regexp_matches({_RAW}, '[0-9]|>=|<=|[≥≤<>]') AS stated,
  regexp_matches(v, '%|процент|\\bpercent\\b') AS percent, regexp_matches(v, 'ng/?ml|нг/?мл') AS ng_ml FROM (SELECT doc_id, row_ord, value_raw, {_IND} AS i, {D.simple("value_raw")} AS v FROM library_rows)""")
def predicates_rows(spark, d):
    i, v = X.norm_simple(F.col("indicator")), X.norm_simple(F.col("value_raw"))
    df = table(spark, d, "library_rows").select("doc_id", "row_ord", "value_raw", i.alias("i"), v.alias("v"))
    stated = F.coalesce("value_raw", F.lit("")).rlike("[0-9]|>=|<=|[≥≤<>]")
    return df.select("doc_id", "row_ord", L.class_mask(F.col("i")).alias("mask"), L.meets(F.col("i"), L.TEXT_CRITERION).alias("textual"), stated.alias("stated"), N.has_percent(F.col("v")).alias("percent"), N.has_ng_ml(F.col("v")).alias("ng_ml"))


@query(f"SELECT category, count(*) AS n FROM (SELECT {L.category_sql('i')} AS category FROM (SELECT {_IND} AS i FROM library_rows)) GROUP BY ALL")
def indicator_categories(spark, d):
    df = table(spark, d, "library_rows").select(X.norm_simple(F.col("indicator")).alias("i"))
    return df.select(L.category(F.col("i")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _same_sql() -> str:
    both = [f"({L.meets_sql('x', L.CLASSES[c])} AND {L.meets_sql('y', L.CLASSES[c])})" for c in L.SAME]
    kit = lambda z: f"({L.meets_sql(z, L.CLASSES['kitting'])} OR {L.meets_sql(z, L.CLASSES['pack_quantity'])})"
    count = lambda z: L.meets_sql(z, L.CLASSES["test_count"])
    return " OR ".join([*both, f"({count('x')} AND {kit('y')})", f"({kit('x')} AND {count('y')})"])


@query(f"SELECT a.alias AS one, b.alias AS other FROM (SELECT DISTINCT alias, {D.simple('alias')} AS x FROM attribute_aliases) a, (SELECT DISTINCT alias, {D.simple('alias')} AS y FROM attribute_aliases) b WHERE {_same_sql()}")
def alias_pairs(spark, d):
    """Spellings that may stand for each other, by an equi-join on class keys."""
    al = table(spark, d, "attribute_aliases").select("alias").distinct().withColumn("i", X.norm_simple(F.col("alias")))
    one = al.select(F.col("alias").alias("one"), F.explode(L.alias_keys(F.col("i"), "a")).alias("k"))
    other = al.select(F.col("alias").alias("other"), F.explode(L.alias_keys(F.col("i"), "b")).alias("k"))
    return one.join(other, "k").select("one", "other").distinct()


@query()
def acceptable_rows(spark, d):
    i, v = F.col("indicator"), F.coalesce("value_raw", F.lit(""))
    return table(spark, d, "library_rows").select("doc_id", "row_ord", R.acceptable(i, v).alias("acceptable"), R.could_be_name(v).alias("name"), R.beside_name(v).alias("beside"))


# ---- names, codes, markers -------------------------------------------------------------


def _distinct_rows(spark, d):
    return table(spark, d, "library_rows").select("doc_id", "row_ord", "indicator", "value_raw").distinct()


@query()
def product_names_docs(spark, d):
    return R.product_names(_distinct_rows(spark, d))


@query()
def name_gate_docs(spark, d):
    """Every document whose number is divisible by 20 against all others, by names, codes, markers and the vectors of name rows."""
    mine, keys, vectors = _gate_keys(spark, d)
    return gate.passed(mine, keys, vectors).where("query_id <> doc_id")


def _gate_keys(spark, d):
    """(keys of the queries, keys of all documents, name vectors of both)."""
    rows = table(spark, d, "library_rows").select("doc_id", "row_ord", "indicator", "value_raw")  # names and keys come once each, rows that stand twice don't matter
    named = written(R.product_names(rows), "named")
    keys = written(gate.gate_keys(rows, named), "gate-keys")
    vectors = written(gate.name_vectors(table(spark, d, "library_rows"), named=named), "name-vectors")
    asked = table(spark, d, "library_docs").where("doc_ord % 20 = 0").select("doc_id").distinct()
    return keys.join(asked, "doc_id", "left_semi"), keys, (vectors.join(asked, "doc_id", "left_semi"), vectors)


_CODE = quoted(re2("({b}[a-zа-яё]{1,8}[-_ ]?[a-zа-яё]?[0-9]{2,5}(?:[-_ ]?[0-9]{1,5})?{b})"))


@query(f"""SELECT code, count(*) AS docs FROM (SELECT DISTINCT doc_id, code FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(coalesce(value_raw, '')), {_CODE}, 1)), '[ _]+', '-', 'g') AS code FROM library_rows)
  WHERE length(replace(code, '-', '')) >= 4) GROUP BY code""")
def product_codes_docs(spark, d):
    flat = table(spark, d, "library_rows").select("doc_id", F.explode(R.product_codes(F.col("value_raw"))).alias("code")).distinct()
    return flat.groupBy("code").agg(F.count("*").alias("docs"))


_MARK = " UNION ".join(f"SELECT doc_id, '{m}' AS marker FROM library_rows WHERE regexp_matches(lower(coalesce(value_raw, '')), {quoted(re2(p))})" for m, p in R.MARKERS.items())


@query(_MARK)
def disease_markers_docs(spark, d):
    return table(spark, d, "library_rows").select("doc_id", F.explode(R.disease_markers(F.col("value_raw"))).alias("marker")).distinct()


@query(f"""WITH m AS ({_MARK}), s AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1), src AS (SELECT DISTINCT source, marker FROM m JOIN (SELECT DISTINCT doc_id, regexp_extract(stored_path, '^(.*?)[^/]*$', 1) AS source FROM library_docs WHERE stored_path IS NOT NULL) USING (doc_id)), c AS (SELECT source, count(*) AS size FROM src GROUP BY 1),
  h AS (SELECT m.doc_id, src.source, count(*) AS hits FROM m JOIN src USING (marker) GROUP BY 1, 2), r AS (SELECT doc_id, source, hits / n AS recall, hits / size AS precision, size - hits AS extra FROM h JOIN s USING (doc_id) JOIN c USING (source)),
  a AS (SELECT * FROM r QUALIFY recall = max(recall) OVER (PARTITION BY doc_id)), b AS (SELECT * FROM a QUALIFY precision = max(precision) OVER (PARTITION BY doc_id))
  SELECT doc_id, source, round(recall, 6) AS recall, round(precision, 6) AS precision, extra FROM b QUALIFY extra = min(extra) OVER (PARTITION BY doc_id)""")
def marker_cascade(spark, d):
    """The folders whose markers cover a document's best: by recall, then precision, then least extra. Documents of equal marker sets are one class."""
    m = disease_markers_docs(spark, d)
    sets = m.groupBy("doc_id").agg(F.sort_array(F.collect_set("marker")).alias("own"))  # of the few fixed markers
    folders = table(spark, d, "library_docs").where("stored_path is not null").select("doc_id", F.regexp_extract("stored_path", "^(.*?)[^/]*$", 1).alias("source")).distinct()
    src = m.join(folders, "doc_id").groupBy("source").agg(F.collect_set("marker").alias("theirs"))
    classes = sets.select("own").distinct().withColumn("marker", F.explode("own")).join(src.withColumn("marker", F.explode("theirs")), "marker").select("own", "source", "theirs").distinct()
    shared = F.size(F.array_intersect("own", "theirs"))
    r = classes.select("own", "source", (shared / F.size("own")).alias("recall"), (shared / F.size("theirs")).alias("precision"), (F.size("theirs") - shared).cast("bigint").alias("extra"))
    for name, best in (("recall", F.max), ("precision", F.max), ("extra", F.min)):
        r = r.withColumn("best", best(name).over(Window.partitionBy("own"))).where(F.col(name) == F.col("best")).drop("best")
    return sets.join(r, "own").select("doc_id", "source", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "extra")


# Texts that hold cases no given table has; they go beside the whole tables.
_CASES = [
    "Изделие предназначено: тест предназначен для анализатора мочи Олвита 5, Дельмар",
    "Полоска предназначена для использования\nЦветная шкала содержит 12 цветовых полей. Состав: буфер",
    "Набор к анализаторам  Тавера Лайт; калибратор для анализатора X1.\nНазначение: предназначен всем",
]
_CASE_SQL = ", ".join(f"({-k - 1}, {quoted(t)})" for k, t in enumerate(_CASES))


def _and_cases(df, key: str):
    """doc_id, text of a table with the cases under negative keys."""
    own = df.select(F.col(key).alias("doc_id"), "text")
    kind = own.schema["doc_id"].dataType
    return own.unionByName(df.sparkSession.createDataFrame([(-k - 1, t) for k, t in enumerate(_CASES)], "doc_id bigint, text string").select(F.col("doc_id").cast(kind), "text"))


_ANALYZER = quoted(re2(extract.ANALYZER))


@query(f"""SELECT doc_id, analyzer FROM (SELECT DISTINCT doc_id, {D.trim("a")} AS analyzer FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_ANALYZER}, 1)) AS a
  FROM (SELECT doc_id, text FROM library_chunks UNION ALL SELECT k::VARCHAR, t FROM (VALUES {_CASE_SQL}) c(k, t)))) WHERE length(analyzer) >= 2""")
def analyzers_docs(spark, d):
    return extract.analyzers(_and_cases(table(spark, d, "library_chunks"), "doc_id"), "doc_id", "text")


# ---- extraction ------------------------------------------------------------------------


def _all(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), {quoted(re2(pattern))}, {group})"


_JOINED = "SELECT DISTINCT doc_id || '/' || row_ord AS k, concat_ws(' ', indicator, value_raw) AS text FROM library_rows"


def _row_texts(spark, d):
    return _distinct_rows(spark, d).select(F.concat_ws("/", "doc_id", "row_ord").alias("k"), F.concat_ws(" ", "indicator", "value_raw").alias("text")).distinct()


@query(f"SELECT DISTINCT k, 'Количество в упаковке' AS indicator, n || ' шт.' AS value_raw FROM (SELECT k, unnest({_all('text', extract.PACK)} || {_all('text', extract.PACK_BEFORE)})::INT AS n FROM ({_JOINED})) WHERE n > 0")
def pack_quantities_rows(spark, d):
    return extract.pack_quantities(_row_texts(spark, d), "k", "text").drop("ord")


@query(f"SELECT DISTINCT k, 'Размер иглы, G' AS indicator, n || ' G' AS value_raw FROM (SELECT k, unnest({_all('text', extract.GAUGE)})::INT AS n FROM ({_JOINED})) WHERE n > 0")
def needle_gauges_rows(spark, d):
    return extract.needle_gauges(_row_texts(spark, d), "k", "text").drop("ord")


def _sens(indicator: str, pattern: str) -> str:
    return f"""SELECT DISTINCT k, '{indicator}' AS indicator, regexp_replace(n::DECIMAL(20,6)::VARCHAR, '\\.?0+$', '') || ' ' || CASE WHEN coalesce(u, '') = '' THEN 'нг/мл' ELSE {D.rep("u", "{ws}", "")} END AS value_raw FROM
      (SELECT k, try_cast(replace(unnest({_all("text", pattern, 1)}), ',', '.') AS DOUBLE) AS n, unnest({_all("text", pattern, 2)}) AS u FROM ({_JOINED})) WHERE n > 0"""


@query(_sens("Аналитическая чувствительность (концентрация)", extract.ANALYTIC) + " UNION ALL " + _sens("Минимальная определяемая концентрация", extract.MINIMUM))
def sensitivities_rows(spark, d):
    return extract.sensitivities(_row_texts(spark, d), "k", "text").drop("ord")


@query(f"SELECT DISTINCT doc_id, n::VARCHAR AS value_raw FROM (" + " UNION ALL ".join(f"SELECT doc_id, {_all('text', p)}[1]::INT AS n FROM documents" for p in extract.COLOURS).replace("FROM documents", f"FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {_CASE_SQL})") + ") WHERE n > 0")
def colour_scales_docs(spark, d):
    return extract.colour_scales(_and_cases(table(spark, d, "documents"), "doc_id"), "doc_id", "text").select("doc_id", "value_raw")


_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), {quoted(re2(p))}) THEN '{m}' END" for m, p in extract.INFECTIONS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT k, array_to_string(m, '; ') AS value_raw FROM (SELECT k, {_NAMED} AS m FROM ({_JOINED})) WHERE len(m) >= 2")
def infections_rows(spark, d):
    return extract.infections(_row_texts(spark, d), "k", "text").select("k", "value_raw")


_LOWROW = "lower(concat_ws(' ', coalesce(indicator, ''), coalesce(value_raw, '')))"
_FLAGS = ", ".join(f"bool_or(regexp_matches(t, {quoted(re2(p))})) AS m{k}" for k, (_, p) in enumerate(extract.MATERIALS))


@query(f"""WITH f AS (SELECT doc_id, {_FLAGS}, bool_or(regexp_matches(t, {quoted(re2(extract.BLOOD))})) AS blood, bool_or(contains(t, 'моч')) AS urine FROM (SELECT doc_id, {_LOWROW} AS t FROM library_rows) GROUP BY doc_id)
  """ + " UNION ALL ".join([f"SELECT doc_id, '{m}' AS value_raw FROM f WHERE m{k}" for k, (m, _) in enumerate(extract.MATERIALS)] + ["SELECT doc_id, 'Цельная кровь' AS value_raw FROM f WHERE blood AND NOT urine"]))
def materials_docs(spark, d):
    return extract.materials(table(spark, d, "library_rows"))


@query(f"""SELECT doc_id, line FROM (SELECT doc_id, unnest({D.lines("text")}) AS line FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {_CASE_SQL})) WHERE length(line) >= 20 AND regexp_matches(lower(line), 'предназначен')
  AND regexp_matches(line, 'анализатор|визуал|моч[аи]|тест|полоск|использован') AND NOT regexp_matches(lower(line), '^(?:описани[ея]|наименование товара|колич|время|состав|хранить)')""")
def purpose_lines_docs(spark, d):
    return extract.purposes(_and_cases(table(spark, d, "documents"), "doc_id"), "doc_id", "text").select("doc_id", F.col("value_raw").alias("line"))


@query()
def document_rows_docs(spark, d):
    """All producers over every document."""
    return extract.document_rows(table(spark, d, "documents"), "doc_id", "text")


@query()
def pdf_rows_docs(spark, d):
    """The producers of plain pages over every document."""
    return extract.document_rows(table(spark, d, "documents"), "doc_id", "text", "pdf")


@query()
def presence_pairs_rows(spark, d):
    return extract.presence_pairs(extract.doc_lines(_distinct_rows(spark, d)))


_DESC = quoted(re2(extract.DESCRIPTION))


@query(f"SELECT DISTINCT doc_id, value_raw FROM (SELECT doc_id, {D.trim(D.rep('v', '{ws}+', ' '))} AS value_raw FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_DESC}, 1)) AS v FROM documents)) WHERE length(value_raw) >= 20")
def descriptions_docs(spark, d):
    return extract.descriptions(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "value_raw")


_PAIR = "SELECT DISTINCT doc_id, pos, line FROM (SELECT doc_id, row_ord * 2 AS pos, {a} AS line FROM library_rows UNION ALL SELECT doc_id, row_ord * 2 + 1, {b} FROM library_rows) WHERE line <> '' AND line <> chr(92)".format(a=D.trim("coalesce(indicator, '')"), b=D.trim("coalesce(value_raw, '')"))
_LABELS = ", ".join(f"'{x}'" for x in extract.LABELS)


@query(f"""WITH l AS ({_PAIR}) SELECT doc_id, pos, line AS indicator, after AS value_raw FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l) WHERE after IS NOT NULL AND {D.simple("line")} IN ({_LABELS})""")
def label_next_line_rows(spark, d):
    return extract.label_next_line(extract.doc_lines(_distinct_rows(spark, d)))


def _name_sql(x: str) -> str:
    n = D.heavy(x)
    short = ", ".join(quoted(w) for w in R.NO_NAME_SHORT)
    return f"(length({n}) >= 3 AND NOT regexp_matches({n}, '^[0-9]+$') AND NOT regexp_matches({n}, {quoted('|'.join(R.NO_NAME))}) AND NOT (length({n}) <= 12 AND {n} IN ({short})))"


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({_PAIR})), h AS (SELECT doc_id, n FROM l WHERE regexp_matches(lower(line), {quoted(re2("наименование{ws}+товар"))}))
  SELECT DISTINCT a.doc_id, a.pos, a.line AS value_raw FROM l a JOIN h ON a.doc_id = h.doc_id AND a.n > h.n AND a.n - h.n <= 19 WHERE length(a.line) >= 6 AND {_name_sql("a.line")}
  AND NOT EXISTS (SELECT 1 FROM l s WHERE s.doc_id = a.doc_id AND s.n > h.n AND s.n <= a.n AND regexp_matches(lower(s.line), '{extract.NAME_STOP}'))
  AND h.n = (SELECT max(n) FROM h g WHERE g.doc_id = a.doc_id AND g.n < a.n)""")
def names_ahead_rows(spark, d):
    return extract.names_ahead(extract.doc_lines(_distinct_rows(spark, d)))


@query("""WITH r AS (SELECT doc_id, row_ord AS pos, indicator AS first, coalesce(value_raw, '') AS value FROM (SELECT DISTINCT doc_id, row_ord, indicator, value_raw FROM library_rows)),
  c AS (SELECT *, last_value(CASE WHEN length(value) >= 2 THEN first END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
  SELECT doc_id, pos, CASE WHEN length(value) < 2 AND before IS NOT NULL THEN before ELSE first END AS indicator, CASE WHEN length(value) < 2 AND before IS NOT NULL THEN concat_ws(' ' || chr(10) || ' ', first, nullif(value, '')) ELSE value END AS value_raw FROM c""")
def carry_forward_rows(spark, d):
    cells = _distinct_rows(spark, d).select("doc_id", F.col("row_ord").alias("pos"), F.col("indicator").alias("first"), F.coalesce("value_raw", F.lit("")).alias("value"))
    return extract.carry_forward(cells)


_PART = D.trim("raw")


@query(f"""WITH p AS (SELECT k, {_PART} AS s FROM (SELECT k, unnest(string_split_regex(text, '[;\\n\\r]+')) AS raw FROM (SELECT DISTINCT doc_id || '/' || chunk_ord AS k, coalesce(text, '') AS text FROM library_chunks))),
  c AS (SELECT k, s, instr(s, ':') AS place, {D.trim("substr(s, 1, instr(s, ':') - 1)")} AS l, {D.trim("substr(s, instr(s, ':') + 1)")} AS r, {_LEFT} AS a, {_RIGHT} AS b FROM p)
  SELECT k, indicator, value_raw, count(*) AS n FROM (SELECT k, l AS indicator, r AS value_raw FROM c WHERE place > 1 AND place <= 120 AND l <> '' AND r <> ''
  UNION ALL SELECT k, a, b FROM c WHERE NOT (place > 1 AND place <= 120 AND l <> '' AND r <> '') AND length(s) >= 4 AND length(a) >= 3 AND b <> '' AND NOT regexp_matches({D.rep("b", "{ws}", "")}, '^0+$')) GROUP BY ALL""")
def spec_blob_chunks(spark, d):
    texts = table(spark, d, "library_chunks").select(F.concat_ws("/", "doc_id", "chunk_ord").alias("k"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return extract.spec_blob(texts, "k", "text").groupBy("k", "indicator", "value_raw").agg(F.count("*").alias("n"))


def _blob_sql(pattern: str) -> str:
    whole = quoted("(?i)" + re2(pattern))
    part = lambda g: f"regexp_extract(text, {whole}, {g})"
    return f"SELECT k, {D.trim(part(1))} AS indicator, {part(2)} || ' ' || {part(3)} AS value_raw FROM ({_JOINED}) WHERE regexp_matches(text, {whole})"


@query(f"{_blob_sql(extract.BLOB_QUANTITY)} UNION ALL {_blob_sql(extract.BLOB_VOLUME)}")
def blob_numbers_rows(spark, d):
    return extract.blob_numbers(_row_texts(spark, d), "k", "text").drop("ord")


@query(f"""WITH t AS ({_JOINED}), g AS (SELECT DISTINCT k, 'Количество в упаковке' AS indicator, n || ' шт.' AS value_raw, 0 AS p FROM (SELECT k, unnest({_all("text", extract.PACK)})::INT AS n FROM t) WHERE n > 0
  UNION ALL SELECT DISTINCT k, 'Размер иглы, G', n || ' G', 1 FROM (SELECT k, unnest({_all("text", extract.GAUGE)})::INT AS n FROM t) WHERE n > 0
  UNION ALL SELECT k, 'Выявление маркеров инфекционных заболеваний', array_to_string(m, '; '), 2 FROM (SELECT k, {_NAMED} AS m FROM t) WHERE len(m) >= 2) SELECT k, indicator, value_raw, min(p) AS producer FROM g GROUP BY ALL""")
def union_first_rows(spark, d):
    texts = _row_texts(spark, d)
    parts = [extract.pack_quantities(texts, "k", "text"), extract.needle_gauges(texts, "k", "text"), extract.infections(texts, "k", "text").withColumn("ord", F.lit(0))]
    return extract.union_first(parts, "k").drop("ord")


@query()
def guess_rows_docs(spark, d):
    return extract.guess_rows(table(spark, d, "documents"), "doc_id", "text")


_TABLE = "<table><tr><th>Показатель</th><td>Значение</td></tr><tr><td>Объем&nbsp;пробы</td><td><b>10</b> мкл</td></tr><tr><td>до 20 мкл</td></tr></table>"
_WORD = "<w:tr><w:tc><w:p><w:t>Состав</w:t></w:p></w:tc><w:tc><w:p><w:t>буфер &amp;amp; калибратор</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:t>Стерильность</w:t></w:tc><w:tc><w:t>да</w:t></w:tc></w:tr>"


@query()
def html_table_rows(spark, d):
    docs = spark.createDataFrame([("a", _TABLE)], "doc_id string, html string")
    return extract.carry_forward(extract.html_table_rows(docs, "doc_id", "html"))


@query()
def word_table_rows(spark, d):
    docs = spark.createDataFrame([("a", _WORD)], "doc_id string, xml string")
    return extract.carry_forward(extract.word_table_rows(docs, "doc_id", "xml"))


# ---- matching --------------------------------------------------------------------------

_MELT = "unnest([{'o': 0, 'i': 'brand', 'v': p_brand}, {'o': 1, 'i': 'type', 'v': p_type}, {'o': 2, 'i': 'size', 'v': p_size::VARCHAR}, {'o': 3, 'i': 'price', 'v': round(p_retailprice)::BIGINT::VARCHAR}])"
_PARTS = f"""WITH m AS (SELECT p_partkey AS id, p_brand AS brand, r.o AS ord, r.i AS ind, r.v AS v, {D.squeezed("r.v")} AS s FROM (SELECT *, {_MELT} AS r FROM part)),
  q AS (SELECT id, brand, ord, ind, {D.features("v", "q").replace("qs", "s")} FROM m WHERE id % 20 = 0), l AS (SELECT id, brand, ord, ind, {D.features("v", "l").replace("ls", "s")} FROM m),
  x AS (SELECT q.id AS query_id, l.id AS doc_id, q.ord, q.ind, {D.match_reason("q", "l")} AS r FROM q JOIN l ON q.brand = l.brand AND q.ind = l.ind AND q.id <> l.id),
  s AS (SELECT query_id, doc_id, count(*) AS points FROM x WHERE r[1] = '1' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM s)"""


def _parts(spark, d):
    """id, brand, type, size, price of the parts, the values as texts; without key or brand a part meets none."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"), F.round("p_retailprice").cast("bigint").cast("string").alias("price"))
    return parts.where("id is not null and brand is not null")


def _pairs(queries, library, keys=("brand", "ind")):
    """Indicator/value rows of query parts beside the same rows of others that agree in the keys."""
    def melted(parts, key, name):
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("ind"), F.col(n).alias("v")) for k, n in enumerate(["brand", "type", "size", "price"])))).alias("r")
        held = [c for c in ("query_id", "doc_id") if c == key or c in parts.columns]
        return parts.withColumnRenamed("id", key).select(*held, "brand", rows).select(*held, "brand", "r.ord", "r.ind", N.features(F.col("r.v")).alias(name))

    return melted(queries, "query_id", "q").join(melted(library, "doc_id", "l").drop("ord"), list(keys)).where("query_id <> doc_id")


def _best(spark, d):
    """The best part of each one whose key is divisible by 20. A key should stand once; copies are compared pair by pair."""
    parts = _parts(spark, d)
    twice = written(parts.groupBy("id").count().where("count > 1").select("id"), "copied-parts")
    once, copied = parts.join(twice, "id", "left_anti"), parts.join(twice, "id", "left_semi")
    mine = lambda df: df.where("id % 20 = 0")
    pairs = _pairs(mine(copied), parts).union(_pairs(mine(once), copied)).where(N.matches(F.col("q"), F.col("l")))
    points = pairs.groupBy("query_id", "doc_id").agg(F.count("*").alias("points")).unionByName(scoring.best_by_points(mine(once), once, "brand", ["type", "size", "price"]))
    return scoring.ranked(points.withColumn("total", F.lit(4)), 1, [F.desc("points"), F.col("doc_id")])


@query(f"{_PARTS} SELECT query_id, doc_id, points, points * 100.0::DOUBLE / 4 AS percent, CASE WHEN points * 100.0 / 4 >= 30 THEN 'match' ELSE 'no_match' END AS decision FROM k WHERE rank = 1")
def kv_score_parts(spark, d):
    """Flagship: the library part that satisfies each query part best, and the decision."""
    return scoring.decided(_best(spark, d)).select("query_id", "doc_id", "points", "percent", "decision")


@query(f"{_PARTS} SELECT x.query_id, x.doc_id, x.ord, x.ind AS indicator, x.r[1] = '1' AS match, substr(x.r, 3) AS reason FROM x JOIN k ON x.query_id = k.query_id AND x.doc_id = k.doc_id AND k.rank = 1")
def explain_rows_parts(spark, d):
    """Row by row, why the best part matches."""
    best, parts = written(_best(spark, d).select("query_id", "doc_id"), "best-parts"), _parts(spark, d)
    asked = parts.join(best.withColumnRenamed("query_id", "id"), "id")
    stocked = parts.join(best.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    told = _pairs(asked, stocked, ("doc_id", "brand", "ind")).withColumn("m", N.values_match(F.col("q"), F.col("l")))
    return told.select("query_id", "doc_id", "ord", F.col("ind").alias("indicator"), "m.match", "m.reason")


_WEIGH = "CASE " + " ".join(f"WHEN c = '{n}' THEN {w}" for n, w in L.WEIGHTS.items()) + " END"


@query(f"""SELECT doc_id, sum(w) AS possible, sum(CASE WHEN told THEN w ELSE 0 END) AS stated FROM (SELECT doc_id, {_WEIGH} AS w, bool_or(told) AS told FROM
  (SELECT doc_id, {L.category_sql("i")} AS c, told FROM (SELECT doc_id, {_IND} AS i, len({D.nums("value_raw")}) > 0 AS told FROM library_rows)) WHERE c <> 'other' GROUP BY doc_id, c) GROUP BY doc_id""")
def property_scores_docs(spark, d):
    return scoring.property_scores(table(spark, d, "library_rows"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, row_ord, {_IND} AS i, {_RAW} AS v FROM library_rows) WHERE NOT {L.meets_sql('i', L.EXCLUDED)} AND (regexp_matches(v, '[0-9]|>=|<=|[≥≤<>]') OR {L.meets_sql('i', L.TEXT_CRITERION)}) GROUP BY doc_id")
def key_rows_docs(spark, d):
    return scoring.key_rows(_distinct_rows(spark, d)).select("doc_id", "row_ord", "indicator", F.coalesce("value_raw", F.lit(""))).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY (o_orderpriority = '1-URGENT') = max(o_orderpriority = '1-URGENT') OVER (PARTITION BY c_custkey)""")
def narrow_orders(spark, d):
    """A customer's urgent orders if there are any, else all of them."""
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return scoring.narrowed(joined.withColumn("urgent", F.col("o_orderpriority") == "1-URGENT"), "urgent", "c_custkey").select("c_custkey", "o_orderkey", "o_orderpriority")


# ---- library, JSON, listings -----------------------------------------------------------


@query("""SELECT doc_id, original_filename, extension, coalesce(rows_count, n, 0) AS rows_count FROM (SELECT DISTINCT doc_id, original_filename, extension, rows_count FROM library_docs)
  LEFT JOIN (SELECT doc_id, count(*)::INT AS n FROM (SELECT DISTINCT doc_id, row_ord FROM library_rows) GROUP BY doc_id) USING (doc_id)""")
def library_list(spark, d):
    return library.listing(table(spark, d, "library_docs"), table(spark, d, "library_rows"))


@query("SELECT r.doc_id, row_ord, indicator FROM library_rows r ANTI JOIN (SELECT doc_id FROM library_docs WHERE extension = '.doc') g ON r.doc_id = g.doc_id")
def library_delete(spark, d):
    gone = table(spark, d, "library_docs").where("extension = '.doc'")
    return library.without(table(spark, d, "library_rows"), gone).select("doc_id", "row_ord", "indicator")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.data.k') IS NOT NULL AS nested FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.get_json_object("props", "$.data.k").isNotNull().alias("nested"))


@query("SELECT c_custkey, c_name, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def details_left_join(spark, d):
    """Every customer with the details of its orders, if any."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n", "total")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Events by hour and type, as the stream counts them."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "event_type", "n", "total")
