"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.model import Dataset
from lexforge.operators import dedup, leakage, quality, transform, validate
from lexforge.plans import pipeline as pl
from lexforge.sources import jsonl, manifest, registry
from lexforge.sources.staging import shared_dir, spread
from lexforge.streaming import jsonl_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Of the synthetic embeddings, whose largest cosine is near 0.5.
SIMILAR = 0.35
AS_OF = datetime(2000, 1, 1)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_seq"), "text"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{tx.SPACE}+', ' ', 'g'))"


def _boilerplate(x: str) -> str:
    out = f"lower({x})"
    for phrase in tx.BOILERPLATE:
        out = f"regexp_replace({out}, '{phrase}', '', 'gi')"
    return out


_CLEANED = f"""
s AS (SELECT doc_id, text, {_strip('text')} AS bare FROM documents),
b AS (SELECT *, {_boilerplate('bare')} AS body FROM s),
c AS (SELECT *, {_collapse('body')} AS cleaned FROM b),
clean AS (
  SELECT doc_id, cleaned AS text FROM c
  WHERE length(bare) >= 50 AND len(regexp_extract_all(bare, '{tx.URL}')) <= 5
    AND length({_strip('body')}) >= 50 AND length(cleaned) >= 50
)"""
_FIRST = "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {}) WHERE rn = 1"
_WORDS = f"string_split({_collapse('lower(text)')}, ' ')"


def _grams(source: str, key: str, n: int = 5) -> str:
    return f"""w AS (SELECT {key} AS k, {_WORDS} AS w FROM {source} WHERE {_collapse('text')} <> ''),
p AS (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n}),
g AS (SELECT DISTINCT k, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM p)"""


# --- text ---------------------------------------------------------------------


@query("text_clean", f"WITH {_CLEANED} SELECT doc_id, text FROM clean")
def text_clean(spark, d):
    return tx.kept(spread(_read(spark, d, "documents").select("doc_id", "text")), tx.clean("text"), "text")


@query("training_prep", f"WITH {_CLEANED} " + _FIRST.format("clean"))
def training_prep(spark, d):
    cleaned = text_clean(spark, d)
    return dedup.exact_filter(cleaned, "text", "doc_id")


@query(
    "clean_dedup_ci",
    f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {_strip('lower(text)')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def clean_dedup_ci(spark, d):
    return dedup.casefold_filter(_read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("url_count", f"SELECT page_id, CAST(len(regexp_extract_all(url || ' ' || html, '{tx.URL}')) AS BIGINT) AS urls FROM pages")
def url_count(spark, d):
    return _read(spark, d, "pages").select("page_id", tx.url_count(F.concat_ws(" ", "url", "html")).cast("bigint").alias("urls"))


@query(
    "clean_records",
    f"SELECT conv_id, turn, nullif(role, '') AS role, nullif({_collapse('text')}, '') AS text FROM conversations",
)
def clean_records(spark, d):
    return transform.clean_records(_read(spark, d, "conversations"))


@query("transform", f"SELECT conv_id, turn, role, lower({_strip('text')}) AS text FROM conversations")
def normalized(spark, d):
    return transform.normalize(_read(spark, d, "conversations"))


@query(
    "ngrams",
    f"WITH {_grams('benchmark', 'item_id')} SELECT k AS item_id, g AS ngram FROM g",
)
def ngrams(spark, d):
    return _read(spark, d, "benchmark").select("item_id", F.explode(tx.ngrams("text", 5)).alias("ngram"))


# --- deduplication ------------------------------------------------------------


@query(
    "exact_dup_groups",
    "SELECT md5(text) AS md5, count(*) AS members, array_to_string(list(doc_id ORDER BY doc_id), ',') AS seqs FROM documents GROUP BY text HAVING count(*) > 1",
)
def exact_dup_groups(spark, d):
    return dedup.exact_groups(_docs(spark, d)).withColumn("seqs", F.array_join("seqs", ","))


@query(
    "exact_dup_report",
    """WITH n AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT count(*) FILTER (n > 1) > 0 AS duplicates_detected, count(*) FILTER (n > 1) AS duplicate_groups,
       CAST(sum(n - 1) AS BIGINT) AS total_duplicate_instances, round(sum(n - 1) / sum(n), 9) AS duplicate_rate FROM n""",
)
def exact_dup_report(spark, d):
    return dedup.exact_report(_docs(spark, d)).withColumn("duplicate_rate", F.round("duplicate_rate", 9))


@query("exact_dedup", _FIRST.format("documents"))
def exact_dedup(spark, d):
    return dedup.exact_filter(_docs(spark, d)).withColumnRenamed("_seq", "doc_id")


@query(
    "record_distinct",
    """SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""",
)
def record_distinct(spark, d):
    return dedup.record_distinct(_read(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    "semantic_pairs",
    f"SELECT a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {SIMILAR}",
)
def semantic_pairs(spark, d):
    return dedup.similar_pairs(_read(spark, d, "embeddings"), SIMILAR, seq="vec_id").withColumn("similarity", F.round("similarity", 6))


@query(
    "semantic_lsh_buckets",
    "SELECT vec_id, CAST(list_reduce(list_transform(embedding[1:20], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda s, b: s * 2 + b) AS BIGINT) AS bucket FROM embeddings",
)
def semantic_lsh_buckets(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", dedup.lsh_bucket("embedding").alias("bucket"))


def _bits(n: int) -> str:
    return f"CAST(list_reduce(list_transform(embedding[1:{n}], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda s, b: s * 2 + b) AS BIGINT)"


@query(
    "semantic_lsh_pairs",
    f"""WITH e AS (SELECT *, {_bits(4)} AS bucket FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS similarity FROM e a JOIN e b ON a.bucket = b.bucket AND a.vec_id < b.vec_id WHERE {_COS} >= {SIMILAR}""",
)
def semantic_lsh_pairs(spark, d):
    return dedup.bucket_pairs(_read(spark, d, "embeddings"), SIMILAR, 4, seq="vec_id").withColumn("similarity", F.round("similarity", 6))


@query(
    "semantic_dedup",
    f"""WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {SIMILAR}
), low AS (SELECT j, list(i) AS lo FROM pairs GROUP BY j),
adj AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id AS j, coalesce(lo, CAST([] AS BIGINT[])) AS lo
  FROM embeddings LEFT JOIN low ON low.j = vec_id
),
g(n, kept) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT g.n + 1, CASE WHEN len(list_intersect(g.kept, adj.lo)) = 0 THEN list_append(g.kept, adj.j) ELSE g.kept END FROM g JOIN adj ON adj.n = g.n + 1
)
SELECT unnest(kept) AS vec_id FROM g WHERE n = (SELECT max(n) FROM g)""",
)
def semantic_dedup(spark, d):
    return dedup.semantic_filter(_read(spark, d, "embeddings"), SIMILAR, use_lsh=False, seq="vec_id").select("vec_id")


def _greedy(vectors: str, key: str, pairs: str) -> str:
    """Recursive SQL: ``g`` has the kept keys of ``vectors`` after each row in order."""
    return f"""WITH RECURSIVE {pairs}, low AS (SELECT j, list(i) AS lo FROM pairs GROUP BY j),
adj AS (
  SELECT row_number() OVER (ORDER BY {key}) - 1 AS n, {key} AS j, coalesce(lo, CAST([] AS BIGINT[])) AS lo FROM {vectors} LEFT JOIN low ON low.j = {key}
),
g(n, kept) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT g.n + 1, CASE WHEN len(list_intersect(g.kept, adj.lo)) = 0 THEN list_append(g.kept, adj.j) ELSE g.kept END FROM g JOIN adj ON adj.n = g.n + 1
),
stays AS (SELECT unnest(kept) AS k FROM g WHERE n = (SELECT max(n) FROM g))"""


@query(
    "semantic_representatives",
    _greedy("embeddings", "vec_id", f"""e AS (SELECT *, {_bits(4)} AS bucket FROM embeddings),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.bucket = b.bucket AND a.vec_id < b.vec_id WHERE {_COS} >= {SIMILAR})""")
    + " SELECT j AS dup_seq, min(i) AS rep_seq FROM pairs WHERE i IN (SELECT k FROM stays) AND j NOT IN (SELECT k FROM stays) GROUP BY j",
)
def semantic_representatives(spark, d):
    return dedup.semantic_removals(_read(spark, d, "embeddings"), SIMILAR, True, 4, seq="vec_id")


# --- leakage ------------------------------------------------------------------

_CONTAMINATION = f"""WITH {_grams('documents', 'doc_id')},
w2 AS (SELECT item_id AS k, {_WORDS} AS w FROM benchmark WHERE {_collapse('text')} <> ''),
p2 AS (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w2 WHERE len(w) >= 5),
e AS (SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS g FROM p2),
t AS (SELECT DISTINCT g FROM g)
SELECT e.k AS index, count(*) AS n_grams, count(t.g) AS n_shared, round(count(t.g) / count(*), 9) AS overlap, count(t.g) / count(*) > 0.8 AS contaminated
FROM e LEFT JOIN t ON e.g = t.g GROUP BY e.k"""


@query("contamination", _CONTAMINATION)
def contamination(spark, d):
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("_seq"), "text")
    return leakage.contamination(_docs(spark, d), items).withColumn("overlap", F.round("overlap", 9))


@query(
    "near_duplicates",
    f"""WITH {_grams('documents', 'doc_id')},
c AS (SELECT k, n, min(k) OVER (PARTITION BY node) AS rep FROM (SELECT k, count(*) AS n, md5(string_agg(g, chr(31) ORDER BY g)) AS node FROM g GROUP BY k)),
r AS (SELECT k, g FROM g WHERE k IN (SELECT rep FROM c)),
x AS (SELECT a.k AS i, b.k AS j, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k)
SELECT i, j, round(shared / (p.n + q.n - shared), 9) AS similarity FROM x JOIN c p ON p.k = i JOIN c q ON q.k = j WHERE shared / (p.n + q.n - shared) >= 0.9
UNION ALL SELECT rep, k, 1.0 FROM c WHERE k <> rep""",
)
def near_duplicates(spark, d):
    """Similar pairs of classes, each by its smallest document, and each copy with its class's."""
    return leakage.near_duplicates(_docs(spark, d), expand=False).withColumn("similarity", F.round("similarity", 9))


@query(
    "memorization",
    f"WITH {_grams('documents', 'doc_id')} SELECT g AS ngram, count(*) AS frequency FROM g GROUP BY g HAVING count(*) >= 10 ORDER BY frequency DESC, ngram LIMIT 20",
)
def memorization(spark, d):
    return leakage.memorization(_docs(spark, d))


@query(
    "frequent_ngrams",
    f"WITH {_grams('documents', 'doc_id')} SELECT g AS ngram, count(*) AS frequency FROM g GROUP BY g HAVING count(*) >= 10",
)
def frequent_ngrams(spark, d):
    return leakage.frequent_ngrams(_docs(spark, d))


# --- quality ------------------------------------------------------------------


def _metrics(spark: SparkSession, df: DataFrame, schema: dict | None = None) -> DataFrame:
    found = quality.metrics_frame(df, schema, as_of=AS_OF)
    return found.select("dimension", "metric_name", F.round("value", 6).alias("value"), "passed")


def _metric(dimension: str, name: str, value: str, threshold: float) -> str:
    return f"SELECT '{dimension}' AS dimension, '{name}' AS metric_name, round(CAST({value} AS DOUBLE), 6) AS value, {value} >= {threshold} AS passed"


def _rate(column: str, table: str = "t") -> str:
    return f"""SELECT count(*) FILTER ({column} < lo - 1.5 * (hi - lo) OR {column} > hi + 1.5 * (hi - lo)) / count(*) AS r FROM
(SELECT {column} FROM {table} WHERE {column} IS NOT NULL), (SELECT quantile_cont({column}, 0.25) AS lo, quantile_cont({column}, 0.75) AS hi FROM {table})"""


def _quality_sql(source: str, columns: list[str], numeric: list[str], extra: list[str], typed_nulls: list[str] = ()) -> str:
    complete = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    mixed = " + ".join([f"CASE WHEN count(*) FILTER ({c} IS NULL) BETWEEN 1 AND count(*) - 1 THEN 1 ELSE 0 END" for c in typed_nulls] or ["0 * count(*)"])
    parts = [f"{_metric('completeness', 'overall_completeness', f'(1 - ({complete}) / (count(*) * {len(columns)}))', 0.95)} FROM t"]
    parts += [f"{_metric('completeness', f'column_{c}_completeness', f'(1 - count(*) FILTER ({c} IS NULL) / count(*))', 0.95)} FROM t" for c in columns]
    parts.append(f"{_metric('consistency', 'type_consistency', f'(1 - 0.1 * ({mixed}))', 0.9)} FROM t")
    parts.append(f"{_metric('uniqueness', 'row_uniqueness', '((SELECT count(*) FROM (SELECT DISTINCT * FROM t)) / count(*))', 0.98)} FROM t")
    rates = " + ".join(f"({_rate(c)})" for c in numeric)
    parts.append(_metric("accuracy", "numeric_outlier_rate", f"(1 - ({rates}) / {len(numeric)})", 0.9))
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts + extra)


_LABELLED = "SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(
    "quality_documents",
    _quality_sql(
        _LABELLED, ["doc_id", "text", "lang", "n_chars", "label"], ["doc_id", "n_chars", "label"],
        [
            "SELECT 'validity', 'required_fields_check', 1.0, true",
            f"{_metric('validity', 'schema_validation', '(CASE WHEN min(n_chars) < 50 THEN 0.9 ELSE 1.0 END)', 1.0)} FROM t",
            _metric("timeliness", "freshness_proxy", "1.0", 0.7), _metric("integrity", "referential_proxy", "1.0", 1.0),
            f"{_metric('consistency', 'label_balance', '(min(n) / max(n))', 0.1)} FROM (SELECT count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY label)",
            "SELECT 'summary', 'text_length_mean', 1.0, true",
        ],
        ["text", "lang"],
    ),
)
def quality_documents(spark, d):
    return _metrics(spark, _labelled(spark, d), _LABELLED_SCHEMA)


@query(
    "quality_orders",
    _quality_sql(
        "SELECT o_orderkey AS id, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders", ["id", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"],
        ["id", "o_custkey", "o_totalprice"],
        [
            f"""{_metric('timeliness', 'data_freshness', "greatest(0, 1 - floor((epoch(TIMESTAMP '2000-01-01') - epoch(max(o_orderdate))) / 86400) / 30)", 0.7)} FROM t""",
            f"{_metric('integrity', 'id_completeness', '(1 - count(*) FILTER (id IS NULL) / count(*))', 1.0)} FROM t",
        ],
    ),
)
def quality_orders(spark, d):
    return _metrics(spark, _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))


_LABELLED_SCHEMA = {"required_fields": ["doc_id", "text"], "fields": {"n_chars": {"constraints": {"min": 50}}}}
#: The report's order of metrics, and their thresholds.
_ORDER = [
    ("completeness", "overall_completeness", "0.95"), *[("completeness", f"column_{c}_completeness", "0.95") for c in ("doc_id", "text", "lang", "n_chars", "label")],
    ("consistency", "type_consistency", "0.9"), ("validity", "required_fields_check", "1.0"), ("validity", "schema_validation", "1.0"), ("uniqueness", "row_uniqueness", "0.98"),
    ("timeliness", "freshness_proxy", "0.7"), ("accuracy", "numeric_outlier_rate", "0.9"), ("integrity", "referential_proxy", "1.0"), ("consistency", "label_balance", "0.1"),
    ("summary", "text_length_mean", ""),
]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return docs.join(_read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")


def _unrounded(name: str) -> str:
    return SQL[name].replace("round(CAST(", "(CAST(").replace(" AS DOUBLE), 6) AS value", " AS DOUBLE)) AS value")


@query(
    "quality_report",
    f"""WITH m AS ({_unrounded('quality_documents')}),
o AS (SELECT m.*, i, threshold FROM m JOIN (VALUES {', '.join(f"('{d}', '{n}', '{t}', {i})" for i, (d, n, t) in enumerate(_ORDER))}) v(d, n, threshold, i) ON d = dimension AND n = metric_name),
d AS (SELECT dimension, avg(value) AS v, min(i) AS i FROM o WHERE dimension <> 'summary' GROUP BY dimension),
failed AS (SELECT *, row_number() OVER (ORDER BY i) AS rn FROM o WHERE NOT passed),
advice AS (
  SELECT i AS place, 'Improve ' || dimension || ': score ' || printf('%.2f', v) || ' is below 0.80' AS message FROM d WHERE v < 0.8
  UNION ALL SELECT 100 + i, 'Fix ' || dimension || '.' || metric_name || ': ' || printf('%.2f', value) || ' is below ' || threshold FROM failed WHERE rn <= 5
)
SELECT 'dimension' AS kind, dimension AS name, round(v, 6) AS value, CAST(NULL AS VARCHAR) AS message FROM d
UNION ALL SELECT 'overall', 'overall', round(avg(v), 6), NULL FROM d
UNION ALL SELECT 'recommendation', CAST(row_number() OVER (ORDER BY place) - 1 AS VARCHAR), NULL, message FROM advice
UNION ALL SELECT 'error', CAST(rn - 1 AS VARCHAR), NULL, dimension || '.' || metric_name || ': ' || printf('%.2f', value) || ' < ' || threshold FROM failed
UNION ALL SELECT 'valid', 'valid', CASE WHEN (SELECT count(*) FROM failed) = 0 AND (SELECT avg(v) FROM d) >= 0.8 THEN 1.0 ELSE 0.0 END, NULL""",
)
def quality_report(spark, d):
    """The rolled-up report: scores by dimension, overall, recommendations, and its verdict."""
    report = quality.check(_labelled(spark, d), "documents", _LABELLED_SCHEMA, as_of=AS_OF)
    verdict = report.to_validation()
    rows = [("dimension", k, round(v, 6), None) for k, v in report.to_dict()["dimension_scores"].items()] + [("overall", "overall", round(verdict.quality_scores["overall"], 6), None)]
    rows += [("recommendation", str(i), None, r) for i, r in enumerate(verdict.warnings)] + [("error", str(i), None, e) for i, e in enumerate(verdict.errors)]
    rows += [("valid", "valid", float(verdict.is_valid), None)]
    return spark.createDataFrame(rows, "kind string, name string, value double, message string")


@query(
    "quality_stage",
    f"""WITH m AS ({_unrounded('quality_orders')}), d AS (SELECT dimension, avg(value) AS v FROM m GROUP BY dimension)
SELECT dimension, round(v, 6) AS value FROM d UNION ALL SELECT 'overall', round(avg(v), 6) FROM d""",
)
def quality_stage(spark, d):
    """The stage that only notes the scores, on rows that pass through it."""
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    result = pl.QualityCheck({"as_of": AS_OF}).process(Dataset(orders))
    if not result.success or result.data.df.count() != orders.count():
        raise RuntimeError(result.error or "rows were lost")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in result.data.quality_metrics.items()], "dimension string, value double")


# --- validation and routing ---------------------------------------------------


@query(
    "required_fields",
    f"""SELECT d.doc_id, CASE WHEN text IS NULL THEN '''text'' must be a string' WHEN {_strip('text')} = '' THEN '''text'' is empty' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def required_fields(spark, d):
    df = _read(spark, d, "documents").join(_read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return df.select("doc_id", validate.record_error(df).alias("error"))


@query(
    "diagnostics",
    f"""WITH t AS (SELECT d.doc_id, text, quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, 'error' AS severity, '''text'' is empty' AS message FROM t WHERE {_strip('text')} = ''
UNION ALL SELECT doc_id, 'warning', '''text'' has fewer than 3 characters' FROM t WHERE length({_strip('text')}) BETWEEN 1 AND 2
UNION ALL SELECT doc_id, 'warning', '''label'' is null' FROM t WHERE label IS NULL""",
)
def diagnostics(spark, d):
    df = _read(spark, d, "documents").join(_read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return validate.messages(df, *validate.record_messages(df), "doc_id").withColumnRenamed("index", "doc_id")


_TYPES = {"click": 0, "view": 1, "purchase": 2, "signup": 3}


@query(
    "label_route",
    f"""SELECT event_id, CAST(CASE lower({_strip('event_type')}) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _TYPES.items())} END AS BIGINT) AS label_id,
CASE WHEN lower({_strip('event_type')}) IN ({', '.join(f"'{k}'" for k in _TYPES)}) THEN NULL ELSE 'Unknown label ''' || lower({_strip('event_type')}) || '''' END AS error FROM events""",
)
def label_route(spark, d):
    df = _read(spark, d, "events").select("event_id", F.col("event_type").alias("label"))
    return df.select("event_id", validate.label_id(df, _TYPES).alias("label_id"), validate.routing_error(df, _TYPES).alias("error"))


@query(
    "label_validate",
    "SELECT l_orderkey, l_linenumber, l_quantity AS label_id, CASE WHEN trunc(l_quantity) BETWEEN 0 AND 30 THEN NULL ELSE 'out' END AS error FROM lineitem",
)
def label_validate(spark, d):
    df = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("label_id"))
    return df.select("*", F.when(validate.label_range_error(df).isNotNull(), "out").alias("error"))


_ODD = "CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '  ' ELSE text END"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    """Documents some of whose texts are missing or blank."""
    text = F.when(F.col("lang") == "de", F.lit(None)).when(F.col("lang") == "fr", F.lit("  ")).otherwise(F.col("text"))
    return _read(spark, d, "documents").select(F.col("doc_id").alias("_seq"), text.alias("text"), "lang")


_TEXT_WARNINGS = f"""WITH t AS (SELECT doc_id, {_ODD} AS text FROM documents)
SELECT doc_id AS index, 'warning' AS severity, CASE WHEN text IS NULL THEN '''text'' is not a string' ELSE '''text'' is empty' END AS message
FROM t WHERE text IS NULL OR {_strip('text')} = ''"""


@query("cleaning_diagnostics", _TEXT_WARNINGS)
def cleaning_diagnostics(spark, d):
    return pl.Cleaning().messages(Dataset(_odd(spark, d)))


@query("transform_diagnostics", _TEXT_WARNINGS)
def transform_diagnostics(spark, d):
    return pl.Normalizing().messages(Dataset(_odd(spark, d)))


@query(
    "validation_diagnostics",
    f"""WITH t AS (SELECT doc_id, {_ODD} AS text FROM documents)
SELECT doc_id AS index, 'error' AS severity, CASE WHEN text IS NULL THEN '''text'' must be a string' ELSE '''text'' is empty' END AS message FROM t WHERE text IS NULL OR {_strip('text')} = ''
UNION ALL SELECT doc_id, 'error', 'Required field ''label'' is missing' FROM t
UNION ALL SELECT doc_id, 'warning', '''text'' has fewer than 3 characters' FROM t WHERE length({_strip('text')}) BETWEEN 1 AND 2""",
)
def validation_diagnostics(spark, d):
    return pl.Requirement().messages(Dataset(_odd(spark, d)))


_LABELS = "CASE event_type WHEN 'view' THEN '  ' WHEN 'click' THEN NULL ELSE upper(event_type) END"


@query(
    "routing_diagnostics",
    f"""WITH t AS (SELECT event_id, {_LABELS} AS label FROM events)
SELECT event_id AS index, 'error' AS severity, CASE WHEN label IS NULL THEN 'Label is null' WHEN trim(label) = '' THEN 'Label is empty' ELSE 'Unknown label ''' || lower(label) || '''' END AS message
FROM t WHERE label IS NULL OR lower(label) NOT IN ('purchase', 'signup')""",
)
def routing_diagnostics(spark, d):
    label = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "click", None).otherwise(F.upper("event_type"))
    df = _read(spark, d, "events").select(F.col("event_id").alias("_seq"), label.alias("label"))
    return pl.Routing({"label_mapping": {"Purchase ": 2, "signup": 3}}).messages(Dataset(df))


@query(
    "routing_of_numbers",
    """SELECT l_orderkey, l_linenumber, 'error' AS severity, 'Label id ' || CAST(l_quantity AS VARCHAR) || ' is outside [0, 30]' AS message FROM lineitem WHERE trunc(l_quantity) > 30
UNION ALL SELECT l_orderkey, l_linenumber, 'warning', 'Label is a number already' FROM lineitem WHERE trunc(l_quantity) <= 30""",
)
def routing_of_numbers(spark, d):
    df = _read(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_quantity").alias("label"))
    return validate.messages(df, *validate.routing_messages(df, {}), "at").select("index.*", "severity", "message")


@query(
    "label_range_diagnostics",
    """SELECT l_orderkey, l_linenumber, 'error' AS severity, 'Label id ' || CAST(l_quantity AS VARCHAR) || ' is outside [5, 20]' AS message FROM lineitem WHERE trunc(l_quantity) NOT BETWEEN 5 AND 20""",
)
def label_range_diagnostics(spark, d):
    df = _read(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_quantity").alias("label_id"))
    none = F.array().cast("array<string>")
    return validate.messages(df, F.array_compact(F.array(validate.label_range_error(df, 5, 20))), none, "at").select("index.*", "severity", "message")


@query(
    "validate_all",
    f"""WITH t AS (SELECT doc_id, {_ODD} AS text FROM documents), n AS (SELECT count(*) FILTER (text IS NULL OR {_strip('text')} = '') AS odd, count(*) AS rows FROM t)
SELECT 'data_loading' AS stage, true AS is_valid, CAST(0 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS warnings
UNION ALL SELECT 'data_cleaning', true, 0, odd FROM n
UNION ALL SELECT 'data_validation', odd = 0, odd, 0 FROM n
UNION ALL SELECT 'data_routing', false, rows, 1 FROM n
UNION ALL SELECT 'label_validation', false, rows, 0 FROM n
UNION ALL SELECT 'data_transformation', true, 0, odd FROM n
UNION ALL SELECT 'text_cleaning', odd = 0, odd, 0 FROM n
UNION ALL SELECT 'exact_dedup', true, 0, 0""",
)
def validate_all(spark, d):
    """What each stage says of the same raw rows, which have no labels."""
    stages = [pl.Loading(), pl.Cleaning(), pl.Requirement({"required_fields": ["text"]}), pl.Routing(), pl.LabelRange(), pl.Normalizing(), pl.TextCleaning(), pl.ExactDedup()]
    chain = pl.Pipeline(stages)
    found = zip(chain.stage_names(), chain.tally_all(Dataset(_odd(spark, d))))
    return spark.createDataFrame([(n, *v) for n, v in found], "stage string, is_valid boolean, errors long, warnings long")


@query(
    "first_failures",
    f"""WITH t AS (SELECT doc_id, {_ODD} AS text FROM documents), bad AS (SELECT text FROM t WHERE text IS NULL OR {_strip('text')} = '' ORDER BY doc_id LIMIT 1)
SELECT 'empty' AS case, false AS success, CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'none', false, NULL
UNION ALL SELECT 'no stage', true, NULL
UNION ALL SELECT 'required', false, 'data_validation: ' || CASE WHEN text IS NULL THEN '''text'' must be a string' ELSE '''text'' is empty' END FROM bad
UNION ALL SELECT 'label', false, 'data_routing: Required field ''label'' is missing'""",
)
def first_failures(spark, d):
    """A failing stage's result has the first row's message, if there are rows at all."""
    df, need = _odd(spark, d), pl.Requirement({"required_fields": ["text"]})
    found = {
        "empty": (need.process(Dataset(df.limit(0))).success, None), "none": (need.process(None).success, None), "no stage": (pl.Pipeline([]).run(Dataset(df)).success, None),
        "required": ((r := pl.Pipeline([need, pl.Routing()]).run(Dataset(df))).success, r.error), "label": ((r := pl.Routing().process(Dataset(df))).success, r.error),
    }
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "case string, success boolean, error string")


# --- files, manifests, versions -----------------------------------------------


@query("chunk_dedup", "SELECT doc_id, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY chunk_id, text ORDER BY doc_id) AS rn FROM (SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS BIGINT) AS chunk_id FROM documents)) WHERE rn = 1")
def chunk_dedup(spark, d):
    numbered = jsonl.with_seq(_read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return dedup.keep_first(jsonl.chunked(numbered), [F.col("chunk_id"), F.md5("text")]).select("doc_id", "chunk_id")


def _written(spark: SparkSession, d: str, table: str, order: str) -> str:
    path = shared_dir(spark)
    df = _read(spark, d, table)
    df = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t.startswith("timestamp")})
    jsonl.write_jsonl(df.orderBy(order), path + "/data.jsonl")
    return path


@query("jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, d):
    path = _written(spark, d, "conversations", "conv_id")
    return jsonl.read_jsonl(spark, path).select("conv_id", "turn", "role", "text")


def _kinds(column: str, kind: str) -> str:
    return f"SELECT '{column}' AS field, array_to_string(list_filter(['NoneType', '{kind}'], lambda k: CASE WHEN k = 'NoneType' THEN n > c ELSE c > 0 END), ',') AS types FROM (SELECT count(*) AS n, count({column}) AS c FROM t)"


@query(
    "schema_infer",
    f"WITH t AS (SELECT doc_id, {_ODD} AS text, nullif(lang, 'en') AS lang, n_chars / 7.0 AS share, lang = 'es' AS es FROM documents ORDER BY doc_id LIMIT 100) "
    + " UNION ALL ".join(_kinds(c, k) for c, k in (("doc_id", "int"), ("text", "str"), ("lang", "str"), ("share", "float"), ("es", "bool"))),
)
def schema_infer(spark, d):
    docs = _odd(spark, d).join(_read(spark, d, "documents").select(F.col("doc_id").alias("_seq"), (F.col("n_chars") / 7.0).alias("share")), "_seq")
    path = shared_dir(spark)
    jsonl.write_jsonl(docs.select(F.col("_seq").alias("doc_id"), "text", F.nullif("lang", F.lit("en")).alias("lang"), "share", (F.col("lang") == "es").alias("es")).orderBy("doc_id"), path)
    found = manifest.infer_schema(spark, path)
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found["fields"].items()], "field string, types string")


@query(
    "column_stats",
    """WITH t AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1000)
SELECT 'doc_id' AS name, CAST(min(doc_id) AS DOUBLE) AS min, CAST(max(doc_id) AS DOUBLE) AS max, round(avg(doc_id), 6) AS mean FROM t
UNION ALL SELECT 'n_chars', min(n_chars), max(n_chars), round(avg(n_chars), 6) FROM t
UNION ALL SELECT 'text_length', min(length(text)), max(length(text)), round(avg(length(text)), 6) FROM t""",
)
def column_stats(spark, d):
    found = manifest.column_stats(spark, _written(spark, d, "documents", "doc_id"))
    return spark.createDataFrame([(k, v["min"], v["max"], round(v["mean"], 6)) for k, v in found.items()], "name string, min double, max double, mean double")


_LINES = "json_object('item_id', item_id, 'text', text)::VARCHAR || chr(10)"


@query(
    "manifest",
    f"SELECT 'benchmark' AS id, 'v1' AS version, count(*) AS row_count, sha256(string_agg({_LINES}, '' ORDER BY item_id)) AS content_hash, 'jsonl' AS format, min(length(text)) AS shortest, 'CC0' AS license FROM benchmark",
)
def made_manifest(spark, d):
    m = manifest.build_manifest(spark, _written(spark, d, "benchmark", "item_id"), "benchmark", "v1", license_info="CC0")
    row = (m["id"], m["version"], m["row_count"], m["content_hash"], m["schema"]["format"], int(m["metadata"]["column_stats"]["text_length"]["min"]), m["metadata"]["license"])
    return spark.createDataFrame([row], "id string, version string, row_count long, content_hash string, format string, shortest long, license string")


@query(
    "content_fingerprint",
    """SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), doc_id, coalesce(lang, chr(30)), n_chars, coalesce(source, chr(30)), coalesce(text, chr(30)))), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM documents""",
)
def content_fingerprint(spark, d):
    return manifest.content_fingerprint(_read(spark, d, "documents"))


_VERSIONS = """SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey AS id, 'set' || o_custkey AS dataset_name,
o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS total_samples, CAST(o_orderkey % 7 AS BIGINT) AS file_count, CAST(floor(o_totalprice * 10) AS BIGINT) AS total_size_bytes FROM orders"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """A registry made of orders: one dataset for each customer."""
    return _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("set"), F.col("o_custkey")).alias("dataset_name"), F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").alias("total_samples"), (F.col("o_orderkey") % 7).alias("file_count"), F.floor(F.col("o_totalprice") * 10).alias("total_size_bytes"),
    )


@query(
    "version_latest",
    f"SELECT id, dataset_name FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY created_at DESC, id DESC) AS rn FROM ({_VERSIONS})) WHERE rn = 1",
)
def version_latest(spark, d):
    return registry.latest(_versions(spark, d)).select("id", "dataset_name")


@query(
    "version_compare",
    f"""SELECT id, total_samples - lag(total_samples) OVER w AS sample_difference, file_count - lag(file_count) OVER w AS file_difference,
total_size_bytes - lag(total_size_bytes) OVER w AS size_difference_bytes FROM ({_VERSIONS}) WINDOW w AS (PARTITION BY dataset_name ORDER BY created_at, id)""",
)
def version_compare(spark, d):
    return registry.compared(_versions(spark, d)).select("id", "sample_difference", "file_difference", "size_difference_bytes")


@query(
    "change_type",
    f"""WITH v AS (SELECT id, total_samples AS s, lag(total_samples) OVER (PARTITION BY dataset_name ORDER BY created_at, id) AS p FROM ({_VERSIONS}))
SELECT id, CASE WHEN p IS NULL THEN 'MAJOR' WHEN p > 0 AND abs(s - p) / p > 0.5 THEN 'MAJOR' WHEN p > 0 AND abs(s - p) / p > 0.1 THEN 'MINOR' ELSE 'PATCH' END AS change_type FROM v""",
)
def change_type(spark, d):
    v = registry.compared(_versions(spark, d)).withColumn("parent", F.col("total_samples") - F.col("sample_difference"))
    return v.select("id", registry.change_type(F.col("total_samples"), F.col("parent"), F.col("parent").isNotNull()).alias("change_type"))


@query(
    "next_version",
    "SELECT p_partkey, '1.' || (p_size % 4) || '.' || (p_size + 1) AS next_version FROM part",
)
def next_version(spark, d):
    v = F.concat(F.lit("v1."), F.col("p_size") % 4, F.lit("."), F.col("p_size"))
    return _read(spark, d, "part").select("p_partkey", registry.next_version_column(v).alias("next_version"))


@query("version_registry", "SELECT '1.0.1' AS version, 'MAJOR' AS change_type, (SELECT count(*) FROM nation) - (SELECT count(*) FROM region) AS sample_difference, true AS intact")
def version_registry(spark, d):
    """Two versions of one dataset written, compared and verified."""
    reg = registry.VersionRegistry(spark, shared_dir(spark))
    kind = registry.DatasetType.CONTRACT_INTELLIGENCE
    reg.create("geo", kind, _written(spark, d, "region", "r_regionkey"))
    second = reg.create("geo", kind, _written(spark, d, "nation", "n_nationkey"), parent_version="1.0.0")
    diff = reg.compare("geo", "1.0.0", second["version"])
    return spark.createDataFrame([(second["version"], diff["change_type"], diff["sample_difference"], reg.validate("geo", "1.0.1"))], "version string, change_type string, sample_difference long, intact boolean")


@query(
    "version_list",
    """WITH t AS (SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n, 2 AS i UNION ALL SELECT 'region', (SELECT count(*) FROM region), 1 UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 3)
SELECT 'listed' AS what, name || ' 1.0.0' AS version, n AS total_samples, CAST(row_number() OVER (ORDER BY i DESC) - 1 AS BIGINT) AS place FROM t
UNION ALL SELECT 'got', 'nation 1.0.0', n, 0 FROM t WHERE name = 'nation' UNION ALL SELECT 'latest', 'region 1.0.0', n, 0 FROM t WHERE name = 'region'
UNION ALL SELECT 'limited', 'supplier 1.0.0', n, 0 FROM t WHERE name = 'supplier'""",
)
def version_list(spark, d):
    """What was registered: all of it, newest first; one by name; the newest of a name; a limit."""
    reg = registry.VersionRegistry(spark, shared_dir(spark))
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")):
        reg.create(name, registry.DatasetType.CLAUSE_EVOLUTION, _written(spark, d, name, key))
    found = {"listed": reg.list(), "got": [reg.get("nation", "1.0.0")], "latest": [reg.latest("region")], "limited": reg.list(limit=1)}
    rows = [(k, f"{r['dataset_name']} {r['version']}", r["total_samples"], i) for k, v in found.items() for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "what string, version string, total_samples long, place long")


@query(
    "version_files",
    f"""WITH n AS (SELECT count(*) AS n, sum(len(list_filter({_WORDS}, lambda w: w <> ''))) AS tokens FROM benchmark)
SELECT CAST(v AS BIGINT) AS entry, n AS sample_count, CAST(tokens AS BIGINT) AS token_count, v = 1 AS first, true AS intact FROM n, (VALUES (1), (2)) t(v)""",
)
def version_files(spark, d):
    """Two versions of a folder, their lineage, and whether the folder is as it was."""
    store = manifest.FileVersions(spark, shared_dir(spark))
    path = _written(spark, d, "benchmark", "item_id")
    made = [store.create(path, "bench", encode=str.split)]
    made.append(store.create(path, "bench", parents=[made[0]["version"]], encode=str.split))
    kept = store.lineage("bench")
    rows = [(i, k["sample_count"], m["token_count"], k["parent_versions"] == [], store.verify(path, k["checksum"])) for i, (k, m) in enumerate(zip(kept, made), 1)]
    return spark.createDataFrame(rows, "entry long, sample_count long, token_count long, first boolean, intact boolean")


# --- pipelines ----------------------------------------------------------------


def _run(pipeline: pl.Pipeline, df: DataFrame) -> DataFrame:
    result = pipeline.run(Dataset(df))
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df


@query("training_preset", f"WITH {_CLEANED} " + _FIRST.format("clean"))
def training_preset(spark, d):
    return _run(pl.training(), _docs(spark, d)).withColumnRenamed("_seq", "doc_id")


@query("feedback_preset", "WITH " + _CLEANED.replace(">= 50", ">= 1") + " " + _FIRST.format("clean"))
def feedback_preset(spark, d):
    return _run(pl.feedback(), _docs(spark, d)).withColumnRenamed("_seq", "doc_id")


_EMBEDDED = _greedy("few", "doc_id", f"""{_CLEANED.strip()}, few AS (SELECT f.doc_id, f.text, e.embedding FROM ({_FIRST.format('clean')}) f JOIN embeddings e ON e.vec_id = f.doc_id),
pairs AS (SELECT a.doc_id AS i, b.doc_id AS j FROM few a JOIN few b ON a.doc_id < b.doc_id WHERE {_COS} >= {SIMILAR})""")


@query("production_preset", _EMBEDDED + " SELECT doc_id, text FROM few WHERE doc_id IN (SELECT k FROM stays)")
def production_preset(spark, d):
    """All its stages, the embeddings' too, with evaluation texts that don't leak."""
    held = _read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("_seq"), F.concat(F.lit("held out evaluation text about the nation "), "n_name").alias("text"))
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("_seq"), "embedding")
    chain = pl.production(eval_texts=held, similarity_threshold=SIMILAR, use_lsh=False)
    return _run(chain, _docs(spark, d).join(vectors, "_seq")).select(F.col("_seq").alias("doc_id"), "text")


@query(
    "production_leak",
    f"""WITH {_CLEANED}, few AS ({_FIRST.format('clean')}), {_grams('few', 'doc_id')},
w2 AS (SELECT item_id AS k, {_WORDS} AS w FROM benchmark WHERE {_collapse('text')} <> ''),
p2 AS (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w2 WHERE len(w) >= 5),
e AS (SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS g FROM p2),
t AS (SELECT DISTINCT g FROM g),
hits AS (SELECT e.k, count(t.g) / count(*) > 0.8 AS contaminated FROM e LEFT JOIN t ON e.g = t.g GROUP BY e.k)
SELECT count(*) FILTER (contaminated) = 0 AS success, CASE WHEN count(*) FILTER (contaminated) > 0 THEN 'leakage_check' ELSE 'versioning' END AS stage_name FROM hits""",
)
def production_leak(spark, d):
    """The preset with the benchmark as its evaluation texts: where it ends."""
    held = _read(spark, d, "benchmark").select(F.col("item_id").alias("_seq"), "text")
    result = pl.production(eval_texts=held, semantic_dedup=False).run(Dataset(_docs(spark, d)))
    return spark.createDataFrame([(result.success, result.stage_name)], "success boolean, stage_name string")


class Letters:
    """A small encoder: how often each of some letters stands in a text."""

    of = "etaoinshrd"

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in self.of] for t in texts]


@query(
    "semantic_stage",
    _greedy("few", "item_id", f"""few AS (SELECT item_id, text, [{', '.join(f"CAST(length(text) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in Letters.of)}] AS embedding FROM benchmark),
pairs AS (SELECT a.item_id AS i, b.item_id AS j FROM few a JOIN few b ON a.item_id < b.item_id WHERE {_COS} >= 0.98)""")
    + " SELECT item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY item_id) AS rn FROM few WHERE item_id IN (SELECT k FROM stays)) WHERE rn = 1",
)
def semantic_stage(spark, d):
    """Semantic deduplication with an encoder that is given, then by text."""
    df = _read(spark, d, "benchmark").select(F.col("item_id").alias("_seq"), "text")
    result = pl.SemanticDedup({"embedder": Letters(), "similarity_threshold": 0.98, "use_lsh": False}).process(Dataset(df))
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df.select(F.col("_seq").alias("item_id"), "text")


_BY_CHUNK = "WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents), " + _CLEANED


@query(
    "run_file_chunks",
    _BY_CHUNK + " SELECT text FROM (SELECT text, row_number() OVER (PARTITION BY chunk, text ORDER BY c.doc_id) AS rn FROM clean c JOIN n ON n.doc_id = c.doc_id) WHERE rn = 1",
)
def run_file_chunks(spark, d):
    """A file through the training preset, deduplicated within chunks of a hundred rows."""
    result = pl.training().run_file(spark, _written(spark, d, "documents", "doc_id"), chunk_size=100)
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df.select("text")


@query("run_file", f"WITH {_CLEANED} SELECT DISTINCT text FROM clean")
def run_file(spark, d):
    """A file loaded and through the feedback preset of long texts, written and read again."""
    out = shared_dir(spark)
    chain = pl.Pipeline([pl.TextCleaning(), pl.ExactDedup()])
    result = chain.run_file(spark, _written(spark, d, "documents", "doc_id"), output_path=out)
    if not result.success:
        raise RuntimeError(result.error)
    return jsonl.read_jsonl(spark, out, numbered=False).select("text")


@query(
    "loading_stage",
    "SELECT conv_id, turn, role, text, 'jsonl' AS format FROM conversations",
)
def loading_stage(spark, d):
    """The stage that reads a source itself."""
    result = pl.Loading({"source": _written(spark, d, "conversations", "conv_id")}).process(None)
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df.select("conv_id", "turn", "role", "text", F.lit(result.metadata["format"]).alias("format"))


@query(
    "leakage_gate",
    _CONTAMINATION.replace("SELECT e.k AS index", "SELECT count(*) FILTER (contaminated) AS contamination_count, true AS failed FROM (SELECT e.k AS index") + ")",
)
def leakage_gate(spark, d):
    """The gate's verdict on documents against the benchmark."""
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("_seq"), "text")
    result = pl.LeakageCheck({"eval_texts": items}).process(Dataset(_docs(spark, d)))
    n = leakage.contamination(_docs(spark, d), items).where("contaminated").count()
    return spark.createDataFrame([(n, not result.success)], "contamination_count long, failed boolean")


@query(
    "stage_graph",
    f"""SELECT event_id, lower({_collapse('event_type')}) AS text, CAST(CASE lower({_strip('event_type')}) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _TYPES.items())} ELSE 9 END AS BIGINT) AS label_id FROM events""",
)
def stage_graph(spark, d):
    """The six classic stages by their dependencies, added in no particular order."""
    kind = F.when(F.lower("event_type").isin(*_TYPES), F.col("event_type")).otherwise("other")
    df = _read(spark, d, "events").select(F.col("event_id").alias("_seq"), "event_id", F.col("event_type").alias("text"), kind.alias("label"))
    graph = pl.Graph()
    mapping = {"label_mapping": _TYPES | {"other": 9}}
    for stage in (pl.Normalizing(), pl.Routing(mapping), pl.Requirement(), pl.LabelRange(), pl.Cleaning(), pl.Loading()):
        graph.add_stage(stage)
    graph.build()
    result = graph.execute(Dataset(df))
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df.select("event_id", "text", "label_id")


@query("stream_dedup", f"WITH {_CLEANED} SELECT DISTINCT text FROM clean")
def stream_dedup(spark, d):
    """Documents arriving as JSONL files, cleaned and deduplicated as a stream."""
    path, out = _written(spark, d, "documents", "doc_id"), shared_dir(spark)
    stream = jsonl_stream.distinct_texts(jsonl_stream.cleaned(jsonl_stream.read_stream(spark, path)))
    jsonl_stream.run_to_end(stream, f"{out}/checkpoint", lambda df, _: df.select("text").write.mode("append").parquet(f"{out}/rows"))
    return spark.read.schema("text string").parquet(f"{out}/rows")


@query(
    "stream_windows",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(length(event_type)) AS BIGINT) AS chars FROM events GROUP BY 1",
)
def stream_windows(spark, d):
    """Events arriving as JSONL files, counted by the hour they happened in, with a watermark."""
    path, out = _written(spark, d, "events", "event_id"), shared_dir(spark)
    stream = jsonl_stream.read_stream(spark, path, "ts string, event_type string").withColumn("at", F.to_timestamp("ts"))
    counts = jsonl_stream.windowed_counts(stream, "1 hour", "365 days", "event_type", "at")
    kept = lambda df, i: df.select(F.col("window.start").alias("hour"), "n", "chars", F.lit(i).alias("batch")).write.mode("append").parquet(f"{out}/rows")
    jsonl_stream.run_to_end(counts, f"{out}/checkpoint", kept, "update")
    rows = spark.read.schema("hour timestamp, n long, chars long, batch int").parquet(f"{out}/rows")
    # of a window that several batches changed, its last state counts
    return rows.groupBy("hour").agg(F.max_by("n", "batch").alias("n"), F.max_by("chars", "batch").alias("chars"))


@query(
    "label_table",
    f"""SELECT event_id, CAST(CASE lower({_strip('event_type')}) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _TYPES.items())} ELSE 9 END AS BIGINT) AS label_id FROM events""",
)
def label_table(spark, d):
    """Labels routed by a mapping that is a table."""
    kind = F.when(F.col("event_type").isin(*_TYPES), F.upper("event_type")).otherwise(" other ")
    df = _read(spark, d, "events").select(F.col("event_id").alias("_seq"), "event_id", kind.alias("label"))
    mapping = spark.createDataFrame([*_TYPES.items(), ("other", 9)], "label string, label_id long")
    result = pl.Routing({"label_mapping": mapping}).process(Dataset(df))
    if not result.success:
        raise RuntimeError(result.error)
    return result.data.df.select("event_id", "label_id")
