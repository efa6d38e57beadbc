"""Queries of scalar functions, hashing, dictionary and resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.similarity import cosine
from weftgraph.functions.text import content_hash, normalize_name, normalize_text
from weftgraph.operators import extraction, resolve, runs, vectors
from weftgraph.plans.graph import norm_sql
from weftgraph.session import new_path, table

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def text_sql(c: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9-]', ' ', 'g'), ' +', ' ', 'g')), '')"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("name").distinct()


_add("normalize_names", lambda s, d: _names(s, d).select("name", normalize_name("name").alias("normalized_name")), f"SELECT DISTINCT name, {norm_sql('name')} AS normalized_name FROM entities")
_add("normalize_text", lambda s, d: _names(s, d).select("name", normalize_text("name").alias("plain")), f"SELECT DISTINCT name, {text_sql('name')} AS plain FROM entities")
_DICT = f"WITH dict AS (SELECT {text_sql('key')} AS key, arg_max(value, line_no) AS value FROM norm_dict GROUP BY 1 HAVING {text_sql('key')} <> '')"


def _words(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "extracted_entities").filter("name IS NOT NULL").select(F.explode(F.split("name", " ")).alias("word"))
    return names.filter("word <> ''").distinct()


_add(
    "dictionary_expand", lambda s, d: resolve.expand_names(_words(s, d), "word", table(s, d, "norm_dict")),
    _DICT + f" SELECT w.word, {text_sql(f'coalesce(value, {text_sql("w.word")})')} AS expanded FROM (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM extracted_entities) w LEFT JOIN dict ON dict.key = {text_sql('w.word')} WHERE w.word <> ''",
)
_add("dictionary_lines", lambda s, d: resolve.dictionary(table(s, d, "norm_dict")), _DICT + " SELECT key, value FROM dict")
_add("content_hash", lambda s, d: table(s, d, "documents").select("doc_id", content_hash("text").alias("content_hash")), "SELECT doc_id, sha256(text) AS content_hash FROM documents")
_add(
    "hash_duplicates",
    lambda s, d: runs.repeated_contents(table(s, d, "documents"), "text"),
    "SELECT sha256(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)


def skip_processed(spark: SparkSession, d: str) -> DataFrame:
    """Documents updated in the last week of the data against those before."""
    rows = table(spark, d, "documents").select("doc_id", "namespace", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), (F.col("updated_at") >= "2025-05-01").alias("late"))
    rows = rows.withColumn("namespace", F.coalesce("namespace", F.lit("none")))
    return runs.skip_processed(rows.filter("late"), rows.filter("NOT coalesce(late, false)"), "doc_id").select("doc_id", "namespace")


_add(
    "skip_processed", skip_processed,
    """WITH r AS (SELECT doc_id, coalesce(namespace, 'none') AS namespace, sha256(coalesce(text, '')) AS h, coalesce(updated_at >= TIMESTAMP '2025-05-01', false) AS late FROM documents)
    SELECT min(doc_id) AS doc_id, namespace FROM r WHERE late AND NOT EXISTS (SELECT 1 FROM r o WHERE NOT o.late AND o.namespace = r.namespace AND o.h = r.h) GROUP BY namespace, h""",
)
_add(
    "min_confidence", lambda s, d: extraction.min_confidence(table(s, d, "extracted_entities"), 0.9).groupBy("entity_type").agg(F.count("*").alias("n")),
    "SELECT entity_type, count(*) AS n FROM extracted_entities WHERE confidence >= 0.9 GROUP BY 1",
)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return extraction.of_types(table(spark, d, "extracted_entities"), ["Person", "SERVICE"]).select("doc_id", "idx", "entity_type").distinct()


_add("type_filter", _typed, "SELECT DISTINCT doc_id, idx, entity_type FROM extracted_entities WHERE lower(entity_type) IN ('person', 'service')")


def _nodes(spark: SparkSession, d: str, late: bool) -> DataFrame:
    rows = table(spark, d, "entities").filter(("batch_no >= 9" if late else "batch_no < 9") + " AND normalized_name <> ''")
    return rows.groupBy("namespace", "entity_type", F.col("normalized_name").alias("name")).agg(F.min("batch_no").alias("b")).withColumn("ord", F.col("name")).drop("b")


_add(
    "fuzzy_best_match",
    lambda s, d: resolve.best_matches(_nodes(s, d, True), _nodes(s, d, False), ["namespace", "entity_type"], 0.85).select("namespace", "entity_type", F.col("name_a").alias("name"), F.col("name_b").alias("matched"), F.round("score", 6).alias("score")),
    """WITH n AS (SELECT DISTINCT namespace, entity_type, normalized_name AS name, batch_no >= 9 AS late FROM entities WHERE normalized_name <> ''),
    s AS (SELECT a.namespace, a.entity_type, a.name, b.name AS matched, jaro_winkler_similarity(a.name, b.name) AS s FROM n a JOIN n b ON a.late AND NOT b.late AND a.namespace = b.namespace AND a.entity_type = b.entity_type)
    SELECT namespace, entity_type, name, matched, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY namespace, entity_type, name ORDER BY round(s, 9) DESC, matched) AS k FROM s WHERE s >= 0.85 - 1e-12) WHERE k = 1""",
)


def _all_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter("normalized_name <> ''")
    return rows.select("namespace", "entity_type", F.col("normalized_name").alias("name")).distinct().withColumn("ord", F.col("name"))


_add(
    "fuzzy_pairs",
    lambda s, d: resolve.similar_pairs(_all_names(s, d), ["namespace", "entity_type"], 0.9, "jaro_winkler").select("namespace", "entity_type", "name_a", "name_b", F.round("score", 6).alias("score")),
    """WITH n AS (SELECT DISTINCT namespace, entity_type, normalized_name AS name FROM entities WHERE normalized_name <> '')
    SELECT a.namespace, a.entity_type, a.name AS name_a, b.name AS name_b, round(jaro_winkler_similarity(a.name, b.name), 6) AS score FROM n a JOIN n b ON a.namespace = b.namespace AND a.entity_type = b.entity_type AND a.name < b.name WHERE jaro_winkler_similarity(a.name, b.name) >= 0.9 - 1e-12""",
)


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    return resolve.similar_pairs(_all_names(spark, d), ["namespace", "entity_type"], 0.75)


_add("sequence_pairs", lambda s, d: _sequence(s, d).select("namespace", "entity_type", "name_a", "name_b", F.round("score", 6).alias("score")))
_add("canonical_merge", lambda s, d: resolve.canonical_map(_sequence(s, d), ["namespace", "entity_type"]))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id", "embedding")


def _asked(df: DataFrame) -> DataFrame:
    return df.filter("vec_id % 50 = 0")


_TOP = """WITH s AS (SELECT q.vec_id AS query_id, b.vec_id, {score} AS s FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) """
_L2 = "1 - list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) / 2"
_DOT = "list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"{_DOT} / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_add("vector_topk", lambda s, d: vectors.nearest(_asked(_vectors(s, d)), _vectors(s, d), ["label"], 5).select("query_id", "vec_id", "rank"), _TOP.format(score=_L2) + "SELECT query_id, vec_id, rank FROM r WHERE rank <= 5")
_add("vector_threshold", lambda s, d: vectors.nearest(_asked(_vectors(s, d)), _vectors(s, d), ["label"], 5, 0.3).select("query_id", "vec_id", "rank"), _TOP.format(score=_L2) + "SELECT query_id, vec_id, rank FROM r WHERE rank <= 5 AND s >= 0.3")
_add("vector_l2_score", lambda s, d: vectors.nearest(_asked(_vectors(s, d)), _vectors(s, d), ["label"], 1).select("query_id", "vec_id", F.round("score", 5).alias("score")), _TOP.format(score=_L2) + "SELECT query_id, vec_id, round(s, 5) AS score FROM r WHERE rank = 1")
_add("vector_cosine", lambda s, d: vectors.nearest(_asked(_vectors(s, d)), _vectors(s, d), ["label"], 1, score=cosine).select("query_id", "vec_id", F.round("score", 5).alias("score")), _TOP.format(score=_COS) + "SELECT query_id, vec_id, round(s, 5) AS score FROM r WHERE rank = 1")
_add("vector_leader", lambda s, d: resolve.leaders(_vectors(s, d).withColumnRenamed("vec_id", "ord"), ["label"], 0.3).select("label", "ord", "leader"))
_add("vector_stats", lambda s, d: vectors.counts(_vectors(s, d), ["label"]), "SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY 1")
_add(
    "vector_ids", lambda s, d: _vectors(s, d).select(vectors.vector_id(F.lit("main"), F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("id")),
    "SELECT 'main:' || label || ':' || vec_id AS id FROM embeddings",
)


_add(
    "hybrid_score", lambda s, d: resolve.hybrid_scores(table(s, d, "similar_pairs")),
    "SELECT namespace, entity_type, least(name_a, name_b) AS name_a, greatest(name_a, name_b) AS name_b, round(0.6 * coalesce(max(score) FILTER (method = 'vector'), 0) + 0.4 * coalesce(max(score) FILTER (method = 'fuzzy'), 0), 6) AS score FROM similar_pairs WHERE name_a IS NOT NULL AND name_b IS NOT NULL AND score IS NOT NULL GROUP BY namespace, entity_type, least(name_a, name_b), greatest(name_a, name_b)",
)


_add(
    "dedupe_candidates", lambda s, d: resolve.unordered_once(table(s, d, "similar_pairs")),
    "SELECT namespace, entity_type, name_a, name_b, score, pair_id FROM (SELECT namespace, entity_type, least(name_a, name_b) AS name_a, greatest(name_a, name_b) AS name_b, score, pair_id, row_number() OVER (PARTITION BY namespace, entity_type, least(name_a, name_b), greatest(name_a, name_b) ORDER BY score DESC NULLS LAST, pair_id) AS n FROM similar_pairs WHERE name_a <> name_b) WHERE n = 1",
)


def fuzzy_hook(spark: SparkSession, d: str) -> DataFrame:
    """Later nodes marked by the fuzzy hook as duplicates of earlier, stored ones."""
    from weftgraph.operators.hooks import fuzzy_hook as hook
    from weftgraph.operators.store import GraphStore

    store = GraphStore(spark, new_path(spark, "hooked"))
    names = table(spark, d, "entities").filter("normalized_name <> '' AND namespace = 'oriel'").select("namespace", "entity_type", "normalized_name", F.col("normalized_name").alias("name"), "batch_no")
    store.replace("entities", names.filter("batch_no < 9").drop("batch_no").distinct())
    new = names.filter("batch_no >= 9").groupBy("entity_type", "name").agg(F.min("batch_no").alias("idx"))
    return hook(0.85)(new, store, "oriel").select("entity_type", "name", "duplicate_of")


_add(
    "fuzzy_hook", fuzzy_hook,
    """WITH n AS (SELECT DISTINCT entity_type, normalized_name AS name, batch_no >= 9 AS late FROM entities WHERE normalized_name <> '' AND namespace = 'oriel'),
    s AS (SELECT a.entity_type, a.name, b.name AS other, jaro_winkler_similarity(a.name, b.name) AS s FROM n a JOIN n b ON a.late AND NOT b.late AND a.entity_type = b.entity_type),
    m AS (SELECT entity_type, name, other FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, name ORDER BY round(s, 9) DESC, other) AS k FROM s WHERE s >= 0.85 - 1e-12) WHERE k = 1)
    SELECT DISTINCT n.entity_type, n.name, nullif(m.other, n.name) AS duplicate_of FROM n LEFT JOIN m USING (entity_type, name) WHERE n.late""",
)


def hook_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Names after the normalising and the dictionary hook."""
    from weftgraph.operators.hooks import Hooks, dictionary_hook, normalize_hook

    rows = table(spark, d, "extracted_entities").filter("name IS NOT NULL").select("doc_id", "idx", "name").distinct().withColumn("properties", F.lit(None).cast("map<string,string>"))
    chain = Hooks([normalize_hook(), dictionary_hook(table(spark, d, "norm_dict"))])
    return chain.run_before(rows.withColumn("raw", F.col("name"))).select("doc_id", "idx", "raw", "name").distinct()


_add(
    "hook_normalise", hook_normalise,
    _DICT + f", r AS (SELECT DISTINCT doc_id, idx, name AS raw, coalesce(nullif({text_sql('name')}, ''), name) AS plain FROM extracted_entities WHERE name IS NOT NULL) SELECT doc_id, idx, raw, coalesce(nullif({text_sql(f'coalesce(value, {text_sql("plain")})')}, ''), plain) AS name FROM r LEFT JOIN dict ON dict.key = {text_sql('plain')}",
)
