"""Queries of response decoding, validation, run statistics, ontology and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import extraction, hooks, runs
from weftgraph.session import table
from weftgraph.sources import html, ontology

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "extraction_raw")
    return extraction.decode(raw.select("doc_id", "raw_response").distinct())


BASE = r"""
WITH raw AS (SELECT DISTINCT doc_id, raw_response FROM extraction_raw),
body AS (SELECT doc_id, raw_response, trim(CASE WHEN trim(regexp_extract(raw_response, '(?s)```(?:json)?\s*\n(.*?)\n```', 1)) <> '' THEN regexp_extract(raw_response, '(?s)```(?:json)?\s*\n(.*?)\n```', 1)
    WHEN regexp_extract(raw_response, '(?s)\{.*\}') <> '' THEN regexp_extract(raw_response, '(?s)\{.*\}') ELSE raw_response END) AS b FROM raw),
dec AS (SELECT doc_id, raw_response, b, raw_response IS NULL OR trim(raw_response) = '' AS blank, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM body),
prob AS (SELECT *, CASE WHEN blank THEN NULL WHEN j IS NULL THEN 'invalid json' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' WHEN json_extract(j, '$.entities') IS NULL OR json_type(j, '$.entities') = 'NULL' THEN 'no entities' WHEN json_type(j, '$.entities') <> 'ARRAY' THEN 'entities not a list' END AS problem FROM dec),
ent AS (SELECT doc_id, i - 1 AS idx, json_extract(j, '$.entities[' || (i - 1) || ']') AS item FROM prob, LATERAL (SELECT unnest(generate_series(1, json_array_length(j, '$.entities')::BIGINT)) AS i) WHERE problem IS NULL AND NOT blank),
rel AS (SELECT doc_id, i - 1 AS rel_pos, json_array_length(j, '$.entities')::BIGINT AS n, json_extract(j, '$.relations[' || (i - 1) || ']') AS item FROM prob, LATERAL (SELECT unnest(generate_series(1, json_array_length(j, '$.relations')::BIGINT)) AS i) WHERE problem IS NULL AND NOT blank),
e AS (SELECT doc_id, idx::INT AS idx, coalesce(nullif(item ->> '$.type', ''), nullif(item ->> '$.entity_type', ''), nullif(item ->> '$.type_id', '')) AS entity_type, item ->> '$.name' AS name, CASE WHEN (item ->> '$.confidence') IS NULL THEN 1.0 ELSE try_cast(item ->> '$.confidence' AS DOUBLE) END AS confidence, item FROM ent),
ok AS (SELECT * FROM e WHERE entity_type IS NOT NULL AND name <> '' AND confidence BETWEEN 0 AND 1),
r AS (SELECT doc_id, rel_pos::INT AS rel_pos, n, try_cast(item ->> '$.from_entity' AS INT) AS from_index, try_cast(item ->> '$.to_entity' AS INT) AS to_index, upper(coalesce(nullif(item ->> '$.relation_type', ''), nullif(item ->> '$.type', ''))) AS relation_type, CASE WHEN (item ->> '$.confidence') IS NULL THEN 1.0 ELSE try_cast(item ->> '$.confidence' AS DOUBLE) END AS confidence FROM rel),
okr AS (SELECT doc_id, rel_pos, from_index, to_index, relation_type, confidence FROM r WHERE relation_type IS NOT NULL AND confidence BETWEEN 0 AND 1 AND from_index >= 0 AND from_index < n AND to_index >= 0 AND to_index < n)
"""
_add("json_entities", lambda s, d: extraction.entity_rows(_decoded(s, d)).drop("properties"), BASE + "SELECT doc_id, idx, entity_type, name, confidence FROM ok")
_add("json_relations", lambda s, d: extraction.relation_rows(_decoded(s, d)).drop("properties"), BASE + "SELECT * FROM okr")
_add(
    "json_residual_props", lambda s, d: extraction.entity_rows(_decoded(s, d)).select("doc_id", "idx", F.explode("properties").alias("key", "value")).filter("key <> 'aliases'"),
    BASE + "SELECT doc_id, idx, key, item ->> ('$.' || key) AS value FROM (SELECT doc_id, idx, item, unnest(json_keys(item)) AS key FROM ok) WHERE key NOT IN ('type', 'entity_type', 'type_id', 'name', 'confidence', 'aliases')",
)
_add("json_invalid", lambda s, d: _decoded(s, d).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n")), BASE + "SELECT problem, count(*) AS n FROM prob WHERE problem IS NOT NULL GROUP BY 1")


def resolve_relation_indices(spark: SparkSession, d: str) -> DataFrame:
    decoded = _decoded(spark, d)
    # indices point into the raw array: what the filter drops takes its relations with it
    kept = extraction.min_confidence(extraction.entity_rows(decoded), 0.8)
    ends = kept.groupBy("doc_id", "idx").agg(F.min(F.struct("entity_type", "name")).alias("x")).select("doc_id", "idx", "x.entity_type", "x.name")
    rows = extraction.resolve_indices(extraction.relation_rows(decoded).drop("properties").distinct(), ends)
    return rows.select("doc_id", "rel_pos", "relation_type", "src_type", "src_name", "dst_type", "dst_name")


_add(
    "resolve_relation_indices", resolve_relation_indices,
    BASE + """, k AS (SELECT doc_id, idx, (min((entity_type, name))) AS x FROM ok WHERE confidence >= 0.8 GROUP BY ALL)
    SELECT o.doc_id, rel_pos, relation_type, a.x[1] AS src_type, a.x[2] AS src_name, b.x[1] AS dst_type, b.x[2] AS dst_name FROM (SELECT DISTINCT * FROM okr) o JOIN k a ON a.doc_id = o.doc_id AND a.idx = from_index JOIN k b ON b.doc_id = o.doc_id AND b.idx = to_index""",
)


def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    return extraction.type_summary(extraction.entity_rows(_decoded(spark, d)))


_add("entities_by_type", extraction_summary, BASE + "SELECT entity_type, count(*) AS n, count(DISTINCT name) AS n_names FROM ok GROUP BY 1")
_add("token_totals", lambda s, d: extraction.token_totals(table(s, d, "extraction_raw")), "SELECT model_name, sum(tokens_used)::BIGINT AS tokens, count(*) AS n FROM extraction_raw GROUP BY 1")


def _results(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "extraction_raw").select("doc_id", "success", "model_name", "tokens_used").distinct()
    n = table(spark, d, "extracted_entities").groupBy("doc_id").agg(F.count("*").alias("entities_found"))
    m = table(spark, d, "extracted_relations").groupBy("doc_id").agg(F.count("*").alias("relationships_created"))
    skipped = F.coalesce(F.col("tokens_used"), F.lit(0)) % 10 == 3
    return raw.join(n, "doc_id", "left").join(m, "doc_id", "left").withColumn("skipped", skipped).withColumn("model_name", F.coalesce("model_name", F.lit("none"))).withColumn("ord", F.struct("doc_id", "tokens_used", "success"))


_RES = """WITH res AS (SELECT r.doc_id, r.success, coalesce(r.model_name, 'none') AS model_name, r.tokens_used, coalesce(tokens_used, 0) % 10 = 3 AS skipped, n.c AS entities_found, m.c AS relationships_created FROM (SELECT DISTINCT doc_id, success, model_name, tokens_used FROM extraction_raw) r
LEFT JOIN (SELECT doc_id, count(*) AS c FROM extracted_entities GROUP BY 1) n USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM extracted_relations GROUP BY 1) m USING (doc_id)),
o AS (SELECT *, coalesce(success, false) OR skipped AS fine, sum(CASE WHEN coalesce(success, false) OR skipped THEN 1 ELSE 0 END) OVER w AS island, coalesce(sum(CASE WHEN skipped THEN 0 ELSE 1 END) OVER (PARTITION BY model_name ORDER BY doc_id, tokens_used NULLS FIRST, success NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM res WINDOW w AS (PARTITION BY model_name ORDER BY doc_id, tokens_used NULLS FIRST, success NULLS FIRST))
"""
_add(
    "pipeline_stats", lambda s, d: runs.statistics(_results(s, d)).withColumn("success_rate", F.round("success_rate", 6)),
    _RES + """SELECT count(*) AS total_documents, count(*) FILTER (coalesce(success, false) AND NOT skipped) AS processed, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT coalesce(success, false) AND NOT skipped) AS failed,
    coalesce(sum(entities_found) FILTER (success AND NOT skipped), 0)::BIGINT AS total_entities, coalesce(sum(relationships_created) FILTER (success AND NOT skipped), 0)::BIGINT AS total_relationships, round(count(*) FILTER (coalesce(success, false) AND NOT skipped) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM res""",
)
_add(
    "failure_runs", lambda s, d: runs.failure_runs(_results(s, d), "ord", ["model_name"]).select("model_name", F.col("first.doc_id").alias("first_doc"), F.col("last.doc_id").alias("last_doc"), "length"),
    _RES + "SELECT model_name, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS length FROM o WHERE NOT fine GROUP BY model_name, island",
)
_add(
    "abort_points", lambda s, d: runs.abort_points(_results(s, d), "ord", ["model_name"], 2).select("model_name", F.col("aborted_at.doc_id").alias("aborted_at")),
    _RES + ", z AS (SELECT *, row_number() OVER (PARTITION BY model_name, island ORDER BY doc_id, tokens_used NULLS FIRST, success NULLS FIRST) AS k FROM o WHERE NOT fine) SELECT model_name, min(doc_id) AS aborted_at FROM z WHERE k = 2 GROUP BY 1",
)
_add("batch_limit", lambda s, d: runs.take_batch(_results(s, d), "ord", ["model_name"], 40).select("model_name", "doc_id", "skipped"), _RES + "SELECT model_name, doc_id, skipped FROM o WHERE before < 40")

_add("ontology_counts", lambda s, d: ontology.counts(table(s, d, "entity_defs")), "SELECT entity_type_id, len(relations)::INT AS n_relations, len(examples)::INT AS n_examples FROM entity_defs")
_add(
    "ontology_lint", lambda s, d: ontology.lint(table(s, d, "entity_defs")),
    """SELECT entity_type_id, 'missing name' AS warning FROM entity_defs WHERE coalesce(name, '') = '' UNION ALL SELECT entity_type_id, 'missing description' FROM entity_defs WHERE coalesce(description, '') = ''
    UNION ALL SELECT entity_type_id, 'no relations' FROM entity_defs WHERE coalesce(len(relations), 0) = 0 UNION ALL SELECT entity_type_id, 'no examples' FROM entity_defs WHERE coalesce(len(examples), 0) = 0
    UNION ALL SELECT entity_type_id, 'unknown target ' || t FROM (SELECT DISTINCT entity_type_id, unnest(relations).target AS t FROM entity_defs) WHERE t NOT IN (SELECT entity_type_id FROM entity_defs)""",
)
_add("ontology_relations", lambda s, d: ontology.relations(table(s, d, "entity_defs")), "SELECT entity_type_id, r.target, r.forward, r.reverse FROM (SELECT entity_type_id, unnest(relations) AS r FROM entity_defs)")
_add(
    "ontology_examples", lambda s, d: ontology.examples(table(s, d, "entity_defs")),
    "SELECT entity_type_id, e.name, e.description FROM (SELECT entity_type_id, unnest(examples) AS e FROM entity_defs)",
)


def ontology_conformance(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.plans.graph import relations

    edges = relations(spark, d)
    allowed = ontology.relations(table(spark, d, "entity_defs")).select(F.col("entity_type_id").alias("src_type"), F.upper("forward").alias("rel_type"), F.col("target").alias("dst_type")).distinct().withColumn("ok", F.lit(True))
    joined = edges.join(allowed, ["src_type", "rel_type", "dst_type"], "left")
    return joined.groupBy("rel_type").agg(F.count_if("ok").alias("n_ok"), F.count_if(F.col("ok").isNull()).alias("n_other"))


def _conformance_sql() -> str:
    from weftgraph.plans.graph import BASE as GRAPH

    return GRAPH + """, allowed AS (SELECT DISTINCT entity_type_id AS s, upper(r.forward) AS f, r.target AS t FROM (SELECT entity_type_id, unnest(relations) AS r FROM entity_defs))
    SELECT rel_type, count(f) AS n_ok, count(*) - count(f) AS n_other FROM relation LEFT JOIN allowed ON s = src_type AND f = rel_type AND t = dst_type GROUP BY 1"""


_add("ontology_conformance", ontology_conformance, _conformance_sql())


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as HTML pages with their whole text, to be parsed again; a null title gives no title, a null text an empty page."""
    rows = table(spark, d, "parsed_documents").select("doc_id", "batch_no", "title", "text", "links").withColumn("links", F.expr("filter(coalesce(links, array()), l -> l.url IS NOT NULL)"))
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    anchors = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<li><a href="'), F.replace(escape(x["url"]), F.lit('"'), F.lit("&quot;")), F.lit('">'), escape(F.coalesce(x["text"], F.lit(""))), F.lit("</a></li>"))), "")
    body = F.pandas_udf(lambda texts: texts.map(html.page_body), "string")(F.coalesce("text", F.lit("")))
    head = F.coalesce(F.concat(F.lit("<title>Space : "), escape(F.col("title")), F.lit("</title>")), F.lit(""))
    content = F.when(F.col("text").isNull(), "").otherwise(F.concat(body, F.lit("<ul>"), anchors, F.lit("</ul>")))
    page = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><div id='main-content'>"), content, F.lit("</div></body></html>"))
    return rows.select("doc_id", "batch_no", "title", "text", F.concat(F.lit("Page_"), "doc_id", F.lit(".html")).alias("file"), page.alias("html"))


def _filled_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).filter("text IS NOT NULL AND title IS NOT NULL")


_add("page_titles", lambda s, d: html.parse_pages(_filled_pages(s, d), "file", "html", ["batch_no"]).select("doc_id", "title").distinct(), "SELECT DISTINCT coalesce(nullif(regexp_extract('Page_' || doc_id || '.html', '_(\\d+)\\.html$', 1), ''), 'Page_' || doc_id) AS doc_id, trim(title) AS title FROM parsed_documents WHERE text IS NOT NULL AND title IS NOT NULL")
_add(
    "page_links", lambda s, d: html.link_rows(html.parse_pages(_filled_pages(s, d), "file", "html", ["batch_no"])).select("url", "link_type").groupBy("url", "link_type").agg(F.count("*").alias("n")),
    """SELECT url, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'external' ELSE 'internal' END AS link_type, count(*) AS n FROM (SELECT unnest(links).url AS url FROM parsed_documents WHERE text IS NOT NULL AND title IS NOT NULL)
    WHERE url <> '' AND NOT starts_with(url, '#') AND (url LIKE 'http://%' OR url LIKE 'https://%' OR url LIKE '%.html') GROUP BY ALL""",
)
_add("page_markdown", lambda s, d: html.parse_pages(_pages(s, d), "file", "html", ["batch_no"]).select("doc_id", "batch_no", "text", "content_hash"))
_add(
    "corpus_summary",
    lambda s, d: html.corpus_summary(table(s, d, "parsed_documents")),
    "SELECT count(*) AS n_docs, sum(coalesce(len(links), 0))::BIGINT AS n_links, sum(length(text))::BIGINT AS n_chars FROM parsed_documents",
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_documents").select("doc_id", "title", "text", "breadcrumb", "source_file", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return rows.distinct()


_add(
    "markdown_export", lambda s, d: html.markdown_files(_docs(s, d)),
    """SELECT doc_id, '# ' || coalesce(title, '') || E'\n\n**Document ID:** ' || doc_id || E'  \n**Source:** ' || coalesce(source_file, '') || E'  \n**Breadcrumb:** ' || coalesce(array_to_string(breadcrumb, ' → '), '') || E'  \n**Content Hash:** ' || content_hash || E'\n\n---\n\n' || coalesce(text, '') || E'\n' AS body
    FROM (SELECT DISTINCT doc_id, title, text, breadcrumb, source_file, sha256(coalesce(text, '')) AS content_hash FROM parsed_documents)""",
)
_add(
    "prompts", lambda s, d: _docs(s, d).select("doc_id", F.sha2(extraction.prompt("Types: {{ENTITY_TYPE_DEFINITIONS}} Text: {{TEXT}}", "a, b", F.coalesce("text", F.lit("")), 3000), 256).alias("prompt_hash")).distinct(),
    "SELECT DISTINCT doc_id, sha256('Types: a, b Text: ' || CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || E'\n\n[... content truncated ...]' ELSE coalesce(text, '') END) AS prompt_hash FROM parsed_documents",
)
_add(
    "index_records",
    lambda s, d: html.index_records(table(s, d, "parsed_documents").select("doc_id", "title", "text", "breadcrumb", "links", "source_file", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "parsed_at", "metadata").filter("doc_id IS NOT NULL")).select("doc_id", F.get_json_object("record", "$.metadata.title").alias("title"), F.get_json_object("record", "$.metadata.content_hash").alias("content_hash"), F.get_json_object("record", "$.metadata.parsed_at").alias("parsed_at"), F.md5(F.get_json_object("record", "$.text")).alias("text_md5")).distinct(),
    "SELECT DISTINCT doc_id, CASE WHEN map_contains(metadata, 'title') THEN map_extract(metadata, 'title')[1] ELSE title END AS title, sha256(coalesce(text, '')) AS content_hash, strftime(parsed_at, '%Y-%m-%dT%H:%M:%S.%f') AS parsed_at, md5(text) AS text_md5 FROM parsed_documents WHERE doc_id IS NOT NULL",
)


def export_entities(spark: SparkSession, d: str) -> DataFrame:
    from weftgraph.plans.graph import entities

    return ontology.export_definitions(entities(spark, d))


def _export_sql() -> str:
    from weftgraph.plans.graph import BASE as GRAPH

    return GRAPH + "SELECT entity_type, '# ID: ' || entity_type || E'\\n## Examples:\\n' || string_agg('### ' || name, E'\\n' ORDER BY name) AS body FROM (SELECT DISTINCT entity_type, name FROM entity) GROUP BY entity_type"


_add("export_entities", export_entities, _export_sql())
_add(
    "alias_lists",
    lambda s, d: extraction.alias_lists(extraction.entity_rows(_decoded(s, d))),
    BASE + "SELECT entity_type, name, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (SELECT DISTINCT entity_type, name, unnest(CAST(json_extract(item, '$.aliases') AS VARCHAR[])) AS alias FROM ok WHERE json_extract(item, '$.aliases') IS NOT NULL) GROUP BY ALL",
)


def review_script(spark: SparkSession, d: str) -> DataFrame:
    """A script for every document: drop the second entity, merge the third into the first, try what is void by then, rename, end; what follows the end doesn't count."""
    ents = extraction.entity_rows(_decoded(spark, d)).select("doc_id", "idx", "entity_type", "name").distinct()
    ents = ents.groupBy("doc_id", "idx").agg(F.min(F.struct("entity_type", "name")).alias("x")).select("doc_id", "idx", "x.entity_type", "x.name")
    steps = [(1, "delete", 2, None, None), (2, "merge", 3, 1, None), (3, "merge", 1, 2, None), (4, "edit", 3, None, "kept"), (5, "merge", 4, 3, None), (6, "edit", 1, None, "renamed"), (7, "done", None, None, None), (8, "delete", 1, None, None)]
    columns = (("seq", "int"), ("action", "string"), ("n", "int"), ("m", "int"), ("new_name", "string"))
    script = F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(step, columns))) for step in steps))
    edits = ents.select("doc_id").distinct().select("doc_id", F.explode(script).alias("s")).select("doc_id", "s.*")
    return hooks.review(ents, edits)


_add(
    "review_script", review_script,
    BASE + """, u AS (SELECT doc_id, idx, min((entity_type, name)) AS x FROM ok GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM u)
    , t AS (SELECT doc_id, max(x[1]) FILTER (n = 1) AS t1, max(x[1]) FILTER (n = 3) AS t3 FROM k GROUP BY 1)
    SELECT doc_id, idx, x[1] AS entity_type, CASE WHEN n = 1 THEN 'renamed' WHEN n = 3 THEN 'kept' ELSE x[2] END AS name FROM k JOIN t USING (doc_id)
    WHERE n <> 2 AND NOT (n = 3 AND t1 = t3) AND NOT (n = 4 AND x[1] = t3 AND t1 <> t3)""",
)
