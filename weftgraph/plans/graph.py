"""Queries over the property graph built from the project's tables, with their SQL.

docs: the last reading of each page; entities: valid extracted entities, first writer wins; mentions: last writer wins;
relations: extracted relations resolved by (doc_id, idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import UNKNOWN_VALUES, content_hash, is_known, normalize_name
from weftgraph.operators import lookup, upsert
from weftgraph.operators.store import GraphStore
from weftgraph.session import discard, materialize, new_path, table

ENTITY = ["namespace", "entity_type", "normalized_name"]
MENTION = ["namespace", "doc_id", "entity_type", "normalized_name"]
EDGE = ["namespace", "src_type", "src_norm", "rel_type", "dst_type", "dst_norm"]
SPACE, KIND, NAME = "oriel", "service", "Quellmark Core"


def docs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_documents").select("namespace", "doc_id", F.col("source_file").alias("source_path"), content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "title", "batch_no", "parsed_at")
    return upsert.last_wins(pages.distinct(), ["namespace", "doc_id"], ["batch_no", "parsed_at", "content_hash", "title"])


def located(spark: SparkSession, d: str) -> DataFrame:
    """Valid entity rows with their page's namespace."""
    home = table(spark, d, "parsed_documents").groupBy("doc_id").agg(F.min("namespace").alias("namespace"))
    rows = table(spark, d, "extracted_entities").select("doc_id", "idx", "entity_type", "name", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "extracted_at")
    rows = rows.filter(is_known("name") & (F.trim("entity_type") != "") & F.col("confidence").between(0, 1)).distinct()
    return lookup.add_name_key(rows.join(home, "doc_id"))


def entities(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    order = ["extracted_at", "doc_id", "idx", "name"]
    return upsert.first_wins(rows or located(spark, d), ENTITY, order).select(*ENTITY, "name", F.unix_millis(F.col("extracted_at").cast("timestamp")).alias("created_at"))


def mentions(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return upsert.last_wins(rows or located(spark, d), MENTION, ["extracted_at", "idx", "confidence", "name"]).select(*MENTION, "confidence")


def relations(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    ends = upsert.first_wins(rows or located(spark, d), ["doc_id", "idx"], ["extracted_at", "entity_type", "name", "confidence"]).select("doc_id", "idx", *ENTITY)
    src = ends.toDF("doc_id", "from_index", "namespace", "src_type", "src_norm")
    dst = ends.drop("namespace").toDF("doc_id", "to_index", "dst_type", "dst_norm")
    rel = table(spark, d, "extracted_relations").select("doc_id", "rel_pos", "from_index", "to_index", F.upper("relation_type").alias("rel_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "extracted_at").distinct()
    rows = rel.join(src, ["doc_id", "from_index"]).join(dst, ["doc_id", "to_index"])
    return upsert.last_wins(rows, EDGE, ["extracted_at", "doc_id", "rel_pos", "confidence"]).select(*EDGE, "confidence")


_stored: dict[tuple, GraphStore] = {}


def stored(spark: SparkSession, d: str) -> GraphStore:
    """The graph of a data folder, written once a session as tables partitioned by namespace; built anew where the folder's files have changed."""
    stamp = []
    for name in ("parsed_documents", "extracted_entities", "extracted_relations"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        stamp.append((status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, d, *stamp)
    if key not in _stored:
        store = GraphStore(spark, new_path(spark, "graph"))
        rows = materialize(located(spark, d), "located")
        store.replace("docs", docs(spark, d))
        for name, make in (("entities", entities), ("mentions", mentions), ("relations", relations)):
            store.replace(name, make(spark, d, rows))
        discard(rows)
        _stored[key] = store
    return _stored[key]


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace({c}, '\\([^)]*\\)', '', 'g')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


_UNKNOWN = ", ".join(f"'{v}'" for v in UNKNOWN_VALUES)
BASE = f"""
WITH docs AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY namespace, doc_id ORDER BY batch_no DESC NULLS LAST, parsed_at DESC NULLS LAST, content_hash DESC NULLS LAST, title DESC NULLS LAST) AS n FROM
    (SELECT DISTINCT namespace, doc_id, source_file AS source_path, sha256(coalesce(text, '')) AS content_hash, title, batch_no, parsed_at FROM parsed_documents)) WHERE n = 1),
located AS (SELECT *, {norm_sql("name")} AS normalized_name FROM (SELECT DISTINCT e.doc_id, e.idx, e.entity_type, e.name, coalesce(e.confidence, 1.0) AS confidence, e.extracted_at, h.namespace
    FROM extracted_entities e JOIN (SELECT doc_id, min(namespace) AS namespace FROM parsed_documents GROUP BY doc_id) h USING (doc_id)
    WHERE regexp_matches(lower(trim(e.name)), '[\\p{{L}}\\p{{N}}]') AND lower(trim(e.name)) NOT IN ({_UNKNOWN}) AND trim(e.entity_type) <> '' AND coalesce(e.confidence, 1.0) BETWEEN 0 AND 1)
    WHERE {norm_sql("name")} <> ''),
entity AS (SELECT namespace, entity_type, normalized_name, name, epoch_us(extracted_at) // 1000 AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY namespace, entity_type, normalized_name ORDER BY extracted_at NULLS FIRST, doc_id, idx NULLS FIRST, name) AS n FROM located) WHERE n = 1),
mention AS (SELECT namespace, doc_id, entity_type, normalized_name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY namespace, doc_id, entity_type, normalized_name ORDER BY extracted_at DESC NULLS LAST, idx DESC NULLS LAST, confidence DESC, name DESC) AS n FROM located) WHERE n = 1),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY extracted_at NULLS FIRST, entity_type, name, confidence) AS n FROM located) WHERE n = 1),
relation AS (SELECT namespace, src_type, src_norm, rel_type, dst_type, dst_norm, confidence FROM (SELECT *, row_number() OVER (PARTITION BY namespace, src_type, src_norm, rel_type, dst_type, dst_norm ORDER BY extracted_at DESC NULLS LAST, doc_id DESC, rel_pos DESC NULLS LAST, confidence DESC) AS n FROM
    (SELECT DISTINCT s.namespace, s.entity_type AS src_type, s.normalized_name AS src_norm, upper(r.relation_type) AS rel_type, t.entity_type AS dst_type, t.normalized_name AS dst_norm, coalesce(r.confidence, 1.0) AS confidence, r.extracted_at, r.doc_id, r.rel_pos
     FROM extracted_relations r JOIN ends s ON s.doc_id = r.doc_id AND s.idx = r.from_index JOIN ends t ON t.doc_id = r.doc_id AND t.idx = r.to_index)) WHERE n = 1)
"""
KEY = lookup.name_key(NAME)
_AT = f"namespace = '{SPACE}'"

QUERIES, ORACLE = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, BASE + sql


_add("entity_upsert_first_wins", entities, "SELECT * FROM entity")
_add("mention_upsert_last_wins", mentions, "SELECT * FROM mention")
_add("relation_upsert", relations, "SELECT * FROM relation")
_add("document_upsert", lambda s, d: docs(s, d).drop("parsed_at"), "SELECT namespace, doc_id, source_path, content_hash, title, batch_no FROM docs")
_add(
    "related_documents",
    lambda s, d: stored(s, d).find_related_documents(SPACE, KIND, NAME).select("doc_id", "source_path", "title", "mention_confidence"),
    f"SELECT doc_id, source_path, title, confidence AS mention_confidence FROM mention JOIN docs USING (namespace, doc_id) WHERE {_AT} AND entity_type = '{KIND}' AND normalized_name = '{KEY}' ORDER BY doc_id LIMIT 10",
)


def _busiest(m: DataFrame) -> DataFrame:
    """The document with most mentions of the namespace, as a one-row table."""
    return m.filter(F.col("namespace") == SPACE).groupBy("namespace", "doc_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(1).select("namespace", "doc_id")


def document_entities(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    doc = _busiest(store.table("mentions", [SPACE])).first().doc_id
    return store.get_document_entities(SPACE, doc).select(F.lit(doc).alias("doc_id"), "entity_type", "name", "mention_confidence")


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    doc = _busiest(store.table("mentions", [SPACE])).first().doc_id
    return lookup.get_document(store.table("docs", [SPACE]), SPACE, doc).select("namespace", "doc_id", "source_path", "content_hash", "title")


_NODE = [*ENTITY, "name", "created_at"]


_add(
    "document_entities", document_entities,
    f", busy AS (SELECT namespace, doc_id FROM mention WHERE {_AT} GROUP BY ALL ORDER BY count(*) DESC, doc_id LIMIT 1) SELECT m.doc_id, e.entity_type, e.name, m.confidence AS mention_confidence FROM mention m JOIN busy USING (namespace, doc_id) JOIN entity e USING (namespace, entity_type, normalized_name)",
)
_add("entity_lookup", lambda s, d: lookup.get_entity(stored(s, d).table("entities", [SPACE]), SPACE, KIND, NAME).select(*_NODE), f"SELECT * FROM entity WHERE {_AT} AND entity_type = '{KIND}' AND normalized_name = '{KEY}'")
_add(
    "document_lookup", document_lookup,
    f", busy AS (SELECT namespace, doc_id FROM mention WHERE {_AT} GROUP BY ALL ORDER BY count(*) DESC, doc_id LIMIT 1) SELECT namespace, doc_id, source_path, content_hash, title FROM docs JOIN busy USING (namespace, doc_id)",
)
_add("list_entities", lambda s, d: stored(s, d).list_entities(SPACE).select(*_NODE), f"SELECT * FROM entity WHERE {_AT} ORDER BY entity_type, name, normalized_name LIMIT 100")
_add("list_entities_by_type", lambda s, d: stored(s, d).list_entities(SPACE, "person", 50).select(*_NODE), f"SELECT * FROM entity WHERE {_AT} AND entity_type = 'person' ORDER BY name, normalized_name LIMIT 50")
_add("list_types", lambda s, d: stored(s, d).list_entity_types(SPACE), f"SELECT DISTINCT entity_type FROM entity WHERE {_AT}")
_add("list_documents", lambda s, d: stored(s, d).list_documents(SPACE).select("doc_id", "source_path", "title"), f"SELECT doc_id, source_path, title FROM docs WHERE {_AT} ORDER BY doc_id LIMIT 100")
_add("node_stats", lambda s, d: stored(s, d).statistics(SPACE)[0], f"SELECT 'Doc' AS label, count(*) AS n FROM docs WHERE {_AT} UNION ALL SELECT 'Entity', count(*) FROM entity WHERE {_AT}")
_add("edge_stats", lambda s, d: stored(s, d).statistics(SPACE)[1], f"SELECT 'MENTIONS' AS rel_type, count(*) AS n FROM mention WHERE {_AT} UNION ALL SELECT rel_type, count(*) FROM relation WHERE {_AT} GROUP BY rel_type")
_add("global_stats", lambda s, d: stored(s, d).statistics()[0].agg(F.sum("n").alias("n_nodes")), "SELECT (SELECT count(*) FROM docs) + (SELECT count(*) FROM entity) AS n_nodes")
_add(
    "related_entities",
    lambda s, d: stored(s, d).find_related_entities(SPACE, KIND, NAME, 50),
    f""", hop AS (SELECT dst_type AS t, dst_norm AS k, rel_type FROM relation WHERE {_AT} AND src_type = '{KIND}' AND src_norm = '{KEY}' UNION SELECT src_type, src_norm, rel_type FROM relation WHERE {_AT} AND dst_type = '{KIND}' AND dst_norm = '{KEY}')
    SELECT e.name AS entity, t AS type, rel_type AS relationship FROM hop JOIN entity e ON e.namespace = '{SPACE}' AND e.entity_type = t AND e.normalized_name = k WHERE NOT (t = '{KIND}' AND k = '{KEY}') ORDER BY 1, 2, 3 LIMIT 50""",
)
_add(
    "k_hop",
    lambda s, d: stored(s, d).k_hop(SPACE, KIND, NAME, 2),
    f""", e AS (SELECT src_type AS a1, src_norm AS a2, dst_type AS b1, dst_norm AS b2 FROM relation WHERE {_AT} UNION SELECT dst_type, dst_norm, src_type, src_norm FROM relation WHERE {_AT}),
    h1 AS (SELECT DISTINCT b1, b2 FROM e WHERE a1 = '{KIND}' AND a2 = '{KEY}'), h2 AS (SELECT DISTINCT e.b1, e.b2 FROM e JOIN h1 ON e.a1 = h1.b1 AND e.a2 = h1.b2),
    r AS (SELECT a1 AS entity_type, a2 AS normalized_name, 0 AS hops FROM e WHERE a1 = '{KIND}' AND a2 = '{KEY}' UNION SELECT b1, b2, 1 FROM h1 UNION SELECT b1, b2, 2 FROM h2)
    SELECT entity_type, normalized_name, min(hops) AS hops FROM r GROUP BY ALL""",
)
_add(
    "entity_confidence",
    lambda s, d: stored(s, d).table("entities").join(stored(s, d).table("mentions").groupBy(*ENTITY).agg(F.max("confidence").alias("c")), ENTITY, "left").select(*ENTITY, F.coalesce("c", F.lit(1.0)).alias("confidence")),
    "SELECT e.namespace, e.entity_type, e.normalized_name, coalesce(max(m.confidence), 1.0) AS confidence FROM entity e LEFT JOIN mention m USING (namespace, entity_type, normalized_name) GROUP BY ALL",
)


def _doomed(e: DataFrame) -> DataFrame:
    return e.filter((F.col("namespace") == SPACE) & (F.col("entity_type") == "service"))


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    e, m, r = (stored(spark, d).table(t) for t in ("entities", "mentions", "relations"))
    left = upsert.delete_entities(e, m, r, _doomed(e))
    parts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, t in zip(("entities", "mentions", "relations"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add(
    "delete_cascade", delete_cascade,
    f""", gone AS (SELECT * FROM entity WHERE {_AT} AND entity_type = 'service'), k AS (SELECT namespace || '|' || entity_type || '|' || normalized_name AS k FROM gone)
    SELECT 'entities' AS table_name, count(*) AS n FROM entity WHERE namespace || '|' || entity_type || '|' || normalized_name NOT IN (SELECT k FROM k)
    UNION ALL SELECT 'mentions', count(*) FROM mention WHERE namespace || '|' || entity_type || '|' || normalized_name NOT IN (SELECT k FROM k)
    UNION ALL SELECT 'relations', count(*) FROM relation WHERE namespace || '|' || src_type || '|' || src_norm NOT IN (SELECT k FROM k) AND namespace || '|' || dst_type || '|' || dst_norm NOT IN (SELECT k FROM k)""",
)
def clear_namespace(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a copy of the graph's nodes after a namespace is cleared."""
    store, copy = stored(spark, d), GraphStore(spark, new_path(spark, "cleared"))
    for name in ("docs", "entities"):
        copy.replace(name, store.table(name))
    copy.clear_namespace(SPACE)
    return copy.statistics()[0]


_add(
    "clear_namespace", clear_namespace,
    f"SELECT 'Doc' AS label, count(*) AS n FROM docs WHERE namespace <> '{SPACE}' UNION ALL SELECT 'Entity', count(*) FROM entity WHERE namespace <> '{SPACE}'",
)


def update_properties(spark: SparkSession, d: str) -> DataFrame:
    nodes = upsert.first_wins(table(spark, d, "entities").select(*ENTITY, "updated_at", F.col("properties")), ENTITY, [F.col("updated_at").desc_nulls_last(), F.to_json("properties")])
    changes = nodes.filter("entity_type = 'service'").select(*ENTITY, F.map_from_arrays(F.array(F.lit("status"), F.lit("version"), F.lit("owner")), F.array(F.lit("checked"), F.lit(None).cast("string"), F.col("namespace"))).alias("properties"))
    updated, _ = upsert.update_entities(nodes, changes, ENTITY, 1_750_000_000_000)
    return updated.select(*ENTITY, "updated_at", F.col("properties")["status"].alias("status"), F.col("properties")["version"].alias("version"), F.col("properties")["owner"].alias("owner"))


QUERIES["update_properties"] = update_properties
ORACLE["update_properties"] = """
WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, entity_type, normalized_name ORDER BY updated_at DESC NULLS LAST, to_json(properties)) AS n FROM entities) WHERE n = 1)
SELECT namespace, entity_type, normalized_name, CASE WHEN entity_type = 'service' THEN 1750000000000 ELSE updated_at END AS updated_at,
  CASE WHEN entity_type = 'service' THEN 'checked' ELSE map_extract(properties, 'status')[1] END AS status,
  CASE WHEN entity_type = 'service' THEN NULL ELSE map_extract(properties, 'version')[1] END AS version,
  CASE WHEN entity_type = 'service' THEN namespace ELSE map_extract(properties, 'owner')[1] END AS owner FROM n
"""


def _given_map(e: DataFrame) -> DataFrame:
    """Every service goes into the first name of its namespace: a canonical map for the merge query."""
    some = _doomed(e)
    first = some.groupBy("namespace", "entity_type").agg(F.min("normalized_name").alias("canonical"))
    return some.join(first, ["namespace", "entity_type"]).filter("normalized_name <> canonical").select("namespace", "entity_type", F.col("normalized_name").alias("duplicate"), "canonical")


def merge_repoint(spark: SparkSession, d: str) -> DataFrame:
    e, m, r = (stored(spark, d).table(t) for t in ("entities", "mentions", "relations"))
    moved, _ = upsert.repoint(m, r, _given_map(e))
    return moved.select(*MENTION)


_add(
    "merge_repoint", merge_repoint,
    f", c AS (SELECT min(normalized_name) AS canonical FROM entity WHERE {_AT} AND entity_type = 'service') SELECT DISTINCT namespace, doc_id, entity_type, CASE WHEN {_AT} AND entity_type = 'service' THEN (SELECT canonical FROM c) ELSE normalized_name END AS normalized_name FROM mention",
)


def merge_repoint_relations(spark: SparkSession, d: str) -> DataFrame:
    e, m, r = (stored(spark, d).table(t) for t in ("entities", "mentions", "relations"))
    return upsert.repoint(m, r, _given_map(e))[1].select(*EDGE)


_add(
    "merge_repoint_relations", merge_repoint_relations,
    f""", c AS (SELECT min(normalized_name) AS canonical FROM entity WHERE {_AT} AND entity_type = 'service'),
    x AS (SELECT namespace, src_type, CASE WHEN {_AT} AND src_type = 'service' THEN (SELECT canonical FROM c) ELSE src_norm END AS src_norm, rel_type, dst_type, CASE WHEN {_AT} AND dst_type = 'service' THEN (SELECT canonical FROM c) ELSE dst_norm END AS dst_norm, src_type = dst_type AND src_norm = dst_norm AS was_loop FROM relation)
    SELECT DISTINCT namespace, src_type, src_norm, rel_type, dst_type, dst_norm FROM x WHERE was_loop OR NOT (src_type = dst_type AND src_norm = dst_norm)""",
)


def edge_properties(spark: SparkSession, d: str) -> DataFrame:
    """Relations stored in two batches with their properties: of each property the last writer's value stays."""
    store = GraphStore(spark, new_path(spark, "edges"))
    ends = upsert.first_wins(located(spark, d), ["doc_id", "idx"], ["extracted_at", "entity_type", "name", "confidence"])
    store.replace("entities", entities(spark, d))
    rows = table(spark, d, "extracted_relations").filter("relation_type IS NOT NULL").groupBy("doc_id", "rel_pos", "from_index", "to_index", F.upper("relation_type").alias("rel_type")).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    for end, index in (("src", "from_index"), ("dst", "to_index")):
        rows = rows.join(ends.select("doc_id", F.col("idx").alias(index), *([F.col("namespace")] if end == "src" else []), F.col("entity_type").alias(f"{end}_type"), F.col("normalized_name").alias(f"{end}_norm")), ["doc_id", index])
    noted = lambda some, name: rows.filter(some).withColumn("properties", F.create_map(F.lit(name), F.col("doc_id"), F.lit("last"), F.concat_ws(":", F.lit(name), "doc_id")))
    store.upsert_relations(noted("confidence < 0.8", "low"), ["doc_id", "rel_pos", "confidence"])
    store.upsert_relations(noted("confidence >= 0.8", "high"), ["doc_id", "rel_pos", "confidence"])
    return store.table("relations").select(*EDGE, *(F.col("properties")[n].alias(n) for n in ("low", "high", "last")))


_add(
    "edge_properties", edge_properties,
    """, r AS (SELECT doc_id, rel_pos, from_index, to_index, upper(relation_type) AS rel_type, max(coalesce(confidence, 1.0)) AS confidence FROM extracted_relations WHERE relation_type IS NOT NULL GROUP BY ALL),
    x AS (SELECT s.namespace, s.entity_type AS src_type, s.normalized_name AS src_norm, rel_type, t.entity_type AS dst_type, t.normalized_name AS dst_norm, r.doc_id, r.confidence FROM r JOIN ends s ON s.doc_id = r.doc_id AND s.idx = from_index JOIN ends t ON t.doc_id = r.doc_id AND t.idx = to_index),
    g AS (SELECT namespace, src_type, src_norm, rel_type, dst_type, dst_norm, max(doc_id) FILTER (confidence < 0.8) AS low, max(doc_id) FILTER (confidence >= 0.8) AS high FROM x GROUP BY ALL)
    SELECT *, coalesce('high:' || high, 'low:' || low) AS last FROM g WHERE low IS NOT NULL OR high IS NOT NULL""",
)
