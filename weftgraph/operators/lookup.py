"""Graph reads: lookups, lists, statistics, neighbours."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_name

NAMESPACE = re.compile(r"^[a-zA-Z0-9]+$")


def validate_namespace(namespace: str) -> str:
    if not NAMESPACE.match(namespace or ""):
        raise ValueError(f"not a namespace: {namespace!r}")
    return namespace


def name_key(name: str) -> str:
    """normalize_name of one literal."""
    plain = re.sub(r"\([^)]*\)", "", name).lower()
    return re.sub(" +", " ", re.sub(r"[^a-z0-9]", " ", plain)).strip(" ")


def get_entity(entities: DataFrame, namespace: str, entity_type: str, name: str) -> DataFrame:
    return entities.filter((F.col("namespace") == namespace) & (F.col("entity_type") == entity_type) & (F.col("normalized_name") == name_key(name))).limit(1)


def get_document(docs: DataFrame, namespace: str, doc_id: str) -> DataFrame:
    return docs.filter((F.col("namespace") == namespace) & (F.col("doc_id") == doc_id)).limit(1)


def list_entities(entities: DataFrame, namespace: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
    """Ordered by type and name; the limit is the feature and runs as a distributed top-k."""
    rows = entities.filter(F.col("namespace") == namespace)
    if entity_type is not None:
        rows = rows.filter(F.col("entity_type") == entity_type)
    return rows.orderBy("entity_type", "name", "normalized_name").limit(limit)


def list_types(entities: DataFrame, namespace: str) -> DataFrame:
    return entities.filter((F.col("namespace") == namespace) & (F.col("entity_type") != "")).select("entity_type").distinct().orderBy("entity_type")


def list_documents(docs: DataFrame, namespace: str, limit: int = 100) -> DataFrame:
    return docs.filter(F.col("namespace") == namespace).orderBy("doc_id").limit(limit)


def document_entities(mentions: DataFrame, entities: DataFrame, namespace: str, doc_id: str) -> DataFrame:
    """Entities a document mentions, with the edge's properties, ordered by type and name."""
    edge = mentions.filter((F.col("namespace") == namespace) & (F.col("doc_id") == doc_id))
    edge = edge.select("namespace", "entity_type", "normalized_name", F.col("confidence").alias("mention_confidence"))
    nodes = entities.filter(F.col("namespace") == namespace)
    return edge.join(nodes, ["namespace", "entity_type", "normalized_name"]).orderBy("entity_type", "name")


def related_documents(mentions: DataFrame, docs: DataFrame, namespace: str, entity_type: str, name: str, limit: int = 10) -> DataFrame:
    """Documents that mention an entity, ordered by doc_id."""
    edge = mentions.filter((F.col("namespace") == namespace) & (F.col("entity_type") == entity_type) & (F.col("normalized_name") == name_key(name)))
    edge = edge.select("namespace", "doc_id", F.col("confidence").alias("mention_confidence"))
    return edge.join(docs.filter(F.col("namespace") == namespace), ["namespace", "doc_id"]).orderBy("doc_id").limit(limit)


def related_entities(relations: DataFrame, entities: DataFrame, namespace: str, entity_type: str, name: str, limit: int = 10) -> DataFrame:
    """Entities one edge away in either direction: (entity, type, relationship)."""
    key = name_key(name)
    edges = relations.filter(F.col("namespace") == namespace)
    out = edges.filter((F.col("src_type") == entity_type) & (F.col("src_norm") == key)).select(F.col("dst_type").alias("entity_type"), F.col("dst_norm").alias("normalized_name"), F.col("rel_type").alias("relationship"))
    into = edges.filter((F.col("dst_type") == entity_type) & (F.col("dst_norm") == key)).select(F.col("src_type").alias("entity_type"), F.col("src_norm").alias("normalized_name"), F.col("rel_type").alias("relationship"))
    others = out.unionByName(into).distinct().filter(~((F.col("entity_type") == entity_type) & (F.col("normalized_name") == key)))
    named = others.join(entities.filter(F.col("namespace") == namespace).select("entity_type", "normalized_name", "name"), ["entity_type", "normalized_name"])
    return named.select(F.col("name").alias("entity"), F.col("entity_type").alias("type"), "relationship").orderBy("entity", "type", "relationship").limit(limit)


def k_hop(relations: DataFrame, namespace: str, entity_type: str, name: str, depth: int = 2) -> DataFrame:
    """(entity_type, normalized_name, hops) of everything within ``depth`` undirected edges; a bounded unrolling of joins."""
    edges = relations.filter(F.col("namespace") == namespace)
    both = edges.select(F.col("src_type").alias("at"), F.col("src_norm").alias("an"), F.col("dst_type").alias("bt"), F.col("dst_norm").alias("bn"))
    both = both.unionByName(both.select(F.col("bt").alias("at"), F.col("bn").alias("an"), F.col("at").alias("bt"), F.col("an").alias("bn"))).distinct()
    key = name_key(name)
    here = edges.filter(((F.col("src_type") == entity_type) & (F.col("src_norm") == key)) | ((F.col("dst_type") == entity_type) & (F.col("dst_norm") == key)))
    seen = here.select(F.lit(entity_type).alias("entity_type"), F.lit(key).alias("normalized_name"), F.lit(0).alias("hops")).distinct()
    edge_frontier = seen
    for hop in range(1, depth + 1):
        step = edge_frontier.join(both, (F.col("entity_type") == F.col("at")) & (F.col("normalized_name") == F.col("an"))).select(F.col("bt").alias("entity_type"), F.col("bn").alias("normalized_name")).distinct()
        edge_frontier = step.join(seen, ["entity_type", "normalized_name"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(edge_frontier)
    return seen


def node_stats(docs: DataFrame, entities: DataFrame, namespace: str | None = None) -> DataFrame:
    """True node counts per label."""
    labels = docs.select("namespace", F.lit("Doc").alias("label")).unionByName(entities.select("namespace", F.lit("Entity").alias("label")))
    if namespace is not None:
        labels = labels.filter(F.col("namespace") == namespace)
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def edge_stats(mentions: DataFrame, relations: DataFrame, namespace: str | None = None) -> DataFrame:
    """Edge counts per type, each edge once."""
    types = mentions.select("namespace", F.lit("MENTIONS").alias("rel_type")).unionByName(relations.select("namespace", "rel_type"))
    if namespace is not None:
        types = types.filter(F.col("namespace") == namespace)
    return types.groupBy("rel_type").agg(F.count("*").alias("n"))


def query(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Free-form SQL over the graph tables, given as views."""
    return spark.sql(sql, **tables) if "{" in sql else _with_views(spark, tables, sql)


def _with_views(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def add_name_key(df: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with its key form; names that have none (no letters or digits) are left out."""
    return df.withColumn("normalized_name", normalize_name(name)).filter("normalized_name <> ''")
