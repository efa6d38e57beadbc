"""GraphStore: the graph tables as versioned Parquet, with set-oriented upserts.

A table lies under ``root/<table>/namespace=<ns>/version=<k>``; a manifest file names the current version of every namespace. A write makes new versions of the namespaces it touches only,
then replaces the manifest, so readers see the old or the new table, never a mixture. Reads of a namespace open its folder only. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import errors
from weftgraph.functions.text import normalize_name
from weftgraph.operators import lookup, upsert, vectors
from weftgraph.schemas import KEYS, PROPERTIES, SCHEMAS
from weftgraph.session import delete, discard, list_names, materialize, prepare, read_text, write_text


def _now(now_ms: int | None):
    return F.lit(now_ms or int(time.time() * 1000)).cast("bigint")


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root.rstrip("/")

    # versions
    def _manifest(self, table: str) -> dict | None:
        names = [n for n in list_names(self.spark, f"{self.root}/{table}") if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.root}/{table}/{names[-1]}")) if names else None

    def table(self, name: str, namespaces: list[str] | None = None) -> DataFrame:
        """The current table, or only some namespaces of it."""
        state = self._manifest(name)
        current = {ns: k for ns, k in (state["versions"] if state else {}).items() if namespaces is None or ns in namespaces}
        if not current:
            return self.spark.createDataFrame([], SCHEMAS[name])
        paths = [f"{self.root}/{name}/namespace={ns}/version={k}" for ns, k in sorted(current.items())]
        columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
        return self.spark.read.schema(SCHEMAS[name] + ", version int").option("basePath", f"{self.root}/{name}").parquet(*paths).select(*columns)

    @staticmethod
    def _namespaces(df: DataFrame) -> list[str]:
        return sorted(r.namespace for r in df.select("namespace").distinct().collect())  # one row a namespace

    def _swap(self, name: str, df: DataFrame, touched: list[str] | None) -> None:
        """``df`` becomes the content of the touched namespaces, or of the whole table. Rows of a namespace are brought together for few files; AQE splits a large one."""
        state = self._manifest(name) or {"number": 0, "versions": {}}
        number = state["number"] + 1
        shaped = df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema))
        if touched is None or touched:
            shaped.withColumn("version", F.lit(number)).hint("rebalance", "namespace").write.mode("append").partitionBy("namespace", "version").parquet(f"{self.root}/{name}")
        there = {n.partition("=")[2] for n in list_names(self.spark, f"{self.root}/{name}") if n.startswith("namespace=")}
        written = {ns for ns in (there if touched is None else there & set(touched)) if f"version={number}" in list_names(self.spark, f"{self.root}/{name}/namespace={ns}")}
        touched = sorted(written | set(state["versions"])) if touched is None else touched
        versions = {ns: k for ns, k in state["versions"].items() if ns not in touched} | {ns: number for ns in written}
        write_text(self.spark, f"{self.root}/{name}/manifest-{number:08}.json", json.dumps({"number": number, "versions": versions}))
        if state["number"]:
            delete(self.spark, f"{self.root}/{name}/manifest-{state['number']:08}.json")
        for ns in touched:
            if ns in state["versions"]:
                delete(self.spark, f"{self.root}/{name}/namespace={ns}/version={state['versions'][ns]}")

    def replace(self, name: str, df: DataFrame) -> None:
        """``df`` becomes the whole table."""
        self._swap(name, df, None)

    # schema
    def create_schema(self) -> None:
        for name in SCHEMAS:
            if self._manifest(name) is None:
                self._swap(name, self.spark.createDataFrame([], SCHEMAS[name]), [])

    def schema_gaps(self) -> DataFrame:
        """(table_name, gap): every table that is missing or holds a key twice."""
        gaps = []
        for name, key in KEYS.items():
            if self._manifest(name) is None:
                gaps.append((name, "missing table"))
            elif not self.table(name).groupBy(*key).count().filter("count > 1").isEmpty():
                gaps.append((name, "repeated keys"))
        return self.spark.createDataFrame(gaps, "table_name string, gap string")

    def verify_schema(self) -> None:
        """Raises SchemaError that names all gaps."""
        gaps = [f"{r.gap} {r.table_name}" for r in self.schema_gaps().collect()]
        if gaps:
            raise errors.SchemaError("; ".join(gaps))

    # batches
    def upsert_documents(self, docs: DataFrame, now_ms: int | None = None) -> None:
        """New documents are created, known ones get path, hash, title and merged properties. Of a key twice in the batch the last in (source_path, content_hash) counts."""
        staged = upsert.last_wins(docs, KEYS["docs"], [c for c in ("source_path", "content_hash") if c in docs.columns])
        staged = staged.withColumns({"created_at": _now(now_ms), "updated_at": _now(now_ms)} | ({} if "properties" in docs.columns else {"properties": F.lit(None).cast(PROPERTIES)}))
        staged = materialize(staged, "staged")
        self._merge("docs", staged)
        discard(staged)

    def _merge(self, name: str, staged: DataFrame) -> None:
        """Staged rows, one a key, replace known ones but for created_at; their properties are merged over the known ones."""
        touched = self._namespaces(staged)
        if not touched:
            return
        old = self.table(name, touched)
        known = old.select(*KEYS[name], F.col("properties").alias("__old"))
        staged = staged.join(known, KEYS[name], "left").withColumn("properties", upsert.merge_properties(F.col("__old"), F.col("properties"))).drop("__old")
        self._swap(name, upsert.overwrite(old, staged, KEYS[name], ["created_at"]), touched)

    def upsert_entities(self, rows: DataFrame, order: list[str], now_ms: int | None = None) -> int:
        """Insert-if-absent of (namespace, entity_type, name[, properties]); existing rows stay. Returns the number of new ones."""
        named = rows.withColumn("normalized_name", normalize_name("name")).filter("normalized_name <> ''")
        staged = upsert.first_wins(named, KEYS["entities"], order).withColumns({"created_at": _now(now_ms), "updated_at": _now(now_ms)})
        staged = materialize(staged.select(*KEYS["entities"], "name", "created_at", "updated_at", *(c for c in ("properties",) if c in staged.columns)), "staged")
        touched = self._namespaces(staged)
        old = self.table("entities", touched)
        new = materialize(staged.join(old.select(*KEYS["entities"]), KEYS["entities"], "left_anti"), "new")
        n, touched = new.count(), self._namespaces(new)
        if n:
            self._swap("entities", self.table("entities", touched).unionByName(new, allowMissingColumns=True), touched)
        discard(staged)
        discard(new)
        return n

    def _edges(self, name: str, rows: DataFrame, order: list[str], now_ms: int | None) -> DataFrame:
        """One row a key: the last writer's confidence, and of each property the last writer's value."""
        last = upsert.last_wins(rows, KEYS[name], order).select(*KEYS[name], "confidence").withColumn("created_at", _now(now_ms))
        if "properties" not in rows.columns:
            return last.withColumn("properties", F.lit(None).cast(PROPERTIES))
        return last.join(upsert.last_properties(rows, KEYS[name], order), KEYS[name], "left")

    def upsert_mentions(self, rows: DataFrame, order: list[str], now_ms: int | None = None) -> DataFrame:
        """Edges (namespace, doc_id, entity_type, normalized_name, confidence[, properties]) whose two ends exist. Returns the others as a written table, with ``problem``."""
        staged = materialize(self._edges("mentions", rows, order, now_ms), "staged")
        touched = self._namespaces(staged)
        docs = self.table("docs", touched).select(*KEYS["docs"], F.lit(True).alias("__doc"))
        ents = self.table("entities", touched).select(*KEYS["entities"], F.lit(True).alias("__entity"))
        marked = staged.join(docs, KEYS["docs"], "left").join(ents, KEYS["entities"], "left")
        problem = F.when(F.col("__doc").isNull(), "no document").when(F.col("__entity").isNull(), "no entity")
        marked = materialize(marked.withColumn("problem", problem).drop("__doc", "__entity"), "marked")
        self._merge("mentions", marked.filter("problem IS NULL").drop("problem"))
        bad = materialize(marked.filter("problem IS NOT NULL").select(*KEYS["mentions"], "problem"), "rejected")
        discard(staged)
        discard(marked)
        return bad

    def upsert_relations(self, rows: DataFrame, order: list[str], now_ms: int | None = None) -> DataFrame:
        """Edges between existing entities, one a (source, type, target), types in upper case. Returns the others as a written table, with ``problem``."""
        staged = materialize(self._edges("relations", rows.withColumn("rel_type", F.upper("rel_type")), order, now_ms), "staged")
        ents = self.table("entities", self._namespaces(staged)).select(*KEYS["entities"])
        marked = staged
        for end in ("src", "dst"):
            marked = marked.join(ents.toDF("namespace", f"{end}_type", f"{end}_norm").withColumn(f"__{end}", F.lit(True)), ["namespace", f"{end}_type", f"{end}_norm"], "left")
        problem = F.when(F.col("__src").isNull(), "no source").when(F.col("__dst").isNull(), "no target")
        marked = materialize(marked.withColumn("problem", problem).drop("__src", "__dst"), "marked")
        self._merge("relations", marked.filter("problem IS NULL").drop("problem"))
        bad = materialize(marked.filter("problem IS NOT NULL").select(*KEYS["relations"], "problem"), "rejected")
        discard(staged)
        discard(marked)
        return bad

    # single rows, by the same merges
    def _row(self, values: tuple, schema: str) -> DataFrame:
        return self.spark.createDataFrame([values], f"{schema}, properties {PROPERTIES}")

    def create_document(self, namespace: str, doc_id: str, source_path: str, content_hash: str, title: str | None = None, **properties: str) -> None:
        """Create or update one document."""
        self._check(namespace)
        self.upsert_documents(self._row((namespace, doc_id, source_path, content_hash, title, properties), "namespace string, doc_id string, source_path string, content_hash string, title string"))

    def create_entity(self, namespace: str, entity_type: str, name: str, **properties: str) -> None:
        self._check(namespace)
        if not self.upsert_entities(self._row((namespace, entity_type, name, properties), "namespace string, entity_type string, name string"), ["name"]):
            raise errors.DuplicateEntityError(f"{namespace}:{entity_type}:{name}")

    def create_relationship(self, namespace: str, from_type: str, from_name: str, to_type: str, to_name: str, rel_type: str, confidence: float = 1.0, **properties: str) -> None:
        """Create or update one edge; both entities must exist."""
        values = (namespace, from_type, lookup.name_key(from_name), rel_type, to_type, lookup.name_key(to_name), confidence, properties)
        for r in self.upsert_relations(self._row(values, "namespace string, src_type string, src_norm string, rel_type string, dst_type string, dst_norm string, confidence double"), ["confidence"]).collect():  # at most one row
            raise errors.EntityNotFoundError(f"{r.problem}: {namespace}:{from_type}:{from_name} {rel_type} {to_type}:{to_name}")

    def add_mention(self, namespace: str, doc_id: str, entity_type: str, name: str, confidence: float = 1.0, **properties: str) -> None:
        """Create or update one mention; the document and the entity must exist."""
        values = (namespace, doc_id, entity_type, lookup.name_key(name), confidence, properties)
        for r in self.upsert_mentions(self._row(values, "namespace string, doc_id string, entity_type string, normalized_name string, confidence double"), ["confidence"]).collect():  # at most one row
            raise (errors.DocumentNotFoundError if r.problem == "no document" else errors.EntityNotFoundError)(f"{namespace}:{doc_id}:{entity_type}:{name}")

    def update_entity(self, namespace: str, entity_type: str, name: str, **properties: str | None) -> None:
        row = self._row((namespace, entity_type, lookup.name_key(name), properties), "namespace string, entity_type string, normalized_name string")
        updated, missing = upsert.update_entities(self.table("entities", [namespace]), row, KEYS["entities"], int(time.time() * 1000))
        if not missing.isEmpty():
            raise errors.EntityNotFoundError(f"{namespace}:{entity_type}:{name}")
        self._swap("entities", updated, [namespace])

    def delete_entity(self, namespace: str, entity_type: str, name: str) -> bool:
        if self.get_entity(namespace, entity_type, name) is None:
            return False
        key = self.spark.createDataFrame([(namespace, entity_type, lookup.name_key(name))], "namespace string, entity_type string, normalized_name string")
        left = upsert.delete_entities(*(self.table(t, [namespace]) for t in ("entities", "mentions", "relations")), key)
        for table, df in zip(("mentions", "relations", "entities"), (left[1], left[2], left[0])):
            self._swap(table, df, [namespace])
        return True

    def get_entity(self, namespace: str, entity_type: str, name: str) -> dict | None:
        found = lookup.get_entity(self.table("entities", [namespace]), namespace, entity_type, name).first()
        return found.asDict() if found else None

    def get_document(self, namespace: str, doc_id: str) -> dict | None:
        found = lookup.get_document(self.table("docs", [namespace]), namespace, doc_id).first()
        return found.asDict() if found else None

    def list_entities(self, namespace: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
        return lookup.list_entities(self.table("entities", [namespace]), namespace, entity_type, limit)

    def list_entity_types(self, namespace: str) -> DataFrame:
        return lookup.list_types(self.table("entities", [namespace]), namespace)

    def list_documents(self, namespace: str, limit: int = 100) -> DataFrame:
        return lookup.list_documents(self.table("docs", [namespace]), namespace, limit)

    def get_document_entities(self, namespace: str, doc_id: str) -> DataFrame:
        return lookup.document_entities(self.table("mentions", [namespace]), self.table("entities", [namespace]), namespace, doc_id)

    def find_related_documents(self, namespace: str, entity_type: str, name: str, limit: int = 10) -> DataFrame:
        return lookup.related_documents(self.table("mentions", [namespace]), self.table("docs", [namespace]), namespace, entity_type, name, limit)

    def find_related_entities(self, namespace: str, entity_type: str, name: str, limit: int = 10) -> DataFrame:
        return lookup.related_entities(self.table("relations", [namespace]), self.table("entities", [namespace]), namespace, entity_type, name, limit)

    def k_hop(self, namespace: str, entity_type: str, name: str, depth: int = 2) -> DataFrame:
        return lookup.k_hop(self.table("relations", [namespace]), namespace, entity_type, name, depth)

    def statistics(self, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Node counts per label and edge counts per type."""
        some = None if namespace is None else [namespace]
        return lookup.node_stats(self.table("docs", some), self.table("entities", some), namespace), lookup.edge_stats(self.table("mentions", some), self.table("relations", some), namespace)

    def merge_entities(self, canonical: DataFrame, mentions_only: bool = False) -> int:
        """Repoint all edges by (namespace, entity_type, duplicate, canonical), then drop the duplicates; the number of mentions and relations that moved.

        The merged names are kept as JSON in the canonical entity's property ``aliases``. With ``mentions_only`` the duplicates' relations go with them.
        """
        canonical = materialize(canonical, "canonical")
        touched = self._namespaces(canonical)
        mentions, relations, entities = (self.table(t, touched) for t in ("mentions", "relations", "entities"))
        gone = canonical.select("namespace", "entity_type", F.col("duplicate").alias("normalized_name"))
        moved = mentions.join(gone, KEYS["entities"], "left_semi").count()
        if mentions_only:
            _, _, relations = upsert.delete_entities(entities, mentions, relations, gone)
        else:
            ends = gone.toDF("namespace", "t", "n")
            hit = [relations.join(ends, (relations["namespace"] == ends["namespace"]) & (relations[f"{e}_type"] == ends["t"]) & (relations[f"{e}_norm"] == ends["n"]), "left_semi") for e in ("src", "dst")]
            moved += hit[0].unionByName(hit[1]).select(*KEYS["relations"]).distinct().count()
        mentions, pointed = upsert.repoint(mentions, relations, canonical)
        merged = upsert.with_aliases(entities, canonical).join(gone, KEYS["entities"], "left_anti")
        self._swap("mentions", mentions, touched)
        self._swap("relations", pointed, touched)
        self._swap("entities", merged, touched)
        discard(canonical)
        return moved

    def clear_namespace(self, namespace: str) -> int:
        """Drops edges, then nodes, then vectors of a namespace; the number of nodes gone. Only its folders are touched."""
        self._check(namespace)
        n = sum(self.table(t, [namespace]).count() for t in ("docs", "entities"))
        for t in ("mentions", "relations", "embeddings", "docs", "entities"):
            if self._manifest(t) is not None:
                self._swap(t, self.spark.createDataFrame([], SCHEMAS[t]), [namespace])
        return n

    # vectors
    def add_embeddings(self, rows: DataFrame) -> None:
        """(namespace, entity_type, entity_name, embedding[, metadata]), keyed by namespace:type:name; a known vector is replaced, its metadata merged."""
        ident = vectors.vector_id(F.col("namespace"), F.col("entity_type"), F.col("entity_name"))
        staged = upsert.first_wins(rows.withColumn("entity_id", ident), KEYS["embeddings"], ["entity_name"])
        staged = materialize(staged if "metadata" in staged.columns else staged.withColumn("metadata", F.lit(None).cast(PROPERTIES)), "staged")
        touched = self._namespaces(staged)
        old = self.table("embeddings", touched)
        known = old.select(*KEYS["embeddings"], F.col("metadata").alias("__old"))
        staged_ = staged.join(known, KEYS["embeddings"], "left").withColumn("metadata", upsert.merge_properties(F.col("__old"), F.col("metadata"))).drop("__old")
        if touched:
            self._swap("embeddings", upsert.overwrite(old, staged_, KEYS["embeddings"]), touched)
        discard(staged)

    def search_similar(self, queries: DataFrame, limit: int = 5, threshold: float = 0.85, show: list[str] = ()) -> DataFrame:
        """Neighbours of (namespace, entity_type, vec_id, embedding) rows: (query_id, vec_id, score, rank, *show); the threshold comes after the top-k."""
        base = self.table("embeddings").select("namespace", "entity_type", F.col("entity_id").alias("vec_id"), "embedding", *show)
        return vectors.nearest(queries, base, ["namespace", "entity_type"], limit, threshold, show=["entity_type", *show] if show else [])

    def vector_stats(self, namespace: str | None = None) -> DataFrame:
        return self.table("embeddings", None if namespace is None else [namespace]).transform(vectors.counts, ["namespace"])

    def delete_vectors(self, namespace: str) -> int:
        gone = self.table("embeddings", [namespace]).count()
        if gone:
            self._swap("embeddings", self.spark.createDataFrame([], SCHEMAS["embeddings"]), [namespace])
        return gone

    def document_exists(self, namespace: str, doc_id: str) -> bool:
        return self.get_document(namespace, doc_id) is not None

    def hash_exists(self, namespace: str, content_hash: str) -> bool:
        return not self.table("docs", [namespace]).filter(F.col("content_hash") == content_hash).isEmpty()

    @staticmethod
    def _check(namespace: str) -> None:
        try:
            lookup.validate_namespace(namespace)
        except ValueError as e:
            raise errors.InvalidNamespaceError(str(e)) from None
