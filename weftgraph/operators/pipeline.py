"""The ingest run as one set-oriented plan: skip, prompt, extract, decode, filter, hooks, upserts, statistics, failure policy."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import PipelineError
from weftgraph.functions.text import content_hash, normalize_name
from weftgraph.operators import extraction, runs
from weftgraph.operators.extractors import Extractor
from weftgraph.operators.hooks import Hooks
from weftgraph.operators.store import GraphStore
from weftgraph.session import discard, materialize


@dataclass
class Settings:
    namespace: str
    types: list[str] = field(default_factory=list)
    min_confidence: float = 0.0
    skip_processed: bool = True
    max_batch_docs: int | None = None
    max_failures: int | None = None
    dry_run: bool = False
    template: str | None = None  # with {{ENTITY_TYPE_DEFINITIONS}} and {{TEXT}}
    definitions: str = ""

    def __post_init__(self):
        GraphStore._check(self.namespace)
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be in 0 to 1")


def prepare_batch(docs: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """``documents`` in order with namespace, content_hash and skipped, cut at max_batch_docs. A page that could not be read (column ``problem``) is neither skipped nor extracted."""
    base = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"namespace": F.lit(settings.namespace), "content_hash": content_hash("text"), "ord": F.struct(F.coalesce("source_file", F.lit("")).alias("file"), "doc_id")})
    if "problem" not in base.columns:
        base = base.withColumn("problem", F.lit(None).cast("string"))
    marked = base.withColumn("skipped", F.lit(False))
    if settings.skip_processed and not settings.dry_run:
        fresh = runs.skip_processed(base.filter("problem IS NULL"), docs, "ord").select(F.col("doc_id").alias("__doc"), F.col("source_file").alias("__file"), F.lit(True).alias("__fresh"))
        joined = base.join(fresh, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source_file").eqNullSafe(F.col("__file")), "left")
        marked = joined.withColumn("skipped", F.col("__fresh").isNull() & F.col("problem").isNull()).drop("__doc", "__file", "__fresh")
    if settings.max_batch_docs is not None:
        marked = runs.take_batch(marked, "ord", ["namespace"], settings.max_batch_docs)
    return marked


def ingest(store: GraphStore, documents: DataFrame, extractor: Extractor, settings: Settings, hooks: Hooks | None = None) -> DataFrame:
    """Run one batch of (doc_id, text, source_file, title[, problem]) and return its one-row statistics, a written table.

    Order is by (source_file, doc_id). Documents whose content the namespace has, and repeats of a content within the batch, are skipped. With a template the extractor gets each
    document's prompt. Entities are filtered without renumbering; relations whose end is gone fall away; an entity that a hook marks as ``duplicate_of`` another is stored as
    that one. Null texts count as empty. After ``max_failures`` failures in a row what came before is stored, no after_batch hook runs, and PipelineError is raised with the
    statistics up to there.
    """
    hooks, began = hooks or Hooks(), time.time()
    work = materialize(prepare_batch(store.table("docs", [settings.namespace]), documents, settings), "batch")
    todo = work.filter("NOT skipped AND problem IS NULL")
    asked = todo.select("doc_id", "text", "content_hash")
    if settings.template is not None:
        asked = asked.withColumn("prompt", extraction.prompt(settings.template, settings.definitions, F.col("text")))
    raw = materialize(extractor.extract(asked), "raw")
    decoded = extraction.decode(raw.filter("success"))
    entities = extraction.of_types(extraction.min_confidence(extraction.entity_rows(decoded), settings.min_confidence), settings.types)
    entities = hooks.run_before(entities, store=store, namespace=settings.namespace, documents=work)
    if "duplicate_of" not in entities.columns:
        entities = entities.withColumn("duplicate_of", F.lit(None).cast("string"))
    entities = materialize(entities, "entities")
    placed = entities.withColumns({"namespace": F.lit(settings.namespace), "name": F.coalesce("duplicate_of", "name")}).withColumn("normalized_name", normalize_name("name"))
    relations = extraction.resolve_indices(extraction.relation_rows(decoded), placed)
    bad = decoded.filter("problem IS NOT NULL").select("doc_id", F.col("problem").alias("__problem"))
    counted = entities.groupBy("doc_id").agg(F.count("*").alias("entities_found"))
    linked = relations.groupBy("doc_id").agg(F.count("*").alias("n_relations"))
    results = work.select("doc_id", "namespace", "ord", "skipped", "problem").join(raw.select("doc_id", "success", "error", "extraction_time"), "doc_id", "left").join(bad, "doc_id", "left").join(counted, "doc_id", "left").join(linked, "doc_id", "left")
    good = F.col("skipped") | F.col("success") & F.col("__problem").isNull() & F.col("problem").isNull()
    results = results.withColumns({"success": F.coalesce(good, F.lit(False)), "error": F.coalesce("problem", "error", "__problem"), "relationships_created": F.coalesce("entities_found", F.lit(0)) + F.coalesce("n_relations", F.lit(0))})
    results = materialize(results.drop("problem", "__problem", "n_relations"), "results")
    stopped = runs.abort_points(results, "ord", ["namespace"], settings.max_failures).first() if settings.max_failures else None  # at most one row
    reached = results
    if stopped:
        file, doc = stopped.aborted_at.file, stopped.aborted_at.doc_id
        reached = results.filter((F.col("ord.file") < file) | (F.col("ord.file") == file) & (F.col("ord.doc_id") <= F.lit(doc)))
    stats = materialize(runs.statistics(reached).withColumn("duration_seconds", F.lit(round(time.time() - began, 3))), "stats")
    if not settings.dry_run:
        kept = reached.filter("success AND NOT skipped").select("doc_id")
        store.upsert_documents(todo.join(kept, "doc_id", "left_semi").select("namespace", "doc_id", F.col("source_file").alias("source_path"), "content_hash", "title"))
        placed = placed.join(kept, "doc_id", "left_semi")
        store.upsert_entities(placed, ["doc_id", "idx"])
        discard(store.upsert_mentions(placed.filter("normalized_name <> ''").drop("properties"), ["doc_id", "idx"]))
        edges = relations.join(kept, "doc_id", "left_semi").select(F.lit(settings.namespace).alias("namespace"), "src_type", normalize_name("src_name").alias("src_norm"), F.col("relation_type").alias("rel_type"), "dst_type", normalize_name("dst_name").alias("dst_norm"), "confidence", "properties", "doc_id", "rel_pos")
        discard(store.upsert_relations(edges, ["doc_id", "rel_pos"]))
        if not stopped:
            hooks.run_after(store, namespace=settings.namespace)
    for df in (work, raw, entities, results):
        discard(df)
    if stopped:
        raise PipelineError(f"stopped after {settings.max_failures} failures in a row", stats.first().asDict())
    return stats


def dedupe(store: GraphStore, namespace: str, threshold: float = 0.75) -> int:
    """After-batch deduplication: similar names of a type merge into the longer one; the number of entities gone."""
    from weftgraph.operators import resolve

    rows = store.table("entities", [namespace]).select("namespace", "entity_type", F.col("normalized_name").alias("name")).withColumn("ord", F.col("name"))
    canonical = materialize(resolve.canonical_map(resolve.similar_pairs(rows, ["namespace", "entity_type"], threshold), ["namespace", "entity_type"]), "canonical")
    n = canonical.count()
    if n:
        store.merge_entities(canonical)
    discard(canonical)
    return n
