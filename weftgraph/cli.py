"""Command line: python -m weftgraph.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import config
from weftgraph.errors import ConfigurationError
from weftgraph.operators import extraction, hooks, lookup
from weftgraph.operators.extractors import Extractor, create_extractor
from weftgraph.operators.pipeline import Settings, ingest
from weftgraph.operators.render import render
from weftgraph.operators.store import GraphStore
from weftgraph.sources import html, ontology

VERSION = "0.2"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--root")
    p.add_argument("--namespace")
    p.add_argument("--config")
    p.add_argument("--log-level", dest="log_level")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--max-results", type=int, default=10)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list-types", "list-docs", "status", "init", "clear", "reset", "version"):
        sub.add_parser(name)
    sub.add_parser("list-entities").add_argument("--type")
    sub.add_parser("show-doc").add_argument("doc_id")
    for name in ("find-related", "related-docs", "render"):
        q = sub.add_parser(name)
        q.add_argument("type")
        q.add_argument("name")
        if name == "render":
            q.add_argument("--depth", type=int, default=2)
            q.add_argument("--max-nodes", type=int, default=100)
    sub.add_parser("query").add_argument("sql")
    sub.add_parser("export-entities").add_argument("--output-dir")
    q = sub.add_parser("parse")
    q.add_argument("folder")
    q.add_argument("--show-content", action="store_true")
    q.add_argument("--show-links", action="store_true")
    q = sub.add_parser("ingest")
    q.add_argument("folder")
    q.add_argument("--output-dir", required=True)
    q = sub.add_parser("entities")
    q.add_argument("action", choices=["list", "show", "validate", "template"])
    q.add_argument("folder")
    q.add_argument("type", nargs="?")
    q.add_argument("--output")
    sub.add_parser("lint").add_argument("folder")
    for name in ("extract", "pipeline"):
        q = sub.add_parser(name)
        q.add_argument("folder" if name == "pipeline" else "file")
        q.add_argument("--extractor", default="gazetteer", choices=["gazetteer", "replay"])
        q.add_argument("--phrases", help="parquet of (entity_type, name), for gazetteer")
        q.add_argument("--responses", help="parquet of (content_hash, raw_response), for replay")
        q.add_argument("--types", "-t", action="append", default=[])
        q.add_argument("--min-confidence", type=float)
        q.add_argument("--entities-dir", help="definitions and prompt_template.md, to make prompts of")
    q.add_argument("--dry-run", action="store_true")
    q.add_argument("--reprocess", action="store_true")
    q.add_argument("--max-batch-docs", type=int)
    q.add_argument("--max-failures", type=int)
    q.add_argument("--hooks", action="store_true", help="normalise, expand and match names before they are stored")
    q.add_argument("--dictionary", help="text file of KEY : value lines")
    q.add_argument("--interactive", metavar="EDITS", help="parquet of review answers (doc_id, seq, action, n, m, new_name)")
    sub.choices["extract"].add_argument("--format", choices=["text", "json"], default="text")
    return p


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _extractor(a, spark: SparkSession) -> Extractor:
    given = {"gazetteer": a.phrases, "replay": a.responses}[a.extractor]
    if not given:
        raise ConfigurationError(f"{a.extractor} needs {'--phrases' if a.extractor == 'gazetteer' else '--responses'}")
    return create_extractor(a.extractor, spark.read.parquet(given))


def _prompts(a, spark: SparkSession) -> dict:
    if not a.entities_dir:
        return {}
    definitions = ontology.by_type(ontology.read_definitions(spark, a.entities_dir), a.types)
    return {"template": ontology.read_template(a.entities_dir), "definitions": ontology.prompt_text(definitions)}


def _extract(a, c: config.Config, spark: SparkSession) -> dict | str:
    """The entities of one file, as text by type or as JSON."""
    page = html.read_files(spark, [a.file])
    asked = page.select("doc_id", "text", "content_hash")
    made = _prompts(a, spark)
    if made:
        asked = asked.withColumn("prompt", extraction.prompt(made["template"], made["definitions"], F.col("text")))
    raw = _extractor(a, spark).extract(asked)
    entities = extraction.of_types(extraction.min_confidence(extraction.entity_rows(extraction.decode(raw)), c.run.min_confidence if a.min_confidence is None else a.min_confidence), a.types)
    if a.format == "json":
        return json.loads(extraction.result_json(entities, raw, page.select("doc_id", F.lit(a.file).alias("file"))).first().body)
    return "\n\n".join(r.body for r in extraction.result_text(entities).orderBy("entity_type").collect())  # one document


def _entities(a, spark: SparkSession) -> dict | str:
    """Commands over a folder of definitions, a hand-written table of a few rows."""
    definitions = ontology.read_definitions(spark, a.folder)
    if a.action == "list":
        return {"definitions": _rows(ontology.counts(definitions).join(definitions.select("entity_type_id", "name"), "entity_type_id").orderBy("entity_type_id"))}
    if a.action == "validate":
        return {"warnings": _rows(ontology.lint(definitions))}
    if a.action == "show":
        found = _rows(ontology.find(definitions, a.type or ""))
        return found[0] if found else {"error": f"no type {a.type}", "known": [r["entity_type_id"] for r in _rows(ontology.type_ids(definitions))]}
    text = ontology.merged_template(ontology.read_template(a.folder), definitions)
    if not a.output:
        return text
    with open(a.output, "w", encoding="utf-8") as out:
        out.write(text)
    return {"written": a.output}


def _pipeline(a, c: config.Config, store: GraphStore, spark: SparkSession) -> dict:
    run = c.run
    settings = Settings(
        c.namespace, a.types, run.min_confidence if a.min_confidence is None else a.min_confidence, run.skip_processed and not a.reprocess,
        a.max_batch_docs or run.max_batch_docs, a.max_failures or run.max_failures, a.dry_run, **_prompts(a, spark),
    )
    chain = hooks.Hooks()
    if a.hooks:
        chain = hooks.default_hooks(ontology.read_dictionary(spark, a.dictionary) if a.dictionary else None, c.resolution.fuzzy_threshold)
    if a.interactive:
        chain.before_store(hooks.review_hook(spark.read.parquet(a.interactive)))
    return _rows(ingest(store, html.read_pages(spark, a.folder), _extractor(a, spark), settings, chain))[0]


def _parse(a, spark: SparkSession, n: int) -> dict:
    pages = html.read_pages(spark, a.folder)
    out = _rows(pages.agg(F.count("*").alias("documents"), F.sum(F.size("links")).alias("links"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("problem").isNotNull()).alias("unreadable")))[0]
    if a.show_content or a.show_links:  # as much as a screen shows: n documents, 50 lines, 10 links
        shown = {"doc_id": F.col("doc_id"), "title": F.col("title")}
        if a.show_content:
            shown["content"] = F.array_join(F.slice(F.split("text", "\n"), 1, 50), "\n")
        if a.show_links:
            shown["first_links"] = F.slice("links", 1, 10)
        out["shown"] = _rows(pages.select(*(v.alias(k) for k, v in shown.items())).orderBy("doc_id").limit(n))
    return out


def run(args: list[str], spark: SparkSession) -> dict | str:
    """The command's result; dicts are printed as JSON. Lists of documents, entities and mentions are cut at --max-results; types, definitions and statistics are whole, as there are few."""
    a = _parser().parse_args(args)
    c = config.load({"root": a.root, "namespace": a.namespace, "log_level": "DEBUG" if a.verbose else a.log_level}, a.config)
    logging.getLogger("weftgraph").setLevel(c.log_level)
    store, ns, n = GraphStore(spark, c.root), c.namespace, a.max_results
    if a.command == "version":
        return {"version": VERSION}
    if a.command == "init":
        store.create_schema()
        store.verify_schema()
        return {"tables": "ready"}
    if a.command in ("clear", "reset"):
        deleted = store.clear_namespace(ns)
        if a.command == "reset":
            store.create_schema()
        return {"namespace": ns, "deleted": deleted}
    if a.command == "status":
        nodes, edges = store.statistics(ns)
        return {"nodes": _rows(nodes), "edges": _rows(edges), "vectors": _rows(store.vector_stats(ns)), "gaps": _rows(store.schema_gaps())}
    if a.command == "list-types":
        return {"namespace": ns, "entity_types": [x["entity_type"] for x in _rows(store.list_entity_types(ns))]}
    if a.command == "list-entities":
        top = store.list_entities(ns, a.type, n).select("entity_type", "normalized_name", "name")
        best = store.table("mentions", [ns]).groupBy("entity_type", "normalized_name").agg(F.max("confidence").alias("c"))
        listed = top.join(best, ["entity_type", "normalized_name"], "left").select("name", F.coalesce("c", F.lit(1.0)).alias("confidence")).orderBy("name")
        return {"namespace": ns, "entity_type": a.type, "max_results": n, "entities": _rows(listed)}
    if a.command == "list-docs":
        return {"namespace": ns, "max_results": n, "documents": _rows(store.list_documents(ns, n).select("doc_id", "source_path"))}
    if a.command == "show-doc":
        found = store.get_document(ns, a.doc_id)
        if not found:
            return {"error": f"no document {a.doc_id}"}
        mentioned = store.get_document_entities(ns, a.doc_id).select("entity_type", "name", "mention_confidence").limit(n)
        return {k: found[k] for k in ("doc_id", "namespace", "source_path", "content_hash")} | {"entities_mentioned": _rows(mentioned)}
    if a.command == "find-related":
        return {"namespace": ns, "source_entity": a.name, "source_type": a.type, "max_results": n, "related_entities": _rows(store.find_related_entities(ns, a.type, a.name, n))}
    if a.command == "related-docs":
        return {"namespace": ns, "documents": _rows(store.find_related_documents(ns, a.type, a.name, n).select("doc_id", "source_path", "mention_confidence"))}
    if a.command == "query":
        return {"rows": _rows(lookup.query(spark, {t: store.table(t) for t in ("docs", "entities", "mentions", "relations", "embeddings")}, a.sql).limit(n))}
    if a.command == "render":
        return render(store.table("relations", [ns]), ns, a.type, a.name, a.depth, a.max_nodes)
    if a.command == "export-entities":
        exported = ontology.export_definitions(store.table("entities", [ns]))
        if a.output_dir:
            exported.write.mode("overwrite").partitionBy("entity_type").text(a.output_dir)
            return {"written": a.output_dir}
        return {"definitions": _rows(exported.orderBy("entity_type").limit(n))}
    if a.command == "ingest":
        return {"files": html.write_markdown(html.read_pages(spark, a.folder), a.output_dir).count(), "output": a.output_dir}
    if a.command == "lint":
        a.action, a.type, a.output = "validate", None, None
    special = {"parse": lambda: _parse(a, spark, n), "entities": lambda: _entities(a, spark), "lint": lambda: _entities(a, spark), "extract": lambda: _extract(a, c, spark), "pipeline": lambda: _pipeline(a, c, store, spark)}
    return special[a.command]()


def main() -> None:
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    out = run(sys.argv[1:], spark)
    print(out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
