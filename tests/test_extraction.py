import json

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import PipelineError
from weftgraph.operators import extraction, runs
from weftgraph.operators import hooks as hooks_module
from weftgraph.operators.extractors import ClientExtractor, GazetteerExtractor, ReplayExtractor
from weftgraph.operators.pipeline import Settings, dedupe, ingest
from weftgraph.operators.store import GraphStore
from weftgraph.streaming.ingest import PAGE, ingest_stream, stream_pages

GOOD = '{"entities": [{"type": "product", "name": "A", "extra": {"k": 1}}, {"entity_type": "x", "name": ""}, {"type_id": "team", "name": "B", "confidence": 0.5}, {"type": "t", "name": "C", "confidence": 1.5}], "relations": [{"from_entity": 0, "to_entity": 2, "type": "owns"}, {"from_entity": 0, "to_entity": 9, "type": "owns"}, {"from_entity": "x", "to_entity": 2, "type": "owns"}]}'


def decoded(spark, *raws):
    return extraction.decode(spark.createDataFrame([(f"d{k}", r) for k, r in enumerate(raws)], "doc_id string, raw_response string"))


def test_decode(spark):
    raws = [GOOD, "Here:\n```json\n" + GOOD + "\n```\nbye", "", None, "{broken", "[1]", '{"relations": []}', '{"entities": {}}']
    rows = {r.doc_id: r.problem for r in decoded(spark, *raws).collect()}
    assert [rows[f"d{k}"] for k in range(8)] == [None, None, None, None, "invalid json", "not an object", "no entities", "entities not a list"]
    d = decoded(spark, GOOD)
    ents = {r.idx: r for r in extraction.entity_rows(d).collect()}
    assert sorted(ents) == [0, 2] and ents[0].confidence == 1.0 and ents[0].properties == {"extra": '{"k":1}'}
    rels = extraction.relation_rows(d).collect()
    assert [(r.from_index, r.to_index, r.relation_type) for r in rels] == [(0, 2, "OWNS")]
    kept = extraction.min_confidence(extraction.entity_rows(d), 0.8)
    assert extraction.resolve_indices(extraction.relation_rows(d), kept).count() == 0
    assert extraction.resolve_indices(extraction.relation_rows(d), extraction.entity_rows(d)).first().dst_name == "B"


def test_hooks_and_review(spark):
    hooks = hooks_module.Hooks()
    hooks.before_store(lambda df, namespace: df.withColumn("name", F.concat("name", F.lit(namespace))))

    @hooks.before_store
    def fails(df):
        raise RuntimeError

    ents = spark.createDataFrame([("d", 0, "t", "a"), ("d", 1, "t", "b"), ("d", 2, "u", "c"), ("d", 3, "t", "e")], "doc_id string, idx int, entity_type string, name string")
    assert {r.name for r in hooks.run_before(ents, namespace="1").collect()} == {"a1", "b1", "c1", "e1"}
    edits = spark.createDataFrame([("d", 1, "delete", 4, None, None), ("d", 2, "edit", 1, None, "A"), ("d", 3, "merge", 2, 1, None), ("d", 4, "merge", 3, 1, None), ("d", 5, "done", None, None, None), ("d", 6, "delete", 1, None, None)], "doc_id string, seq int, action string, n int, m int, new_name string")
    assert sorted((r.idx, r.name) for r in hooks_module.review(ents, edits).collect()) == [(0, "A"), (2, "c")]


def test_run_policy(spark):
    rows = [(k, k not in (2, 3, 6), k == 3) for k in range(8)]
    df = spark.createDataFrame([("r", *r, 1, 2, None) for r in rows], "run string, o int, success boolean, skipped boolean, entities_found int, relationships_created int, error string")
    assert sorted((r.first, r.length) for r in runs.failure_runs(df, "o", ["run"]).collect()) == [(2, 1), (6, 1)]
    assert runs.abort_points(df, "o", ["run"], 2).count() == 0
    assert [r.aborted_at for r in runs.abort_points(df.withColumn("skipped", F.lit(False)), "o", ["run"], 2).collect()] == [3]
    assert runs.take_batch(df, "o", ["run"], 4).count() == 5
    s = runs.statistics(df).first()
    assert (s.total_documents, s.processed, s.skipped, s.failed, s.success_rate) == (8, 5, 1, 2, 62.5)
    assert runs.statistics(df.limit(0)).first().success_rate == 0.0


def pages(spark, *rows):
    return spark.createDataFrame([*rows], PAGE)


def test_ingest_and_stream(spark, tmp_path):
    phrases = spark.createDataFrame([("product", "Router Box"), ("team", "Alpha")], "entity_type string, name string")
    store = GraphStore(spark, "file://" + str(tmp_path / "g"))
    batch = pages(spark, ("d1", "t", "The router box of Alpha", "a"), ("d2", "t", "The router box of Alpha", "b"), ("d3", "t", None, "c"))
    s = ingest(store, batch, GazetteerExtractor(phrases), Settings("ns")).first()
    assert (s.total_documents, s.processed, s.skipped, s.total_entities) == (3, 2, 1, 2)
    assert store.table("mentions").count() == 2 and store.table("docs").count() == 2
    assert ingest(store, batch, GazetteerExtractor(phrases), Settings("ns")).first().skipped == 3
    assert ingest(store, batch, GazetteerExtractor(phrases), Settings("ns", skip_processed=False, dry_run=True)).first().processed == 3
    assert dedupe(store, "ns") == 0
    folder = str(tmp_path / "in")
    pages(spark, ("d9", "t", "alpha again", "z")).write.parquet(folder)
    seen = []
    query = ingest_stream(store, stream_pages(spark, folder), GazetteerExtractor(phrases), Settings("ns"), str(tmp_path / "cp"), lambda n, stats: seen.append(stats.first().processed))
    query.awaitTermination()
    assert seen == [1] and store.document_exists("ns", "d9")


def test_extractors(spark):
    docs = spark.createDataFrame([("d", "x", "h"), ("e", "y", "none")], "doc_id string, text string, content_hash string")
    stored = spark.createDataFrame([("h", GOOD)], "content_hash string, raw_response string")
    got = {r.doc_id: r.success for r in ReplayExtractor(stored).extract(docs).collect()}
    assert got == {"d": True, "e": False}

    def client(text):
        if text == "y":
            raise TimeoutError("slow")
        return GOOD, 7

    rows = {r.doc_id: (r.success, r.tokens_used, r.error) for r in ClientExtractor(client, "m", wait=0.0).extract(docs).collect()}
    assert rows == {"d": (True, 7, None), "e": (False, 0, "TimeoutError: slow")}


def reply(*names):
    return json.dumps({"entities": [{"type": "thing", "name": n} for n in names], "relations": [{"from_entity": 0, "to_entity": 1, "type": "near", "since": "2020"}]}), 3


def test_prompts_reach_the_client_and_edges_keep_properties(spark, tmp_path):
    store = GraphStore(spark, "file://" + str(tmp_path / "g"))
    answer = reply("Quay", "Pier")
    client = ClientExtractor(lambda p: answer if p.startswith("Find thing in ") else ("not json", 0), "m", wait=0.0)
    settings = Settings("ns", template="Find {{ENTITY_TYPE_DEFINITIONS}} in {{TEXT}}", definitions="thing")
    s = ingest(store, pages(spark, ("d1", "t", "text", "a")), client, settings).first()
    assert (s.processed, s.total_entities, s.total_relationships) == (1, 2, 3) and s.duration_seconds >= 0
    assert store.table("relations").first().properties == {"since": "2020"}
    assert ingest(store, pages(spark, ("d2", "t", "other", "a")), client, Settings("ns")).first().failed == 1


def test_failures_in_a_row_stop_the_run(spark, tmp_path):
    store, after = GraphStore(spark, "file://" + str(tmp_path / "g")), []
    chain = hooks_module.Hooks(after=[lambda tables: after.append(1)])
    batch = pages(spark, *((f"d{k}", "t", f"text {k}" + (" bad" if k in (1, 3, 4) else ""), f"f{k}") for k in range(7)))

    answer = reply("Quay", "Pier")

    def client(text):
        if "bad" in text:
            raise ValueError("no answer")
        return answer

    with pytest.raises(PipelineError) as stop:
        ingest(store, batch, ClientExtractor(client, "m", wait=0.0), Settings("ns", max_failures=2), chain)
    assert (stop.value.statistics["processed"], stop.value.statistics["failed"]) == (2, 3)
    assert sorted(r.doc_id for r in store.table("docs").collect()) == ["d0", "d2"] and not after
    assert ingest(store, batch, ClientExtractor(client, "m", wait=0.0), Settings("ns", max_failures=3), chain).first().processed == 2 and after == [1]


def test_default_chain(spark, tmp_path):
    store = GraphStore(spark, "file://" + str(tmp_path / "g"))
    store.create_entity("ns", "thing", "harbour master office")
    lines = spark.createDataFrame([("HQ", "Head Quarters", 1)], "key string, value string, line_no int")
    ents = spark.createDataFrame([("d", k, "thing", n, 1.0, {}) for k, n in enumerate(["Harbour Master Ofice", "HQ", "Tide Gauge North", "tide gauge  north!", "Tide Gauge Nort"])], "doc_id string, idx int, entity_type string, name string, confidence double, properties map<string,string>")
    edits = spark.createDataFrame([("d", 1, "delete", 4, None, None)], "doc_id string, seq int, action string, n int, m int, new_name string")
    chain = hooks_module.default_hooks(lines, 0.85, 0.8, edits)
    rows = {r.idx: r for r in chain.run_before(ents, store=store, namespace="ns").collect()}
    assert sorted(rows) == [0, 1, 2, 4]
    assert rows[0].name == "harbour master ofice" and rows[0].duplicate_of == "harbour master office" and rows[0].properties["normalized_name"] == "harbour master ofice"
    assert rows[1].name == "head quarters" and rows[1].duplicate_of is None
    assert {rows[2].duplicate_of, rows[4].duplicate_of} == {None, "tide gauge nort"}
    assert store.vector_stats("ns").first().n_vectors == 2
    again = {r.idx: r for r in chain.run_before(ents, store=store, namespace="ns").collect()}
    assert again[2].duplicate_of == "tide gauge nort" and store.vector_stats("ns").first().n_vectors == 2
    answers = hooks_module.Answers({"go?": "yes", "which?": "b"})
    assert answers.confirm("go?", False) and answers.choose("which?", ["a", "b"]) == "b" and answers.choose("which?", ["a"]) == "a" and hooks_module.Answers().prompt("x", "d") == "d"


def test_results(spark):
    d = decoded(spark, GOOD)
    ents = extraction.entity_rows(d)
    assert extraction.filter_by_confidence(ents, extraction.relation_rows(d), 0.8)[0].count() == 1 and extraction.entities_of_type(ents, "Team").count() == 0
    assert extraction.unique_types(ents).first().types == ["product", "team"]
    raw = spark.createDataFrame([("d0", "m", 7, 0.5, True)], "doc_id string, model_name string, tokens_used int, extraction_time double, success boolean")
    files = spark.createDataFrame([("d0", 'x"y.html')], "doc_id string, file string")
    body = json.loads(extraction.result_json(ents, raw, files).first().body)
    assert body["file"] == 'x"y.html' and body["model"] == "m" and [e["name"] for e in body["entities"]] == ["A", "B"] and body["metadata"]["entity_count"] == 2
    assert {r.body for r in extraction.result_text(ents).collect()} == {"product (1):\n  - A", "team (1):\n  - B (confidence: 0.50)"}
    rows = spark.createDataFrame([("r", k, k > 1, None if k > 1 else "slow") for k in range(4)], "run string, o int, success boolean, error string")
    assert [(r.error, r.n) for r in runs.error_counts(rows).collect()] == [("slow", 2)]
    assert [r.percent for r in runs.progress(rows, "o", ["run"]).orderBy("o").collect()] == [25.0, 50.0, 75.0, 100.0]
