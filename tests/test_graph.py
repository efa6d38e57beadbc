import pytest

from weftgraph import errors
from weftgraph.operators import lookup, resolve, upsert
from weftgraph.operators.store import GraphStore


@pytest.fixture()
def store(spark, tmp_path):
    s = GraphStore(spark, "file://" + str(tmp_path))
    s.create_schema()
    return s


def fill(spark, store):
    docs = spark.createDataFrame([("ns1", f"doc_00{k}", f"p{k}", f"h{k}", "t") for k in (1, 2, 3)], "namespace string, doc_id string, source_path string, content_hash string, title string")
    store.upsert_documents(docs, 1)
    rows = spark.createDataFrame([("ns1", "product", "Knowledge Discovery (KD)", 0), ("ns1", "product", "knowledge discovery", 1), ("ns1", "person", "Ann", 2), ("ns2", "product", "Knowledge Discovery", 3), ("ns1", "person", "日本", 4)], "namespace string, entity_type string, name string, o int")
    assert store.upsert_entities(rows, ["o"], 1) == 3
    edges = spark.createDataFrame([("ns1", "doc_001", "product", "knowledge discovery", 0.5, 0), ("ns1", "doc_001", "product", "knowledge discovery", 0.7, 1), ("ns1", "doc_002", "product", "knowledge discovery", 0.9, 2), ("ns1", "doc_009", "product", "knowledge discovery", 0.9, 3)], "namespace string, doc_id string, entity_type string, normalized_name string, confidence double, o int")
    bad = store.upsert_mentions(edges, ["o"], 1)
    assert [r.doc_id for r in bad.collect()] == ["doc_009"]
    rel = spark.createDataFrame([("ns1", "person", "ann", "owns", "product", "knowledge discovery", 1.0, 0), ("ns1", "person", "bob", "owns", "product", "knowledge discovery", 1.0, 0)], "namespace string, src_type string, src_norm string, rel_type string, dst_type string, dst_norm string, confidence double, o int")
    store.upsert_relations(rel, ["o"], 1)


def test_upserts_and_reads(spark, store):
    fill(spark, store)
    store.verify_schema()
    e, m, d, r = (store.table(t) for t in ("entities", "mentions", "docs", "relations"))
    assert lookup.get_entity(e, "ns1", "product", "Knowledge-Discovery").first().name == "Knowledge Discovery (KD)"
    assert [x.doc_id for x in lookup.related_documents(m, d, "ns1", "product", "Knowledge Discovery").collect()] == ["doc_001", "doc_002"]
    assert lookup.document_entities(m, e, "ns1", "doc_001").first().mention_confidence == 0.7
    assert [tuple(x) for x in lookup.related_entities(r, e, "ns1", "product", "knowledge discovery").collect()] == [("Ann", "person", "OWNS")]
    assert {(x.normalized_name, x.hops) for x in lookup.k_hop(r, "ns1", "person", "Ann").collect()} == {("ann", 0), ("knowledge discovery", 1)}
    assert {x.label: x.n for x in lookup.node_stats(d, e, "ns1").collect()} == {"Doc": 3, "Entity": 2}
    assert {x.rel_type: x.n for x in lookup.edge_stats(m, r, "ns1").collect()} == {"MENTIONS": 2, "OWNS": 1}
    assert store.document_exists("ns1", "doc_001") and not store.document_exists("ns2", "doc_001")
    assert store.hash_exists("ns1", "h2") and not store.hash_exists("ns1", "zz")


def test_single_rows(spark, store):
    fill(spark, store)
    with pytest.raises(errors.DuplicateEntityError):
        store.create_entity("ns1", "person", "ANN")
    store.create_entity("ns1", "person", "Bea", status="new", team="x")
    store.update_entity("ns1", "person", "Bea", status="old", team=None)
    assert lookup.get_entity(store.table("entities"), "ns1", "person", "bea").first().properties == {"status": "old"}
    with pytest.raises(errors.EntityNotFoundError):
        store.update_entity("ns1", "person", "nobody", a="b")
    assert store.delete_entity("ns1", "product", "Knowledge Discovery") and not store.delete_entity("ns1", "product", "Knowledge Discovery")
    assert store.table("mentions").count() == 0 and store.table("relations").count() == 0
    assert store.clear_namespace("ns1") == 5 and store.clear_namespace("ns1") == 0
    assert store.table("entities").count() == 1
    with pytest.raises(errors.InvalidNamespaceError):
        store.clear_namespace("a-b")


def test_merge(spark, store):
    fill(spark, store)
    store.create_entity("ns1", "product", "Knowledge Discovry")
    canonical = spark.createDataFrame([("ns1", "product", "knowledge discovery", "knowledge discovry")], "namespace string, entity_type string, duplicate string, canonical string")
    store.merge_entities(canonical)
    assert {x.normalized_name for x in store.table("mentions").collect()} == {"knowledge discovry"}
    assert store.table("relations").first().dst_norm == "knowledge discovry"


def test_canonical_chain(spark):
    pairs = spark.createDataFrame([("n", "a1", "a22", 0.9, "1", "2"), ("n", "a22", "a333", 0.8, "2", "3")], "ns string, name_a string, name_b string, score double, ord_a string, ord_b string")
    assert {tuple(r) for r in resolve.canonical_map(pairs, ["ns"]).collect()} == {("n", "a1", "a333"), ("n", "a22", "a333")}


def test_merge_properties(spark):
    df = spark.sql("select map('a','1','b','2') as o, map('b', cast(null as string), 'c','3') as n union all select null, map('x','1')")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    from pyspark.sql import functions as F

    assert [r.m for r in df.select(upsert.merge_properties(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "c": "3"}, {"x": "1"}]


def test_single_calls_and_their_errors(spark, store):
    store.create_document("ns1", "d1", "p", "h", "t", lang="en")
    store.create_document("ns1", "d1", "p2", "h2", "t", size="3")
    doc = store.get_document("ns1", "d1")
    assert doc["source_path"] == "p2" and doc["properties"] == {"lang": "en", "size": "3"} and store.get_document("ns1", "no") is None
    for name in ("Ann", "Bob"):
        store.create_entity("ns1", "person", name)
    store.create_relationship("ns1", "person", "ann", "person", "bob", "knows", 0.5, since="2019", place="x")
    store.create_relationship("ns1", "person", "Ann", "person", "Bob", "KNOWS", 0.9, since="2021")
    edge = store.table("relations").first()
    assert (edge.confidence, edge.properties) == (0.9, {"since": "2021", "place": "x"}) and store.table("relations").count() == 1
    store.add_mention("ns1", "d1", "person", "Ann", 0.7, line="4")
    assert store.get_document_entities("ns1", "d1").first().name == "Ann" and store.find_related_documents("ns1", "person", "ann").first().doc_id == "d1"
    for call, error in ((lambda: store.add_mention("ns1", "d9", "person", "Ann"), errors.DocumentNotFoundError), (lambda: store.add_mention("ns1", "d1", "person", "Cy"), errors.EntityNotFoundError), (lambda: store.create_relationship("ns1", "person", "ann", "person", "cy", "knows"), errors.EntityNotFoundError)):
        with pytest.raises(error):
            call()


def test_only_touched_namespaces_are_written(spark, store):
    for ns in ("a1", "b2"):
        store.create_entity(ns, "person", "Ann")
    before = store._manifest("entities")["versions"]
    store.create_entity("b2", "person", "Bob")
    after = store._manifest("entities")["versions"]
    assert after["a1"] == before["a1"] and after["b2"] > before["b2"]
    plan = store.table("entities")._jdf.filter("namespace = 'a1'").queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan
    assert store.table("entities", ["a1"]).count() == 1 and store.table("entities").count() == 3


def test_merge_keeps_names_and_counts(spark, store):
    fill(spark, store)
    store.create_entity("ns1", "product", "Knowledge Discovry")
    canonical = spark.createDataFrame([("ns1", "product", "knowledge discovery", "knowledge discovry")], "namespace string, entity_type string, duplicate string, canonical string")
    assert store.merge_entities(canonical) == 3  # two mentions, one relation
    assert store.get_entity("ns1", "product", "knowledge discovry")["properties"] == {"aliases": '["Knowledge Discovery (KD)"]'}


def test_candidates(spark):
    schema = "block string, name string, other string, score double"
    fuzzy = spark.createDataFrame([("t", "a", f"x{k}", 0.8 + k / 100) for k in range(6)], schema)
    vector = spark.createDataFrame([("t", "a", "x0", 0.99), ("t", "b", "y", 0.5)], schema)
    rows = resolve.candidates(fuzzy, vector).orderBy("name", "rank").collect()
    assert [(r.name, r.other, r.method) for r in rows][:2] == [("a", "x0", "vector"), ("a", "x5", "fuzzy")] and len(rows) == 6
