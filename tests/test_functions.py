import pytest
from pyspark.sql import functions as F

from weftgraph.functions import similarity as sim
from weftgraph.functions.text import is_known, normalize_name, normalize_text
from weftgraph.operators import lookup, resolve, vectors


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("raw,key", [("Knowledge Discovery (KD)", "knowledge discovery"), ("AI/ML-Platform", "ai ml platform"), ("  ", ""), ("日本", "")])
def test_normalize_name(spark, raw, key):
    assert one(spark, raw, normalize_name) == key == lookup.name_key(raw)


@pytest.mark.parametrize("raw,plain", [("hello@world!", "hello world"), ("a&b|c", "a b c"), ("", ""), (None, ""), ("Text-Mining (x)", "text-mining x")])
def test_normalize_text(spark, raw, plain):
    assert one(spark, raw, normalize_text) == plain


@pytest.mark.parametrize("raw,known", [("n/a", False), (" TBD ", False), ("--", False), (None, False), ("", False), ("Nadia", True), ("0", True)])
def test_is_known(spark, raw, known):
    assert one(spark, raw, is_known) is known


def test_jaro_winkler():
    assert sim.jaro_winkler_value(" ABC", "abc") == 1.0 and sim.jaro_winkler_value("", "a") == 0.0 and sim.jaro_winkler_value(None, "a") == 0.0
    assert round(sim.jaro_winkler_value("similar", "similr"), 4) == 0.9714
    assert round(sim.jaro_winkler_value("catherine", "katherine"), 4) == 0.9259
    assert round(sim.jaro_winkler_value("james jones", "james earl jones"), 4) == 0.9011


def test_bounds_lose_nothing(spark):
    names = ["kubernetes", "k8s", "similar", "similr", "catherine", "katherine", "james jones", "james earl jones", "a", "ab", "router", "ruoter", " pad", "pad"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("la", sim.letter_counts(F.col("a"))).withColumn("lb", sim.letter_counts(F.col("b")))
    for r in df.select("a", "b", sim.may_reach_jaro_winkler(F.col("a"), F.col("b"), F.col("la"), F.col("lb"), 0.8).alias("j"), sim.may_reach_sequence(F.col("a"), F.col("b"), F.col("la"), F.col("lb"), 0.7).alias("s")).collect():
        assert r.j or sim.jaro_winkler_value(r.a, r.b) < 0.8
        assert r.s or sim.sequence_value(r.a.strip(), r.b.strip()) < 0.7 or r.a != r.a.strip() or r.b != r.b.strip()


def test_dictionary_last_line_counts(spark):
    lines = spark.createDataFrame([("DL", "Deep Learning", 1), ("K8S", "Kubernetes", 2), ("dl", "Data Lake", 3), ("AI/ML", "Artificial Intelligence Machine Learning", 4), (None, "x", 5)], "key string, value string, line_no int")
    names = spark.createDataFrame([("k8s",), ("DL",), ("ai ml",), ("other",), (None,)], "n string")
    assert {r.n: r.expanded for r in resolve.expand_names(names, "n", lines).collect()} == {"k8s": "kubernetes", "DL": "data lake", "ai ml": "artificial intelligence machine learning", "other": "other", None: ""}


def test_nearest_and_leaders(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0]), (1, 5, None)]
    df = spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in vectors.nearest(df, df, ["label"], 1, 0.9, sim.cosine).collect()}
    assert got == {(1, 2), (2, 1)}
    lead = {r.ord: r.leader for r in resolve.leaders(df.filter("embedding is not null").withColumnRenamed("vec_id", "ord"), ["label"], 0.9).collect()}
    assert lead == {1: 1, 2: 1, 3: 3, 4: 4}
