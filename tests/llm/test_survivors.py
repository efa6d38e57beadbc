import datetime as dt

from pyspark.sql import functions as F

from weftgraph.llm.survivors import merged_records, survivors

A, B = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
SCHEMA = "doc_id string, idx int, tag string, confidence double, at timestamp, name string, site string, value string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return survivors(df, F.upper(F.trim("tag")), {"name": F.col("name"), "site": F.col("site")}, F.col("confidence"), F.col("at"), ["doc_id", "idx"])


def test_rules(spark):
    rows = [
        ("d1", 0, "t1", 0.9, A, "n/a", None, "v"),
        ("d2", 0, " T1", 0.8, A, "good", " - ", "v"),
        ("d3", 0, "T1", 7.0, B, "bad", "roof", "v"),
        ("d4", 0, "T1", 0.8, B, "later", "??", "v"),
        ("d4", 0, "T1", 0.8, B, "later", "??", "v"),
        ("d9", 1, "T2", None, A, "x", None, "v"), ("d8", 5, "T2", float("nan"), A, "y", None, "v"),
        ("d5", 1, "T3", 0.5, A, "alone", "a", "v"), ("d5", 1, "T3", 0.5, A, "alone", "a", "v"),
        ("d6", 1, None, 0.5, A, "no tag", "a", "v"), ("d7", 1, "  ", 0.5, A, "no tag", "a", "v"),
        (None, 1, "T4", 0.5, A, "p", None, "v"), ("z", None, "T4", 0.5, A, "q", None, "v"),
    ]
    found = run(spark, rows)
    got = {(r.group_key, r.field): (r.doc_id, r.idx, r.value) for r in found.collect()}
    assert got == {("T1", "name"): ("d4", 0, "later"), ("T1", "site"): ("d3", 0, "roof"), ("T2", "name"): ("d8", 5, "y"), ("T4", "name"): ("z", None, "q")}
    merged = {r.group_key: (r.name, r.site) for r in merged_records(found, ["name", "site"]).collect()}
    assert merged["T1"] == ("later", "roof") and merged["T2"] == ("y", None)


def test_empty(spark):
    assert run(spark, []).collect() == []
