import random

from pyspark.sql import functions as F

from weftgraph.llm.canonical import listed_words, map_rows, map_values
from weftgraph.llm.components import hash_to_min
from weftgraph.llm.setjoin import similarity_join, word_grams


def test_join_against_brute_force(spark):
    rng = random.Random(7)
    sets = {f"k{i}": sorted({f"t{min(int(rng.expovariate(0.15)), 30)}" for _ in range(rng.randint(0, 9))}) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()), "k string, tokens array<string>")
    for t in (0.3, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert {(r.left_key, r.right_key) for r in similarity_join(df, df, "k", "tokens", t, same=True).collect()} == want
        two = {(r.left_key, r.right_key) for r in similarity_join(df, df, "k", "tokens", t).collect()}
        assert two == want | {(b, a) for a, b in want} | {(k, k) for k in sets if sets[k]}


def test_numbered_grams(spark):
    row = spark.createDataFrame([("aaa b",)], "s string").select(word_grams(F.col("s"), 2).alias("g")).first()
    assert sorted(row.g) == ["^a#1", "^b#1", "a$#1", "aa#1", "aa#2", "b$#1"]


def test_canonical(spark):
    defs = spark.createDataFrame(
        [("data_store", "Data Store", "Keeps. Also called: database, db."), ("person", None, "Human. Also called: staff member."), ("empty", "Empty", None), (None, "x", "y")],
        "entity_type_id string, name string, description string",
    )
    rows = [(1, "person"), (2, " person "), (3, "Perosn"), (4, "DataStore"), (5, "store, data"), (6, "lunch menu"), (7, None), (8, "  "), (9, "???"), (10, "DB"), (11, "Staff-Member"), (12, "staff members"), (3, "Perosn")]
    df = spark.createDataFrame(rows, "id int, value string")
    got = sorted((r.id, r.mapped_id) for r in map_rows(df, "value", defs, listed_words(F.col("description"), r"(?i)also called:\s*(.*)$")).collect())
    assert got == [(2, "person"), (3, "person"), (3, "person"), (4, "data_store"), (5, "data_store"), (6, "unmatched"), (9, "unmatched"), (10, "data_store"), (11, "person"), (12, "person")]
    assert map_rows(df.limit(0), "value", defs).collect() == []
    assert {r.mapped_id for r in map_rows(df, "value", defs.limit(0)).collect()} == {"unmatched"}
    assert map_values(df, "value", defs.limit(0).select("entity_type_id", F.col("name").alias("phrase"))).count() == 11


def test_components_against_union_find(spark):
    rng = random.Random(11)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame([*pairs, (None, 3), (7, None), (9, 9), (301, 300)], "a int, b int")
    got = {r.vertex: r.group_min for r in hash_to_min(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert hash_to_min(df.limit(0)).collect() == []
