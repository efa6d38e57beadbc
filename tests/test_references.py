import datetime as dt

import pytest

from weftgraph.operators.references import orphan_counts, orphans

T0, T1 = dt.datetime(2025, 3, 3), dt.datetime(2025, 3, 12)


@pytest.fixture()
def tables(spark):
    refs = [("r1", "a", 1, T0), ("r2", "a", 2, T0), ("r3", "b", 1, T0), ("r4", None, 1, T0), ("r5", "a", None, T0), ("r6", None, None, T0), ("r7", None, 9, T0), ("r8", "a", 1, None), ("r2", "a", 2, T0)]
    targets = [("a", 1, T0, "x"), ("a", 1, T1, "x"), ("b", 1, T1, "y"), (None, 9, T0, "z"), ("c", 3, None, "z")]
    return (spark.createDataFrame(refs, "state string, k string, i int, at timestamp").withColumnRenamed("state", "id"), spark.createDataFrame(targets, "k string, i int, at timestamp, id string"))


def states(df):
    return sorted((r.id, r.state) for r in df.collect())


def test_simple(tables):
    refs, targets = tables
    assert states(orphans(refs, ["k", "i"], targets, ["k", "i"], "simple", "at", "at")) == [("r2", "missing"), ("r2", "missing"), ("r3", "late")]


def test_partial_and_full(tables):
    refs, targets = tables
    assert states(orphans(refs, ["k", "i"], targets, ["k", "i"], "partial")) == [("r2", "missing"), ("r2", "missing")]
    full = states(orphans(refs, ["k", "i"], targets, ["k", "i"], "full"))
    assert [s for s in full if s[1] == "partial key"] == [("r4", "partial key"), ("r5", "partial key"), ("r7", "partial key")]


def test_empty_and_counts(tables):
    refs, targets = tables
    none = orphans(refs, ["k", "i"], targets.limit(0), ["k", "i"])
    assert len(none.collect()) == 5
    assert orphans(refs.limit(0), ["k", "i"], targets, ["k", "i"]).collect() == []
    rows = orphan_counts(none, "refs", "at", ["state"]).collect()
    assert sum(r.n for r in rows) == 5 and any(r.week is None for r in rows)


def test_bad_arguments(tables):
    refs, targets = tables
    with pytest.raises(ValueError):
        orphans(refs, ["k"], targets, ["k", "i"])
    with pytest.raises(ValueError):
        orphans(refs, ["k"], targets, ["k"], "loose")


def test_clashing_names(tables):
    refs, targets = tables
    out = orphans(refs.withColumnRenamed("id", "state"), ["k", "i"], targets, ["k", "i"])
    assert out.columns == ["k", "i", "at", "state"] and {r.state for r in out.collect()} == {"missing"}


def test_a_popular_target_is_split(spark):
    """The references to one key, a third of all, are split over tasks by AQE: the targets are written before the join."""
    from pyspark.sql import functions as F

    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        refs = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(6)
        targets = spark.range(0, 60_000, 2).select(F.col("id").alias("key")).union(spark.range(7, 8).toDF("key")).repartition(6)
        found = orphans(refs, ["k"], targets, ["key"])
        n = found.groupBy("state").count().collect()
        df = found.select("k", "pad")
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in n] == [("missing", 20_000 - 1)]
    assert "skew=true" in plan
