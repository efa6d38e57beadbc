"""Exact nearest neighbours within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.similarity import l2_score


def nearest(queries: DataFrame, base: DataFrame, block: list[str], limit: int = 5, threshold: float | None = None, score=l2_score, show: list[str] = ()) -> DataFrame:
    """Top ``limit`` base vectors of each query's block: (query_id, vec_id, score, rank, and the columns ``show``); the threshold is applied after the top-k.

    Both sides have the block columns, ``vec_id`` and ``embedding``; a vector is not its own neighbour. Ties go to the smaller vec_id. The join is an equi-join on
    the block; the window keeps only ``limit`` rows a query before its shuffle. Null embeddings have no neighbours.
    """
    q = queries.filter("embedding IS NOT NULL").select(*block, F.col("vec_id").alias("query_id"), F.col("embedding").alias("__q"))
    pairs = q.join(base.filter("embedding IS NOT NULL").select(*block, "vec_id", "embedding", *(c for c in show if c not in block)), block).filter("query_id <> vec_id")
    scored = pairs.select("query_id", "vec_id", score(F.col("__q"), F.col("embedding")).alias("score"), *show)
    rank = F.row_number().over(Window.partitionBy("query_id", *(c for c in block if c in show)).orderBy(F.col("score").desc(), "vec_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return top if threshold is None else top.filter(F.col("score") >= threshold)


def counts(vectors: DataFrame, by: list[str]) -> DataFrame:
    return vectors.groupBy(*by).agg(F.count("*").alias("n_vectors"))


def vector_id(namespace: Column, entity_type: Column, name: Column) -> Column:
    return F.concat_ws(":", namespace, entity_type, name)
