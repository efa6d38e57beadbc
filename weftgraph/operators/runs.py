"""Run statistics and failure policy over per-document results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import content_hash


def statistics(results: DataFrame) -> DataFrame:
    """One row from (success, skipped, entities_found, relationships_created, error): totals and success rate in percent (0 without documents)."""
    ok, skipped = F.coalesce("success", F.lit(False)), F.coalesce("skipped", F.lit(False))
    return results.agg(
        F.count("*").alias("total_documents"),
        F.count_if(ok & ~skipped).alias("processed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~ok & ~skipped).alias("failed"),
        F.coalesce(F.sum(F.when(ok & ~skipped, F.col("entities_found"))), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum(F.when(ok & ~skipped, F.col("relationships_created"))), F.lit(0)).alias("total_relationships"),
        F.coalesce(F.try_divide(F.count_if(ok & ~skipped) * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def error_counts(results: DataFrame) -> DataFrame:
    """(error, n): the errors of a run, each once; distributed, so a run with any number of failures is reported whole."""
    return results.filter("NOT coalesce(success, false)").groupBy(F.coalesce("error", F.lit("unknown")).alias("error")).agg(F.count("*").alias("n"))


def progress(results: DataFrame, order: str, by: list[str]) -> DataFrame:
    """``results`` with ``done``, how many of ``by`` were reached, and ``percent`` of all, in order."""
    all_ = results.groupBy(*by).agg(F.count("*").alias("__all"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return results.withColumn("done", nth).join(all_, by).withColumn("percent", F.round(F.col("done") * 100.0 / F.col("__all"), 2)).drop("__all")


def failure_runs(results: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Runs of consecutive failures within ``by``: (by, first, last, length). Skipped documents count as successes."""
    fine = F.when(F.col("success") | F.coalesce("skipped", F.lit(False)), 1).otherwise(0)
    island = F.sum(fine).over(Window.partitionBy(*by).orderBy(order))
    failed = results.withColumn("__island", island).filter("NOT (success OR coalesce(skipped, false)) OR success IS NULL AND NOT coalesce(skipped, false)")
    return failed.groupBy(*by, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__island")


def abort_points(results: DataFrame, order: str, by: list[str], max_failures: int) -> DataFrame:
    """Where a run of ``by`` stops: the position of the max_failures-th failure in a row, if there is one."""
    fine = F.when(F.col("success") | F.coalesce("skipped", F.lit(False)), 1).otherwise(0)
    marked = results.withColumn("__island", F.sum(fine).over(Window.partitionBy(*by).orderBy(order))).withColumn("__bad", 1 - fine)
    nth = F.sum("__bad").over(Window.partitionBy(*by, "__island").orderBy(order))
    hit = marked.withColumn("__nth", nth).filter((F.col("__nth") == max_failures) & (F.col("__bad") == 1))
    return hit.groupBy(*by).agg(F.min(order).alias("aborted_at"))


def take_batch(results: DataFrame, order: str, by: list[str], limit: int) -> DataFrame:
    """Documents reached before ``limit`` were processed; skipped ones are free."""
    done = F.when(F.coalesce("skipped", F.lit(False)), 0).otherwise(1)
    before = F.sum(done).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return results.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < limit).drop("__before")


def repeated_contents(documents: DataFrame, text: str) -> DataFrame:
    """(content_hash, n_docs, first_doc) of every text that several documents have."""
    return documents.filter(F.col(text).isNotNull()).groupBy(content_hash(text).alias("content_hash")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def skip_processed(batch: DataFrame, docs: DataFrame, order: str) -> DataFrame:
    """New contents only: not in ``docs`` of the namespace, and of equal contents in the batch the first in ``order``."""
    fresh = batch.join(docs.select("namespace", "content_hash").distinct(), ["namespace", "content_hash"], "left_anti")
    first = fresh.groupBy("namespace", "content_hash").agg(F.min(order).alias(order))
    return fresh.join(first, ["namespace", "content_hash", order], "left_semi")
