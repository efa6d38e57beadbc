"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.references import orphan_counts, orphans
from weftgraph.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    relations = table(spark, d, "extracted_relations")
    sides = F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("from_index").alias("index")), F.struct(F.lit("to").alias("side"), F.col("to_index").alias("index"))))
    refs = relations.select("doc_id", "rel_pos", "extracted_at", sides.alias("end")).select("doc_id", "rel_pos", "extracted_at", "end.side", "end.index")
    targets = table(spark, d, "extracted_entities").select("doc_id", "idx", "extracted_at")
    return orphans(refs, ["doc_id", "index"], targets, ["doc_id", "idx"], "simple", "extracted_at", "extracted_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Relation ends that lead to no entity row, or to one that arrived later."""
    return _orphans(spark, d).select("doc_id", "rel_pos", "side", "state").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and week; repeated rows count once."""
    return orphan_counts(_orphans(spark, d).distinct(), "extracted_relations", "extracted_at", ["side", "state"])


_FOUND = """
WITH target AS (SELECT doc_id, idx, min(extracted_at) AS since FROM extracted_entities GROUP BY ALL),
ref AS (SELECT doc_id, rel_pos, extracted_at, 'from' AS side, from_index AS i FROM extracted_relations
        UNION ALL SELECT doc_id, rel_pos, extracted_at, 'to', to_index FROM extracted_relations),
orphan AS (SELECT DISTINCT r.doc_id, rel_pos, extracted_at, side, i, CASE WHEN t.doc_id IS NULL THEN 'missing' ELSE 'late' END AS state
           FROM ref r LEFT JOIN target t ON t.doc_id = r.doc_id AND t.idx = r.i
           WHERE r.doc_id IS NOT NULL AND i IS NOT NULL AND (t.doc_id IS NULL OR since > extracted_at))
"""

QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
ORACLE = {
    "p6_found": _FOUND + "SELECT DISTINCT doc_id, rel_pos, side, state FROM orphan",
    "p6_counts": _FOUND + "SELECT 'extracted_relations' AS table_name, CAST(date_trunc('week', extracted_at) AS DATE) AS week, side, state, count(*) AS n FROM orphan GROUP BY ALL",
}
