"""Incremental ingest: a file stream of pages, each micro-batch through the batch plan.

The checkpoint remembers files; contents already in the graph are skipped by the plan's anti-join, as in batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.extractors import Extractor
from weftgraph.operators.pipeline import Settings, ingest
from weftgraph.operators.store import GraphStore

PAGE = "doc_id string, title string, text string, source_file string"


def stream_pages(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Parquet pages as they arrive."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest_stream(store: GraphStore, pages: DataFrame, extractor: Extractor, settings: Settings, checkpoint: str, each: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Ingest what has arrived and stop; run again to take up later files. ``each`` sees every batch's statistics."""
    def run(batch: DataFrame, number: int) -> None:
        stats = ingest(store, batch, extractor, settings)
        if each:
            each(number, stats)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
