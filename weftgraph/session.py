"""Session helpers: shared checkpoint folder, written intermediate tables, run settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to a Python worker; bounds worker memory for very long texts.
ARROW_BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the library's plans rely on (idempotent): maps merge with the last value, Arrow batches stay below ARROW_BATCH_BYTES."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset, a session whose executors are on this machine gets a local one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = known or "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        if not known:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame made by :func:`materialize`."""
    path = getattr(df, "_weft_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed, so that it is there whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.rename(aside, target)


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    source = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
