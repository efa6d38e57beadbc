"""Problem 8: encoding of the whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm import bpe


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text"))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_DIR) -> DataFrame:
    """Ids of every row's text as ``(key, ids ARRAY<INT>)``; one row out for each row in.

    Null and empty texts give an empty array, never null. All text is plain: strings that look like special
    tokens are encoded as ordinary text. Equal rows give equal rows; other columns of ``df`` are not read; a null
    key is kept; an empty table gives an empty table. The plan is a scan and one Arrow stage, without a shuffle.
    """
    kind = df.schema[key].dataType
    data = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary, folder))

    def run(batches):
        encoder = bpe.worker_encoder(data.value)
        for batch in batches:
            ids, ends = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            keys, texts = batch.columns
            for k in range(batch.num_rows):
                encoder.extend(texts[k].as_py(), ids)
                ends[k + 1] = len(ids)
            values = pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), values)], [key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _plain(df, key, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_DIR) -> DataFrame:
    """``(key, text)``: the text of every row's ids; null or empty ids give an empty text, ids outside the vocabulary raise."""
    kind = df.schema[key].dataType
    data = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary, folder))

    def run(batches):
        tokens = {i: t for t, i in bpe.parse_ranks(data.value).items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, row or ())).decode("utf-8") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())])
    return df.select(df[key], df[ids]).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_DIR) -> DataFrame:
    """``(key, n_tokens INT)`` of every row's text; null and empty texts have 0."""
    kind = df.schema[key].dataType
    data = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary, folder))

    def run(batches):
        encoder = bpe.worker_encoder(data.value)
        for batch in batches:
            keys, texts = batch.columns
            sizes = np.fromiter((encoder.count(texts[k].as_py()) for k in range(batch.num_rows)), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes)], [key, "n_tokens"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.IntegerType())])
    return _plain(df, key, text).mapInArrow(run, schema)
