"""Extractors: documents in, raw responses out. Offline ones are deterministic; a network client is injected."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import ConfigurationError, ParseError

RAW = "doc_id string, raw_response string, model_name string, tokens_used int, extraction_time double, success boolean, error string"


class Extractor(Protocol):
    def extract(self, documents: DataFrame) -> DataFrame:
        """(doc_id, text, content_hash[, prompt]) to rows of RAW."""


class ReplayExtractor:
    """Stored responses by content hash."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def extract(self, documents: DataFrame) -> DataFrame:
        found = documents.select("doc_id", "content_hash").join(self.responses.select("content_hash", "raw_response"), "content_hash", "left")
        ok = F.col("raw_response").isNotNull()
        return found.select("doc_id", "raw_response", F.lit("replay").alias("model_name"), F.lit(0).alias("tokens_used"), F.lit(0.0).alias("extraction_time"), ok.alias("success"), F.when(~ok, "no stored response").alias("error"))


class GazetteerExtractor:
    """Names of a phrase list (entity_type, name) found as whole words of a text."""

    def __init__(self, phrases: DataFrame):
        self.phrases = phrases

    def extract(self, documents: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        first = documents.select("doc_id", "text", F.explode(F.array_distinct(words)).alias("word"))
        listed = self.phrases.select("entity_type", "name", F.element_at(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), 1).alias("word"))
        hits = first.join(listed, "word").filter(F.instr(F.lower("text"), F.lower("name")) > 0).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("entity_type").alias("type"), "name"))).alias("entities"))
        rows = documents.select("doc_id").join(hits, "doc_id", "left")
        body = F.to_json(F.struct(F.coalesce("entities", F.from_json(F.lit("[]"), "array<struct<type:string,name:string>>")).alias("entities"), F.array().cast("array<string>").alias("relations")))
        return rows.select("doc_id", body.alias("raw_response"), F.lit("gazetteer").alias("model_name"), F.lit(0).alias("tokens_used"), F.lit(0.0).alias("extraction_time"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


#: What a passing failure says of itself, in class names and messages (fixed values, lower case).
RETRYABLE = ("timeout", "timed out", "connection", "rate limit", "ratelimit", "throttl", "too many requests", "service unavailable", "serviceunavailable", "429", "500", "502", "503", "504")


def is_retryable(error: Exception) -> bool:
    """Whether a call may succeed if it is made again: a response that can't be read, or an error that calls itself passing."""
    said = f"{type(error).__name__} {error}".lower()
    return isinstance(error, (TimeoutError, ConnectionError, ParseError)) or any(word in said for word in RETRYABLE)


class ClientExtractor:
    """Each document's prompt, or its text where there is none, through an injected client (str -> (response, tokens)), with retries and exponential waits."""

    def __init__(self, client: Callable[[str], tuple[str, int]], model_name: str, retries: int = 1, retryable: Callable[[Exception], bool] = is_retryable, wait: float = 1.0):
        self.client, self.model_name, self.retries, self.retryable, self.wait = client, model_name, retries, retryable, wait

    def extract(self, documents: DataFrame) -> DataFrame:
        client, name, retries, retryable, wait = self.client, self.model_name, self.retries, self.retryable, self.wait

        def run(frames):
            for frame in frames:
                rows = []
                for doc, text in zip(frame["doc_id"], frame["asked"]):
                    began, error, raw, used = time.time(), None, None, 0
                    for attempt in range(retries + 1):
                        try:
                            (raw, used), error = client(text or ""), None
                            break
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                            if attempt == retries or not retryable(e):
                                break
                            time.sleep(wait * 2**attempt)
                    rows.append((doc, raw, name, used, time.time() - began, error is None, error))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

        asked = F.coalesce("prompt", "text") if "prompt" in documents.columns else F.col("text")
        return documents.select("doc_id", asked.alias("asked")).mapInPandas(run, RAW)


_REGISTRY: dict[str, Callable[..., Extractor]] = {"replay": ReplayExtractor, "gazetteer": GazetteerExtractor, "client": ClientExtractor}


def create_extractor(kind: str, *args, **kwargs) -> Extractor:
    if kind not in _REGISTRY:
        raise ConfigurationError(f"unknown extractor {kind!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[kind](*args, **kwargs)
