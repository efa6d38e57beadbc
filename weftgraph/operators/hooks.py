"""Hooks around storage: the registry and the shipped chain of normalising, deduplicating and reviewing entities.

A before_store hook takes the batch's entity rows (doc_id, idx, entity_type, name, confidence, properties[, duplicate_of]) and returns them; hooks that find a
duplicate set ``duplicate_of`` to the name of the entity it means, and storage rewrites the key. idx never changes.
"""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.similarity import hashed_embedding
from weftgraph.functions.text import normalize_name, normalize_text
from weftgraph.operators import resolve
from weftgraph.operators.upsert import merge_properties
from weftgraph.session import materialize


@dataclass
class Hooks:
    """Registered transformations: before_store is chained over the entity table, after_batch runs on the committed tables."""

    before: list[Callable] = field(default_factory=list)
    after: list[Callable] = field(default_factory=list)

    def before_store(self, hook: Callable) -> Callable:
        self.before.append(hook)
        return hook

    def after_batch(self, hook: Callable) -> Callable:
        self.after.append(hook)
        return hook

    @staticmethod
    def _call(hook: Callable, first, extra: dict):
        known = inspect.signature(hook).parameters
        anything = any(p.kind is p.VAR_KEYWORD for p in known.values())
        return hook(first, **{k: v for k, v in extra.items() if anything or k in known})

    def run_before(self, entities: DataFrame, **extra) -> DataFrame:
        """A hook that raises is logged and leaves the table as it was."""
        for hook in self.before:
            try:
                entities = self._call(hook, entities, extra)
            except Exception:
                logging.getLogger(__name__).exception("before_store hook failed")
        return entities

    def run_after(self, tables, **extra) -> None:
        for hook in self.after:
            try:
                self._call(hook, tables, extra)
            except Exception:
                logging.getLogger(__name__).exception("after_batch hook failed")


def _renamed(entities: DataFrame, name: Column) -> DataFrame:
    """The name replaced and kept as property ``normalized_name``; an empty result leaves the row as it was."""
    rows = entities.withColumn("__name", name)
    filled = F.col("__name") != ""
    noted = merge_properties(F.col("properties"), F.create_map(F.lit("normalized_name"), F.col("__name")))
    return rows.withColumns({"properties": F.when(filled, noted).otherwise(F.col("properties")), "name": F.when(filled, F.col("__name")).otherwise(F.col("name"))}).drop("__name")


def normalize_hook() -> Callable:
    """Display form of every name: lower case, special characters dropped, single spaces."""

    def normalise(entities: DataFrame) -> DataFrame:
        return _renamed(entities, normalize_text("name"))

    return normalise


def dictionary_hook(lines: DataFrame) -> Callable:
    """Names that are a key of the dictionary (key, value, line_no) become its value, in display form."""

    def expand(entities: DataFrame) -> DataFrame:
        return _renamed(resolve.expand_names(entities, "name", lines), F.col("expanded")).drop("expanded")

    return expand


def _marked(entities: DataFrame, found: DataFrame) -> DataFrame:
    """``entities`` with ``duplicate_of`` from (entity_type, name, duplicate); one given before stays."""
    rows = entities if "duplicate_of" in entities.columns else entities.withColumn("duplicate_of", F.lit(None).cast("string"))
    return rows.join(found, ["entity_type", "name"], "left").withColumn("duplicate_of", F.coalesce("duplicate_of", "duplicate")).drop("duplicate").select(*rows.columns)


def fuzzy_hook(threshold: float = 0.85) -> Callable:
    """Names like a stored entity's of their type (Jaro-Winkler, best first, the earlier in name order if equal) mean it; all stored entities count."""

    def fuzzy(entities: DataFrame, store, namespace: str) -> DataFrame:
        asked = entities.select("entity_type", "name").distinct().select("entity_type", normalize_name("name").alias("n"), "name").filter("n <> ''")
        new = asked.groupBy("entity_type", F.col("n").alias("name")).agg(F.min("n").alias("ord"))
        known = store.table("entities", [namespace]).select("entity_type", F.col("normalized_name").alias("name"), F.struct("normalized_name", F.col("name").alias("full")).alias("ord"))
        best = resolve.best_matches(new, known, ["entity_type"], threshold).select("entity_type", F.col("name_a").alias("n"), F.col("ord_b.full").alias("duplicate"))
        # an entity that is stored under this very key needs no mark
        found = asked.join(best, ["entity_type", "n"]).filter(F.col("n") != normalize_name("duplicate")).select("entity_type", "name", "duplicate")
        return _marked(entities, materialize(found, "fuzzy"))

    return fuzzy


def vector_hook(threshold: float = 0.85, embed: Callable[[Column], Column] = hashed_embedding) -> Callable:
    """Names whose embedding is near a stored one of their type mean its entity; the others' embeddings are stored, a group of like ones among them under its first name.

    ``embed`` makes a vector of a name: a built-in expression by default, or a pandas UDF around a model.
    """

    def vector(entities: DataFrame, store, namespace: str) -> DataFrame:
        rows = entities if "duplicate_of" not in entities.columns else entities.filter("duplicate_of IS NULL")
        asked = rows.select("entity_type", "name").distinct().withColumn("embedding", embed(F.col("name"))).withColumns({"namespace": F.lit(namespace), "vec_id": F.col("name")})
        asked = materialize(asked.filter("embedding IS NOT NULL"), "vectors")
        near = store.search_similar(asked, 1, threshold, ["entity_name"])
        known = near.select(F.col("entity_type"), F.col("query_id").alias("name"), F.col("entity_name").alias("duplicate"))
        fresh = asked.join(known, ["entity_type", "name"], "left_anti")
        led = materialize(resolve.leaders(fresh.select("entity_type", F.col("name").alias("ord"), "embedding"), ["entity_type"], threshold), "leaders")
        store.add_embeddings(fresh.join(led.filter("ord = leader").select("entity_type", F.col("ord").alias("name")), ["entity_type", "name"]).select("namespace", "entity_type", F.col("name").alias("entity_name"), "embedding"))
        inner = led.filter("ord <> leader").select("entity_type", F.col("ord").alias("name"), F.col("leader").alias("duplicate"))
        return _marked(entities, materialize(known.filter("name <> duplicate").unionByName(inner), "alike"))

    return vector


def review(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """Replay of review scripts (doc_id, seq, action, n, m, new_name) over each document's entities, numbered 1.. by idx.

    Actions are taken in the order of seq: ``delete n`` drops n, ``edit n`` renames it (blank names change nothing), ``merge n m`` lets n go into m where both have
    one type, ``done`` ends the script. Numbers that don't exist, or whose entity has gone by then, make an action void. A script is replayed in one task a document, with
    the document's entities only.
    """
    numbered = entities.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "entity_type", "name")))
    schema = "doc_id string, n int, gone boolean, new_name string"

    def replay(rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        types = dict(zip(rows["__n"], rows["entity_type"]))
        gone, names = set(), {}
        for step in steps.sort_values("seq", kind="stable").itertuples():
            if step.action == "done":
                break
            here = lambda x: not pd.isna(x) and int(x) in types and int(x) not in gone
            if not here(step.n):
                continue
            n = int(step.n)
            if step.action == "delete":
                gone.add(n)
            elif step.action == "edit" and isinstance(step.new_name, str) and step.new_name.strip():
                names[n] = step.new_name.strip()
            elif step.action == "merge" and here(step.m) and int(step.m) != n and types[n] == types[int(step.m)]:
                gone.add(n)
        doc = rows["doc_id"].iloc[0] if len(rows) else None
        return pd.DataFrame([(doc, n, n in gone, names.get(n)) for n in sorted(gone | set(names))], columns=["doc_id", "n", "gone", "new_name"])

    asked = edits.select("doc_id", "seq", "action", "n", "m", "new_name").filter("doc_id IS NOT NULL")
    some = numbered.select(F.col("doc_id").cast("string").alias("doc_id"), "__n", "entity_type").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    done = some.groupBy("doc_id").cogroup(asked.groupBy("doc_id")).applyInPandas(replay, schema)
    done = materialize(done.select("doc_id", F.col("n").alias("__n"), "gone", F.col("new_name").alias("__new")), "review")
    kept = numbered.join(done, ["doc_id", "__n"], "left").filter("NOT coalesce(gone, false)")
    return kept.withColumn("name", F.coalesce("__new", "name")).select(*entities.columns)


def review_hook(edits: DataFrame) -> Callable:
    """The review as a hook; ``edits`` are the answers of whoever reviewed, a table instead of a dialogue."""

    def reviewed(entities: DataFrame) -> DataFrame:
        return review(entities, edits)

    return reviewed


class Answers:
    """Decisions asked for during a run, from a table of answers {question: answer}; without one, or with another than may be chosen, the default counts."""

    def __init__(self, given: dict[str, str] | None = None):
        self.given, self.enabled = given or {}, given is not None

    def confirm(self, question: str, default: bool = True) -> bool:
        answer = self.given.get(question)
        return default if answer is None else answer.strip().lower() in ("y", "yes", "true", "1")

    def prompt(self, question: str, default: str | None = None) -> str:
        return self.given.get(question, default or "")

    def choose(self, question: str, choices: list[str], default: str | None = None) -> str:
        answer = self.given.get(question)
        return answer if answer in choices else default or choices[0]


def dedupe_hook(threshold: float = 0.75) -> Callable:
    """After a batch: similar names of a type merge into the longer one."""

    def dedupe(store, namespace: str) -> None:
        from weftgraph.operators.pipeline import dedupe as merge

        merge(store, namespace, threshold)

    return dedupe


def default_hooks(lines: DataFrame | None = None, fuzzy: float | None = 0.85, vector: float | None = None, edits: DataFrame | None = None, merge: float | None = None, embed: Callable[[Column], Column] = hashed_embedding) -> Hooks:
    """The chain normalise, dictionary, fuzzy, vector, review, and merging after the batch; what is None is left out."""
    chain = [normalize_hook()]
    if lines is not None:
        chain.append(dictionary_hook(lines))
    if fuzzy is not None:
        chain.append(fuzzy_hook(fuzzy))
    if vector is not None:
        chain.append(vector_hook(vector, embed))
    if edits is not None:
        chain.append(review_hook(edits))
    return Hooks(chain, [dedupe_hook(merge)] if merge is not None else [])
