"""Entity resolution of the graph: dictionary expansion, best match, pair lists, canonical map, leaders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.similarity import jaro_winkler, letter_counts, may_reach_jaro_winkler, may_reach_sequence, sequence_ratio
from weftgraph.functions.text import normalize_text
from weftgraph.operators.upsert import first_wins
from weftgraph.session import materialize


def dictionary(lines: DataFrame) -> DataFrame:
    """(key, value): keys in display form; of a key that occurs again the last line counts."""
    keyed = lines.select(normalize_text("key").alias("key"), "value", "line_no").filter("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def expand_names(df: DataFrame, name: str, lines: DataFrame) -> DataFrame:
    """``df`` with ``expanded``: the display form, replaced by the dictionary's expansion where the whole name is a key.

    Spark broadcasts the dictionary, a written table of known size, if that allows, and joins by key otherwise, where AQE splits a frequent name.
    """
    known = materialize(dictionary(lines), "dictionary").toDF("__key", "__value")
    joined = df.withColumn("__plain", normalize_text(name)).join(known, F.col("__plain") == F.col("__key"), "left")
    return joined.withColumn("expanded", normalize_text(F.coalesce("__value", "__plain"))).drop("__plain", "__key", "__value")


def _blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], bound, threshold: float, more: Column | None = None) -> DataFrame:
    """Pairs of a block that pass a native bound: an equi-join on the block, split by AQE where a block is large."""
    a = left.select(*block, *(F.col(c).alias(f"{c}_a") for c in ("name", "ord"))).withColumn("letters_a", letter_counts(F.col("name_a")))
    b = right.select(*block, *(F.col(c).alias(f"{c}_b") for c in ("name", "ord"))).withColumn("letters_b", letter_counts(F.col("name_b")))
    joined = a.join(b, block)
    if more is not None:
        joined = joined.filter(more)
    return joined.filter(bound(F.col("name_a"), F.col("name_b"), F.col("letters_a"), F.col("letters_b"), threshold)).drop("letters_a", "letters_b")


def best_matches(new: DataFrame, existing: DataFrame, block: list[str], threshold: float = 0.85) -> DataFrame:
    """The best existing name of each new one by Jaro-Winkler: (block, name_a, ord_a, name_b, ord_b, score).

    ``new`` and ``existing`` have the block columns, ``name`` and a total order ``ord``. Ties go to the earlier existing row. Names without
    a match at the threshold have no row. Null and blank names match nothing.
    """
    pairs = _blocked_pairs(new, existing, block, may_reach_jaro_winkler, threshold)
    scored = pairs.withColumn("score", jaro_winkler("name_a", "name_b")).filter(F.col("score") >= threshold)
    best = F.row_number().over(Window.partitionBy(*block, "ord_a").orderBy(F.col("score").desc(), "ord_b"))
    return scored.withColumn("__rank", best).filter("__rank = 1").drop("__rank")


def similar_pairs(names: DataFrame, block: list[str], threshold: float = 0.75, method: str = "sequence") -> DataFrame:
    """All pairs of a block with similarity at the threshold, earlier name first: (block, name_a, ord_a, name_b, ord_b, score)."""
    bound, score = {"sequence": (may_reach_sequence, sequence_ratio), "jaro_winkler": (may_reach_jaro_winkler, jaro_winkler)}[method]
    pairs = _blocked_pairs(names, names, block, bound, threshold, F.col("ord_a") < F.col("ord_b"))
    return pairs.withColumn("score", score("name_a", "name_b")).filter(F.col("score") >= threshold)


def _ends(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.select("namespace", "entity_type", F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), *columns)


def unordered_once(pairs: DataFrame) -> DataFrame:
    """Each pair of names once, whatever the direction: the best score, of equal ones the smallest pair_id."""
    return first_wins(_ends(pairs.filter("name_a <> name_b"), "score", "pair_id"), ["namespace", "entity_type", "name_a", "name_b"], [F.col("score").desc_nulls_last(), "pair_id"])


def by_score(pairs: DataFrame) -> DataFrame:
    """Pairs, best first; of equal ones the earlier in scan order."""
    return pairs.orderBy(F.col("score").desc(), "ord_a", "ord_b")


def hybrid_scores(pairs: DataFrame, vector: float = 0.6, fuzzy: float = 0.4) -> DataFrame:
    """Vector and fuzzy results of a pair of names as one weighted score; a method without a result counts 0."""
    ends = _ends(pairs.filter("name_a IS NOT NULL AND name_b IS NOT NULL AND score IS NOT NULL"), "method", "score")
    part = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("score"))), F.lit(0.0))
    return ends.groupBy("namespace", "entity_type", "name_a", "name_b").agg(F.round(vector * part("vector") + fuzzy * part("fuzzy"), 6).alias("score"))


def candidates(fuzzy: DataFrame, vector: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` candidates a name from both kinds of matches (block, name, other, score), each other name once with its best score: (block, name, other, score, method, rank)."""
    both = fuzzy.withColumn("method", F.lit("fuzzy")).unionByName(vector.withColumn("method", F.lit("vector")))
    once = first_wins(both, ["block", "name", "other"], [F.col("score").desc(), "method"])
    rank = F.row_number().over(Window.partitionBy("block", "name").orderBy(F.col("score").desc(), "other"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit)


def canonical_map(pairs: DataFrame, block: list[str]) -> DataFrame:
    """(block, duplicate, canonical) from scored pairs, best first: of each pair the longer name stays, the later one if equally long.

    A name that has gone is followed to the one it went into, so no merge loses anything. The pairs of one block are taken in one task.
    """
    kinds = {f.name: f.dataType for f in pairs.schema}
    schema = ", ".join([*(f"{c} {kinds[c].simpleString()}" for c in block), "duplicate string", "canonical string"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        into: dict[str, str] = {}

        def now(name: str) -> str:
            while name in into:
                name = into[name]
            return name

        for row in frame.sort_values(["score", "ord_a", "ord_b"], ascending=[False, True, True], kind="stable").itertuples():
            a, b = now(row.name_a), now(row.name_b)
            if a != b:
                keep, gone = (b, a) if len(b) >= len(a) else (a, b)
                into[gone] = keep
        rows = [(*key, gone, now(gone)) for gone in into]
        return pd.DataFrame(rows, columns=[*block, "duplicate", "canonical"])

    return pairs.groupBy(*block).applyInPandas(run, schema)


def leaders(vectors: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """Online leader clustering in ``ord``: each vector joins the nearest leader at the threshold or becomes one.

    ``vectors`` has the block columns, ``ord`` and ``embedding``; out: (block, ord, leader, score). Sequential by definition, so a block is one task.
    """
    kinds = {f.name: f.dataType for f in vectors.schema}
    schema = ", ".join([*(f"{c} {kinds[c].simpleString()}" for c in block), f"ord {kinds['ord'].simpleString()}", f"leader {kinds['ord'].simpleString()}", "score double"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        heads, base, out = [], np.zeros((0, 0)), []
        for ord_, vector in zip(frame["ord"], frame["embedding"]):
            v = np.asarray(vector, np.float64)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            scores = base @ v if len(heads) else np.zeros(0)
            best = int(scores.argmax()) if len(heads) else -1
            if best >= 0 and scores[best] >= threshold:
                out.append((*key, ord_, heads[best], float(scores[best])))
            else:
                heads.append(ord_)
                base = np.vstack([base, v]) if len(base) else v[None, :]
                out.append((*key, ord_, ord_, 1.0))
        return pd.DataFrame(out, columns=[*block, "ord", "leader", "score"])

    return vectors.groupBy(*block).applyInPandas(run, schema)
