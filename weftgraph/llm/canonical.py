"""Problem 4: mapping free-typed values to a canonical list by a prefix-filter set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.setjoin import similarity_join, word_grams
from weftgraph.session import materialize

GRAM = 2
THRESHOLD = 0.3
SURE = 0.6
EDITS = 0.4


def plain_words(c: Column, noise: str | None = None) -> Column:
    """Words of a typed value: camel case parted, marks and leading articles dropped, lower case; what ``noise``, a pattern over the lower case, matches is dropped too."""
    low = F.lower(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    low = low if noise is None else F.regexp_replace(low, noise, " ")
    low = F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(low, r"^\s*(the|an|a) ", " "))


def listed_words(text: Column, pattern: str) -> Column:
    """The words, parted by commas, that group 1 of a pattern finds in a text: other words in use that a description lists."""
    return F.split(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\.\s*$", ""), r",\s*")


def canonical_phrases(definitions: DataFrame, others: Column | None = None) -> DataFrame:
    """``(entity_type_id, phrase)``: the id, the name and the words in ``others``, an array of other words in use, of each definition."""
    also = F.array().cast("array<string>") if others is None else F.coalesce(others, F.array().cast("array<string>"))
    each = F.explode(F.concat(F.array("entity_type_id", "name"), also))
    rows = definitions.filter("entity_type_id IS NOT NULL").select("entity_type_id", each.alias("phrase"))
    return rows.select("entity_type_id", plain_words(F.col("phrase")).alias("phrase")).filter("phrase <> ''").groupBy("phrase").agg(F.min("entity_type_id").alias("entity_type_id"))


def map_values(values: DataFrame, value: str, phrases: DataFrame, noise: str | None = None) -> DataFrame:
    """``(value, entity_type_id, phrase, jaccard)`` of every distinct non-null value; the last three are null where nothing fits.

    Values are reduced to distinct plain words first (map-side combined), so a value of any frequency is compared once. Candidates share a rare
    n-gram (prefix filter), reach a Jaccard of ``THRESHOLD`` exactly, and are taken if it is ``SURE``, if one is the other with words cut short, or if the edit distance is at most ``EDITS`` of
    the length; the best Jaccard wins, then the smaller distance, then the smaller id. Values without letters or digits match nothing.
    """
    distinct = materialize(values.select(F.col(value).alias("value")).filter("value IS NOT NULL").distinct(), "values").withColumn("words", plain_words(F.col("value"), noise))
    typed = distinct.select("words").distinct().filter("words <> ''").withColumn("grams", word_grams(F.col("words"), GRAM))
    known = phrases.withColumnRenamed("phrase", "words").withColumn("grams", word_grams(F.col("words"), GRAM))
    pairs = similarity_join(typed.select("words", "grams"), known.select("words", "grams"), "words", "grams", THRESHOLD)
    edits = F.levenshtein(F.regexp_replace("left_key", " ", ""), F.regexp_replace("right_key", " ", ""))
    a, b = F.split("left_key", " "), F.split("right_key", " ")
    shortened = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (F.least(F.length(x), F.length(y)) >= 3) & (x.startswith(y) | y.startswith(x))), lambda ok: ok)
    good = pairs.withColumn("edits", edits).filter((F.col("jaccard") >= SURE) | shortened | (F.col("edits") <= F.floor(F.greatest(F.length("left_key"), F.length("right_key")) * EDITS)))
    good = good.join(known.select(F.col("words").alias("right_key"), "entity_type_id"), "right_key")
    best = good.groupBy("left_key").agg(F.min(F.struct(-F.col("jaccard"), "edits", "entity_type_id", F.col("right_key").alias("phrase"), "jaccard")).alias("b"))
    best = best.select(F.col("left_key").alias("words"), "b.entity_type_id", "b.phrase", "b.jaccard")
    return materialize(distinct.join(best, "words", "left").select("value", "entity_type_id", "phrase", "jaccard"), "mapped")


def map_rows(rows: DataFrame, value: str, definitions: DataFrame, others: Column | None = None, noise: str | None = None) -> DataFrame:
    """``rows`` with ``mapped_id``: rows whose value is null, blank or already an id are left out; 'unmatched' where nothing fits.

    ``others`` and ``noise`` are those of :func:`canonical_phrases` and :func:`plain_words`. The values' map is a written table, so Spark knows its size, and AQE splits a value that
    many rows have. Repeated rows stay repeated; a column ``mapped_id`` of ``rows`` gives way to this one.
    """
    ids = definitions.select(F.col("entity_type_id").alias("__id")).filter("__id IS NOT NULL").distinct()
    open_ = rows.filter(F.regexp_replace(F.col(value), r"(?U)\s", "") != "").join(ids, F.col(value) == F.col("__id"), "left_anti")
    mapped = map_values(open_, value, canonical_phrases(definitions, others), noise).select(F.col("value").alias("__value"), F.col("entity_type_id").alias("__mapped"))
    joined = open_.join(mapped, open_[value] == mapped["__value"], "left")
    return joined.select(*(c for c in rows.columns if c != "mapped_id"), F.coalesce("__mapped", F.lit("unmatched")).alias("mapped_id"))
