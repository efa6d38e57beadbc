"""Prefix-filter set-similarity join (shared by problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize


def word_grams(c: Column, n: int) -> Column:
    """Numbered n-grams of the words of a string, each word padded; the order of the words doesn't matter.

    A gram that occurs k times gives k tokens, so sets compare like multisets.
    """
    words = F.filter(F.split(c, " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, n))))
    ordered = F.array_sort(grams)
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("#"), (i - F.array_position(ordered, g) + 2).cast("string")))


def similarity_join(left: DataFrame, right: DataFrame, key: str, tokens: str, threshold: float, same: bool = False) -> DataFrame:
    """Pairs ``(left_key, right_key, jaccard)`` of rows whose token sets have a Jaccard of at least ``threshold``; exact.

    ``key`` must be unique on each side, ``tokens`` is an array without repeats; other columns are not read. Tokens are ordered by global rarity and only the
    ``n - ceil(t n) + 1`` rarest of each set are joined (two sets that reach the threshold must share one of them); the length and
    positional filters drop most of what meets, and the Jaccard of the rest is computed on the whole sets. With ``same`` the
    sides are one table and each pair comes once, left_key < right_key. Rows with null keys, null or empty token arrays have no pairs.
    A token is joined the more rarely the more rows hold it: frequent tokens fall out of the prefixes. The counts are written first, so that AQE splits the rows of
    a frequent token where they are looked up.
    """
    def sized(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).filter(F.col("key").isNotNull() & (F.size("tokens") > 0))

    left, right = sized(left), sized(right)
    each = left if same else left.unionByName(right)
    counts = each.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")

    def prefixes(df: DataFrame) -> DataFrame:
        rows = df.select("key", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(counts, "token")
        ranked = rows.groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
        return ranked.select("key", "size", F.posexplode(F.slice("ranked", F.lit(1), keep.cast("int"))).alias("at", "r")).select("key", "size", "at", F.col("r.token").alias("token"))

    a = prefixes(left)
    b = a if same else prefixes(right)
    a, b = a.toDF("left_key", "left_size", "left_at", "token"), b.toDF("right_key", "right_size", "right_at", "token")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size")) - 1e-9)
    most = 1 + F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at")) - 1
    long_enough = (F.col("left_size") >= threshold * F.col("right_size") - 1e-9) & (F.col("right_size") >= threshold * F.col("left_size") - 1e-9)
    met = a.join(b, "token").filter(long_enough)
    if same:
        met = met.filter("left_key < right_key")
    # the first shared prefix token bounds the overlap: what stands before it in either order is not shared
    first = met.groupBy("left_key", "right_key").agg(F.max(most >= need).alias("possible")).filter("possible").select("left_key", "right_key")
    sets = first.join(left.toDF("left_key", "left_tokens"), "left_key").join(right.toDF("right_key", "right_tokens"), "right_key")
    both = F.size(F.array_intersect("left_tokens", "right_tokens"))
    jaccard = both / (F.size("left_tokens") + F.size("right_tokens") - both)
    return sets.select("left_key", "right_key", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)
