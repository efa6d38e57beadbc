"""Problem 3: best representative of each duplicate group by field-by-field survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import is_known


def survivors(df: DataFrame, group: Column, fields: dict[str, Column], confidence: Column, time: Column, key: list[str]) -> DataFrame:
    """The surviving value of every field of every group of two or more records: ``(group_key, field, *key, value)``.

    One aggregation takes, for each field, the extreme of one composite struct: (confidence, time, key, value) over the records whose
    value is known. The struct is inverted (negated confidence and time, then the key ascending) so that its minimum is the winner. Confidence null, NaN or
    outside 0 to 1 ranks last, a null time ranks after any time, a null key part after any other. Values that only say that nothing is known never win; a
    field without a known value has no row. Rows with a null or blank group are left out. A record is one ``key``: repeated rows count once. Partial
    aggregation reduces a group, of any size, to one row a map task before the shuffle. Empty tables give none.
    """
    c = confidence.cast("double")
    rank = F.when(c.between(0, 1) & ~F.isnan(c), -c).otherwise(F.lit(2.0))
    late = F.coalesce(-F.unix_micros(time.cast("timestamp")), F.lit(2**63 - 1))
    parts = [x for k in key for x in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(k))]
    best = [F.min(F.when(is_known(v), F.struct(rank.alias("rank"), late.alias("late"), *parts, v.alias("value")))).alias(f) for f, v in fields.items()]
    whole = F.struct(*parts)
    grouped = df.withColumn("__group", group).filter("trim(__group) <> ''").groupBy(F.col("__group").alias("group_key")).agg(F.min(whole).alias("__first"), F.max(whole).alias("__last"), *best)
    several = grouped.filter("__first <> __last")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("won")) for f in fields)))
    return several.select("group_key", each.alias("s")).filter("s.won IS NOT NULL").select("group_key", "s.field", *(F.col(f"s.won.{k}").alias(k) for k in key), F.col("s.won.value").alias("value"))


def merged_records(found: DataFrame, fields: list[str]) -> DataFrame:
    """One record a group from :func:`survivors`: a column for each field, null where no value survived."""
    return found.groupBy("group_key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
