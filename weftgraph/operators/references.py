"""References to records that do not exist (problem 6): composite keys with partial nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

MATCHES = ("simple", "partial", "full")


def orphans(refs: DataFrame, ref_columns: list[str], targets: DataFrame, key_columns: list[str], match: str = "simple", ref_time: str | None = None, target_time: str | None = None) -> DataFrame:
    """Rows of ``refs`` whose composite reference has no target, with a column ``state``.

    References are grouped by their null mask and each mask is joined to the distinct targets on its non-null columns only, so
    every join is an equi-join. ``match`` says what nulls mean, as in SQL: *simple*: a reference with any null refers to nothing and is never
    an orphan; *partial*: the non-null columns must occur together in a target, all-null is no reference; *full*: all-null
    is no reference, any other null makes it an orphan ('partial key').

    ``state`` is 'missing', 'partial key', or, where both time columns are given, 'late' if the earliest target is later than the
    reference (a null time is never late). Repeated references stay repeated; targets are reduced to one row a key and written before the join, so a key of any
    frequency is shuffled once a map task, never multiplies rows, and the references to a popular key are split over tasks by AQE. Columns of ``targets`` other than the keys and time are not
    read, so clashing names do no harm; a column ``state`` of ``refs`` gives way to this one. Empty targets make every reference 'missing'.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if len(ref_columns) != len(key_columns):
        raise ValueError("as many reference as key columns are needed")
    timed = ref_time is not None and target_time is not None
    names = [f"__key{i}" for i in range(len(key_columns))]
    keyed = targets.select(*(targets[k].alias(n) for k, n in zip(key_columns, names)), (targets[target_time] if timed else F.lit(None)).alias("__since"))
    shown = [c for c in refs.columns if c != "state"]
    bits = reduce(lambda a, b: a + b, (F.when(refs[c].isNull(), 1 << i).otherwise(0) for i, c in enumerate(ref_columns)))
    marked = refs.withColumn("__mask", bits)
    every = (1 << len(ref_columns)) - 1
    parts = []
    for mask in range(every + 1):
        if mask == every and mask or mask and match == "simple":
            continue
        some = marked.filter(F.col("__mask") == mask)
        if mask and match == "full":
            parts.append(some.select(*shown, F.lit("partial key").alias("state")))
            continue
        on = [(c, n) for i, (c, n) in enumerate(zip(ref_columns, names)) if not mask >> i & 1]
        known = keyed.dropna(subset=[n for _, n in on]).groupBy(*(n for _, n in on)).agg(F.min("__since").alias("__since"), F.lit(True).alias("__there"))
        known = materialize(known, "targets")
        joined = some.join(known, [some[c] == known[n] for c, n in on], "left")
        state = F.when(F.col("__there").isNull(), "missing")
        if timed:
            state = state.when(F.col("__since") > F.col(ref_time), "late")
        parts.append(joined.withColumn("state", state).filter("state IS NOT NULL").select(*shown, "state"))
    return reduce(DataFrame.unionByName, parts)


def orphan_counts(found: DataFrame, table: str, time: str, by: list[str]) -> DataFrame:
    """Orphans per table, period (week of ``time``, null where the time is) and ``by`` columns."""
    week = F.to_date(F.date_trunc("week", F.col(time))).alias("week")
    return found.groupBy(F.lit(table).alias("table_name"), week, *by).agg(F.count("*").alias("n"))
