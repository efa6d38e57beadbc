"""Keyed merges of graph tables, as DataFrame transformations.

All merges are set-oriented: one window or aggregation on the key and at most one join with the existing table on the
same key. Nothing is updated in place; :class:`weftgraph.operators.store.GraphStore` swaps table versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order`` (insert-if-absent inside a batch). Null keys are keys of their own."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order`` (property overwrite inside a batch)."""
    return first_wins(df, key, [F.col(c).desc_nulls_last() for c in order])


def insert_absent(existing: DataFrame, staged: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` plus the staged rows whose key it lacks; existing rows stay as they are. ``staged`` has one row a key."""
    return existing.unionByName(staged.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def overwrite(existing: DataFrame, staged: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """Staged rows replace existing rows of their key, but for the ``keep`` columns (created_at and the like), which stay."""
    old = existing.select(*key, *(F.col(c).alias(f"__old_{c}") for c in keep), F.lit(True).alias("__there"))
    merged = staged.join(old, key, "left")
    for c in keep:
        merged = merged.withColumn(c, F.when(F.col("__there"), F.col(f"__old_{c}")).otherwise(F.col(c)))
    merged = merged.drop("__there", *(f"__old_{c}" for c in keep))
    return existing.join(staged.select(*key), key, "left_anti").unionByName(merged, allowMissingColumns=True)


def merge_properties(old: Column, new: Column) -> Column:
    """Map merge: new values win, a null value removes its key. Null maps count as empty."""
    empty = F.expr("cast(map() as map<string,string>)")
    return F.map_filter(F.map_concat(F.coalesce(old, empty), F.coalesce(new, empty)), lambda _, v: v.isNotNull())


def last_properties(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``(key, properties)``: of every property of a key the last writer's value; a null value stays, to remove the property where maps are merged."""
    each = df.select(*key, F.struct(*order).alias("__at"), F.explode("properties").alias("__name", "__value"))
    one = each.groupBy(*key, "__name").agg(F.max_by(F.struct("__value"), "__at").alias("__last"))
    return one.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__name", F.col("__last.__value"))))).alias("properties"))


def with_aliases(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """``entities`` where the canonical ones of (namespace, entity_type, duplicate, canonical) have the merged entities' names added to their property ``aliases``, a JSON array."""
    key = ["namespace", "entity_type", "normalized_name"]
    merged = entities.select(*key, "name").join(canonical.select("namespace", "entity_type", F.col("duplicate").alias("normalized_name"), "canonical"), key)
    names = merged.groupBy("namespace", "entity_type", F.col("canonical").alias("normalized_name")).agg(F.collect_set("name").alias("__names"))
    known = F.coalesce(F.from_json(F.col("properties")["aliases"], "array<string>"), F.array().cast("array<string>"))
    listed = F.to_json(F.array_sort(F.array_distinct(F.concat(known, F.col("__names")))))
    joined = entities.join(names, key, "left")
    added = merge_properties(F.col("properties"), F.create_map(F.lit("aliases"), listed))
    return joined.withColumn("properties", F.when(F.col("__names").isNull(), F.col("properties")).otherwise(added)).select(*entities.columns)


def update_entities(entities: DataFrame, changes: DataFrame, key: list[str], now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(updated table, changes whose key does not exist). ``changes`` is key columns and a ``properties`` map, one row a key."""
    delta = changes.select(*key, F.col("properties").alias("__new"))
    joined = entities.join(delta, key, "left")
    touched = F.col("__new").isNotNull()
    updated = joined.withColumn("properties", F.when(touched, merge_properties(F.col("properties"), F.col("__new"))).otherwise(F.col("properties")))
    updated = updated.withColumn("updated_at", F.when(touched, F.lit(now_ms)).otherwise(F.col("updated_at"))).drop("__new")
    return updated.select(*entities.columns), changes.join(entities.select(*key), key, "left_anti")


def delete_entities(entities: DataFrame, mentions: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop entities and every edge that touches them. ``gone`` has (namespace, entity_type, normalized_name)."""
    key = ["namespace", "entity_type", "normalized_name"]
    gone = gone.select(*key).distinct()
    left = relations.join(gone.toDF("namespace", "src_type", "src_norm"), ["namespace", "src_type", "src_norm"], "left_anti")
    left = left.join(gone.toDF("namespace", "dst_type", "dst_norm"), ["namespace", "dst_type", "dst_norm"], "left_anti")
    return entities.join(gone, key, "left_anti"), mentions.join(gone, key, "left_anti"), left.select(*relations.columns)


def repoint(mentions: DataFrame, relations: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move edges from merged entities to their canonical ones.

    ``canonical`` is (namespace, entity_type, duplicate, canonical). A mention that meets an existing one of the canonical entity gives way to it; relations
    are repointed on both ends, self-loops made by the merge are dropped and equal edges collapse.
    """
    m = canonical.select("namespace", "entity_type", F.col("duplicate").alias("normalized_name"), "canonical")
    moved = mentions.join(m, ["namespace", "entity_type", "normalized_name"], "left")
    moved = moved.withColumn("__moved", F.col("canonical").isNotNull()).withColumn("normalized_name", F.coalesce("canonical", "normalized_name")).drop("canonical")
    moved = first_wins(moved, ["namespace", "doc_id", "entity_type", "normalized_name"], ["__moved", F.col("confidence").desc_nulls_last()]).drop("__moved")
    out = relations.withColumn("__loop", F.struct("src_type", "src_norm") == F.struct("dst_type", "dst_norm"))
    for end in ("src", "dst"):
        one = canonical.select("namespace", F.col("entity_type").alias(f"{end}_type"), F.col("duplicate").alias(f"{end}_norm"), "canonical")
        out = out.join(one, ["namespace", f"{end}_type", f"{end}_norm"], "left").withColumn(f"{end}_norm", F.coalesce("canonical", f"{end}_norm")).drop("canonical")
    out = out.filter((F.struct("src_type", "src_norm") != F.struct("dst_type", "dst_norm")) | F.col("__loop")).select(*relations.columns)
    edge = ["namespace", "src_type", "src_norm", "rel_type", "dst_type", "dst_norm"]
    return moved.select(*mentions.columns), first_wins(out, edge, [F.col("confidence").desc_nulls_last()])
