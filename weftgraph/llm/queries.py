"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import canonical, components, history, nicknames, packing, reading, split, survivors, tokens, variants
from weftgraph.functions.text import UNKNOWN_VALUES, normalize_name
from weftgraph.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Numbered pieces of every page above 2,000 characters; one set of pieces for each different reading of a page."""
    pages = table(spark, d, "parsed_documents").select("doc_id", "text")
    return split.split_documents(pages).dropDuplicates(["doc_id", "text_key", "piece_no"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that had to be split."""
    pages = table(spark, d, "parsed_documents").select("doc_id", "text")
    return split.split_documents(pages).filter("n_pieces > 1 and piece_no = 1").select("doc_id").distinct()


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each split text put together again from the new parts of its pieces, with whether all pieces keep to the limit and the overlap."""
    p = p1_pieces(spark, d)
    fits = (F.char_length("piece") <= split.LIMIT) & (F.char_length("piece") == F.col("end") - F.col("start"))
    laps = F.when(F.col("piece_no") == 1, F.col("new_from") == F.col("start")).otherwise((F.col("new_from") - F.col("start")).between(1, split.OVERLAP))
    new = F.struct("piece_no", F.expr("substring(piece, new_from - start + 1)").alias("new"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["new"]), "")
    each = p.groupBy("doc_id", "text_key", "n_pieces").agg(whole.alias("text"), F.bool_and(fits & laps).alias("good"), F.count("*").alias("n"))
    return each.select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars"), (F.col("good") & (F.col("n") == F.col("n_pieces"))).alias("good"))


P1_REBUILT = "SELECT DISTINCT doc_id, md5(text) AS text_md5, length(text)::INT AS n_chars, true AS good FROM parsed_documents WHERE length(text) > 2000"
P1_FOUND = "SELECT DISTINCT doc_id FROM parsed_documents WHERE length(text) > 2000"


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_documents").select(F.col("doc_id").alias("item"), "batch_no", "text")
    nodes = table(spark, d, "entities").filter("normalized_name IS NOT NULL")
    block = F.concat_ws(":", F.coalesce("namespace", F.lit("")), F.coalesce("entity_type", F.lit("")))
    names = nodes.select(F.concat(block, F.lit(":"), "normalized_name").alias("item"), "batch_no", block.alias("block"), F.col("normalized_name").alias("name"))
    return history.dedupe_batches(pages, names)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Repeats and near repeats of what was accepted before, as pairs of keys."""
    r = _repeats(spark, d)
    return r.select("kind", F.least("item", "target").alias("key_a"), F.greatest("item", "target").alias("key_b")).distinct()


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of each batch by kind and way."""
    return _repeats(spark, d).groupBy("kind", "batch_no", "how").agg(F.count("*").alias("n_repeats"))


ASSET_FIELDS = ["name", "owner", "tier", "site", "lifecycle", "summary"]


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities")
    fields = {f: F.col("name") if f == "name" else F.col("properties")[f] for f in ASSET_FIELDS}
    return survivors.survivors(rows, F.upper(F.trim(F.col("properties")["asset_tag"])), fields, F.col("confidence"), F.col("extracted_at"), ["doc_id", "idx"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The record whose value survives, for each field of each registered thing."""
    return _survivors(spark, d).select(F.col("group_key").alias("asset_tag"), "field", "doc_id", "idx")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One built record for each registered thing."""
    return survivors.merged_records(_survivors(spark, d), ASSET_FIELDS).withColumnRenamed("group_key", "asset_tag")


_LIST = ", ".join(f"'{v}'" for v in UNKNOWN_VALUES)
_P3 = f"""
WITH e AS (SELECT upper(trim(map_extract(properties, 'asset_tag')[1])) AS asset_tag, doc_id, idx, confidence, extracted_at, name, properties FROM extracted_entities),
g AS (SELECT asset_tag FROM e WHERE trim(asset_tag) <> '' GROUP BY asset_tag HAVING count(DISTINCT (doc_id, idx)) > 1),
v AS (SELECT asset_tag, doc_id, idx, confidence, extracted_at, 'name' AS field, name AS value FROM e
      {" ".join(f"UNION ALL SELECT asset_tag, doc_id, idx, confidence, extracted_at, '{f}', map_extract(properties, '{f}')[1] FROM e" for f in ASSET_FIELDS[1:])}),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_tag, field ORDER BY CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN -confidence ELSE 2 END, extracted_at DESC NULLS LAST, doc_id NULLS LAST, idx NULLS LAST, value) AS n
      FROM v JOIN g USING (asset_tag) WHERE regexp_matches(lower(trim(value)), '[\\p{{L}}\\p{{N}}]') AND lower(trim(value)) NOT IN ({_LIST}))
"""
P3_FOUND = _P3 + "SELECT asset_tag, field, doc_id, idx FROM r WHERE n = 1"
P3_RECORDS = _P3 + f"SELECT asset_tag, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}" for f in ASSET_FIELDS)} FROM r WHERE n = 1 GROUP BY asset_tag"


#: How these data decorate types and list other words in use (fixed values).
TYPE_NOISE = r"^\s*type\s*:"
OTHER_WORDS = r"(?i)also called:\s*(.*)$"


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").select("doc_id", "idx", "entity_type")
    return canonical.map_rows(rows, "entity_type", table(spark, d, "entity_defs"), canonical.listed_words(F.col("description"), OTHER_WORDS), TYPE_NOISE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The definition meant by each typed entity type."""
    return _mapped(spark, d).select("doc_id", "idx", F.col("mapped_id").alias("entity_type_id")).distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that fit no definition, with their rows."""
    return _mapped(spark, d).filter("mapped_id = 'unmatched'").groupBy("entity_type").agg(F.count("*").alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every node that accepted pairs join."""
    pairs = table(spark, d, "similar_pairs").filter("accepted")
    block = F.concat(F.coalesce("namespace", F.lit("")), F.lit("\u0001"), F.coalesce("entity_type", F.lit("")), F.lit("\u0001"))
    ends = pairs.select(F.concat(block, normalize_name("name_a")).alias("a"), F.concat(block, normalize_name("name_b")).alias("b"))
    groups = components.hash_to_min(ends.distinct())
    part = lambda c, i: F.split_part(F.col(c), F.lit("\u0001"), F.lit(i))
    return groups.select(part("vertex", 1).alias("namespace"), part("vertex", 2).alias("entity_type"), part("vertex", 3).alias("normalized_name"), part("group_min", 3).alias("group_name"))


P5_FOUND = """
WITH RECURSIVE p AS (SELECT DISTINCT coalesce(namespace, '') AS namespace, coalesce(entity_type, '') AS entity_type,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(name_a, '\\([^)]*\\)', '', 'g')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS a,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(name_b, '\\([^)]*\\)', '', 'g')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS b
    FROM similar_pairs WHERE accepted AND name_a IS NOT NULL AND name_b IS NOT NULL),
e AS (SELECT namespace, entity_type, a, b FROM p WHERE a <> b UNION SELECT namespace, entity_type, b, a FROM p WHERE a <> b),
reach(namespace, entity_type, v, u) AS (SELECT namespace, entity_type, a, a FROM e UNION SELECT r.namespace, r.entity_type, r.v, e.b FROM reach r JOIN e ON e.namespace = r.namespace AND e.entity_type = r.entity_type AND e.a = r.u)
SELECT namespace, entity_type, v AS normalized_name, min(u) AS group_name FROM reach GROUP BY namespace, entity_type, v
"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities")
    listed = F.explode(F.from_json(F.col("properties")["aliases"], "array<string>"))
    given = rows.filter(F.col("properties")["aliases"].isNotNull()).select("name", listed.alias("alias"))
    said = variants.response_aliases(table(spark, d, "extraction_raw")).unionByName(given).filter("name IS NOT NULL AND alias IS NOT NULL")
    shorts = spark.createDataFrame(nicknames.short_forms(), "short string, full string")
    return variants.link_variants(rows.select("name"), said, table(spark, d, "norm_dict"), shorts, nicknames.SYNONYMS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings that name the same entity."""
    return variants.variant_pairs(_variants(spark, d))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every known name with its entity and the entity's number of spellings."""
    linked = _variants(spark, d)
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The text that each document's ids stand for, as its digest."""
    return tokens.decode_ids(p8_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


P8_ROUNDTRIP = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, sized in tokens of byte_bpe_50k."""
    return _packed(spark, d).select("doc_id", "piece_no", "token_start", "n_tokens", "container")


def p9_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every document that has a place, with whether its parts follow each other, keep to the capacity and are divided only above it, and its containers hold no more than they can."""
    p = _packed(spark, d)
    full = p.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    each = p.join(full, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count_distinct("piece_no").alias("parts"), F.max("held").alias("held"))
    good = (F.col("n") == F.col("end")) & (F.col("parts") == F.ceil(F.col("n") / packing.CAPACITY)) & (F.col("held") <= packing.CAPACITY)
    return each.select("doc_id", good.alias("good"))


P9_PLACED = "SELECT doc_id, true AS good FROM documents WHERE length(text) > 0"


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_grades"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of English prose at the hardest level."""
    return _levels(spark, d).filter(f"prose AND grade = {reading.GRADES}").select("doc_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document of English prose."""
    return _levels(spark, d).filter("prose").select("doc_id", F.round("level", 3).alias("level"), "grade")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt, "p2_found": p2_found, "p2_batches": p2_batches, "p3_found": p3_found, "p3_records": p3_records, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p5_found": p5_found, "p7_found": p7_found, "p7_entities": p7_entities, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_containers": p9_containers, "p9_fill": p9_fill, "p9_placed": p9_placed, "p10_found": p10_found, "p10_levels": p10_levels}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_rebuilt": P1_REBUILT, "p3_found": P3_FOUND, "p3_records": P3_RECORDS, "p5_found": P5_FOUND, "p8_roundtrip": P8_ROUNDTRIP, "p9_placed": P9_PLACED}
