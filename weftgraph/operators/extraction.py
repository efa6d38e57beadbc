"""Model responses to entity and relation rows, and the filters and hooks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_RESERVED = ["type", "entity_type", "type_id", "name", "confidence"]
RELATION_RESERVED = ["from_entity", "to_entity", "type", "relation_type", "confidence"]
MAX_CONTENT = 100_000
#: What a cut text ends with (fixed value).
TRUNCATED = "\n\n[... content truncated ...]"


def response_json(raw: Column) -> Column:
    """The JSON part of a response: the first fenced block, else the widest braces, else the trimmed text."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.trim(F.when(F.trim(fenced) != "", fenced).when(braces != "", braces).otherwise(raw))


def decode(responses: DataFrame) -> DataFrame:
    """``responses`` with ``entities`` and ``relations`` (arrays of JSON objects) and ``problem``.

    problem is null for a readable or blank response (blank has no entities), else 'invalid json', 'not an object', 'no entities' or 'entities not a list'. Nothing raises.
    """
    body = response_json(F.col("raw_response"))
    blank = F.col("raw_response").isNull() | (F.trim("raw_response") == "")
    parsed = responses.withColumn("__body", body).withColumn("__v", F.try_parse_json("__body"))
    kind = F.schema_of_variant("__v")
    inner = F.try_variant_get("__v", "$.entities", "variant")
    problem = (
        F.when(blank, None).when(F.col("__v").isNull(), "invalid json").when(~kind.startswith("OBJECT"), "not an object")
        .when(inner.isNull(), "no entities").when(~F.schema_of_variant(inner).startswith("ARRAY"), "entities not a list")
    )
    listed = lambda what: F.from_json(F.get_json_object("__body", f"$.{what}"), "array<string>")
    out = parsed.withColumn("problem", problem)
    good = F.col("problem").isNull() & ~blank
    return out.withColumn("entities", F.when(good, listed("entities"))).withColumn("relations", F.when(good, listed("relations"))).drop("__v", "__body")


def _text(item: str, key: str) -> Column:
    return F.get_json_object(item, f"$.{key}")


def _first_filled(*cs: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in cs))


def _confidence(item: str) -> Column:
    """The number given, 1.0 where none is; null where what is given is no number."""
    given = _text(item, "confidence")
    return F.when(given.isNull(), F.lit(1.0)).otherwise(F.expr(f"try_cast(get_json_object({item}, '$.confidence') as double)"))


def residual(item: str, reserved: list[str]) -> Column:
    """The object's other keys, values as JSON text (strings plain)."""
    return F.map_filter(F.from_json(item, "map<string,string>"), lambda k, _: ~k.isin(reserved))


def entity_rows(decoded: DataFrame) -> DataFrame:
    """Valid entities: (doc_id, idx, entity_type, name, confidence, properties); idx is the position in the raw array."""
    each = decoded.select("doc_id", F.posexplode("entities").alias("idx", "item")).filter("item LIKE '{%'")
    rows = each.select("doc_id", "idx", _first_filled(_text("item", "type"), _text("item", "entity_type"), _text("item", "type_id")).alias("entity_type"), _text("item", "name").alias("name"), _confidence("item").alias("confidence"), residual("item", ENTITY_RESERVED).alias("properties"))
    return rows.filter("entity_type IS NOT NULL AND name <> '' AND confidence BETWEEN 0 AND 1")


def relation_rows(decoded: DataFrame) -> DataFrame:
    """Valid relations: (doc_id, rel_pos, from_index, to_index, relation_type, confidence, properties); indices lie in the raw entity array."""
    each = decoded.select("doc_id", F.size("entities").alias("n"), F.posexplode("relations").alias("rel_pos", "item")).filter("item LIKE '{%'")
    index = lambda key: F.expr(f"try_cast(get_json_object(item, '$.{key}') as int)")
    rows = each.select("doc_id", "rel_pos", "n", index("from_entity").alias("from_index"), index("to_entity").alias("to_index"), F.upper(_first_filled(_text("item", "relation_type"), _text("item", "type"))).alias("relation_type"), _confidence("item").alias("confidence"), residual("item", RELATION_RESERVED).alias("properties"))
    return rows.filter("relation_type IS NOT NULL AND confidence BETWEEN 0 AND 1 AND from_index >= 0 AND from_index < n AND to_index >= 0 AND to_index < n").drop("n")


def min_confidence(entities: DataFrame, threshold: float) -> DataFrame:
    """Entities at the threshold; idx stays, so relations to dropped ones find no end."""
    return entities if threshold <= 0 else entities.filter(F.col("confidence") >= threshold)


def of_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Case-insensitive type filter; an empty list keeps all."""
    return entities if not types else entities.filter(F.lower("entity_type").isin([t.lower() for t in types]))


def resolve_indices(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with both ends' type and name; a relation whose end isn't among ``entities`` (one row a doc_id and idx) is dropped."""
    ends = entities.select("doc_id", "idx", "entity_type", "name")
    src = ends.select("doc_id", F.col("idx").alias("from_index"), F.col("entity_type").alias("src_type"), F.col("name").alias("src_name"))
    dst = ends.select("doc_id", F.col("idx").alias("to_index"), F.col("entity_type").alias("dst_type"), F.col("name").alias("dst_name"))
    return relations.join(src, ["doc_id", "from_index"]).join(dst, ["doc_id", "to_index"])


def filter_by_confidence(entities: DataFrame, relations: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Entities at the threshold, and no relations: their indices are those of the unfiltered list."""
    return entities.filter(F.col("confidence") >= threshold), relations.limit(0)


def entities_of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    """Entities of exactly this type, case included."""
    return entities.filter(F.col("entity_type") == entity_type)


def unique_types(entities: DataFrame) -> DataFrame:
    """(doc_id, types): the sorted types of each result."""
    return entities.groupBy("doc_id").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))


def type_summary(entities: DataFrame) -> DataFrame:
    """(entity_type, n, n_names)."""
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


def alias_lists(entities: DataFrame) -> DataFrame:
    """(entity_type, name, aliases): the aliases a response gives with an entity, sorted, joined by |."""
    each = entities.filter(F.col("properties")["aliases"].isNotNull()).select("entity_type", "name", F.explode(F.from_json(F.col("properties")["aliases"], "array<string>")).alias("alias"))
    return each.groupBy("entity_type", "name").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))


def token_totals(responses: DataFrame) -> DataFrame:
    """Tokens and responses per model."""
    return responses.groupBy("model_name").agg(F.sum("tokens_used").alias("tokens"), F.count("*").alias("n"))


def result_json(entities: DataFrame, responses: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, body): each result as JSON, its entities in order with their properties beside type, name and confidence; ``files`` is (doc_id, file)."""
    item = F.to_json(F.map_concat(F.create_map(F.lit("type"), F.col("entity_type"), F.lit("name"), F.col("name"), F.lit("confidence"), F.col("confidence").cast("string")), F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))))
    listed = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))).alias("items"))
    rows = responses.select("doc_id", "model_name", "tokens_used", "extraction_time", "success").join(files, "doc_id", "left").join(listed, "doc_id", "left")
    body = F.concat(
        F.lit('{"file":'), F.coalesce(F.to_json(F.array("file")), F.lit("[null]")), F.lit(',"model":'), F.to_json(F.array("model_name")), F.lit(',"entities":['), F.coalesce(F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("")),
        F.lit('],"metadata":'), F.to_json(F.struct(F.coalesce(F.size("items"), F.lit(0)).alias("entity_count"), "extraction_time", "tokens_used", "success")), F.lit("}"),
    )
    return rows.select("doc_id", F.regexp_replace(body, r'^\{"file":\[(.*?)\],"model":\[(.*?)\],', r'{"file":$1,"model":$2,').alias("body"))


def result_text(entities: DataFrame) -> DataFrame:
    """(doc_id, entity_type, body): each result's entities of a type as lines, confidences below 1 shown."""
    shown = F.concat(F.lit("  - "), F.col("name"), F.when(F.col("confidence") < 1, F.format_string(" (confidence: %.2f)", F.col("confidence"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", shown.alias("line")))), lambda x: x["line"])
    return entities.groupBy("doc_id", "entity_type").agg(F.concat(F.first("entity_type"), F.lit(" ("), F.count("*").cast("string"), F.lit("):\n"), F.array_join(lines, "\n")).alias("body"))


def prompt(template: str, definitions: str, text: Column, most: int = MAX_CONTENT) -> Column:
    """The template with both placeholders filled; texts above ``most`` characters are cut with a marker, as the model's input is bounded."""
    body = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)
    return F.replace(F.replace(F.lit(template), F.lit("{{ENTITY_TYPE_DEFINITIONS}}"), F.lit(definitions)), F.lit("{{TEXT}}"), body)


def grouped(entities: DataFrame) -> DataFrame:
    """One row a type with its entities in order, for text output."""
    rows = F.array_sort(F.collect_list(F.struct("name", "confidence")))
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), rows.alias("entities"))
