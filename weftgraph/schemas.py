"""Schemas of the graph tables."""

PROPERTIES = "map<string,string>"
SCHEMAS = {
    "docs": f"namespace string, doc_id string, source_path string, content_hash string, title string, created_at bigint, updated_at bigint, properties {PROPERTIES}",
    "entities": f"namespace string, entity_type string, normalized_name string, name string, created_at bigint, updated_at bigint, properties {PROPERTIES}",
    "mentions": f"namespace string, doc_id string, entity_type string, normalized_name string, confidence double, created_at bigint, properties {PROPERTIES}",
    "relations": f"namespace string, src_type string, src_norm string, rel_type string, dst_type string, dst_norm string, confidence double, created_at bigint, properties {PROPERTIES}",
    "embeddings": f"namespace string, entity_id string, entity_type string, entity_name string, embedding array<float>, metadata {PROPERTIES}",
}
KEYS = {
    "docs": ["namespace", "doc_id"],
    "entities": ["namespace", "entity_type", "normalized_name"],
    "mentions": ["namespace", "doc_id", "entity_type", "normalized_name"],
    "relations": ["namespace", "src_type", "src_norm", "rel_type", "dst_type", "dst_norm"],
    "embeddings": ["namespace", "entity_id"],
}
