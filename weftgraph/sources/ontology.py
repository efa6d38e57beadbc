"""Entity definitions: Markdown files, checks, prompt text."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "entity_type_id string, name string, description string, relations array<struct<target: string, forward: string, reverse: string>>, examples array<struct<name: string, description: string>>, source_file string"
NOT_DEFINITIONS = {"prompt_template.md", "readme.md"}
_ID = re.compile(r"^#\s*ID\s*:\s*(.+)$", re.I)
_NAME = re.compile(r"^##\s*Name\s*:\s*(.+)$", re.I)
_SECTION = re.compile(r"^##\s*(Description|Relations?|Examples?)\b\s*:?\s*(.*)$", re.I)


def parse_definition(content: str, source_file: str) -> tuple:
    """One definition as a row of SCHEMA; a file without an id takes its stem. Relation lines need exactly three parts."""
    ident, name, section, described = Path(source_file).stem, None, None, []
    relations, examples = [], []
    for line in content.splitlines():
        text = line.strip()
        if m := _ID.match(text):
            ident = m[1].strip().lower()
        elif m := _NAME.match(text):
            name, section = m[1].strip(), None
        elif m := _SECTION.match(text):
            section = m[1].lower()[0]
            if section == "d" and m[2]:
                described.append(m[2])
        elif text.startswith("## "):
            section = None
        elif section == "d":
            described.append(text)
        elif section == "r" and text[:1] in "-*" and text:
            parts = [p.strip() for p in text[1:].split(":")]
            if len(parts) == 3 and all(parts):
                relations.append(tuple(parts))
        elif section == "e" and text.startswith("###"):
            examples.append([text.lstrip("#").strip(), []])
        elif section == "e" and examples:
            examples[-1][1].append(text)
    description = "\n".join(described).strip() or None
    return ident, name, description, relations, [(n, "\n".join(d).strip()) for n, d in examples], source_file


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions of a folder of small Markdown files; of an id that occurs again the later file counts."""
    found = {}
    for path in sorted(Path(folder).glob("*.md")):
        if path.name.lower() not in NOT_DEFINITIONS:
            row = parse_definition(path.read_text(encoding="utf-8"), path.name)
            found[row[0]] = row
    return spark.createDataFrame(list(found.values()), SCHEMA)


def find(definitions: DataFrame, entity_type: str) -> DataFrame:
    """The definition of one type, whatever the case."""
    return definitions.filter(F.col("entity_type_id") == entity_type.lower())


def type_ids(definitions: DataFrame) -> DataFrame:
    return definitions.select("entity_type_id").orderBy("entity_type_id")


def by_type(definitions: DataFrame, types: list[str]) -> DataFrame:
    """Definitions of the types asked for, whatever the case; all if none is known."""
    some = definitions.filter(F.lower("entity_type_id").isin([t.lower() for t in types]))
    return definitions if not types or some.isEmpty() else some


def counts(definitions: DataFrame) -> DataFrame:
    return definitions.select("entity_type_id", F.size("relations").alias("n_relations"), F.size("examples").alias("n_examples"))


def relations(definitions: DataFrame) -> DataFrame:
    return definitions.select("entity_type_id", F.explode("relations").alias("r")).select("entity_type_id", "r.*")


def examples(definitions: DataFrame) -> DataFrame:
    return definitions.select("entity_type_id", F.explode("examples").alias("e")).select("entity_type_id", "e.*")


def lint(definitions: DataFrame) -> DataFrame:
    """(entity_type_id, warning) of every gap, and of relation targets that have no definition."""
    tests = {"missing name": F.coalesce("name", F.lit("")) == "", "missing description": F.coalesce("description", F.lit("")) == "", "no relations": F.coalesce(F.size("relations"), F.lit(0)) <= 0, "no examples": F.coalesce(F.size("examples"), F.lit(0)) <= 0}
    found = F.explode(F.array_compact(F.array(*(F.when(t, F.lit(w)) for w, t in tests.items()))))
    gaps = definitions.select("entity_type_id", found.alias("warning"))
    ids = definitions.select(F.col("entity_type_id").alias("target"))
    unknown = relations(definitions).select("entity_type_id", "target").distinct().join(ids, "target", "left_anti")
    return gaps.unionByName(unknown.select("entity_type_id", F.concat(F.lit("unknown target "), "target").alias("warning")))


def prompt_text(definitions: DataFrame) -> str:
    """The definitions as they stand in a prompt: name, id, description, relations and examples of each (a hand-written table of a few rows)."""
    lines = []
    for r in definitions.orderBy("entity_type_id").collect():
        lines += [f"## {r.name or r.entity_type_id}", f"**ID**: `{r.entity_type_id}`", ""]
        lines += [f"**Description**: {r.description}", ""] if r.description else []
        lines += ["**Relations**:", *(f"- {t}: {f} / {b}" for t, f, b in r.relations), ""] if r.relations else []
        lines += ["**Examples**:", *(f"- **{n}**: {d}" for n, d in r.examples), ""] if r.examples else []
        lines += ["---", ""]
    return "\n".join(lines)


def read_template(folder: str, name: str = "prompt_template.md") -> str:
    """The prompt template beside the definitions."""
    path = Path(folder) / name
    if not path.exists():
        raise FileNotFoundError(f"no template {path}")
    return path.read_text(encoding="utf-8")


def merged_template(template: str, definitions: DataFrame) -> str:
    """The template with the definitions filled in; the text is left open."""
    return template.replace("{{ENTITY_TYPE_DEFINITIONS}}", render(definitions))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, line_no) of a text file of ``KEY : value`` lines: parted at the first colon; blank lines, # comments and lines without key or value are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    parts = F.split(F.trim("line"), r"\s*:\s*", 2)
    rows = lines.filter("NOT trim(line) LIKE '#%' AND instr(line, ':') > 0").select(parts[0].alias("key"), parts[1].alias("value"), (F.col("at") + 1).alias("line_no"))
    return rows.filter("key <> '' AND value <> ''")


def render(definitions: DataFrame) -> str:
    """Prompt text of all definitions (a hand-written table of a few rows)."""
    parts = []
    for r in definitions.orderBy("entity_type_id").collect():
        lines = [f"# ID: {r.entity_type_id}", f"## Name: {r.name or r.entity_type_id}"]
        if r.description:
            lines += ["## Description:", r.description]
        if r.relations:
            lines += ["## Relations:", *(f"- {t} : {f} : {b}" for t, f, b in r.relations)]
        if r.examples:
            lines += ["## Examples:", *(f"### {n}\n{d}" for n, d in r.examples)]
        parts.append("\n".join(lines))
    return "\n\n---\n\n".join(parts)


def export_definitions(entities: DataFrame) -> DataFrame:
    """(entity_type, body): the graph's entities of a type as an example section, by name."""
    names = entities.select("entity_type", "name").distinct()
    named = F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("### "), n)), "\n")
    return names.groupBy("entity_type").agg(F.concat(F.lit("# ID: "), F.first("entity_type"), F.lit("\n## Examples:\n"), named).alias("body"))
