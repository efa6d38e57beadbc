import json

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import html, ontology

PAGE = """<html><head><title>Harbour desk:Tide tables:June</title></head><body><ol id="breadcrumbs"><li><a href="x">One</a></li><li><a>Two</a></li></ol>
<div id="main-content" class="wiki-content"><h2>Part</h2><p>Some <b>bold</b> text<br>next</p><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><script>no()</script>
<a href="https://e.org">ext</a> <a href="p.html">in</a> <a href="#top">no</a> <a href="p.html#x">no</a></div><a href="https://outside.org">out</a></body></html>"""


def test_parse(spark, tmp_path):
    (tmp_path / "Name_123.html").write_text(PAGE, encoding="utf-8")
    (tmp_path / "plain.html").write_text("<p></p>", encoding="utf-8")
    rows = {r.doc_id: r for r in html.read_pages(spark, str(tmp_path)).collect()}
    r = rows["123"]
    assert r.title == "Tide tables:June" and r.breadcrumb == ["One", "Two"]
    assert "## Part" in r.text and "- a\n  - b" in r.text and "**bold**" in r.text and "no()" not in r.text
    assert [(x.url, x.link_type) for x in r.links] == [("https://e.org", "external"), ("p.html", "internal")]
    assert rows["plain"].text == "" and rows["plain"].title == "Untitled Document"


@pytest.mark.parametrize("heading,title,want", [(None, "Harbour:", "Harbour:"), (None, ":Low water", "Low water"), ("Ebb", "Flood", "Ebb"), (None, " : ", ":"), (None, None, "Untitled Document"), ("A: B", None, "B")])
def test_titles(spark, heading, title, want):
    df = spark.createDataFrame([(heading, title)], "h string, t string")
    assert df.select(html.page_title(F.col("h"), F.col("t")).alias("r")).first().r == want


def test_markdown_export(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "T", "body", ["a", "b"], "f.html", "h")], "doc_id string, title string, text string, breadcrumb array<string>, source_file string, content_hash string")
    body = html.markdown_files(docs).first().body
    assert body.startswith("# T\n\n**Document ID:** d1") and "**Breadcrumb:** a → b" in body and body.endswith("---\n\nbody\n")
    assert [r.file for r in html.write_markdown(docs, "file://" + str(tmp_path / "out")).collect()] == ["d1.md"]
    assert (tmp_path / "out" / "d1.md").read_text(encoding="utf-8") == body
    more = docs.withColumn("metadata", F.create_map(F.lit("title"), F.lit("own"), F.lit('a "b"'), F.lit("c"))).withColumn("parsed_at", F.lit("2025-01-02 03:04:05").cast("timestamp"))
    record = json.loads(html.index_records(more).first().record)
    assert record["doc_id"] == "d1" and record["text"] == "body"
    assert record["metadata"]["title"] == "own" and record["metadata"]['a "b"'] == "c" and record["metadata"]["breadcrumb"] == ["a", "b"] and record["metadata"]["parsed_at"].startswith("2025-01-02T03:04:05")
    assert json.loads(html.index_records(docs).first().record)["metadata"]["title"] == "T"


def test_file_list_and_broken_files(spark, tmp_path):
    (tmp_path / "a_1.html").write_text("<title>x: One</title><div id='main-content'>hello</div>", encoding="utf-8")
    (tmp_path / "b_2.html").write_bytes(b"<title>\xff\xfe</title>")
    rows = {r.doc_id: r for r in html.read_files(spark, [str(tmp_path / "a_1.html"), str(tmp_path / "b_2.html")]).collect()}
    assert rows["1"].problem is None and rows["1"].text == "hello" and rows["1"].parsed_at is not None
    assert rows["2"].problem == "not UTF-8" and rows["2"].text == ""


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("# comment\n\nDB : Data base\nno colon\nQ : a : b\n: x\nDB:Data bank\n", encoding="utf-8")
    rows = [(r.key, r.value, r.line_no) for r in ontology.read_dictionary(spark, str(path)).orderBy("line_no").collect()]
    assert rows == [("DB", "Data base", 3), ("Q", "a : b", 5), ("DB", "Data bank", 7)]


def test_ontology(spark, tmp_path):
    (tmp_path / "product.md").write_text("#  ID  :  Product\n## Name: Product\n## Description:\nA thing.\n## Relations\n- team : owned_by : owns\n- bad : line\n## Examples:\n### X\nfirst\n", encoding="utf-8")
    (tmp_path / "other.md").write_text("## Name:\n", encoding="utf-8")
    (tmp_path / "README.md").write_text("# ID: no", encoding="utf-8")
    defs = ontology.read_definitions(spark, str(tmp_path))
    rows = {r.entity_type_id: r for r in defs.collect()}
    assert set(rows) == {"product", "other"} and len(rows["product"].relations) == 1 and rows["product"].examples[0].description == "first"
    warnings = {(r.entity_type_id, r.warning) for r in ontology.lint(defs).collect()}
    assert ("product", "unknown target team") in warnings and ("other", "no relations") in warnings
    assert ontology.by_type(defs, ["PRODUCT"]).count() == 1 and ontology.by_type(defs, ["zzz"]).count() == 2
    assert "# ID: product" in ontology.render(defs)


TEXT = """# Head & <b>

First line
second **line** with [a](b.html) & 5 < 6

- one
  - nested
- two
1. first
2. second
5. not an item

> quoted

| a | b |
|---|---|
| c | d e |

```python
x = "<a>"

    y && z
```
Last""" + " word" * 20_000


def test_page_markdown_holds_the_text(spark, tmp_path):
    from weftgraph.plans import extract

    rows = [("1", 0, "T", TEXT, [("u.html", "link")]), ("2", 0, None, "only text", None), ("3", 0, "T", None, None)]
    spark.createDataFrame(rows, "doc_id string, batch_no int, title string, text string, links array<struct<url: string, text: string>>").write.parquet(str(tmp_path / "parsed_documents.parquet"))
    got = {r.doc_id: r for r in extract.QUERIES["page_markdown"](spark, str(tmp_path)).collect()}
    text = {k.removeprefix("Page_"): r.text for k, r in got.items()}
    words = lambda s: [w for w in s.replace("|---|---|", "").replace("```python", "python ```").replace("|", " ").split()]
    assert words(text["1"]) == [*words(TEXT), "-", "[link](u.html)"]
    for part in ("# Head & <b>\n", "First line\nsecond", "- one\n  - nested\n- two", "1. first\n2. second", 'x = "<a>"\n\n    y && z\n```', "c | d e |"):
        assert part in text["1"], part
    assert text["2"] == "only text" and text["3"] == "" and len({r.content_hash for r in got.values()}) == 3
    assert {r.title for r in extract.QUERIES["page_titles"](spark, str(tmp_path)).collect()} == {"T"}
