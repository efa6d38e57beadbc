import pytest

from weftgraph import cli, config
from weftgraph.errors import ConfigurationError


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"namespace": "fromfile", "run": {"max_failures": 7}}')
    env = {"WEFTGRAPH_NAMESPACE": "fromenv", "WEFTGRAPH_RUN__MIN_CONFIDENCE": "0.4", "WEFTGRAPH_RUN__SKIP_PROCESSED": "no", "OTHER": "x"}
    c = config.load({"log_level": "DEBUG", "namespace": None}, str(file), env)
    assert (c.namespace, c.log_level, c.run.max_failures, c.run.min_confidence, c.run.skip_processed) == ("fromfile", "DEBUG", 7, 0.4, False)
    assert config.load({}, None, env).namespace == "fromenv"
    for bad in ({"namespace": "a-b"}, {"log_level": "LOUD"}, {"run": {"min_confidence": 2}}, {"nothing": 1}, {"resolution": {"fuzzy_threshold": -1}}):
        with pytest.raises(ConfigurationError):
            config.load(bad, None, {})


def test_commands(spark, tmp_path):
    root = ["--root", "file://" + str(tmp_path / "g"), "--namespace", "ns1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_1.html").write_text("<title>S:T</title><div id='main-content'>The router box of Alpha</div>", encoding="utf-8")
    spark.createDataFrame([("product", "Router Box"), ("team", "Alpha")], "entity_type string, name string").write.parquet(str(tmp_path / "p"))
    go = lambda *x: cli.run([*root, *x], spark)
    assert go("init") == {"tables": "ready"}
    assert go("parse", str(tmp_path / "in"))["documents"] == 1
    assert go("pipeline", str(tmp_path / "in"), "--phrases", str(tmp_path / "p"))["processed"] == 1
    assert go("list-types")["entity_types"] == ["product", "team"]
    assert go("list-entities", "--type", "team")["entities"] == [{"name": "Alpha", "confidence": 1.0}]
    assert go("list-docs")["documents"][0]["doc_id"] == "1"
    assert [x["name"] for x in go("show-doc", "1")["entities_mentioned"]] == ["Router Box", "Alpha"]
    assert go("related-docs", "team", "alpha")["documents"][0]["doc_id"] == "1"
    assert go("find-related", "team", "alpha")["related_entities"] == []
    assert go("render", "team", "alpha").startswith("<!doctype html>")
    assert go("status")["nodes"] and go("clear")["deleted"] == 3
    assert go("version")["version"]


def test_more_commands(spark, tmp_path):
    root = ["--root", "file://" + str(tmp_path / "g"), "--namespace", "ns1"]
    (tmp_path / "in").mkdir()
    page = tmp_path / "in" / "a_1.html"
    page.write_text("<title>S:T</title><div id='main-content'>The router box of Alpha <a href='https://e.org'>e</a></div>", encoding="utf-8")
    (tmp_path / "defs").mkdir()
    (tmp_path / "defs" / "product.md").write_text("# ID: product\n## Name: Product\n## Description:\nA thing.\n", encoding="utf-8")
    (tmp_path / "defs" / "prompt_template.md").write_text("Types: {{ENTITY_TYPE_DEFINITIONS}} Text: {{TEXT}}", encoding="utf-8")
    phrases = str(tmp_path / "p")
    spark.createDataFrame([("product", "Router Box"), ("team", "Alpha")], "entity_type string, name string").write.parquet(phrases)
    go = lambda *x: cli.run([*root, *x], spark)
    assert go("ingest", str(tmp_path / "in"), "--output-dir", "file://" + str(tmp_path / "md"))["files"] == 1 and (tmp_path / "md" / "1.md").exists()
    shown = go("parse", str(tmp_path / "in"), "--show-content", "--show-links")["shown"][0]
    assert shown["content"].startswith("The router box") and shown["first_links"][0]["url"] == "https://e.org"
    assert [e["name"] for e in go("extract", str(page), "--phrases", phrases, "--format", "json", "-t", "TEAM")["entities"]] == ["Alpha"]
    assert go("extract", str(page), "--phrases", phrases, "--entities-dir", str(tmp_path / "defs")).startswith("product (1):\n  - Router Box")
    defs = str(tmp_path / "defs")
    assert go("entities", "list", defs)["definitions"][0]["entity_type_id"] == "product" and go("entities", "show", defs, "PRODUCT")["name"] == "Product"
    assert go("entities", "show", defs, "none")["known"] == ["product"] and len(go("entities", "validate", defs)["warnings"]) == 2 and len(go("lint", defs)["warnings"]) == 2
    assert "# ID: product" in go("entities", "template", defs) and go("entities", "template", defs, "--output", str(tmp_path / "t.md"))["written"]
    with pytest.raises(ConfigurationError):
        go("pipeline", str(tmp_path / "in"))
    stats = go("pipeline", str(tmp_path / "in"), "--phrases", phrases, "--hooks", "--max-failures", "3", "--types", "product", "--min-confidence", "0.5", "--max-batch-docs", "4")
    assert stats["processed"] == 1 and go("list-types")["entity_types"] == ["product"]
    assert go("query", "SELECT count(*) AS n FROM entities")["rows"] == [{"n": 1}] and "### router box" in go("export-entities")["definitions"][0]["body"]
    assert go("reset")["deleted"] == 2
