"""Outside formats on literal documents."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline import plugins
from siftline.functions import scoring as s
from siftline.operators import calibration as cal
from siftline.operators import detection as det
from siftline.operators import graphs as g
from siftline.sources import files, graphml, knowledge, sarif, verdict_json

DOC = {
    "runs": [{
        "tool": {"driver": {"name": "t", "rules": [{"id": "r1", "shortDescription": {"text": "Old"}}, {"id": "r1", "shortDescription": {"text": "New"}, "properties": {"tags": ["security", "external/cwe/cwe-79", "cwe-1"], "precision": "high"}}, {"id": "r2", "defaultConfiguration": {"level": "error"}, "properties": {"cwe": "89"}}]}},
        "results": [
            {"ruleId": "r1", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}, "contextRegion": {"snippet": {"text": "ctx"}}}}], "properties": {"confidence": "0.33"}},
            {"ruleId": "r1", "message": {"text": ""}}, {"ruleId": "r2", "level": "none"}, {"ruleId": "missing", "properties": {"precision": "very-high"}},
        ],
    }]
}


def test_sarif(spark):
    docs = spark.createDataFrame([("d", json.dumps(DOC)), ("bad", "[1"), ("none", "{}")], "doc string, body string")
    got = {r.n: r for r in sarif.scan(docs).collect()}
    assert len(got) == 4
    assert (got[0].cwe_id, got[0].cwe_name, got[0].severity, got[0].confidence, got[0].file_path, got[0].line, got[0].snippet) == ("CWE-79", "New", "low", 0.33, "a.py", 3, "ctx")
    assert (got[1].severity, got[1].confidence, got[1].message, got[1].file_path, got[1].line) == ("medium", 0.85, "New", "", 0)
    assert (got[2].cwe_id, got[2].severity, got[2].confidence) == ("CWE-89", "info", 0.8)
    assert (got[3].cwe_id, got[3].confidence) == ("", 0.95)


def test_a_bad_result_costs_no_other(spark):
    good, odd = DOC["runs"][0]["results"][0], {"ruleId": 7, "locations": "here", "properties": {"confidence": 0.5}, "message": ["m"]}
    run = DOC["runs"][0] | {"results": ["bad", good, 3, None, [good], odd]}
    rows = [("a", json.dumps({"runs": ["none", None, run, {"results": [good]}, {"results": "many"}, {"tool": 4}]})), ("b", json.dumps([DOC])), ("c", '"text"'), ("d", "{"), ("e", None), ("f", ""), ("g", '{"runs": 1}')]
    docs = spark.createDataFrame(rows, "doc string, body string")
    got = {(r.doc, r.run, r.n): r for r in sarif.scan(docs).collect()}
    assert set(got) == {("a", 2, 1), ("a", 2, 5), ("a", 3, 0)}
    assert got["a", 2, 1].cwe_name == "New" and got["a", 3, 0].cwe_name == "" and got["a", 3, 0].tool is None
    assert (got["a", 2, 5].rule_id, got["a", 2, 5].file_path, got["a", 2, 5].line, got["a", 2, 5].confidence, got["a", 2, 5].message) == ("7", "", 0, 0.5, "")
    assert dict(map(tuple, sarif.problems(docs).collect())) == {"b": "no object", "c": "no object", "d": "no JSON", "e": "no JSON", "f": "no JSON"}


@pytest.mark.parametrize("body", ["[]", "3", "{"])
def test_strict_scans_raise(spark, body):
    with pytest.raises(Exception, match="no SARIF object: d"):
        sarif.scan(spark.createDataFrame([("d", body)], "doc string, body string"), strict=True).collect()


def test_sarif_files(spark, tmp_path):
    (tmp_path / "a.sarif").write_text(json.dumps(DOC))
    assert sarif.scan(sarif.read(spark, str(tmp_path))).count() == 4


def test_cwe_xml(spark, tmp_path):
    body = '<Weakness ID="79" Name="XSS"><Description> d </Description><Detection_Methods><Detection_Method><Method>Manual</Method><Description>look</Description></Detection_Method></Detection_Methods><Common_Consequences><Consequence><Scope>Integrity</Scope><Scope>Access</Scope><Impact>Bad</Impact></Consequence></Common_Consequences></Weakness>'
    (tmp_path / "c.xml").write_text(f"<Catalog><Weaknesses>{body}{body.replace('79', '80')}</Weaknesses></Catalog>")
    got = knowledge.read_cwe_xml(spark, str(tmp_path / "c.xml")).orderBy("id").collect()
    assert [r.id for r in got] == ["CWE-79", "CWE-80"]
    assert got[0].description == "d" and got[0].detection_methods == ["Manual: look"] and got[0].consequences == ["Integrity, Access: Bad"] and got[0].mitigations == []


def test_cve_falls_back(spark):
    rows = [{"id": "a", "descriptions": [{"lang": "es", "value": "uno"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 5.0, "baseSeverity": "MEDIUM"}}]}}, {"id": "b", "descriptions": []}]
    got = knowledge.parse_cve(spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")).collect()
    assert [(r.id, r.description, r.score, r.cwe_ids) for r in got] == [("a", "uno", 5.0, [])]


def test_source_files(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\ny", "node_modules/b.js": "z", "src/c.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.source_files(spark, str(tmp_path)).collect()
    assert [(r.language, r.text) for r in got] == [("python", "x = 1\ny")]
    (tmp_path / "w.json").write_text('{"cwe_id": "CWE-1", "sast_weight": 0.5, "gat_weight": 0.2, "llm_weight": 0.3}\n{"cwe_id": "CWE-2"}\n')
    assert [tuple(r) for r in files.read_weights(spark, str(tmp_path / "w.json")).collect()] == [("CWE-1", 0.5, 0.2, 0.3)]


def test_skipped_directories_are_never_opened(spark, tmp_path, monkeypatch):
    from siftline.sources import tree

    names = ["a.py", "__init__.py", "src/b.py", "src/deep/er/c.PY", "src/node_modules/x/d.py", "vendor/e.py", ".git/f.py", "src/g.txt", "src/h.min.js", "src/deep/i.js", "scripts/j.js", "scripts/k.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    seen, entries = [], tree.entries
    monkeypatch.setattr(tree, "entries", lambda system, directory, extensions: (seen.append(directory), entries(system, directory, extensions))[1])
    for tasks in ("1", "2", "100"):
        seen.clear()
        reader = tree.TreeReader({"path": str(tmp_path), "tasks": tasks, "extensions": "py,js"})
        found = [path for part in reader.partitions() for path, _ in reader.read(part)]
        assert sorted(found) == sorted(f"file:{tmp_path}/{n}" for n in names if n.lower().endswith((".py", ".js")) and not {"node_modules", "vendor", ".git"} & set(n.split("/")))
        assert seen and not [d for d in seen if {"node_modules", "vendor", ".git"} & set(d.split("/"))]
    got = {r.file.removeprefix(f"file:{tmp_path}/"): r.text for r in files.source_files(spark, f"file:{tmp_path}").collect()}
    assert got.keys() >= {"a.py", "__init__.py", "src/b.py", "src/deep/i.js", "scripts/k.py"}
    assert not got.keys() & {"src/h.min.js", "scripts/j.js", "src/g.txt", "vendor/e.py"} and got["a.py"] == "a.py\ufffd"
    (tmp_path / "none").mkdir()
    assert files.source_files(spark, str(tmp_path / "none")).count() == 0


def test_weights_of_yaml_and_of_no_file(spark, tmp_path):
    assert files.read_weights(spark, str(tmp_path / "missing.json")).count() == files.read_weights(spark, str(tmp_path / "missing.yaml")).count() == 0
    (tmp_path / "w.yaml").write_text("CWE-1:\n  sast_weight: 0.5\n  gat_weight: 0.2\n  llm_weight: 0.3\nCWE-2: 7\ndefault: {sast_weight: 1, gat_weight: 0, llm_weight: 0}\nCWE-3: {gat_weight: 1}\n")
    (tmp_path / "below.yml").write_text("weights:\n  CWE-9: {sast_weight: 0.25, gat_weight: 0.25}\n")
    (tmp_path / "list.yml").write_text("[1, 2]\n")
    assert sorted(map(tuple, files.read_weights(spark, str(tmp_path / "w.yaml")).collect())) == [("CWE-1", 0.5, 0.2, 0.3), ("default", 1.0, 0.0, 0.0)]
    assert [r.cwe_id for r in files.read_weights(spark, str(tmp_path / "below.yml")).collect()] == ["CWE-9"]
    assert files.read_weights(spark, str(tmp_path / "list.yml")).count() == 0


def test_graphml(spark):
    xml = '<graphml><graph><node id="1"><data key="labelV">CALL</data><data key="CODE">f</data><data key="LINE_NUMBER">4</data></node><node id="2"/><edge source="1" target="2"><data key="labelE">DDG</data></edge></graph></graphml>'
    nodes, edges = graphml.load(spark.createDataFrame([(9, xml)], "graph_id long, xml string"))
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [(9, 1, "CALL", "f", 4), (9, 2, "", "", 0)]
    assert [tuple(r) for r in edges.collect()] == [(9, 1, 2, "DDG")]


def test_verdict_text(spark):
    rows = [(1, '{"exploitable": true, "confidence": 3}'), (2, "```json\n{\"coverage\": -1}\n```"), (3, "sorry"), (4, "")]
    got = {r.id: r for r in verdict_json.parse(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got[1].exploitable and got[1].confidence == 1.0 and got[1].feasible
    assert got[2].coverage == 0.0 and got[2].parsed and not got[3].parsed and got[3].reasoning == "Raw response: sorry"


def test_plugins(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "id long, prompt string")

    def answer(prompt):
        if prompt == "p3":
            raise ValueError(prompt)
        return prompt.upper()

    got = {r.id: r.body for r in plugins.run_stages(prompts, [plugins.verdict_provider(answer)]).collect()}
    assert got[3] == '{"error": "ValueError"}' and got[4] == "P4" and len(got) == 12
    model = plugins.feature_model(lambda f: pd.DataFrame({"klass": (f["a"] > 1).astype(int), "probability": f["a"] / 4, "confidence": f["b"]}), ["a", "b"])
    assert [r.predicted.klass for r in spark.createDataFrame([(1.0, 0.5), (2.0, 0.5)], "a double, b double").transform(model).collect()] == [0, 1]


@pytest.mark.parametrize(("code", "value"), [('password = "hunter22"', "hunter22"), ("api_key: 'abcd1234'", "abcd1234"), ('SECRET = os.environ.get("X") or "fallback1"', "fallback1"), ('password = "aaaa"', None), ('password = "changeme"', None), ("password = get()", None), ('name = "hunter22"', None), ('passwd = "abc"', None)])
def test_hardcoded_secret(spark, code, value):
    got = spark.range(1).select(det.hardcoded_secret(F.lit(code)).alias("x")).first().x
    assert (got.value if got else None) == value


def test_conformal(spark):
    assert cal.conformal_level(10, 0.1) == 1.0 and cal.conformal_level(100, 0.1) == pytest.approx(0.91)
    with pytest.raises(ValueError):
        cal.conformal_level(10, 1.0)
    p = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    sets = lambda t: spark.range(1).select(cal.prediction_set(p, F.lit(t)).alias("x")).first().x
    assert (sets(0.0), sets(0.5), sets(0.51), sets(1.0)) == ([0], [0], [0, 1], [0, 1, 2])
    values = [0.1, 0.1, 0.1, 5.0, 2.0, 2.0, 9.5]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, v double")
    for n in range(7):
        wanted = spark.createDataFrame([("a", n), ("b", 0)], "g string, k long")
        got = {r.g: r.x for r in cal.order_statistics(rows, "g", "v", wanted, bins=2).collect()}
        assert got == {"a": sorted(values)[n], "b": 1.0}


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(1, a, b, "DDG") for a, b in [(1, 2), (2, 3), (3, 1), (5, 6)]] + [(2, 1, 2, "AST")], "graph_id long, src long, dst long, type string")
    nodes = spark.createDataFrame([(1, n) for n in (1, 2, 3, 5, 6, 7)] + [(2, 1), (2, 2)], "graph_id long, node_id long").withColumns({"type": F.lit("CALL"), "line": F.lit(1), "code": F.lit("x")})
    got = {(r.graph_id, r.node_id): r.component for r in g.components(nodes, edges).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 5): 5, (1, 6): 5, (1, 7): 7, (2, 1): 1, (2, 2): 1}
    start = spark.createDataFrame([(1, 1)], "graph_id long, node_id long")
    assert {r.node_id: r.depth for r in g.reach(edges, start, 5).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.node_id for r in g.reach(edges, start, 1).collect()} == {1, 2}


def test_lookup_keeps_unknown(spark):
    assert spark.range(1).select(s.lookup(F.lit("x"), {"a": 1}).alias("x")).first().x is None
