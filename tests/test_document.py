"""The nested report: its parts put together are one JSON document, equal to one made in plain Python."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.operators import audit, document

FIELDS = "n int, cwe string, severity string, title string, impact string, file string, vuln_class string, cvss_score double, cvss_vector string, confidence double, source_ref string, sink_ref string"


def plain(findings):
    rules, results = {}, []
    for f in findings:
        cwe = (f["cwe"] or "").strip() or "CWE-Other"
        rid = cwe.replace("CWE-", "cwe-")
        rules.setdefault(rid, {"id": rid, "name": cwe, "shortDescription": {"text": R.CWE_NAMES.get(cwe, cwe)}, "properties": {"tags": ["security", cwe.lower()], "precision": "medium"}})
        ref = f["source_ref"] or f["file"] or ""
        head, _, tail = ref.rpartition(":")
        uri, line = (head, int(tail)) if tail.isdigit() and head else (ref, 1)
        if "/" not in uri and "\\" not in uri:
            uri = f["file"] or uri
        results.append({
            "ruleId": rid, "level": document.LEVELS.get(f["severity"], "note"), "message": {"text": f"{f['title'] or ''}\n\n{f['impact'] or ''}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": max(1, line)}}}], "partialFingerprints": {"primaryLocationLineHash": f"{uri}:{line}:{f['vuln_class'] or ''}"},
            "properties": {"severity": f["severity"], "cvss": {"score": f["cvss_score"], "vector": f["cvss_vector"]}, "cwe": cwe, "confidence": f["confidence"], "source_ref": f["source_ref"], "sink_ref": f["sink_ref"]},
        })
    run = {"tool": {"driver": {"name": 'a "tool"', "rules": list(rules.values())}}, "invocations": [{"executionSuccessful": True}], "results": results, "properties": {"applicationId": "é", "repositoryName": ""}}
    return {"$schema": document.SCHEMA, "version": "2.1.0", "runs": [run]}


def written(path):
    parts = sorted(Path(path).glob("part-*"))
    return parts, "".join(p.read_text() for p in parts)


def test_parts_are_one_document(spark, tmp_path):
    names = FIELDS.replace(" string", "").replace(" double", "").replace(" int", "").split(", ")
    rows = [(i, ["CWE-79", "CWE-1", " CWE-89 ", "", None][i % 5], ["High", "Low", "Info", None, "odd"][i % 5], f'say "{i}"\n\té', None if i % 3 else "imp\\act", f"src/{i}.java" if i % 4 else None, None if i % 2 else "xss", i / 7 if i % 3 else None, None, 0.5, ["a/b.java:12", "plain:7", "x", "", None, "c:\\d:0"][i % 6], None) for i in range(120)]
    findings = spark.createDataFrame(rows, FIELDS).repartition(5)
    lines = document.report_lines(findings, ["n"], tool='a "tool"', application="é")
    document.write_document(lines, f"{tmp_path}/r", part_lines=20)
    parts, text = written(f"{tmp_path}/r")
    got = json.loads(text)
    assert len(parts) > 3 and got == plain([dict(zip(names, r)) for r in rows])
    assert got["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "cwe-79"
    listed = {r.name: r.bytes for r in document.document_parts(spark, f"{tmp_path}/r").collect()}
    assert listed == {p.name: p.stat().st_size for p in parts}
    docs = spark.createDataFrame([(1, text)], "id int, body string")
    assert audit.violations(docs, "id", "body", audit.REPORT_RULES).count() == 0


def test_no_findings_and_few_columns(spark, tmp_path):
    few = spark.createDataFrame([(1, "CWE-79")], "n int, cwe string")
    document.write_document(document.report_lines(few, ["n"], tool="t"), f"{tmp_path}/a")
    one = json.loads(written(f"{tmp_path}/a")[1])["runs"][0]
    assert len(one["results"]) == 1 and one["results"][0]["properties"]["confidence"] is None
    document.write_document(document.report_lines(few.where(F.lit(False)), ["n"], tool="t"), f"{tmp_path}/b")
    none = json.loads(written(f"{tmp_path}/b")[1])["runs"][0]
    assert none["results"] == [] and none["tool"]["driver"]["rules"] == []
