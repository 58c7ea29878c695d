"""Findings, enrichment, profiling, streaming, and the registry of queries."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayloom.dataset import Refusal
from assayloom.operators import enrichment, findings, profile
from assayloom.streaming import incremental

DOC = """---
id: {id}
title: "A claim"
status: {status}
phase: exploratory
integrity_signoff: {signoff}
provenance:
  script: {script}
  data_version: v1
  commit: abc
relationships:
  - {{ type: supports, target: 12, note: "x" }}
figures:
  - png: figures/a.png
    legend_png: figures/a.legend.png
---
{body}
"""
GOOD = "![a](../figures/a.png) <img src='figures/a.legend.png'> see [finding 0031](0031-x.md), finding 0007 is me, in 2024."


def rules(spark, body=GOOD, status="candidate", signoff="false", script="scripts/x.py", id="7", **more):
    p = findings.parsed(spark.createDataFrame([("findings/0007-a.md", DOC.format(body=body, status=status, signoff=signoff, script=script, id=id))], "path string, content string"))
    return {(r["rule"], r["detail"]) for r in findings.violations(p, **more).collect()}


def test_rules(spark):
    assert rules(spark) == set()
    assert {r for r, _ in rules(spark, signoff="true")} == {1} and rules(spark, signoff="true", gate_passed=True) == set()
    assert {r for r, _ in rules(spark, status="validated", script="scratch/x.py", gate_passed=True)} == {2}
    assert rules(spark, body="![l](figures/a.legend.png)") == {(3, "figures/a.png")}
    assert rules(spark, body=GOOD + " ![b](./figures/x/../b.png?raw=1 'title')") == {(4, "figures/b.png")}
    assert rules(spark, body=GOOD + " Finding 0042 and findings #0031.") == {(5, "0042")}
    assert rules(spark, body="![a](figures/a.png)") == {(6, "figures/a.legend.png")}
    assert rules(spark, body=GOOD + " ![k](figures/b.legend.png)") == {(6, "figures/b.legend.png")}
    assert {r for r, _ in rules(spark, structured=True)} == {7}
    assert rules(spark, body="  ") == set()


def test_escapes_and_data_paths(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(findings.relative, "<figures/a%20b+c.png>") == "figures/a b+c.png" and one(findings.relative, "figures/%zz.png") == "figures/%zz.png"
    assert one(findings.relative, "https://x.org/figures/a.png") is None and one(findings.relative, "figures/../a.png") is None
    assert one(findings.under_data, "sub/../data/raw.csv") and not one(findings.under_data, "database/x") and one(findings.under_data, "/project/data")
    assert one(findings.writes_data, "cat x > data/y") and one(findings.writes_data, "rm -rf ./data/x") and not one(findings.writes_data, "cat data/x")
    assert tuple(one(findings.state, "{bad")) == (False, False)


def test_graph_queries(spark):
    p = spark.createDataFrame([(1, "invalidated"), (2, "validated"), (3, "candidate"), (4, "candidate")], "id int, status string")
    e = spark.createDataFrame([(2, "supports", 1), (3, "refines", 2), (4, "relates_to", 1), (3, "contradicts", 4), (4, "supersedes", 9)], "src int, type string, dst int")
    assert {r["id"] for r in findings.cascade(e, p).collect()} == {2}
    assert {r["id"] for r in findings.cascade_closure(e, p).collect()} == {2, 3}
    assert [(r["src"], r["dst"]) for r in findings.dangling(e, p).collect()] == [(4, 9)]
    assert findings.most_connected(e, 1).first()["degree"] == 3
    c = spark.createDataFrame([("candidate", "validated", True), ("under_exploration", "validated", True), ("under_exploration", "validated", False), ("closed", "invalidated", False)], "old string, new string, signoff boolean")
    c = c.withColumns({k: F.lit(True) for k in ("reproduced", "replicated", "data_replicated")}).withColumn("phase", F.lit("exploratory"))
    assert [r["allowed"] for r in findings.transitions(c).collect()] == [False, True, False, True]


def test_accessions(spark):
    raw = {"sp|P05067-2|A4_HUMAN": "P05067", "P05067": "P05067", "A0A024R161;P12345": "A0A024R161", "CON__P00761": None, "": None, "x, Q9H0H5": "Q9H0H5", "tr|A0A024R161|N": "A0A024R161"}
    got = {r["id"]: r["a"] for r in spark.createDataFrame([(k,) for k in raw], "id string").withColumn("a", enrichment.accession(F.col("id"))).collect()}
    assert got == raw
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    audit = enrichment.mapping_audit(ids("P05067", "zzz"), ids("P05067", "sp|P12345|X"))
    assert audit.count() == 3
    with pytest.raises(Refusal):
        enrichment.checked(audit)


def test_over_representation(spark):
    genes = lambda v: spark.createDataFrame([(x,) for x in v], "gene int")
    terms = spark.createDataFrame([("s", "t", g) for g in range(4)] + [("s", "u", 9)], "source string, term string, gene int")
    out = {r["term"]: r for r in enrichment.over_representation(genes([0, 1, 9]), genes(range(10)), terms).collect()}
    assert abs(out["t"]["p_raw"] - 1 / 3) < 1e-12 and out["t"]["gene_ratio"] == 2 / 3 and out["t"]["intersecting_genes"] == "0;1"
    with pytest.raises(Refusal):
        enrichment.over_representation(genes([99]), genes(range(10)), terms)
    body = '{"result":[{"source":"KEGG","native":"K1","name":"k","p_value":0.01,"significant":true,"term_size":200,"query_size":10,"intersection_size":8,"effective_domain_size":999,"intersections":[["IEA"],[],["IEA"]]}],"meta":{"version":"e1"}}'
    r = enrichment.response_table(spark, body, ["a", "b", "c"]).first()
    assert (r["gene_ratio"], r["recall"], r["intersecting_genes"]) == (0.8, 0.04, "a;c")
    with pytest.raises(enrichment.EnrichmentServiceError):
        enrichment.ask(lambda *_: 1 / 0, "u", {})


def test_colors(spark):
    known = spark.createDataFrame([("a", "#1")], "value string, hex string")
    values = spark.createDataFrame([("b", 2), ("a", 0), ("c", 1)], "value string, ord int")
    assert {r["value"]: r["hex"] for r in enrichment.assigned_colors(values, known, ["#1", "#2", "#3"]).collect()} == {"a": "#1", "c": "#2", "b": "#3"}
    with pytest.raises(Refusal):
        enrichment.assigned_colors(values, known, ["#1", "#2"])


def test_concordance(spark):
    rows = [(i, float(i % 2) * 100 + i, i % 2 == 1) for i in range(20)]
    rows[3] = (3, rows[3][1], False)
    out = {r["id"]: r["outcome"] for r in profile.concordance(spark.createDataFrame(rows, "id int, s double, e boolean"), "s", "e").collect()}
    assert out[3] == "flagged" and out[4] == "concordant"


def test_guard_stream(spark, tmp_path):
    spark.createDataFrame([("f/0007.md", DOC.format(body="x", status="candidate", signoff="true", script="s", id="7"))], "path string, content string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, content string").parquet(f"{tmp_path}/in")
    incremental.guard(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r["rule"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1, 3, 6}


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    root = Path(entry.__file__).parent / "assayloom"
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
