"""Checks of records and reports, each with records that break it."""

import pytest
from pyspark.sql import functions as F

from scalarium.operators import detectors, findings, validation
from scalarium.sources import office


def problems(df):
    return sorted((r.ref, r.problem) for r in df.collect())


def test_capabilities(spark):
    rows = [
        (1, "good", "1", "analyzer", "structural", None, "required", "available", None, "x"),
        (1, "parser", "1", "parser", "structural", None, "required", "available", None, "x"),
        (1, "stat", "1", "analyzer", "statistical", None, "optional", "unavailable", "later", None),
        (1, "odd", "", "writer", None, "why", "perhaps", "available", "no", None),
        (1, "unknown", "1", "verifier", "cryptographic", None, "disabled", "unknown", None, None),
    ]
    got = problems(validation.capability_problems(spark.createDataFrame(rows, "source_id int, capability string, revision string, role string, mechanism string, purpose string, participation string, availability string, reason string, implementation string")))
    assert got == sorted([("parser", "capability.mechanism"), ("stat", "capability.purpose"), *(("odd", f"capability.{x}") for x in ("identity", "role", "purpose", "participation", "availability")), ("unknown", "capability.availability")])
    plan = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "source_id int, capability string")
    assert sorted(tuple(r) for r in validation.plan_gaps(plan, plan.distinct().union(spark.createDataFrame([(2, "a")], plan.schema))).collect()) == [(1, "b", "capability.not_declared"), (2, "a", "capability.not_planned")]


def test_executions_and_scopes(spark):
    part = "array<struct<start:int,end:int>>"
    rows = [
        (1, "exec/0", "completed", None, [(0, 9)], [(0, 9)], [], []),
        (1, "exec/1", "completed", "x", [(0, 9)], [(0, 8)], [], []),
        (1, "exec/2", "partial", "limit", [(0, 9)], [(0, 4)], [(4, 9)], ["d"]),
        (1, "exec/3", "partial", "limit", [(0, 9)], [(0, 5)], [(4, 9)], []),
        (1, "exec/4", "failed", "x", [(0, 9)], [], [], []),
        (1, "exec/5", "canceled", "execution.timeout", [(0, 9)], [], [], []),
        (1, "exec/06", "not_run", None, [(0, 9)], [(1, 2)], [], []),
        (1, "exec/7", "done", None, [(3, 3)], [(8, 20)], [], []),
    ]
    got = problems(validation.execution_problems(spark.createDataFrame(rows, f"source_id int, ref string, state string, reason string, requested {part}, analyzed {part}, excluded {part}, diagnostics array<string>")))
    assert got == sorted([
        ("exec/1", "execution.completed_covers_request"), ("exec/3", "execution.overlap"), ("exec/3", "execution.partial_says_what"), ("exec/4", "execution.failed_without_diagnostic"), ("exec/5", "execution.canceled_reason"),
        ("exec/06", "execution.idle_with_scope"), ("exec/06", "execution.reference"), ("exec/7", "execution.exceeds_request"), ("exec/7", "execution.request"), ("exec/7", "execution.state"),
    ])
    scopes = [(1, "a", "artifact/0", "whole_artifact", None), (1, "b", "artifact/0", "byte", [(0, 2), (2, 3)]), (1, "c", "art/0", "line", [(0, 2), (1, 3)]), (1, "d", "artifact/1", "whole_artifact", [(0, 1)])]
    got = problems(validation.scope_problems(spark.createDataFrame(scopes, f"source_id int, ref string, artifact_ref string, unit string, regions {part}")))
    assert got == [("c", "scope.artifact"), ("c", "scope.regions"), ("c", "scope.unit"), ("d", "scope.regions")]


def test_reports(spark):
    texts = spark.createDataFrame([(1, "é​x​"), (2, "plain")], "doc_id long, text string")
    found = validation.ordered(detectors.all_findings(texts).selectExpr("*", "'exec/2' as execution_ref"))
    assert validation.finding_problems(found, texts).count() == 0
    other = spark.createDataFrame([(1, "e​x​")], texts.schema)
    assert ("finding/0", "finding.coordinates") in problems(validation.finding_problems(found, other))
    linked = found.withColumnRenamed("doc_id", "source_id")
    runs = spark.createDataFrame([(1, "exec/2", "analysis", "completed")], "source_id long, ref string, stage string, state string")
    assert validation.linkage_problems(linked, runs).count() == 0
    assert {p for _, p in problems(validation.linkage_problems(linked, runs.selectExpr("source_id", "ref", "stage", "'failed' as state")))} == {"finding.unusable_operation"}
    assert {p for _, p in problems(validation.linkage_problems(linked, runs.limit(0)))} == {"finding.execution"}
    told = findings.summaries(texts, found).withColumnRenamed("doc_id", "source_id")
    status = spark.createDataFrame([(1, "completed"), (2, "failed")], "source_id long, status string")
    assert [(r.source_id, r.problem) for r in validation.summary_problems(told, linked, status).collect()] == [(2, "summary.exit_code")]
    kept = validation.selected(found, "all", "metadata")
    assert kept.count() == 0 and validation.selected(kept, "metadata", "metadata").count() == 0
    with pytest.raises(ValueError):
        validation.selected(kept, "metadata", "unicode")


def test_least_report(spark):
    texts = ["", "a", "é" * 60, "x" * 1234, "€a" * 700 + "\U0001f600"]
    for t in texts:
        offsets = [len(t[:k].encode()) for k in range(len(t) + 1)]
        want = len(t.encode()) + len(",".join(map(str, offsets)))
        size, numbers = validation.least_report(F.col("text"))
        r = spark.createDataFrame([(t,)], "text string").select(size.alias("s"), numbers.alias("n")).first()
        assert (r.s, r.n) == (want, len(offsets))


def test_limits(spark):
    many = spark.range(7)
    got = {(r.limit, r.found, r.most) for r in validation.beyond_limits(many, many, many, {"observations": 6, "links": 7}).collect()}
    assert got == {("observations", 7, 6)}


def test_switches_and_counts():
    w, strict = office.WORD
    read = lambda ns, inner: office.toggle(office._Tree(f"<w:p xmlns:w='{ns}' xmlns:o='o'><w:r>{inner}</w:r></w:p>".encode()), 1, ns, "vanish")
    own = "<w:rPr>{}</w:rPr>".format
    for ns, inner, state in [
        (w, "", "unspecified"), (w, own(""), "unspecified"), (w, own("<w:vanish/>"), "on"), (w, own("<w:vanish w:val='0'/>"), "off"), (w, own("<w:vanish w:val='on'/>"), "on"), (strict, own("<w:vanish w:val='on'/>"), "unknown"),
        (w, own("<w:vanish/><w:vanish/>"), "unknown"), (w, own("<w:vanish/>") * 2, "unknown"), (w, own("<w:vanish o:x='1'/>"), "unknown"), (w, own("<w:vanish>x</w:vanish>"), "unknown"), (w, own("<w:vanish w:val='maybe'/>"), "unknown"), (w, "<w:b><w:rPr><w:vanish/></w:rPr></w:b>", "unspecified"),
    ]:
        assert read(ns, inner) == state, inner
    assert [office.non_negative(x) for x in ("3", " +07\n", "", "+", "-1", "1.0", str(2**64), str(2**64 - 1), "٣")] == [3, 7, None, None, None, None, None, 2**64 - 1, None]
