"""Decoding, packages, identity, reveal, evidence, profiles, corpus and stream."""

import io
import itertools
import json
import os
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scalarium.functions import identity
from scalarium.operators import evidence, packaging, profiles, reveal
from scalarium.plans import corpus
from scalarium.sources import decode, imports, office, packages, sinks, workspace
from scalarium.streaming import corpus as stream


def test_decoding_finds_where_it_fails(spark):
    rows = [("a.txt", b"ok"), ("b.txt", b"a\xc3("), ("c.txt", b"\xff\xfea\x00"), ("d.txt", b"\xff\xfe\x00\x00a\x00\x00\x00"), ("e.txt", b"\xef\xbb\xbfx"), ("f.bin", b"\x00\x01\x02abc"), ("g.pdf", b" \n%PDF-1.7"), ("h.txt", b"a\xe2\x82"), ("i.html", b"<!DOCTYPE html><p>"), ("j.png", b"\x89PNG\r\n\x1a\n")]
    got = {r.path: r for r in decode.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"].text == "ok" and got["a.txt"].failure_code is None
    assert (got["b.txt"].failure.start, got["b.txt"].failure.end, got["b.txt"].failure.reason) == (1, 2, "invalid continuation byte")
    assert got["c.txt"].text == "﻿a" and got["c.txt"].encoding == "utf-16-le"
    assert got["d.txt"].text == "﻿a" and got["d.txt"].encoding == "utf-32-le"
    assert got["e.txt"].bom == "efbbbf" and got["e.txt"].text == "﻿x"
    assert got["f.bin"].format == "binary" and got["g.pdf"].format == "pdf" and got["j.png"].format == "binary"
    assert got["h.txt"].failure.reason == "unexpected end of data" and got["i.html"].mime == "text/html"


def test_discovery_and_reading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_hidden.txt").write_text("h")
    (tmp_path / "sub" / "a[1].txt").write_text("abc")
    os.symlink(tmp_path / "_hidden.txt", tmp_path / "link")
    rows = [tuple(r)[:4] for r in workspace.discovered(spark, str(tmp_path)).collect()]
    assert rows == [("_hidden.txt", "file", "candidate", None), ("link", "symlink", "skipped", "symlink_not_followed"), ("sub/a[1].txt", "file", "candidate", None)]
    flat = workspace.discovered(spark, str(tmp_path), recursive=False)
    assert ("sub", "directory", "skipped", "recursion_disabled") in [tuple(r)[:4] for r in flat.collect()]
    assert {r.path: bytes(r.content) for r in workspace.contents(workspace.discovered(spark, str(tmp_path)), str(tmp_path)).collect()} == {"_hidden.txt": b"h", "sub/a[1].txt": b"abc"}


def test_acquisition_charges_only_what_is_read(spark):
    df = spark.sql("select array(named_struct('path', 'a', 'size', 50L), named_struct('path', 'b', 'size', 200L), named_struct('path', 'c', 'size', 30L), named_struct('path', 'd', 'size', 40L)) as f")
    assert [r.state for r in df.select(workspace.acquisition(F.col("f"), 100).alias("o")).first().o] == ["read", "execution.resource_limit", "read", "execution.resource_limit"]


def _zip(files, **how):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data, **how)
    return buffer.getvalue()


def test_packages_refuse_what_is_odd():
    good = _zip({"b/x.xml": "<a/>", "a.txt": "hello" * 50})
    assert [r[0] for r in packages.read_package(good)] == ["a.txt", "b/x.xml"]
    for data, code in [(b"x" + good, "package.prefix"), (good[:-5], "package.invalid"), (_zip({"../x": "1"}), "package.name"), (_zip({"a": "1", "a/b": "2"}), "package.name_collision"), (good[:30] + bytes([good[30] ^ 1]) + good[31:], "package.")]:
        with pytest.raises(packages.PackageError, match=code):
            packages.read_package(data)


def test_xml_tokens_and_refusals():
    tokens = packages.read_xml(b"<a xmlns='u' k='v'>x&amp;y<b/>z</a>")
    assert [(t[0], t[3], t[4], t[6]) for t in tokens] == [("element", "u", "a", None), ("text", None, None, "x&y"), ("element", "u", "b", None), ("text", None, None, "z")]
    assert tokens[2][2] == 0 and tokens[2][7] == 26
    for data, code in [(b"<!DOCTYPE a><a/>", "xml.unsupported"), (b"<a>", "xml.invalid"), (b"<a/><b/>", "xml.invalid"), (b"<a>" * 200 + b"</a>" * 200, "xml.resource_limit")]:
        with pytest.raises(packages.PackageError, match=code):
            packages.read_xml(data)


def test_word_and_odt_scopes():
    w = next(iter(office.WORD))
    body = "<w:p><w:r><w:t>one</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>two</w:t></w:r><w:r><w:tab/><w:t>three</w:t></w:r></w:p><w:p><w:ins><w:r><w:t>four</w:t></w:r></w:ins><w:del><w:r><w:delText>five</w:delText></w:r></w:del></w:p>"
    rows = office.word_scopes(f"<w:document xmlns:w='{w}'><w:body>{body}</w:body></w:document>".encode())
    assert [(r[1], r[3], r[4]) for r in rows] == [("text", "onetwo", True), ("text", "three", False), ("text", "four", False), ("deleted_text", "five", False)]
    odt = f"<o:document-content xmlns:o='{office.ODF_OFFICE}' xmlns:t='{office.ODF_TEXT}'><o:body><o:text><t:p>a<t:s t:c='3'/>b<t:tab/>c<t:line-break/></t:p><t:p><t:span>d</t:span><t:s t:c='x'/>e</t:p></o:text></o:body></o:document-content>"
    assert [r[3] for r in office.odt_scopes(odt.encode())] == ["a   b\tc\n", "d", "e"]
    core = f"<c:coreProperties xmlns:c='{office.CORE}' xmlns:d='{office.DC}'><d:creator>A</d:creator><d:creator>B</d:creator><c:revision>2</c:revision></c:coreProperties>"
    assert office.metadata_properties(core.encode()) == [("core", "creator", "A", 0), ("core", "creator", "B", 1), ("core", "revision", "2", 0)]


def test_targets(spark):
    cases = {("word/document.xml", "media/a.png"): "word/media/a.png", ("word/document.xml", "../media/a.png"): "media/a.png", ("", "/x/./y"): "x/y", ("a/b", "../../c"): None, ("a/b", "c//d"): None, ("a/b", "c%20"): None, ("a/b", ""): None, ("a/b", "c/.."): None}
    df = spark.createDataFrame([(s, t) for s, t in cases], "s string, t string")
    got = {(r.s, r.t): r.o.part for r in df.select("s", "t", packaging.internal_target(F.col("s"), F.col("t")).alias("o")).collect()}
    assert got == cases
    owners = spark.createDataFrame([("_rels/.rels",), ("word/_rels/document.xml.rels",), ("_rels/x.xml.rels",), ("word/x.xml",)], "n string").select("n", packaging.owner(F.col("n")).alias("o")).collect()
    assert {r.n: r.o for r in owners} == {"_rels/.rels": "", "word/_rels/document.xml.rels": "word/document.xml", "_rels/x.xml.rels": "x.xml", "word/x.xml": None}


def test_canonical_json():
    assert identity.canonical('{"b":1,"a":[1.0,1e21,1e-7,0.1,-0,123456789012345680000,5e-324]}') == '{"a":[1,1e+21,1e-7,0.1,0,123456789012345680000,5e-324],"b":1}'
    assert identity.canonical('{"\\ue000":1,"\\ud83d\\ude00":2}') == '{"\U0001f600":2,"":1}'
    assert identity.digest("test/1", '{"\\ue000":1,"\\ud83d\\ude00":2}') == "e1db2081828d9ec6b14b700bae85c70b3271851225e00d83939476f850d355ec"
    assert identity.digest("test/1", '{"text":"\\u0000\\t\\n\\\\\\"/"}') == "a42cf7f4793bbe7c2bf84b3c94f4ef84471e03ae35439a45d1a824102f020acb"
    for bad in ['{"a":1,"a":2}', '"\\ud800"', "NaN", "1 2"]:
        with pytest.raises(ValueError):
            identity.canonical(bad)
    assert identity.selection("aé😀", [(0, 2)]) != identity.selection("aé😀", [(0, 1)])
    with pytest.raises(ValueError):
        identity.selection("abc", [(0, 2), (1, 3)])


def test_reveal_and_hunks(spark):
    df = spark.createDataFrame([(1, "a​⟦b"), (2, "plain")], "doc_id long, text string")
    assert {r.doc_id: r.rendered for r in reveal.revealed(df).collect()} == {1: "a⟦U+200B ZERO WIDTH SPACE⟧⟦⟦b", 2: "plain"}
    rows = sorted(tuple(r) for r in reveal.occurrences(df).collect())
    assert rows == [(1, 1, "finding", "U+200B", 1, 4, 1, 30, []), (1, 2, "literal_marker_escape", "U+27E6", 4, 7, 30, 36, [])]
    lines = [str(k) for k in range(30)]
    other = [*lines]
    other[2], other[8], other[25] = "x", "y", "z"
    pairs = spark.createDataFrame([(1, "\n".join(lines), "\n".join(other)), (2, "a\nb", "a"), (3, "s", "s")], "doc_id long, before string, after string")
    assert sorted(tuple(r) for r in reveal.hunks(pairs).collect()) == [(1, 1, 12, 2), (1, 23, 29, 1), (2, 1, 2, 2)]


def test_reveal_marks_what_findings_about_characters_mark(spark):
    """Emoji and keycaps too, other controls and format characters by an escape, and places that other findings point at."""
    from scalarium.operators import detectors, findings

    rows = [(1, "hi \U0001f469 ok", "utf-8"), (2, "12️⃣ 3 #⃣", "utf-8"), (3, "a\u0600b\x07\tc\r\n", "utf-8"), (4, "п: author: x\n", "utf-16-le"), (5, "", "utf-8"), (6, "⟦⟧", "utf-8")]
    df = spark.createDataFrame(rows, "doc_id long, text string, encoding string")
    got = {r.doc_id: r.rendered for r in reveal.revealed(df).collect()}
    keycap = "⟦U+FE0F VARIATION SELECTOR-16⟧⟦U+20E3 COMBINING ENCLOSING KEYCAP⟧"
    assert got == {
        1: "hi ⟦U+1F469 WOMAN⟧ ok",
        2: f"1⟦U+0032 DIGIT TWO⟧{keycap} 3 ⟦U+0023 NUMBER SIGN⟧⟦U+20E3 COMBINING ENCLOSING KEYCAP⟧",
        3: "a⟦U+0600 ARABIC NUMBER SIGN⟧b⟦U+0007 UNNAMED CONTROL⟧\tc\r\n",
        4: "п: author: x\n", 5: "", 6: "⟦⟦⟧",
    }
    found = findings.ordered_ranks(detectors.all_findings(df))
    told = reveal.occurrences(df, found).collect()
    marked = {(r.doc_id, p) for r in found.filter("id like 'unicode.%'").collect() for p in r.positions}
    assert {(r.doc_id, r.pos) for r in told if r.reason == "finding"} == marked
    other = next(r for r in told if r.doc_id == 4)
    assert (other.pos, other.reason, other.source_start, other.source_end, other.rendered_start, other.rendered_end) == (3, "finding_reference", 6, 8, 4, 5)
    assert [f.id for f in other.findings] == ["provenance.text_marker"]
    for r in told:
        piece = got[r.doc_id].encode()[r.rendered_start : r.rendered_end].decode()
        assert piece == (dict((i, t) for i, t, _ in rows)[r.doc_id][r.pos] if r.reason == "finding_reference" else "⟦⟦" if r.reason == "literal_marker_escape" else piece) and (r.code_point in piece or r.reason in ("finding_reference", "literal_marker_escape"))


def test_regions_meet_at_seven_lines(spark):
    def changed(*at):
        lines = [str(k) for k in range(40)]
        return "\n".join(lines) + "\n", "\n".join("x" if k in at else x for k, x in enumerate(lines)) + "\n"

    pairs = spark.createDataFrame([(1, *changed(5, 12)), (2, *changed(5, 13)), (3, *changed(39)), (4, "", "a\n")], "doc_id long, before string, after string")
    assert sorted(tuple(r) for r in reveal.hunks(pairs).collect()) == [(1, 3, 16, 2), (2, 3, 9, 1), (2, 11, 17, 1), (3, 37, 40, 1), (4, 1, 1, 1)]


def test_evidence_checks(spark):
    regions = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 20, 30)], "source_id long, start long, end long")
    assert sorted(tuple(r) for r in evidence.merged_regions(regions).collect()) == [(1, 0, 9), (1, 20, 30)]
    spans = spark.createDataFrame([(1, 3, 8), (1, 8, 10), (2, 0, 1), (1, 20, 30)], "source_id long, start long, end long")
    assert sorted(tuple(r) for r in evidence.outside(spans, regions).collect()) == [(1, 8, 10), (2, 0, 1)]
    assert [r.source_id for r in evidence.coverage_gaps(regions, spans).collect()] == [1, 2] or sorted(r.source_id for r in evidence.coverage_gaps(regions, spans).collect()) == [1, 2]
    groups = spark.range(1).select(evidence.span_groups(F.array(*(F.lit(x).cast("long") for x in (10, 10, 5, 30, 1, 1, 1))), 3, 25).alias("g")).first().g
    assert groups == [0, 0, 0, 1, 2, 2, 2]
    many = spark.range(40_000).select(F.lit(1).alias("source_id"), F.lit("r").alias("ref"), F.col("id").alias("pos"))
    assert sorted((r.start, r.end) for r in evidence.spans(many).collect()) == [(0, 16384), (16384, 32768), (32768, 40000)]


def test_status_precedence(spark):
    rows = [(1, "parser", "failed", True, False), (2, "analysis", "partial", True, False), (3, "analysis", "canceled", False, False), (4, "analysis", "incomplete", True, False), (5, "analysis", "disabled", False, False), (5, "analysis", "completed", True, False), (6, "analysis", "failed", False, False)]
    got = {r.source_id: r.status for r in evidence.status(spark.createDataFrame(rows, "source_id long, stage string, state string, usable boolean, optional boolean")).collect()}
    assert got == {1: "failed", 2: "partial", 3: "canceled", 4: "partial", 5: "completed", 6: "failed"}


def test_profiles(spark):
    rules = spark.createDataFrame([(1, "k", "expected", None), (2, "k", "noteworthy", "retain"), (3, "k", "suspicious", None)], "rule_id int, kind string, assessment string, queue string")
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "z")], "rule_id int, fact string")
    obs = spark.createDataFrame([(1, 1, "k", "main", True), (2, 1, "k", "main", True), (3, 1, "other", "main", True), (4, 1, "k", "main", False), (5, 1, "k", "else", True), (6, 2, "k", "main", True)], "observation_id int, artifact_id int, kind string, scope string, complete boolean")
    has = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a"), (6, "a")], "observation_id int, fact string")
    signals = spark.createDataFrame([(9, 2, True)], "signal_id int, artifact_id int, mapping_complete boolean")
    targets = spark.createDataFrame([(9, 6)], "signal_id int, observation_id int")
    got = {r.observation_id: (r.assessment, r.reason, r.omit_default) for r in profiles.assessments("main", rules, facts, obs, has, signals, targets).collect()}
    assert got == {1: ("expected", "rules_matched", True), 2: ("noteworthy", "rules_matched", False), 3: ("unknown", "no_matching_rule", False), 4: ("unknown", "coverage_or_mapping_incomplete", False), 5: ("unknown", "profile_scope_mismatch", False), 6: ("suspicious", "pattern_override", False)}
    # a mapped signal makes an observation of another scope suspicious; the reason stays that of the scope
    more = targets.unionByName(spark.createDataFrame([(10, 5)], "signal_id int, observation_id int"))
    got = {r.observation_id: tuple(r)[1:] for r in profiles.assessments("main", rules, facts, obs.withColumn("exact", F.col("observation_id") != 1), has, signals.unionByName(spark.createDataFrame([(10, 1, False)], signals.schema)), more).collect()}
    assert got[5] == ("suspicious", "profile_scope_mismatch", False) and got[1] == ("unknown", "unmapped_pattern_requires_review", False)
    got = {r.observation_id: tuple(r)[1:] for r in profiles.assessments("main", rules, facts, obs.withColumn("exact", F.col("observation_id") != 1), has, signals, targets).collect()}
    assert got[1] == ("unknown", "coverage_or_mapping_incomplete", False)


def test_manifest_membership(spark):
    parts = spark.createDataFrame([(1, "mimetype"), (1, "content.xml"), (1, "Pictures/a.png"), (1, "extra.xml")], "source_id long, name string")
    manifest = spark.createDataFrame([(1, "/"), (1, "content.xml"), (1, "Pictures/"), (1, "gone.xml"), (1, "Empty/")], "source_id long, path string")
    got = {r.path: r.state for r in packaging.manifest_membership(manifest, parts).collect()}
    assert got == {"/": "package", "content.xml": "resolved", "Pictures/": "directory", "gone.xml": "missing", "Empty/": "missing", "mimetype": "manifest_exempt", "extra.xml": "unlisted", "Pictures/a.png": "unlisted"}


def test_imports(spark):
    rows = [("a", b'{"schema_version":"1.0","findings":[{}]}'), ("b", b'{"schema_version":"9"}'), ("c", b'{"a":1,"a":2}'), ("d", b"\xff")]
    got = {r.path: (r.mode, r.findings) for r in imports.imported(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": ("legacy", 1), "b": ("inert", 0), "c": ("inert", 0), "d": ("inert", 0)}


def test_bundle(tmp_path):
    told = sinks.write_bundle(str(tmp_path / "b"), {"x.txt": b"1"})
    assert json.loads((tmp_path / "b" / "manifest.json").read_text()) == told
    with pytest.raises(ValueError):
        sinks.write_bundle(str(tmp_path / "c"), {"../x": b""})
    with pytest.raises(FileExistsError):
        sinks.write_bundle(str(tmp_path / "b"), {"y": b""})


def test_corpus_and_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, "x​"), (2, "plain"), (3, "y\x07")], "doc_id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    rows = stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.doc_id: (r.state, r.exit_code) for r in rows.collect()} == {1: ("requires_review", 1), 2: ("no_reported_findings", 0), 3: ("requires_review", 2)}
    assert stream.completed(spark, str(tmp_path / "out"))
    stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/entries")).count() == 3
    summary = corpus.summary(rows).first()
    assert (summary.state, summary.entries, summary.exit_code) == ("completed", 3, 2)
    lines = corpus.records(rows.drop("batch")).orderBy("part", "_key").collect()
    assert json.loads(lines[0].line)["type"] == "header" and json.loads(lines[-1].line)["type"] == "summary"


def test_unified_diffs(spark):
    import difflib

    from scalarium.operators import diffs

    lines = [f"line {k}" for k in range(20)]
    other = [*lines]
    other[3], other[4], other[15] = "x", "y", "z"
    rows = [(1, "\n".join(lines) + "\n", "\n".join(other) + "\n"), (2, "same", "same"), (3, "a\nb\n", "a\nc"), (4, "a", "a\nb\n")]
    got = {r.doc_id: r.diff for r in diffs.unified(spark.createDataFrame(rows, "doc_id long, before string, after string"), ("source", "revealed")).collect()}
    want = "".join(difflib.unified_diff([x + "\n" for x in lines], [x + "\n" for x in other], "source", "revealed"))
    assert got[1].replace("\t", "") == want.replace("\t", "") and got[2] == ""
    assert got[3].endswith("-b\n+c\n\\ No newline at end of file\n")
    assert got[4].startswith("--- source\n+++ revealed\n@@ -1,1 +1,2 @@\n-a\n\\ No newline at end of file\n+a\n+b\n")


def test_evidence_graph_of_an_audit(spark):
    from scalarium.operators import assembly, detectors
    from scalarium.operators import findings as found_in

    rows = [(1, "a​​ b​", None), (2, None, "text.decode_failed"), (3, None, "file.too_large")]
    parsed = spark.createDataFrame(rows, "doc_id long, text string, failure_code string")
    texts = parsed.filter("failure_code is null")
    found = found_in.ordered_ranks(detectors.unicode_kinds(texts))
    run, made, spans = assembly.executions(parsed), assembly.artifacts(parsed), assembly.anchors(found)
    state = {(r.source_id, r.capability): r.state for r in run.collect()}
    assert state[1, "analyze.unicode"] == "completed" and state[2, "parse.text"] == "failed" and state[2, "analyze.text"] == "not_run" and state[3, "acquire.file"] == "failed" and state[3, "parse.text"] == "not_run" and state[1, "verify.provenance"] == "disabled"
    assert sorted((r.source_id, r.start, r.end) for r in spans.collect()) == [(1, 1, 3), (1, 5, 6)]
    assert {r.capability: r.findings for r in assembly.results(run, found).collect()}["analyze.unicode"] == 1
    assert assembly.problems(run, made, spans, texts).count() == 0
    assert {r.source_id: r.status for r in evidence.status(run).collect()} == {1: "completed", 2: "failed", 3: "failed"}


def test_registry(spark):
    from scalarium.functions.registry import Registry, RegistryError

    one = json.dumps({"id": "p", "version": "1", "scope": "main", "rules": [{"id": "r", "revision": 1, "kind": "k", "assessment": "expected", "facts": ["a"]}]})
    registry = Registry()
    assert registry.register(one) == registry.register(one)
    for bad, why in [(one.replace("main", "x"), "changed"), (one.replace('"1"', '"2"').replace("expected", "unknown"), "conflict"), ("{}", "schema"), (one.replace("expected", "odd").replace('"1"', '"3"'), "schema")]:
        with pytest.raises(RegistryError, match=why):
            registry.register(bad)
    scope, rules, facts = registry.tables(spark, "p", "1")
    assert scope == "main" and rules.count() == 1 and facts.first().fact == "a"


def test_scalar_maps():
    data = "<a>x&amp;é&#x41;\r\nz\r<!-- c --><![CDATA[<&]]>😀<b/>w</a>".encode()
    found = [t for t in packages.read_xml(data) if t[0] == "text"]
    rows = packages.scalar_map(data, found[0][7], found[0][6])
    assert "".join(c for c, *_ in rows) == "x&éA\nz\n<&😀" == found[0][6]
    assert [data[a:b] for _, a, b, _ in rows] == [b"x", b"&amp;", "é".encode(), b"&#x41;", b"\r\n", b"z", b"\r", b"<", b"&", "😀".encode()]
    assert [how for *_, how in rows][1:7] == ["entity_reference", "literal", "character_reference", "line_ending", "literal", "line_ending"]


def test_reports(spark):
    from scalarium.operators import detectors
    from scalarium.plans import reports
    from scalarium.sources.imports import checked

    parsed = spark.createDataFrame([(1, "é​\x07", None), (2, "x", None), (3, None, "file.too_large")], "doc_id long, text string, failure_code string")
    found = detectors.all_findings(parsed.filter("failure_code is null"))
    got = {r.doc_id: (r.exit_code, json.loads(r.report), r.sha256, r.report) for r in reports.reports(parsed, found).collect()}
    assert [f["id"] for f in got[1][1]["findings"]] == ["unicode.control", "unicode.zero_width"] and got[1][0] == 2 and got[2][1]["findings"] == [] and got[3][1]["status"] == "failed"
    assert all(r[3].isascii() and checked(r[3]) == ("1.0", None, len(r[1]["findings"])) for r in got.values())
    assert identity.canonical(got[2][3]) == identity.canonical(json.dumps(got[2][1]))


#: Nulls, fractions, negative numbers and repeated rows as line items.
ODD_ITEMS = [(1, 1, 2, 2.5), (1, 1, 2, None), (1, 2, 3, None), (1, None, 4, 9.0), (2, 1, 5, 43.5), (2, 2, 0, 3.0), (2, 2, 0, 3.0), (2, 2, 0, 3.0), (3, -2, 4, 9.0), (None, 1, 0, 20.0), (4, None, 1, None), (5, 1, 6, -70.0), (5, -1, 0, 30.5)]


def _of_odd_items(spark, path, name):
    import __spark_entry__ as entry

    spark.createDataFrame(ODD_ITEMS, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return sorted((tuple(r) for r in entry.queries()[name](spark, str(path)).collect()), key=str)


def test_region_merge_of_odd_items(spark, tmp_path):
    """The rows that the SQL gives on them."""
    assert _of_odd_items(spark, tmp_path, "region_merge") == sorted([(1, 40, 42), (1, 80, None), (2, 40, 84), (3, -80, -71), (4, None, None), (5, -40, -10), (5, 40, -30), (None, 40, 60)], key=str)


def test_equal_regions_that_touch_nothing_stay_apart(spark, tmp_path):
    """The rows that the SQL gives on repeated items without an end or with one before their start; both windows read one sort."""
    import __spark_entry__ as entry

    rows = [(1, 1, 0, None)] * 3 + [(2, 2, 0, -30.0)] * 2 + [(3, 1, 0, 5.0)] * 2 + [(4, 1, 0, 100.0)] + [(4, 3, 0, None)] * 2 + [(None, 1, 0, None)] * 2 + [(6, None, 0, 1.0)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    merged = entry.queries()["region_merge"](spark, str(tmp_path))
    want = [(1, 40, None)] * 3 + [(2, 80, 50)] * 2 + [(3, 40, 45), (4, 40, 140), (6, None, None)] + [(None, 40, None)] * 2
    assert sorted((tuple(r) for r in merged.collect()), key=str) == sorted(want, key=str)
    assert merged._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2 and merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") == 1


def test_scope_containment_of_odd_items(spark, tmp_path):
    """The rows that the SQL gives on them: nothing contains a span with a null."""
    want = [(1, 42, 54), (1, 42, 54), (1, 83, 95), (1, None, None), (2, 80, 92), (2, 80, 92), (2, 80, 92), (3, -76, -64), (4, None, None), (5, 46, 58), (None, 40, 52)]
    assert _of_odd_items(spark, tmp_path, "scope_containment") == sorted(want, key=str)


def test_selection_digest_covers_whole_texts(spark, tmp_path):
    """A change at a text's end shows, also behind the first span; null and empty texts keep their rows."""
    import __spark_entry__ as entry
    from scalarium.plans import planted

    body = "the same beginning of every text " * 700
    rows = [(1, body + "a"), (2, "short"), (15, None), (31, ""), (14, None)]
    got = {}
    for end in "ab":
        spark.createDataFrame([(k, t[:-1] + end if k == 1 else t) for k, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/{end}/documents.parquet")
        got[end] = {r.doc_id: r.digest for r in entry.queries()["selection_digest"](spark, f"{tmp_path}/{end}").collect()}
    assert got["a"][1] != got["b"][1] and {k: v for k, v in got["a"].items() if k != 1} == {k: v for k, v in got["b"].items() if k != 1}
    whole = body + "a" + planted.TAILS[1]
    assert got["a"][1] == identity.selection(whole, [(0, 16384), (16384, len(whole))])
    assert got["a"][2] == identity.selection("short" + planted.TAILS[2], [(0, 5 + len(planted.TAILS[2]))])
    assert got["a"][14] == identity.selection(planted.MARK + planted.TAILS[14], [(0, 1 + len(planted.TAILS[14]))])
    assert got["a"][15] is None and got["a"][31] is None and len(got["a"]) == 5


def test_profile_queries_take_every_part_and_customer(spark, tmp_path):
    """Against brute force on a small fixture with keys that the queries once left out."""
    import __spark_entry__ as entry

    parts, customers = [*range(55, 75), 1000, 1001], [(k, k % 4) for k in range(90, 110)]
    orders = [(100 * c + k, c) for c, _ in customers for k in range(c % 7)]
    for name, rows, schema in [("part", [(p,) for p in parts], "p_partkey long"), ("customer", customers, "c_custkey long, c_nationkey int"), ("orders", orders, "o_orderkey long, o_custkey long")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    has = {c: {o % 13 for o, by in orders if by == c} for c, _ in customers}
    want = sorted((p, c) for p in parts for c, _ in customers if p % 3 == c % 3 and {p % 11, p % 13} <= has[c])
    got = sorted(tuple(r) for r in entry.queries()["profile_rule_match"](spark, str(tmp_path)).collect())
    assert got == want and any(p > 60 for p, _ in want)
    told = {r.observation_id: (r.assessment, r.reason) for r in entry.queries()["profile_assessments"](spark, str(tmp_path)).collect()}
    open_ = {n: {c for c, of in customers if of == n and not (c % 2 == 0 or n % 4 > 0)} for n in range(4)}
    names = ["expected", "noteworthy", "unknown", "suspicious"]
    for c, n in customers:
        mapped = c % 5 == 0
        unmapped = bool(open_[n] - ({c} if mapped else set()))
        ranks = [p % 4 for p, o in want if o == c]
        reason = "profile_scope_mismatch" if c % 9 == 0 else "pattern_override" if mapped else "unmapped_pattern_requires_review" if unmapped else "coverage_or_mapping_incomplete" if c % 8 == 0 else "rules_matched" if ranks else "no_matching_rule"
        assert told[c] == ("suspicious" if mapped else names[max(ranks)] if reason == "rules_matched" else "unknown", reason)
    assert len({reason for _, reason in told.values()}) >= 5


def test_rules_of_one_pattern(spark):
    """Rules that share kind and facts fit alike, and the highest of them counts."""
    rules = spark.createDataFrame([(1, "k", "expected", None), (2, "k", "noteworthy", "retain"), (3, "k", "expected", None), (4, "j", "expected", None), (5, "k", "suspicious", None)], "rule_id int, kind string, assessment string, queue string")
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "a"), (5, None)], "rule_id int, fact string")
    obs = spark.createDataFrame([(1, 1, "k", "main", True), (2, 1, "j", "main", True), (3, 1, "k", "main", True)], "observation_id int, artifact_id int, kind string, scope string, complete boolean")
    has = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (3, "b"), (1, None), (9, "a")], "observation_id int, fact string")
    assert sorted((r.rule_id, r.observation_id) for r in profiles.rule_matches(rules, facts, obs, has).collect()) == [(1, 1), (2, 1), (3, 1), (4, 2)]
    none = spark.createDataFrame([], "signal_id int, artifact_id int, mapping_complete boolean"), spark.createDataFrame([], "signal_id int, observation_id int")
    got = {r.observation_id: (r.assessment, r.reason, r.omit_default) for r in profiles.assessments("main", rules, facts, obs, has, *none).collect()}
    assert got == {1: ("noteworthy", "rules_matched", False), 2: ("expected", "rules_matched", True), 3: ("unknown", "no_matching_rule", False)}


def test_classes_of_observations_meet_patterns(spark, monkeypatch):
    """Observations of equal facts meet patterns once, whatever their number; null ids, repeated rows and slices lose nothing."""
    size, facts = 3000, 12
    triples = list(itertools.combinations(range(facts), 3))
    rules = spark.createDataFrame([(k, "k", "expected", None) for k in range(len(triples))], "rule_id int, kind string, assessment string, queue string")
    rule_facts = spark.createDataFrame([(k, f) for k, three in enumerate(triples) for f in three], "rule_id int, fact int")
    observations = spark.range(size).select(F.col("id").alias("observation_id"), F.lit("k").alias("kind"))
    has = observations.select("observation_id", F.explode(F.array(*map(F.lit, range(facts)))).alias("fact")).filter("observation_id % 1000 > 0 or fact <> 3")

    got = sorted((r.rule_id, r.observation_id) for r in profiles.rule_matches(rules, rule_facts, observations, has).collect())
    assert got == [(k, o) for k, three in enumerate(triples) for o in range(size) if o % 1000 > 0 or 3 not in three]
    own, classes, fits = profiles.class_matches(profiles.patterned(rules, rule_facts), observations, has)
    assert sorted(r.n for r in classes.collect()) == [3, size - 3] and own.count() == size
    assert fits.count() == len(triples) + sum(3 not in three for three in triples)
    odd = spark.createDataFrame([(None, "k", "expected", None), (7, "k", "expected", None), (7, "k", "expected", None)], rules.schema)
    monkeypatch.setattr(profiles, "SLICE", 100)
    monkeypatch.setattr(profiles, "CHUNK", 10)
    seen = observations.unionByName(spark.createDataFrame([(None, "k"), (5, None)], "observation_id long, kind string"))
    rows = Counter((r.rule_id, r.observation_id) for r in profiles.rule_matches(odd, rule_facts.filter("rule_id < 0"), seen, has).collect())
    assert rows == {(k, o): 1 + (k == 7) for k in (None, 7) for o in (None, *range(size))}


def test_rule_matches_repeat_within_pages(spark, tmp_path):
    """Each rule with each observation that it fits, in an order in which Parquet takes under half a byte a row."""
    import os

    rules = spark.range(200).select(F.col("id").alias("rule_id"), F.lit("k").alias("kind"), F.lit("expected").alias("assessment"), F.lit(None).cast("string").alias("queue"))
    observations = spark.range(6001).select(F.col("id").alias("observation_id"), F.lit("k").alias("kind"))
    facts = rules.select("rule_id", F.lit(1).alias("fact"))
    has = observations.select("observation_id", F.explode(F.array(F.lit(1), F.col("observation_id") % 40)).alias("fact"))
    profiles.rule_matches(rules, facts, observations, has).select("rule_id", "observation_id").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 200 * 6001 and out.filter("rule_id not between 0 and 199 or observation_id not between 0 and 6000").isEmpty()
    size = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet"))
    assert size < 200 * 6001 / 2


def test_signal_effects_against_pairs(spark):
    import random

    rng = random.Random(3)
    obs, signals = [(k, rng.randrange(6)) for k in range(40)], [(k, rng.randrange(6), k % 3 > 0) for k in range(14)]
    targets = [(rng.randrange(14), rng.randrange(40)) for _ in range(60)] + [(s, o) for s, a, _ in signals[:4] for o, b in obs if a == b]
    got = profiles.signal_effects(spark.createDataFrame(obs, "observation_id int, artifact_id int"), spark.createDataFrame(signals, "signal_id int, artifact_id int, mapping_complete boolean"), spark.createDataFrame(targets, "signal_id int, observation_id int"))
    want = {o: (any(t == o for _, t in targets), any(not full and a == b and (s, o) not in targets for s, b, full in signals)) for o, a in obs}
    assert {r.observation_id: (r.mapped, r.unmapped) for r in got.collect()} == want and len({u for _, u in want.values()}) == 2


def test_audit_queries_run_all_rules(spark, tmp_path):
    """What is planted beyond single characters (UUID, labels, Base64, bare CR, zero-width binary) reaches states, codes and reports."""
    import __spark_entry__ as entry

    ids = [1, 3, 4, 8, 9, 10, 11, 15]
    spark.createDataFrame([(k, "plain words") for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    review = "requires_review"
    assert {r.doc_id: (r.state, r.exit_code) for r in rows("corpus_states")} == {1: (review, 3), 3: ("failed", 4), 4: ("unsupported", 4), 8: (review, 2), 9: (review, 1), 10: (review, 1), 11: (review, 1), 15: ("no_reported_findings", 0)}
    summary = rows("corpus_summary")[0]
    assert (summary.entries, summary.requires_review, summary.no_reported_findings, summary.failed, summary.unsupported, summary.exit_code) == (8, 5, 1, 1, 1, 4)
    assert {(r.state, r.exit_code): r.documents for r in rows("corpus_triage")} == {(review, 3): 1, (review, 2): 1, (review, 1): 3, ("failed", 4): 1, ("unsupported", 4): 1, ("no_reported_findings", 0): 1}
    entries = [e for e in (json.loads(r.line) for r in rows("corpus_records")) if e["type"] == "entry"]
    assert {e["doc_id"]: e["high"] for e in entries}[1] == 1 and {e["doc_id"]: e["info"] for e in entries}[3] == 1
    told = {r.doc_id: r.exit_code for r in rows("finding_summary")}
    assert told[1] == 3 and told[8] == 2 and all(told[k] for k in (9, 10, 11)) and told[15] == 0
    assert sum(r.documents for r in rows("exit_code_histogram") if r.exit_code == 0) == 1
    codes = {r.doc_id: r.exit_code for r in rows("json_reports")}
    assert codes == {1: 3, 3: 4, 4: 4, 8: 2, 9: 1, 10: 1, 11: 1, 15: 0}
    assert rows("graph_problems") == []
