"""Detectors at their thresholds, and characters against Python's own tables."""

import json
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scalarium.functions import characters, strings
from scalarium.operators import detectors, scalars
from scalarium.operators import findings as found_in

ZWSP, ZWNJ, WJ = "​", "‌", "⁠"


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def found(df):
    return sorted(((r.doc_id, r.id, json.loads(r.evidence), list(r.positions)) for r in df.collect()), key=lambda x: (x[0], x[1], json.dumps(x[2], sort_keys=True), x[3]))


def test_kinds_take_the_first_match():
    assert characters.kind_of(0x0B) == "unusual_whitespace" and characters.kind_of(0x85) == "unusual_whitespace"
    assert characters.kind_of(0x180E) == "control" and characters.kind_of(0x20E3) == "combining"
    assert characters.kind_of(0xE0001) == "tag" and characters.kind_of(0x115F) == "" and characters.kind_of(9) == ""
    assert characters.category(0x2EBF0) == "Cn" and characters.name(7, "UNNAMED CONTROL") == "UNNAMED CONTROL"


def test_inventory_places_and_counts(spark):
    df = texts(spark, ["a​b​", "", "plain", "😀‍x", "﻿start"])
    rows = {(r.doc_id, r.cp): (r.kind, r["count"], r.positions) for r in scalars.inventory(df).collect()}
    assert rows == {(0, 0x200B): ("zero_width", 2, [1, 3]), (3, 0x200D): ("zero_width", 1, [1]), (4, 0xFEFF): ("zero_width", 1, [0])}
    leading = found(detectors.unicode_kinds(df))[-1]
    assert leading[2]["leading_bom"] is True
    offsets = texts(spark, ["é😀​"]).select(strings.byte_offsets(F.col("text"), F.array(F.lit(2), F.lit(1)))).first()[0]
    assert offsets == [6, 2]


@pytest.mark.parametrize(("n", "hit"), [(31, False), (32, True), (33, True)])
def test_zero_width_binary_needs_thirty_two(spark, n, hit):
    rows = found(detectors.zero_width_binary(texts(spark, [(ZWSP + ZWNJ) * (n // 2) + ZWSP * (n % 2)])))
    assert bool(rows) == hit
    if hit:
        assert rows[0][2]["sequence_period"] == 2 and rows[0][2]["adjacent_fraction"] == 1.0


def test_zero_width_binary_minority_and_spacing(spark):
    few, enough = ZWSP * 37 + ZWNJ * 3, ZWSP * 36 + ZWNJ * 4
    spaced = "".join(c + "ab" for c in (ZWSP + ZWNJ) * 16)
    loose = "".join(c + "a" * (k % 3 + 1) for k, c in enumerate((ZWSP + ZWNJ) * 16))
    rows = found(detectors.zero_width_binary(texts(spark, [few, enough, spaced, loose])))
    assert [r[0] for r in rows] == [1, 2] and rows[1][2]["constant_spacing"] is True


def test_runs_and_periods(spark):
    selectors = "".join(chr(0xFE00 + k) for k in range(8))
    tags = "".join(chr(0xE0000 + ord(c)) for c in "sixteen letters!")
    df = texts(spark, ["x" + selectors, "x" + selectors[:7], tags, tags[:15], selectors[:4] + "-" + selectors[4:]])
    rows = found(detectors.runs(df))
    assert [(r[0], r[1]) for r in rows] == [(0, "pattern.variation_selector_run"), (2, "pattern.tag_run")]
    assert rows[1][2]["ascii_projection"] == "sixteen letters!"
    df = texts(spark, [("ab" + WJ) * 12, ("ab" + WJ) * 11, WJ * 12, "﻿" + ("ab" + WJ) * 12, ("ab‍") * 12])
    assert [(r[0], r[2]["character_interval"]) for r in found(detectors.periodic_insertion(df))] == [(0, 3), (3, 3)]


def test_emoji_and_keycaps(spark):
    df = texts(spark, ["1️⃣ 1 #⃣ © 5️", "12"])
    rows = found(detectors.emoji(df))
    assert [(r[2]["code_point"], r[2]["match_basis"], r[3]) for r in rows] == [("U+0023", "keycap_base", [6]), ("U+0031", "keycap_base", [0]), ("U+00A9", "unicode_emoji_property", [9])]


def test_line_endings_and_marks(spark):
    df = texts(spark, ["a\r\nb", "a\r\nb\n", "a\rb", "\n\n", "x﻿y"])
    assert [(r[0], r[2]) for r in found(detectors.line_endings(df))] == [(1, {"crlf": 1, "cr": 0, "lf": 1}), (2, {"crlf": 0, "cr": 1, "lf": 0})]
    assert [(r[0], r[3]) for r in found(detectors.embedded_bom(df))] == [(4, [1])]


def test_mixed_scripts_by_token(spark):
    df = texts(spark, ["pаypal", "p а", "Ωmega", "αβ_abc", "абв1x", "éа"])
    assert sorted((r.doc_id, r.start, r.token, tuple(r.scripts)) for r in detectors.mixed_script_tokens(df).collect()) == [(0, 0, "pаypal", ("CYRILLIC", "LATIN")), (2, 0, "Ωmega", ("GREEK", "LATIN")), (5, 0, "éа", ("CYRILLIC", "LATIN"))]


def test_identifiers(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    df = texts(spark, [f"{u} {u.upper()} {u}", f"x{u}", f"{u}-", f"é{u}", f"({u})"])
    assert [(r[0], r[2]["value"], r[3]) for r in found(detectors.uuids(df))] == [(0, u.upper(), [37]), (0, u, [0, 74]), (4, u, [1])]


def test_markers(spark):
    df = texts(spark, ["Generated \n by = x<y", "mywatermark: a", "AUTHOR:\n\n  b", "author=\n", "traceking-id:1", "Tracking ID: 7\nprovenance = p", "ſ author: " + "z" * 200, "author:  \n"])
    rows = [(r[0], r[2]["escaped_marker"], r[3]) for r in found(detectors.provenance_markers(df))]
    assert rows == [(0, "Generated \\n by = x", [0]), (2, "AUTHOR:\\n\\n  b", [0]), (5, "Tracking ID: 7", [0]), (5, "provenance = p", [15]), (6, "author: " + "z" * 160, [2]), (7, "author:  ", [0])]


def test_encoded_candidates(spark):
    good = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVoxMjM0NTY3"
    df = texts(spark, [good, good[:-1], "é" + good, good + "=", "a" * 32, f"({good})"])
    assert [(r[0], r[2]["base64_decoded_bytes"]) for r in found(detectors.encoded_candidates(df))] == [(0, 33), (5, 33)]


def test_summary_order_and_views(spark):
    df = texts(spark, ["\x07 x​ é", "none"])
    rows = detectors.all_findings(df)
    told = {r.doc_id: r for r in found_in.summaries(df, rows).collect()}
    assert told[0].exit_code == 2 and told[0].medium == 1 and told[1].findings == 0 and told[1].exit_code == 0
    first = found_in.ordered_ranks(rows).filter("finding_ref = 'finding/0'").first()
    assert first.id == "unicode.control"
    assert found_in.view(rows, "metadata").count() == 0 and found_in.view(rows, "unicode").count() == rows.count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab​‌­é\t\n\\￾😀\x07\x85"), max_size=30), min_size=1, max_size=8))
def test_escapes_positions_and_formatting(spark, rows):
    df = texts(spark, rows)
    for r in df.select("doc_id", "text", strings.escaped(F.col("text")).alias("e"), strings.formatting_removed(F.col("text")).alias("f")).collect():
        assert r.e == r.text.encode("unicode_escape").decode()
        assert r.f == "".join(c for c in r.text if characters.kind_of(ord(c)) not in characters.REMOVABLE)
    for r in scalars.inventory(df).collect():
        assert [k for k, c in enumerate(rows[r.doc_id]) if ord(c) == r.cp] == r.positions


def test_normal_forms_and_periods(spark):
    rows = ["é", "ﬁ", "plain", "å"]
    for r in texts(spark, rows).select("text", strings.nfc(F.col("text")).alias("c"), strings.nfkc(F.col("text")).alias("k")).collect():
        assert (r.c, r.k) == (unicodedata.normalize("NFC", r.text), unicodedata.normalize("NFKC", r.text))
    df = texts(spark, ["abababab", "aaa", "ab", "abcabcab", "abcabcabc"])
    assert [r[0] for r in df.orderBy("doc_id").select(strings.period(F.col("text"))).collect()] == [2, 1, None, None, 3]


def test_no_detector_runs_python_rows(spark):
    plan = detectors.zero_width_binary(texts(spark, ["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
