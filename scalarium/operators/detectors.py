"""The detectors: each takes texts (doc_id, text) and gives findings.

Everything but NFC and NFKC stays in the JVM.  A detector first drops texts that can't have what it looks for.  The rules
about single characters and their patterns share one table of marks, so texts are cut and shuffled once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.functions import characters, strings
from scalarium.operators.findings import findings, union
from scalarium.operators.scalars import byte_width, classified, gathered, marks, placed

#: Thresholds of the patterns.
BINARY_COUNT, BINARY_MINORITY, BINARY_ADJACENT = 32, 0.1, 0.75
RUNS = {"variation_selector": 8, "tag": 16}
PERIODIC_COUNT = 12
MARKER_CHARACTERS = 160
BOMS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))


def _subject(cp: str = "cp", name: str = "name"):
    return F.concat(characters.label(F.col(cp)), F.lit(" "), F.col(name))


def unicode_kinds(texts: DataFrame, with_contexts: bool = False, marked: DataFrame | None = None) -> DataFrame:
    """unicode.<kind>: a finding for each code point with a kind; contexts cost a join with the texts."""
    rows = gathered((marks(texts) if marked is None else marked).filter("kind is not null"), ["doc_id", "cp", "kind", "name"])
    rows = rows.withColumn("leading_bom", (F.col("cp") == 0xFEFF) & (F.col("positions") == F.array(F.lit(0))))
    rows, told = _with_contexts(rows, texts, with_contexts)
    told = [characters.label(F.col("cp")).alias("code_point"), "name", "count", "leading_bom", *told]
    severity = F.when(F.col("leading_bom") | F.col("kind").isin("combining", "unusual_whitespace", "soft_hyphen", "variation_selector"), "INFO").when(F.col("kind") == "control", "MEDIUM").otherwise("LOW")
    return findings(rows, F.concat(F.lit("unicode."), F.col("kind")), F.struct(*told), F.col("positions"), _subject(), severity, F.col("byte_offsets"))


def _with_contexts(rows: DataFrame, texts: DataFrame, wanted: bool) -> tuple[DataFrame, list[Column]]:
    if not wanted:
        return rows, []
    told = [strings.contexts(F.col("text"), F.col("positions")).alias("contexts"), F.greatest(F.lit(0), F.col("count") - 8).alias("contexts_omitted")]
    return rows.join(texts.select("doc_id", "text"), "doc_id"), told


def text_hashes(texts: DataFrame) -> DataFrame:
    """SHA-256 of each text, its normal forms and its form without formatting, and what differs."""
    t = F.col("text")
    forms = texts.select("doc_id", "text", strings.nfc(t).alias("nfc"), strings.nfkc(t).alias("nfkc"), strings.formatting_removed(t).alias("plain"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return forms.select(
        "doc_id", sha("text").alias("raw_text_sha256"), sha("nfc").alias("nfc_text_sha256"), sha("nfkc").alias("nfkc_text_sha256"), sha("plain").alias("formatting_removed_sha256"),
        (F.length("text") - F.length("plain")).alias("formatting_removed_count"), (F.col("nfc") != t).alias("nfc_changed"), (F.col("nfkc") != t).alias("nfkc_changed"),
    )


def normalization(texts: DataFrame) -> DataFrame:
    """unicode.normalization; only texts with a character that a normal form may change are sent to Python."""
    t = F.col("text")
    rows = texts.filter(t.rlike(characters.unstable_class())).select("doc_id", (strings.nfc(t) != t).alias("nfc_changed"), (strings.nfkc(t) != t).alias("nfkc_changed")).filter("nfc_changed or nfkc_changed")
    return findings(rows, "unicode.normalization", F.struct("nfc_changed", "nfkc_changed"))


def emoji(texts: DataFrame, with_contexts: bool = False, marked: DataFrame | None = None) -> DataFrame:
    rows = gathered((marks(texts) if marked is None else marked).filter("match_basis is not null"), ["doc_id", "cp", "name", "match_basis"])
    rows, more = _with_contexts(rows, texts, with_contexts)
    told = F.struct(characters.label(F.col("cp")).alias("code_point"), "name", "count", F.lit(characters.EMOJI_VERSION).alias("emoji_data_version"), "match_basis", F.lit("code_point").alias("count_unit"), F.lit(True).alias("requires_context_review"), *more)
    return findings(rows, "unicode.emoji", told, F.col("positions"), _subject(), byte_offsets=F.col("byte_offsets"))


def line_endings(texts: DataFrame) -> DataFrame:
    rows = texts.select("doc_id", strings.line_endings(F.col("text")).alias("e"))
    kinds = sum((F.col(f"e.{k}") > 0).cast("int") for k in ("crlf", "cr", "lf"))
    return findings(rows.filter((kinds > 1) | (F.col("e.cr") > 0)), "text.line_endings", F.col("e"))


def bom(texts: DataFrame) -> DataFrame:
    """text.bom of texts with a column bom (hexadecimal, null without one) and a column encoding."""
    return findings(texts.filter("bom is not null"), "text.bom", F.struct(F.col("bom").alias("hex"), "encoding"))


def _formatting(texts: DataFrame, marked: DataFrame | None) -> DataFrame:
    """doc_id, s: a text's zero-width characters, variation selectors and tags as an array by position."""
    some = (marks(texts) if marked is None else marked).filter(F.col("kind").isin("zero_width", *RUNS))
    return some.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "byte", "cp", "kind"))).alias("s"))


def _of(rows: DataFrame, keep) -> DataFrame:
    """Rows whose array s holds what `keep` accepts; count, positions and byte_offsets of these."""
    some = rows.withColumn("s", F.filter("s", keep)).filter(F.size("s") > 0)
    return some.withColumns({"count": F.size("s").cast("long"), "positions": F.col("s.pos"), "byte_offsets": F.col("s.byte")})


def _gaps() -> Column:
    """Distances of adjoining positions."""
    return F.transform(F.slice("positions", 2, F.greatest(F.size("positions") - 1, F.lit(0))), lambda p, i: p - F.get(F.col("positions"), i))


def _embedded_bom(rows: DataFrame) -> DataFrame:
    return findings(_of(rows, lambda x: (x["cp"] == 0xFEFF) & (x["pos"] > 0)), "text.embedded_bom", F.struct("count"), F.col("positions"), byte_offsets=F.col("byte_offsets"))


def embedded_bom(texts: DataFrame) -> DataFrame:
    return _embedded_bom(_formatting(texts, None))


def _zero_width_binary(rows: DataFrame) -> DataFrame:
    some = _of(rows, lambda x: x["cp"].isin(0x200B, 0x200C)).filter(F.col("count") >= BINARY_COUNT)
    some = some.withColumns({"zwsp": F.size(F.filter("s", lambda x: x["cp"] == 0x200B)).cast("long"), "gaps": _gaps()}).withColumn("zwnj", F.col("count") - F.col("zwsp"))
    some = some.withColumns({"adjacent_fraction": F.size(F.filter("gaps", lambda g: g == 1)) / (F.col("count") - 1), "constant_spacing": F.array_min("gaps") == F.array_max("gaps")})
    some = some.filter((F.least("zwsp", "zwnj") > 0) & (F.least("zwsp", "zwnj") / F.col("count") >= BINARY_MINORITY) & ((F.col("adjacent_fraction") >= BINARY_ADJACENT) | F.col("constant_spacing")))
    some = some.withColumn("sequence_period", strings.period(F.array_join(F.transform("s", lambda x: F.when(x["cp"] == 0x200B, "0").otherwise("1")), "")))
    limits = F.struct(F.lit(BINARY_COUNT).alias("minimum_count"), F.lit(BINARY_MINORITY).alias("minimum_minority_fraction"), F.lit(BINARY_ADJACENT).alias("minimum_adjacent_fraction_or_constant_spacing"))
    told = F.struct("count", F.struct(F.col("zwsp").alias("U+200B"), F.col("zwnj").alias("U+200C")).alias("alphabet"), "adjacent_fraction", "constant_spacing", "sequence_period", limits.alias("thresholds"))
    return findings(some, "pattern.zero_width_binary", told, F.col("positions"), byte_offsets=F.col("byte_offsets"))


def zero_width_binary(texts: DataFrame) -> DataFrame:
    """pattern.zero_width_binary: long and dense or regular sequences of U+200B and U+200C."""
    return _zero_width_binary(_formatting(texts, None))


def _runs(rows: DataFrame) -> DataFrame:
    some = rows.withColumn("s", F.filter("s", lambda x: x["kind"].isin(*RUNS))).filter(F.size("s") >= min(RUNS.values()))
    at = lambda i: F.get(F.col("s"), i)
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (at(i)["pos"] > at(i - 1)["pos"] + 1) | (at(i)["kind"] != at(i - 1)["kind"]))
    some = some.withColumn("first", first)
    cut = F.transform("first", lambda a, j: F.slice("s", a + 1, F.coalesce(F.get(F.col("first"), j + 1), F.size("s")) - a))
    some = some.select("doc_id", F.explode(cut).alias("s")).withColumns({"count": F.size("s").cast("long"), "kind": F.get(F.col("s"), F.lit(0))["kind"]})
    some = some.withColumn("minimum_run", F.when(F.col("kind") == "tag", RUNS["tag"]).otherwise(RUNS["variation_selector"])).filter("count >= minimum_run")
    shown = F.array_join(F.transform(F.filter("s", lambda x: x["cp"].between(0xE0020, 0xE007E)), lambda x: F.char((x["cp"] - 0xE0000).cast("long"))), "")
    some = some.withColumns({"alphabet_size": F.size(F.array_distinct("s.cp")), "ascii_projection": F.when(F.col("kind") == "tag", shown)})
    return findings(some, F.concat(F.lit("pattern."), F.col("kind"), F.lit("_run")), F.struct("count", "minimum_run", "alphabet_size", "ascii_projection"), F.col("s.pos"), byte_offsets=F.col("s.byte"))


def runs(texts: DataFrame) -> DataFrame:
    """pattern.variation_selector_run and pattern.tag_run: long runs of one of these kinds."""
    return _runs(_formatting(texts, None))


def _periodic_insertion(rows: DataFrame) -> DataFrame:
    some = _of(rows, lambda x: (x["kind"] == "zero_width") & (x["cp"] != 0x200D) & ~((x["pos"] == 0) & (x["cp"] == 0xFEFF))).filter(F.col("count") >= PERIODIC_COUNT)
    some = some.withColumn("gaps", _gaps()).withColumn("character_interval", F.array_min("gaps")).filter((F.col("character_interval") == F.array_max("gaps")) & (F.col("character_interval") > 1))
    return findings(some, "pattern.periodic_insertion", F.struct("count", "character_interval", F.lit(PERIODIC_COUNT).alias("minimum_count")), F.col("positions"), byte_offsets=F.col("byte_offsets"))


def periodic_insertion(texts: DataFrame) -> DataFrame:
    """pattern.periodic_insertion: zero-width characters other than the joiner at one distance over 1."""
    return _periodic_insertion(_formatting(texts, None))


def matches(texts: DataFrame, expression: str) -> DataFrame:
    """doc_id, pos, byte, value of an expression's matches that don't overlap.

    Each match is found again by the text before it: what lies between matches is what splitting at the expression leaves,
    so a running sum of lengths places them.
    """
    found = texts.filter(F.col("text").rlike(expression))
    extra = ["encoding"] if "encoding" in texts.columns else []
    pairs = F.arrays_zip(F.split("text", expression).alias("between"), F.regexp_extract_all("text", F.lit(expression), F.lit(0)).alias("value"))
    each = found.select("doc_id", *extra, F.posexplode(pairs).alias("k", "p")).filter("p.value is not null")
    between, value = F.col("p.between"), F.col("p.value")
    # a part is a match and what comes before it, so its match begins so much after the part does
    each = each.select("doc_id", "k", value.alias("value"), F.length(between).alias("after"), byte_width(between, texts).alias("bytes_after"), (F.length(between) + F.length(value)).alias("chars"), (byte_width(between, texts) + byte_width(value, texts)).alias("bytes"))
    return placed(each).select("doc_id", (F.col("pos") + F.col("after")).alias("pos"), (F.col("byte") + F.col("bytes_after")).cast("int").alias("byte"), "value")


def mixed_script_tokens(texts: DataFrame) -> DataFrame:
    """doc_id, start, byte, token, scripts of runs of letters and numbers (no decimal digits) with Latin and Greek or Cyrillic letters."""
    other = r"\p{IsGreek}|\p{IsCyrillic}|[\x{AB65}\x{1D26}-\x{1D2B}\x{1C80}-\x{1C8F}\x{A640}-\x{A69F}\x{B5}\x{2126}\x{1D400}-\x{1D7FF}\x{1E030}-\x{1E08F}]"
    latin = r"[A-Za-z\x{AA}-\x{24F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A722}-\x{A7FF}\x{FB00}-\x{FB06}\x{FF21}-\x{FF5A}\x{250}-\x{2AF}\x{1D00}-\x{1DBF}]"
    inside = characters.java_class([cp for cp in characters.word_points() if cp != 0x5F and characters.category(cp) != "Nd"])
    some = texts.filter(F.col("text").rlike(other) & F.col("text").rlike(latin))
    # tokens with letters beyond ASCII, told apart further by the names of their letters
    token = matches(some, f"(?<!{inside})(?={inside}*[^\\x00-\\x7F]){inside}++").filter(F.col("value").rlike(other) & F.col("value").rlike(latin))
    each = token.select("doc_id", "pos", "byte", F.col("value").alias("token"), F.explode(F.array_distinct(F.transform(strings.chars(F.col("value")), characters.code_point))).alias("cp"))
    told = each.join(characters.scripts(texts.sparkSession), "cp", "left").groupBy("doc_id", "pos", "byte", "token").agg(F.sort_array(F.collect_set("script")).alias("scripts"))
    return told.filter(F.array_contains("scripts", "LATIN") & F.arrays_overlap("scripts", F.array(F.lit("GREEK"), F.lit("CYRILLIC")))).select("doc_id", F.col("pos").alias("start"), "byte", "token", "scripts")


def mixed_script(texts: DataFrame) -> DataFrame:
    rows = mixed_script_tokens(texts)
    return findings(rows, "text.mixed_script", F.struct(strings.escaped(F.col("token")).alias("escaped_token"), "scripts"), F.array("start"), byte_offsets=F.array("byte"))


def uuids(texts: DataFrame) -> DataFrame:
    word = characters.word_inside()
    rows = matches(texts, f"(?=[0-9A-Fa-f]{{8}}-)(?<![{word}\\x{{5F}}\\-])[0-9A-Fa-f]{{8}}-(?:[0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}(?![{word}\\x{{5F}}\\-])")
    rows = gathered(rows, ["doc_id", "value"])
    return findings(rows, "identifier.uuid", F.struct("value", "count", (F.col("count") > 1).alias("repeated")), F.col("positions"), byte_offsets=F.col("byte_offsets"))


def _either(word: str) -> str:
    """A word of small letters in any case, with the letters that fold to i, s and k."""
    more = {"i": "\\x{130}\\x{131}", "s": "\\x{17F}", "k": "\\x{212A}"}
    return "".join(f"[{c}{c.upper()}{more.get(c, '')}]" if c.isalpha() else c for c in word)


def provenance_markers(texts: DataFrame) -> DataFrame:
    """provenance.text_marker: a label, `:` or `=`, and up to 160 characters of its line."""
    space, value = characters.space_class(), "[^\\r\\n<>]"
    labels = "|".join([f"{_either('generated')}{space}++{_either('by')}", *(_either(w) for w in ("watermark", "provenance")), f"{_either('tracking')}[-_ ]{_either('id')}", f"{_either('document')}[-_ ]{_either('id')}", _either("author")])
    rows = matches(texts, f"(?=[GgWwPpTtDdAa])(?<![{characters.word_inside()}\\x{{5F}}])(?:{labels}){space}*+[:=]{space}*{value}{{1,{MARKER_CHARACTERS}}}")
    return findings(rows, "provenance.text_marker", F.struct(strings.escaped(F.col("value")).alias("escaped_marker")), F.array("pos"), byte_offsets=F.array("byte"))


def encoded_candidates(texts: DataFrame) -> DataFrame:
    """text.encoded_candidate: long tokens that are Base64 with a digit and a letter."""
    word = characters.word_inside()
    rows = matches(texts, f"(?=[A-Za-z0-9+/]{{32}})(?<![{word}\\x{{5F}}+/])[A-Za-z0-9+/]{{32,}}+={{0,2}}+(?![{word}\\x{{5F}}+/=])")
    rows = rows.filter(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).withColumn("size", strings.decoded_size(F.col("value"))).filter("size is not null")
    return findings(rows, "text.encoded_candidate", F.struct("value", F.length("value").alias("character_count"), F.col("size").alias("base64_decoded_bytes")), F.array("pos"), byte_offsets=F.array("byte"))


def metadata(entries: DataFrame) -> DataFrame:
    """metadata.present of rows of doc_id and metadata (a map)."""
    rows = entries.select("doc_id", F.explode("metadata").alias("key", "value"))
    return findings(rows, "metadata.present", F.struct("key", "value"), subject=F.col("key"))


def parser_failures(failures: DataFrame) -> DataFrame:
    """parser.failure of rows of doc_id, code, message, start, end."""
    return findings(failures, "parser.failure", F.struct(F.col("code").alias("error_type"), "message", F.col("start").alias("byte_start"), F.col("end").alias("byte_end")))


def all_findings(texts: DataFrame, with_contexts: bool = False) -> DataFrame:
    """All text detectors.  Texts are cut at their marks once; both groupings of the marks read one shuffle."""
    marked = marks(texts)
    formatting = _formatting(texts, marked)
    parts = [unicode_kinds(texts, with_contexts, marked), normalization(texts), emoji(texts, with_contexts, marked), line_endings(texts)]
    parts += [rule(formatting) for rule in (_embedded_bom, _zero_width_binary, _runs, _periodic_insertion)]
    parts += [rule(texts) for rule in (mixed_script, uuids, provenance_markers, encoded_candidates)]
    if {"bom", "encoding"} <= set(texts.columns):
        parts.append(bom(texts))
    return union(parts)


__all__ = ["all_findings", "classified"]
