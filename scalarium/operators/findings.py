"""The table of findings: its columns, templates, order, views and summaries.

A finding is doc_id, id, severity, confidence, category, classification, title, description, evidence (JSON), positions
(characters) and byte_offsets (in the source's encoding).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.functions import strings

#: Severity, confidence, category, classification and title of each rule; titles of the per-character rules name the character.
TEMPLATES = {
    "identifier.uuid": ("MEDIUM", 0.99, "identifier", "observed_fact", "UUID-like identifier present"),
    "parser.failure": ("INFO", 1.0, "parser", "observed_fact", "Audit could not complete"),
    "pattern.periodic_insertion": ("MEDIUM", 0.7, "possible_steganography", "suspicious_pattern", "Periodic invisible-character insertion"),
    "pattern.tag_run": ("MEDIUM", 0.75, "possible_steganography", "suspicious_pattern", "Long contiguous tag sequence"),
    "pattern.variation_selector_run": ("MEDIUM", 0.75, "possible_steganography", "suspicious_pattern", "Long contiguous variation selector sequence"),
    "pattern.zero_width_binary": ("HIGH", 0.8, "possible_steganography", "suspicious_pattern", "Possible zero-width binary encoding"),
    "provenance.text_marker": ("LOW", 0.9, "provenance", "observed_fact", "Explicit provenance or identifier label detected"),
    "text.bom": ("INFO", 1.0, "document_structure", "observed_fact", "Byte order mark detected"),
    "text.embedded_bom": ("LOW", 1.0, "document_structure", "observed_fact", "Embedded BOM character detected"),
    "text.encoded_candidate": ("INFO", 0.5, "embedded_content", "suspicious_pattern", "Long encoding-compatible token detected"),
    "text.line_endings": ("LOW", 1.0, "document_structure", "observed_fact", "Mixed or legacy line endings detected"),
    "text.mixed_script": ("LOW", 0.6, "unicode", "suspicious_pattern", "Mixed Latin and Greek/Cyrillic letters within a token"),
    "unicode.emoji": ("LOW", 1.0, "unicode", "observed_fact", "Emoji-capable {} detected"),
    "unicode.normalization": ("INFO", 1.0, "unicode", "observed_fact", "Unicode normalization changes extracted text"),
    "metadata.present": ("INFO", 1.0, "metadata", "observed_fact", "{} metadata present"),
} | {f"unicode.{kind}": (severity, 1.0, "unicode", "observed_fact", "{} detected") for kind, severity in (("zero_width", "LOW"), ("bidi_control", "LOW"), ("tag", "LOW"), ("variation_selector", "INFO"), ("soft_hyphen", "INFO"), ("unusual_whitespace", "INFO"), ("combining", "INFO"), ("control", "MEDIUM"))}
#: Descriptions of the rules.
_CHARACTERS = "Character occurrences are observable facts. Language, typography, emoji and formatting can explain legitimate uses; presence alone does not establish hidden data."
_RUN = "This run is consistent with encoded character data. Tags and variation selectors also have legitimate uses; interpretation requires review."
DESCRIPTIONS = {
    "identifier.uuid": "A UUID-shaped value may serve as a persistent identifier. Its persistence, uniqueness, purpose and origin cannot be inferred from syntax alone.",
    "parser.failure": "The file was not fully analyzed. Review the error before interpreting findings.",
    "pattern.periodic_insertion": "Invisible formatting characters recur at an exact character interval. Formatting conventions may also produce this pattern.",
    "pattern.tag_run": _RUN,
    "pattern.variation_selector_run": _RUN,
    "pattern.zero_width_binary": "A two-symbol ZWSP/ZWNJ alphabet forms a long contiguous or regularly spaced sequence. This is consistent with an invisible encoding scheme; no payload, author or watermark intent is confirmed.",
    "provenance.text_marker": "The source contains a provenance-related label, possibly in a comment. The statement is unverified and could be an example or ordinary prose.",
    "text.bom": "An initial BOM is an ordinary encoding marker.",
    "text.embedded_bom": "Possible concatenated text or embedded formatting marker.",
    "text.encoded_candidate": "This alphanumeric token is syntactically valid Base64; hashes, identifiers and ordinary application data can match. Decoded content is not executed or recursively analyzed.",
    "text.line_endings": "Line-ending differences can result from ordinary editing or platform conversion.",
    "text.mixed_script": "Mixed scripts can contain visually similar letters, but can also be intentional. This is not a comprehensive confusables detector.",
    "unicode.emoji": "Review whether this content is required for the application or document. Comments, docstrings, string literals and test data are not automatically exempt. Presence does not establish hidden encoding, malicious intent or permission to remove it. Some symbols also have ordinary text presentation; counts refer to code points, not rendered emoji.",
    "unicode.normalization": "Canonical or compatibility equivalents differ. This is common in normal text and does not imply a watermark.",
    "metadata.present": "Metadata is evidence, not proof of watermarking.",
}
VIEWS = {
    "unicode": ("unicode", "possible_steganography"),
    "metadata": ("metadata", "identifier", "provenance"),
    "structure": ("document_structure", "embedded_content", "hidden_content", "visual_watermark"),
}
FAILED = 4
COLUMNS = ["doc_id", "id", "severity", "confidence", "category", "classification", "title", "description", "evidence", "positions", "byte_offsets"]


def _told(rule: str, k: int) -> str | float:
    """The k-th thing told of a rule: severity, confidence, category, classification, title, description."""
    return TEMPLATES[rule][k] if k < 5 else DESCRIPTIONS.get(rule, _CHARACTERS)


def _pick(rule: str | Column, k: int) -> Column:
    """The same as a column; of a rule that rows name in `id`, one expression over all rules."""
    if isinstance(rule, str):
        return F.lit(_told(rule, k))
    quoted = lambda x: repr(x) if isinstance(x, float) else "'" + x.replace("'", "\\'") + "'"
    return F.expr("case id " + " ".join(f"when '{r}' then {quoted(_told(r, k))}" for r in TEMPLATES) + " end")


def findings(rows: DataFrame, rule: str | Column, evidence: Column, positions: Column | None = None, subject: Column | None = None, severity: Column | None = None, byte_offsets: Column | None = None) -> DataFrame:
    """Rows (with doc_id) as findings of a rule; subject fills the title's gap."""
    rows = rows.withColumn("id", F.lit(rule) if isinstance(rule, str) else rule)
    title = _pick(rule, 4)
    none = F.expr("cast(array() as array<int>)")
    return rows.select(
        "doc_id",
        "id",
        (severity if severity is not None else _pick(rule, 0)).alias("severity"),
        _pick(rule, 1).cast("double").alias("confidence"),
        _pick(rule, 2).alias("category"),
        _pick(rule, 3).alias("classification"),
        (F.replace(title, F.lit("{}"), subject) if subject is not None else title).alias("title"),
        _pick(rule, 5).alias("description"),
        F.to_json(evidence).alias("evidence"),
        (positions if positions is not None else none).alias("positions"),
        (byte_offsets if byte_offsets is not None else none).alias("byte_offsets"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def view(found: DataFrame, name: str) -> DataFrame:
    """Findings of a view's categories; failures to parse always stay."""
    return found if name == "all" else found.filter(F.col("category").isin(*VIEWS[name], "parser"))


def location(found: DataFrame, source: str = "file") -> Column:
    """Where a finding is, as JSON with sorted keys: byte and character offsets and the source's name, or what there is of these."""
    at = F.struct("byte_offsets", F.col("positions").alias("character_offsets"), F.lit(source).alias("source"))
    start = F.struct(F.lit(0).alias("byte_offset"), F.lit(source).alias("source"))
    of = F.col("id")
    return F.when(F.size("positions") > 0, F.to_json(at)).when(of == "text.bom", F.to_json(start)).when(of.startswith("metadata.") | of.startswith("parser."), F.lit("{}")).otherwise(F.to_json(F.struct(F.lit(source).alias("source"))))


def ordered_ranks(found: DataFrame, partition: str = "doc_id") -> DataFrame:
    """Adds finding_ref (finding/0 and so on): severity first, then id, location as JSON text, title."""
    from pyspark.sql import Window

    order = Window.partitionBy(partition).orderBy(strings.order_rank(F.col("severity")).desc(), "id", location(found), "title")
    return found.withColumn("finding_ref", F.concat(F.lit("finding/"), F.row_number().over(order) - 1))


def summaries(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, findings, high, medium, low, info, exit_code of each text; a failure to parse makes the code 4."""
    of = lambda s: F.count_if(F.col("severity") == s)
    counts = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("findings"), of("HIGH").alias("high"), of("MEDIUM").alias("medium"), of("LOW").alias("low"), of("INFO").alias("info"),
        F.max(F.when(F.col("id") == "parser.failure", FAILED).otherwise(strings.severity_rank(F.col("severity")))).alias("exit_code"),
    )
    names = ["findings", "high", "medium", "low", "info", "exit_code"]
    return texts.select("doc_id").join(counts, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))
