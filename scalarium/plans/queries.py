"""One query per operator, with the SQL that says the same: characters, findings, views."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.functions import characters, strings
from scalarium.operators import detectors, scalars
from scalarium.operators import findings as found_in
from scalarium.plans import planted
from scalarium.sources.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def joined(positions: str = "positions"):
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",").alias(positions)


_KIND_ROWS = [(a, b, kind) for kind in characters.KINDS for a, b in characters.ranges([cp for cp, k, *_ in characters.kind_rows() if k == kind])]
_KINDS_SQL = planted.SCALARS + ", " + planted.sql_ranges("kind_ranges", _KIND_ROWS) + ", points as (select distinct cp from scalars), kinds as (select cp, of as kind from points join kind_ranges on cp between lo and hi), hits as (select doc_id, pos, ch, scalars.cp, kind from scalars join kinds on scalars.cp = kinds.cp)"
_INVENTORY_SQL = _KINDS_SQL + ", inventory as (select doc_id, cp, kind, count(*) as n, string_agg(cast(pos as varchar), ',' order by pos) as positions, min(pos) as first from hits group by doc_id, cp, kind)"
_SEVERITY_SQL = "case when (cp = 65279 and n = 1 and first = 0) or kind in ('combining', 'unusual_whitespace', 'soft_hyphen', 'variation_selector') then 'INFO' when kind = 'control' then 'MEDIUM' else 'LOW' end"
_LABEL_SQL = "'U+' || lpad(hex(cp), cast(greatest(4, length(hex(cp))) as integer), '0')"


@query(f"with {_INVENTORY_SQL} select doc_id, {_LABEL_SQL} as code_point, kind, cast(n as bigint) as count, positions, {_SEVERITY_SQL} as severity from inventory")
def unicode_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scalars.inventory(planted.texts(spark, sf_dir))
    bom = (F.col("cp") == 0xFEFF) & (F.col("positions") == F.array(F.lit(0)))
    severity = F.when(bom | F.col("kind").isin("combining", "unusual_whitespace", "soft_hyphen", "variation_selector"), "INFO").when(F.col("kind") == "control", "MEDIUM").otherwise("LOW")
    return rows.select("doc_id", characters.label(F.col("cp")).alias("code_point"), "kind", "count", joined(), severity.alias("severity"))


@query(f"with {_KINDS_SQL} select kind, cast(count(*) as bigint) as count, cast(count(distinct doc_id) as bigint) as documents, cast(count(distinct cp) as bigint) as code_points from hits group by kind")
def unicode_kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scalars.inventory(planted.texts(spark, sf_dir))
    return rows.groupBy("kind").agg(F.sum("count").alias("count"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("cp").alias("code_points"))


@query(f"with {_KINDS_SQL} select doc_id, cast(pos as bigint) as pos, cast(strlen(substr(text, 1, pos)) as bigint) as byte_offset from hits join texts using (doc_id) where kind = 'zero_width'")
def byte_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    rows = scalars.inventory(texts).filter("kind = 'zero_width'").join(texts, "doc_id")
    return rows.select("doc_id", F.inline(F.arrays_zip(F.col("positions").alias("pos"), strings.byte_offsets(F.col("text"), F.col("positions")).alias("byte_offset")))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("byte_offset").cast("long").alias("byte_offset"))


_EMOJI = [(a, b, "") for a, b in characters.ranges([p for p in characters.emoji_points() if chr(p) not in characters.KEYCAP_BASES])]
_EMOJI_SQL = planted.SCALARS + ", " + planted.sql_ranges("emoji_ranges", _EMOJI) + ", ahead as (select *, lead(cp, 1) over w as n1, lead(cp, 2) over w as n2 from scalars window w as (partition by doc_id order by pos)), points as (select distinct cp from scalars), emoji as (select distinct cp from points join emoji_ranges on cp between lo and hi), marked as (select doc_id, pos, cp, 'unicode_emoji_property' as basis from ahead where cp in (select cp from emoji) union all select doc_id, pos, cp, 'keycap_base' from ahead where strpos('#*0123456789', ch) > 0 and (n1 = 8419 or (n1 = 65039 and n2 = 8419)))"


@query(f"with {_EMOJI_SQL} select doc_id, {_LABEL_SQL} as code_point, basis as match_basis, cast(count(*) as bigint) as count, string_agg(cast(pos as varchar), ',' order by pos) as positions from marked group by doc_id, cp, basis")
def emoji_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scalars.emoji_occurrences(planted.texts(spark, sf_dir)).groupBy("doc_id", "cp", "match_basis").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return rows.select("doc_id", characters.label(F.col("cp")).alias("code_point"), "match_basis", "count", joined())


_ENDINGS_SQL = planted.SQL + r", e as (select doc_id, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as crlf, length(text) - length(replace(text, chr(13), '')) as crs, length(text) - length(replace(text, chr(10), '')) as lfs from texts)"


@query(f"with {_ENDINGS_SQL} select doc_id, cast(crlf as bigint) as crlf, cast(crs - crlf as bigint) as cr, cast(lfs - crlf as bigint) as lf, (crs - crlf > 0 or (case when crlf > 0 then 1 else 0 end + case when lfs - crlf > 0 then 1 else 0 end) > 1) as mixed from e")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    counted = texts.select("doc_id", strings.line_endings(F.col("text")).alias("e")).select("doc_id", *(F.col(f"e.{k}").cast("long").alias(k) for k in ("crlf", "cr", "lf")))
    mixed = detectors.line_endings(texts).select("doc_id", F.lit(True).alias("mixed"))
    return counted.join(mixed, "doc_id", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))


@query(f"with {planted.SQL} select doc_id, bom as hex from texts where bom is not null")
def bom_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.bom(planted.texts(spark, sf_dir)).select("doc_id", F.get_json_object("evidence", "$.hex").alias("hex"))


@query(f"with {planted.SCALARS} select doc_id, cast(count(*) as bigint) as count, string_agg(cast(pos as varchar), ',' order by pos) as positions from scalars where cp = 65279 and pos > 0 group by doc_id")
def embedded_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.embedded_bom(planted.texts(spark, sf_dir)).select("doc_id", F.get_json_object("evidence", "$.count").cast("long").alias("count"), joined())


_GREEK = [(0x370, 0x3FF, "GREEK"), (0x400, 0x52F, "CYRILLIC"), (0x41, 0x5A, "LATIN"), (0x61, 0x7A, "LATIN"), (0xC0, 0x24F, "LATIN")]


@query(
    f"with {planted.SCALARS}, {planted.sql_ranges('script_ranges', _GREEK)}, points as (select distinct cp from scalars), scripts as (select cp, of as script from points join script_ranges on cp between lo and hi where cp not in (215, 247)), "
    "letters as (select doc_id, pos, ch, cp, script from scalars join scripts using (cp)), runs as (select *, pos - row_number() over (partition by doc_id order by pos) as island from letters), "
    "tokens as (select doc_id, min(pos) as start, string_agg(ch, '' order by pos) as token, string_agg(distinct script, ',' order by script) as scripts from runs group by doc_id, island) "
    "select doc_id, cast(start as bigint) as start, token, scripts from tokens where scripts in ('CYRILLIC,LATIN', 'GREEK,LATIN', 'CYRILLIC,GREEK,LATIN')"
)
def mixed_script_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.mixed_script_tokens(planted.texts(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), "token", F.array_join("scripts", ",").alias("scripts"))


_GAPS_SQL = planted.SCALARS + ", marks as (select doc_id, pos, cp, ch, pos - lag(pos) over (partition by doc_id order by pos) as gap from scalars where cp in (8203, 8204))"


@query(
    f"with {_GAPS_SQL}, s as (select doc_id, count(*) as n, count(*) filter (where cp = 8203) as zwsp, count(*) filter (where cp = 8204) as zwnj, avg(case when gap = 1 then 1.0 when gap is not null then 0.0 end) as f, min(gap) = max(gap) as same, string_agg(ch, '' order by pos) as q from marks group by doc_id) "
    "select doc_id, cast(n as bigint) as count, cast(zwsp as bigint) as zwsp, cast(zwnj as bigint) as zwnj, round(cast(f as double), 6) as adjacent_fraction, same as constant_spacing, (select cast(min(p) as bigint) from range(1, 33) r(p) where p <= n // 3 and substr(q, cast(p + 1 as bigint), cast(n - p as bigint)) = substr(q, 1, cast(n - p as bigint))) as sequence_period from s where n >= 32 and least(zwsp, zwnj) > 0 and least(zwsp, zwnj) / n >= 0.1 and (f >= 0.75 or same)"
)
def zero_width_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k, t: F.get_json_object("evidence", f"$.{k}").cast(t)
    alphabet = lambda k: F.get_json_object("evidence", f"$.alphabet['{k}']").cast("long")
    rows = detectors.zero_width_binary(planted.texts(spark, sf_dir))
    return rows.select("doc_id", of("count", "long").alias("count"), alphabet("U+200B").alias("zwsp"), alphabet("U+200C").alias("zwnj"), F.round(of("adjacent_fraction", "double"), 6).alias("adjacent_fraction"), of("constant_spacing", "boolean").alias("constant_spacing"), of("sequence_period", "long").alias("sequence_period"))


_RUNS_SQL = (
    planted.SCALARS + ", marks as (select doc_id, pos, cp, case when cp between 917504 and 917631 then 'tag' else 'variation_selector' end as kind from scalars where cp between 65024 and 65039 or cp between 917504 and 917631 or cp between 917760 and 917999), "
    "isles as (select *, pos - row_number() over (partition by doc_id, kind order by pos) as island from marks), "
    "runs as (select doc_id, kind, count(*) as n, count(distinct cp) as alphabet, min(pos) as start, string_agg(case when cp between 917536 and 917630 then chr(cast(cp - 917504 as integer)) else '' end, '' order by pos) as shown from isles group by doc_id, kind, island)"
)


@query(f"with {_RUNS_SQL} select doc_id, 'pattern.' || kind || '_run' as id, cast(n as bigint) as count, cast(alphabet as bigint) as alphabet_size, cast(start as bigint) as start, case when kind = 'tag' then shown end as ascii_projection from runs where n >= case when kind = 'tag' then 16 else 8 end")
def kind_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.get_json_object("evidence", f"$.{k}")
    return detectors.runs(planted.texts(spark, sf_dir)).select("doc_id", "id", of("count").cast("long").alias("count"), of("alphabet_size").cast("long").alias("alphabet_size"), F.col("positions")[0].cast("long").alias("start"), of("ascii_projection").alias("ascii_projection"))


@query(
    f"with {planted.SCALARS}, marks as (select doc_id, pos, pos - lag(pos) over (partition by doc_id order by pos) as gap from scalars where cp in (8203, 8204, 8288, 8289, 8290, 8291, 8292, 65279) and not (pos = 0 and cp = 65279)) "
    "select doc_id, cast(count(*) as bigint) as count, cast(min(gap) as bigint) as character_interval from marks group by doc_id having count(*) >= 12 and min(gap) = max(gap) and min(gap) > 1"
)
def periodic_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.get_json_object("evidence", f"$.{k}").cast("long").alias(k)
    return detectors.periodic_insertion(planted.texts(spark, sf_dir)).select("doc_id", of("count"), of("character_interval"))


@query(
    f"with {planted.SQL}, parts as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\s', '  ', 'g'), '(^|[^0-9A-Za-z_-])([0-9A-Fa-f]{{8}}-([0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}})', 2)) as value, text from texts) "
    "select doc_id, value, cast(count(*) as bigint) as count, count(*) > 1 as repeated from parts group by doc_id, value"
)
def uuid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k, t: F.get_json_object("evidence", f"$.{k}").cast(t).alias(k)
    return detectors.uuids(planted.texts(spark, sf_dir)).select("doc_id", of("value", "string"), of("count", "long"), of("repeated", "boolean"))


@query(
    f"with {planted.SQL}, parts as (select doc_id, unnest(regexp_extract_all(text, '(?i)(^|[^0-9A-Za-z_])((?:generated\\s+by|watermark|provenance|tracking[-_ ]id|document[-_ ]id|author)\\s*[:=]\\s*[^\\r\\n<>]{{1,160}})', 2)) as marker from texts) select doc_id, marker as marker from parts"
)
def provenance_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.provenance_markers(planted.texts(spark, sf_dir))
    told = F.get_json_object("evidence", "$.escaped_marker")
    return rows.select("doc_id", F.replace(told, F.lit("\\n"), F.lit("\n")).alias("marker"))


@query(
    f"with {planted.SQL}, parts as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\s', '  ', 'g'), '(^|[^0-9A-Za-zÀ-ÿ_+/])([A-Za-z0-9+/]{{32,}}={{0,2}})($|[^0-9A-Za-zÀ-ÿ_+/=])', 2)) as value from texts) "
    "select doc_id, value, cast(length(value) as bigint) as character_count, cast(octet_length(from_base64(value)) as bigint) as base64_decoded_bytes from parts where length(value) % 4 = 0 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')"
)
def encoded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k, t: F.get_json_object("evidence", f"$.{k}").cast(t).alias(k)
    return detectors.encoded_candidates(planted.texts(spark, sf_dir)).select("doc_id", of("value", "string"), of("character_count", "long"), of("base64_decoded_bytes", "long"))


_REMOVABLE_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for _, found in characters.KIND_RANGES for a, b in found) + "]"


@query(f"with {planted.SQL} select doc_id, sha256(text) as raw_text_sha256, sha256(nfc_normalize(text)) as nfc_text_sha256, nfc_normalize(text) <> text as nfc_changed, sha256(regexp_replace(text, '{_REMOVABLE_CLASS}', '', 'g')) as formatting_removed_sha256, cast(length(text) - length(regexp_replace(text, '{_REMOVABLE_CLASS}', '', 'g')) as bigint) as formatting_removed_count from texts")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.text_hashes(planted.texts(spark, sf_dir))
    return rows.select("doc_id", "raw_text_sha256", "nfc_text_sha256", "nfc_changed", "formatting_removed_sha256", F.col("formatting_removed_count").cast("long").alias("formatting_removed_count"))


def _nfkc_sql(text: str) -> str:
    """NFKC of the planted texts: their few characters that compatibility forms change, and NFC."""
    for c in sorted({c for t in planted.TAILS for c in t if characters.changes_in_nfkc(ord(c))}):
        text = f"replace({text}, chr({ord(c)}), {planted._sql_text(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize({text})"


@query(f"with {planted.SQL}, forms as (select doc_id, text, {_nfkc_sql('text')} as nfkc from texts) select doc_id, sha256(nfkc) as nfkc_text_sha256, nfkc <> text as nfkc_changed from forms")
def nfkc_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.text_hashes(planted.texts(spark, sf_dir)).select("doc_id", "nfkc_text_sha256", "nfkc_changed")


_ESCAPE_SQL = "case when ch = chr(92) then repeat(chr(92), 2) when cp = 9 then chr(92) || 't' when cp = 10 then chr(92) || 'n' when cp = 13 then chr(92) || 'r' when cp between 32 and 126 then ch when cp < 256 then chr(92) || 'x' || lpad(lower(hex(cp)), 2, '0') when cp < 65536 then chr(92) || 'u' || lpad(lower(hex(cp)), 4, '0') else chr(92) || 'U' || lpad(lower(hex(cp)), 8, '0') end"


@query(
    f"with {_INVENTORY_SQL}, firsts as (select doc_id, cp, pos from (select *, row_number() over (partition by doc_id, cp order by pos) as k from hits) where k <= 8) "
    f"select f.doc_id, 'U+' || lpad(hex(f.cp), cast(greatest(4, length(hex(f.cp))) as integer), '0') as code_point, cast(f.pos as bigint) as character_offset, (select string_agg(e, '' order by pos) from (select {_ESCAPE_SQL} as e, s.pos from scalars s where s.doc_id = f.doc_id and s.pos between f.pos - 16 and f.pos + 16)) as escaped_text from firsts f"
)
def first8_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    rows = scalars.inventory(texts).join(texts.select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", characters.label(F.col("cp")).alias("code_point"), F.inline(strings.contexts(F.col("text"), F.col("positions"))))
    return rows.withColumn("character_offset", F.col("character_offset").cast("long"))


#: Characters that compatibility forms change; with NFC this tells whether NFKC changes a text.
_COMPATIBLE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in characters.ranges([cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and characters.changes_in_nfkc(cp)])) + "]"
_RULES_SQL = {
    "unicode_inventory": ("'unicode.' || kind", "severity", "'unicode'"),
    "emoji_inventory": ("'unicode.emoji'", "'LOW'", "'unicode'"),
    "bom_findings": ("'text.bom'", "'INFO'", "'document_structure'"),
    "embedded_bom": ("'text.embedded_bom'", "'LOW'", "'document_structure'"),
    "mixed_script_tokens": ("'text.mixed_script'", "'LOW'", "'unicode'"),
    "zero_width_binary": ("'pattern.zero_width_binary'", "'HIGH'", "'possible_steganography'"),
    "kind_runs": ("id", "'MEDIUM'", "'possible_steganography'"),
    "periodic_insertion": ("'pattern.periodic_insertion'", "'MEDIUM'", "'possible_steganography'"),
    "uuid_identifiers": ("'identifier.uuid'", "'MEDIUM'", "'identifier'"),
    "provenance_markers": ("'provenance.text_marker'", "'LOW'", "'provenance'"),
    "encoded_candidates": ("'text.encoded_candidate'", "'INFO'", "'embedded_content'"),
}
_FINDINGS_SQL = "found as (" + " union all ".join([f"select doc_id, {rule} as id, {severity} as severity, {category} as category from ({ORACLE_SQL[name]})" for name, (rule, severity, category) in _RULES_SQL.items()] + [f"select doc_id, 'text.line_endings', 'LOW', 'document_structure' from ({ORACLE_SQL['line_endings']}) where mixed", f"select doc_id, 'unicode.normalization', 'INFO', 'unicode' from (with {planted.SQL} select doc_id from texts where nfc_normalize(text) <> text or regexp_matches(text, '{_COMPATIBLE}'))"]) + ")"
_UNPLANTED_SQL = _FINDINGS_SQL.replace(planted.SQL, "texts as (select doc_id, coalesce(text, '') as text, cast(null as varchar) as bom from documents)")


@query(
    f"with {_FINDINGS_SQL}, s as (select doc_id, count(*) as findings, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low, count(*) filter (where severity = 'INFO') as info, max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) as exit_code from found group by doc_id) "
    "select d.doc_id, " + ", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("findings", "high", "medium", "low", "info", "exit_code")) + " from documents d left join s on d.doc_id = s.doc_id"
)
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    return found_in.summaries(texts, detectors.all_findings(texts))


@query(f"with {_FINDINGS_SQL}, s as (select d.doc_id, coalesce(max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 when 'INFO' then 1 end), 0) as exit_code from documents d left join found f on d.doc_id = f.doc_id group by d.doc_id) select cast(exit_code as bigint) as exit_code, cast(count(*) as bigint) as documents from s group by exit_code")
def exit_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_summary(spark, sf_dir).groupBy("exit_code").agg(F.count(F.lit(1)).alias("documents"))


@query(f"with {_INVENTORY_SQL} select {_LABEL_SQL} as code_point, cast(sum(n) as bigint) as count from inventory group by cp order by sum(n) desc, cp limit 10")
def top_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scalars.inventory(planted.texts(spark, sf_dir)).groupBy("cp").agg(F.sum("count").alias("count"))
    return rows.orderBy(F.desc("count"), "cp").limit(10).select(characters.label(F.col("cp")).alias("code_point"), "count")


@query(
    f"with {_INVENTORY_SQL}, bytes as (select doc_id, cp, string_agg(cast(strlen(substr(text, 1, pos)) as varchar), ',' order by pos) as byte_offsets from hits join texts using (doc_id) group by doc_id, cp), "
    f"placed as (select doc_id, 'unicode.' || kind as id, positions, byte_offsets, row_number() over (partition by doc_id order by case {_SEVERITY_SQL} when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc, kind, '[' || byte_offsets || ']') - 1 as k from inventory join bytes using (doc_id, cp)) "
    "select doc_id, id, positions, byte_offsets, 'finding/' || k as finding_ref from placed"
)
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found_in.ordered_ranks(detectors.unicode_kinds(planted.texts(spark, sf_dir)))
    return rows.select("doc_id", "id", joined(), joined("byte_offsets"), "finding_ref")


def _by_rule(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "category", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


_BY_RULE_SQL = "select id, category, severity, cast(count(*) as bigint) as findings, cast(count(distinct doc_id) as bigint) as documents from found {} group by id, category, severity"


def _view_sql(view: str) -> str:
    return f"with {_FINDINGS_SQL} " + _BY_RULE_SQL.format(f"where category in ({', '.join(repr(c) for c in found_in.VIEWS[view])})")


@query(f"with {_FINDINGS_SQL} " + _BY_RULE_SQL.format(""))
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(detectors.all_findings(planted.texts(spark, sf_dir)))


@query(f"with {_UNPLANTED_SQL} " + _BY_RULE_SQL.format(""))
def unplanted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(detectors.all_findings(documents(spark, sf_dir)))


@query(_view_sql("unicode"))
def view_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(found_in.view(detectors.all_findings(planted.texts(spark, sf_dir)), "unicode"))


@query(_view_sql("metadata"))
def view_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(found_in.view(detectors.all_findings(planted.texts(spark, sf_dir)), "metadata"))


@query(_view_sql("structure"))
def view_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(found_in.view(detectors.all_findings(planted.texts(spark, sf_dir)), "structure"))
