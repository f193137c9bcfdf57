"""Queries over Word and OpenDocument packages, which are made from the conversations: a paragraph for each turn."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.operators import detectors
from scalarium.operators import findings as found_in
from scalarium.plans import planted
from scalarium.plans.queries import _BY_RULE_SQL, _FINDINGS_SQL, _by_rule, query
from scalarium.sources import office
from scalarium.sources.packages import tokens

XML_NAMES = r"(\.xml|\.rels)$"
#: Tails of the planted texts that XML can hold as they are.
_PLAIN_TAILS = [k for k, t in enumerate(planted.TAILS) if all(c in "\t\n" or ord(c) >= 0x20 for c in t)]


def _packages(spark: SparkSession, sf_dir: str, files: Callable[[int, list[str]], list[tuple[str, str, bool]]]) -> DataFrame:
    """source_id, content: a package for each conversation, of what `files` makes of its id and texts: name, data, whether deflated."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    texts = F.transform("turns", lambda t: F.coalesce(t["text"], F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for source, told in zip(batch.source_id, batch.texts, strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for name, data, deflated in files(int(source), list(told)):
                        z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED)
                made.append(buffer.getvalue())
            yield pd.DataFrame({"source_id": batch.source_id, "content": made})

    return turns.select(F.col("conv_id").alias("source_id"), texts.alias("texts")).mapInPandas(run, "source_id long, content binary")


def _word_files(source: int, texts: list[str], paragraph: Callable[[str], str]) -> list[tuple[str, str, bool]]:
    """A Word package: every sixth strict, without a main relationship, with two, or of another content type."""
    kind = source % 6
    word = list(office.WORD)[kind == 2]
    relation = f"<Relationship Id='r{{}}' Type='{office.MAIN_RELATION[kind == 2]}' Target='word/document.xml'/>"
    relations = "".join(relation.format(k) for k in range({3: 0, 4: 2}.get(kind, 1)))
    main = "application/xml" if kind == 5 else office.MAIN_TYPE
    body = "".join(map(paragraph, texts))
    core = f"<c:coreProperties xmlns:c='{office.CORE}' xmlns:d='{office.DC}' xmlns:t='{office.TERMS}'><d:creator>user {source}</d:creator><d:creator>second</d:creator><c:revision>{source % 7}</c:revision><t:created>2024-01-0{1 + source % 9}</t:created><c:other>x</c:other></c:coreProperties>"
    return [
        ("[Content_Types].xml", f"<Types xmlns='{office.TYPES}'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Override PartName='/word/document.xml' ContentType='{main}'/></Types>", True),
        ("_rels/.rels", f"<Relationships xmlns='{office.RELATIONSHIPS}'>{relations}</Relationships>", True),
        ("docProps/core.xml", core, True),
        ("word/document.xml", f"<w:document xmlns:w='{word}'><w:body>{body}</w:body></w:document>", True),
    ]


def _several_runs(text: str) -> str:
    """A paragraph of two runs that are one stretch of text, a hidden one behind a tab, and a deleted one."""
    half = len(text) // 2
    run = "<w:r>{}<w:t xml:space='preserve'>{}</w:t></w:r>"
    return f"<w:p>{run.format('', escape(text[:half]))}{run.format('<w:rPr><w:b/></w:rPr>', escape(text[half:]))}{run.format('<w:rPr><w:vanish/></w:rPr><w:tab/>', 'note')}<w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>"


def _word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.parts(_packages(spark, sf_dir, lambda source, texts: _word_files(source, texts, _several_runs)))


@query(
    "with turns as (select conv_id, turn, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, text nulls first) as k from conversations where conv_id is not null), "
    "parts as (select conv_id, k, 0 as part, 'text' as role, text, false as hidden from turns where text <> '' union all select conv_id, k, 1, 'text', 'note', true from turns union all select conv_id, k, 2, 'deleted_text', 'old', false from turns) "
    "select conv_id as source_id, cast(row_number() over (partition by conv_id order by k, part) - 1 as bigint) as scope, 'main' as story, role, hidden, sha256(text) as text_sha256 from parts"
)
def docx_text_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = office.docx_scopes(_word(spark, sf_dir).filter("name = 'word/document.xml'"))
    return rows.select("source_id", F.col("scope").cast("long").alias("scope"), "story", "role", "hidden", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(
    "select distinct conv_id as source_id, case when conv_id % 6 < 3 then 'word/document.xml' end as part, case when conv_id % 6 = 2 then 'strict' when conv_id % 6 < 2 then 'transitional' end as variant, "
    "case conv_id % 6 when 3 then 'docx.main_relationship_missing' when 4 then 'docx.main_relationship_ambiguous' when 5 then 'docx.main_content_type' end as code from conversations where conv_id is not null"
)
def docx_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _word(spark, sf_dir)
    return office.identified_docx(parts, tokens(parts.filter(F.col("name").rlike(XML_NAMES))))


_PROPERTIES_SQL = "ids as (select distinct conv_id as source_id from conversations where conv_id is not null), properties as (" + " union all ".join(f"select source_id, '{key}' as key, {value} as value, {n} as occurrence from ids" for key, value, n in (("creator", "'user ' || source_id", 0), ("creator", "'second'", 1), ("revision", "cast(source_id % 7 as varchar)", 0), ("created", "'2024-01-0' || (1 + source_id % 9)", 0))) + ")"


@query(f"with {_PROPERTIES_SQL} select source_id, key, value, cast(occurrence as bigint) as occurrence from properties")
def office_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = office.properties(_word(spark, sf_dir).filter("name = 'docProps/core.xml'"))
    return rows.select("source_id", "key", "value", F.col("occurrence").cast("long").alias("occurrence"))


@query(f"with {_PROPERTIES_SQL} select source_id as doc_id, 'metadata.present' as id, 'INFO' as severity, key || ' metadata present' as title, key, value from properties where occurrence = 0")
def metadata_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = office.properties(_word(spark, sf_dir).filter("name = 'docProps/core.xml'")).filter("occurrence = 0")
    entries = rows.groupBy(F.col("source_id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    of = lambda k: F.get_json_object("evidence", f"$.{k}").alias(k)
    return detectors.metadata(entries).select("doc_id", "id", "severity", "title", of("key"), of("value"))


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of Word packages as texts (doc_id, text); what is planted stands behind each turn."""

    def files(source: int, texts: list[str]) -> list[tuple[str, str, bool]]:
        tail = planted.TAILS[source % len(planted.TAILS)] if source % len(planted.TAILS) in _PLAIN_TAILS else ""
        return _word_files(source, [t + tail for t in texts], lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{escape(t)}</w:t></w:r></w:p>")

    parts = office.parts(_packages(spark, sf_dir, files)).filter("name = 'word/document.xml'")
    return office.docx_scopes(parts).select((F.col("source_id") * 4096 + F.col("scope")).alias("doc_id"), "text")


_TAIL_SQL = f"case conv_id % {len(planted.TAILS)} " + " ".join(f"when {k} then {planted._sql_text(planted.TAILS[k])}" for k in _PLAIN_TAILS) + " else '' end"
_SCOPES_SQL = f"texts as (select conv_id * 4096 + row_number() over (partition by conv_id order by turn, text nulls first) - 1 as doc_id, coalesce(text, '') || {_TAIL_SQL} as text, cast(null as varchar) as bom from conversations where conv_id is not null and coalesce(text, '') || {_TAIL_SQL} <> '')"


@query(f"with {_FINDINGS_SQL.replace(planted.SQL, _SCOPES_SQL)} " + _BY_RULE_SQL.format(""))
def scope_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rules find in the text scopes of Word packages."""
    return _by_rule(found_in.union([detectors.all_findings(_scopes(spark, sf_dir))]))


def _odt_files(source: int, texts: list[str]) -> list[tuple[str, str, bool]]:
    """An OpenDocument text: every fifth of another type, with a deflated type, encrypted, or without its content in the manifest."""
    kind = source % 5
    body = "".join(f"<t:p>{escape(x)}<t:s t:c='3'/>x<t:tab/>y<t:line-break/></t:p>" for x in texts)
    entry = lambda path, more="": f"<m:file-entry m:full-path='{path}' m:media-type='text/xml'>{more}</m:file-entry>"
    listed = "" if kind == 4 else entry("content.xml", "<m:encryption-data/>" if kind == 3 else "")
    return [
        ("mimetype", "text/plain" if kind == 1 else office.ODT_TYPE, kind == 2),
        ("META-INF/manifest.xml", f"<m:manifest xmlns:m='{office.ODF_MANIFEST}'>{entry('/')}{listed}</m:manifest>", True),
        ("content.xml", f"<o:document-content xmlns:o='{office.ODF_OFFICE}' xmlns:t='{office.ODF_TEXT}'><o:body><o:text>{body}</o:text></o:body></o:document-content>", True),
    ]


@query(
    "with turns as (select conv_id, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, text nulls first) - 1 as k from conversations where conv_id is not null) "
    "select conv_id as source_id, cast(k as bigint) as scope, sha256(text || '   x' || chr(9) || 'y' || chr(10)) as text_sha256 from turns"
)
def odt_text_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = office.odt_content_scopes(office.parts(_packages(spark, sf_dir, _odt_files)).filter("name = 'content.xml'"))
    return rows.select("source_id", F.col("scope").cast("long").alias("scope"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("select distinct conv_id as source_id, case conv_id % 5 when 1 then 'odt.mimetype' when 2 then 'odt.mimetype' when 3 then 'odt.encrypted' when 4 then 'odt.manifest_content' end as code from conversations where conv_id is not null")
def odt_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = office.parts(_packages(spark, sf_dir, _odt_files))
    return office.identified_odt(parts, tokens(parts.filter(F.col("name").rlike(XML_NAMES))))
