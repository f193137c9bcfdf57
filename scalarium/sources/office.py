"""Text scopes and metadata of Word and OpenDocument packages.

The relational part (relationships, content types, manifests) is in operators.packaging; what needs an XML part's
order and nesting runs here, a part at a time.  Scopes are tables of doc_id and text, so every detector takes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.operators import packaging
from scalarium.sources.packages import PackageError, parts, read_xml

#: Namespaces, relationship and content types, and property names of the formats.
WORD = {"http://schemas.openxmlformats.org/wordprocessingml/2006/main": "transitional", "http://purl.oclc.org/ooxml/wordprocessingml/main": "strict"}
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
MAIN_RELATION = ("http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument", "http://purl.oclc.org/ooxml/officeDocument/relationships/officeDocument")
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
ODF_OFFICE, ODF_TEXT = "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
ODF_MANIFEST = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
ODT_TYPE = "application/vnd.oasis.opendocument.text"
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
APP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
DC, TERMS = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
STORIES = {"document": "main", "hdr": "header", "ftr": "footer", "comments": "comments", "footnotes": "footnotes", "endnotes": "endnotes"}
ROLES = {"t": "text", "delText": "deleted_text", "instrText": "field_instruction", "delInstrText": "deleted_field_instruction"}
REVISIONS = ("ins", "del", "moveFrom", "moveTo")
PROJECTED = {(DC, "creator"): "creator", (DC, "identifier"): "document_id", (TERMS, "created"): "created", (TERMS, "modified"): "modified", (CORE, "lastModifiedBy"): "last_modified_by", (CORE, "revision"): "revision", (APP, "Application"): "application", (APP, "AppVersion"): "application_version", (APP, "Company"): "company", (APP, "Template"): "template"}
ODF_KNOWN = ("p", "h", "span", "a", "section", "list", "list-item", "list-header", "hidden-text", "hidden-paragraph", "conditional-text", "ruby", "ruby-base", "ruby-text", "note", "note-body", "note-citation", "tracked-changes", "changed-region", "deletion", "insertion", "format-change")
EXPANDED_SCALARS = 200_000
SCOPE = "source_id long, name string, scope int, story string, role string, paragraph int, text string, hidden boolean, code string"


class _Tree:
    def __init__(self, data: bytes):
        self.tokens = read_xml(data)
        self.elements = [t for t in self.tokens if t[0] == "element"]

    def above(self, element: int | None) -> Iterator[tuple]:
        """An element and what encloses it, inside out."""
        while element is not None:
            yield self.elements[element]
            element = self.elements[element][2]


def word_scopes(data: bytes) -> list[tuple]:
    """story, role, paragraph, text, hidden of stretches of text of one paragraph, role and revision state.

    Tabs, breaks and any other structure part stretches; text outside a run's text elements is no scope.
    """
    tree = _Tree(data)
    space, local = tree.elements[0][3], tree.elements[0][4]
    if space not in WORD or local not in STORIES:
        raise PackageError("word.structure")
    scopes: list[list] = []
    last = None
    for kind, element, parent, ns, name, _, value, *_ in tree.tokens:
        if kind == "element":
            inside_properties = any(e[3] == space and e[4] == "rPr" for e in tree.above(element))
            if not inside_properties and not (ns == space and (name == "r" or name in ROLES)):
                last = None
            continue
        holder = tree.elements[element]
        if holder[3] != space or holder[4] not in ROLES:
            if value.strip(" \t\r\n"):
                last = None
            continue
        paragraph = next((e[1] for e in tree.above(element) if e[3] == space and e[4] == "p"), None)
        revisions = tuple(e[1] for e in tree.above(element) if e[3] == space and e[4] in REVISIONS)
        foreign = tuple(e[1] for e in tree.above(element) if e[3] != space)
        run = next((e[1] for e in tree.above(element) if e[3] == space and e[4] == "r"), None)
        hidden = run is not None and "on" in (toggle(tree, run, space, "vanish"), toggle(tree, run, space, "webHidden"))
        key = (paragraph, ROLES[holder[4]], revisions, foreign)
        if last == key:
            scopes[-1][3] += value
            scopes[-1][4] |= hidden
        else:
            scopes.append([STORIES[local], ROLES[holder[4]], paragraph, value, hidden])
            last = key
    return [tuple(s) for s in scopes]


def toggle(tree: _Tree, run: int, space: str, name: str) -> str:
    """What a run's own properties say of a switch: on, off, unspecified, or unknown where they say it twice or oddly."""
    own = [e for e in tree.elements if e[2] == run and e[3] == space and e[4] == "rPr"]
    if len(own) != 1:
        return "unknown" if own else "unspecified"
    found = [e for e in tree.elements if e[2] == own[0][1] and e[3] == space and e[4] == name]
    if len(found) != 1:
        return "unknown" if found else "unspecified"
    one = found[0]
    filled = any(t[2] == one[1] if t[0] == "element" else t[1] == one[1] and t[6].strip(" \t\r\n") for t in tree.tokens)
    value = f"{{{space}}}val"
    if filled or any(k != value for k in one[5]):
        return "unknown"
    said = one[5].get(value, "true")
    told = {"true": "on", "1": "on", "false": "off", "0": "off"} | ({"on": "on", "off": "off"} if WORD[space] == "transitional" else {})
    return told.get(said, "unknown")


def non_negative(value: str) -> int | None:
    """A count as XML writes it; None if it isn't one or is beyond 64 bits."""
    plain = re.fullmatch(r"[ \t\r\n]*\+?([0-9]+)[ \t\r\n]*", value)
    return int(plain[1]) if plain and int(plain[1]) < 1 << 64 else None


def odt_scopes(data: bytes) -> list[tuple]:
    """As word_scopes() for content.xml: spaces, tabs and line breaks are expanded within their paragraph."""
    tree = _Tree(data)
    if (tree.elements[0][3], tree.elements[0][4]) != (ODF_OFFICE, "document-content"):
        raise PackageError("odt.structure")
    scopes: list[list] = []
    left = EXPANDED_SCALARS - sum(len(t[6]) for t in tree.tokens if t[0] == "text")
    last = None
    for kind, element, _, ns, name, attributes, value, *_ in tree.tokens:
        paragraph = next((e[1] for e in tree.above(element) if e[3] == ODF_TEXT and e[4] in ("p", "h")), None)
        if kind == "element":
            if ns == ODF_TEXT and name in ("s", "tab", "line-break"):
                count = non_negative(attributes.get(f"{{{ODF_TEXT}}}c", "1")) if name == "s" else 1
                if count is None or paragraph is None:
                    last = None
                    continue
                value = {"s": " ", "tab": "\t", "line-break": "\n"}[name] * count if count <= left else None
                if value is None:
                    raise PackageError("odt.resource_limit")
                left -= len(value)
            else:
                if not (ns == ODF_TEXT and name in ODF_KNOWN and name not in ("p", "h")):
                    last = None
                continue
        if paragraph is None:
            if value.strip(" \t\r\n"):
                last = None
            continue
        hidden = any(e[3] == ODF_TEXT and e[4] in ("hidden-text", "conditional-text") for e in tree.above(element))
        key = (paragraph, hidden)
        if last == key:
            scopes[-1][3] += value
        else:
            scopes.append(["main", "text", paragraph, value, hidden])
            last = key
    return [tuple(s) for s in scopes]


def metadata_properties(data: bytes) -> list[tuple]:
    """kind, key, value, occurrence of the projected properties of a core or app part."""
    tree = _Tree(data)
    root = tree.elements[0]
    kind = {(CORE, "coreProperties"): "core", (APP, "Properties"): "app"}.get((root[3], root[4]))
    if kind is None:
        raise PackageError("metadata.unsupported_root")
    out, seen = [], {}
    for e in tree.elements:
        if e[2] == 0 and (key := PROJECTED.get((e[3], e[4]))):
            value = "".join(t[6] for t in tree.tokens if t[0] == "text" and t[1] == e[1])
            out.append((kind, key, value, seen.get(key, 0)))
            seen[key] = seen.get(key, 0) + 1
    return out


def _per_part(rows: DataFrame, read, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, name, data in zip(batch.source_id, batch.name, batch.content, strict=True):
                try:
                    out += [(source, name, k, *r, None) for k, r in enumerate(read(bytes(data)))]
                except PackageError as e:
                    out.append((source, name, None, *[None] * (len(columns) - 4), str(e)))
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({c: "Int64" for c in ("scope", "paragraph", "property", "occurrence") if c in columns})

    return rows.select("source_id", "name", "content").mapInPandas(run, schema)


def docx_scopes(story_parts: DataFrame) -> DataFrame:
    return _per_part(story_parts, word_scopes, ["source_id", "name", "scope", "story", "role", "paragraph", "text", "hidden", "code"], SCOPE)


def odt_content_scopes(content_parts: DataFrame) -> DataFrame:
    return _per_part(content_parts, odt_scopes, ["source_id", "name", "scope", "story", "role", "paragraph", "text", "hidden", "code"], SCOPE)


def properties(metadata_parts: DataFrame) -> DataFrame:
    return _per_part(metadata_parts, metadata_properties, ["source_id", "name", "property", "kind", "key", "value", "occurrence", "code"], "source_id long, name string, property int, kind string, key string, value string, occurrence int, code string")


def declarations(xml_tokens: DataFrame, parts_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relationships, default and override content types as the tokens of a package's parts declare them."""
    at = lambda k: F.col("attributes")[k]
    rel = xml_tokens.filter((F.col("namespace") == RELATIONSHIPS) & (F.col("local") == "Relationship"))
    rel = rel.select("source_id", at("Id").alias("rel_id"), packaging.owner(F.col("name")).alias("source_part"), at("Type").alias("type"), F.coalesce(at("Target"), F.lit("")).alias("target"), F.coalesce(at("TargetMode"), F.lit("Internal")).alias("mode"))
    types = xml_tokens.filter((F.col("namespace") == TYPES) & (F.col("name") == "[Content_Types].xml"))
    defaults = types.filter("local = 'Default'").select("source_id", at("Extension").alias("extension"), at("ContentType").alias("content_type"))
    overrides = types.filter("local = 'Override'").select("source_id", at("PartName").alias("name"), at("ContentType").alias("content_type"))
    return packaging.resolved_relationships(rel, parts_table), defaults, overrides


def identified_docx(parts_table: DataFrame, xml_tokens: DataFrame) -> DataFrame:
    """source_id, part, variant, code: the main part of each Word package, or why there is none."""
    rel, defaults, overrides = declarations(xml_tokens, parts_table)
    main = rel.filter((F.col("source_part") == "") & F.col("type").isin(*MAIN_RELATION)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"), F.min("state").alias("state"))
    assigned = packaging.content_types(parts_table.filter("name is not null"), defaults, overrides).select("source_id", F.col("name").alias("part"), "content_type")
    root = xml_tokens.filter("element = 0 and kind = 'element'").select("source_id", F.col("name").alias("part"), "namespace", "local")
    rows = parts_table.select("source_id").distinct().join(main, "source_id", "left").join(assigned, ["source_id", "part"], "left").join(root, ["source_id", "part"], "left")
    variant = F.when(F.col("namespace") == list(WORD)[0], WORD[list(WORD)[0]]).when(F.col("namespace") == list(WORD)[1], WORD[list(WORD)[1]])
    code = F.when(F.col("n").isNull(), "docx.main_relationship_missing").when(F.col("n") > 1, "docx.main_relationship_ambiguous").when(F.col("state") != "resolved", F.concat(F.lit("docx.main_part_"), F.col("state"))).when(~F.coalesce(F.col("content_type") == MAIN_TYPE, F.lit(False)), "docx.main_content_type").when(variant.isNull() | (F.col("local") != "document"), "docx.main_root")
    return rows.select("source_id", F.when(code.isNull(), F.col("part")).alias("part"), F.when(code.isNull(), variant).alias("variant"), code.alias("code"))


def identified_odt(parts_table: DataFrame, xml_tokens: DataFrame) -> DataFrame:
    """source_id, code (null for an OpenDocument text): its mimetype part, manifest and content."""
    kind = parts_table.filter("name = 'mimetype'").select("source_id", (F.col("content") == F.lit(ODT_TYPE).cast("binary")).alias("typed"), (F.col("method") == 0).alias("plain"))
    manifest = xml_tokens.filter((F.col("name") == "META-INF/manifest.xml") & (F.col("namespace") == ODF_MANIFEST))
    listed = manifest.filter("local = 'file-entry'").groupBy("source_id").agg(F.count_if(F.col("attributes")[f"{{{ODF_MANIFEST}}}full-path"] == "content.xml").alias("content"))
    sealed = manifest.filter("local = 'encryption-data'").select("source_id").distinct().withColumn("sealed", F.lit(True))
    body = xml_tokens.filter((F.col("name") == "content.xml") & (F.col("namespace") == ODF_OFFICE) & (F.col("local") == "text")).groupBy("source_id").agg(F.count(F.lit(1)).alias("bodies"))
    rows = parts_table.select("source_id").distinct()
    for other in (kind, listed, sealed, body):
        rows = rows.join(other, "source_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    code = F.when(no(F.col("typed")) | no(F.col("plain")), "odt.mimetype").when(F.col("sealed"), "odt.encrypted").when(no(F.col("content") == 1), "odt.manifest_content").when(no(F.col("bodies") == 1), "odt.text_body")
    return rows.select("source_id", code.alias("code"))


__all__ = ["parts"]
