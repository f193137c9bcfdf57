"""ZIP packages and XML parts as rows.

A package or a part is a value of a row and is read whole by one task, within fixed limits; what comes out are
tables that joins can work on.  What breaks a rule is a row with a code, never a failed job.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of packages and of parts.
PACKAGE_BYTES, PACKAGE_ENTRIES, PART_BYTES, TOTAL_BYTES, NAME_BYTES = 8 << 20, 4096, 32 << 20, 64 << 20, 1 << 20
XML_BYTES, XML_TOKENS, XML_ELEMENTS, XML_DEPTH, XML_ATTRIBUTES = 4 << 20, 100_000, 50_000, 128, 128

PARTS = "source_id long, name string, directory boolean, method int, crc32 long, compressed_sha256 string, sha256 string, content binary, code string"
TOKENS = "source_id long, name string, token int, kind string, element int, parent int, namespace string, local string, attributes map<string,string>, value string, start long, end long, code string"


class PackageError(ValueError):
    pass


def safe_name(name: str) -> bool:
    """Relative, without empty or dotted steps, drive letters, backslashes or controls."""
    steps = name.removesuffix("/").split("/")
    return bool(name) and "\\" not in name and ":" not in name and not re.search(r"[\x00-\x1f\x7f]", name) and all(s not in ("", ".", "..") for s in steps)


def read_package(data: bytes) -> list[tuple]:
    """Name, directory, method, CRC-32, SHA-256 of the stored and of the plain bytes, and these, of each entry by name.

    Only single-disk files without prefix, gaps or trailer, stored or deflated, unencrypted, with safe names that
    neither repeat nor stand for a file and a folder.
    """
    if len(data) > PACKAGE_BYTES:
        raise PackageError("package.too_large")
    if not data.startswith((b"PK\x03\x04", b"PK\x05\x06")):
        raise PackageError("package.prefix")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        entries = archive.infolist()
    except (zipfile.BadZipFile, struct.error, ValueError) as e:
        raise PackageError("package.invalid") from e
    if archive.comment or len(entries) > PACKAGE_ENTRIES or sum(len(e.filename.encode()) for e in entries) > NAME_BYTES:
        raise PackageError("package.comment" if archive.comment else "package.resource_limit")
    names = [e.filename for e in entries]
    plain = {n.rstrip("/") for n in names}
    if not all(map(safe_name, names)):
        raise PackageError("package.name")
    if len(plain) < len(names) or any("/".join(n.split("/")[:k]) in {x for x in names if not x.endswith("/")} for n in names for k in range(1, n.rstrip("/").count("/") + 1)):
        raise PackageError("package.name_collision")
    out, total, expected = [], 0, 0
    for e in sorted(entries, key=lambda e: e.header_offset):
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise PackageError("package.unsupported")
        if e.header_offset != expected:
            raise PackageError("package.gap")
        signature, _, flags, method, _, _, crc, stored, size, n, extra = struct.unpack_from("<4s5H3L2H", data, e.header_offset)
        if signature != b"PK\x03\x04" or method != e.compress_type or flags != e.flag_bits or data[e.header_offset + 30 : e.header_offset + 30 + n] != e.orig_filename.encode("utf-8" if e.flag_bits & 0x800 else "cp437"):
            raise PackageError("package.header_mismatch")
        if not flags & 8 and (crc, stored, size) != (e.CRC, e.compress_size, e.file_size):
            raise PackageError("package.header_mismatch")
        begin = e.header_offset + 30 + n + extra
        raw = data[begin : begin + e.compress_size]
        total += e.file_size
        if e.file_size > PART_BYTES or total > TOTAL_BYTES:
            raise PackageError("package.resource_limit")
        try:
            decoder = zlib.decompressobj(-15)
            content = raw if e.compress_type == zipfile.ZIP_STORED else decoder.decompress(raw, e.file_size + 1)
        except zlib.error as x:
            raise PackageError("package.invalid") from x
        if len(content) != e.file_size or zlib.crc32(content) != e.CRC:
            raise PackageError("package.checksum")
        expected = begin + e.compress_size
        if flags & 8:
            expected += 16 if data[expected : expected + 4] == b"PK\x07\x08" else 12
        out.append((e.filename, e.is_dir(), e.compress_type, e.CRC, hashlib.sha256(raw).hexdigest(), hashlib.sha256(content).hexdigest(), content))
    if entries and expected != archive.start_dir:
        raise PackageError("package.gap")
    return sorted(out, key=lambda r: r[0].encode())


def parts(packages: DataFrame) -> DataFrame:
    """Parts of packages (source_id, content); one row with a code for a package that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, data in zip(batch.source_id, batch.content, strict=True):
                try:
                    rows += [(source, *r, None) for r in read_package(bytes(data))]
                except PackageError as e:
                    rows.append((source, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source_id", "name", "directory", "method", "crc32", "compressed_sha256", "sha256", "content", "code"]).astype({"directory": "boolean", "method": "Int32", "crc32": "Int64"})

    return packages.select("source_id", "content").mapInPandas(run, PARTS)


def read_xml(data: bytes) -> list[tuple]:
    """Tokens of an XML part: elements (with parent, name, attributes) where they start, and character data.

    kind is element or text; element is an index in document order; start and end are byte places.  UTF-8 alone, no
    document types, and within limits.
    """
    if len(data) > XML_BYTES:
        raise PackageError("xml.resource_limit")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or (m := re.match(rb'<\?xml[^>]*encoding=["\']([^"\']+)', data)) and m[1].lower() not in (b"utf-8", b"us-ascii"):
        raise PackageError("xml.unsupported")
    parser = expat.ParserCreate("utf-8", namespace_separator="\x1f")
    parser.buffer_text = False
    out: list[tuple] = []
    stack: list[int] = []
    count = 0

    def split(name: str) -> tuple[str | None, str]:
        space, mark, local = name.rpartition("\x1f")
        return (space if mark else None), local

    def limit(hit: bool) -> None:
        if hit:
            raise PackageError("xml.resource_limit")

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal count
        limit(count >= XML_ELEMENTS or len(stack) >= XML_DEPTH or len(attributes) > XML_ATTRIBUTES or len(out) >= XML_TOKENS)
        space, local = split(name)
        at = parser.CurrentByteIndex
        told = {(f"{{{s}}}{a}" if s else a): v for (s, a), v in ((split(k), v) for k, v in attributes.items())}
        out.append(("element", count, stack[-1] if stack else None, space, local, told, None, at, None))
        stack.append(count)
        count += 1

    def text(value: str) -> None:
        limit(len(out) >= XML_TOKENS)
        at = parser.CurrentByteIndex
        if out and out[-1][0] == "text" and out[-1][1] == stack[-1]:
            kind, element, *rest, value_before, begin, _ = out[-1]
            out[-1] = (kind, element, *rest, value_before + value, begin, None)
        else:
            out.append(("text", stack[-1], None, None, None, None, value, at, None))

    def doctype(*_: object) -> None:
        raise PackageError("xml.unsupported")

    parser.StartElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, text, doctype
    parser.EndElementHandler = lambda _: stack.pop()
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise PackageError("xml.invalid") from e
    return out


#: The entities that XML itself names.
ENTITIES = {b"amp": "&", b"lt": "<", b"gt": ">", b"quot": '"', b"apos": "'"}


def scalar_map(data: bytes, start: int, value: str) -> list[tuple[str, int, int, str]]:
    """Character, first byte, byte after, and how it was written, of each character of a text that begins at a byte.

    literal, entity_reference, character_reference or line_ending (a CR or CRLF that became a line feed).  CDATA marks,
    comments and instructions between are passed over.
    """
    out: list[tuple[str, int, int, str]] = []
    at, plain = start, False
    while len(out) < len(value):
        if data.startswith(b"<![CDATA[", at) and not plain:
            at, plain = at + 9, True
        elif plain and data.startswith(b"]]>", at):
            at, plain = at + 3, False
        elif not plain and data[at : at + 1] == b"<":
            close = b"-->" if data.startswith(b"<!--", at) else b"?>" if data.startswith(b"<?", at) else b">"
            at = data.index(close, at) + len(close)
        elif not plain and data[at : at + 1] == b"&":
            end = data.index(b";", at) + 1
            name = data[at + 1 : end - 1]
            char = chr(int(name[2:], 16) if name[:2] == b"#x" else int(name[1:])) if name[:1] == b"#" else ENTITIES[name]
            out.append((char, at, end, "character_reference" if name[:1] == b"#" else "entity_reference"))
            at = end
        elif data[at : at + 1] == b"\r":
            end = at + 1 + (data[at + 1 : at + 2] == b"\n")
            out.append(("\n", at, end, "line_ending"))
            at = end
        else:
            lead = data[at]
            end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            out.append((data[at:end].decode(), at, end, "literal"))
            at = end
    if "".join(c for c, *_ in out) != value:
        raise PackageError("xml.map_mismatch")
    return out


def scalar_maps(xml_parts: DataFrame) -> DataFrame:
    """source_id, name, token, scalar, ch, start, end, how: where each character of the parts' texts was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, name, data in zip(batch.source_id, batch.name, batch.content, strict=True):
                data = bytes(data)
                try:
                    found = [(k, t) for k, t in enumerate(read_xml(data)) if t[0] == "text"]
                except PackageError:
                    continue  # tokens() has the row that says why
                rows = [(source, name, k, i, *c) for k, t in found for i, c in enumerate(scalar_map(data, t[7], t[6]))]
                yield pd.DataFrame(rows, columns=["source_id", "name", "token", "scalar", "ch", "start", "end", "how"])

    return xml_parts.select("source_id", "name", "content").mapInPandas(run, "source_id long, name string, token int, scalar int, ch string, start long, end long, how string")


def tokens(xml_parts: DataFrame) -> DataFrame:
    """Tokens of XML parts (source_id, name, content); one row with a code for a part that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_id", "name", "token", "kind", "element", "parent", "namespace", "local", "attributes", "value", "start", "end", "code"]
        for batch in batches:
            rows = []
            for source, name, data in zip(batch.source_id, batch.name, batch.content, strict=True):
                try:
                    found = read_xml(bytes(data))
                    ends = [t[7] for t in found[1:]] + [len(data)]
                    rows += [(source, name, k, *t[:8], end, None) for k, (t, end) in enumerate(zip(found, ends, strict=True))]
                except PackageError as e:
                    rows.append((source, name, None, None, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("token", "element", "parent", "start", "end")})

    return xml_parts.select("source_id", "name", "content").mapInPandas(run, TOKENS)
