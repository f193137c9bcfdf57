"""Text functions on columns: escapes, periods, Base64, locations, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scalarium.functions import characters


def chars(text: Column) -> Column:
    """The characters of a string, none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _hex(cp: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(cp.cast("long"))), width, "0")


def escaped(text: Column) -> Column:
    """Backslash escapes for everything but printable ASCII: two, four or eight hexadecimal digits."""

    def one(c: Column) -> Column:
        cp = F.ascii(c)
        return (
            F.when(c == "\\", "\\\\")
            .when(c == "\t", "\\t")
            .when(c == "\n", "\\n")
            .when(c == "\r", "\\r")
            .when(cp.between(0x20, 0x7E), c)
            .when(cp < 0x100, F.concat(F.lit("\\x"), _hex(cp, 2)))
            .when(cp < 0x10000, F.concat(F.lit("\\u"), _hex(cp, 4)))
            .otherwise(F.concat(F.lit("\\U"), _hex(cp, 8)))
        )

    # only what lies outside plain runs is looked at by itself
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[ -\[\]-~]++|(?s:.)"), F.lit(0)), lambda p: F.when(F.length(p) > 1, p).otherwise(one(p))), "")


def display_escaped(text: Column) -> Column:
    """An ASCII form for display: line feeds stay, CR, tab and backslash have short escapes, others `\\u{HEX}`."""

    def one(c: Column) -> Column:
        cp = F.ascii(c)
        digits = F.hex(cp.cast("long"))
        return (
            F.when(c == "\\", "\\\\")
            .when(c == "\t", "\\t")
            .when(c == "\r", "\\r")
            .when((c == "\n") | cp.between(0x20, 0x7E), c)
            .otherwise(F.concat(F.lit("\\u{"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit("}")))
        )

    parts = F.regexp_extract_all(text, F.lit(r"[\n -\[\]-~]++|(?s:.)"), F.lit(0))
    shown = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > 1, p).otherwise(one(p))), "")
    return F.when(text.rlike(r"[^\n -\[\]-~]"), shown).otherwise(text)


def period(sequence: Column) -> Column:
    """The smallest period of at most 32 and of a third of the string's length; null without one."""
    n = F.length(sequence)
    most = F.least(F.lit(32), F.floor(n / 3).cast("int"))
    fits = lambda p: F.substr(sequence, p + 1, n - p) == F.substr(sequence, F.lit(1), n - p)
    return F.when(most >= 1, F.get(F.filter(F.sequence(F.lit(1), most), fits), F.lit(0)))


def contexts(text: Column, positions: Column, most: int = 8, around: int = 16) -> Column:
    """Escaped surroundings of the first positions."""

    def one(p: Column) -> Column:
        start = F.greatest(p - around, F.lit(0))
        return F.struct(p.alias("character_offset"), escaped(F.substr(text, start + 1, p + around + 1 - start)).alias("escaped_text"))

    return F.transform(F.slice(positions, 1, most), one)


def byte_offsets(text: Column, positions: Column) -> Column:
    """UTF-8 byte offsets of characters: for few positions per text."""
    return F.transform(positions, lambda p: F.octet_length(F.substr(text, F.lit(1), p)).cast("int"))


def formatting_removed(text: Column) -> Column:
    return F.regexp_replace(text, characters.removable_class(), "")


def decoded_size(token: Column) -> Column:
    """Bytes of strict Base64, null if it isn't."""
    return F.when(F.length(token) % 4 == 0, F.octet_length(F.try_to_binary(token, F.lit("base64"))))


def line_endings(text: Column) -> Column:
    """CRLF, and CR and LF that aren't part of one."""
    pairs = F.regexp_count(text, F.lit("\r\n"))
    return F.struct(pairs.alias("crlf"), (F.regexp_count(text, F.lit("\r")) - pairs).alias("cr"), (F.regexp_count(text, F.lit("\n")) - pairs).alias("lf"))


def _normal(form: str, text: Column) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    # ASCII is its own normal form and needs no Python
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(run(F.when(F.octet_length(text) != F.length(text), text)))


def nfc(text: Column) -> Column:
    return _normal("NFC", text)


def nfkc(text: Column) -> Column:
    return _normal("NFKC", text)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity.isin("LOW", "INFO"), 1).otherwise(0)


def order_rank(severity: Column) -> Column:
    """As severity_rank, but INFO after LOW: findings are put in this order."""
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0)


def ascii_fold(text: Column) -> Column:
    """A to Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
