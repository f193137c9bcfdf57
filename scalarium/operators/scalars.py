"""Texts as rows of characters, and the inventories of kinds and emoji over them.

Texts are a DataFrame with doc_id and text.  A text without any interesting character is left out by one regular
expression before it is taken apart, and the text itself never enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarium.functions import characters


def scalars(texts: DataFrame, containing: str | None = None) -> DataFrame:
    """doc_id, pos (from 0), ch, cp of each character; of texts that match an expression, if given."""
    if containing:
        texts = texts.filter(F.col("text").rlike(containing))
    each = texts.select("doc_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).filter("ch <> ''")
    return each.withColumn("cp", characters.code_point(F.col("ch")))


def byte_width(text: Column, texts: DataFrame) -> Column:
    """Bytes of a part of a text in the encoding of its source (a column `encoding`; UTF-8 without one)."""
    if "encoding" not in texts.columns:
        return F.octet_length(text)
    of = F.coalesce(F.col("encoding"), F.lit("utf-8"))
    wide = F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return F.when(of.startswith("utf-16"), 2 * wide).when(of.startswith("utf-32"), 4 * F.length(text)).otherwise(F.octet_length(text))


def placed(parts: DataFrame) -> DataFrame:
    """Rows of doc_id, k, chars, bytes and others with pos and byte, where each part of a text begins."""
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({"pos": F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("int"), "byte": F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("int")})


def marks(texts: DataFrame) -> DataFrame:
    """doc_id, pos, byte, cp, kind, name, match_basis of characters that have a kind or are emoji (keycap bases before a keycap alone).

    A text is cut at these characters, so the parts between them are a row each and single characters none; a shuffle
    carries lengths and code points.  A character both of a kind and an emoji is one row with both.
    """
    special, keycap = characters.special_class(), f"\\x{{{characters.EMOJI_STYLE:X}}}?\\x{{{characters.KEYCAP:X}}}"
    text = F.col("text")
    cut = lambda expression: F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    with_keycaps = cut(f"[^{special}#*0-9]++|[#*0-9]+(?!{keycap})|(?s:.)")
    parts = F.when(F.contains(text, F.lit(chr(characters.KEYCAP))), with_keycaps).otherwise(cut(f"[^{special}]++|(?s:.)"))
    extra = ["encoding"] if "encoding" in texts.columns else []
    each = texts.filter(text.rlike(f"[{special}]")).select("doc_id", *extra, F.posexplode(parts).alias("k", "part"))
    part = F.col("part")
    each = each.select("doc_id", "k", F.when(F.length(part) == 1, characters.code_point(part)).alias("cp"), F.length(part).alias("chars"), byte_width(part, texts).alias("bytes"))
    order = Window.partitionBy("doc_id").orderBy("k")
    rows = placed(each).withColumns({"next1": F.lead("cp", 1).over(order), "next2": F.lead("cp", 2).over(order)})
    base = F.col("cp").isin(*map(ord, characters.KEYCAP_BASES))
    before_keycap = F.coalesce(F.col("next1") == characters.KEYCAP, F.lit(False)) | F.coalesce((F.col("next1") == characters.EMOJI_STYLE) & (F.col("next2") == characters.KEYCAP), F.lit(False))
    found = rows.filter("cp is not null").join(characters.specials(texts.sparkSession), "cp").filter(~base | before_keycap)
    basis = F.when(F.col("is_emoji"), F.when(base, "keycap_base").otherwise("unicode_emoji_property"))
    return found.select("doc_id", "pos", "byte", "cp", "kind", "name", basis.alias("match_basis"))


def classified(texts: DataFrame) -> DataFrame:
    """doc_id, pos, byte, cp, kind, name of characters that have a kind."""
    return marks(texts).filter("kind is not null").drop("match_basis")


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, count, positions and byte_offsets of rows with pos and byte."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(F.struct("pos", "byte"))).alias("at"))
    return found.withColumns({"positions": F.col("at.pos"), "byte_offsets": F.col("at.byte")}).drop("at")


def inventory(texts: DataFrame) -> DataFrame:
    """doc_id, cp, kind, name, count, positions, byte_offsets: a row for each code point with a kind of each text."""
    return gathered(classified(texts), ["doc_id", "cp", "kind", "name"])


def emoji_occurrences(texts: DataFrame) -> DataFrame:
    """doc_id, pos, byte, cp, name, match_basis; keycap bases count only before a keycap."""
    return marks(texts).filter("match_basis is not null").drop("kind")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `island`, equal for rows of equal keys at consecutive positions."""
    return rows.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
