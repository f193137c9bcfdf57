"""Rendering of notable characters, and line differences between texts and their renderings.

Texts are rendered in their rows: a text is cut at the characters that matter, and a constant table says what each is
rendered as.  Nothing is shuffled but for occurrences, which carry lengths and no text.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarium.functions import characters, strings
from scalarium.operators.scalars import byte_width, placed

OPEN, CLOSE = "⟦", "⟧"
_PAGE = 256


@cache
def _special() -> tuple[dict[int, tuple[str, str]], str, str]:
    """What each character is rendered as and why, without regard to keycaps; and classes of these, inside and whole.

    All controls and format characters but CR, LF and tab have a kind, so there is none that only display would escape.
    """
    marked = {cp: title for cp, _, _, title in characters.kind_rows()}
    marked |= {cp: characters.name(cp, "UNNAMED CONTROL") for cp in characters.emoji_points()}
    out = {cp: (f"{OPEN}U+{cp:04X} {title}{CLOSE}", "finding") for cp, title in marked.items()}
    out[ord(OPEN)] = (OPEN * 2, "literal_marker_escape")
    inside = characters.java_class(sorted(cp for cp in out if chr(cp) not in characters.KEYCAP_BASES))[1:-1]
    return out, inside, f"[{inside}]"


@cache
def _pages() -> str:
    """The renderings as JSON, an array for each 256 code points, so that one is found by its place."""
    told, _, _ = _special()
    pages = []
    for page in range(0x110000 // _PAGE):
        own = [told[cp][0] if cp in told else None for cp in range(page * _PAGE, (page + 1) * _PAGE)]
        pages.append(own if any(own) else None)
    return json.dumps(pages)


def rendering(char: Column) -> Column:
    """What a special character is rendered as; null for any other."""
    pages = F.from_json(F.lit(_pages()), "array<array<string>>")  # folded to a constant when the query is planned
    cp = characters.code_point(char)
    return F.get(F.get(pages, F.floor(cp / _PAGE).cast("int")), (cp % _PAGE).cast("int"))


def _parts(text: Column) -> Column:
    """A text cut into special characters and what lies between them."""
    inside = _special()[1]
    keycap = f"\\x{{{characters.EMOJI_STYLE:X}}}?\\x{{{characters.KEYCAP:X}}}"
    cut = lambda expression: F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    # bases of keycaps are cut off, but only those before a keycap are rendered: a base alone is marked by what follows it
    with_keycaps = cut(f"[^{inside}#*0-9]++|[#*0-9]+(?!{keycap})|[#*0-9]{keycap}|(?s:.)")
    return F.when(F.contains(text, F.lit(chr(characters.KEYCAP))), with_keycaps).otherwise(cut(f"[^{inside}]++|(?s:.)"))


def _shown(part: Column) -> Column:
    """A part as it is rendered: special characters, keycap sequences character by character, and the rest as it is."""
    base = F.left(part, F.lit(1)).isin(*characters.KEYCAP_BASES)
    keycap = base & F.endswith(part, F.lit(chr(characters.KEYCAP)))
    each = F.array_join(F.transform(strings.chars(part), lambda c: F.coalesce(rendering(c), c)), "")
    return F.when(keycap, each).when((F.length(part) == 1) & ~base, F.coalesce(rendering(part), part)).otherwise(part)


def revealed(texts: DataFrame) -> DataFrame:
    """doc_id, rendered: characters that a rule about single characters marks become ⟦U+XXXX NAME⟧, and a
    literal ⟦ is doubled."""
    return texts.select("doc_id", rendered(F.col("text")).alias("rendered"))


def rendered(text: Column) -> Column:
    return F.when(text.rlike(f"{_special()[2]}|\\x{{{characters.KEYCAP:X}}}"), F.array_join(F.transform(_parts(text), _shown), "")).otherwise(text)


def occurrences(texts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, reason, code_point, source_start, source_end, rendered_start, rendered_end (bytes), findings.

    A row for each character that is rendered otherwise or that a finding of `found` (with finding_ref) points at: the
    reason is finding, literal_marker_escape or finding_reference.  source bytes are those of the source's
    encoding, rendered ones of UTF-8.  findings holds reference, id, category, severity and classification of each.
    """
    whole = _special()[2]
    some = texts.filter(F.col("text").rlike(f"{whole}|\\x{{{characters.KEYCAP:X}}}"))
    if found is not None:
        at = found.select("doc_id", F.explode("positions").alias("pos"), F.struct("finding_ref", "id", "category", "severity", "classification").alias("finding"))
        refs = at.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
        # texts of which only findings speak are taken apart too
        some = texts.join(refs.select("doc_id").distinct().unionByName(some.select("doc_id")).distinct(), "doc_id", "left_semi")
    extra = ["encoding"] if "encoding" in texts.columns else []
    each = some.select("doc_id", *extra, F.posexplode(_parts(F.col("text"))).alias("k", "part"))
    each = each.select("doc_id", *extra, F.posexplode(strings.chars(F.col("part"))).alias("j", "ch"), "k", "part")
    base = F.col("ch").isin(*characters.KEYCAP_BASES)
    keycap = F.endswith("part", F.lit(chr(characters.KEYCAP))) & (F.length("part") > 1) & F.left("part", F.lit(1)).isin(*characters.KEYCAP_BASES)
    shown = F.when(~base | keycap, rendering(F.col("ch")))
    reason = F.when(shown.isNull(), F.lit(None)).when(F.col("ch") == OPEN, "literal_marker_escape").otherwise("finding")
    rows = each.select("doc_id", F.struct("k", "j").alias("k"), "ch", reason.alias("reason"), F.lit(1).alias("chars"), byte_width(F.col("ch"), texts).alias("bytes"), F.octet_length(F.coalesce(shown, F.col("ch"))).alias("shown"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed(rows).withColumn("rendered_start", F.coalesce(F.sum("shown").over(before), F.lit(0)))
    if found is not None:
        rows = rows.join(refs, ["doc_id", "pos"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("findings").isNotNull(), "finding_reference")))
        links = F.coalesce("findings", F.array().cast(refs.schema["findings"].dataType))
    else:
        links = F.array().cast("array<struct<finding_ref:string,id:string,category:string,severity:string,classification:string>>")
    long = lambda c: c.cast("long")
    return rows.filter("reason is not null").select(
        "doc_id", "pos", "reason", characters.label(characters.code_point(F.col("ch"))).alias("code_point"), long(F.col("byte")).alias("source_start"), long(F.col("byte") + F.col("bytes")).alias("source_end"),
        long(F.col("rendered_start")).alias("rendered_start"), long(F.col("rendered_start") + F.col("shown")).alias("rendered_end"), links.alias("findings"),
    )


def display_escapes(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", strings.display_escaped(F.col("text")).alias("escaped"))


NO_NEWLINE = "\n\\ No newline at end of file"


def lines(text: Column) -> Column:
    """The lines of a text without their line feeds; a last line that has none ends in what a diff says about that."""
    parts = F.split(text, "\n")
    last = F.slice(parts, 1, F.size(parts) - 1)
    whole = F.concat(last, F.array(F.concat(F.element_at(parts, -1), F.lit(NO_NEWLINE))))
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), last).otherwise(whole)


def changed_runs(a: Column, b: Column) -> Column:
    """Runs of changed lines (s and the line after the last, e; from 0) of two equally long arrays of lines."""
    changed = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: F.get(a, k) != F.get(b, k))
    one = F.transform(
        F.array(F.when(F.size(a) > 0, changed).otherwise(F.array().cast("array<int>"))),
        lambda x: F.transform(
            F.array(F.filter(F.transform(x, lambda k, i: F.when((i == 0) | (k > F.get(x, i - 1) + 1), i)), lambda i: i.isNotNull())),
            lambda first: F.transform(first, lambda i, j: F.struct(F.get(x, i).alias("s"), (F.get(x, F.coalesce(F.get(first, j + 1), F.size(x)) - 1) + 1).alias("e"))),
        )[0],
    )
    return F.get(one, F.lit(0))


def regions(runs: Column, size: Column, context: int = 3) -> Column:
    """Runs of changed lines put together: start and end (from 0, end not included) with context, runs.

    A run joins the region before it if its context reaches that region's end.
    """
    begins = F.filter(F.transform(runs, lambda r, i: F.when((i == 0) | (r["s"] - context > F.get(runs, i - 1)["e"] + context), i)), lambda i: i.isNotNull())
    one = F.transform(
        F.array(begins),
        lambda first: F.transform(
            first,
            lambda i, j: F.transform(
                F.array(F.slice(runs, i + 1, F.coalesce(F.get(first, j + 1), F.size(runs)) - i)),
                lambda own: F.struct(F.greatest(F.get(own, F.lit(0))["s"] - context, F.lit(0)).alias("start"), F.least(F.element_at(own, -1)["e"] + context, size).alias("end"), own.alias("runs")),
            )[0],
        ),
    )
    return F.get(one, F.lit(0))


def hunks(pairs: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, start, end (lines from 1, end included), changed: regions of changed lines with context, overlapping ones merged.

    Lines are compared by position if both sides have as many; else all lines are one region.
    """
    rows = pairs.filter("before <> after").select("doc_id", F.array(F.struct(lines(F.col("before")).alias("a"), lines(F.col("after")).alias("b"))).alias("p"))
    told = F.transform("p", lambda p: _regions_of(p["a"], p["b"], context))[0]
    each = rows.select("doc_id", F.explode(told).alias("h"))
    changed = F.aggregate("h.runs", F.lit(0), lambda n, r: n + r["e"] - r["s"])
    return each.select("doc_id", (F.col("h.start") + 1).cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), changed.cast("long").alias("changed"))


def _regions_of(a: Column, b: Column, context: int) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    whole = F.array(F.struct(F.lit(0).alias("start"), most.alias("end"), F.array(F.struct(F.lit(0).alias("s"), most.alias("e"))).alias("runs")))
    by_line = F.transform(F.array(changed_runs(a, b)), lambda r: regions(r, F.size(a), context))[0]
    return F.when(F.size(a) == F.size(b), by_line).otherwise(whole)
