"""Fixture text, not an operator: what the detectors look for, planted in the documents table.

The synthetic documents have no invisible or otherwise notable characters, so a query over them alone would
compare empty results.  Each document's text gets one of these tails (and some a leading mark) by its id; the same
projection is written in SQL for the other side of a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.sources.tables import documents

_ZW = "​‌"
TAILS = [
    " zero​width‌ join‍ed",
    " " + "".join(_ZW[(k // 2) % 2] for k in range(40)),
    " " + "ab⁠" * 14 + "end",
    " x" + "".join(chr(0xFE00 + k) for k in range(9)) + " " + "".join(chr(0xE0000 + ord(c)) for c in "hidden tag payload"),
    " soft­hyphen no break" + chr(0x2028) + chr(0x202E) + "abc" + chr(0x202C),
    " école å ﬁ Ω",
    " \U0001f469‍\U0001f4bb 1️⃣ 2 # *⃣ © 3️x",
    " pаypal Ωmegan мир plain αbc_жd 1а2b",
    " 123e4567-e89b-12d3-a456-426614174000, 123E4567-e89b-12d3-a456-426614174000 123e4567-e89b-12d3-a456-426614174000 x123e4567-e89b-12d3-a456-426614174001",
    "\nGenerated  by: tool X\nauthor = Jane Doe\nmywatermark: no\nTracking-ID:\n\n7\nwatermark :<\nprovenance=\n",
    " QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVoxMjM0NTY3ODkw QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVoxMjM0NTY3 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx",
    "\r\nwindows\rmac\nunix\r\n",
    " mid﻿mark" + chr(0x1F) + chr(0x180E),
    " bell\x07del\x7fnext\x85",
    " ordinary ending.",
    "",
]
MARK, MARKED = "﻿", 14  # documents with this remainder begin with a mark


def _sql_text(s: str) -> str:
    """A SQL string whose rarer characters are written by number."""
    out, plain = [], ""
    for c in s:
        if 0x20 <= ord(c) < 0x7F and c != "'":
            plain += c
        else:
            out += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    return " || ".join(out + [f"'{plain}'"] * (bool(plain) or not out))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of all documents with what is planted in them, and bom and encoding as a file's would be."""
    docs = documents(spark, sf_dir)
    which = F.pmod("doc_id", F.lit(len(TAILS)))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (which + 1).cast("int"))
    marked = which == MARKED
    text = F.concat(F.when(marked, MARK).otherwise(""), "text", tail)
    return docs.select("doc_id", text.alias("text"), F.when(marked, "efbbbf").alias("bom"), F.lit("utf-8").alias("encoding"))


SQL = (
    f"texts as (select doc_id, case when doc_id % {len(TAILS)} = {MARKED} then chr(65279) else '' end || coalesce(text, '') || case doc_id % {len(TAILS)} "
    + " ".join(f"when {k} then {_sql_text(t)}" for k, t in enumerate(TAILS))
    + f" end as text, case when doc_id % {len(TAILS)} = {MARKED} then 'efbbbf' end as bom from documents)"
)
#: Characters of the texts, with positions from 0.
SCALARS = SQL + ", chars as (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(0, length(text))) as pos from texts where text <> ''), scalars as (select doc_id, pos, ch, unicode(ch) as cp from chars)"


def sql_ranges(name: str, rows: list[tuple[int, int, str]]) -> str:
    return f"{name}(lo, hi, of) as (values {', '.join(f"({a}, {b}, '{v}')" for a, b, v in rows)})"
