"""Unified diffs of texts and their renderings, line by line at equal positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.functions import strings
from scalarium.operators.reveal import _regions_of, lines, rendered

#: Names of the two sides of a faithful diff and of one for display.
FAITHFUL, DISPLAY = ("a/decoded.txt", "b/revealed.txt"), ("a/escaped-decoded.txt", "b/escaped-revealed.txt")


def _prefixed(mark: str, some: Column, start: Column, end: Column) -> Column:
    return F.transform(F.slice(some, start + 1, end - start), lambda x: F.concat(F.lit(mark), x))


def _hunk(a: Column, b: Column, h: Column) -> Column:
    """A region as text: the lines around and between its runs, and of each run the old lines and then the new ones."""
    runs = h["runs"]
    body = F.flatten(
        F.transform(
            runs,
            lambda r, j: F.concat(
                _prefixed(" ", a, F.when(j == 0, h["start"]).otherwise(F.get(runs, j - 1)["e"]), r["s"]),
                _prefixed("-", a, r["s"], F.least(r["e"], F.size(a))),
                _prefixed("+", b, r["s"], F.least(r["e"], F.size(b))),
            ),
        )
    )
    body = F.concat(body, _prefixed(" ", a, F.element_at(runs, -1)["e"], F.greatest(h["end"], F.element_at(runs, -1)["e"])))
    size = lambda x: F.greatest(F.least(h["end"], F.size(x)) - h["start"], F.lit(0))
    head = lambda x: F.concat(F.when(size(x) == 0, h["start"]).otherwise(h["start"] + 1), F.lit(","), size(x))
    return F.concat(F.lit("@@ -"), head(a), F.lit(" +"), head(b), F.lit(" @@\n"), F.array_join(body, "\n"), F.lit("\n"))


def unified(pairs: DataFrame, names: tuple[str, str] = FAITHFUL, context: int = 3) -> DataFrame:
    """doc_id, diff: a unified diff of each pair (doc_id, before, after), empty if both are equal.

    Lines are compared by position when both sides have as many, in regions with context; else everything is one
    region.  A region's changed lines that follow one another stand together, the old ones first.  All in the row.
    """
    both = F.array(F.struct(lines(F.col("before")).alias("a"), lines(F.col("after")).alias("b")))
    text = F.transform(both, lambda p: F.array_join(F.transform(_regions_of(p["a"], p["b"], context), lambda h: _hunk(p["a"], p["b"], h)), ""))[0]
    head = F.lit(f"--- {names[0]}\n+++ {names[1]}\n")
    return pairs.select("doc_id", F.when(F.col("before") == F.col("after"), "").otherwise(F.concat(head, text)).alias("diff"))


def compared(texts: DataFrame) -> DataFrame:
    """doc_id, faithful, display: the diff of each text and its rendering, and that of both in their ASCII form."""
    pairs = texts.select("doc_id", F.col("text").alias("before"), rendered(F.col("text")).alias("after"))
    faithful = unified(pairs).withColumnRenamed("diff", "faithful")
    escaped = pairs.select("doc_id", *(strings.display_escaped(F.col(c)).alias(c) for c in ("before", "after")))
    display = unified(escaped, DISPLAY).withColumnRenamed("diff", "display")
    return faithful.join(display, "doc_id")
