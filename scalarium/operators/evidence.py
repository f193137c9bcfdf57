"""The evidence graph as tables, and what must hold of it.

Executions, artifacts, anchors, results and diagnostics are rows with references within a source.  Each check gives
the rows that break it, so a valid graph has empty checks; none needs more than equi-joins on (source_id, reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of spans.
SPAN_SCALARS, GROUP_SPANS, GROUP_SCALARS = 16_384, 512, 16_384
SKIPPED = ("disabled", "unavailable", "prerequisite", "unsupported", "policy")
STATES = ("completed", "partial", "failed", "canceled", "incomplete")


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str = "ref") -> DataFrame:
    """Rows whose reference names nothing of the same source."""
    known = targets.select("source_id", F.col(target).alias(column))
    return rows.filter(F.col(column).isNotNull()).join(known, ["source_id", column], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans (source_id, start, end) that no region of the source contains.

    Regions that touch are merged first, so a span is contained if one that begins at or before it reaches its end: that
    is found by sorting both together, not by comparing all pairs.  Nothing contains a span with a null, and a region
    with one contains nothing.
    """
    merged = merged_regions(regions).filter("source_id is not null and start is not null")
    both = merged.select("source_id", "start", "end", F.lit(0).alias("is_span"), F.lit(None).cast("long").alias("span_end")).unionByName(spans.select("source_id", "start", F.lit(None).cast("long").alias("end"), F.lit(1).alias("is_span"), F.col("end").cast("long").alias("span_end")))
    order = Window.partitionBy("source_id").orderBy("start", "is_span").rowsBetween(Window.unboundedPreceding, 0)
    reach = both.withColumn("reach", F.max("end").over(order))
    inside = F.col("source_id").isNotNull() & (F.col("reach") >= F.col("span_end"))
    return reach.filter((F.col("is_span") == 1) & ~F.coalesce(inside, F.lit(False))).select("source_id", "start", F.col("span_end").alias("end"))


def merged_regions(regions: DataFrame, key: str = "source_id") -> DataFrame:
    """Regions of each source in order, those that touch or overlap merged.  Nulls come last.

    Equal regions are numbered in one order: both windows read rows as one sort left them, so the first of them begins a
    merged region and the others join it, and those that touch nothing, as their end is null or before their start, stay apart.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)), 1).otherwise(0)
    return regions.withColumn("k", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(key, "k").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end")).drop("k")


def coverage_gaps(requested: DataFrame, covered: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources whose covered regions don't add up to exactly the requested ones."""
    a = merged_regions(requested, key)
    b = merged_regions(covered, key)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).select(key).distinct()


def why_not_run(flags: Column) -> Column:
    """The first of the reasons not to run that a struct of booleans holds."""
    return F.coalesce(*(F.when(flags[s], s) for s in SKIPPED))


def status(executions: DataFrame) -> DataFrame:
    """source_id, status of rows of source_id, stage, state, usable, optional.

    Disabled ones don't count.  A failed acquisition or parser fails the whole; then partial, canceled, incomplete.
    """
    run = executions.filter("state <> 'disabled'")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = run.groupBy("source_id").agg(
        has(F.col("stage").isin("acquisition", "parser") & (F.col("state") == "failed")).alias("broken"),
        has(F.col("state") == "partial").alias("partial"),
        has(F.col("state") == "canceled").alias("canceled"),
        has(F.col("state").isin("failed", "incomplete")).alias("incomplete"),
        has(F.col("usable")).alias("usable"),
        has(F.col("optional") & (F.col("state") == "failed")).alias("optional_failed"),
    )
    of = F.when(F.col("broken"), "failed").when(F.col("partial"), "partial").when(F.col("canceled"), F.when(F.col("usable"), "partial").otherwise("canceled"))
    return told.select("source_id", of.when(F.col("incomplete"), F.when(F.col("usable") | F.col("optional_failed"), "partial").otherwise("failed")).otherwise("completed").alias("status"))


def spans(positions: DataFrame) -> DataFrame:
    """Positions (source_id, ref, pos) as spans of adjoining ones, cut at 16,384 characters: source_id, ref, start, end."""
    order = Window.partitionBy("source_id", "ref").orderBy("pos")
    run = positions.withColumn("island", F.col("pos") - F.row_number().over(order))
    within = Window.partitionBy("source_id", "ref", "island").orderBy("pos")
    cut = run.withColumn("part", F.floor((F.row_number().over(within) - 1) / SPAN_SCALARS))
    return cut.groupBy("source_id", "ref", "island", "part").agg(F.min("pos").cast("long").alias("start"), (F.max("pos") + 1).cast("long").alias("end")).drop("island", "part")


def covering(text: Column) -> Column:
    """Spans of a whole text, as pairs in order, cut at 16,384 characters; none for an empty text."""
    size = F.length(text).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), size - 1, F.lit(SPAN_SCALARS).cast("long"))
    return F.when(size > 0, F.transform(starts, lambda a: F.array(a, F.least(a + SPAN_SCALARS, size)))).otherwise(F.array().cast("array<array<bigint>>"))


def span_groups(sizes: Column, most: int = GROUP_SPANS, scalars: int = GROUP_SCALARS) -> Column:
    """For an array of span lengths in order, the number of the group each belongs to: a new one begins where it would hold too many spans or characters."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        full = (s["n"] >= most) | ((s["n"] > 0) & (s["size"] + x > scalars))
        group = s["group"] + full.cast("int")
        return F.struct(group.alias("group"), (F.when(full, 0).otherwise(s["n"]) + 1).alias("n"), (F.when(full, 0).otherwise(s["size"]) + x).cast("long").alias("size"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def numbered(rows: DataFrame, prefix: str, order: list[str], key: str = "source_id") -> DataFrame:
    """Adds ref: prefix/0, prefix/1 and so on within a source."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("ref", F.concat(F.lit(prefix + "/"), place))
