"""An audit of a corpus: a state for each source, a summary, and records that end in a completion marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarium.functions import identity
from scalarium.operators import detectors
from scalarium.operators import findings as found_in
from scalarium.sources.tables import checkpointed

STATES = ("no_reported_findings", "requires_review", "unsupported", "failed", "skipped", "canceled")
OUTPUT_BYTES = 128 << 20


def audited(parsed: DataFrame) -> DataFrame:
    """Findings of parsed files (doc_id, text, failure_code and what sources.decode adds): text rules, and a failure to parse as one finding."""
    good = parsed.filter("failure_code is null")
    failed = parsed.filter("failure_code is not null").select("doc_id", F.col("failure_code").alias("code"), F.col("failure.reason").alias("message"), F.col("failure.start").alias("start"), F.col("failure.end").alias("end"))
    return detectors.all_findings(good).unionByName(detectors.parser_failures(failed))


def state(failure: Column, findings: Column) -> Column:
    return F.when(failure == "format.unsupported", "unsupported").when(failure.isNotNull(), "failed").when(findings > 0, "requires_review").otherwise("no_reported_findings")


def entries(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, state, reason, exit_code and counts of findings of each source."""
    rows = found_in.summaries(parsed, found).join(parsed.select("doc_id", "failure_code"), "doc_id")
    of = state(F.col("failure_code"), F.col("findings"))
    code = F.when(of.isin("failed", "unsupported", "canceled"), found_in.FAILED).otherwise(F.col("exit_code")).cast("long")
    return rows.select("doc_id", of.alias("state"), F.col("failure_code").alias("reason"), code.alias("exit_code"), "findings", "high", "medium", "low", "info")


def summary(rows: DataFrame, discovery_complete: bool = True) -> DataFrame:
    """One row: state, entries, a count for each state, exit_code."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    told = rows.agg(F.count(F.lit(1)).alias("entries"), *counts, F.coalesce(F.max("exit_code"), F.lit(0)).alias("exit_code"))
    partial = F.lit(not discovery_complete) | (F.col("failed") > 0) | (F.col("unsupported") > 0)
    return told.select(F.when(F.col("canceled") > 0, "canceled").when(partial, "partial").otherwise("completed").alias("state"), "entries", *STATES, "exit_code")


def records(rows: DataFrame, discovery_complete: bool = True, order: str = "doc_id") -> DataFrame:
    """JSON lines with their order: a header, an entry for each source, and the summary that marks completion."""
    body = rows.select(F.col(order).cast("string").alias("_key"), F.lit(1).alias("part"), F.to_json(F.struct(F.lit("entry").alias("type"), *rows.columns)).alias("line"))
    end = summary(rows, discovery_complete).select(F.lit("").alias("_key"), F.lit(2).alias("part"), F.to_json(F.struct(F.lit("summary").alias("type"), F.col("*"))).alias("line"))
    start = rows.sparkSession.createDataFrame([("", 0, '{"type":"header","schema":"1.0","concurrency":1}')], "_key string, part int, line string")
    return start.unionByName(body).unionByName(end)


def digested(lines: DataFrame) -> DataFrame:
    """Adds the SHA-256 of each line's canonical JSON."""
    return lines.withColumn("canonical_sha256", F.sha2(identity.canonical_json(F.col("line")).cast("binary"), 256))


def within_budget(lines: DataFrame, keys: list[str], size: Column, budget: int = OUTPUT_BYTES) -> DataFrame:
    """Adds upto, the bytes of all lines so far in the order of the keys (nulls first), and fits.

    Lines are dealt by ranges of the keys; the running sum is taken within a range and added to what the ranges before
    hold, so no task gets all rows.  Where ranges end depends on a sample, so the dealt rows are checkpointed.
    """
    rows = checkpointed(lines.withColumn("_size", size.cast("long")).repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()))
    blocks = rows.groupBy("_block").agg(F.sum("_size").alias("_sum"))  # a row for each partition
    before = blocks.withColumn("_before", F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_block").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", within).join(F.broadcast(before), "_block").withColumn("upto", F.col("_in") + F.col("_before")).withColumn("fits", F.col("upto") <= budget).drop("_size", "_block", "_in", "_before")
