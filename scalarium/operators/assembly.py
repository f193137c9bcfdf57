"""The evidence graph of an audit: capabilities, executions, artifacts, anchors and results as tables.

Every source has the same capabilities, so their table is a handful of rows crossed with the sources' keys; all
other tables come from parsed files and their findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.operators import evidence

#: Capabilities in stage order: id, stage, what it needs, whether it runs, whether an audit does without.
CAPABILITIES = [
    ("acquire.file", "acquisition", None, True, False),
    ("parse.text", "parser", "acquire.file", True, False),
    ("analyze.unicode", "analysis", "parse.text", True, True),
    ("analyze.emoji", "analysis", "parse.text", True, True),
    ("analyze.text", "analysis", "parse.text", True, True),
    ("analyze.patterns", "analysis", "parse.text", True, True),
    ("analyze.identifiers", "analysis", "parse.text", True, True),
    ("analyze.metadata", "analysis", "parse.text", True, True),
    ("verify.provenance", "verification", "parse.text", False, True),
    ("analyze.statistical", "statistical", "parse.text", False, True),
    ("compare.fingerprint", "comparison", "parse.text", False, True),
]
RULES = {"unicode.emoji": "analyze.emoji", "unicode.": "analyze.unicode", "text.encoded": "analyze.identifiers", "text.": "analyze.text", "pattern.": "analyze.patterns", "identifier.": "analyze.identifiers", "provenance.": "analyze.identifiers", "metadata.": "analyze.metadata", "parser.": "parse.text"}


def capability_of(rule: str):
    out = None
    for prefix, capability in RULES.items():
        hit = F.col(rule).startswith(prefix)
        out = F.when(hit, capability) if out is None else out.when(hit, capability)
    return out


def executions(parsed: DataFrame) -> DataFrame:
    """source_id, ref, capability, stage, state, reason, usable, optional for each source (doc_id, failure_code) and capability.

    Acquisition fails on file codes, the parser on all others, and what follows a failure isn't run.
    """
    spark = parsed.sparkSession
    known = spark.createDataFrame([(k, *c) for k, c in enumerate(CAPABILITIES)], "place int, capability string, stage string, needs string, enabled boolean, optional boolean")
    rows = parsed.select(F.col("doc_id").alias("source_id"), F.col("failure_code")).crossJoin(F.broadcast(known))  # eleven rows a source
    broken = F.col("failure_code").isNotNull()
    at_read = F.coalesce(F.col("failure_code").startswith("file."), F.lit(False))
    state = (
        F.when(~F.col("enabled"), "disabled")
        .when(broken & at_read & (F.col("stage") == "acquisition"), "failed")
        .when(broken & ~at_read & (F.col("stage") == "parser"), "failed")
        .when(broken & ((F.col("stage") == "analysis") | (at_read & (F.col("stage") == "parser"))), "not_run")
        .otherwise("completed")
    )
    reason = F.when(state == "failed", F.col("failure_code")).when(state == "not_run", "prerequisite").when(state == "disabled", "disabled")
    told = rows.select("source_id", "place", "capability", "stage", state.alias("state"), reason.alias("reason"), ((state == "completed") & (F.col("stage") != "acquisition")).alias("usable"), "optional")
    return told.withColumn("ref", F.concat(F.lit("exec/"), F.col("place"))).drop("place")


def artifacts(parsed: DataFrame) -> DataFrame:
    """source_id, ref, kind, sha256, parent: the bytes of each source and, where it was decoded, its text."""
    key = F.col("doc_id").alias("source_id")
    sources = parsed.select(key, F.lit("artifact/0").alias("ref"), F.lit("source").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(None).cast("string").alias("parent"))
    texts = parsed.filter("failure_code is null").select(key, F.lit("artifact/1").alias("ref"), F.lit("text").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit("artifact/0").alias("parent"))
    return sources.unionByName(texts)


def anchors(found: DataFrame) -> DataFrame:
    """source_id, finding_ref, start, end: spans of adjoining positions of numbered findings."""
    each = found.select(F.col("doc_id").alias("source_id"), F.col("finding_ref").alias("ref"), F.explode("positions").alias("pos"))
    return evidence.spans(each).withColumnRenamed("ref", "finding_ref")


def results(run: DataFrame, found: DataFrame) -> DataFrame:
    """source_id, execution, findings: how many findings each execution that was completed gave."""
    counts = found.select(F.col("doc_id").alias("source_id"), capability_of("id").alias("capability")).groupBy("source_id", "capability").agg(F.count(F.lit(1)).alias("findings"))
    done = run.filter("state = 'completed' and stage = 'analysis'")
    return done.join(counts, ["source_id", "capability"], "left").select("source_id", F.col("ref").alias("execution"), "capability", F.coalesce("findings", F.lit(0)).alias("findings"))


def problems(run: DataFrame, made: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """source_id, problem of whatever breaks the graph: parents or prerequisites that are missing, repeated references, spans outside the text."""
    told = [
        evidence.dangling(made.withColumnRenamed("parent", "to"), "to", made).select("source_id", F.lit("artifact.parent").alias("problem")),
        evidence.duplicates(made, ["source_id", "ref"]).select("source_id", F.lit("artifact.repeated").alias("problem")),
        evidence.duplicates(run, ["source_id", "ref"]).select("source_id", F.lit("execution.repeated").alias("problem")),
        evidence.outside(spans, texts.select(F.col("doc_id").alias("source_id"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))).select("source_id", F.lit("anchor.outside").alias("problem")),
    ]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out.distinct()
