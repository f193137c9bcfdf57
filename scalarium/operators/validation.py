"""Checks of evidence records and of whole reports: each gives rows of what breaks it, with source_id, ref and problem.

A check never fails a job and never repairs anything; an empty result means that all records hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.functions import identity, strings
from scalarium.operators.findings import FAILED, VIEWS, location

#: Roles, mechanisms, purposes, participation, states, and the limits of a profile's evaluation.
MECHANISMS = ("structural", "cryptographic", "statistical")
PURPOSES = ("watermark_detection", "channel_analysis", "intrinsic_fingerprint_research")
PARTICIPATION = ("required", "optional", "disabled")
OPERATIONAL, ANALYTICAL = ("acquisition", "parser"), ("analyzer", "verifier")
PROFILE_LIMITS = {"observations": 10_000, "signals": 10_000, "links": 100_000}
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")
REFERENCE = r"^{}/(0|[1-9][0-9]*)$"


def _rows(records: DataFrame, ref: str, checks: dict[str, Column]) -> DataFrame:
    """source_id, ref, problem for each check that a record breaks; a check that can't be decided is broken."""
    told = F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(problem)) for problem, holds in checks.items()))
    return records.select("source_id", F.col(ref).alias("ref"), F.explode(F.filter(told, lambda p: p.isNotNull())).alias("problem"))


def capability_problems(capabilities: DataFrame) -> DataFrame:
    """Of capabilities (source_id, capability, revision, role, mechanism, purpose, participation, availability, reason, implementation)."""
    c = F.col
    analytical, statistical = c("role").isin(*ANALYTICAL), F.coalesce(c("mechanism") == "statistical", F.lit(False))
    available = c("availability") == "available"
    return _rows(capabilities, "capability", {
        "capability.identity": (F.length("capability") > 0) & (F.length("revision") > 0),
        "capability.role": c("role").isin(*OPERATIONAL, *ANALYTICAL),
        "capability.mechanism": F.when(analytical, c("mechanism").isin(*MECHANISMS)).otherwise(c("mechanism").isNull()),
        "capability.purpose": F.when(statistical, c("purpose").isin(*PURPOSES)).otherwise(c("purpose").isNull()),
        "capability.participation": c("participation").isin(*PARTICIPATION),
        "capability.availability": F.when(available, c("implementation").isNotNull() & c("reason").isNull()).otherwise(c("availability").isin("unavailable", "unknown") & (F.length("reason") > 0)),
    })


def ascending(regions: Column) -> Column:
    """Whether regions (start, end) aren't empty, don't overlap and stand in order."""
    return F.forall(F.transform(regions, lambda r, i: (r["start"] < r["end"]) & (r["start"] >= F.when(i == 0, 0).otherwise(F.get(regions, i - 1)["end"]))), lambda ok: ok)


def scope_problems(scopes: DataFrame) -> DataFrame:
    """Of scopes (source_id, ref, artifact_ref, unit, regions): a whole artifact has no regions, bytes and characters have some in order."""
    whole = F.col("unit") == "whole_artifact"
    return _rows(scopes, "ref", {
        "scope.artifact": F.col("artifact_ref").rlike(REFERENCE.format("artifact")),
        "scope.unit": whole | F.col("unit").isin("byte", "scalar"),
        "scope.regions": F.when(whole, F.col("regions").isNull()).otherwise((F.size("regions") > 0) & ascending(F.col("regions"))),
    })


def execution_problems(executions: DataFrame) -> DataFrame:
    """Of executions (source_id, ref, state, reason, requested, analyzed, excluded as arrays of regions of characters, diagnostics): the rules of each state.

    What was completed covers what was asked for, what is partial says what was left out and why, and what failed, was
    canceled or wasn't run has analysed nothing; analysed and excluded parts lie within the request and apart.
    """
    c = F.col
    none = lambda x: F.size(x) == 0
    same = lambda a, b: F.to_json(F.struct(c(a))) == F.regexp_replace(F.to_json(F.struct(c(b))), f'"{b}"', f'"{a}"')
    both = F.array_sort(F.concat("analyzed", "excluded"))
    within = F.forall(both, lambda r: F.exists(c("requested"), lambda q: (q["start"] <= r["start"]) & (r["end"] <= q["end"])))
    state, reason = c("state"), F.coalesce(F.length("reason") > 0, F.lit(False))
    idle = state.isin("not_run", "failed", "canceled")
    return _rows(executions, "ref", {
        "execution.reference": c("ref").rlike(REFERENCE.format("exec")),
        "execution.state": state.isin("completed", "partial", "failed", "canceled", "not_run", "disabled"),
        "execution.request": F.size("requested").isNotNull() & ascending(c("requested")),
        "execution.exceeds_request": within,
        "execution.overlap": ascending(both),
        "execution.idle_with_scope": ~idle | (none("analyzed") & reason),
        "execution.canceled_reason": (state != "canceled") | (c("reason") == "execution.canceled"),
        "execution.failed_without_diagnostic": (state != "failed") | (F.size("diagnostics") > 0),
        "execution.completed_covers_request": (state != "completed") | (c("reason").isNull() & none("excluded") & same("analyzed", "requested")),
        "execution.partial_says_what": (state != "partial") | ((F.size("analyzed") > 0) & (F.size("excluded") > 0) & (F.size("diagnostics") > 0) & reason),
    })


def plan_gaps(planned: DataFrame, declared: DataFrame) -> DataFrame:
    """source_id, capability, problem: capabilities planned but not declared for a source, and the other way round, with repeats."""
    keys = ["source_id", "capability"]
    gap = lambda a, b, problem: a.select(*keys).exceptAll(b.select(*keys)).withColumn("problem", F.lit(problem))
    return gap(planned, declared, "capability.not_declared").unionByName(gap(declared, planned, "capability.not_planned"))


def finding_problems(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Of findings (doc_id, finding_ref and the columns of findings) and the texts they are of: references, severities, counts and coordinates.

    Byte offsets are held against the text before each character; texts without findings aren't moved.
    """
    numbers = F.size("positions")
    count = F.get_json_object("evidence", "$.count").cast("long")
    told = found.withColumnsRenamed({"doc_id": "source_id"})
    plain = _rows(told, "finding_ref", {
        "finding.reference": F.col("finding_ref").rlike(REFERENCE.format("finding")),
        "finding.severity": F.col("severity").isin(*SEVERITIES),
        "finding.count": count.isNull() | (numbers == 0) | (count == numbers),
        "finding.coordinate_count": numbers == F.size("byte_offsets"),
    })
    again = told.groupBy("source_id", F.col("finding_ref").alias("ref")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id", "ref", F.lit("finding.repeated").alias("problem"))
    placed = told.filter(numbers > 0).join(texts.select(F.col("doc_id").alias("source_id"), "text"), "source_id")
    right = strings.byte_offsets(F.col("text"), F.col("positions"))
    inside = (F.array_max("positions") < F.length("text")) & (F.array_min("positions") >= 0)
    wrong = placed.filter(~(inside & (right == F.col("byte_offsets")))).select("source_id", F.col("finding_ref").alias("ref"), F.lit("finding.coordinates").alias("problem"))
    return plain.unionByName(again).unionByName(wrong)


def linkage_problems(found: DataFrame, executions: DataFrame) -> DataFrame:
    """Of findings (source_id, finding_ref, id, execution_ref) and executions (source_id, ref, stage, state): findings come from operations that could give them.

    A failure to parse comes from an acquisition or a parser that failed, any other finding from an analysis that was
    completed or is partial.
    """
    runs = executions.select("source_id", F.col("ref").alias("execution_ref"), "stage", "state", F.lit(True).alias("known"))
    rows = found.join(runs, ["source_id", "execution_ref"], "left")
    failure = F.col("id") == "parser.failure"
    known = F.coalesce("known", F.lit(False))
    broken = (F.col("state") == "failed") & F.col("stage").isin(*OPERATIONAL)
    usable = F.col("state").isin("completed", "partial") & (F.col("stage") == "analysis")
    return _rows(rows, "finding_ref", {"finding.execution": known, "finding.failure_execution": ~known | ~failure | broken, "finding.unusable_operation": ~known | failure | usable})


def summary_problems(summaries: DataFrame, found: DataFrame, status: DataFrame) -> DataFrame:
    """Of summaries (source_id, findings, high, medium, low, info, exit_code): whether they count the findings (source_id, severity) and say what the status (source_id, status) asks for."""
    names = ["findings", "high", "medium", "low", "info"]
    of = lambda s: F.count_if(F.col("severity") == s)
    right = found.groupBy("source_id").agg(F.struct(F.count(F.lit(1)).alias("findings"), *(of(s).alias(s.lower()) for s in SEVERITIES), F.max(strings.severity_rank(F.col("severity"))).alias("exit_code")).alias("right"))
    rows = summaries.join(right, "source_id", "left").join(status, "source_id", "left")
    want = lambda n: F.coalesce(F.col(f"right.{n}"), F.lit(0))
    counts = reduce(lambda a, b: a & b, [F.col(n) == want(n) for n in names])
    code = F.when(F.col("status") == "completed", want("exit_code")).otherwise(FAILED)
    return _rows(rows.withColumn("ref", F.lit("summary")), "ref", {"summary.counts": counts, "summary.exit_code": F.col("exit_code") == code})


def selected(found: DataFrame, current: str, name: str) -> DataFrame:
    """A view of findings that are already those of the view `current`: a filtered report can't be widened."""
    if name not in ("all", *VIEWS) or current not in ("all", *VIEWS):
        raise ValueError("unknown view")
    if current not in ("all", name):
        raise ValueError("findings that a view left out can't be had back")
    return found if name == "all" else found.filter(F.col("category").isin(*VIEWS[name], "parser"))


def ordered(found: DataFrame, execution: str = "execution_ref", partition: str = "doc_id") -> DataFrame:
    """Adds finding_ref by severity, id, location, title, canonical evidence and execution."""
    from pyspark.sql import Window

    order = Window.partitionBy(partition).orderBy(strings.order_rank(F.col("severity")).desc(), "id", location(found), "title", "_payload", execution)
    rows = found.withColumn("_payload", identity.canonical_json(F.col("evidence")))
    return rows.withColumn("finding_ref", F.concat(F.lit("finding/"), F.row_number().over(order) - 1)).drop("_payload")


def least_report(text: Column) -> tuple[Column, Column]:
    """Bytes and numbers that a report of a UTF-8 text needs at least: the text, and where each character and the end lie.

    Offsets of k digits or more are counted by the characters that begin behind the first 10^(k-1) bytes, so no
    character is looked at by itself.
    """
    size, numbers = F.octet_length(text), F.length(text) + 1
    behind = lambda k: numbers - F.length(F.substring(text.cast("binary"), 1, 10**k).cast("string"))
    digits = reduce(lambda a, k: a + F.when(size >= 10**k, behind(k)).otherwise(0), range(1, 9), numbers)
    return (size + digits + numbers - 1).cast("long"), numbers.cast("long")


def fits_report(text: Column, most_bytes: int, most_numbers: int) -> Column:
    """False only if no report of the text can stay within the limits."""
    size, numbers = least_report(text)
    return (size <= most_bytes) & (numbers <= most_numbers)


def beyond_limits(observations: DataFrame, signals: DataFrame, signal_targets: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """limit, found, most: limits of an interactive profile evaluation that these tables exceed; a corpus has none."""
    most = PROFILE_LIMITS | (limits or {})
    counted = [t.agg(F.count(F.lit(1)).alias("found")).select(F.lit(n).alias("limit"), "found", F.lit(most[n]).alias("most")) for n, t in (("observations", observations), ("signals", signals), ("links", signal_targets))]
    return reduce(DataFrame.unionByName, counted).filter("found > most")
