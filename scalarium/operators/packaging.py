"""Relationships, content types and manifests of packages, as joins over tables of parts and declarations.

OPC names compare with A to Z folded, ODF names exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.functions import strings

UNSUPPORTED, OUTSIDE, EMPTY = "opc.target_syntax_unsupported", "opc.target_outside_package", "opc.target_empty"
#: Parts that a manifest need not list.
MANIFEST_EXEMPT = ("mimetype", "META-INF/manifest.xml")


def internal_target(source: Column, target: Column) -> Column:
    """A struct of the part that a target names, seen from a source part, or of the code why it names none.

    Only plain ASCII paths are followed; `..` leaves a folder and `.` stays.
    """
    folder = F.when(target.startswith("/") | (source == ""), F.array().cast("array<string>")).otherwise(F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1))
    steps = F.split(F.regexp_replace(target, "^/", ""), "/")
    walked = F.aggregate(
        steps,
        F.struct(folder.alias("at"), F.lit(None).cast("string").alias("code")),
        lambda s, p: F.struct(
            F.when(s["code"].isNotNull() | (p == "."), s["at"]).when((p == "..") & (F.size(s["at"]) > 0), F.slice(s["at"], 1, F.size(s["at"]) - 1)).when(p == "..", s["at"]).otherwise(F.concat(s["at"], F.array(p))).alias("at"),
            F.coalesce(s["code"], F.when(p == "", UNSUPPORTED).when((p == "..") & (F.size(s["at"]) == 0), OUTSIDE)).alias("code"),
        ),
    )
    plain = target.rlike(r"^[A-Za-z0-9/\-._~!$&'()*+,;=@]*$") & ~target.startswith("//")
    bad_end = (F.size(walked["at"]) == 0) | target.isin(".", "..") | target.endswith("/.") | target.endswith("/..")
    code = F.when(target == "", EMPTY).when(~plain, UNSUPPORTED).otherwise(F.coalesce(walked["code"], F.when(bad_end, UNSUPPORTED)))
    return F.struct(F.when(code.isNull(), F.array_join(walked["at"], "/")).alias("part"), code.alias("code"))


def owner(name: Column) -> Column:
    """The part whose relationships a part holds (empty for the package's own), null if it holds none."""
    m = lambda k: F.regexp_extract(name, r"^(.*?)(?:^|/)(?i:_rels)/([^/]+)(?i:\.rels)$", k)
    is_rels = name.rlike(r"(^|/)(?i:_rels)/[^/]*(?i:\.rels)$")
    root = name.rlike(r"^(?i:_rels)/(?i:\.rels)$")
    return F.when(root, "").when(is_rels & (m(2) != ""), F.when(m(1) == "", m(2)).otherwise(F.concat(m(1), F.lit("/"), m(2))))


def resolved_relationships(relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds part, state and code to relationships (source_id, rel_id, source_part, target, mode): external, resolved, missing, ambiguous, or invalid with a code."""
    rel = relationships.withColumn("_t", internal_target(F.col("source_part"), F.col("target"))).withColumn("fold", F.when(F.col("mode") != "External", strings.ascii_fold(F.col("_t.part"))))
    known = parts.groupBy("source_id", strings.ascii_fold(F.col("name")).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("part"))
    out = rel.join(known, ["source_id", "fold"], "left")
    state = F.when(F.col("mode") == "External", "external").when(F.col("_t.code").isNotNull(), "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return out.select(*relationships.columns, F.when(state == "resolved", F.col("part")).alias("part"), state.alias("state"), F.when(F.col("mode") != "External", F.col("_t.code")).alias("code"))


def content_types(parts: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """source_id, name, content_type, basis of parts: an override of the name beats a default of the extension; two that differ are ambiguous."""
    one = lambda df, key: df.groupBy("source_id", key).agg(F.min("content_type").alias("content_type"), F.countDistinct("content_type").alias("n"))
    of_name = one(overrides.withColumn("fold", strings.ascii_fold(F.regexp_replace("name", "^/", ""))), "fold").toDF("source_id", "fold", "by_name", "n_name")
    of_ext = one(defaults.withColumn("ext", strings.ascii_fold(F.col("extension"))), "ext").toDF("source_id", "ext", "by_ext", "n_ext")
    rows = parts.select("source_id", "name").withColumns({"fold": strings.ascii_fold(F.col("name")), "ext": strings.ascii_fold(F.regexp_extract("name", r"\.([^./]*)$", 1))})
    rows = rows.join(of_name, ["source_id", "fold"], "left").join(of_ext, ["source_id", "ext"], "left")
    basis = F.when(F.col("n_name") > 1, "ambiguous").when(F.col("by_name").isNotNull(), "override").when(F.col("n_ext") > 1, "ambiguous").when(F.col("by_ext").isNotNull(), "default").otherwise("missing")
    return rows.select("source_id", "name", F.when(basis == "override", F.col("by_name")).when(basis == "default", F.col("by_ext")).alias("content_type"), basis.alias("basis"))


def overrides_without_part(overrides: DataFrame, parts: DataFrame) -> DataFrame:
    fold = lambda c: strings.ascii_fold(F.regexp_replace(c, "^/", ""))
    return overrides.withColumn("fold", fold("name")).join(parts.select("source_id", fold("name").alias("fold")), ["source_id", "fold"], "left_anti").drop("fold")


def manifest_membership(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """source_id, path, state of manifest entries (source_id, path) and parts (source_id, name), each way.

    package for `/`; a path that ends in `/` is a directory if some part is below it; others are resolved, missing or
    declared twice (ambiguous).  Parts that no entry lists are unlisted, but for those that need none.
    """
    entries = manifest.groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("n"))
    files = parts.filter(~F.col("name").endswith("/")).select("source_id", F.col("name").alias("path")).distinct().withColumn("is_part", F.lit(True))
    steps = F.split("path", "/")
    below = files.filter(F.size(steps) > 1).select("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))).alias("path")).distinct().withColumn("has_below", F.lit(True))
    both = entries.join(files, ["source_id", "path"], "full_outer").join(below, ["source_id", "path"], "left")
    state = (
        F.when(F.col("n").isNull(), F.when(F.col("path").isin(*MANIFEST_EXEMPT) | F.col("path").startswith("META-INF/"), "manifest_exempt").otherwise("unlisted"))
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("path") == "/", "package")
        .when(F.col("path").endswith("/"), F.when(F.col("has_below"), "directory").otherwise("missing"))
        .when(F.col("is_part"), "resolved")
        .otherwise("missing")
    )
    return both.select("source_id", "path", state.alias("state"))
