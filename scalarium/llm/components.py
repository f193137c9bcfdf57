"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.llm.tables import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex with an edge down has one, to a vertex that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    told = ends.groupBy("id").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return told.filter("down > 1 or (down = 1 and least = 0)").isEmpty()


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """The least vertex of each vertex's component: id, component, for vertices other than that least one.

    links is a stored table with columns a and b, whole numbers; self links and repeats do no harm and rows with nulls
    are left out.  Each round is written to the shared folder, and the one before removed.  Rounds are about the logarithm of the number of
    vertices, and a star needs one; all rows of a busy vertex meet only in counts and minima, and in joins that can
    be split.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u is tied to the least of u and its neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours are tied to the least of them
        tied = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, stored(tied.filter("u <> v").distinct(), "links")
        discard(before)
        if _stars(edges):
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out.stored_at = edges.stored_at
            return out
    raise RuntimeError("components did not settle")
