"""Approximate nearest neighbours by collision counting over query-centred windows.

Each vector has one number on each of m random lines; a block of vectors keeps them as m sorted arrays, made once.  A
query puts a window around its own place in each array.  Windows are as wide as a distance asks for: a vector so near
lies in each with the same probability, so one that lies in too few of them is all but surely farther.  Those that
lie in enough are verified by the exact measure.  While fewer than k of them are that near, the windows widen (virtual
rehashing) and only what they newly take in is counted.  Inner products become distances by one more component, which
makes all vectors equally long; where norms are unequal the distances are alike, and windows then take in most of a block.

A task holds one block and its arrays; queries pass by in batches and keep their best few of each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalarium.llm.tables import bounded

LINES, SEED = 128, 20240229
#: Vectors of a block, at most (places are 16 bits wide); fewer where cores would be idle, but no fewer than the second.
VECTOR_BLOCK, LEAST_BLOCK = 1 << 16, 1 << 12
#: Half a window's width for each unit of distance, and how likely a vector at that distance lies in it.
WIDTH = 1.5
INSIDE = math.erf(WIDTH / math.sqrt(2))
#: A candidate lies in so many windows.  Of vectors at the very distance 95% do (1.6 standard deviations), of nearer ones more.
THRESHOLD = math.floor(LINES * INSIDE - 1.6 * math.sqrt(LINES * INSIDE * (1 - INSIDE)))
#: How windows widen while too few are found, and how many vectors of a block tell where to begin.
WIDER, SAMPLE = 1.1, 16
#: Inner products in double precision differ by less than this share of both lengths.
ROUNDING = 1e-9


class Index:
    """The sorted arrays of a block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, least: int = 20):
        self.vectors, self.longest = vectors, longest
        scaled = vectors / longest
        last = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        self.lines = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, LINES))
        on = np.column_stack([scaled, last]) @ self.lines
        order = np.argsort(on, axis=0, kind="stable").T
        self.sorted = np.ascontiguousarray(np.take_along_axis(on.T, order, 1))
        self.order = order.astype(np.uint16)
        self.entered = np.empty(order.size, np.intp)
        #: The first distance that windows are for: the median of what the sample's own `least`-th nearest have.
        some = scaled[:: max(1, len(scaled) // SAMPLE)][:SAMPLE]
        size = np.sqrt((some * some).sum(axis=1))
        near = [self._edge(scaled @ x, min(least + 1, len(scaled))) / n for x, n in zip(some, size, strict=True) if n]
        self.begin = max(1e-6, math.sqrt(max(0.0, 2 - 2 * float(np.median(near))))) if near else 1.0
        self.verified = 0

    def candidates(self, queries: np.ndarray, least: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the vectors verified and their scores, in windows that cover the distance of the `least`-th best of them (a number for all, or one for each)."""
        size = np.sqrt((queries * queries).sum(axis=1))
        on = np.column_stack([queries / size[:, None], np.zeros(len(queries))]) @ self.lines
        half = WIDTH * self.begin
        edges = [(line.searchsorted(on[:, i] - half), line.searchsorted(on[:, i] + half, "right")) for i, line in enumerate(self.sorted)]
        left, right = (np.array(e).T.tolist() for e in zip(*edges, strict=True))
        for j, wanted in enumerate(np.broadcast_to(least, len(queries)).tolist()):
            yield self._search(queries[j], on[j], size[j] * self.longest, left[j], right[j], min(wanted, len(self.vectors)))

    def _search(self, query: np.ndarray, on: np.ndarray, scale: float, left: list[int], right: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        n, distance = len(self.vectors), self.begin
        if 2 * (sum(right) - sum(left)) > n * LINES:  # what lies outside is less
            count = LINES - self._counted([(0, a) for a in left], [(b, n) for b in right])
        else:
            count = self._counted(list(zip(left, right, strict=True)), [])
        found, score = np.zeros(0, np.intp), np.zeros(0)
        seen = np.zeros(n, bool)
        while True:
            new = np.flatnonzero((count >= THRESHOLD) & ~seen)
            seen[new] = True
            found, score = np.concatenate([found, new]), np.concatenate([score, self._rough(new, query)])
            if len(found) == n:
                break
            if len(found) >= least:
                edge = math.sqrt(max(0.0, 2 - 2 * self._edge(score, least) / scale))
                if edge <= distance:
                    break
                distance = min(edge, 4 * distance)
            else:
                distance *= WIDER
            wide_left, wide_right = zip(*((line.searchsorted(x - WIDTH * distance), line.searchsorted(x + WIDTH * distance, "right")) for line, x in zip(self.sorted, on, strict=True)), strict=True)
            count += self._counted(list(zip(wide_left, left, strict=True)), list(zip(right, wide_right, strict=True)))
            left, right = wide_left, wide_right
        self.verified += len(found)
        return found, score

    def _counted(self, *ranges: list[tuple[int, int]]) -> np.ndarray:
        """How often each vector stands in these ranges of the sorted arrays."""
        parts = [line[a:b] for told in ranges for line, (a, b) in zip(self.order, told, strict=False) if a < b]
        size = sum(map(len, parts))
        if not size:
            return np.zeros(len(self.vectors), np.intp)
        np.concatenate(parts, out=self.entered[:size])
        return np.bincount(self.entered[:size], minlength=len(self.vectors))

    def best(self, found: np.ndarray, rough: np.ndarray, query: np.ndarray, least: int) -> np.ndarray:
        """Those of the found that can be among the `least` best: more than rounding puts the others behind."""
        if len(found) <= least:
            return found
        return found[rough >= self._edge(rough, least) - ROUNDING * self.longest * math.sqrt(query @ query)]

    def _rough(self, found: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products whose last digits depend on how they are summed; most of a block is faster taken as it lies."""
        return (self.vectors @ query)[found] if 4 * len(found) > len(self.vectors) else self.vectors[found] @ query

    @staticmethod
    def _edge(score: np.ndarray, least: int) -> float:
        return float(np.partition(score, len(score) - least)[len(score) - least])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (floats if the vectors are of floats, else doubles): rows with an id and a vector that isn't zero and has only finite components.

    Every such row stays, rows that share an id too.
    """
    kind = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


_FOUND = "d int, query_id long, vec_id long, score double"


def _searched(k: int):
    """Search of blocks: of each block first come its vectors, then the queries."""

    def answers(index: Index, own_ids: np.ndarray, ids: np.ndarray, asking: np.ndarray) -> pa.RecordBatch:
        out = []
        same = np.searchsorted(own_ids, ids, "right") - np.searchsorted(own_ids, ids)
        for query_id, query, (found, rough) in zip(ids.tolist(), asking, index.candidates(asking, k + same), strict=True):
            other = own_ids[found] != query_id
            found = index.best(found[other], rough[other], query, k)
            score = (index.vectors[found] * query).sum(axis=1)
            if len(found) > k:
                near = score >= index._edge(score, k)
                found, score = found[near], score[near]
            best = np.lexsort((own_ids[found], -score))[:k]
            out.append((np.full(len(best), query_id), own_ids[found[best]], score[best]))
        query_ids, vec_ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(query_ids), asking.shape[1], np.int32)), pa.array(query_ids), pa.array(vec_ids), pa.array(scores)], names=["d", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, index, parts, own_ids = None, None, [], None
        for batch in batches:
            block, asks, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            ids, longest, vectors = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0) | (np.diff(length) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if (key := (int(length[a]), int(block[a]))) != here:
                    here, index, parts = key, None, []
                flat = vectors.slice(a, b - a).flatten().to_numpy().astype(np.float64).reshape(b - a, -1)
                if not asks[a]:
                    parts.append((ids[a:b].copy(), flat))
                    continue
                if index is None and parts:
                    all_ids = np.concatenate([x for x, _ in parts])
                    own = np.argsort(all_ids, kind="stable")
                    own_ids = all_ids[own]
                    index, parts = Index(np.concatenate([x for _, x in parts])[own], float(longest[a]), k), []
                if index is not None:
                    yield answers(index, own_ids, ids[a:b], flat)

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query by inner product: query_id, rank (from 1), vec_id, score.

    Queries are the vectors whose id is divisible by `every`, of rows that share an id and a length the least vector.
    Every other row of a query's length is a candidate, but none of its own id; vectors of each length are searched
    on their own.  The nearest come first and ties by the smaller vec_id; scores are inner products of the original
    vectors in double precision.  Other columns are left out.  An empty table gives an empty result.
    """
    spark = bounded(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col).withColumn("d", F.size("v"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "d").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    told = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"))
    most, cores = F.ceil(F.col("n") / VECTOR_BLOCK), F.least(F.ceil(F.col("n") / LEAST_BLOCK), F.lit(spark.sparkContext.defaultParallelism))
    told = F.broadcast(told.select("d", "longest", F.greatest(most, cores).cast("int").alias("blocks")))  # a row for each length
    # a row's place deals it to a block, so that rows of one id spread
    base = rows.withColumn("place", F.monotonically_increasing_id()).join(told, "d").withColumns({"block": F.pmod(F.xxhash64("vec_id", "place"), "blocks").cast("int"), "asks": F.lit(False)})
    asking = asked.join(told, "d").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})
    columns = ["block", "asks", "d", "vec_id", "longest", "v"]
    dealt = base.select(columns).unionByName(asking.select(columns)).repartition("d", "block").sortWithinPartitions("d", "block", "asks")
    found = dealt.mapInArrow(_searched(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("d", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
