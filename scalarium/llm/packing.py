"""Packing of tokenized documents into sequences: pattern packing by non-negative least squares.

Documents become pieces of at most the sequence's length.  How many pieces there are of each length (a
histogram, at most as long as a sequence) is all that planning needs, so it runs on the driver whatever the
corpus: patterns of up to three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded, and what remains is packed best fit first.
The n-th piece of a length, counted in a distributed way, then looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalarium.llm.bpe import encoded
from scalarium.llm.tables import stored


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and the id that ends it: doc_id, piece, start, length, ids_crc32, ids with keep_ids.

    A document longer than the capacity is cut into pieces of that length, of which the first may be shorter.
    A null or empty text is one piece, the ending id.  Rows with equal or null ids are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, ids, counts in encoded(batch.column(1), path):
                stops = np.cumsum(counts)
                whole = np.insert(ids, stops, np.uint32(end_id))  # each document's ids, then the ending one
                sizes = counts + 1
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * capacity
                start = np.where(k == 0, 0, first[row] + (k - 1) * capacity)
                length = np.where(k == 0, first[row], capacity)
                at = (np.cumsum(sizes) - sizes)[row] + start
                data = memoryview(whole.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + i)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)).astype(np.int32)), pa.array(whole.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three present lengths, ascending, that add up to the capacity; a missing length is 0."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    pairs = present[(2 * present <= capacity) & has[capacity - present]]
    found = [np.stack([np.zeros_like(pairs), pairs, capacity - pairs], 1)]
    for a in present[3 * present <= capacity]:
        b = present[(present >= a) & (2 * present <= capacity - a)]
        b = b[has[capacity - a - b]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(found)


def fitted(rows: np.ndarray, histogram: np.ndarray, steps: int = 6000) -> np.ndarray:
    """Non-negative repeat counts of the patterns that bring their lengths closest to the histogram, in weighted least squares.

    Each step solves for the one pattern that the gradient favours most, so few patterns get a count.  A
    remaining piece weighs as its length: short ones are easily placed.
    """
    size = len(histogram)
    weight = (np.arange(size) / (size - 1)) ** 2
    rest = histogram.astype(float)
    counts = np.zeros(len(rows))
    if not len(rows):
        return counts
    a, b, c = rows.T
    wa, wb, wc = weight[a] * (a > 0), weight[b], weight[c]
    # the squared norm of a pattern, where equal lengths add up
    norm = wa + wb + wc + 2 * (wa * (a == b) + wb * (b == c) + wa * (a == c))
    for _ in range(steps):
        slope = (wa * rest[a] + wb * rest[b] + wc * rest[c]) / norm
        slope = np.maximum(slope, -counts)
        k = int(np.argmax(slope * slope * norm))
        if abs(slope[k]) < 0.5:
            break
        counts[k] += slope[k]
        for length in rows[k]:
            if length:
                rest[length] -= slope[k]
    return counts


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Compositions of sequences and how many sequences have each; together they hold the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    counts = fitted(rows, left)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 0.5:
            break
        lengths = [int(x) for x in rows[k] if x]
        most = min(int(left[x]) // lengths.count(x) for x in lengths)
        n = min(int(round(counts[k])), most)
        if n > 0:
            out.append((tuple(lengths), n))
            for x in lengths:
                left[x] -= n
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    free = np.zeros(capacity + 1, bool)

    def put(content: tuple[int, ...], n: int) -> None:
        r = capacity - sum(content)
        room[r][content] = room[r].get(content, 0) + n
        free[r] = True

    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            r = length + int(fits[0])
            content, m = room[r].popitem()
            if not room[r]:
                free[r] = False
            if m > n:
                room[r][content] = m - n
                free[r] = True
            put((*content, length), min(m, n))
            n -= min(m, n)
    return [(content, n) for same in room.values() for content, n in same.items()]


class Places:
    """Where the n-th piece of a length goes: runs of sequences that have a place for that length."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], histogram: np.ndarray):
        runs = []
        base = 0
        for lengths, n in made:
            offset = 0
            for length in lengths:
                runs.append((length, base, offset, n))
                offset += length
            base += n
        self.sequences = base
        table = np.array(sorted(runs), np.int64).reshape(-1, 4)
        self.first = np.cumsum(table[:, 3]) - table[:, 3]  # of all pieces, by length and then rank
        self.base, self.offset = table[:, 1], table[:, 2]
        self.before = np.cumsum(histogram) - histogram
        if not (np.bincount(table[:, 0], weights=table[:, 3], minlength=len(histogram)) == histogram).all():
            raise AssertionError("the plan doesn't hold each piece once")

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.before[length] + rank
        run = np.searchsorted(self.first, at, side="right") - 1
        return self.base[run] + at - self.first[run], self.offset[run]


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which has a column length of 1 to capacity and a column part.

    part is any number that few rows share compared to all (the task that made a row, say): pieces of one length
    are counted within each part first and the parts' counts added up, so no length's pieces meet in one task.
    parts is read more than once and must not change between. Sequences are numbered from 0 and have no gaps.
    """
    by_part = parts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        histogram[r["length"]] = r["n"]
    places = Places(plan(histogram, capacity), histogram)
    ahead = by_part.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece")) - 1
    ranked = parts.withColumn("rank", rank).join(ahead, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    names = [c for c in parts.columns if c != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes if c != "part")
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All documents packed: pieces() with sequence_id and offset, one row per piece.

    An empty table gives an empty result.  Texts are encoded once; the pieces are stored between.
    """
    made = pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids).withColumn("part", F.spark_partition_id())
    return pack(stored(made, "pieces"), capacity)
