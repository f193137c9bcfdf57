"""Removal of repeated passages: Rabin-Karp hashes of every window of so many words, counted in Spark.

A map task hashes all windows of its documents, in chunks.  A chunk sends each hash at most twice (twice if
it has met it again itself), packed by bucket: 8 bytes of hash (the bucket holds more of it) and a byte or two
of position.  A bucket's task sorts its hashes, and answers each chunk with the positions of those that came
more than once.  A chunk's task merges these into maximal intervals of words by document.  So a window costs
about ten bytes of shuffle and is never a row, and a hash that millions of windows share arrives at its
bucket at most twice per chunk.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.llm.text import U64, distinct, mix64, raw_text, slices, span_hashes, window_hashes, window_starts, word_bounds

CHUNK_WINDOWS = 1_000_000
BUCKET_BYTES = 16 << 20
_OWN, _DOCS, _HASHES = 0, 1, 2
_SECOND = U64(0xA0761D6478BD642F)
_ROW = "key int, chunk long, kind int, hashes binary, places binary"


def packed_gaps(ascending: np.ndarray) -> bytes:
    """Ascending numbers below 2^31 as differences in one byte, or five where that doesn't do."""
    gaps = np.diff(ascending, prepend=0)
    wide = np.flatnonzero((gaps > 254) | (gaps < 0))
    small = np.minimum(gaps, 255).astype(np.uint8)
    return len(gaps).to_bytes(4, "little") + small.tobytes() + gaps[wide].astype("<i4").tobytes()


def unpacked_gaps(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<i4", -1, 4 + n)
    return np.cumsum(gaps)


class _Chunk:
    """Windows of consecutive documents of one task."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.more: list[np.ndarray] = []  # eight bits of a second hash
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, CRC-32 and bytes of the text, windows
        self.size = 0

    def add(self, ids: list[int | None], buf: np.ndarray, off: np.ndarray, width: int) -> None:
        starts, ends, counts = word_bounds(buf, off)
        at, fits = window_starts(counts, width)
        if len(at):
            words = span_hashes(buf, starts, ends)
            self.hashes.append(window_hashes(words, at, width))
            self.more.append((window_hashes(mix64(words + _SECOND), at, width) >> U64(56)).astype(np.uint8))
            self.size += len(at)
        view = memoryview(np.ascontiguousarray(buf))
        edges = off.tolist()
        for d in np.flatnonzero(fits).tolist():
            a, b = edges[d], edges[d + 1]
            self.docs.append((ids[d], zlib.crc32(view[a:b]), b - a, int(fits[d])))

    def rows(self, number: int, buckets: int) -> list[tuple]:
        if not self.size:
            return []
        hashes = np.concatenate(self.hashes)
        sent_as = (hashes << U64(8)) | np.concatenate(self.more)  # the highest bits tell the bucket
        order = np.argsort(sent_as, kind="stable")
        ordered, whole = sent_as[order], hashes[order]
        same = (ordered[1:] == ordered[:-1]) & (whole[1:] == whole[:-1])
        again = np.zeros(len(ordered), bool)
        again[1:] = same
        met = again.copy()
        met[:-1] |= same
        third = again.copy()  # of a hash's occurrences here, all but the first two stay
        third[1:] &= again[:-1]
        sent = np.ones(len(hashes), bool)
        sent[order[third]] = False
        out = [(number % (1 << 31), number, _DOCS, _packed_docs(self.docs), None)]
        own = np.sort(order[met])
        if len(own):
            out.append((number % (1 << 31), number, _OWN, None, packed_gaps(own)))
        places = np.flatnonzero(sent)
        hashes, sent_as = hashes[places], sent_as[places]
        bucket = (((hashes >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            which = order[edges[b] : edges[b + 1]]
            out.append((b, number, _HASHES, sent_as[which].astype("<u8").tobytes(), packed_gaps(places[which])))
        return out


def _packed_docs(docs: list[tuple[int | None, int, int, int]]) -> bytes:
    told = np.array([(x[0] or 0, x[0] is None, *x[1:]) for x in docs], np.int64)
    return told.tobytes()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_NAMES, _KINDS = ["key", "chunk", "kind", "hashes", "places"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _hashed(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        made, chunk = 0, _Chunk()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off):
                chunk.add(ids[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                if chunk.size >= CHUNK_WINDOWS:
                    yield _batch(chunk.rows(task + made, buckets), _NAMES, _KINDS)
                    made, chunk = made + 1, _Chunk()
        if chunk.size:
            yield _batch(chunk.rows(task + made, buckets), _NAMES, _KINDS)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each chunk with the places of hashes that the bucket has more than once; other rows pass."""
    by_bucket: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        through = []
        for key, chunk, kind, hashes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == _HASHES:
                by_bucket.setdefault(key, []).append((chunk, hashes, places))
            else:
                through.append((key, chunk, kind, hashes, places))
        if through:
            yield _batch(through, _NAMES, _KINDS)
    while by_bucket:
        key, rows = by_bucket.popitem()
        all_hashes = np.frombuffer(b"".join(r[1] for r in rows), "<u8")
        ordered = np.sort(all_hashes)
        repeated = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(repeated):
            continue
        at = np.minimum(np.searchsorted(repeated, all_hashes), len(repeated) - 1)
        hit = repeated[at] == all_hashes
        edges = np.cumsum([0, *(len(r[1]) // 8 for r in rows)])
        out = []
        for (chunk, _, places), a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            if hit[a:b].any():
                out.append((key, chunk, _OWN, None, packed_gaps(unpacked_gaps(places)[hit[a:b]])))
        if out:
            yield _batch(out, _NAMES, _KINDS)


def _merged(width: int):
    def run(group: pa.Table) -> pa.Table:
        docs, hit = np.zeros((0, 5), np.int64), []
        for kind, data, places in zip(group["kind"].to_pylist(), group["hashes"].to_pylist(), group["places"].to_pylist(), strict=True):
            if kind == _DOCS:
                docs = np.frombuffer(data, np.int64).reshape(-1, 5)
            else:
                hit.append(unpacked_gaps(places))
        n = docs[:, 4]
        first = np.cumsum(n) - n
        windows = distinct(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
        doc = np.searchsorted(first, windows, side="right") - 1
        place = windows - first[doc]
        # a window begins a new interval if the one before doesn't reach it
        new = np.ones(len(windows), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + width)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(windows)) - 1
        found = distinct(doc[begin])
        edge = np.searchsorted(doc[begin], np.append(found, len(docs)))
        spans = np.stack([place[begin], place[end[: len(begin)]] + width], 1).astype("<i8") if len(begin) else np.zeros((0, 2), "<i8")
        return pa.table(
            {
                "doc_id": pa.array(docs[found, 0], pa.int64(), mask=docs[found, 1] == 1),
                "crc": pa.array(docs[found, 2]),
                "size": pa.array(docs[found, 3].astype(np.int32)),
                "spans": pa.array([spans[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            }
        )

    return run


def repeated_spans(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal intervals of words of repeated windows: doc_id, crc and size (of the text's bytes), spans.

    spans holds pairs of 64-bit little-endian numbers: the first word of an interval and the one after its last.
    One row per document that has any; rows of equal id and text have equal intervals and each has its row.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    hashed = docs.mapInArrow(_hashed(width, 3 * partitions), _ROW)
    counted = hashed.repartition(partitions, "key").mapInArrow(_counted, _ROW)
    return counted.select("chunk", "kind", "hashes", "places").groupBy("chunk").applyInArrow(_merged(width), "doc_id long, crc long, size int, spans binary")


def _with_spans(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """All columns of docs and `__repeats_spans`, null where nothing is repeated."""
    spans = repeated_spans(docs, width, id_col, text_col).dropDuplicates(["doc_id", "crc", "size"]).toDF("__repeats_id", "__repeats_crc", "__repeats_size", "__repeats_spans")
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__repeats_id")) & (F.crc32(text.cast("binary")) == F.col("__repeats_crc")) & (F.octet_length(text) == F.col("__repeats_size"))
    return docs.join(spans, same, "left").drop("__repeats_id", "__repeats_crc", "__repeats_size")


def _cut(off: np.ndarray, buf: np.ndarray, spans: list[bytes | None]) -> Iterator[tuple[int, int, bytes]]:
    """Of each text its words, how many go, and the kept ones joined by a space."""
    for i, j in slices(off):
        part = buf[off[i] : off[j]]
        data = part.tobytes()
        starts, ends, counts = word_bounds(part, off[i : j + 1] - off[i])
        first = np.cumsum(counts) - counts
        for d in range(j - i):
            n, f = int(counts[d]), int(first[d])
            keep = np.ones(n, bool)
            for a, b in np.frombuffer(spans[i + d], "<i8").reshape(-1, 2).tolist() if spans[i + d] else ():
                keep[a:b] = False
            which = f + np.flatnonzero(keep)
            yield n, n - len(which), b" ".join([data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text without the words of repeated windows: doc_id, n_words, n_removed, kept (words joined by a space).

    A window is repeated if its word sequence starts anywhere else, in the same document too; rows with equal ids
    are documents of their own.  Words are parted by the space and U+0009 to U+000D.  A null or empty text has no
    words.  Other columns of docs are left out.  Hashes decide: 64 bits and those of the bucket, which are 24 once the input
    needs so many, so among the windows of 100 TB less than one pair is expected to agree by chance.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_cut(*raw_text(batch.column(1)), batch.column(2).to_pylist()))
            words, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _with_spans(plain, width, "doc_id", "text").select("doc_id", "text", "__repeats_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with texts cut as in remove_repeats() and, if there is such a column, their sizes in characters.

    A text of which nothing goes stays as it is, to the byte; one of which all goes becomes empty, and null stays null.
    """
    names = docs.columns
    joined = _with_spans(docs, width, id_col, text_col)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            hit = np.array([d for d, x in enumerate(spans) if x], np.int64)
            columns = [batch.column(i) for i in range(len(names))]
            if len(hit):
                cut = iter(_cut(*raw_text(columns[at].take(pa.array(hit))), [spans[d] for d in hit]))
                where = set(hit.tolist())
                columns[at] = pa.array([next(cut)[2].decode("utf-8", "replace") if d in where else x for d, x in enumerate(columns[at].to_pylist())], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.select(*names, "__repeats_spans").mapInArrow(run, docs.schema)
    if size_col in names:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType)).select(*names)
    return out


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
