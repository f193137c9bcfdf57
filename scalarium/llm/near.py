"""Near-duplicates by BagMinHash: unbiased signatures of weighted Jaccard similarity, banded and verified.

A document is the multiset of its five-word shingles.  Each shingle's weights are cut into the intervals [0, 1),
[1, 2), [2, 4), [4, 8) and so on, and each interval carries a Poisson process seeded by shingle and interval, of a
rate in proportion to the interval's length; a point has a register and a place within the interval, which is
found by halving the interval with random bits.  A register's value is the first point that falls to it at a
place below the shingle's weight.  So two multisets agree in a register with the probability of their weighted
Jaccard similarity, and a shingle of weight w costs log w processes rather than w.  Only points early enough to
matter are made: about m (ln m + 3) per document of whatever length.

Texts that are equal stand as one.  Documents of a bucket (a band of registers) are compared with the bucket's
first one; if that leaves a bucket in more than one class, those outside the first one's class are compared with
all others by signature, in cells of bounded size.  What looks alike is verified on the texts: first the likest
pairs of each document, which joins what belongs together, and at last all that are still of different classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.llm.components import components
from scalarium.llm.tables import discard, stored
from scalarium.llm.text import U64, mix64, raw_text, slices, span_hashes, window_hashes, window_starts, word_bounds

SHINGLE_WORDS, SIMILAR = 5, 0.8
BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
#: Equal registers that a pair needs to be verified: 4.5 standard deviations below what a similarity of 0.8 gives.
PROMISING = int(REGISTERS * SIMILAR - 4.5 * math.sqrt(REGISTERS * SIMILAR * (1 - SIMILAR)))
#: Documents of a cell that are searched, and that search, each; and bytes of their texts where these are sent along.
CELL, CELL_BYTES = 2048, 16 << 20


def shingles(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The document and the hash of each shingle.  A document with fewer words has one of all its words, one without words none."""
    starts, ends, counts = word_bounds(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = span_hashes(buf, starts, ends)
    at, fits = window_starts(counts, width)
    doc, hashes = np.repeat(np.arange(len(counts)), fits), window_hashes(words, at, width)
    first = np.cumsum(counts) - counts
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            doc = np.concatenate([doc, few])
            hashes = np.concatenate([hashes, window_hashes(words, first[few], n)])
    order = np.argsort(doc, kind="stable")
    return doc[order], hashes[order]


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures of the multisets of shingles of documents 0 to n_docs: n_docs rows of m registers, infinite for an empty one."""
    signature = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, minlength=n_docs)
    _, first, weight = np.unique(mix64(shingle + mix64(doc.astype(U64))), return_index=True, return_counts=True)
    doc, shingle = doc[first], shingle[first]
    slack = 3.0
    with np.errstate(divide="ignore"):
        while len(doc):
            bound = (math.log(m) + slack) / total
            level = 0
            while True:
                low = 0 if level == 0 else 1 << (level - 1)
                size = max(1, low)  # of the interval [low, low + size)
                some = np.flatnonzero(weight > low)
                if not len(some):
                    break
                d, w = doc[some], weight[some]
                seed = mix64(shingle[some] + U64((level + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
                time = np.zeros(len(some))
                k = 0
                while len(d):
                    k += 2
                    u = mix64(seed + U64(k * 0xE7037ED1A0B428DB & (1 << 64) - 1))
                    time = time - np.log(((u >> U64(11)) + U64(1)) * 2.0**-53) / (m * size)
                    keep = time <= bound[d]
                    d, w, seed, time = d[keep], w[keep], seed[keep], time[keep]
                    v = mix64(seed + U64((k + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1))
                    register = ((v >> U64(32)) * U64(m)) >> U64(32)
                    place = low + (((v & U64(0xFFFFFFFF)) * U64(size)) >> U64(32)).astype(np.int64)
                    inside = place < w
                    np.minimum.at(signature, d[inside] * m + register[inside].astype(np.int64), time[inside])
                level += 1
            open_docs = np.isinf(signature.reshape(n_docs, m)).any(axis=1)
            keep = open_docs[doc]
            doc, shingle, weight = doc[keep], shingle[keep], weight[keep]
            slack += 4
    return signature.reshape(n_docs, m)


def banded(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands, and a byte of each register."""
    bits = mix64(signatures.view(U64))
    bands = np.empty((len(bits), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(bits), b + 1, U64)
        for i in range(BAND_ROWS):
            h = mix64(h + bits[:, b * BAND_ROWS + i])
        bands[:, b] = h
    return bands.view(np.int64), (bits >> U64(56)).astype(np.uint8)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text, bands (none for a text without words), registers (a byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off):
                part = np.ascontiguousarray(buf[off[i] : off[j]])
                edges = off[i : j + 1] - off[i]
                view = memoryview(part)
                digest = [hashlib.md5(view[a:b]).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                doc, shingle = shingles(part, edges)
                bands, registers = banded(bag_minhash(doc, shingle, j - i))
                has = np.bincount(doc, minlength=j - i) > 0
                stops = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(stops), pa.array(bands[has].reshape(-1))),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "bands", "registers"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, digest binary, bands array<long>, registers binary")


def weighted_jaccard(buf_a: np.ndarray, off_a: np.ndarray, buf_b: np.ndarray, off_b: np.ndarray) -> np.ndarray:
    """Similarity of the i-th document of a and the i-th of b, on the multisets of shingles; 0 if neither has any."""
    n = len(off_a) - 1
    sides = [shingles(buf, off) for buf, off in ((buf_a, off_a), (buf_b, off_b))]
    pair = np.concatenate([s[0] for s in sides])
    key = mix64(np.concatenate([s[1] for s in sides]) + mix64(pair.astype(U64)))
    unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    cut = len(sides[0][0])
    a, b = np.bincount(inverse[:cut], minlength=len(unique)), np.bincount(inverse[cut:], minlength=len(unique))
    of = pair[first]
    both = np.bincount(of, np.minimum(a, b), n)
    either = np.bincount(of, np.maximum(a, b), n)
    return np.divide(both, either, out=np.zeros(n), where=either > 0)


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts (doc_id, text) are at least that similar, with their similarity."""
    first = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    second = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(first, "b").join(second, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (off_a, buf_a), (off_b, buf_b) = raw_text(batch.column(2)), raw_text(batch.column(3))
            for i, j in slices(off_a + off_b):
                score = weighted_jaccard(buf_a[off_a[i] : off_a[j]], off_a[i : j + 1] - off_a[i], buf_b[off_b[i] : off_b[j]], off_b[i : j + 1] - off_b[i])
                good = np.flatnonzero(score >= similar - 1e-12)
                if len(good):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(good + i)) for c in (0, 1)), pa.array(score[good])], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def _promising(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers agree often enough."""
    of = lambda c: firsts.select(F.col("first").alias(c), F.col("registers").alias(f"registers_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "registers_a", "registers_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (raw_text(batch.column(c)) for c in (2, 3))
            a, b = (buf[off[0] : off[-1]].reshape(-1, REGISTERS) for off, buf in (a, b))
            good = pa.array(np.flatnonzero((a == b).sum(axis=1) >= PROMISING))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _cell(most: int):
    """Pairs of a searching document and others of the cell that look alike and are of different classes, the likest first."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, component, search = (group[c].to_numpy() for c in ("first", "component", "search"))
        off, buf = raw_text(group["registers"])
        registers = buf[off[0] : off[-1]].reshape(-1, REGISTERS)
        queries, rows = np.flatnonzero(search), np.flatnonzero(~search)
        found = []
        for q in queries:
            equal = (registers[rows] == registers[q]).sum(axis=1)
            hit = np.flatnonzero((equal >= PROMISING) & (component[rows] != component[q]))
            hit = rows[hit[np.argsort(-equal[hit], kind="stable")[:most]]]
            if len(hit):
                found.append(np.stack([np.maximum(first[hit], first[q]), np.minimum(first[hit], first[q])], 1))
        pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _unsettled(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of buckets that are in several classes, with their class, and that of the bucket's leader."""
    placed = shared.join(linked.withColumnRenamed("id", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("bucket")
    rest = placed.join(split, "bucket")
    leading = rest.filter("first = leader").select("bucket", F.col("component").alias("leading"))
    return rest.join(leading, "bucket")


def _celled(rest: DataFrame, size: Column, columns: list[str]) -> DataFrame:
    """Members of buckets (with `size`, bytes of each) in a grid of cells: part `cell` of the bucket meets part `seek_cell` of those that search it.

    Both parts have a bounded number of documents and of bytes, whatever the bucket has; a document of the leader's class
    doesn't search.
    """
    seeks = F.col("component") != F.col("leading")
    parts = lambda n, of: F.greatest(F.lit(1), F.ceil(n / CELL), F.ceil(of / CELL_BYTES)).cast("int")
    some = F.when(seeks, size)
    told = rest.groupBy("bucket").agg(parts(F.count(F.lit(1)), F.sum(size)).alias("cells"), parts(F.count(some), F.coalesce(F.sum(some), F.lit(0))).alias("seek_cells"))
    rest = rest.join(told, "bucket")
    part = lambda of: F.pmod(F.xxhash64("first", F.lit(of)), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = rest.withColumns({"cell": part("cells"), "seek_cell": each("seek_cells"), "search": F.lit(False)})
    searching = rest.filter(seeks).withColumns({"cell": each("cells"), "seek_cell": part("seek_cells"), "search": F.lit(True)})
    return rows.unionByName(searching).select("bucket", "cell", "seek_cell", "first", "component", "search", *columns)


def _alike(rest: DataFrame, firsts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) across classes of those that aren't in the leader's class and others of their bucket: for each the likest few of each cell."""
    told = rest.join(firsts.select("first", "registers"), "first")
    cells = _celled(told, F.lit(REGISTERS), ["registers"])
    return cells.groupBy("bucket", "cell", "seek_cell").applyInArrow(_cell(most), "a long, b long").distinct()


def _bags(text: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, sorted, and how often it has them."""
    off, buf = raw_text(text)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in slices(off):
        doc, shingle = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        edges = np.searchsorted(doc, np.arange(j - i + 1))
        out += [np.unique(shingle[a:b], return_counts=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _linking_cell(similar: float):
    """Links (a, b, similarity) that join classes of a cell: pairs that look alike, verified where they meet.

    A pair is verified in the first bucket that it shares, and only while its classes are still apart, so what comes
    out is at most as much as the cell has classes.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, component, search, leading = (group[c].to_numpy() for c in ("first", "component", "search", "leading"))
        off, buf = raw_text(group["registers"])
        registers = buf[off[0] : off[-1]].reshape(-1, REGISTERS)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        bags = _bags(group["text"])
        queries, rows = np.flatnonzero(search), np.flatnonzero(~search)
        seeks = component[rows] != leading[rows]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        out = []
        for q in queries.tolist():
            equal = (registers[rows] == registers[q]).sum(axis=1)
            same = bands[rows] == bands[q]
            own = bands[q][same.argmax(axis=1)] == key[0].as_py()
            hit = np.flatnonzero((equal >= PROMISING) & own & (component[rows] != component[q]) & ~(seeks & (first[rows] > first[q])))
            for h in rows[hit[np.argsort(-equal[hit], kind="stable")]].tolist():
                x, y = root(int(component[q])), root(int(component[h]))
                if x != y and (score := _bag_similarity(bags[q], bags[h])) >= similar - 1e-12:
                    out.append((max(first[q], first[h]), min(first[q], first[h]), score))
                    parent[max(x, y)] = min(x, y)
        a, b, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(score, pa.float64())})

    return run


def _last_links(rest: DataFrame, firsts: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """All links that are left between classes of a bucket: texts go to the cells, pairs never leave them."""
    told = rest.join(firsts.select("first", "registers", "bands"), "first").join(texts.select(F.col("doc_id").alias("first"), "text"), "first")
    cells = _celled(told, F.octet_length("text"), ["leading", "registers", "bands", "text"])
    return cells.groupBy("bucket", "cell", "seek_cell").applyInArrow(_linking_cell(similar), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of each document: doc_id, class_id (the least doc_id of its class), n_links.

    Documents are linked if their texts are equal or their multisets of five-word shingles have a weighted Jaccard
    similarity of at least `similar`; classes are the linked groups.  n_links is the number of other texts that the
    document's text was found linked to.  Of pairs of similarity 0.8, 7 in 100,000 share no band and 3 in a million have
    fewer than PROMISING registers equal, so these aren't compared; more alike ones are rarer still.  One row per row, repeated rows too.  A null text counts as empty, and texts
    without words are linked if equal.  A row without an id is in no class; of rows that share an id, each text counts.  Other columns of docs are left out.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    made = stored(sketches(plain), "sketches")
    firsts = made.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    firsts = stored(firsts, "firsts")
    member = firsts.select("first", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(member.join(buckets, "bucket"), "buckets")
    pairs = shared.filter("first <> leader").select(F.col("first").alias("a"), F.col("leader").alias("b")).distinct()
    # texts that share a bucket are looked up once for all that follows; both sides grow with the input, so neither is broadcast
    wanted = shared.select(F.col("first").alias("doc_id")).distinct().hint("merge")
    texts = stored(plain.join(wanted, "doc_id", "left_semi"), "texts")
    links = stored(verified(_promising(pairs, firsts), texts, similar).dropDuplicates(["a", "b"]), "links")
    linked = components(links)
    # in buckets that are still in several classes, look for links between these: likely ones first, then all
    for most in (4, None):
        rest = stored(_unsettled(shared, linked), "unsettled")
        if rest.isEmpty():
            discard(rest)
            break
        more = verified(_alike(rest, firsts, most), texts, similar) if most else _last_links(rest, firsts, texts, similar)
        before, links = links, stored(links.unionByName(more).dropDuplicates(["a", "b"]), "links")
        discard(before, rest, linked)
        linked = components(links)
    discard(shared, texts)
    all_links, final = links, linked
    degree = all_links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
    classes = firsts.select("digest", "first").join(final.withColumnRenamed("id", "first"), "first", "left").join(degree, "first", "left")
    classes = classes.select("digest", F.coalesce("component", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = made.select("doc_id", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
