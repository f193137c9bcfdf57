"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (5 to 8 folded bytes, words parted by one symbol) that a document has at least once,
twice, four times or eight times, hashed.  Each is scaled by the logarithm of how much more often toxic documents
have it than others; a logistic regression on the scaled features gives the weights.  Only the features that tell
the classes apart best get one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.llm.language import FOLD, SYMBOL_BITS, held_out
from scalarium.llm.tables import bounded
from scalarium.llm.text import distinct, raw_text, slices

ORDERS = (5, 6, 7, 8)
#: How often a document has an n-gram: each level that it reaches is a feature.
COUNTS = (1, 2, 4, 8)
FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
#: Labelled rows that the regression is fitted on: all, or about so many drawn by a hash of the id.
SAMPLE_ROWS = 24_000
#: Features that get a weight at most, how many documents must have one, and the log-likelihood it must add.
KEPT_FEATURES, LEAST_DOCUMENTS, LEAST_GAIN = 8192, 5, 8.0
THRESHOLD = 0.7
#: Features whose counts are sent together.
BLOCK = 1 << 14
#: Bytes of text taken at a time, where all n-grams are kept and where few are.
COUNTED_BYTES, SCORED_BYTES = 1 << 17, 1 << 19


_LEVELS = [(k + 1) * 0x9E377 & (FEATURES - 1) for k in range(len(COUNTS))]


def with_levels(wanted: np.ndarray) -> np.ndarray:
    """Marks the n-grams of which some level is marked."""
    out = np.zeros(FEATURES, bool)
    for level in _LEVELS:
        out |= wanted[np.arange(FEATURES) ^ level]
    return out


def features(buf: np.ndarray, off: np.ndarray, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of document and feature, each once and by document; of n-grams that `grams` marks, if given."""
    sizes = np.diff(off)
    symbols = np.zeros(len(buf) + len(sizes) + 1, np.int64)
    of = np.append(np.repeat(np.arange(len(sizes)), sizes + 1), len(sizes))
    symbols[np.arange(len(buf)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = FOLD[buf]
    # runs of parting symbols count as one
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    keep[1:] |= of[1:] != of[:-1]
    symbols, of = symbols[keep], of[keep]
    found = []
    kind = np.uint32 if len(sizes) <= 1 << (32 - FEATURE_BITS) else np.int64
    code = symbols
    for order in range(2, max(ORDERS) + 1):
        if len(code) < 2:
            break
        code = (code[:-1] << SYMBOL_BITS) | symbols[order - 1 :]
        if order in ORDERS:
            hashed = ((code + order).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)
            at = np.arange(len(code)) if grams is None else np.flatnonzero(grams[hashed])
            doc = of[at]
            within = of[at + order - 2] == doc  # the last symbol may be the one that parts documents
            found.append(((doc[within] << FEATURE_BITS) | hashed[at[within]].astype(np.int64)).astype(kind))
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, kind)
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    first = np.flatnonzero(new)
    pairs, count = every[first], np.diff(first, append=len(every))
    pairs = distinct(np.concatenate([pairs[count >= least] ^ kind(level) for least, level in zip(COUNTS, _LEVELS, strict=True)])).astype(np.int64)
    return pairs >> FEATURE_BITS, pairs & (FEATURES - 1)


class Model:
    """A weight for each feature (none for most) and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant
        self.grams = with_levels(weights != 0)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, feature = features(buf, off, self.grams)
        z = self.constant + np.bincount(doc, self.weights[feature], len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ratios(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios of features from how many toxic and other documents have them."""
    p, q = toxic + 1.0, other + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def informative(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The features by which the classes differ most, by the likelihood ratio of presence."""

    def entropy(k: np.ndarray, n: float) -> np.ndarray:
        p = np.clip(k / max(n, 1), 1e-12, 1 - 1e-12)
        return -n * (p * np.log(p) + (1 - p) * np.log(1 - p))

    gain = entropy(toxic + other, n_toxic + n_other) - entropy(toxic, n_toxic) - entropy(other, n_other)
    gain[toxic + other < LEAST_DOCUMENTS] = -1
    best = np.argsort(-gain, kind="stable")[:KEPT_FEATURES]
    return best[gain[best] > LEAST_GAIN]


def logistic(doc: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, columns: int, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and constant of a regularised logistic regression, by accelerated gradient steps."""
    n = max(len(label), 1)
    # a bound of the curvature, by power iteration
    v = np.ones(columns)
    for _ in range(12):
        v = np.bincount(column, value * np.bincount(doc, value * v[column], n)[doc], columns)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (0.3 * size / n + 0.3 + ridge)
    w = np.zeros(columns + 1)
    w[-1] = np.log((label.sum() + 1) / (n - label.sum() + 1))
    ahead, past = w.copy(), w.copy()
    for t in range(rounds):
        z = ahead[-1] + np.bincount(doc, value * ahead[column], n)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / n
        slope = np.append(np.bincount(column, value * error[doc], columns) + ridge * ahead[:-1], error.sum())
        past, w = w, ahead - step * slope
        ahead = w + t / (t + 3) * (w - past)
    return w[:-1], float(w[-1])


def packed_counts(n: np.ndarray) -> bytes:
    """Numbers from 0 on in one byte each, those over 254 in eight more at the end."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n > 254].astype("<i8").tobytes()


def unpacked_counts(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", -1, size)
    return n


_COUNTED = "block int, other binary, toxic binary, n_other long, n_toxic long"


def _counted(made: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTED from numbers of documents by class and feature, and by class; blocks that have none are left out."""
    for block in range(FEATURES // BLOCK):
        part = made[:, block * BLOCK : (block + 1) * BLOCK]
        if part.any() or block == 0:
            row = [block, *map(packed_counts, part), *(int(x) if block == 0 else 0 for x in n)]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "other", "toxic", "n_other", "n_toxic"), row, strict=True))], pa.schema([("block", pa.int32()), ("other", pa.binary()), ("toxic", pa.binary()), ("n_other", pa.int64()), ("n_toxic", pa.int64())]))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows of _COUNTED by block."""
    sums: dict[int, np.ndarray] = {}
    n = np.zeros(2, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            n += (row["n_other"], row["n_toxic"])
            own = sums.setdefault(row["block"], np.zeros((2, BLOCK), np.int64))
            for k, told in enumerate((row["other"], row["toxic"])):
                own[k] += unpacked_counts(told, BLOCK)
    for block, own in sums.items():
        told = [block, *map(packed_counts, own), *(int(x) if block == 0 else 0 for x in n)]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(told, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "other", "toxic", "n_other", "n_toxic"])


def document_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many other and toxic documents of `labelled` (label, text) have each feature, and how many there are.

    A task adds up what it has met and sends it once, in blocks of features of about a byte each; so what is shuffled
    is 2 MB a task at most and a block's sum takes one task's bounded memory.  The driver gets one row a block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = (batch.column(0).to_numpy() > 0).astype(np.int64)
            n += np.bincount(label, minlength=2)
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off, COUNTED_BYTES):
                doc, feature = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for k in (0, 1):
                    have[k] += np.bincount(feature[label[i:j][doc] == k], minlength=FEATURES)
        if n.any():
            yield from _counted(have, n)

    told = labelled.mapInArrow(count, _COUNTED).repartition("block").mapInArrow(_added, _COUNTED).toArrow()
    have, n = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for row in told.to_pylist():
        n += (row["n_other"], row["n_toxic"])
        at = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
        have[0, at], have[1, at] = (unpacked_counts(row[k], BLOCK) for k in ("other", "toxic"))
    return have, n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The classifier of labelled documents whose id isn't held out; a document with several labels takes the highest.

    Rows without an id or a label teach nothing; documents that share an id each count with its label, and null texts as
    empty.  Without labels of both kinds the score is the share of toxic labels (0.5 without any).  Features are counted
    over all labelled documents; the regression is fitted on labels drawn, few enough to send to every task.
    """
    bounded(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_id")))
    n = own.count()
    own = own.groupBy("label_id").agg(F.max("label").alias("label"))
    fitted = own if n <= sample_rows else own.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 32)) < int(sample_rows / n * (1 << 32)))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # labels grow with the documents, so they aren't broadcast, however few they are; those drawn have a bound
    labelled, sample = (text.join(of, F.col("doc_id") == F.col("label_id")).select("label", "text") for of in (own.hint("merge"), F.broadcast(fitted)))
    (other, toxic), (n_other, n_toxic) = document_counts(labelled)
    best = np.sort(informative(toxic.astype(float), other.astype(float), n_toxic, n_other)) if n_toxic and n_other else np.zeros(0, np.int64)
    if not len(best):
        return Model(np.zeros(FEATURES), float(np.log((n_toxic + 1) / (n_other + 1))))
    few = toxic + other < LEAST_DOCUMENTS
    scale = ratios(np.where(few, 0, toxic), np.where(few, 0, other))[best]
    wanted = np.zeros(FEATURES, bool)
    wanted[best] = True
    grams = with_levels(wanted)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off, COUNTED_BYTES):
                doc, feature = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], grams)
                doc, feature = doc[wanted[feature]], feature[wanted[feature]]
                edges = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                column = np.searchsorted(best, feature).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([column[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["label", "columns"])

    drawn = sample.mapInArrow(having, "label int, columns binary").toArrow()
    columns = [np.frombuffer(x.as_py(), "<u2") for x in drawn["columns"]]
    label = (drawn["label"].to_numpy() > 0).astype(float)
    doc = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    column = np.concatenate([np.zeros(0, "<u2"), *columns]).astype(np.int64)
    w, constant = logistic(doc, column, scale[column], label, len(best))
    weights = np.zeros(FEATURES)
    weights[best] = w * scale
    return Model(weights, constant)


def _shared(model: Model) -> Callable[[], Model]:
    """What tasks make the model from: the weights that aren't zero."""
    at = np.flatnonzero(model.weights)
    told = (at.astype(np.int32), model.weights[at], model.constant)

    def make() -> Model:
        weights = np.zeros(FEATURES)
        weights[told[0]] = told[1]
        return Model(weights, told[2])

    return make


def _scored(own: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    off, buf = raw_text(column)
    for i, j in slices(off, SCORED_BYTES):
        yield i, j, own.scores(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score reaches the threshold).

    One row per row; a null or empty text has the score of no features.  Other columns are left out.
    """
    make = _shared(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            for i, j, p in _scored(own, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with all their columns, whose score is under the threshold; a null text counts as empty.

    Only texts are sent to Python, which returns a verdict; rows are dropped in the JVM.  Nothing is shuffled.
    """
    bounded(docs.sparkSession)
    make = _shared(model)

    @F.arrow_udf("boolean")
    def is_clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for column in texts:
            yield pa.array(np.concatenate([np.zeros(0), *(p for _, _, p in _scored(own, column))]) < threshold)

    return docs.filter(is_clean(docs[text_col]))
