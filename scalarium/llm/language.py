"""Language identification by a mixture of languages.

A document's words are drawn from several languages at unknown proportions.  Each language's words are scored by
letter trigrams (folded bytes, of which two predict the third) counted over all labelled training documents.
Expectation-maximisation estimates the proportions; the set of languages is the one of best penalised
likelihood among the sets of the k most present languages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarium.llm.tables import bounded
from scalarium.llm.text import raw_text, slices

UNDETERMINED = "und"
#: Symbols of a trigram: 0 parts words, then the letters a to z, 32 kinds of continuation bytes and 5 of lead bytes.
SYMBOLS, SYMBOL_BITS = 64, 6
TRIGRAMS = SYMBOLS**3
FOLD = np.zeros(256, np.uint8)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B] = np.arange(1, 27)
FOLD[0x80:0xC0] = 27 + (np.arange(64) & 31)  # so upper and lower case of Latin-1 letters fall together
FOLD[0xC0:] = 59 + np.arange(64) % 5
ROUNDS = 8
#: What another language must add to the log-likelihood, times the logarithm of the number of words.
PENALTY = 4.0
#: Languages, at most: a model holds 262,144 numbers for each.
MOST_LANGUAGES = 256


def held_out(id_col: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 1 when divided by 3; never for a row without an id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams at each place of the folded text with a parting symbol before, between and after documents; where in
    these each word's trigrams begin and end; how many words each document has."""
    sizes = np.diff(off)
    symbols = np.zeros(len(buf) + len(sizes) + 2, np.int32)
    symbols[np.arange(len(buf)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = FOLD[buf]
    inside = symbols > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    grams = (symbols[:-2] << (2 * SYMBOL_BITS)) | (symbols[1:-1] << SYMBOL_BITS) | symbols[2:]
    words = np.diff(np.searchsorted(starts, off + np.arange(len(off))))
    return grams, starts - 1, ends - 1, words


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, trigram, n over rows of lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has.astype(np.int32)), pa.array(n[has])], names=["lang", "trigram", "n"])
            counts.clear()

        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off):
                grams, starts, ends, words = trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                of = np.repeat(langs[i:j], words)
                sizes = ends - starts
                for lang in set(of):
                    which = of == lang
                    n, a = sizes[which], starts[which]
                    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    if lang not in counts:
                        counts[lang] = np.zeros(TRIGRAMS, np.int64)
                    counts[lang] += np.bincount(grams[at], minlength=TRIGRAMS)
                if len(counts) > 16:
                    yield from told()
        yield from told()

    return docs.select("lang", "text").mapInArrow(run, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


class Model:
    """Conditional log-probabilities of a trigram's last symbol, by language."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    @classmethod
    def of(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
        log_p = np.zeros((TRIGRAMS, len(languages)), np.float32)
        for k in range(len(languages)):
            count = np.zeros(TRIGRAMS)
            count[gram[lang == k]] = n[lang == k]
            three = count.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
            two = three.sum(axis=0)
            one = two.sum(axis=0)
            p1 = (one + 0.5) / (one.sum() + 0.5 * SYMBOLS)
            p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
            p3 = (three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)
            log_p[:, k] = np.log(p3).reshape(-1)
        return cls(languages, log_p)

    def word_scores(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[::2], cuts[1::2] = starts, ends
        return np.add.reduceat(self.log_p[grams], cuts, axis=0)[::2].astype(np.float64)


def mixture(scores: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in documents 0 to n, and the log-likelihood; words are in order of doc."""
    top = scores.max(axis=1, keepdims=True)
    p = np.exp(scores - top)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    words = np.bincount(doc, minlength=n)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    have = doc[begin] if len(doc) else doc
    total = np.zeros(n)
    for _ in range(ROUNDS):
        part = share[doc] * p
        whole = np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        if len(begin):
            share = share.copy()
            share[have] = np.add.reduceat(part / whole, begin, axis=0) / words[have, None]
    whole = np.maximum((share[doc] * p).sum(axis=1), 1e-300)
    if len(begin):
        total[have] = np.add.reduceat(np.log(whole) + top[:, 0], begin)
    return share, total


def proportions(scores: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's proportions of the languages of its best set, and how sure the first of them is (0 to 1)."""
    n, k = len(words), scores.shape[1]
    doc = np.repeat(np.arange(n), words)
    every = np.ones((n, k), bool)
    share, _ = mixture(scores, doc, n, every)
    begin = np.cumsum(words) - words
    single = np.zeros((n, k))
    has = np.flatnonzero(words)
    if len(has):
        single[has] = np.add.reduceat(scores, begin[has], axis=0)
    best = single.argmax(axis=1)
    value = single[np.arange(n), best]
    chosen = np.zeros((n, k))
    chosen[np.arange(n), best] = 1
    sure = np.exp(single - value[:, None])
    sure = 1 / sure.sum(axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, k + 1):
        open_docs = np.flatnonzero(np.take_along_axis(share, order[:, size - 1 : size], 1)[:, 0] >= 0.01)
        if not len(open_docs):
            break
        allowed = np.zeros((len(open_docs), k), bool)
        np.put_along_axis(allowed, order[open_docs, :size], True, 1)
        which = np.flatnonzero(np.isin(doc, open_docs)) if len(open_docs) < n else np.arange(len(doc))
        mixed, likely = mixture(scores[which], np.searchsorted(open_docs, doc[which]), len(open_docs), allowed)
        likely -= PENALTY * (size - 1) * np.log(words[open_docs] + 1)
        better = likely > value[open_docs]
        at = open_docs[better]
        value[at], chosen[at] = likely[better], mixed[better]
        sure[at] = mixed[better].max(axis=1)
    return chosen, sure


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows with a text and a language whose id isn't held out.  It has TRIGRAMS numbers a language."""
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    told = trigram_counts(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))).toArrow()  # at most TRIGRAMS rows a language
    languages = sorted(set(told["lang"].to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {x: k for k, x in enumerate(languages)}
    lang = np.array([place[x] for x in told["lang"].to_pylist()], np.int64)
    return Model.of(languages, lang, told["trigram"].to_numpy(), told["n"].to_numpy())


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _predicted(own: Model, column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """Of each slice of a column of texts: first row, the one after its last, languages, scores, proportions."""
    off, buf = raw_text(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    for i, j in slices(off, (1 << 22) // max(4, len(own.languages))):  # numbers of a slice are words times languages
        part, edges = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        grams, starts, ends, words = trigrams(part, edges)
        n = j - i
        names, score, share = [UNDETERMINED] * n, np.zeros(n), np.zeros((n, len(own.languages)))
        if own.languages and len(starts):
            found, sure = proportions(own.word_scores(grams, starts, ends), words)
            first = found.argmax(axis=1)
            ascii_letters = np.concatenate([[0], np.cumsum((FOLD[part] > 0) & (part < 0x80))])
            plain = np.diff(ascii_letters[edges]) > 0
            data = part.tobytes()
            for d in range(n):
                if words[d] and not null[i + d] and (plain[d] or has_letter(data[edges[d] : edges[d + 1]])):
                    names[d], score[d], share[d] = own.languages[first[d]], min(1.0, max(0.0, sure[d])), found[d]
        yield i, j, names, score, share


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions (JSON of the languages found, by share).

    One row per row.  lang_pred is `und` with a score of 0 if the text is null or has no letter, or if nothing was
    learned.  Other languages are told by name only if the model has learned them.  Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))  # bounded by MOST_LANGUAGES, not by the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for i, j, names, score, share in _predicted(own, batch.column(1)):
                told = [json.dumps({own.languages[k]: round(float(p[k]), 4) for k in np.argsort(-p, kind="stable") if p[k] > 0}) for p in share]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(told, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "proportions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, proportions string")


def known(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, whose language is predicted (not `und`) with at least that score.

    A null text, one without letters and any text when nothing was learned go.  Only texts are sent to Python, which
    returns a verdict; rows are dropped in the JVM.  Nothing is shuffled.
    """
    shared = bounded(docs.sparkSession).sparkContext.broadcast((model.languages, model.log_p))

    @F.arrow_udf("boolean")
    def is_known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for column in texts:
            good = np.zeros(len(column), bool)
            for i, j, names, score, _ in _predicted(own, column):
                good[i:j] = np.array([x != UNDETERMINED for x in names]) & (score >= least_score)
            yield pa.array(good)

    return docs.filter(is_known(docs[text_col]))
