"""Language and toxicity models against plain versions of what they do, a document and a symbol at a time."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from scalarium.llm import language, toxicity

WORDS = {
    "en": "the and that with house river winter garden bread water stone light friend morning window paper",
    "de": "der und das mit haus fluss winter garten brot wasser stein licht freund morgen fenster papier über schön",
    "fr": "le et que avec maison rivière hiver jardin pain eau pierre lumière ami matin fenêtre papier",
}


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def symbols(text: str) -> list[int]:
    return [int(language.FOLD[b]) for b in text.encode()]


def word_grams(text: str) -> list[list[tuple[int, int, int]]]:
    words, now = [], []
    for s in [*symbols(text), 0]:
        if s:
            now.append(s)
        elif now:
            padded = [0, *now, 0]
            words.append([tuple(padded[k : k + 3]) for k in range(len(now))])
            now = []
    return words


class PlainLanguage:
    """Trigram counts by language, the smoothed probability of a third symbol, and mixtures by plain loops."""

    def __init__(self, rows):
        self.three = collections.defaultdict(collections.Counter)
        for lang, text in rows:
            for word in word_grams(text):
                self.three[lang].update(word)
        self.languages = sorted(self.three)
        self.two, self.one = {}, {}
        for lang, counts in self.three.items():
            self.two[lang], self.one[lang] = collections.Counter(), collections.Counter()
            for (_, b, c), n in counts.items():
                self.two[lang][b, c] += n
                self.one[lang][c] += n

    def log_p(self, lang, gram):
        a, b, c = gram
        one, two, three = self.one[lang], self.two[lang], self.three[lang]
        p1 = (one[c] + 0.5) / (sum(one.values()) + 0.5 * 64)
        p2 = (two[b, c] + 8 * p1) / (sum(n for (x, _), n in two.items() if x == b) + 8)
        return math.log((three[gram] + 8 * p2) / (sum(n for (x, y, _), n in three.items() if (x, y) == (a, b)) + 8))

    def mixture(self, scores, allowed):
        share = {lang: 1 / len(allowed) for lang in allowed}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for s in scores:
                part = {lang: share[lang] * math.exp(s[lang] - max(s.values())) for lang in allowed}
                whole = max(sum(part.values()), 1e-300)
                for lang in allowed:
                    new[lang] += part[lang] / whole / len(scores)
            share = new
        return share, sum(math.log(max(sum(share[lang] * math.exp(s[lang] - max(s.values())) for lang in allowed), 1e-300)) + max(s.values()) for s in scores)

    def predict(self, text):
        if text is None or not any(c.isalpha() for c in text) or not self.languages:
            return "und", 0.0
        known = {}
        scores = [{lang: sum(known.setdefault((lang, g), self.log_p(lang, g)) for g in word) for lang in self.languages} for word in word_grams(text)]
        if not scores:
            return "und", 0.0
        single = {lang: sum(s[lang] for s in scores) for lang in self.languages}
        best = max(self.languages, key=lambda x: single[x])
        value, chosen, sure = single[best], {best: 1.0}, 1 / sum(math.exp(x - single[best]) for x in single.values())
        share, _ = self.mixture(scores, self.languages)
        order = sorted(self.languages, key=lambda x: -share[x])
        for size in range(2, len(order) + 1):
            if share[order[size - 1]] < 0.01:
                break
            mixed, likely = self.mixture(scores, order[:size])
            likely -= language.PENALTY * (size - 1) * math.log(len(scores) + 1)
            if likely > value:
                value, chosen, sure = likely, mixed, max(mixed.values())
        return max(chosen, key=lambda x: chosen[x]), sure


def prose(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_language_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, lang, rng.randrange(3, 30)), lang) for k, lang in enumerate(["en", "de", "fr"] * 12)]
    rows += [(100, prose(rng, "en", 20) + " " + prose(rng, "fr", 25), "en"), (101, prose(rng, "de", 30) + "\n" + prose(rng, "en", 6), None)]
    rows += [(102, None, "en"), (103, "", "de"), (104, " 12 - 7 ", "fr"), (105, "中文", None), (None, prose(rng, "de", 9), "de"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (106, "ß", None)]
    df = spark.createDataFrame([(*r, "a", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    plain = PlainLanguage([(lang, t) for i, t, lang in rows if i is not None and not held(i) and t is not None and lang is not None])
    got = language.predict(df, language.train(df)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, _ in rows:
        lang, score = plain.predict(t)
        want[i, i is not None and held(i), lang, round(score, 3)] += 1
    told = collections.Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in got)
    close = lambda a: {(i, h, lang) for i, h, lang, _ in a}
    assert close(told) == close(want) and sum(told.values()) == sum(want.values())
    scores = {(r.doc_id, r.lang_pred): r.score for r in got}
    assert all(abs(scores[i, lang] - s) < 0.01 for i, _, lang, s in want)
    assert sum(len(x.split()) > 0 and len(eval(x)) > 1 for x in (r.proportions for r in got if r.doc_id == 100)) == 1


def test_language_of_empty_tables_and_long_texts(spark):
    schema = "doc_id long, text string, lang string, extra array<int>"
    empty = spark.createDataFrame([], schema)
    model = language.train(empty)
    assert model.languages == [] and language.predict(empty, model).count() == 0
    rng = random.Random(4)
    long = prose(rng, "fr", 400_000)
    df = spark.createDataFrame([(0, prose(rng, "en", 50), "en", [1]), (1, prose(rng, "fr", 50), "fr", None), (30, long, None, [2]), (40, None, None, None)], schema)
    assert not held(0) and not held(1)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.train(df)).collect()}
    assert got == {0: "en", 1: "fr", 30: "fr", 40: "und"}
    kept = language.known(df, language.train(df), 0.3)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 30]
    assert {r.lang_pred for r in language.predict(df, model).collect()} == {"und"} and language.known(df, model, 0.3).count() == 0


def plain_features(text: str) -> set[int]:
    seq = [0]
    for s in symbols(text):
        if s or seq[-1]:
            seq.append(s)
    seq.append(0)
    count = collections.Counter()
    for order in toxicity.ORDERS:
        for i in range(len(seq) - order + 1):
            code = 0
            for s in seq[i : i + order]:
                code = code << 6 | s
            count[((code + order) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - toxicity.FEATURE_BITS)] += 1
    levels = [(k + 1) * 0x9E377 & (toxicity.FEATURES - 1) for k in range(len(toxicity.COUNTS))]
    return {f ^ level for f, n in count.items() for least, level in zip(toxicity.COUNTS, levels, strict=True) if n >= least}


TEXTS = ["you are a nasty fool fool fool", "what a lovely day", "", "   ", "über  schön!!  a", "fool " * 40, "x", "fooll", "a nasty, nasty day"]


def test_features_against_plain_loops():
    data = [t.encode() for t in TEXTS]
    off = np.cumsum([0, *map(len, data)])
    doc, feature = toxicity.features(np.frombuffer(b"".join(data), np.uint8), off)
    got = [set(feature[doc == d].tolist()) for d in range(len(TEXTS))]
    assert got == [plain_features(t) for t in TEXTS] and len(feature) == sum(map(len, got))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        words = rng.choices(WORDS["en"].split(), k=12) + (["nasty", "fool"] if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words), "s", 0.5))
        labels.append((k, 1, int(toxic)))
    docs += [(0, docs[0][1], "s", 0.5), (None, "nasty fool", None, None), (900, None, None, None), (901, "", None, None)]
    labels += [(4, 0, 0), (5, None, None), (None, 1, 1), (901, 0, 0), (950, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_toxicity_against_plain_counts(spark, labelled):
    df, of, docs, labels = labelled
    told = {}
    for i, _, y in labels:
        if i is not None and y is not None and not held(i):
            told[i] = max(told.get(i, 0), y)
    rows = [(told[i], plain_features(t or "")) for i, t, *_ in docs if i in told]
    counts = [collections.Counter(f for y, fs in rows if y == k for f in fs) for k in (0, 1)]
    have, n = toxicity.document_counts(spark.createDataFrame([(told[i], t) for i, t, *_ in docs if i in told], "label int, text string").repartition(5))
    assert n.tolist() == [sum(y == k for y, _ in rows) for k in (0, 1)]
    for k in (0, 1):
        at = np.flatnonzero(have[k])
        assert dict(zip(at.tolist(), have[k][at].tolist(), strict=True)) == dict(counts[k])
    model = toxicity.train(df, of)
    # weights are those of a regression on features scaled by log-count ratios: its slope vanishes
    n0, n1 = n.tolist()
    entropy = lambda k, m: -sum(x * math.log(x / m) for x in (k, m - k) if 0 < x)
    every = {f: (counts[0][f], counts[1][f]) for f in counts[0] | counts[1]}
    gain = {f: entropy(a + b, n0 + n1) - entropy(a, n0) - entropy(b, n1) for f, (a, b) in every.items() if a + b >= toxicity.LEAST_DOCUMENTS}
    best = {f for f, g in gain.items() if g > toxicity.LEAST_GAIN + 1e-9}
    kept = set(np.flatnonzero(model.weights).tolist())
    assert kept <= {f for f, g in gain.items() if g > toxicity.LEAST_GAIN - 1e-6} and len(best - kept) <= 0.02 * len(best)
    all_1 = sum(counts[1][f] for f in gain) + toxicity.FEATURES
    all_0 = sum(counts[0][f] for f in gain) + toxicity.FEATURES
    ratio = {f: math.log((every[f][1] + 1) / all_1) - math.log((every[f][0] + 1) / all_0) for f in kept}
    z = [model.constant + sum(model.weights[f] for f in fs & kept) for _, fs in rows]
    error = [1 / (1 + math.exp(-x)) - y for x, (y, _) in zip(z, rows, strict=True)]
    assert abs(sum(error)) / len(rows) < 1e-3
    for f in list(kept)[:50]:
        slope = sum(e * ratio[f] for e, (_, fs) in zip(error, rows, strict=True) if f in fs) / len(rows) + 1e-4 * model.weights[f] / ratio[f]
        assert abs(slope) < 5e-3
    # scores are of the whole text by these weights
    got = collections.Counter((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in toxicity.score(df, model).collect())
    want = collections.Counter()
    for i, t, *_ in docs:
        p = 1 / (1 + math.exp(-(model.constant + sum(model.weights[f] for f in plain_features(t or "") & kept))))
        want[i, i is not None and held(i), round(p, 6), int(p >= 0.7)] += 1
    assert got == want
    truth = dict((k, k % 4 == 0) for k in range(240) if held(k))
    by = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(by[k] == t for k, t in truth.items()) >= 0.97 * len(truth)
    clean = toxicity.clean(df, model)
    assert clean.columns == df.columns and clean.count() == sum(n for (*_, p), n in want.items() if not p)


def test_toxicity_of_empty_tables_and_long_texts(spark, labelled):
    df, of, *_ = labelled
    none = df.limit(0)
    model = toxicity.train(none, of)
    assert toxicity.score(none, model).count() == 0 and {r.score for r in toxicity.score(df, model).collect()} == {0.5}
    model = toxicity.train(df, of)
    long = spark.createDataFrame([(1, "lovely morning " * 200_000 + "nasty fool"), (2, "z" * (2 << 20))], "doc_id long, text string")
    assert toxicity.score(long, model).count() == 2 and toxicity.clean(long, model).count() <= 2
    one_kind = toxicity.train(df, of.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score(df, one_kind).collect()} == {0}
