"""The training-data operators against plain versions of what they do, on small tables with odd rows."""

import collections
import glob
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scalarium.llm import audio, bpe, components, language, near, neighbours, packing, substring, tables, text, toxicity, urls, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "The quick brown fox can't  jump; it's 12 o'clock.\n\n"),
    (2, None),
    (3, ""),
    (4, "   "),
    (5, "école ß 中文 😀 <|endoftext|>x"),
    (6, "a" * 3000),
    (7, "word " * 900),
    (7, "word " * 900),
    (8, "'s's 'll'd \x1c\u00a0 \u2003x\r\n\tz"),
    (None, "no id here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in ODD], "doc_id long, text string, n_tokens string, piece int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")


# 1


def test_bpe_is_the_library(spark, docs, empty):
    told = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in ODD:
        ids = told.encode(t or "", add_special_tokens=False).ids
        decoded = told.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(docs, PATH).collect()) == want
    full = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.decoded for r in full)) == sorted((t or "" for _, t in ODD))
    assert bpe.digests(empty, PATH).count() == 0


def test_bpe_on_random_text():
    told = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    pool = ["'s", "'re", " ", "  ", "\n", "a", "B", "é", "1", "22", "!", "'", "<|endoftext|>", "中", "😀", "don't", "\r\n", "ⅷ", "\u00a0", "the", " ing", "\u1c89"]
    some = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(3000)] + ["".join(rng.choices("aeo st", k=rng.randint(0, 60))) for _ in range(2000)]
    got = []
    for _, _, ids, counts in bpe.encoded(pa.array(some), PATH, 4096):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [e.ids for e in told.encode_batch(some, add_special_tokens=False)]


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """Two different words that agree in every polynomial hash modulo a power of two, if long enough."""
    told = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in told), "".join((b, a)[x] for x in told)


@pytest.mark.parametrize("n", [32, 64, 1024])
def test_words_that_hash_alike_are_told_apart(n, monkeypatch):
    told = Tokenizer.from_file(PATH)
    coder = bpe.codec(PATH)
    texts = ["\n".join(thue_morse(n, "a", "b")), " ".join(thue_morse(n, "q", "z")), "one two three " * 3]
    for hashes in (bpe.span_hashes, lambda buf, starts, ends: np.zeros(len(starts), np.uint64)):  # at last all alike
        coder._forget()
        monkeypatch.setattr(bpe, "span_hashes", hashes)
        for t in texts * 2:
            buf = np.frombuffer(t.encode(), np.uint8)
            ids, counts = coder.encode(buf, np.array([0, len(buf)]))
            assert ids.tolist() == told.encode(t, add_special_tokens=False).ids and counts.sum() == len(ids)
            assert coder.decode(ids)[0].tobytes() == t.encode()
    coder._forget()
    a, b = thue_morse(1024, "a", "b")
    buf = np.frombuffer((a + b).encode(), np.uint8)
    first, second = text.span_hashes(buf, np.array([0, 1024]), np.array([1024, 2048]))
    assert first != second


def test_automaton_of_few_merges_agrees_with_merging():
    merges = [(b"a", b"b"), (b"ab", b"a"), (b"b", b"b"), (b"a", b"a"), (b"aba", b"b"), (b"bb", b"a")]
    words = [bytes([b]) for b in b"ab"] + [x + y for x, y in merges]
    machine = bpe.Automaton({w: i for i, w in enumerate(words)}, merges)
    for n in range(1, 9):
        for letters in itertools.product(b"ab", repeat=n):
            parts = [bytes([c]) for c in letters]
            for x, y in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (x, y):
                        parts[k : k + 2] = [x + y]
                    k += 1
            assert [machine.labels[i] for i in machine.encode(bytes(letters))] == parts


def test_words_in_step_agree_with_words_alone():
    """Small alphabets make words turn back, random bytes are no text, and 64 bytes fill the set of closed places."""
    told = bpe.codec(PATH).automaton
    merges = [(b"a", b"b"), (b"ab", b"a"), (b"b", b"b"), (b"a", b"a"), (b"aba", b"b"), (b"bb", b"a")]
    labels = [bytes([b]) for b in b"ab"] + [x + y for x, y in merges]
    few = bpe.Automaton({w: i for i, w in enumerate(labels)}, merges)
    rng = random.Random(3)
    long = [rng.choices(told.labels[:50_000], k=9) for _ in range(2000)]
    some = [bytes(rng.choices(range(256), k=rng.randint(1, 64))) for _ in range(1000)] + [b"".join(x)[:64] for x in long] + [bytes([b]) * 64 for b in range(256)]
    for machine, words in ((few, [bytes(rng.choices(b"ab", k=rng.randint(1, 64))) for _ in range(3000)]), (told, some), (told, [])):
        sizes = np.array([len(w) for w in words], np.int64)
        ids, counts = machine.encode_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes, 700)
        alone = [machine.encode(w) for w in words]
        assert counts.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]
    with pytest.raises(ValueError, match="alphabet"):
        few.encode_spans(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))


def test_new_words_are_not_encoded_one_by_one(monkeypatch):
    """Where most words of a text are new, as in large corpora, encoding each on its own took most of the time of op4_packing."""
    rng = random.Random(9)
    some = " ".join("".join(rng.choices("abdeghilmnorstuäéñ", k=rng.randint(1, 14))) for _ in range(5000))
    coder, alone = bpe.codec(PATH), []
    coder._forget()
    monkeypatch.setattr(coder.automaton, "encode", lambda word: alone.append(word) or [])
    buf = np.frombuffer(some.encode(), np.uint8)
    ids, _ = coder.encode(buf, np.array([0, len(buf)]))
    coder._forget()
    assert not alone and ids.tolist() == Tokenizer.from_file(PATH).encode(some, add_special_tokens=False).ids


def test_numbered_keys():
    rng = np.random.default_rng(4)
    told, known = text.Numbered(2), {}
    for n in (0, 1, 3, 200, 5000):
        keys = np.setdiff1d(np.concatenate([rng.integers(0, 1 << 63, n, np.uint64), np.arange(n, dtype=np.uint64)]), np.array(list(known), np.uint64))
        told.add(keys)
        known |= {k: len(known) + i for i, k in enumerate(keys.tolist())}
        asked = np.concatenate([np.array(list(known), np.uint64), np.arange(2 * n, dtype=np.uint64)])
        assert told.find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]


# 2


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nx"), (6, "u", "ünïcode 😀\n"), (6, "u", "ünïcode 😀\n"), (None, "u", "<p>one</p>"), (None, "u", "alone"), (7, "u", "\r" * 70_001 + "\r\n\r\r\n" * 30_000), (8, "u", "\n\r" * 40_000), (9, "u", "é" * (3 << 20)), (10, "u", "a\r")] + [(k, "v", "hot") for k in range(100, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    best = collections.defaultdict(lambda: None)
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(i, best[html or ""] or i)
    count = collections.Counter(h or "" for _, _, h in rows)
    want = []
    for i, _, html in rows:
        data, top = (html or "").encode(), best[html or ""] if count[html or ""] > 1 else None
        revisit = top is not None and i != top
        want.append((i, len(data), warc.payload_digest(data), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.round_trip(pages.filter("page_id = -1")).count() == 0
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    large = warc.round_trip(pages, least_bytes=1000).collect()
    assert {r.record_type for r in large} == {"response"}
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records([b"WARC/1.1", b"Content-Length: 9", b"", b"short"]))
    with pytest.raises(ValueError, match="longer"):
        list(warc.records([b"WARC/1.1", b"Content-Length: 1", b"", b"long", b""]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.records([b"", b"x"]))


# 3


def _slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_audio(spark, docs, empty):
    assert audio.TABLES["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert audio.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    blocks = np.random.default_rng(1).integers(0, 256, (4, 576)).astype(np.uint8)
    assert audio.adpcm_samples(blocks).tolist() == [_slow_adpcm(bytes(b)) for b in blocks]
    stored = {r.n_bytes: r for r in audio.store(docs).collect()}
    rows = audio.round_trip(docs).collect()
    assert len(rows) == len(ODD) and audio.round_trip(empty).count() == 0
    for r in rows:
        data = next((t or "").encode() for i, t in ODD if len((t or "").encode()) == r.n_bytes and i == r.doc_id)
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        codec = audio.codec_of(payload)
        if codec == "adpcm":
            wide = [x for k in range(0, len(payload), 576) for x in _slow_adpcm(payload[k : k + 576])]
        else:
            wide = [int(audio.TABLES[codec][b]) for b in payload]
        twice = [x for a, b in itertools.pairwise([*wide, wide[-1]]) for x in (a, (a + b) >> 1)]
        pcm = np.array(twice, "<i2")
        assert r.feature == f"{codec};16000;{len(twice)};{sum(x * x for x in twice) // len(twice)};{sum((a < 0) != (b < 0) for a, b in itertools.pairwise(twice))};{zlib.crc32(pcm.tobytes()):08x}"
        assert hashlib.sha256(stored[r.n_bytes].media).hexdigest() == r.media_sha256
    assert audio.wav_data(audio.pcm(audio.store(docs)).first().pcm)[:3] == (1, 16000, 2)


# 4


def test_packing_holds_each_token_once(spark, docs, empty):
    told = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, capacity=64, keep_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for i in (1, 2, 3, 5, 6, None):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == [*told.encode(dict(ODD)[i] or "", add_special_tokens=False).ids, 2]
    cut = [r for r in rows if r.doc_id == 6]
    assert all(r.length == 64 for r in cut if r.piece > 0) and [r.start for r in sorted(cut, key=lambda r: r.piece)] == list(itertools.accumulate([0, *(r.length for r in sorted(cut, key=lambda r: r.piece))][:-1]))
    assert packing.pack_documents(empty, PATH).count() == 0


def test_resampled_audio_is_stored(spark, docs, tmp_path):
    """round_trip() leaves the samples in the shared folder, and the feature is that of the stored ones."""
    before = set(glob.glob(f"{tables.shared_dir(spark)}/pcm-*"))
    told = collections.Counter((r.doc_id, r.feature) for r in audio.round_trip(docs).collect())
    (path,) = set(glob.glob(f"{tables.shared_dir(spark)}/pcm-*")) - before
    kept = spark.read.parquet(path).collect()
    assert collections.Counter((r.doc_id, audio.feature(r.codec, np.frombuffer(audio.wav_data(r.pcm)[3], "<i2"))) for r in kept) == told
    assert all(audio.wav_data(r.pcm)[:3] == (1, 16000, 2) for r in kept)


def test_media_of_one_part_are_held_at_a_time(spark, docs, monkeypatch):
    """Media go once their samples are stored, and no row is lost or repeated between the parts."""
    held, real = [], audio.stored
    media = lambda: set(glob.glob(f"{tables.shared_dir(spark)}/media-*"))
    before = media()

    def stored(*args, **named):
        made = real(*args, **named)
        held.append(len(media() - before))
        return made

    monkeypatch.setattr(audio, "stored", stored)
    rows = audio.round_trip(docs).collect()
    assert max(held) == 1 and media() == before
    whole = audio.describe(audio.pcm(audio.store(docs))).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, whole)) and len(rows) == len(ODD)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(1 + rng.gamma(1.5, 120, 20_000).astype(int), 512), minlength=513)
    made = packing.plan(histogram, 512)
    held = np.zeros(513, np.int64)
    for lengths, n in made:
        assert sum(lengths) <= 512
        for x in lengths:
            held[x] += n
    assert (held == histogram).all()
    least = math.ceil((histogram * np.arange(513)).sum() / 512)
    assert sum(n for _, n in made) <= 1.01 * least


def test_patterns_fill_a_sequence():
    rows = packing.patterns(np.arange(1, 13), 12)
    want = {tuple(sorted(x)) for k in (2, 3) for x in itertools.combinations_with_replacement(range(1, 13), k) if sum(x) == 12}
    assert {tuple(int(x) for x in r if x) for r in rows} == want and len(rows) == len(want)


# 5


@pytest.mark.parametrize("norms", ["unit", "gaussian", "lognormal", "one longer"])
def test_neighbours_recall_by_norms(norms):
    """The windows of a query cover its k-th best, whether norms are equal or not."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    if norms != "gaussian":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.lognormal(0, 0.3, size=(3000, 1)) if norms == "lognormal" else 1
    x[7] *= 3 if norms == "one longer" else 1
    asking = np.arange(0, 3000, 20)
    found = neighbours.Index(x, float(np.linalg.norm(x, axis=1).max())).candidates(x[asking], 21)
    hit = 0
    for q, (f, _) in zip(asking.tolist(), found, strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & set(f.tolist()))
    assert hit >= 0.98 * 20 * len(asking)


def test_windows_widen_by_what_they_newly_take_in():
    """Counts kept while windows widen are those of the last windows counted at once, and few vectors are verified where some are near."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(120, 32))
    x = centres[rng.integers(0, 120, 6000)] + 0.15 * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(x, 1.0)
    hit = 0
    index.begin /= 3  # so windows must widen
    for q, (found, score) in zip(range(0, 6000, 60), index.candidates(x[::60], 21), strict=True):
        exact = x @ x[q]
        assert np.allclose(score, exact[found])
        hit += len(set(np.argsort(-exact)[:21].tolist()) & set(found.tolist()))
        edge = np.sqrt(max(0, 2 - 2 * np.sort(exact[found])[-21]))
        on = np.column_stack([x, np.zeros(6000)]) @ index.lines
        inside = (np.abs(on - on[q]) <= neighbours.WIDTH * edge * 0.999).sum(axis=1) >= neighbours.THRESHOLD
        assert set(np.flatnonzero(inside).tolist()) <= set(found.tolist())
    assert hit >= 0.95 * 21 * 100
    assert index.verified < 0.1 * 6000 * 100


def test_neighbours_recall_on_a_table(spark):
    """9,000 vectors without any structure, in the blocks that the query makes."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(9000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist(), 1, "b") for k, v in enumerate(x)], "vec_id long, embedding array<float>, block int, asks string")
    by = collections.defaultdict(set)
    for r in neighbours.nearest(df).collect():
        by[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 9000, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(by[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 20 * 450


def test_neighbours_of_each_length_and_every_row(spark):
    """Vectors of a rarer length are searched too, and rows that share an id are all candidates."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=8)) for k in range(100)] + [(200 + k, rng.normal(size=5)) for k in range(60)]
    rows += [(33, 9 * rows[0][1]), (33, 7 * rows[0][1]), *[(40, rng.normal(size=8)) for _ in range(30)]]
    got = neighbours.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert sorted(by) == [*range(0, 100, 20), 200, 220, 240]
    for q, found in by.items():
        query = min((v for k, v in rows if k == q), key=lambda v: v.tolist())
        want = sorted(((k, round(float((v * query).sum()), 9)) for k, v in rows if k != q and len(v) == len(query)), key=lambda f: (-f[1], f[0]))[:20]
        assert found == want
    assert [k for k, _ in by[0][:2]] == [33, 33]


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[100:180] = x[100]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [None] * 12), (1080, [float("inf")] * 12), (None, [1.0] * 12), (20, [float(v) for v in x[20]]), (1100, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 400, 20))
    hit = 0
    for q, found in by.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:20]
        hit += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 20 and all(abs(s - score[v]) < 1e-9 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * 20 * len(by)
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        ids = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = rng.geometric(0.2, 200), rng.geometric(0.2, 200)
        keep = rng.random(200) < rng.random()
        b[keep] = a[keep]
        doc = np.repeat([0, 1], [a.sum(), b.sum()])
        s = near.bag_minhash(doc, np.concatenate([np.repeat(ids, a), np.repeat(ids, b)]), 2, 1000)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * 0.016 / math.sqrt(40) and np.std(errors) < 0.03


def _bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def _classes(rows):
    """Classes by comparing all pairs of texts."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        x, y = _bag(a), _bag(b)
        if (a or "") == (b or "") or (x | y).total() and (x & y).total() >= 0.8 * (x | y).total() - 1e-9:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def test_near_duplicates_against_all_pairs(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 7)):
            t = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += ["", "", None, "   ", "a b", "a  b", "a b c", "x " * 300, "x " * 310, "x " * 100, "same line here now\n" * 50, "same line here now\n" * 55]
    rows = list(enumerate(rows))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)
    assert near.near_duplicates(empty).count() == 0
    twice = near.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in twice), key=str) == [(1, 1), (1, 1), (None, None)]


def test_links_across_classes_of_a_bucket(spark):
    """A chain of near copies whose ends differ: each is linked to its neighbours alone."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    t = [rng.choice(words) for _ in range(300)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(t)))
        for _ in range(5):
            t[rng.randrange(300)] = rng.choice(words)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 600)] + [(7, 7), (None, 3)]
    parent = list(range(1000))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(1000) if root(i) != i}


# 7


def _slow_repeats(rows, width):
    found = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = collections.Counter(tuple(w[k : k + width]) for w in found for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, found, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                keep[k : k + width] = [False] * width
        out.append((i, len(w), len(w) - sum(keep), " ".join(itertools.compress(w, keep))))
    return out


def test_repeated_windows_against_counting(spark, empty, monkeypatch):
    rng = random.Random(6)
    words = [rng.choice("abcdefgh") + str(k) for k in range(50)]
    passage = " ".join(rng.choices(words, k=40))
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 90))) + ("\n" + passage if k % 4 == 0 else "")) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "w " * 200), (103, passage), (103, passage), (None, passage + "\u00a0end"), (104, "é\u2003x " * 50)]
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", 100)
    for width in (3, 35):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substring.remove_repeats(df, width).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r) for r in got), key=key) == sorted(_slow_repeats(rows, width), key=key)
    assert substring.remove_repeats(empty).count() == 0
    whole = spark.createDataFrame([(1, "a\n b", "x", 4), (2, passage, "y", 0), (3, passage, None, 0), (4, None, None, 7)], "doc_id long, text string, _spans2 string, n_chars long")
    kept = {r.doc_id: (r.text, r.n_chars) for r in substring.without_repeats(whole).collect()}
    assert kept == {1: ("a\n b", 4), 2: ("", 0), 3: ("", 0), 4: (None, 7)}


def test_packed_numbers():
    places = np.array([0, 1, 254, 255, 600, 1_000_000, 1_000_001])
    assert substring.unpacked_gaps(substring.packed_gaps(places)).tolist() == places.tolist()


def test_windows_that_differ_in_a_word_that_hashes_alike(spark):
    """Words that agree in polynomial hashes don't make windows equal; a word and a text longer than a slice are whole."""
    a, b = thue_morse(1024, "a", "b")
    rest = " ".join(f"w{k}" for k in range(40))
    long = "z" * (3 << 20)
    texts = [f"{a} {rest}", f"{b} {rest}", f"{long} {rest}x", " ".join(f"v{k % 70000}" for k in range(400_000))]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].kept, got[1].kept) == (a, b) and got[0].n_removed == 40
    assert got[2].kept == f"{long} w39x" and got[2].n_removed == 39
    assert got[3].n_removed == 400_000 and got[3].kept == ""


# 8


def test_urls_against_plain_matching(spark):
    rng = random.Random(7)
    hosts = ["com", "example.com", "m.example.com", "xexample.com", "net", "Example.NET", "a.net:80", "org", "", "a.com.x", "u@x.com"]
    paths = ["/en/", "/en/7", "/en/77/" + "z" * 200, "/de/", "/de/8", "/es/", "/e", "", "/a.com/en/", "/de/7?x=/en/", "#/en/", "\n/en/"]
    found = [(k, rng.choice(["http://", "://", "x", "a://b://"]) + rng.choice(hosts) + rng.choice(paths)) for k in range(600)] + [(900, None), (901, ""), (None, "http://com/en/"), (902, "http://É.com/en/é")]
    want = []
    for i, u in found:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path)) if fits else None
        want.append((i, host, path, best and best.host + best.path, best.verdict if best else "allow"))
    got = urls.judge(spark.createDataFrame(found, "page_id long, url string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    many = urls.Automaton([urls.Rule(f"h{k}.com", f"/p{k}/", "block") for k in range(60)])
    assert many.words > 1
    hit = many.fitting([f"a.h{k}.com".encode() for k in range(60)], [f"/p{k}/x".encode() for k in range(60)])
    assert [many.rules[k].host for k in hit] == [f"h{k}.com" for k in range(60)]


# 9, 10


def _corpus(spark, n=400):
    rng = random.Random(8)
    lexicon = {"en": "the of and house water light strange thing".split(), "de": "der die und haus wasser licht straße ding".split(), "fr": "le la et maison eau lumière étrange chose".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(lexicon))
        words = [rng.choice(lexicon[lang]) + rng.choice(["", "s", "en", "e"]) for _ in range(rng.randint(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            words[1:1] = rng.choices(["scoundrel", "nitwit"], k=3)
        rows.append((k, " ".join(words), lang, int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language(spark, empty):
    rows, df = _corpus(spark)
    model = language.train(df)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, "12 !? \n"), (3, "中文"), (4, ""), (5, "the house " * 20 + "die straße und das wasser " * 20), (None, "la maison")], "doc_id long, text string")
    told = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [told[k].lang_pred for k in (1, 2, 4)] == ["und"] * 3 and told[3].lang_pred in model.languages and told[None].lang_pred == "fr" and told[None].held_out is False
    assert list(json.loads(told[5].proportions))[:2] == ["de", "en"] and all(0 <= r.score <= 1 for r in told.values())
    assert language.predict(odd, language.train(empty)).filter("lang_pred <> 'und'").count() == 0


def test_mixture_finds_proportions():
    scores = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.02, 0.96, 0.02]] * 40))
    share, sure = language.proportions(scores, np.array([100, 0]))
    assert abs(share[0, 0] - 0.6) < 0.06 and share[0, 2] == 0 and 0.5 < sure[0] < 0.7


def test_toxicity(spark, empty):
    rows, df = _corpus(spark)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].predicted == r[3] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "nitwit")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.train(empty, empty.select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    some = toxicity.train(df, df.select("doc_id", "toxic"), sample_rows=200)
    assert np.count_nonzero(some.weights)


# shared parts


def test_words_and_windows():
    data = "ab  c\x0b\u00a0d\n".encode()
    buf = np.frombuffer(data + b"x y", np.uint8)
    off = np.array([0, len(data), len(data), len(buf)])
    starts, ends, counts = text.word_bounds(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "\u00a0d", "x", "y"] and counts.tolist() == [3, 0, 2]
    hashes = text.span_hashes(buf, starts, ends)
    assert len(set(hashes.tolist())) == 5
    items = np.array([1, 2, 3, 1, 2, 3, 2, 1, 3], np.uint64)
    at, fits = text.window_starts(np.array([9, 0, 2]), 3)
    assert fits.tolist() == [7, 0, 0]
    w = text.window_hashes(items, at, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 6


def test_shared_folder(spark):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_toxic_counts_are_of_all_labelled_rows(spark):
    """A toxic word that the sample has too rarely gets its weight from the counts of all rows."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices("house water light thing stone river".split(), k=12)) + (" nitwit" if k % 2 else "") + (" zorgblat" if k % 50 == 1 else ""), k % 2) for k in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_rows=200)
    _, feature = toxicity.features(np.frombuffer(b"zorgblat", np.uint8), np.array([0, 8]))
    assert model.weights[feature].max() > 0
