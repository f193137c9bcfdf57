"""The pipeline's stages: what each keeps, on a small table with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    lexicon = {"en": "the of and house water light strange thing".split(), "fr": "le la et maison eau lumière étrange chose".split()}
    words = {k: [w + e for w in v for e in ("", "s", "en", "e", "ly", "ing", "o")] for k, v in lexicon.items()}
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = []
    for k in range(240):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang], k=rng.randint(30, 80)))
        if k % 6 == 0:
            text = "nitwit scoundrel " * 3 + text
        rows.append((k, text, lang, "s", len(text), "extra"))
    rows += [(1000 + k, rows[k][1], "en", "s", 0, None) for k in range(1, 20)]  # exact copies
    rows += [(1100 + k, rows[k][1] + " tail", "en", "s", 0, None) for k in range(1, 20)]  # near copies
    rows += [(1200 + k, " ".join(rng.choices(words["en"], k=50)) + " " + passage, "en", "s", 0, None) for k in range(3)]
    rows += [(2000, None, "en", "s", 0, None), (2001, "", None, None, None, None), (2002, "123 456 !!", "en", "s", 0, None), (None, "the house of light and water", "en", "s", 0, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
            after.write.parquet(path := f"{folder}/out-{k}")
            after = spark.read.parquet(path)
        seen.append((name, docs, after))
        docs = after
    gone = [ids(a) - ids(b) for _, a, b in seen]
    assert gone[0] == {2000, 2001, 2002}
    assert {k for k in range(0, 240, 6)} <= gone[1] | {None} and len(gone[1] - set(range(0, 240, 6)) - {1000 + k for k in range(0, 240, 6)} - {1100 + k for k in range(0, 240, 6)}) <= 2
    assert {1000 + k for k in range(1, 20) if k % 6} <= gone[2] and not any(k is not None and k < 240 for k in gone[2])
    cut = seen[3][2].filter("doc_id >= 1200 and doc_id < 1203").collect()
    assert cut and all("shared" not in r.text and r.n_chars == len(r.text) for r in cut) and gone[3] == set()
    packed = seen[4][2]
    assert ids(packed) == ids(seen[3][2])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_one_row_of_each_class_stays(spark, tmp_path):
    """Repeated rows and copies without an id go but for one, which substring dedup then leaves whole; other texts of an id stay."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
    repeated, nameless, shared, other, mixed = (text() for _ in range(5))
    rows = [(7, repeated)] * 3 + [(None, nameless)] * 3 + [(None, mixed), (30, mixed), (30, mixed), (20, mixed + " tail")]
    rows += [(1, shared), (9, shared + " tail"), (9, other)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    stages = dict(corpus_pipeline.STAGES)
    after = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert after.columns == docs.columns
    after.write.parquet(str(tmp_path / "kept"))
    after = stages["substring dedup"](spark, spark.read.parquet(str(tmp_path / "kept")), str(tmp_path))
    want = [(7, repeated), (None, nameless), (20, mixed + " tail"), (1, shared), (9, other)]
    assert sorted((r.doc_id or 0, r.text) for r in after.collect()) == sorted((k or 0, t) for k, t in want)
