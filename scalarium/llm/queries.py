"""One query per operator over its whole table, with production parameters, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scalarium.llm import audio, bpe, language, near, neighbours, packing, substring, toxicity, urls, warc
from scalarium.llm.tables import table

BPE_FILE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.round_trip(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_warc_revisits, op3_telephony_audio, op4_packing, op5_neighbours, op6_near_duplicates, op7_substring_dedup, op8_url_filters, op9_language, op10_toxicity)
}

#: The other operators can't be said in SQL: a vocabulary's merges, SHA-1, codecs, fitted models and signatures.
ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i : i + 34], ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35)
),
repeated as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by gram) as n from windows) where n > 1
),
covered as (select distinct doc_id, unnest(range(i, i + 35)) as p from repeated),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
kept as (
  select words.doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
  from words anti join covered on words.doc_id = covered.doc_id and words.p = covered.p
  group by words.doc_id
)
select docs.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from docs left join kept on docs.doc_id = kept.doc_id
""",
    "op8_url_filters": r"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
),
rules (of_host, of_path, decision) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
),
fits as (
  select page_id, of_host || of_path as rule, decision,
    row_number() over (partition by page_id order by length(of_host || of_path) desc) as place
  from parts join rules on ends_with('.' || host, '.' || of_host) and starts_with(path, of_path)
)
select parts.page_id, host, path, rule, coalesce(decision, 'allow') as verdict
from parts left join fits on parts.page_id = fits.page_id and place = 1
""",
}
