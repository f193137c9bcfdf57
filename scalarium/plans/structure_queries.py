"""Queries with their SQL: sources, corpus, reveal, evidence, profiles, packages.

Tables of parts, relationships, regions and so on are derived from the star schema; the same derivation stands in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scalarium.functions import characters, identity, strings
from scalarium.operators import assembly, detectors, diffs, evidence, packaging, profiles, reveal, validation
from scalarium.operators import findings as found_in
from scalarium.plans import corpus, planted, reports
from scalarium.plans.queries import _EMOJI_SQL, _FINDINGS_SQL, _KINDS_SQL, ORACLE_SQL, QUERIES, joined, query
from scalarium.sources import decode, sinks, workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sources ---------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several encodings, some broken."""
    docs = planted.texts(spark, sf_dir)
    text, which = F.col("text"), F.pmod("doc_id", F.lit(5))
    content = (
        F.when(which == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(which == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(which == 3, F.concat(text.cast("binary"), F.unhex(F.lit("C328"))))
        .otherwise(text.cast("binary"))
    )
    return docs.select("doc_id", F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), content.alias("content"))


@query(f"with {planted.SQL} select doc_id, case when doc_id % 5 = 1 then 'utf-16-le' when doc_id % 5 = 2 then 'utf-16-be' else 'utf-8' end as encoding, case when doc_id % 5 = 1 then 'fffe' when doc_id % 5 = 2 then 'feff' else bom end as bom, case when doc_id % 5 = 3 then null else sha256(case when doc_id % 5 in (1, 2) then chr(65279) || text else text end) end as text_sha256, case when doc_id % 5 = 3 then cast(strlen(text) as bigint) end as failed_at from texts")
def encoding_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.decoded(_files(spark, sf_dir))
    return rows.select("doc_id", "encoding", "bom", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("failure.start").cast("long").alias("failed_at"))


@query(f"with {planted.SQL} select doc_id, case when doc_id % 5 = 3 then 'text.decode_failed' end as failure_code, 'text/plain' as mime from texts")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.parsed(_files(spark, sf_dir)).select("doc_id", "failure_code", "mime")


@query(r"select page_id, 'text' as format, case when regexp_matches(html, '(?i)^[\x{FEFF} \t\r\n]*(<!doctype html|<html)') then 'text/html' else 'text/plain' end as mime from pages")
def format_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.lit("page").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return decode.identified(decode.decoded(pages)).select("page_id", "format", "mime")


@query(
    "with recursive files as (select row_number() over (partition by c_nationkey order by c_custkey) as k, c_nationkey, c_custkey, cast(c_custkey % 1000 as bigint) as size from customer), "
    "walk as (select c_nationkey, cast(0 as bigint) as k, cast(null as bigint) as c_custkey, cast(null as varchar) as state, cast(9000 as bigint) as rest from (select distinct c_nationkey from customer) "
    "union all select f.c_nationkey, f.k, f.c_custkey, case when w.rest <= 1 then 'execution.resource_limit' when f.size <= least(990, w.rest - 1) then 'read' when f.size > 990 then 'file.too_large' else 'execution.resource_limit' end, "
    "w.rest - case when w.rest > 1 and f.size <= least(990, w.rest - 1) then f.size else 0 end from walk w join files f on f.c_nationkey = w.c_nationkey and f.k = w.k + 1) "
    "select c_nationkey, c_custkey, state from walk where k > 0"
)
def acquisition_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("path"), (F.col("c_custkey") % 1000).cast("long").alias("size")).alias("f"))
    folders = files.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("f")).alias("files"))
    return folders.select("c_nationkey", F.inline(workspace.acquisition(F.col("files"), 9000, 990))).select("c_nationkey", F.col("path").cast("long").alias("c_custkey"), "state")


# corpus ----------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str, code: Column) -> DataFrame:
    """Planted texts as parsed files, some with a failure code; where and why decoding failed isn't planted."""
    return planted.texts(spark, sf_dir).withColumns({"failure_code": code, "failure": F.lit(None).cast("struct<encoding:string,start:int,end:int,reason:string>")})


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.pmod("doc_id", F.lit(17)) == 3, "text.decode_failed").when(F.pmod("doc_id", F.lit(17)) == 4, "format.unsupported")
    parsed = _parsed(spark, sf_dir, code)
    return corpus.entries(parsed, corpus.audited(parsed))


_STATES_SQL = _FINDINGS_SQL + ", counts as (select doc_id, count(*) as n, max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) as code from found group by doc_id), states as (select d.doc_id, case when d.doc_id % 17 = 3 then 'failed' when d.doc_id % 17 = 4 then 'unsupported' when n > 0 then 'requires_review' else 'no_reported_findings' end as state, case when d.doc_id % 17 in (3, 4) then 4 else coalesce(code, 0) end as exit_code from documents d left join counts on d.doc_id = counts.doc_id)"


@query(f"with {_STATES_SQL} select doc_id, state, cast(exit_code as bigint) as exit_code from states")
def corpus_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", "state", "exit_code")


@query(f"with {_STATES_SQL} select 'partial' as state, cast(count(*) as bigint) as entries, " + ", ".join(f"cast(count(*) filter (where state = '{s}') as bigint) as {s}" for s in corpus.STATES) + ", cast(max(exit_code) as bigint) as exit_code from states")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(_corpus(spark, sf_dir))


@query()
def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.digested(corpus.records(_corpus(spark, sf_dir))).select("part", "line", "canonical_sha256")


@query("select doc_id, cast(sum(strlen(coalesce(text, ''))) over (order by doc_id) as bigint) as upto, sum(strlen(coalesce(text, ''))) over (order by doc_id) <= 1000000 as fits from documents")
def output_budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.within_budget(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")), ["doc_id"], F.col("size"), 1_000_000).select("doc_id", "upto", "fits")


# reveal ----------------------------------------------------------------------------------------------------------

@query(f"with {planted.SCALARS} select doc_id, sha256(string_agg(case when ch = chr(92) then repeat(chr(92), 2) when cp = 9 then chr(92) || 't' when cp = 13 then chr(92) || 'r' when cp = 10 or cp between 32 and 126 then ch else chr(92) || 'u{{' || lpad(hex(cp), cast(greatest(4, length(hex(cp))) as integer), '0') || '}}' end, '' order by pos)) as escaped_sha256 from scalars group by doc_id")
def display_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reveal.display_escapes(planted.texts(spark, sf_dir)).select("doc_id", F.sha2(F.col("escaped").cast("binary"), 256).alias("escaped_sha256"))


_EMOJI_PARTS = _EMOJI_SQL[_EMOJI_SQL.index(", emoji_ranges") :].replace("points as", "emoji_points as").replace("from points", "from emoji_points")
_REVEAL_SQL = _KINDS_SQL + _EMOJI_PARTS + ", shown as (select s.doc_id, s.pos, s.ch, s.cp, case when h.pos is not null or m.pos is not null then 'finding' when s.ch = chr(10214) then 'literal_marker_escape' end as reason from scalars s left join hits h on h.doc_id = s.doc_id and h.pos = s.pos left join (select distinct doc_id, pos from marked) m on m.doc_id = s.doc_id and m.pos = s.pos)"
_NAMES_SQL = planted.sql_ranges("names", [(cp, cp, title.replace("'", "''")) for cp, title in sorted({ord(c): characters.name(ord(c), "UNNAMED CONTROL") for t in [*planted.TAILS, planted.MARK] for c in t}.items())])
_SHOWN_SQL = "case reason when 'finding' then chr(10214) || 'U+' || lpad(hex(cp), cast(greatest(4, length(hex(cp))) as integer), '0') || ' ' || of || chr(10215) when 'literal_marker_escape' then repeat(ch, 2) else ch end"


@query(f"with {_REVEAL_SQL}, {_NAMES_SQL}, whole as (select doc_id, string_agg({_SHOWN_SQL}, '' order by pos) as rendered from shown left join names on cp = lo group by doc_id) select doc_id, cast(length(rendered) as bigint) as length, sha256(rendered) as sha256 from whole")
def reveal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reveal.revealed(planted.texts(spark, sf_dir)).select("doc_id", F.length("rendered").cast("long").alias("length"), F.sha2(F.col("rendered").cast("binary"), 256).alias("sha256"))


@query(f"with {_REVEAL_SQL} select h.doc_id, cast(h.pos as bigint) as pos, h.reason, cast(strlen(substr(text, 1, h.pos)) as bigint) as source_start, cast(strlen(substr(text, 1, h.pos + 1)) as bigint) as source_end from shown h join texts using (doc_id) where h.reason is not null")
def reveal_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reveal.occurrences(planted.texts(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "reason", "source_start", "source_end")


def _line_sql() -> str:
    return f"with {planted.SCALARS}, lines as (select doc_id, case when ends_with(text, chr(10)) then string_split(text[:-2], chr(10)) else string_split(text, chr(10)) end as l from texts), each_line as (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as k, len(l) as n from lines), changed as (select * from each_line where regexp_matches(line, '[^ -\\[\\]-~]') or contains(line, chr(92))), fresh as (select *, coalesce(k - lag(k) over (partition by doc_id order by k) > 7, true) as new from changed), grouped as (select *, sum(case when new then 1 else 0 end) over (partition by doc_id order by k) as hunk from fresh)"


@query(_line_sql() + " select doc_id, cast(greatest(min(k) - 2, 1) as bigint) as start, cast(least(max(k) + 4, max(n)) as bigint) as \"end\", cast(count(*) as bigint) as changed from grouped group by doc_id, hunk")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    return reveal.hunks(texts.select("doc_id", F.col("text").alias("before"), strings.display_escaped(F.col("text")).alias("after")))


# evidence --------------------------------------------------------------------------------------------------------

_REGIONS_SQL = "regions as (select l_orderkey as source_id, cast(l_linenumber * 40 as bigint) as start, cast(l_linenumber * 40 + l_quantity as bigint) as \"end\" from lineitem), spans as (select l_orderkey as source_id, cast(l_linenumber * 40 + l_suppkey % 20 as bigint) as start, cast(l_linenumber * 40 + l_suppkey % 20 + 12 as bigint) as \"end\" from lineitem)"


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _table(spark, sf_dir, "lineitem")
    begin = F.col("l_linenumber") * 40
    at = begin + F.col("l_suppkey") % 20
    both = [(begin, begin + F.col("l_quantity")), (at, at + 12)]
    # SQL rounds where it casts, half to even
    return tuple(items.select(F.col("l_orderkey").alias("source_id"), a.cast("long").alias("start"), F.rint(b).cast("long").alias("end")) for a, b in both)


_MERGED_SQL = _REGIONS_SQL + ", marked as (select *, case when start > coalesce(max(\"end\") over (partition by source_id order by start, \"end\" rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from regions), numbered as (select *, sum(new) over (partition by source_id order by start, \"end\" rows unbounded preceding) as k from marked), merged as (select source_id, min(start) as start, max(\"end\") as \"end\" from numbered group by source_id, k)"


@query(f"with {_MERGED_SQL} select source_id, start, \"end\" from merged")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merged_regions(_regions(spark, sf_dir)[0])


@query(f"with {_MERGED_SQL} select s.source_id, s.start, s.\"end\" from spans s where not exists (select 1 from merged m where m.source_id = s.source_id and m.start <= s.start and s.\"end\" <= m.\"end\")")
def scope_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, spans = _regions(spark, sf_dir)
    return evidence.outside(spans, regions)


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    state = F.element_at(F.array(*map(F.lit, ("completed", "completed", "completed", "partial", "failed", "canceled", "incomplete", "disabled"))), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, ("acquisition", "parser", "analysis"))), (F.pmod("l_linenumber", F.lit(3)) + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), stage.alias("stage"), state.alias("state"), (F.pmod(k, F.lit(3)) == 0).alias("usable"), (F.pmod(k, F.lit(5)) == 0).alias("optional"))


_EXEC_SQL = "executions as (select l_orderkey as source_id, case l_linenumber % 3 when 0 then 'acquisition' when 1 then 'parser' else 'analysis' end as stage, case l_partkey % 8 when 3 then 'partial' when 4 then 'failed' when 5 then 'canceled' when 6 then 'incomplete' when 7 then 'disabled' else 'completed' end as state, l_partkey % 3 = 0 as usable, l_partkey % 5 = 0 as optional from lineitem)"


@query(
    f"with {_EXEC_SQL}, told as (select source_id, bool_or(stage in ('acquisition', 'parser') and state = 'failed') as broken, bool_or(state = 'partial') as partial, bool_or(state = 'canceled') as canceled, bool_or(state in ('failed', 'incomplete')) as incomplete, bool_or(usable) as usable, bool_or(optional and state = 'failed') as spare from executions where state <> 'disabled' group by source_id) "
    "select source_id, case when broken then 'failed' when partial then 'partial' when canceled then case when usable then 'partial' else 'canceled' end when incomplete then case when usable or spare then 'partial' else 'failed' end else 'completed' end as status from told"
)
def status_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.status(_executions(spark, sf_dir))


@query(f"with {_EXEC_SQL} select stage, state, cast(count(*) as bigint) as executions from executions group by stage, state")
def execution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executions(spark, sf_dir).groupBy("stage", "state").agg(F.count(F.lit(1)).alias("executions"))


@query("select l_orderkey as source_id, l_suppkey % 20 as ref from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_custkey % 20 >= l.l_suppkey % 20)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_suppkey") % 20).alias("ref"))
    targets = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("o_custkey") % 20).cast("long"))).alias("ref"))
    return evidence.dangling(rows, "ref", targets)


@query("select l_orderkey as source_id, l_suppkey as ref, cast(count(*) as bigint) as n from lineitem group by l_orderkey, l_suppkey having count(*) > 1")
def duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.duplicates(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("ref")), ["source_id", "ref"])


@query(f"with {_KINDS_SQL}, isles as (select doc_id, kind, pos, pos - row_number() over (partition by doc_id, kind order by pos) as island from hits) select doc_id as source_id, kind as ref, cast(min(pos) as bigint) as start, cast(max(pos) + 1 as bigint) as \"end\" from isles group by doc_id, kind, island")
def anchor_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scalarium.operators.scalars import classified

    return evidence.spans(classified(planted.texts(spark, sf_dir)).select(F.col("doc_id").alias("source_id"), F.col("kind").alias("ref"), "pos"))


@query(
    "with recursive items as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as k, cast(o_orderkey % 900 as bigint) as size from orders), "
    "walk as (select distinct o_custkey, cast(0 as bigint) as k, cast(0 as bigint) as grp, cast(0 as bigint) as n, cast(0 as bigint) as total from orders union all "
    "select i.o_custkey, i.k, w.grp + case when w.n >= 4 or (w.n > 0 and w.total + i.size > 1500) then 1 else 0 end, case when w.n >= 4 or (w.n > 0 and w.total + i.size > 1500) then 1 else w.n + 1 end, case when w.n >= 4 or (w.n > 0 and w.total + i.size > 1500) then i.size else w.total + i.size end from walk w join items i on i.o_custkey = w.o_custkey and i.k = w.k + 1) "
    "select o_custkey, string_agg(cast(grp as varchar), ',' order by k) as groups from walk where k > 0 group by o_custkey"
)
def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 900).cast("long").alias("size")))), lambda x: x["size"]).alias("sizes"))
    return items.select("o_custkey", evidence.span_groups(F.col("sizes"), 4, 1500).alias("groups")).select("o_custkey", joined("groups"))


@query()
def selection_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each planted text's spans, which cover it; a text without characters has nothing to select, so its digest is null."""
    return planted.texts(spark, sf_dir).select("doc_id", identity.selection_digest(F.col("text"), evidence.covering(F.col("text"))).alias("digest"))


# profiles --------------------------------------------------------------------------------------------------------


def _profile(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Rules from parts, facts from what they are; observations from customers, facts from their orders."""
    part, orders, customer = (_table(spark, sf_dir, t) for t in ("part", "orders", "customer"))
    rules = part.select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % 3).alias("kind"), F.element_at(F.array(*map(F.lit, profiles.ASSESSMENTS)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("assessment"), F.when(F.col("p_partkey") % 7 == 0, "retain").alias("queue"))
    facts = part.select(F.col("p_partkey").alias("rule_id"), F.explode(F.array(F.col("p_partkey") % 11, F.col("p_partkey") % 13)).alias("fact"))
    observations = customer.select(F.col("c_custkey").alias("observation_id"), F.col("c_nationkey").alias("artifact_id"), (F.col("c_custkey") % 3).alias("kind"), F.when(F.col("c_custkey") % 9 == 0, "other").otherwise("main").alias("scope"), (F.col("c_custkey") % 8 != 0).alias("complete"))
    has = orders.select(F.col("o_custkey").alias("observation_id"), (F.col("o_orderkey") % 13).alias("fact"))
    signals = customer.select(F.col("c_custkey").alias("signal_id"), F.col("c_nationkey").alias("artifact_id"), ((F.col("c_custkey") % 2 == 0) | (F.col("c_nationkey") % 4 > 0)).alias("mapping_complete"))
    targets = customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("signal_id"), F.col("c_custkey").alias("observation_id"))
    return rules, facts, observations, has, signals, targets


_PROFILE_SQL = (
    "rules as (select p_partkey as rule_id, p_partkey % 3 as kind, p_partkey % 4 as rank, case when p_partkey % 7 = 0 then 'retain' end as queue from part), "
    "rule_facts as (select distinct rule_id, fact from (select p_partkey as rule_id, unnest([p_partkey % 11, p_partkey % 13]) as fact from part)), "
    "observations as (select c_custkey as observation_id, c_nationkey as artifact_id, c_custkey % 3 as kind, case when c_custkey % 9 = 0 then 'other' else 'main' end as scope, c_custkey % 8 <> 0 as complete from customer), "
    "facts as (select distinct o_custkey as observation_id, o_orderkey % 13 as fact from orders), "
    "fits as (select r.rule_id, o.observation_id, r.rank, r.queue from rules r join observations o on r.kind = o.kind where not exists (select 1 from rule_facts f where f.rule_id = r.rule_id and not exists (select 1 from facts x where x.observation_id = o.observation_id and x.fact = f.fact)))"
)


@query(f"with {_PROFILE_SQL} select rule_id, observation_id from fits")
def profile_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, facts, observations, has, *_ = _profile(spark, sf_dir)
    return profiles.rule_matches(rules, facts, observations, has).select("rule_id", "observation_id")


@query(
    f"with {_PROFILE_SQL}, best as (select observation_id, max(rank) as rank, bool_or(coalesce(queue = 'retain', false)) as retain from fits group by observation_id), signals as (select c_custkey as id, c_nationkey as artifact_id, c_custkey % 2 = 0 or c_nationkey % 4 > 0 as full_map, c_custkey % 5 = 0 as aimed from customer), "
    "told as (select o.*, b.rank, b.retain, o.observation_id in (select id from signals where aimed) as mapped, exists (select 1 from signals s where not s.full_map and s.artifact_id = o.artifact_id and not (s.aimed and s.id = o.observation_id)) as unmapped from observations o left join best b on b.observation_id = o.observation_id), "
    "why as (select *, case when scope <> 'main' then 'profile_scope_mismatch' when mapped then 'pattern_override' when unmapped then 'unmapped_pattern_requires_review' when not complete then 'coverage_or_mapping_incomplete' when rank is null then 'no_matching_rule' else 'rules_matched' end as reason from told), "
    "final as (select *, case when mapped then 'suspicious' when reason = 'rules_matched' then ['expected', 'noteworthy', 'unknown', 'suspicious'][rank + 1] else 'unknown' end as assessment from why) "
    "select observation_id, assessment, reason, reason = 'rules_matched' and assessment = 'expected' and not coalesce(retain, false) as omit_default from final"
)
def profile_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.assessments("main", *_profile(spark, sf_dir))


# packages --------------------------------------------------------------------------------------------------------


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as packages: a part for each supplier number, relationships from line items."""
    items = _table(spark, sf_dir, "lineitem")
    source = F.col("l_orderkey").alias("source_id")
    parts = items.select(source, F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Word/Part").otherwise("word/part"), F.col("l_suppkey") % 10, F.when(F.col("l_linenumber") % 3 == 0, ".xml").otherwise(".bin")).alias("name")).distinct()
    target = F.concat(F.element_at(F.array(*map(F.lit, ("part", "../word/part", "/word/part", "./part", "../../part", "pa%72t"))), (F.col("l_partkey") % 6 + 1).cast("int")), F.col("l_suppkey") % 12, F.lit(".xml"))
    rels = items.select(source, F.col("l_linenumber").alias("rel_id"), F.lit("word/document.xml").alias("source_part"), target.alias("target"), F.when(F.col("l_quantity") > 45, "External").otherwise("Internal").alias("mode"))
    return parts, rels


_PARTS_SQL = (
    "parts as (select distinct l_orderkey as source_id, case when l_linenumber % 2 = 0 then 'Word/Part' else 'word/part' end || (l_suppkey % 10) || case when l_linenumber % 3 = 0 then '.xml' else '.bin' end as name from lineitem), "
    "rels as (select l_orderkey as source_id, l_linenumber as rel_id, l_partkey % 6 as form, 'word/part' || (l_suppkey % 12) || '.xml' as goal, case when l_quantity > 45 then 'External' else 'Internal' end as mode from lineitem)"
)


@query(
    f"with {_PARTS_SQL}, known as (select source_id, lower(name) as fold, count(*) as n, min(name) as name from parts group by source_id, lower(name)) "
    "select r.source_id, r.rel_id, case when mode = 'External' then 'external' when form in (4, 5) then 'invalid' when n is null then 'missing' when n > 1 then 'ambiguous' else 'resolved' end as state, case when mode <> 'External' and form not in (4, 5) and n = 1 then name end as part from rels r left join known k on k.source_id = r.source_id and k.fold = r.goal"
)
def relationship_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, rels = _packages(spark, sf_dir)
    return packaging.resolved_relationships(rels, parts).select("source_id", "rel_id", "state", "part")


def _types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts, _ = _packages(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey"))
    defaults = orders.filter("o_custkey % 4 <> 0").select("source_id", F.lit("XML").alias("extension"), F.lit("application/xml").alias("content_type"))
    overrides = orders.select("source_id", F.concat(F.lit("/word/part"), F.col("o_custkey") % 10, F.lit(".bin")).alias("name"), F.lit("application/main").alias("content_type"))
    return parts, defaults, overrides


_TYPES_SQL = _PARTS_SQL + ", overrides as (select o_orderkey as source_id, 'word/part' || (o_custkey % 10) || '.bin' as name from orders)"


@query(
    f"with {_TYPES_SQL} select p.source_id, p.name, case when v.name is not null then 'application/main' when o_custkey % 4 <> 0 and ends_with(p.name, '.xml') then 'application/xml' end as content_type, case when v.name is not null then 'override' when o_custkey % 4 <> 0 and ends_with(p.name, '.xml') then 'default' else 'missing' end as basis from parts p left join overrides v on v.source_id = p.source_id and v.name = lower(p.name) left join orders on o_orderkey = p.source_id"
)
def content_type_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaging.content_types(*_types(spark, sf_dir))


@query(f"with {_TYPES_SQL} select v.source_id, '/' || v.name as name from overrides v where not exists (select 1 from parts p where p.source_id = v.source_id and lower(p.name) = v.name)")
def override_without_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _, overrides = _types(spark, sf_dir)
    return packaging.overrides_without_part(overrides, parts).select("source_id", "name")


_MANIFEST_SQL = _PARTS_SQL + ", manifest as (select o_orderkey as source_id, unnest(['/', 'word/', 'Word/', 'word/part' || (o_custkey % 10) || '.bin']) as path from orders)"


@query(
    f"with {_MANIFEST_SQL} select coalesce(m.source_id, p.source_id) as source_id, coalesce(m.path, p.name) as path, case when m.path is null then 'unlisted' when m.path = '/' then 'package' when ends_with(m.path, '/') then case when exists (select 1 from parts q where q.source_id = m.source_id and starts_with(q.name, m.path)) then 'directory' else 'missing' end when p.name is not null then 'resolved' else 'missing' end as state from manifest m full outer join parts p on p.source_id = m.source_id and p.name = m.path"
)
def manifest_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _ = _packages(spark, sf_dir)
    manifest = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.explode(F.array(F.lit("/"), F.lit("word/"), F.lit("Word/"), F.concat(F.lit("word/part"), F.col("o_custkey") % 10, F.lit(".bin")))).alias("path"))
    return packaging.manifest_membership(manifest, parts)


@query("with runs as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events) select user_id, event_type, cast(count(*) as bigint) as length, cast(count(distinct island) as bigint) as runs from runs group by user_id, event_type")
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    rows = events.withColumn("island", order("user_id") - order("user_id", "event_type"))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("length"), F.countDistinct("island").alias("runs"))


# graph and diffs -------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planted texts of which some failed, what was executed, and numbered findings."""
    which = F.pmod("doc_id", F.lit(17))
    code = F.when(which == 3, "text.decode_failed").when(which == 4, "file.too_large")
    parsed = _parsed(spark, sf_dir, code)
    found = found_in.ordered_ranks(corpus.audited(parsed))
    return parsed, assembly.executions(parsed), found


@query(
    "with c(k, capability, stage) as (values " + ", ".join(f"({k}, '{c}', '{s}')" for k, (c, s, *_) in enumerate(assembly.CAPABILITIES)) + ") "
    "select doc_id as source_id, 'exec/' || k as ref, case when k >= 8 then 'disabled' when doc_id % 17 = 3 and k = 1 then 'failed' when doc_id % 17 = 4 and k = 0 then 'failed' when doc_id % 17 = 3 and k > 1 then 'not_run' when doc_id % 17 = 4 and k > 0 then 'not_run' else 'completed' end as state from documents cross join c"
)
def execution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].select("source_id", "ref", "state")


@query(f"with {_FINDINGS_SQL} select d.doc_id as source_id, cast(count(f.id) as bigint) as findings from documents d left join (select * from found where starts_with(id, 'unicode.') and id <> 'unicode.emoji') f on d.doc_id = f.doc_id where d.doc_id % 17 not in (3, 4) group by d.doc_id")
def execution_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, run, found = _graph(spark, sf_dir)
    return assembly.results(run, found).filter("capability = 'analyze.unicode'").select("source_id", "findings")


@query(
    "with told as (select doc_id as source_id, doc_id % 17 not in (3, 4) as good from documents) "
    "select source_id, 'artifact.parent' as problem from told where good and source_id % 11 = 0 union all "
    "select source_id, 'artifact.repeated' from told where source_id % 13 = 0 and source_id % 11 <> 0 union all "
    "select source_id, 'execution.repeated' from told where source_id % 19 = 5 union all "
    "select source_id, 'anchor.outside' from told where good and source_id % 16 = 2"
)
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks find in a graph that was broken: sources without their bytes, repeated rows, spans moved behind the text."""
    parsed, run, found = _graph(spark, sf_dir)
    at = lambda n: F.pmod("source_id", F.lit(n))
    made = assembly.artifacts(parsed)
    source = F.col("ref") == "artifact/0"
    made = made.filter(~(source & (at(11) == 0))).unionByName(made.filter(source & (at(13) == 0) & (at(11) != 0)))
    run = run.unionByName(run.filter((F.col("ref") == "exec/2") & (at(19) == 5)))
    moved = F.when(at(16) == 2, 1 << 24).otherwise(0)
    spans = assembly.anchors(found).withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved})
    return assembly.problems(run, made, spans, parsed.filter("failure_code is null"))


@query("select doc_id from documents where doc_id % 5 <> 3 and (doc_id % 3 = 0 or doc_id % 7 = 0)")
def unverified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose claimed text isn't what their bytes decode to: some claims are longer, some missing."""
    files = decode.decoded(_files(spark, sf_dir)).filter("failure is null")
    claim = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(None)).when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return decode.unverified(files.select("doc_id", "content", claim.alias("text"))).select("doc_id")


@query()
def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = planted.texts(spark, sf_dir)
    return diffs.compared(texts)


@query(
    f"with {_KINDS_SQL}, first as (select doc_id, min(n) as n from (select doc_id, cp, count(*) as n from hits group by doc_id, cp) group by doc_id) "
    "select doc_id as source_id, 'finding.coordinates' as problem from first where doc_id % 11 = 0 union all select doc_id, 'finding.repeated' from first where doc_id % 13 = 0 union all select doc_id, 'finding.severity' from first where doc_id % 7 = 3"
)
def report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of findings say of some whose places were moved, references repeated or severities misspelt."""
    texts = planted.texts(spark, sf_dir)
    found = found_in.ordered_ranks(detectors.unicode_kinds(texts))
    at = lambda n: F.pmod("doc_id", F.lit(n))
    moved = F.when(at(11) == 0, F.transform("byte_offsets", lambda b: b + 1)).otherwise(F.col("byte_offsets"))
    odd = F.when(at(7) == 3, F.lower("severity")).otherwise(F.col("severity"))
    broken = found.withColumns({"byte_offsets": moved, "severity": odd}).withColumn("copies", F.explode(F.when(at(13) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copies")
    return validation.finding_problems(broken, texts).select("source_id", "problem").distinct()


@query(
    f"with {planted.SCALARS}, places as (select doc_id, cast(coalesce(sum(strlen(ch)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as b from scalars union all select doc_id, cast(strlen(text) as bigint) from texts), "
    "told as (select doc_id, sum(length(cast(b as varchar))) + count(*) - 1 as n, count(*) as numbers from places group by doc_id) "
    "select t.doc_id, cast(strlen(text) + n as bigint) as least_bytes, cast(numbers as bigint) as least_numbers, strlen(text) + n <= 20000 and numbers <= 3000 as fits from told t join texts using (doc_id)"
)
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, numbers = validation.least_report(F.col("text"))
    return planted.texts(spark, sf_dir).select("doc_id", size.alias("least_bytes"), numbers.alias("least_numbers"), validation.fits_report(F.col("text"), 20_000, 3_000).alias("fits"))


@query("select o_custkey % 50 as fold_group, cast(count(*) as bigint) as n from orders group by o_custkey % 50 having count(*) > 1")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Dir/É").otherwise("dir/É"), (F.col("o_custkey") % 50).cast("string"))
    rows = sinks.colliding_paths(_table(spark, sf_dir, "orders").select(path.alias("path")))
    return rows.select(F.regexp_extract("fold", r"(\d+)$", 1).cast("long").alias("fold_group"), "n")


@query()
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, found = _graph(spark, sf_dir)
    return reports.reports(parsed, found.drop("finding_ref")).select("doc_id", "exit_code", "sha256")


@query(f"with {_STATES_SQL} select state, cast(exit_code as bigint) as exit_code, cast(count(*) as bigint) as documents from states group by state, exit_code")
def corpus_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).groupBy("state", "exit_code").agg(F.count(F.lit(1)).alias("documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]
