"""Queries of the language-model data problems (2, 4, 6, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import encode, fuse, history, leaks, spans, topn
from tidewell.shared import table

#: Where the public tokenizers' files lie; a parameter of the encoding query.
TOKENIZERS = "/opt/tokenizers"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_entries(table(spark, d, "timeline_entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_events(table(spark, d, "analyzed_events"))


def _fusion(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "dup_groups"), table(spark, d, "raw_events"), table(spark, d, "sources")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fused_groups(*_fusion(spark, d))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every metadata value judged true (of lists, every element), and from which member it is taken."""
    return fuse.true_values(*_fusion(spark, d)).drop("belief")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).where("edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with up to one edited character, and the number of edits."""
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p6_found, p6_values, p7_ids, p8_found, p8_near, p9_found)}
SQL: dict[str, str] = {
    "p4_found": """select source_id, event_day, rnk, event_id from (select source_id, event_id, event_day, row_number() over (partition by source_id, event_day order by impact_score desc, t desc, event_id) as rnk from
(select *, strftime(t, '%Y-%m-%d') as event_day from (select distinct source_id, event_id, impact_score, try_cast(event_date as timestamptz) at time zone 'UTC' as t from analyzed_events
where source_id is not null and impact_score >= 0 and impact_score <= 10 and not isnan(impact_score)) where t is not null)) where rnk <= 3""",
    "p6_found": """with ev as (select distinct event_seq, source, event_date, content, metadata from raw_events),
src as (select k, max(p) as p from (select lower(regexp_replace(unnest([source_id, source_name]), '[\\s\\p{Z}_-]+', '', 'g')) as k, coalesce(priority, 0) as p from sources) group by k),
mem as (select group_id, seq, min(pos) as pos from (select group_id, unnest(duplicates) as seq, generate_subscripts(duplicates, 1) as pos from dup_groups) group by group_id, seq),
m as (select mem.*, coalesce(src.p, 0) as pr, event_date, content, case when not json_valid(metadata) then null when json_type(metadata) = 'OBJECT' then metadata
when json_type(metadata) = 'VARCHAR' and json_valid(json_extract_string(metadata, '$')) and json_type(json_extract_string(metadata, '$')) = 'OBJECT' then json_extract_string(metadata, '$') end as md
from mem join ev on ev.event_seq = mem.seq left join src on src.k = lower(regexp_replace(coalesce(source, ''), '[\\s\\p{Z}_-]+', '', 'g'))),
mm as (select *, count(*) over (partition by group_id) as n from m),
pri as (select group_id, seq from (select *, row_number() over (partition by group_id order by pr desc, pos) as r from mm where n >= 2) where r = 1),
con as (select group_id, seq from (select mm.*, row_number() over (partition by mm.group_id order by length(content) desc, mm.seq = pri.seq desc, pos) as r from mm join pri on mm.group_id = pri.group_id where trim(content, chr(32) || chr(9) || chr(10) || chr(13)) <> '') where r = 1),
val as (select group_id, k, seq, pr, event_date, json_extract(md, '$.' || k) as v, json_extract_string(md, '$.' || k) as s from mm, (select unnest(['authors', 'summary', 'license', 'repo_url', 'reading_minutes', 'doi', 'lang']) as k) where n >= 2 and md is not null),
met as (select group_id, k, seq from (select *, row_number() over (partition by group_id, k order by pr desc, event_date desc nulls last, seq) as r from val
where v is not null and json_type(v) <> 'NULL' and cast(v as varchar) not in ('[]', '{}') and not (json_type(v) = 'VARCHAR' and lower(trim(s)) in ('', 'n/a'))) where r = 1)
select group_id, 'primary' as field_name, seq as event_seq from pri union all select group_id, 'content', seq from con union all select group_id, 'metadata.' || k, seq from met""",
    "p8_found": """with d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
t as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d where len(w) >= 12)),
tg as (select item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from t where len(w) >= 12))
select distinct doc_id, item_id from dg join tg on dg.g = tg.g""",
    "p9_found": """with w as (select doc_id, i, md5(substring(text, i, 400)) as h from (select doc_id, text, unnest(range(1, length(text) - 398)) as i from documents where length(text) >= 400)),
s as (select h from w group by h having count(distinct doc_id) > 1),
c as (select doc_id, i, lead(i) over (partition by doc_id order by i) as following from (select distinct doc_id, i from w where h in (select h from s)))
select doc_id, cast(sum(least(coalesce(following - i, 400), 400)) as bigint) as shared_chars from c group by doc_id""",
    "p2_found": """with recursive e as (select entry_seq, id, try_cast(substring(event_date, 1, 10) as date) as day, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) as w from timeline_entries),
pairs as (select a.entry_seq as i, b.entry_seq as j from e a join e b on a.id = b.id where a.entry_seq < b.entry_seq
union select a.entry_seq, b.entry_seq from e a join e b on b.day between a.day - 3 and a.day + 3 where a.entry_seq < b.entry_seq and len(a.w) > 0 and len(b.w) > 0
and 10 * len(list_intersect(a.w, b.w)) >= 6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
nodes as (select v, row_number() over (order by v) as k, early from (select v, list(u) filter (u is not null) as early from (select j as v, i as u from pairs union all select i, null from pairs) group by v)),
walk as (select 0::bigint as k, []::bigint[] as taken union all
select nodes.k, case when len(list_intersect(coalesce(nodes.early, []), walk.taken)) = 0 then list_append(walk.taken, nodes.v) else walk.taken end from walk join nodes on nodes.k = walk.k + 1),
accepted as (select unnest(taken) as v from (select taken from walk order by k desc limit 1))
select min(i) as kept_seq, j as dup_seq from pairs where i in (select v from accepted) and j not in (select v from accepted) group by j""",
}
