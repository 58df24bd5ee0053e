"""Queries of the event timeline, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text, urls
from tidewell.operators import analysis, fuzzy, ingest, stats, timeline
from tidewell.shared import table
from tidewell.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    """The raw events, each delivery once."""
    return table(spark, d, "raw_events").withColumn("event_date", F.col("event_date").cast("timestamp")).dropDuplicates(["event_seq"])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The timeline entries that have a day, with it."""
    return table(spark, d, "timeline_entries").withColumn("day", F.to_date(F.substring("event_date", 1, 10))).where("day is not null")


_EVENTS = "(select distinct on (event_seq) * from raw_events order by event_seq)"
_ENTRIES = "(select *, try_cast(substring(event_date, 1, 10) as date) as day from timeline_entries where try_cast(substring(event_date, 1, 10) as date) is not null)"
_SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KEY = f"strftime(day, '%Y-%m') || '-' || {_SLUG}"


def _half_up(x: str, scale: int = 10) -> str:
    return f"floor({x} * {scale}.0::double + 0.5::double) / {scale}.0::double"


_IMPACT = _half_up("(significance.technological_breakthrough * 0.35::double + significance.industry_impact * 0.3::double + significance.adoption_scale * 0.2::double + significance.novelty * 0.15::double)")


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    """Analysed events, each once, with the score of their significance."""
    rows = table(spark, d, "analyzed_events").dropDuplicates(["event_id"])
    return rows.withColumn("computed", analysis.impact_score(F.col("significance")))


_ANALYSED = f"(select *, {_IMPACT} as computed from (select distinct on (event_id) * from analyzed_events order by event_id))"


@query(f"""select event_id, computed as impact_score, loaded_day from (select event_id, computed, strftime(loaded_at, '%Y-%m-%d') as loaded_day, loaded_at from
(select *, {_IMPACT} as computed from (select event_id, any_value(significance) as significance, min(loaded_at) as loaded_at from analyzed_events group by event_id)))
where loaded_at between timestamp '2025-11-01 00:00:00' and timestamp '2025-11-30 23:59:59' and computed >= 7 order by computed desc, loaded_at desc, event_id limit 40""")
def weekly_top_n(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "analyzed_events").groupBy("event_id").agg(F.any_value("significance").alias("significance"), F.min("loaded_at").alias("event_ts"))
    rows = ingest.in_window(rows, "event_ts", "2025-11-01 00:00:00", "2025-11-30 23:59:59").withColumn("impact_score", analysis.impact_score(F.col("significance")))
    return analysis.select_top(rows, 7.0, 40).select("event_id", "impact_score", F.date_format("event_ts", "yyyy-MM-dd").alias("loaded_day"))


@query(f"select event_id, computed as impact_score from {_ANALYSED}")
def impact_score(spark: SparkSession, d: str) -> DataFrame:
    return _analysed(spark, d).select("event_id", F.col("computed").alias("impact_score"))


@query(f"select event_seq, source, epoch_us(event_date) as event_us from {_EVENTS} where event_date between timestamp '2025-10-20 00:00:00' and timestamp '2025-11-10 00:00:00'")
def ingest_window(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.in_window(_raw_events(spark, d), "event_date", "2025-10-20 00:00:00", "2025-11-10 00:00:00")
    return rows.select("event_seq", "source", F.unix_micros("event_date").alias("event_us"))


@query(f"select event_seq, source, pos from (select event_seq, source, row_number() over (partition by source order by event_date desc nulls last, event_seq) as pos from {_EVENTS}) where pos <= 20")
def topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.top_per_key(_raw_events(spark, d), ["source"], [F.desc_nulls_last("event_date"), "event_seq"], 20).select("event_seq", "source", "pos")


@query("select item_seq, id, source from (select *, row_number() over (partition by id order by item_seq) as n from raw_items) where n = 1")
def keep_first_by_id(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_per_key(table(spark, d, "raw_items"), ["id"], ["item_seq"]).select("item_seq", "id", "source")


@query("select item_seq, substring(sha1(coalesce(url, '')), 1, 12) as item_hash, md5(coalesce(title, '') || '-' || coalesce(url, '')) as event_key from raw_items")
def item_hashes(spark: SparkSession, d: str) -> DataFrame:
    url, title = F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))
    return table(spark, d, "raw_items").select("item_seq", F.substring(F.sha1(url), 1, 12).alias("item_hash"), F.md5(F.concat(title, F.lit("-"), url)).alias("event_key"))


@query("select item_seq, title, coalesce(nullif(trim(summary), ''), title) as content, source, len(coalesce(authors, [])) as n_authors from raw_items")
def raw_item_to_event(spark: SparkSession, d: str) -> DataFrame:
    content = ingest.content_or_title(F.col("summary"), F.col("title"))
    return table(spark, d, "raw_items").select("item_seq", "title", content.alias("content"), "source", F.size(F.coalesce("authors", F.array().cast("array<string>"))).cast("bigint").alias("n_authors"))


@query("""select rss_seq, trim(regexp_replace(title, '[ \\t\\n\\r\\f]+', ' ', 'g')) as title, source_id, list_aggregate(coalesce(authors, case when creator is null then [] else [creator] end), 'string_agg', ';') as authors
from rss_items where length(link) > 0 and length(title) > 0""")
def rss_mapped(spark: SparkSession, d: str) -> DataFrame:
    creator = F.when(F.col("creator").isNull(), F.array().cast("array<string>")).otherwise(F.array("creator"))
    who = F.coalesce("authors", creator)
    title = F.trim(F.regexp_replace("title", r"[ \t\n\r\f]+", " "))
    return table(spark, d, "rss_items").where("length(link) > 0 and length(title) > 0").select("rss_seq", title.alias("title"), "source_id", F.when(F.size(who) > 0, F.array_join(who, ";")).alias("authors"))


@query("""select source_table, source_ordinal, source, count(*) as n from (select 'raw_items' as source_table, 0 as source_ordinal, source from raw_items
union all select 'rss_items', 1, source_id from rss_items) group by all""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.union_sources(raw_items=table(spark, d, "raw_items").select("source"), rss_items=table(spark, d, "rss_items").select(F.col("source_id").alias("source")))
    return rows.groupBy("source_table", "source_ordinal", "source").agg(F.count("*").alias("n"))


@query("select kind, enabled, count(*) as n, count(*) filter (rate_limit_qpm > 0) as limited, max(coalesce(priority, 0)) as top_priority from sources group by kind, enabled")
def source_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").groupBy("kind", "enabled").agg(F.count("*").alias("n"), F.count_if(F.col("rate_limit_qpm") > 0).alias("limited"), F.max(F.coalesce("priority", F.lit(0))).alias("top_priority"))


@query("""select node_id, coalesce(json_extract_string(doc, '$.headline'), json_extract_string(doc, '$.name')) as title, json_extract_string(doc, '$.url') as url, json_extract_string(doc, '$.datePublished') as published
from (select node_id, case when json_valid(node) then node end as doc from jsonld_nodes) where json_extract_string(doc, '$."@type"') = 'BlogPosting'""")
def jsonld_items(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "jsonld_nodes").select("node_id", F.try_parse_json("node").alias("doc"))
    get = lambda path: F.try_variant_get("doc", path, "string")
    return doc.where(get("$['@type']") == "BlogPosting").select("node_id", F.coalesce(get("$.headline"), get("$.name")).alias("title"), get("$.url").alias("url"), get("$.datePublished").alias("published"))


@query(f"""select violation, count(*) as n from (select unnest([case when title is null or length(title) not between 1 and 500 then 'title' end, case when coalesce(source, '') = '' then 'source' end,
case when not coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+'), false) then 'url' end, case when coalesce(content, '') = '' then 'content' end, case when event_date is null then 'date' end]) as violation from {_EVENTS}) where violation is not null group by violation""")
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    bad = F.array(
        F.when(F.col("title").isNull() | ~F.length("title").between(1, 500), "title"),
        F.when(F.coalesce("source", F.lit("")) == "", "source"),
        F.when(~urls.is_valid(F.col("url")), "url"),
        F.when(F.coalesce("content", F.lit("")) == "", "content"),
        F.when(F.col("event_date").isNull(), "date"),
    )
    return _raw_events(spark, d).select(F.explode(bad).alias("violation")).where("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


@query(f"select event_seq, trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')) as plain from {_EVENTS}")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _raw_events(spark, d).select("event_seq", text.normal_text(F.col("title")).alias("plain"))


_WORDS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) > 2)"
_TERMS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) > 4 or regexp_matches(w, '[0-9]') or regexp_matches(w, '^[a-z]{{2,}}$'))"


def _similarity_sql(a: str, b: str) -> str:
    """SQL of the combined similarity of two normal texts."""
    wa, wb, ta, tb = _WORDS.format(a), _WORDS.format(b), _TERMS.format(a), _TERMS.format(b)
    common = f"len(list_intersect({wa}, {wb}))"
    jac = f"case when len({wa}) = 0 or len({wb}) = 0 then 0.0::double else {common}::double / (len({wa}) + len({wb}) - {common}) end"
    over = f"case when len({ta}) = 0 or len({tb}) = 0 then 0.0::double else len(list_intersect({ta}, {tb}))::double / least(len({ta}), len({tb})) end"
    lev = f"case when greatest(length({a}), length({b})) = 0 then 1.0::double else 1::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end"
    inside = f"case when contains({a}, {b}) or contains({b}, {a}) then 0.9::double else 0.0::double end"
    return f"case when {a} = {b} then 1.0::double else greatest({jac}, {inside}, case when ({over}) > 0.5 then {over} else 0.0::double end, {lev}) end"


_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_]+', ' ', 'g'))"


@query(f"""select group_id, member, round({_similarity_sql('a', 'b')}, 9) as similarity from (
select g.group_id, g.member, {_PLAIN.format('x.title')} as a, {_PLAIN.format('y.title')} as b from
(select group_id, duplicates[1] as leader, unnest(list_distinct(duplicates)) as member from dup_groups) g
join {_EVENTS} x on x.event_seq = g.leader join {_EVENTS} y on y.event_seq = g.member where g.member <> g.leader)""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    titles = _raw_events(spark, d).select("event_seq", text.normal_text(F.coalesce("title", F.lit(""))).alias("plain"))
    members = table(spark, d, "dup_groups").select("group_id", F.try_element_at("duplicates", F.lit(1)).alias("leader"), F.explode(F.array_distinct("duplicates")).alias("member")).where("member <> leader")
    pairs = members.join(titles.select(F.col("event_seq").alias("leader"), F.col("plain").alias("a")), "leader").join(titles.select(F.col("event_seq").alias("member"), F.col("plain").alias("b")), "member")
    return pairs.select("group_id", "member", F.round(text.text_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


_DOMAIN = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^(.*?)www\\.', '\\1')"
_PREPARED = f"""prepared as (select event_seq, source, url, epoch_us(event_date) as ts, {_DOMAIN} as domain, {_PLAIN.format('title')} as nt, {_PLAIN.format('substring(content, 1, 500)')} as nc, length(coalesce(content, '')) > 0 as has from {_EVENTS} where event_date is not null),
firsts as (select event_seq, min(event_seq) over (partition by url) as first from prepared where url is not null),
candidates as (select a.event_seq as i, b.event_seq as j from prepared a join prepared b on b.ts between a.ts - 172800000999 and a.ts + 172800000999 where a.event_seq < b.event_seq
union select first, event_seq from firsts where first < event_seq),
scored as (select i, j, case when a.url = b.url then 1.0::double when abs(a.ts // 1000 - b.ts // 1000) <= 172800000 then
({_similarity_sql('a.nt', 'b.nt')}) * 0.5::double + (case when a.has and b.has then ({_similarity_sql('a.nc', 'b.nc')}) * 0.3::double else 0.0::double end) + (case when a.domain = b.domain then 0.1::double else 0.0::double end)
+ (1::double - abs(a.ts // 1000 - b.ts // 1000)::double / 172800000.0::double) * 0.1::double else 0.0::double end as score
from candidates join prepared a on a.event_seq = i join prepared b on b.event_seq = j),
pairs as (select i, j, score from scored where score >= 0.6)"""
_LED = f"""with recursive {_PREPARED},
links as (select i, j from pairs union select a.event_seq, b.event_seq from prepared a join prepared b on a.url = b.url where a.event_seq < b.event_seq),
nodes as (select v, row_number() over (order by v) as k, early from (select v, list(u) filter (u is not null) as early from (select j as v, i as u from links union all select i, null from links) group by v)),
walk as (select 0::bigint as k, []::bigint[] as lead union all
select nodes.k, case when len(list_intersect(coalesce(nodes.early, []), walk.lead)) = 0 then list_append(walk.lead, nodes.v) else walk.lead end from walk join nodes on nodes.k = walk.k + 1),
leads as (select unnest(lead) as v from (select lead from walk order by k desc limit 1)),
led as (select v as member, v as leader from leads union all select j, min(i) from links where i in (select v from leads) and j not in (select v from leads) group by j)"""


@query(f"with {_PREPARED} select i, j, round(score, 6) as score from pairs")
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.duplicate_pairs(table(spark, d, "raw_events")).select("i", "j", F.round("score", 6).alias("score"))


@query(f"{_LED} select member, leader from led")
def dedup_leaders(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.duplicate_groups(table(spark, d, "raw_events")).select("member", "leader")


_PRIORITIES = "(select source, max(priority) as priority from (select source_name as source, coalesce(priority, 0) as priority from sources union all select source_id, coalesce(priority, 0) from sources) group by source)"


def _priorities(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "sources").select(F.explode(F.array("source_name", "source_id")).alias("source"), F.coalesce("priority", F.lit(0)).alias("priority"))
    return named.groupBy("source").agg(F.max("priority").alias("priority"))


@query(f"""{_LED}, rows as (select leader, e.event_seq, e.source, length(coalesce(e.content, '')) as chars, coalesce(p.priority, 0) as priority from led join {_EVENTS} e on e.event_seq = led.member left join {_PRIORITIES} p on p.source = e.source),
best as (select leader, arg_max(event_seq, priority * 1000000000000 - event_seq) as primary_seq, arg_max(chars, priority * 1000000000000 - event_seq) as pc, max(chars) as mc, arg_max(event_seq, chars * 1000000000000 - event_seq) as longest, count(*) as duplicate_count, count(distinct source) as n_sources from rows group by leader)
select leader, primary_seq, case when pc = mc then primary_seq else longest end as content_seq, duplicate_count, n_sources from best""")
def dedup_merged(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "raw_events")
    return fuzzy.merged_groups(events, fuzzy.duplicate_groups(events), _priorities(spark, d))


@query(f"{_LED} select (select count(*) from prepared) as original, (select count(*) from led where member <> leader) as removed, round((select count(*) from led where member <> leader)::double / (select count(*) from prepared), 9) as rate")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "raw_events")
    groups = fuzzy.duplicate_groups(events)
    total = events.where("event_seq is not null and event_date is not null").agg(F.count_distinct("event_seq").alias("original"), F.lit(0).cast("bigint").alias("removed"))
    gone = groups.agg(F.lit(0).cast("bigint").alias("original"), F.count_if(F.col("member") != F.col("leader")).alias("removed"))
    return total.unionByName(gone).agg(F.sum("original").alias("original"), F.sum("removed").alias("removed")).select("original", "removed", F.round(F.coalesce(F.try_divide("removed", "original"), F.lit(0.0)), 9).alias("rate"))


@query(f"select item_seq, {_DOMAIN} as domain from raw_items")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").select("item_seq", urls.domain(F.col("url")).alias("domain"))


@query("""select rss_seq, case when coalesce(regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+'), false) then
regexp_replace(regexp_replace(regexp_replace(link, '#.*$', ''), '([?&])(?:utm_(?:source|medium|campaign|term|content)=[^&]*(?:&|$))+', '\\1', 'g'), '[?&]+$', '') else link end as link from rss_items""")
def url_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_items").select("rss_seq", urls.sanitised(F.col("link")).alias("link"))


@query(f"select entry_seq, strftime(day, '%Y-%m-%d') || '-' || substring({_SLUG}, 1, 50) as timeline_id, strftime(day, '%Y-%m-%d') || '-' || substring({_SLUG}, 1, 30) as analysis_id, {_KEY} as month_key from {_ENTRIES} where title is not null")
def event_ids(spark: SparkSession, d: str) -> DataFrame:
    day, title = F.col("day"), F.col("title")
    rows = _entries(spark, d).where("title is not null")
    return rows.select("entry_seq", text.event_id(day, title).alias("timeline_id"), text.event_id(day, title, 30).alias("analysis_id"), text.month_key(day, title).alias("month_key"))


def _map_sql(column: str, names: dict[str, str]) -> str:
    values = " ".join(f"when '{k}' then '{v}'" for k, v in names.items())
    return f"case lower(trim({column})) {values} else '{text.DEFAULT_CATEGORY}' end"


@query(f"select category, {_map_sql('category', text.ANALYSED_CATEGORIES)} as timeline_category, count(*) as n from {_ANALYSED} group by all")
def category_map(spark: SparkSession, d: str) -> DataFrame:
    return _analysed(spark, d).groupBy("category", text.mapped_category(F.col("category"), text.ANALYSED_CATEGORIES).alias("timeline_category")).agg(F.count("*").alias("n"))


_CATEGORY = "case " + " ".join(f"when {' or '.join(f'''contains(lower(text), '{w}')''' for w in ws)} then '{n}'" for n, ws in analysis.CATEGORY_WORDS) + " else 'research' end"


@query(f"select doc_id, {_CATEGORY} as category from documents where text is not null")
def mock_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", analysis.built_in_category(F.col("text")).alias("category"))


def _mock(shift: str) -> str:
    return _half_up(f"least(10::double, greatest(0::double, least(9.3::double, greatest(7.2::double, length(text)::double / 200::double + 7::double)) + ({shift}::double)))")


@query(f"""select doc_id, {_half_up("(t * 0.35::double + i * 0.3::double + a * 0.2::double + n * 0.15::double)")} as impact_score, tokens from
(select doc_id, {_mock('0.3')} as t, {_mock('-0.2')} as i, {_mock('-0.1')} as a, {_mock('0.4')} as n, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents where text is not null)""")
def mock_score(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "documents").where("text is not null").withColumn("s", analysis.built_in_scores(F.col("text")))
    return scores.select("doc_id", analysis.impact_score(F.col("s")).alias("impact_score"), F.ceil(F.length("text") / 4).alias("tokens"))


@query(f"""select doc_id, rnk, word, freq from (select *, row_number() over (partition by doc_id order by freq desc, place) as rnk from (select doc_id, word, count(*) as freq, min(place) as place from
(select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from (select doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as w from documents where text is not null))
where length(word) between 4 and 17 and word not in ({', '.join(f"'{w}'" for w in analysis.STOP_WORDS)}) group by doc_id, word)) where rnk <= 4""")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return analysis.top_keywords(table(spark, d, "documents"), "doc_id", "text")


@query()
def mock_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Tested against a brute-force version; SQL would need the same sums in another order."""
    return table(spark, d, "timeline_entries").where("title is not null").select("entry_seq", analysis.unit_vector(F.col("title")).alias("vector"))


@query()
def artifact_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """The cascade that repairs descriptions; the SQL engine's patterns differ in look-ahead of lazy groups, so tested on fixtures."""
    rows = _raw_events(spark, d)
    body, title = F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))
    clean = text.without_boilerplate(text.sanitised(body, title, 1000))
    return rows.select("event_seq", clean.alias("description"), text.is_low_quality(clean, title).alias("low_quality"), text.has_prompt_marks(body).alias("marked"))


@query("select doc_id, len(string_split(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))[1], chr(10))) as lines from documents where text is not null and text <> ''")
def first_paragraph_lines(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", F.size(F.split(F.split(plain, "\n\n")[0], "\n")).cast("bigint").alias("lines"))


@query("select event_seq, nullif(regexp_extract(metadata, '(?s)\\{.*\\}'), '') as payload from (select distinct event_seq, metadata from raw_events) where metadata is not null")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    return _raw_events(spark, d).where("metadata is not null").select("event_seq", text.json_payload(F.col("metadata")).alias("payload"))


_OLD, _NEW = f"(select * from {_ENTRIES} where batch_no = 0 and title is not null)", f"(select * from {_ENTRIES} where batch_no > 0 and title is not null)"


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _entries(spark, d).where("title is not null")
    return rows.where("batch_no = 0"), rows.where("batch_no > 0")


@query(f"""select entry_seq, id from (select entry_seq, id, row_number() over (partition by {_KEY} order by entry_seq) as n from {_NEW} x where (id is null or id not in (select id from {_OLD} where id is not null)) and {_KEY} not in (select {_KEY} from {_OLD})) where n = 1""")
def new_event_antijoin(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return timeline.new_entries(new, old).select("entry_seq", "id")


@query(f"""with n as (select entry_seq, id, day, {_KEY} as k from {_NEW}), o as (select id, {_KEY} as k from {_OLD}) select entry_seq, 'id' as kind from n where id in (select id from o where id is not null)
union all select entry_seq, 'key' from n where k in (select k from o) union all select entry_seq, 'repeated' from (select entry_seq, min(entry_seq) over (partition by k) as first from n) where entry_seq > first
union all select entry_seq, 'future' from n where day > date '2025-11-25'""")
def validate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return timeline.conflicts(new, old, "2025-11-25")


@query(f"""with n as (select *, list_distinct(regexp_split_to_array(lower(title), '[ \\t\\n\\r\\f]+')) as w from {_NEW}), o as (select *, list_distinct(regexp_split_to_array(lower(title), '[ \\t\\n\\r\\f]+')) as w from {_OLD})
select n.entry_seq, min(o.entry_seq) as similar_seq from n join o on n.day = o.day and n.category = o.category where len(list_intersect(n.w, o.w))::double / (len(n.w) + len(o.w) - len(list_intersect(n.w, o.w))) > 0.8::double group by n.entry_seq""")
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return timeline.similar_existing(new, old)


@query(f"""select coalesce(category, '(none)') as category, count(*) as total, {_half_up('avg(impact_score)')} as average, cast(min(day) as varchar) as earliest, cast(max(day) as varchar) as latest from {_ENTRIES} group by coalesce(category, '(none)')
union all select '(all)', count(*), {_half_up('avg(impact_score)')}, cast(min(day) as varchar), cast(max(day) as varchar) from {_ENTRIES}""")
def timeline_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.timeline_stats(_entries(spark, d))


@query(f"select coalesce(category, '(none)') as category, case when max(impact_score) >= 9 then 'impact:critical' when max(impact_score) >= 7 then 'impact:high' else 'impact:moderate' end as label from {_ENTRIES} group by all")
def impact_labels(spark: SparkSession, d: str) -> DataFrame:
    return stats.impact_labels(_entries(spark, d))


@query("""select event_type, count(*) as calls, count(*) filter (value is null or value < 0) as failures, round(sum(value) filter (value >= 0), 4) as total, round(avg(value) filter (value >= 0), 4) as average, min(value) filter (value >= 0) as least, max(value) filter (value >= 0) as most
from events group by event_type""")
def api_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.call_metrics(table(spark, d, "events"), "event_type", "value")


@query(f"""select count(*) as analysed, count(*) filter (computed >= 6 and not isnan(computed)) as selected, coalesce({_half_up('avg(computed) filter (computed > 0 and not isnan(computed))', 100)}, 0::double) as average,
coalesce(max(computed) filter (computed > 0 and not isnan(computed)), 0::double) as highest, coalesce(min(computed) filter (computed > 0 and not isnan(computed)), 0::double) as lowest from {_ANALYSED}""")
def selection_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.selection_metrics(_analysed(spark, d), "computed", 6.0)


@query("select event_type, count(*) as n, arg_max(user_id, epoch_us(ts)::hugeint * 100000000 + event_id) as last from events group by event_type")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.last_by_key(table(spark, d, "events"), "event_type", "ts", "event_id", "user_id")


@query("select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 60000000 preceding and current row) as in_window from events")
def failure_window(spark: SparkSession, d: str) -> DataFrame:
    return stats.sliding_failures(table(spark, d, "events"), "event_type", "ts", 60).select("event_id", "in_window")


@query("""select doc_id, tokens, running from (select doc_id, tokens, sum(tokens) over (partition by source order by doc_id)::bigint as running from (select doc_id, source, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as tokens from documents)) where running <= 12000""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return analysis.within_budget(table(spark, d, "documents"), "source", "doc_id", "text", 12_000).select("doc_id", "tokens", "running")


@query("select o_orderkey, cast(ceil((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate))) / 7.0) as bigint) as week from orders")
def week_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", timeline.week_of_year(F.to_date("o_orderdate")).alias("week"))


@query(f"select entry_seq, year(day) as year, monthname(day) as month, title, description, category, coalesce(sources[1], '') as link from {_ENTRIES}")
def timeline_rows(spark: SparkSession, d: str) -> DataFrame:
    return timeline.file_rows(_entries(spark, d)).withColumn("year", F.col("year").cast("bigint"))


@query(f"""select entry_seq, strftime(make_date(year(day), month(day), 1), '%Y-%m-%d') || '-' || substring({_SLUG.replace('title', 'trim(title)')}, 1, 50) as id, {_map_sql('category', text.TIMELINE_CATEGORIES)} as category
from {_ENTRIES} where length(trim(title)) between 1 and 200 and length(trim(coalesce(description, trim(title)))) between 1 and 1000 and coalesce(regexp_matches(trim(sources[1]), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+'), false)""")
def timeline_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.file_rows(_entries(spark, d))
    key = rows.select("entry_seq", "year", "month", "title", "description", "category", "link")
    day, title = timeline.month_day(F.col("year"), F.col("month")), F.trim("title")
    fine = F.length(title).between(1, 200) & F.length(F.trim(F.coalesce("description", title))).between(1, 1000) & urls.is_valid(F.trim("link"))
    return key.where(fine).select("entry_seq", text.event_id(day, title).alias("id"), text.mapped_category(F.col("category"), text.TIMELINE_CATEGORIES).alias("category"))


@query(f"select entry_seq, event_date from {_ENTRIES} order by day desc, entry_seq limit 10")
def recent_n(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest(_entries(spark, d), "day", "entry_seq", 10).select("entry_seq", "event_date")


@query(f"select entry_seq from {_ENTRIES} where day between date '2025-10-10' and date '2025-10-20' and category = 'Public Releases'")
def events_in_range(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("day between date '2025-10-10' and date '2025-10-20' and category = 'Public Releases'").select("entry_seq")


@query("""select day, event_type, n from (select date_trunc('day', ts) as day, event_type, count(*) as n from events where ts is not null group by all)
where day + interval 1 day <= (select date_trunc('milliseconds', max(ts)) from events) - interval 2 day""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days that are over: those that end two days or more before the newest event; later ones wait in the state."""
    events = windows.parquet_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windows.windowed_counts(events, "ts", "event_type")
    return windows.run_once(counts).select(F.col("window_start").alias("day"), "event_type", "n")


@query("select event_seq, max(title) as title from raw_events where ingested_at is not null group by event_seq")
def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """A first read takes all files as one batch, so no row is late in it; state is dropped 48 hours after the newest."""
    rows = windows.parquet_stream(spark, d, "raw_events").where("ingested_at is not null").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return windows.run_once(windows.first_deliveries(rows, "ingested_at", ["event_seq"]).select("event_seq", "title"))


_SCORES = " and ".join(f"(significance.{name} between 0 and 10 and not isnan(significance.{name}))" for name in analysis.WEIGHTS)
_URL = "'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+'"


@query(f"""select violation, count(*) as n from (select unnest([case when not coalesce(regexp_matches(id, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-[a-z0-9-]+$'), false) then 'id' end,
case when not coalesce(length(title) between 1 and 200, false) then 'title' end, case when not coalesce(regexp_matches(event_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?Z$'), false) then 'date' end,
case when not coalesce(length(description) between 1 and 1000, false) then 'description' end, case when not coalesce(category in ('research', 'product', 'regulation', 'industry'), false) then 'category' end,
case when sources is null or len(list_filter(sources, lambda u: not coalesce(regexp_matches(u, {_URL}), false))) > 0 then 'sources' end, case when not coalesce(url is null or regexp_matches(url, {_URL}), false) then 'url' end,
case when not coalesce(impact_score between 0 and 10 and not isnan(impact_score), false) then 'impact_score' end, case when not coalesce({_SCORES}, false) then 'significance' end]) as violation from {_ANALYSED}) where violation is not null group by violation""")
def validate_analyzed(spark: SparkSession, d: str) -> DataFrame:
    return _analysed(spark, d).select(F.explode(analysis.violations()).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("""select doc_id, list_aggregate(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')[1:2], lambda x: substring(x, 1, 160)), 'string_agg', '|') as sentences
from documents where text is not null""")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", analysis.first_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.when(F.size("s") > 0, F.array_join("s", "|")).alias("sentences"))


@query("select source, count(*) as collected, count(distinct id) as different, count(*) filter (url is null or url = '') as without_url from raw_items group by source")
def source_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_metrics(table(spark, d, "raw_items"), "source", "id")


@query(f"""select 'collected' as stage, count(*) as n from raw_items union all select 'different', count(distinct id) from raw_items
union all select 'analysed', count(*) from {_ANALYSED} union all select 'selected', count(*) filter (computed >= 6 and not isnan(computed)) from {_ANALYSED}""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    items, scores = table(spark, d, "raw_items"), _analysed(spark, d)
    chosen = F.count_if((F.col("computed") >= 6) & ~F.isnan("computed"))
    return stats.stage_counts(items.agg(F.count("*").alias("collected"), F.count_distinct("id").alias("different")), scores.agg(F.count("*").alias("analysed"), chosen.alias("selected")))
