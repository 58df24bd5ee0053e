"""Queries of the general data problems (1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import drift, packed, timestamps
from tidewell.shared import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.layout_changes(table(spark, d, "pwc_raw"))


def p1_papers(spark: SparkSession, d: str) -> DataFrame:
    """All records in one layout; of the fields that no alias names, their names."""
    rows = drift.unified_records(table(spark, d, "pwc_raw"))
    return rows.withColumn("other", F.array_join(F.array_sort(F.map_keys("other")), "|"))


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.generated_casts(table(spark, d, "pwc_raw"))


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """Each unbroken run of files that have a field: first and last file, and how many."""
    runs = drift.lifespans(table(spark, d, "pwc_raw"))
    return runs.groupBy("feed", "key", "island").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count("*").alias("files")).drop("island")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.timestamp_values(table(spark, d, "raw_items"), table(spark, d, "rss_items"), table(spark, d, "pwc_raw"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_instants(_values(spark, d), table(spark, d, "sources"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where(F.col("utc_us").isNotNull() & ~F.col("value").rlike(timestamps.CANONICAL)).select("rec_table", "rec_id", "field_name", "utc_us")


def p3_notations(spark: SparkSession, d: str) -> DataFrame:
    """How many values each table and field has in each notation, read or not."""
    return _instants(spark, d).where("value is not null").groupBy("rec_table", "field_name", F.coalesce("notation", F.lit("none")).alias("notation"), "status").agg(F.count("*").alias("n"))


def p3_orders(spark: SparkSession, d: str) -> DataFrame:
    """What the fitted mixtures decide about dates of either order, with all declared orders hidden, against these."""
    return timestamps.hidden_orders(_values(spark, d), table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    fields = packed.author_fields(table(spark, d, "pwc_raw"), table(spark, d, "jsonld_nodes"))
    return packed.split_packed(fields, ["rec_table", "rec_id"], "packed")


def _papers_sql() -> str:
    """One layout by the same alias table: the first spelling that is not null, then the cast."""
    cast = {"boolean": "case when lower({0}) in ('true', 'yes', '1') then true when lower({0}) in ('false', 'no', '0') then false end", "bigint": "try_cast(regexp_replace({0}, '[,_ ]', '', 'g') as bigint)"}
    columns = []
    for canonical, names in drift.ALIASES.items():
        text = "coalesce(" + ", ".join(f"""json_extract_string(doc, '$."{name}"')""" for name in names) + ")"
        columns.append(f"{cast.get(drift.CASTS.get(canonical, ''), '{0}').format(text)} as {canonical}")
    known = ", ".join(f"'{name}'" for names in drift.ALIASES.values() for name in names)
    return f"""select record_no, feed, file_no, {', '.join(columns)}, array_to_string(list_sort(list_filter(json_keys(doc), lambda k: k not in ({known}))), '|') as other
from (select *, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as doc from pwc_raw)"""


QUERIES = {f.__name__: f for f in (p1_found, p1_papers, p1_casts, p1_lifespans, p3_found, p3_notations, p3_orders, p5_found)}
SQL: dict[str, str] = {
    "p1_papers": _papers_sql(),
    "p1_casts": f"""with seen as (select feed, file_no, unnest(json_keys(payload)) as key, payload from pwc_raw where json_valid(payload) and json_type(payload) = 'OBJECT'),
typed as (select feed, file_no, key, case json_type(payload, '$."' || key || '"') when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as t from seen)
select feed, key, coalesce(string_agg(distinct t, '|' order by t), '') as types, min(file_no) as first_file, max(file_no) as last_file, max(canonical) as canonical, max("cast") as "cast" from typed
left join (values {', '.join(f"('{name}', '{canonical}', '{drift.CASTS.get(canonical, 'string')}')" for canonical, names in drift.ALIASES.items() for name in names)}) as a(key, canonical, "cast") using (key) group by feed, key""",
    "p1_lifespans": """with docs as (select feed, file_no, payload from pwc_raw where json_valid(payload) and json_type(payload) = 'OBJECT'),
files as (select feed, file_no, row_number() over (partition by feed order by file_no) as file_at from (select distinct feed, file_no from pwc_raw)),
seen as (select distinct feed, file_no, unnest(json_keys(payload)) as key from docs),
runs as (select feed, file_no, key, file_at - row_number() over (partition by feed, key order by file_at) as island from seen join files using (feed, file_no))
select feed, key, min(file_no) as first_file, max(file_no) as last_file, count(*) as files from runs group by feed, key, island""",
    "p1_found": """with files as (select feed, file_no, row_number() over (partition by feed order by file_no) as place from (select distinct feed, file_no from pwc_raw)),
docs as (select feed, file_no, place, payload, json_extract_string(payload, '$.id') as paper from pwc_raw join files using (feed, file_no) where json_valid(payload) and json_type(payload) = 'OBJECT'),
kv as (select feed, file_no, place, paper, key, cast(json_extract(payload, '$."' || key || '"') as varchar) as v, json_type(payload, '$."' || key || '"') as t from (select *, unnest(json_keys(payload)) as key from docs)),
seen as (select feed, file_no, place, key, coalesce(string_agg(distinct case t when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end, '|' order by
case t when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end), '') as types from kv group by feed, file_no, place, key),
runs as (select *, place - row_number() over (partition by feed, key order by place) as island, lag(place) over (partition by feed, key order by place) as before, lead(place) over (partition by feed, key order by place) as after from seen),
back as (select *, row_number() over (partition by feed, key, island order by place) as nth, last_value(nullif(types, '') ignore nulls) over (partition by feed, key, island order by place rows between unbounded preceding and 1 preceding) as earlier from runs),
gone as (select feed, place + 1 as place, key as a from runs where (after is null or after > place + 1) and place < (select max(f.place) from files f where f.feed = runs.feed)),
born as (select feed, place, key as b from runs where place > 1 and (before is null or before < place - 1)),
ren as (select g.feed, g.place, a, b from gone g join born n on g.feed = n.feed and g.place = n.place join kv x on x.feed = g.feed and x.place = g.place - 1 and x.key = a and x.t <> 'NULL'
join kv y on y.feed = g.feed and y.place = g.place and y.key = b and y.t <> 'NULL' and y.paper = x.paper group by all having bool_and(x.v = y.v)),
found as (select feed, place, 'renamed' as change_kind, a as field_name, b as new_name from ren
union all select feed, place, 'removed', a, '' from gone where not exists (select 1 from ren where ren.feed = gone.feed and ren.place = gone.place and ren.a = gone.a)
union all select feed, place, 'added', b, '' from born where not exists (select 1 from ren where ren.feed = born.feed and ren.place = born.place and ren.b = born.b)
union all select feed, place, 'retyped', key, types from back where nth > 1 and types <> '' and earlier <> types)
select feed, file_no, change_kind, field_name, new_name from found join files using (feed, place)""",
}
