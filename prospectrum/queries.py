"""Each operator bound to the driver's tables, with the SQL that gives the same rows.

Lead-shaped rows are derived from customers (and their orders and nations) by expressions that both engines read;
the operators themselves are then written twice, here as DataFrames and in ORACLES as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.functions import rules, text
from prospectrum.functions.rules import ICP_WORDS, PREMIUM, PREMIUM_WORDS, REGIONS, SOURCE_POINTS, TAXONOMY, Vocabulary
from prospectrum.job_queries import job_queries
from prospectrum.more_queries import more_queries, scratch
from prospectrum.operators import leads, service
from prospectrum.operators.service import LeadsQuery
from prospectrum.plans import pipeline
from prospectrum.runtime import table
from prospectrum.source_queries import SOURCE_QUERIES
from prospectrum.sources import captured
from prospectrum.state_queries import state_queries

SOURCES = [*SOURCE_POINTS][:12]
RAW = {
    "company_name": "c_name || case c_custkey % 4 when 0 then ' Ltd.' when 1 then ', LLC' when 2 then ' Corporation' else ' &amp; Co' end",
    "category": "case c_custkey % 6 when 0 then case when c_custkey % 12 = 0 then 'Machine learning lab' else 'Software Technology' end when 1 then 'Dental Clinic' when 2 then 'estate agents' when 3 then 'Cloud Data Consulting' when 4 then c_mktsegment else 'Web and SEO agency' end",
    "website": "case when c_custkey % 9 = 0 then '' else 'https://www.Site' || cast(c_custkey % 700 as string) || '.com/about?x=1' end",
    "email": "case when c_custkey % 3 = 0 then '' else 'info' || cast(c_custkey as string) || '@site' || cast(c_custkey % 700 as string) || '.com' end",
    "all_emails": "case when c_custkey % 10 = 0 then 'a@x.com; b@x.com' else '' end",
    "email_verified": "case when c_custkey % 3 = 0 then '' when c_custkey % 5 = 0 then 'dead' when c_custkey % 5 = 1 then 'alive' else 'unknown' end",
    "phone": "case when c_custkey % 4 = 0 then '' else '+1 555 ' || cast(c_custkey as string) end",
    "linkedin": "case when c_custkey % 6 = 0 then 'https://linkedin.com/company/c' || cast(c_custkey as string) else '' end",
    "facebook": "case when c_custkey % 11 = 0 then 'https://facebook.com/c' || cast(c_custkey as string) else '' end",
    "rating": "cast(cast(floor(abs(c_acctbal) / 2000) as bigint) as string) || '.' || cast(cast(floor(abs(c_acctbal) / 200) as bigint) % 10 as string) || ' stars'",
    "review_count": "cast(n_orders * 3 as string) || ',000'",
    "company_size": "cast(c_custkey % 1300 as string) || ' - ' || cast(c_custkey % 1300 + c_custkey % 51 as string)",
    "hourly_rate": "case when c_custkey % 7 = 0 then '' else '$' || cast(c_custkey % 90 as string) || ' - $99 / hr' end",
    "min_project": "case when c_custkey % 8 = 0 then '$1,000+' else '' end",
    "address": "case n_nationkey % 5 when 0 then 'Toronto, Canada' when 1 then 'Dubai' when 2 then 'Karachi' when 3 then 'Berlin, Germany' else n_name end",
    "search_query": "'firms in ' || lower(n_name)",
    "source": "case c_custkey % 13 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SOURCES)) + " else 'elsewhere' end",
}
FROM = "customer join nation on c_nationkey = n_nationkey left join (select o_custkey, count(*) as n_orders_ from orders group by o_custkey) o on o_custkey = c_custkey"
BASE_SQL = "base as (select *, coalesce(n_orders_, 0) as n_orders from " + FROM + "), raw as (select c_custkey as ord, " + ", ".join(f"{e} as {c}" for c, e in RAW.items()) + " from base)"


def raw_leads(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    return leads.as_leads(c.select(F.col("c_custkey").alias("ord"), *(F.expr(e).alias(k) for k, e in RAW.items())))


def hits_sql(hay: str, vocabulary: Vocabulary, words: bool, least: int = 1) -> str:
    def test(k: str) -> str:
        return f"regexp_matches({hay}, '(^|[^a-z0-9]){k}s?([^a-z0-9]|$)')::int" if words else f"contains({hay}, '{k}')::int"

    rows = ", ".join("{'less': -(" + " + ".join(test(k) for k in kw) + f"), 'ord': {i}, 'slug': '{slug}'" + "}" for i, (slug, kw) in enumerate(vocabulary.buckets))
    return f"list_sort(list_filter([{rows}], lambda r: r.less <= -{least}))"


def or_sql(hay: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({hay}, '{w}')" for w in words) + ")"


KEY_SQL = r"nullif(split_part(split_part(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\.', ''), '/', 1), '?', 1), '')"
NAME_SQL = r"nullif(trim(regexp_replace(regexp_replace(replace(replace(lower(trim(company_name)), '.', ''), ',', ''), '\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|pvt|private|fze|llp|plc|gmbh|sa|srl|pty)\b', '', 'g'), '\s+', ' ', 'g')), '')"
SCORE_SQL = f"""least(100,
 case when email = '' then 0 when email_verified = 'alive' then 22 when email_verified = 'dead' then 0 else 12 end
 + (phone <> '')::int * 8 + (linkedin <> '')::int * 7 + (website <> '')::int * 3 + contains(all_emails, ';')::int * 2
 + case when rt >= 4.7 then 15 when rt >= 4.5 then 12 when rt >= 4 then 8 when rt >= 3.5 then 4 when rt > 0 then 1 else 0 end
 + case when rv >= 200 then 15 when rv >= 100 then 12 when rv >= 50 then 8 when rv >= 20 then 5 when rv >= 5 then 2 else 0 end
 + (company_size <> '')::int * 3 + (hourly_rate <> '')::int * 2
 + case source {" ".join(f"when '{s}' then {n}" for s, n in SOURCE_POINTS.items())} else 5 end
 + (address <> '')::int * 2 + (min_project <> '')::int * 2 + (facebook <> '')::int
 + (list_has_any(tags, [{", ".join(f"'{p}'" for p in PREMIUM)}]))::int * 5 + (employee_count >= 1000)::int * 3)::int"""
TIER_SQL = "case when score >= 75 then 'A' when score >= 55 then 'B' when score >= 35 then 'C' else 'D' end"
HAY_SQL = r"lower(concat_ws(' ', nullif(category, ''), nullif(company_name, ''), nullif(search_query, ''), nullif(regexp_replace(regexp_replace(regexp_replace(website, '^https?://', '', 'i'), '^www\.', '', 'i'), '[.\-/]', ' ', 'g'), '')))"
REGION_SQL = hits_sql("lower(concat_ws(' ', address, search_query))", REGIONS, False) + "[1].slug"
COUNT_SQL = "case when len(digits) = 0 then null when len(digits) = 1 then digits[1]::bigint else floor((digits[1]::bigint + digits[2]::bigint) / 2.0 + 0.5) end::int"
BAND_SQL = "case when employee_count is null then null when employee_count <= 1 then 'solo' when employee_count <= 10 then 'small' when employee_count <= 249 then 'mid' when employee_count <= 999 then 'large' else 'enterprise' end"


def scored_sql(of: str) -> str:
    """CTEs that classify and score the rows of a table with the raw columns, to scored."""
    return (
        f"h as (select *, {HAY_SQL} as hay, regexp_extract_all(replace(company_size, ',', ''), '\\d+') as digits, {REGION_SQL} as region, coalesce(try_cast(regexp_extract(rating, '^\\d+\\.?\\d*') as double), 0) as rt, coalesce(try_cast(regexp_extract(review_count, '^\\d+') as bigint), 0) as rv from {of}), "
        f"t as (select *, {hits_sql('hay', TAXONOMY, True)} as hits, {COUNT_SQL} as employee_count from h), "
        f"u as (select *, list_transform(hits, lambda r: r.slug) as tags, hits[1].slug as industry, {BAND_SQL} as firm_size_band from t), v as (select *, {SCORE_SQL} as score from u), "
        f"scored as (select *, {TIER_SQL} as tier, ord as id, timestamp '2026-01-01' + to_days((ord % 40)::int) as scraped_at from v)"
    )


SCORED_SQL = f"with {BASE_SQL}, {scored_sql('raw')} "


def scored(spark: SparkSession, sf: str) -> DataFrame:
    df = leads.scored(leads.regions(leads.firmographics(leads.classify(raw_leads(spark, sf)))))
    return df.withColumn("id", F.col("ord")).withColumn("scraped_at", F.expr("timestamp '2026-01-01' + make_dt_interval(cast(ord % 40 as int))"))


SMALL = "ord as id, company_name, score, tier, industry, source"
SMALL_COLUMNS = ["id", "company_name", "score", "tier", "industry", "source"]
SEARCH = LeadsQuery(tier="C", min_score=36, has_email=True, search=" AGENCY")
SAVED = LeadsQuery(min_score=0, max_score=60, search="germany", tag="healthcare")
PAGES_OF = {"query_page_desc": LeadsQuery(page=2, page_size=25), "query_page_asc": LeadsQuery(sort_col="scraped_at", sort_dir="asc", page=3, page_size=500), "query_search": SEARCH, **{f"preset_{k}": q for k, q in service.PRESETS.items()}}


def where_sql(q: LeadsQuery) -> str:
    out = ["true"]
    out += [f"{c} = '{v}'" for c in ("tier", "source", "industry", "region", "firm_size_band") if (v := getattr(q, c))]
    out += [f"list_contains(tags, '{q.tag}')"] * bool(q.tag) + ["email <> ''"] * q.has_email
    out += [f"score >= {q.min_score}"] * (q.min_score is not None) + [f"score <= {q.max_score}"] * (q.max_score is not None)
    if q.search:
        s = q.search.strip().lower()
        out.append("(" + " or ".join(f"{c} ilike '%{s}%'" for c in ("company_name", "email", "address", "category")) + ")")
    return " and ".join(out)


def page_sql(q: LeadsQuery) -> str:
    size = min(200, q.page_size)
    return SCORED_SQL + f"select {SMALL} from scored where {where_sql(q)} order by {q.sort_col} {q.sort_dir} nulls last, id limit {size} offset {(q.page - 1) * size}"


NOW, CUT = "timestamp '2026-02-01 00:00:00'", 3
STORED_SQL = "stored as (select 'k' || cast(ord as string) as dedupe_key, id, score, tier, source, case when ord % 7 = 0 then 'contacted' else 'new' end as status, timestamp '2026-01-01' as updated_at from scored where ord % 3 <> 0)"
BATCH_SQL = "batch as (select 'k' || cast(ord as string) as dedupe_key, score + 1 as score, tier, 'resync' as source from scored where ord % 3 <> 1)"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("ord % 3 <> 0").select(F.expr("'k' || cast(ord as string)").alias("dedupe_key"), "id", "score", "tier", "source", F.expr("case when ord % 7 = 0 then 'contacted' else 'new' end").alias("status"), F.expr("timestamp '2026-01-01'").alias("updated_at"))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    batch = scored(spark, sf).where("ord % 3 <> 1").select(F.expr("'k' || cast(ord as string)").alias("dedupe_key"), (F.col("score") + 1).alias("score"), "tier", F.lit("resync").alias("source"))
    out = leads.upsert(stored(spark, sf), batch, F.expr(NOW))
    return out.select("dedupe_key", "score", "tier", "source", "status", "updated_at")


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the event stream as keys: events before a cut are the master, later ones the batch."""
    ev = table(spark, sf, "events")
    side = lambda test: ev.where(test).groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dedupe_key")).agg(F.max("ts").alias("scraped_at"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.min_by("event_type", "event_id").alias("category"), F.when(F.min("event_id") % 2 == 0, F.lit("")).otherwise(F.min("event_type")).alias("company_name"))
    return leads.merge_master(side("event_id % 5 < 3"), side("event_id % 5 >= 3"), F.expr(NOW))


def _side_sql(test: str) -> str:
    return f"(select 'u' || cast(user_id as string) as dedupe_key, max(ts) as scraped_at, min(ts) as first_seen_at, max(ts) as last_seen_at, arg_min(event_type, event_id) as category, case when min(event_id) % 2 = 0 then '' else min(event_type) end as company_name from events where {test} group by 1)"


MASTER_SQL = f"""select coalesce(m.dedupe_key, b.dedupe_key) as dedupe_key, coalesce(nullif(m.category, ''), b.category) as category,
 coalesce(nullif(m.company_name, ''), nullif(b.company_name, ''), m.company_name, b.company_name) as company_name,
 coalesce(m.first_seen_at, b.first_seen_at) as first_seen_at, case when b.dedupe_key is not null then {NOW} else m.last_seen_at end as last_seen_at,
 case when b.dedupe_key is not null then {NOW} else m.scraped_at end as scraped_at from {_side_sql("event_id % 5 < 3")} m full join {_side_sql("event_id % 5 >= 3")} b on m.dedupe_key = b.dedupe_key"""

RUNS = "event_id as id, user_id % 20 as saved_search_id, ts as created_at, case event_id % 3 when 0 then 'pending' when 1 then 'done' else 'failed' end as status"


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").selectExpr("event_id as id", "user_id % 20 as saved_search_id", "ts as created_at", "case event_id % 3 when 0 then 'pending' when 1 then 'done' else 'failed' end as status")
    return ev.withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string"), "leads_found": F.lit(None).cast("long")})


def searches(spark: SparkSession) -> DataFrame:
    """Fifteen searches over three signatures; five ids have none."""
    return spark.range(15).select("id", F.element_at(F.array(F.lit("ai-ml"), F.lit("healthcare"), F.lit("real-estate")), (F.col("id") % 3 + 1).cast("int")).alias("industry"), F.lit("europe").alias("region"), F.lit("quick").alias("depth"), F.when(F.col("id") % 2 == 0, "daily").otherwise("weekly").alias("schedule"), (F.col("id") % 5 != 0).alias("is_active"), F.when(F.col("id") % 4 > 0, F.expr("timestamp '2026-02-01' - make_dt_interval(cast(id as int))")).alias("last_run_at"))


SEARCH_SQL = "searches as (select range as id, ['ai-ml', 'healthcare', 'real-estate'][(range % 3 + 1)::int] as industry, case when range % 2 = 0 then 'daily' else 'weekly' end as schedule, range % 5 <> 0 as is_active, case when range % 4 > 0 then timestamp '2026-02-01' - to_days(range::int) end as last_run_at from range(15))"
CLAIM_SQL = f"""with runs as (select {RUNS} from events), {SEARCH_SQL},
 picked as (select * from runs where status = 'pending' order by created_at, id limit 10),
 held as (select p.*, s.industry from picked p left join searches s on s.id = p.saved_search_id)
 select r.id, case when h.id is null then r.status when h.industry is null then 'failed' else 'running' end as status,
 case when h.id is not null and h.industry is not null then {NOW} end as started_at from runs r left join held h on h.id = r.id"""


def claimed(spark: SparkSession, sf: str) -> DataFrame:
    return service.claim(run_rows(spark, sf), searches(spark), F.expr(NOW)).select("id", "status", "started_at")


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    done = stored(spark, sf).where("id % 4 = 0").select(F.lit("u1").alias("user_id"), F.col("id").alias("lead_id"))
    fresh = scored(spark, sf).withColumn("dedupe_key", F.expr("'k' || cast(ord as string)"))
    return service.new_deliveries(done, service.attributed(fresh, stored(spark, sf), SAVED, "u1", 4, 9)).select("user_id", "lead_id", "saved_search_id", "delivery_reason")


DELIVERY_SQL = SCORED_SQL + f", {STORED_SQL} select 'u1' as user_id, s.id as lead_id, 4::bigint as saved_search_id, 'fresh' as delivery_reason from scored x join stored s on s.dedupe_key = 'k' || cast(x.ord as string) where x.score between 0 and 60 and list_contains(x.tags, 'healthcare') and contains(lower(concat_ws(' ', nullif(company_name, ''), nullif(email, ''), nullif(address, ''), nullif(category, ''), nullif(search_query, ''))), 'germany') and s.id % 4 <> 0"

PROSE = Vocabulary.of({"english": "the|of|and|thing", "german": "der|die|und", "french": "le|les|que", "spanish": "el|los|de"})
ANSWER = "case event_id % 5 when 0 then 'not json' when 1 then '```json\n{\"primary_industry\": \"ai-ml\", \"secondary_services\": [\"healthcare\", \"odd\"], \"confidence\": 1.7}\n```' when 2 then '{\"primary_industry\": \"odd\", \"confidence\": 0.5}' when 3 then 'Sure: {\"primary_industry\": \"healthcare\", \"confidence\": -1} done' else '{\"confidence\": 0.5}' end"
ELEMENT = "'{\"elements\": [{\"type\": \"node\", \"id\": ' || cast(s_suppkey as string) || ', \"tags\": {\"name\": \"' || s_name || '\", \"office\": \"it\", \"contact:phone\": \"' || cast(s_nationkey as string) || '\", \"addr:city\": \"Town\", \"addr:street\": \"Road ' || cast(s_suppkey % 5 as string) || '\"}}, {\"type\": \"way\", \"id\": 1, \"tags\": {\"amenity\": \"cafe\"}}]}'"
LD_HTML = "'<html><script type=\"application/ld+json\">{\"name\": \"' || s_name || '\", \"telephone\": \"' || cast(s_nationkey as string) || '\", \"url\": \"https://' || case when s_suppkey % 2 = 0 then 'dir.example' else 'firm.example' end || '/x\", \"address\": {\"streetAddress\": \"1 Road\", \"addressRegion\": \"R\"}}</script></html>'"
CONTACT_HTML = "'<a href=\"mailto:Info' || cast(c_custkey as string) || '@firm' || cast(c_custkey % 50 as string) || '.com\">x</a> ' || case when c_custkey % 3 = 0 then '<a href=\"https://www.linkedin.com/company/f' || cast(c_custkey as string) || '\">l</a>' else '' end || ' also sales@firm' || cast(c_custkey % 50 as string) || '.com logo@2x.png'"
CONTACT_SQL = f"""with p as (select 'firm' || cast(c_custkey % 50 as string) || '.com' as host, c_custkey as o, c_custkey % 3 = 0 as li from customer),
 stop as (select host, coalesce(min(o) filter (where li), 1000000000) as last from p group by host),
 used as (select p.* from p join stop using (host) where p.o <= stop.last),
 e as (select host, o * 2 as place, 'info' || cast(o as string) || '@' || host as mail from used union all select host, min(o) * 2 + 1, 'sales@' || host from used group by host),
 r as (select host, mail, row_number() over (partition by host order by place) as n from e)
 select r.host, string_agg(mail, ';' order by n) as emails, max(case when last < 1000000000 then 'https://www.linkedin.com/company/f' || cast(last as string) end) as linkedin from r join stop using (host) where n <= 3 group by r.host"""


def contact_rows(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "customer").select(F.expr("'firm' || cast(c_custkey % 50 as string) || '.com'").alias("host"), F.col("c_custkey").alias("path_ord"), F.expr(CONTACT_HTML).alias("html"))
    return captured.contacts(pages).select("host", F.array_join("emails", ";").alias("emails"), "linkedin")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return leads.merge_duplicates(raw_leads(spark, sf)).select("dedupe_key", "ord", "company_name", "category", "email", "phone", "linkedin", "source")


MERGED_SQL = f"keyed as (select *, coalesce({KEY_SQL}, {NAME_SQL}) as dedupe_key from raw), merged as (select dedupe_key, min(k.ord) as ord, " + ", ".join(f"coalesce(arg_min({c}, k.ord) filter (where {c} <> ''), arg_min({c}, k.ord)) as {c}" for c in RAW) + " from keyed k where dedupe_key is not null group by dedupe_key)"
CLEAN_RAW_SQL = BASE_SQL.replace(f"{RAW['company_name']} as company_name", f"replace({RAW['company_name']}, '&amp;', '&') as company_name")
ICP_SQL = or_sql("lower(concat_ws(' ', category, company_name))", ICP_WORDS)
CONTACT_TEST = "(phone <> '' or linkedin <> '' or (email <> '' and email_verified <> 'dead'))"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.run(raw_leads(spark, sf)).select("dedupe_key", "company_name", "industry", F.array_join("tags", ";").alias("tags"), F.round("tag_confidence", 6).alias("tag_confidence"), "employee_count", "firm_size_band", "region", "score", "tier")


CONF_SQL = "(case when len(hits) = 0 then 0.0 else least(0.95, 0.5 + 0.1 * -hits[1].less + 0.1 * (-hits[1].less - coalesce(-hits[2].less, 0))) end)::double"
PICK = "dedupe_key, company_name, industry, array_to_string(tags, ';') as tags, round(" + CONF_SQL + ", 6) as tag_confidence, employee_count, firm_size_band, region, score, tier"


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("t"))
    return t.select("page_id", text.clean_text(F.concat(F.col("t"), F.lit("  <br> A&nbsp;&#66;&#x43;+ "))).alias("title"))


TITLE_SQL = r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || '  <br> A&nbsp;&#66;&#x43;+ ', '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&#66;', 'B'), '&#x43;', 'C'), '&quot;', '\"'), '\s+', ' ', 'g')) as title from pages".replace('\\"', '"')


def _emails(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,})"), F.lit(1))))
    d = table(spark, sf, "documents").select("doc_id", found.alias("e")).where(F.size("e") > 0)
    return d.select("doc_id", F.size("e").cast("long").alias("n"), text.clean_emails(F.array_join("e", " , ")).alias("emails"))


EMAIL_SQL = r"select doc_id, len(e)::bigint as n, array_to_string(e, '; ') as emails from (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}'))) as e from documents) where len(e) > 0"


def _prose_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return d.select("doc_id", F.array_join(rules.slugs(F.filter(rules.hits(F.col("t"), PROSE, words=True), lambda r: r["less"] <= -2)), ";").alias("tags"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    p = service.parsed_answer(F.expr(ANSWER.replace("\n", "\\n")), [s for s, _ in TAXONOMY.buckets])
    return table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", "p.industry", F.array_join("p.secondary", ";").alias("secondary"), "p.confidence")


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return captured.map_elements(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.expr(ELEMENT).alias("payload"))).select("name", "category", "phone", "address")


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    return captured.linked_data(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.lit("https://dir.example/p").alias("url"), F.expr(LD_HTML).alias("html"))).select("ord", "name", "phone", "website", "address")


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    dom = spark.range(500).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".com")).alias("domain"), F.when(F.col("id") % 2 == 0, "alive").otherwise("dead").alias("status"))
    return service.counts_by(leads.verify_emails(raw_leads(spark, sf), dom), "email_verified", "none")


def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("ts").cast("string")).when(F.col("event_id") % 20 == 0, "odd").alias("last_seen_at"), F.lit(None).cast("string").alias("scraped_at"))
    return leads.not_expired(ev, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


def _reclassified(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    before = s.select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "healthcare").otherwise(F.col("industry")).alias("industry"), F.when(F.col("id") % 9 == 0, "llm").otherwise("rules").alias("tag_source"))
    return service.reclassification(before, s)


def _name_keys(spark: SparkSession, sf: str) -> DataFrame:
    return raw_leads(spark, sf).select("ord", text.name_key(F.col("company_name")).alias("k"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return leads.to_row(raw_leads(spark, sf).withColumn("score", (F.col("ord") % 3).cast("int"))).select("ord", "email", "rating", "review_count", "score")


def _confidences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", rules.name_confidence(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))).alias("confidence"))


def _s(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fn(scored(spark, sf))


def _page(q: LeadsQuery) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: service.query_leads(scored(spark, sf), q)[0].select(*SMALL_COLUMNS)


def _ids(test: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: test(raw_leads(spark, sf)).select("ord")


#: name -> (query, SQL or None)
SCHEDULED = {
    "id": "o_orderkey", "industry": "case o_orderkey % 4 when 0 then 'ai-ml' when 1 then 'healthcare' when 2 then 'real-estate' end", "region": "case when o_custkey % 3 = 0 then '' else 'r' || cast(o_custkey % 5 as string) end", "depth": "case when o_orderkey % 5 = 0 then 'deep' when o_orderkey % 5 = 1 then 'quick' end",
    "schedule": "case when o_orderkey % 2 = 0 then 'daily' else 'weekly' end", "is_active": "o_orderkey % 5 <> 0", "last_run_at": "case when o_orderkey % 7 > 0 then timestamp '2026-02-01 00:00:00' - interval '1' day * cast(o_orderkey % 12 as int) end",
}
SCHEDULED_SQL = "searches as (select " + ", ".join(f"{e} as {n}" for n, e in SCHEDULED.items()) + " from orders)"


def scheduled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*(F.expr(e).alias(n) for n, e in SCHEDULED.items()))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "lead_pipeline": (flagship, f"with {CLEAN_RAW_SQL}, {MERGED_SQL}, kept as (select * from merged where {ICP_SQL} and {CONTACT_TEST}), {scored_sql('kept')} select {PICK} from scored where score >= 22"),
    "site_keys": (lambda s, d: table(s, d, "pages").groupBy(text.site_key(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")), r"select split_part(split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/', 1), '?', 1) as host, count(*) as n from pages group by 1"),
    "name_keys": (_name_keys, f"with {BASE_SQL} select ord, {NAME_SQL} as k from raw"),
    "merge_duplicates": (merged, f"with {BASE_SQL}, {MERGED_SQL} select dedupe_key, ord, company_name, category, email, phone, linkedin, source from merged"),
    "clean_titles": (_titles, TITLE_SQL),
    "clean_emails": (_emails, EMAIL_SQL),
    "clean_phones": (lambda s, d: table(s, d, "customer").select("c_custkey", text.clean_phone(F.expr("case c_custkey % 4 when 0 then 'N/A' when 1 then '+000' when 2 then ' 12  34 ' else 'none' end")).alias("phone")), "select c_custkey, case when c_custkey % 4 = 2 then '12 34' else '' end as phone from customer"),
    "firmographics": (_s(lambda df: df.select("ord", "employee_count", "firm_size_band", "is_enterprise", rules.hourly_floor(F.col("hourly_rate")).alias("hourly"))), SCORED_SQL + "select ord, employee_count, firm_size_band, employee_count >= 1000 as is_enterprise, try_cast(regexp_extract(hourly_rate, '\\d+') as int) as hourly from scored"),
    "classify": (_s(lambda df: df.select("ord", "industry", F.array_join("tags", ";").alias("tags"), F.array_join("sub_industries", ";").alias("sub_industries"), F.round("tag_confidence", 6).alias("tag_confidence"))), SCORED_SQL + f"select ord, industry, array_to_string(tags, ';') as tags, array_to_string(tags[2:], ';') as sub_industries, round({CONF_SQL}, 6) as tag_confidence from scored"),
    "prose_tags": (_prose_tags, f"select doc_id, array_to_string(list_transform({hits_sql('lower(text)', PROSE, True, 2)}, lambda r: r.slug), ';') as tags from documents"),
    "regions": (_s(lambda df: df.select("ord", "region")), SCORED_SQL + "select ord, region from scored"),
    "score_leads": (_s(lambda df: df.select("ord", "score", "tier")), SCORED_SQL + "select ord, score, tier from scored"),
    "tier_counts": (_s(lambda df: service.counts_by(df, "tier", "none")), SCORED_SQL + "select tier, count(*) as n from scored group by 1"),
    "dashboard_totals": (_s(service.totals), SCORED_SQL + "select count(*) as total, floor(avg(score) + 0.5)::bigint as avg_score, max(scraped_at) as latest_run, " + ", ".join(f"count_if({c} <> '') as with_{c}, floor(100 * count_if({c} <> '') / count(*) + 0.5)::bigint as {c}_percent" for c in ("email", "phone", "linkedin")) + " from scored"),
    "source_counts": (_s(lambda df: service.counts_by(df, "source", "unknown")), SCORED_SQL + "select source, count(*) as n from scored group by 1"),
    "industry_counts": (_s(lambda df: service.counts_by(df, "industry", "(unclassified)")), SCORED_SQL + "select coalesce(industry, '(unclassified)') as industry, count(*) as n from scored group by 1"),
    "score_histogram": (_s(service.score_histogram), SCORED_SQL + "select b.range as bucket, count(s.id) as n from range(10) b left join scored s on least(9, floor(s.score / 10)) = b.range group by 1"),
    "source_facet": (_s(service.facet), SCORED_SQL + "select distinct source from scored"),
    "top_scores": (_s(lambda df: service.top_scores(df).select(*SMALL_COLUMNS)), SCORED_SQL + f"select {SMALL} from scored order by score desc, id limit 10"),
    "backfill": (_s(lambda df: service.backfill(df, LeadsQuery(tag="healthcare")).select(*SMALL_COLUMNS)), SCORED_SQL + f"select {SMALL} from scored where list_contains(tags, 'healthcare') order by score desc, id limit 200"),
    "exact_total": (lambda s, d: service.query_leads(scored(s, d), SEARCH)[1], SCORED_SQL + f"select count(*) as total from scored where {where_sql(SEARCH)}"),
    "export_cells": (_s(lambda df: captured.csv_cells(service.export_leads(df, LeadsQuery(tier="C")).select("company_name", "email", "score", "tier", "review_count"))), SCORED_SQL + "select company_name, email, cast(score as string) as score, tier, review_count from scored where tier = 'C'"),
    "icp_filter": (_ids(leads.icp), f"with {BASE_SQL} select ord from raw where {ICP_SQL}"),
    "contact_filter": (_ids(leads.contactable), f"with {BASE_SQL} select ord from raw where {CONTACT_TEST}"),
    "dead_email_filter": (_ids(leads.not_only_dead_email), f"with {BASE_SQL} select ord from raw where not (email_verified = 'dead' and phone = '' and linkedin = '')"),
    "score_floor": (_s(lambda df: leads.score_floor(df, 35).select("ord")), SCORED_SQL + "select ord from scored where score >= 35"),
    "first_seen_in_source": (lambda s, d: leads.first_seen(raw_leads(s, d), F.lower(F.coalesce(F.nullif("website", F.lit("")), "company_name"))).select("ord"), f"with {BASE_SQL} select min(ord) as ord from raw group by lower(coalesce(nullif(website, ''), company_name))"),
    "first_rows": (lambda s, d: leads.first_rows(raw_leads(s, d), 300).select("ord"), f"with {BASE_SQL} select ord from raw order by ord limit 300"),
    "email_statuses": (_statuses, f"with {BASE_SQL} select case when email = '' then 'none' when c >= 500 then 'unknown' when c % 2 = 0 then 'alive' else 'dead' end as email_verified, count(*) as n from (select *, ord % 700 as c from raw) group by 1"),
    "stored_rows": (_rows, f"with {BASE_SQL} select ord, nullif(email, '') as email, nullif(regexp_extract(rating, '^\\d+\\.?\\d*')::double, 0) as rating, nullif(regexp_extract(review_count, '^\\d+')::int, 0) as review_count, nullif((ord % 3)::int, 0) as score from raw"),
    "master_merge": (lambda s, d: master(s, d).select("dedupe_key", "category", "company_name", "first_seen_at", "last_seen_at", "scraped_at"), MASTER_SQL),
    "master_expiry": (_pruned, "select event_id from events where case when event_id % 10 > 0 then ts > timestamp '2023-12-21' else event_id % 20 <> 0 end"),
    "upsert": (upserted, SCORED_SQL + f", {STORED_SQL}, {BATCH_SQL} select coalesce(s.dedupe_key, b.dedupe_key) as dedupe_key, coalesce(b.score, s.score) as score, coalesce(b.tier, s.tier) as tier, coalesce(b.source, s.source) as source, s.status, case when b.dedupe_key is not null then {NOW} else s.updated_at end as updated_at from stored s full join batch b on s.dedupe_key = b.dedupe_key"),
    "saved_search_match": (_s(lambda df: df.where(service.matches_saved(SAVED)).select("ord")), SCORED_SQL + "select ord from scored where score between 0 and 60 and list_contains(tags, 'healthcare') and contains(lower(concat_ws(' ', nullif(company_name, ''), nullif(email, ''), nullif(address, ''), nullif(category, ''), nullif(search_query, ''))), 'germany')"),
    "new_deliveries": (deliveries, DELIVERY_SQL),
    "claim_runs": (claimed, CLAIM_SQL),
    "latest_runs": (lambda s, d: service.latest_runs(run_rows(s, d), 5).select("saved_search_id", "id", F.col("nth").cast("long").alias("nth")), f"select saved_search_id, id, nth from (select *, row_number() over (partition by saved_search_id order by created_at desc, id desc) as nth from (select {RUNS} from events)) where nth <= 5"),
    "due_searches": (lambda s, d: scheduled(s, d).where(service.due(F.expr(NOW))).select("id"), f"with {SCHEDULED_SQL} select id from searches where is_active and (last_run_at is null or last_run_at <= {NOW} - case when schedule = 'daily' then interval 1 day else interval 7 day end)"),
    "signature_groups": (lambda s, d: service.signature_groups(scheduled(s, d)), f"with {SCHEDULED_SQL} select coalesce(industry, 'any') || '|' || coalesce(nullif(region, ''), 'all') || '|' || case when depth = 'deep' then 'deep' else 'quick' end as signature, count(*) as n, min(id) as first from searches group by 1"),
    "reclassification": (_reclassified, SCORED_SQL + "select outcome, count(*) as n from (select case when id % 9 = 0 then 'protected' when old is not distinct from industry then 'unchanged' when industry is null then 'cleared' when old is null then 'gained' else 'changed' end as outcome from (select id, industry, case when id % 4 = 0 then null when id % 4 = 1 then 'healthcare' else industry end as old from scored)) group by 1"),
    "parsed_answers": (_answers, "select event_id, case event_id % 5 when 1 then 'ai-ml' when 3 then 'healthcare' end as industry, case event_id % 5 when 1 then 'healthcare' when 2 then '' when 3 then '' end as secondary, case event_id % 5 when 1 then 1.0::double when 2 then 0.5::double when 3 then 0.0::double end as confidence from events"),
    "needs_classification": (_s(lambda df: df.withColumn("llm_model", F.lit(None).cast("string")).withColumn("tag_source", F.when(F.col("ord") % 5 == 0, "llm").otherwise("rules")).where(service.needs_classification("m1", 0.65)).select("ord")), SCORED_SQL + f"select ord from scored where industry is null or ord % 5 = 0 or {CONF_SQL} < 0.65"),
    "map_elements": (_elements, "select s_name as name, 'it' as category, cast(s_nationkey as string) as phone, 'Road ' || cast(s_suppkey % 5 as string) || ', Town' as address from supplier"),
    "linked_data": (_linked, "select s_suppkey as ord, s_name as name, cast(s_nationkey as string) as phone, case when s_suppkey % 2 = 0 then '' else 'https://firm.example/x' end as website, '1 Road, R' as address from supplier"),
    "unwrapped_links": (lambda s, d: table(s, d, "supplier").select("s_suppkey", captured.unwrapped(F.expr("'https://dir.example/r?u=https%3A%2F%2F' || case when s_suppkey % 3 = 0 then 'dir.example' else 'a.example' end || '%2Fp%2Bq'"), "dir.example").alias("target")), "select s_suppkey, case when s_suppkey % 3 <> 0 then 'https://a.example/p+q' end as target from supplier"),
    "contacts": (contact_rows, CONTACT_SQL),
    "page_texts": (lambda s, d: table(s, d, "documents").select("doc_id", F.length(captured.page_text(F.col("text"), F.lit(""))).cast("long").alias("n")), "select doc_id, case when length(trim(text)) >= 50 then least(length(text), 20000) end as n from documents"),
    "name_confidence": (_confidences, "select p_partkey, case when p_partkey % 3 = 0 or not contains(p_name, ' ') then 1.0::double else 0.7::double end as confidence from part"),
    "source_union": (lambda s, d: table(s, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment").unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name")), allowMissingColumns=True), "select c_name as name, c_mktsegment from customer union all select s_name, null from supplier"),
    "event_windows": (lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"), "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2"),
    **{name: (_page(q), page_sql(q)) for name, q in PAGES_OF.items()},
}
PREMIUM_FALLBACK_SQL = or_sql("lower(concat_ws(' ', coalesce(category, ''), coalesce(company_name, '')))", PREMIUM_WORDS)
QUERIES["unclassified_score"] = (lambda s, d: leads.scored(raw_leads(s, d)).select("ord", "score"), f"with {BASE_SQL}, h as (select *, coalesce(try_cast(regexp_extract(rating, '^\\d+\\.?\\d*') as double), 0) as rt, coalesce(try_cast(regexp_extract(review_count, '^\\d+') as bigint), 0) as rv, case when {PREMIUM_FALLBACK_SQL} then ['ai-ml'] else ['none'] end as tags, 0 as employee_count from raw) select ord, {SCORE_SQL} as score from h")
QUERIES |= SOURCE_QUERIES
QUERIES |= job_queries(raw_leads, scored, BASE_SQL, f"coalesce({KEY_SQL}, {NAME_SQL})", SCORED_SQL)
QUERIES |= more_queries(raw_leads, scored, BASE_SQL, SCORED_SQL, MERGED_SQL, ICP_SQL, CONTACT_TEST, CLEAN_RAW_SQL, scored_sql, f"coalesce({KEY_SQL}, {NAME_SQL})")
QUERIES |= state_queries(scratch)
