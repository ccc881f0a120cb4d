"""Queries over keyed state, deliveries, filters as rows, seek paging and sessions, bound to the driver's tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.operators import matching, paging, service
from prospectrum.operators.service import LeadsQuery
from prospectrum.plans import maintenance, rollups
from prospectrum.runtime import table
from prospectrum.source_queries import pages
from prospectrum.sources import datasource, directories
from prospectrum.streaming import incremental, state

Frame = Callable[[SparkSession, str], DataFrame]
PAGE = LeadsQuery(region="r1", min_score=20, page=3, page_size=10)
SESSIONS_SQL = """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
 i as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
 select user_id, min(ts) as start, max(ts) as last, count(*) as n, round(sum(value), 4) as value from i group by user_id, s"""
PARTS, TTL_DAYS = 4, 4.0

# Stored leads of customers and saved searches of orders: expressions that both engines read.
LEAD = {
    "id": "c_custkey", "dedupe_key": "'k' || cast(c_custkey as string)", "company_name": "c_name", "email": "case when c_custkey % 3 = 0 then '' else 'a' || cast(c_custkey as string) || '@x.com' end",
    "address": "case when c_custkey % 2 = 0 then 'Town ' || cast(c_nationkey as string) end", "category": "lower(c_mktsegment)", "search_query": "cast(null as string)", "tier": "case c_custkey % 4 when 0 then 'A' when 1 then 'B' else 'C' end",
    "source": "case c_custkey % 5 when 0 then 'clutch' when 1 then null else 'google_maps' end", "industry": "case when c_custkey % 7 < 5 then 'i' || cast(c_custkey % 7 as string) end", "region": "'r' || cast(c_nationkey % 5 as string)",
    "firm_size_band": "case c_custkey % 3 when 0 then 'small' when 1 then 'mid' end", "score": "case when c_custkey % 11 > 0 then cast(c_custkey % 101 as int) end",
}
TAGS = ("'t' || cast(c_custkey % 6 as string)", "'t' || cast(c_custkey % 10 as string)")
FILTER = {
    "tier": "case when o_orderkey % 2 = 0 then 'A' end", "source": "case when o_orderkey % 9 = 0 then 'clutch' end", "industry": "case when o_orderkey % 3 > 0 then 'i' || cast(o_orderkey % 6 as string) end",
    "tag": "case when o_orderkey % 5 = 0 then 't' || cast(o_orderkey % 8 as string) end", "region": "case when o_orderkey % 4 > 0 then 'r' || cast(o_orderkey % 5 as string) end",
    "minScore": "case when o_orderkey % 6 < 4 then cast(o_orderkey % 90 as double) end", "maxScore": "case when o_orderkey % 7 = 0 then 60.0 end", "hasEmail": "case when o_orderkey % 8 = 0 then true end",
    "search": "case when o_orderkey % 10 = 0 then ' Town ' || cast(o_orderkey % 25 as string) || ' ' end",
}


def leads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(*(F.expr(e).alias(n) for n, e in LEAD.items()), F.array(*map(F.expr, TAGS)).alias("tags"))


def searches(spark: SparkSession, sf: str) -> DataFrame:
    own = F.to_json(F.struct(*(F.expr(e).alias(n) for n, e in FILTER.items())))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).cast("string").alias("user_id"), own.alias("filter_json"))


LEADS_SQL = "leads as (select " + ", ".join(f"{e} as {n}" for n, e in LEAD.items()) + f", [{', '.join(TAGS)}] as tags from customer)"
FILTERS_SQL = "filters as (select o_orderkey as search_id, cast(o_custkey % 50 as varchar) as user_id, " + ", ".join(f"{e} as f_{n}" for n, e in FILTER.items()) + " from orders)"
MATCH = " and ".join(f"(f_{c} is null or f_{c} = {c})" for c in ("tier", "source", "industry", "region"))
MATCH += """ and (f_tag is null or list_contains(tags, f_tag)) and (f_minScore is null or coalesce(score, 0) >= f_minScore) and (f_maxScore is null or coalesce(score, 0) <= f_maxScore)
 and (f_hasEmail is null or email <> '') and (f_search is null or contains(lower(concat_ws(' ', company_name, nullif(email, ''), address, category)), lower(trim(f_search))))"""


def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = matching.counted(leads(spark, sf), searches(spark, sf).withColumnRenamed("id", "search_id"), "id", ["search_id"])
    return both.select("search_id", "n", F.col("id").alias("ids"))


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    own = leads(spark, sf)
    return matching.attributed_all(own, own.where("id % 3 < 2"), searches(spark, sf)).select("user_id", "lead_id", "saved_search_id")


def in_parts(spark: SparkSession, sf: str, rows: DataFrame, order: str, kind: str, scratch: Callable) -> DataFrame:
    """A table as a stream: micro-batches of rows that follow each other in an order. Each batch is several files; all are written in
    one parallel job and dated by their place in the order, as a stream reads its files by date."""
    path = scratch(spark)
    rows.repartitionByRange(PARTS * spark.sparkContext.defaultParallelism, order).write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files() -> list:
        return [f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]

    own = sorted(files(), key=lambda f: f.getPath().getName())
    first = min(f.getModificationTime() for f in own) - 1000 * len(own)
    dates = {f.getPath().getName(): first + 1000 * i for i, f in enumerate(own)}
    for f in own:
        fs.setTimes(f.getPath(), dates[f.getPath().getName()], -1)
    if {f.getPath().getName(): f.getModificationTime() for f in files()} != dates:
        raise OSError(f"{path}: the file system keeps no dates, so the stream's order is unknown")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", -(-len(own) // PARTS)).parquet(path)


def state_queries(scratch: Callable[[SparkSession], str]) -> dict[str, tuple[Frame, str]]:
    def lives(spark: SparkSession, sf: str) -> DataFrame:
        us = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
        rows = table(spark, sf, "events").selectExpr("'u' || cast(user_id as string) || '-' || cast(event_id % 7 as string) as dedupe_key", f"{us} as seen_us", "event_type as category", "case when event_id % 2 = 0 then '' else cast(event_id as string) end as phone")
        stream = in_parts(spark, sf, rows, "seen_us", "dedupe_key string, seen_us bigint, category string, phone string", scratch)
        out, mark = scratch(spark), scratch(spark)
        state.living_master(stream, ["category", "phone"], days=TTL_DAYS).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        schema = "dedupe_key string, first_seen bigint, last_seen bigint, n_seen bigint, category string, phone string, over boolean"
        return state.latest_lives(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)).select("dedupe_key", "first_seen", "last_seen", "n_seen", "category", "phone")

    def replayed(spark: SparkSession, sf: str) -> DataFrame:
        """Each batch is delivered, then once more as if its first write had broken off."""
        rows = table(spark, sf, "events").selectExpr("cast(user_id as string) as user_id", "event_id % 40 as lead_id", "event_id")
        kind = "user_id string, lead_id bigint, event_id bigint"
        path, mark = scratch(spark), scratch(spark)
        write = state.deliver_into(path)

        def twice(batch: DataFrame, number: int) -> None:
            first = batch.groupBy("user_id", "lead_id").agg(F.min("event_id").alias("event_id"))
            write(first, number)
            write(first, number)

        in_parts(spark, sf, rows, "event_id", kind, scratch).writeStream.foreachBatch(twice).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return state.deliveries(spark, path, kind)

    def captured_leads(spark: SparkSession, sf: str) -> DataFrame:
        """Supplier pages as captures of two sources and several days, read back by the data source."""
        path = scratch(spark)
        for name in ("goodfirms", "clutch"):
            rows = pages(spark, sf, name).selectExpr(f"'{name}' as source", "'2026-01-' || lpad(cast(ord % 9 + 1 as string), 2, '0') as day", "ord", "'https://list.example/' || cast(ord as string) as url", "html as body")
            datasource.write_captures(rows, path)
        own = datasource.captures(spark, path).where("source = 'goodfirms' and day >= '2026-01-04'")
        return directories.goodfirms(own.select("ord", F.col("body").alias("html"))).select("name", "rating", "reviews")

    def seek_page(spark: SparkSession, sf: str) -> DataFrame:
        own = paging.Ordered(scratch(spark))
        own.write(leads(spark, sf).withColumn("deleted_at", F.when(F.col("id") % 17 == 0, F.lit("x"))), 8)
        page, total = own.page(spark, PAGE)
        return page.select("id", "score", F.lit(total).cast("long").alias("total"))

    def rollup(spark: SparkSession, sf: str) -> DataFrame:
        """A table of days, made once, from which the last ten are asked for, by tier."""
        path = scratch(spark)
        rows = leads(spark, sf).withColumns({"phone": F.col("address"), "linkedin": F.lit(None).cast("string"), "day": (F.col("id") % 30).cast("int"), "dedupe_key": F.concat(F.lit("s"), (F.col("id") % 400).cast("string"))})
        rollups.daily(rows, F.col("day"), "tier").write.parquet(path)
        out = rollups.merged(spark.read.parquet(path).where("day >= 20"), "tier")
        exact = rows.where("day >= 20").groupBy("tier").agg(F.countDistinct("dedupe_key").alias("keys"), F.expr("percentile(score, array(0.47, 0.53))").alias("near"))
        told = F.abs(F.col("distinct_keys") - F.col("keys")) <= 0.06 * F.col("keys")
        ranked = F.col("score_50").between(F.floor(F.col("near")[0]), F.ceil(F.col("near")[1]))
        return out.join(exact, "tier").select("tier", "n", "with_email", "with_phone", "with_email_percent", F.round("average", 6).alias("average"), told.alias("keys_near"), ranked.alias("median_near"))

    def answered(spark: SparkSession, sf: str) -> DataFrame:
        """Answers about customers' pages, plain, fenced, with chatter or broken, fill the gaps of stored leads."""
        own = leads(spark, sf).withColumns({"phone": F.lit(""), "linkedin": F.when(F.col("id") % 2 == 0, "https://linkedin.com/old"), "facebook": F.lit(""), "instagram": F.lit("")})
        said = F.to_json(F.struct(F.concat(F.lit("Mail"), F.col("id").cast("string"), F.lit("@Firm.com")).alias("email"), F.when(F.col("id") % 4 > 0, "N/A").otherwise("+1 2").alias("phone"), F.lit("https://linkedin.com/new").alias("linkedin")))
        kinds = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), said, F.lit("\n```"))).when(F.col("id") % 5 == 1, F.concat(F.lit("Found "), said, F.lit(" only."))).when(F.col("id") % 5 == 2, "nothing {found").otherwise(said)
        found = service.contact_answers(own.select("dedupe_key", kinds.alias("answer")))
        return maintenance.filled(own, found).select("id", "email", "phone", "linkedin")

    lives_sql = f"""with e as (select 'u' || cast(user_id as varchar) || '-' || cast(event_id % 7 as varchar) as dedupe_key, epoch_us(ts) as seen, event_type, case when event_id % 2 = 1 then cast(event_id as varchar) end as phone, event_id from events),
 g as (select *, case when seen - lag(seen) over (partition by dedupe_key order by seen) <= {int(TTL_DAYS * state.DAY)} then 0 else 1 end as new from e),
 i as (select *, sum(new) over (partition by dedupe_key order by seen) as life from g)
 select dedupe_key, min(seen) as first_seen, max(seen) as last_seen, count(*) as n_seen, arg_min(event_type, seen) as category, coalesce(arg_min(phone, seen) filter (where phone is not null), '') as phone from i group by dedupe_key, life"""
    return {
        "filters_as_rows": (match_counts, f"with {LEADS_SQL}, {FILTERS_SQL} select search_id, count(*) as n, cast(sum(id) as bigint) as ids from filters join leads on {MATCH} group by search_id"),
        "deliveries_of_filters": (delivered, f"with {LEADS_SQL}, {FILTERS_SQL} select user_id, id as lead_id, min(search_id) as saved_search_id from filters join leads on {MATCH} where id % 3 < 2 group by user_id, id"),
        "contact_answers": (answered, f"with {LEADS_SQL} select id, case when email <> '' or id % 5 = 2 then email else 'mail' || cast(id as varchar) || '@firm.com' end as email, case when id % 5 = 2 or id % 4 > 0 then '' else '+1 2' end as phone, case when id % 2 = 0 then 'https://linkedin.com/old' when id % 5 <> 2 then 'https://linkedin.com/new' end as linkedin from leads"),
        "captured_leads": (captured_leads, "select name, '4.5' as rating, cast(s_nationkey as varchar) as reviews from (select s_name as name, * from supplier union all select 'Other ' || s_name as name, * from supplier) where s_suppkey % 9 + 1 >= 4"),
        "query_page_seek": (seek_page, f"with {LEADS_SQL}, own as (select id, score from leads where id % 17 > 0 and region = 'r1' and coalesce(score, -1) >= 20) select id, score, (select count(*) from own) as total from own order by score desc nulls last, id limit {PAGE.page_size} offset {PAGE.page_size * (PAGE.page - 1)}"),
        "dashboard_rollup": (rollup, f"with {LEADS_SQL} select tier, count(*) as n, count_if(email <> '') as with_email, count(address) as with_phone, cast(round(100.0 * count_if(email <> '') / count(*)) as integer) as with_email_percent, round(avg(score), 6) as average, true as keys_near, true as median_near from leads where id % 30 >= 20 group by tier"),
        "event_sessions": (lambda s, d: incremental.sessions(table(s, d, "events"), "6 hours").select("user_id", "start", "last", "n", F.round("value", 4).alias("value")), SESSIONS_SQL),
        "sliding_counts": (lambda s, d: incremental.windowed_counts(table(s, d, "events"), width="6 hours", slide="2 hours"), "select time_bucket(interval 2 hour, ts) - to_hours(2 * k) as start, event_type, count(*) as n from events, unnest([0, 1, 2]) as x(k) group by 1, 2"),
        "living_master": (lives, lives_sql),
        "replayed_deliveries": (replayed, "select cast(user_id as varchar) as user_id, event_id % 40 as lead_id, min(event_id) as event_id from events group by 1, 2"),
    }
