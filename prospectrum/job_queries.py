"""Jobs over the stored table bound to the driver's tables, with SQL. Takes what it shares with queries.py as arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.plans import maintenance
from prospectrum.runtime import table

Frame = Callable[[SparkSession, str], DataFrame]
OLD_SQL = "case id % 4 when 0 then null when 1 then 'healthcare' else industry end"


def job_queries(raw: Frame, scored: Frame, base_sql: str, key_sql: str, scored_sql: str) -> dict[str, tuple[Frame, str]]:
    def again(spark: SparkSession, sf: str) -> DataFrame:
        s = scored(spark, sf)
        old = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "healthcare").otherwise(F.col("industry"))
        return maintenance.reclassified(s.withColumns({"industry": old, "tag_source": F.when(F.col("id") % 9 == 0, "llm").otherwise("rules")}))

    def filled(spark: SparkSession, sf: str) -> DataFrame:
        rows = raw(spark, sf)
        found = rows.where("ord % 2 = 0").select("ord", F.concat(F.lit("new"), F.col("ord").cast("string")).alias("email"), F.lit("").alias("phone"))
        return maintenance.filled(rows, found, "ord", ("email", "phone"), 300).select("ord", "email", "phone")

    def pending(spark: SparkSession, sf: str) -> DataFrame:
        rows = raw(spark, sf)
        return maintenance.pending(rows, rows.where("ord % 3 = 0").select(F.lower("company_name").alias("key")), F.lower("company_name")).select("ord")

    def outcomes(spark: SparkSession, sf: str) -> DataFrame:
        return maintenance.outcomes(table(spark, sf, "events").selectExpr("case when event_id % 3 = 0 then 1 end as parsed", "case when event_id % 3 = 1 then 'e' end as error"))

    new_sql = f"x as (select id, {OLD_SQL} as old, industry as new from scored)"
    done_sql = f"with {base_sql} select ord from raw where lower(company_name) not in (select lower(company_name) from raw where ord % 3 = 0)"
    return {
        "reclassified_rows": (lambda s, d: again(s, d).select("id", "industry", "outcome"), scored_sql + f", {new_sql} select id, case when id % 9 = 0 then old else new end as industry, case when id % 9 = 0 then 'protected' when old is not distinct from new then 'unchanged' when new is null then 'cleared' when old is null then 'gained' else 'changed' end as outcome from x"),
        "industry_losses": (lambda s, d: maintenance.industry_losses(again(s, d)), scored_sql + f", {new_sql} select old as industry, count(*) as n from x where id % 9 <> 0 and old is not null and old is distinct from new group by 1"),
        "collapsed_keys": (lambda s, d: maintenance.collapsed(raw(s, d), "ord").select("ord"), f"with {base_sql}, k as (select ord, {key_sql} as dedupe_key from raw) select min(ord) as ord from k where dedupe_key is not null group by dedupe_key"),
        "filled_contacts": (filled, f"with {base_sql}, lack as (select ord from raw where website <> '' and email = '' order by ord limit 300) select ord, case when email = '' and ord % 2 = 0 and ord in (select ord from lack) then 'new' || cast(ord as varchar) else email end as email, phone from raw"),
        "pending_firms": (pending, done_sql),
        "model_outcomes": (outcomes, "select count_if(event_id % 3 = 0)::bigint as classified, count_if(event_id % 3 = 1)::bigint as failed, count_if(event_id % 3 = 2)::bigint as unusable, count(*) as total from events"),
    }
