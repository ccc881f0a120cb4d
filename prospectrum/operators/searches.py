"""Saved searches and their runs as tables: made, listed, changed, deleted and queued. Each function gives the
table's next state, or the rows that a user sees; a request is a row, so many are answered at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.operators import leads, service
from prospectrum.operators.service import LeadsQuery

# What a search's name, schedule and order may be, and a filter's keys with their types.
LONGEST_NAME = 120
SCHEDULES, DEPTHS = ("off", "daily", "weekly"), ("quick", "deep")
IN_FLIGHT = ("pending", "running")
TEXT_KEYS, NUMBER_KEYS, TRUTH_KEYS = ("tier", "source", "industry", "tag", "region", "firmSizeBand", "search"), ("minScore", "maxScore"), ("hasEmail",)
CHOICES = {"sortCol": ("score", "scraped_at"), "sortDir": ("asc", "desc")}


def filter_problem(c: Column) -> Column:
    """Null where a filter's JSON is an object whose known keys have their types; else what is wrong."""
    typed = F.transform_values(F.from_json(c, "map<string, string>"), lambda _, v: v)
    quoted = lambda k: c.rlike(rf'"{k}"\s*:\s*"')
    has = lambda k: F.map_contains_key(typed, F.lit(k)) & typed[k].isNotNull()
    checks = [(has(k) & ~quoted(k), k) for k in TEXT_KEYS]
    checks += [(has(k) & (quoted(k) | typed[k].try_cast("double").isNull()), k) for k in NUMBER_KEYS]
    checks += [(has(k) & (quoted(k) | ~typed[k].isin("true", "false")), k) for k in TRUTH_KEYS]
    checks += [(has(k) & ~typed[k].isin(*v), k) for k, v in CHOICES.items()]
    out = F.when(c.isNull() | ~F.trim(c).startswith("{") | typed.isNull(), "filter is no JSON object")
    for bad, k in checks:
        out = out.when(bad, f"filter has an odd {k}")
    return out


def name_problem(c: Column) -> Column:
    n = F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(n < 1, "a name is needed").when(n > LONGEST_NAME, "the name is too long")


def created(searches: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(searches with new rows, what was asked with its problem). asked: user_id, name, filter_json, request_id; ids
    go on from the greatest, in the order of request_id."""
    judged = asked.withColumn("problem", F.coalesce(name_problem(F.col("name")), filter_problem(F.col("filter_json"))))
    last = searches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    nth = F.row_number().over(W.orderBy("request_id"))  # requests of one call, not the table
    new = judged.where("problem is null").withColumn("_nth", nth).join(F.broadcast(last)).select(
        (F.col("_last") + F.col("_nth")).alias("id"), "user_id", F.trim("name").alias("name"), "filter_json",
        F.lit("off").alias("schedule"), F.lit(True).alias("is_active"), F.lit("quick").alias("depth"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("last_run_at"),
    )
    return searches.unionByName(new, allowMissingColumns=True), judged


def listed(searches: DataFrame, user_id: str) -> DataFrame:
    """A user's own, newest first."""
    return searches.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("id")).select("id", "name", "filter_json", "schedule", "is_active", "created_at")


def changed(searches: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: id, user_id, name, is_active and, if it has it, schedule; null leaves a value. Only a user's own rows
    change, and no row whose new name is empty or too long or whose schedule isn't known. Of several requests for a
    row the one with the greatest request_id counts."""
    asked = asked if "schedule" in asked.columns else asked.withColumn("schedule", F.lit(None).cast("string"))
    ok = asked.where((F.col("name").isNull() | name_problem(F.col("name")).isNull()) & (F.col("schedule").isNull() | F.col("schedule").isin(*SCHEDULES)))
    last = ok.groupBy("id", "user_id").agg(F.max_by(F.struct(F.trim("name").alias("name"), "is_active", "schedule"), "request_id").alias("_new"))
    out = searches.join(last, ["id", "user_id"], "left")
    return out.withColumns({c: F.coalesce(f"_new.{c}", c) for c in ("name", "is_active", "schedule")}).select(*searches.columns)


def deleted(searches: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: id, user_id."""
    return searches.join(asked.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*searches.columns)


def queued(runs: DataFrame, searches: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(runs with new pending rows, the answer to each request). asked: saved_search_id, user_id, depth, request_id.

    Answers: 404 where the search isn't the user's, 409 with the run's id where one is in flight or an earlier
    request of this call has queued one, else 202. A depth that isn't known is the search's own."""
    mine = searches.select(F.col("id").alias("saved_search_id"), "user_id", F.col("depth").alias("_depth"), F.lit(True).alias("_mine"))
    flying = runs.where(F.col("status").isin(*IN_FLIGHT)).groupBy("saved_search_id").agg(F.min("id").alias("run_id"))
    nth = F.row_number().over(W.partitionBy("saved_search_id", F.col("_mine").isNull()).orderBy("request_id"))
    judged = asked.join(mine, ["saved_search_id", "user_id"], "left").join(flying, "saved_search_id", "left").withColumn("_nth", nth)
    answer = F.when(F.col("_mine").isNull(), 404).when(F.col("run_id").isNotNull() | (F.col("_nth") > 1), 409).otherwise(202)
    judged = judged.withColumn("answer", answer).withColumn("run_id", F.when(F.col("answer") == 409, F.col("run_id")))
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    new = judged.where("answer = 202").withColumn("_place", F.row_number().over(W.orderBy("request_id"))).join(F.broadcast(last)).select(
        (F.col("_last") + F.col("_place")).alias("id"), "saved_search_id", "user_id", F.lit("pending").alias("status"), now.alias("created_at"),
        F.when(F.col("depth").isin(*DEPTHS), F.col("depth")).otherwise(F.coalesce("_depth", F.lit("quick"))).alias("depth"),
    )
    return runs.unionByName(new, allowMissingColumns=True), judged.select("request_id", "saved_search_id", "answer", "run_id")


def enqueued(runs: DataFrame, searches: DataFrame, now: Column) -> DataFrame:
    """Runs with a pending one for each search that is due and has none in flight."""
    due = searches.where(service.due(now)).select(F.col("id").alias("saved_search_id"), "user_id", "depth", F.lit("due").alias("_why"))
    asked = due.withColumn("request_id", F.col("saved_search_id")).drop("_why")
    return queued(runs, searches, asked, now)[0]


def not_started(runs: DataFrame, run_ids: DataFrame, now: Column, error: str) -> DataFrame:
    """Pending runs (id) whose worker couldn't be started have failed, with the reason."""
    out = runs.join(run_ids.select("id", F.lit(True).alias("_gone")), "id", "left")
    gone = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("status") == "pending")
    return out.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "error": F.when(gone, error).otherwise(F.col("error")), "finished_at": F.when(gone, now).otherwise(F.col("finished_at"))}).select(*runs.columns)


def seeded(delivered: DataFrame, stored: DataFrame, q: LeadsQuery, user_id: str, search_id: int) -> DataFrame:
    """New deliveries of a search that was just saved: what the table already holds for it."""
    rows = service.backfill(stored.where(service.visible(stored)), q).select(F.lit(user_id).alias("user_id"), F.col("id").alias("lead_id"), F.lit(search_id).cast("long").alias("saved_search_id"), F.lit(None).cast("long").alias("scrape_run_id"), F.lit("backfill").alias("delivery_reason"))
    return service.new_deliveries(delivered, rows)


def one_site(website: str, found: DataFrame, now: Column) -> DataFrame:
    """The raw lead of one company's site from what its pages show (emails, linkedin, facebook, instagram): one row."""
    from prospectrum.sources.captured import site_name

    url = website if website.lower().startswith(("http://", "https://")) else f"https://{website}"
    text = lambda c: F.coalesce(F.first(c, ignorenulls=True), F.lit("")).alias(c)
    got = found.agg(F.first("emails", ignorenulls=True).alias("e"), *(text(c) for c in ("linkedin", "facebook", "instagram")))
    row = got.select(F.lit(0).cast("long").alias("ord"), site_name(F.lit(url)).alias("name"), F.lit(url).alias("website"), F.coalesce(F.get("e", F.lit(0)), F.lit("")).alias("email"), F.coalesce(F.array_join("e", "; "), F.lit("")).alias("all_emails"), "linkedin", "facebook", "instagram", F.lit(f"url:{website}").alias("search_query"), F.lit("on_demand_url").alias("source"), F.lit("on_demand").alias("engine"), now.alias("scraped_at"))
    return leads.as_leads(row)
