"""python -m prospectrum COMMAND ...: batch jobs over captured files and the stored table (Parquet)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.functions.rules import TAXONOMY, Vocabularies, differences
from prospectrum.functions.text import name_key, site_key
from prospectrum.operators import leads, matching, searches, service
from prospectrum.plans import maintenance, pipeline
from prospectrum.sources import captured, directories


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prospectrum")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "captures (a Parquet folder for each source) to scored leads"), ("ingest", "run files (CSV) to scored leads"), ("rescore", "scores of a stored table anew"), ("clean", "a stored table cleaned and merged"), ("reclassify", "classes of a stored table by the rules"), ("export", "a stored table as CSV")):
        c = sub.add_parser(name, help=text)
        c.add_argument("source")
        c.add_argument("target")
        if name in ("run", "ingest", "reclassify"):
            c.add_argument("--vocabulary", help="JSON file with icp_words, industries or regions in place of the default ones")
        if name == "run":
            c.add_argument("--only", nargs="*", help="sources, by key")
        if name == "reclassify":
            c.add_argument("--apply", action="store_true", help="write the rows; else the counts of outcomes")
    c = sub.add_parser("migrate", help="a stored table of an earlier form in the present one")
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("drift", help="what a vocabulary file has otherwise than the built-in one; an error if there is anything")
    c.add_argument("source")
    c = sub.add_parser("url", help="one company's site, from its captured pages (Parquet: host, path, html), to a scored lead")
    c.add_argument("website")
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("firms", help="names (a text file) to scored leads, from a folder with resolved (Parquet: name, website) and pages; names already in the target are left alone")
    c.add_argument("source")
    c.add_argument("captures")
    c.add_argument("target")
    c = sub.add_parser("saved-searches", help="claim pending runs of a folder with searches, runs and leads, and write its next runs and deliveries")
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("classify", help="a stored table updated by captured model answers (Parquet: dedupe_key, answer)")
    c.add_argument("source")
    c.add_argument("answers")
    c.add_argument("target")
    c.add_argument("--model", default="captured")
    c.add_argument("--dry-run", action="store_true", help="write what the answers say, and no table")
    c.add_argument("--force", action="store_true", help="classes that are good enough, too")
    return p


def one_site(spark: SparkSession, website: str, pages: DataFrame) -> DataFrame:
    """A site's scored lead; none where the quality filters drop it."""
    url = website if website.lower().startswith(("http://", "https://")) else f"https://{website}"
    own = pages.where(F.col("host") == site_key(F.lit(url)))
    found = captured.contacts(captured.in_path_order(own, deep=True))
    return pipeline.run(searches.one_site(website, found, F.current_timestamp()))


def firms(spark: SparkSession, names: DataFrame, captures: str, done: DataFrame | None) -> DataFrame:
    """Leads of names (name) whose website was found, scored; those of done (name_key) are left out."""
    todo = names.withColumn("name_key", name_key(F.col("name"))).where("name_key <> ''").dropDuplicates(["name_key"])
    if done is not None:
        todo = todo.join(done.select("name_key").distinct(), "name_key", "left_anti")
    sites = spark.read.parquet(f"{captures}/resolved").select("name", "website")
    found = captured.contacts(captured.in_path_order(spark.read.parquet(f"{captures}/pages"), deep=True))
    rows = todo.join(directories.resolved(todo.select("name"), ("captured", sites.withColumns({"profile_url": F.lit(""), "confidence": F.lit(1.0)}))), "name").where(F.col("website").isNotNull())
    raw = captured.enriched(leads.as_leads(rows.select(F.xxhash64("name_key").alias("ord"), "name", "website", "profile_url").withColumns({"source": F.lit("on_demand_firm"), "engine": F.lit("on_demand")})), found)
    scored = pipeline.run(raw)
    return scored.withColumn("name_key", name_key(F.col("company_name")))


def saved_searches(spark: SparkSession, source: str, target: str) -> None:
    """Runs that are due or pending are claimed, their matches among the stored leads delivered, and the runs closed; all
    runs meet the leads in one join."""
    now = F.current_timestamp()
    own, stored = spark.read.parquet(f"{source}/searches"), spark.read.parquet(f"{source}/leads")
    searches.enqueued(spark.read.parquet(f"{source}/runs"), own, now).write.mode("overwrite").parquet(f"{target}/queued")
    service.claim(spark.read.parquet(f"{target}/queued"), own, now).write.mode("overwrite").parquet(f"{target}/claimed")
    claimed = spark.read.parquet(f"{target}/claimed")
    empty = spark.createDataFrame([], "user_id string, lead_id long, saved_search_id long, scrape_run_id long, delivery_reason string")
    work = claimed.where("status = 'running'").select(F.col("id").alias("scrape_run_id"), "saved_search_id").join(own.select(F.col("id").alias("saved_search_id"), "filter_json", "user_id"), "saved_search_id")
    hits = matching.matched(stored.where("dedupe_key is not null"), work, ["id"], ["user_id", "saved_search_id", "scrape_run_id"])
    # A lead that several runs of a user match is the first run's.
    rows = hits.groupBy("user_id", F.col("id").alias("lead_id")).agg(F.min(F.struct("scrape_run_id", "saved_search_id")).alias("x")).select("user_id", "lead_id", F.col("x.saved_search_id").cast("long").alias("saved_search_id"), F.col("x.scrape_run_id").cast("long").alias("scrape_run_id"), F.lit("fresh").alias("delivery_reason"))
    delivered = spark.read.parquet(f"{source}/user_leads") if captured.exists(spark, f"{source}/user_leads") else empty
    service.new_deliveries(delivered, rows).write.mode("overwrite").parquet(f"{target}/user_leads")
    found = spark.read.parquet(f"{target}/user_leads").groupBy(F.col("scrape_run_id").alias("id")).agg(F.count(F.lit(1)).alias("leads_found"))
    running = claimed.where("status = 'running'").select("id").join(found, "id", "left").select("id", F.coalesce("leads_found", F.lit(0)).alias("leads_found"))
    service.finish(claimed, running, now).write.mode("overwrite").parquet(f"{target}/runs")


def model_pass(df: DataFrame, answers: DataFrame, model: str, allowed: list[str], force: bool, dry_run: bool) -> DataFrame:
    """The table after a pass of answers, or in a dry run what each answer says."""
    todo = df.where(service.needs_classification(model, force=force)).select("dedupe_key")
    got = answers.select("dedupe_key", "answer").join(todo, "dedupe_key", "left_semi").groupBy("dedupe_key").agg(F.min("answer").alias("answer"))
    if dry_run:
        p = service.parsed_answer(F.col("answer"), allowed)
        return got.select("dedupe_key", p.alias("p")).select("dedupe_key", "p.industry", "p.confidence")
    return service.classified(df.join(got, "dedupe_key", "left"), allowed, model, F.current_timestamp()).drop("answer")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("prospectrum").getOrCreate()
    if a.command in ("run", "ingest", "reclassify"):
        words = Vocabularies.read(spark.read.text(a.vocabulary, wholetext=True).first()[0] if a.vocabulary else "{}")
        settings = pipeline.Settings(icp_words=words.icp_words, taxonomy=words.taxonomy, regions=words.regions)
    if a.command == "run":
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(a.source)
        keys = [s.getPath().getName() for s in root.getFileSystem(conf).listStatus(root)]
        rows, failed = captured.gather_into({k: lambda k=k: spark.read.parquet(f"{a.source}/{k}") for k in keys}, F.current_timestamp(), f"{a.target}.gathered", tuple(a.only) if a.only else None)
        for key, why in failed.items():
            print(f"left out: {key}: {why}", file=sys.stderr)
        out = pipeline.run(rows, settings)
    elif a.command == "ingest":
        out = pipeline.run(captured.read_runs(spark, a.source), settings)
    elif a.command == "rescore":
        out = maintenance.rescored(spark.read.parquet(a.source))
    elif a.command == "clean":
        out = maintenance.cleaned_table(spark.read.parquet(a.source))
    elif a.command == "reclassify":
        out = maintenance.reclassified(spark.read.parquet(a.source), words.taxonomy)
        out = maintenance.collapsed(out.drop("outcome", "before"), "ord") if a.apply else service.counts_by(out, "outcome", "none")
    elif a.command == "migrate":
        out = maintenance.migrated(spark.read.parquet(a.source))
    elif a.command == "drift":
        if found := differences(Vocabularies.read("{}"), Vocabularies.read(spark.read.text(a.source, wholetext=True).first()[0])):
            raise SystemExit("\n".join(found))
        return
    elif a.command == "url":
        out = one_site(spark, a.website, spark.read.parquet(a.source))
    elif a.command == "firms":
        done = spark.read.parquet(a.target) if captured.exists(spark, a.target) else None
        firms(spark, spark.read.text(a.source).select(F.trim("value").alias("name")), a.captures, done).write.mode("append").parquet(a.target)
        return
    elif a.command == "saved-searches":
        saved_searches(spark, a.source, a.target)
        return
    elif a.command == "classify":
        out = model_pass(spark.read.parquet(a.source), spark.read.parquet(a.answers), a.model, [s for s, _ in TAXONOMY.buckets], a.force, a.dry_run)
    else:
        captured.replace_csv(spark.read.parquet(a.source), a.target)
        return
    out.write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
