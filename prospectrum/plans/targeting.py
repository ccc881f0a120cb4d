"""Which jobs would gather leads for saved searches: a join of searches with what each source can be asked.

Vocabularies are small tables, of which the package has a default (``defaults``): ``categories`` (industry, source, category), where the industry ``*`` stands for
searches that name none or an unknown one, and ``places`` (region, region_ord, source, place, place_ord). Only
industry and region can be asked of a source; the rest of a search's filter is applied to what comes back.
"""

from __future__ import annotations

import json
import pkgutil
from datetime import datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAPS, ANY = "google_maps", "*"
# The sources of a depth in order, with the most jobs, pages a job, results or profiles a job, and a job's wording.
ASKED = """
quick google_maps  4 1 20 {c} in {p}
quick clutch       6 1  0 {p}/{c}
quick goodfirms    6 1  0 directory/country/{c}/{p}
deep  google_maps  6 1 40 {c} in {p}
deep  clutch       4 2  0 {p}/{c}
deep  goodfirms    4 2  0 directory/country/{c}/{p}
deep  designrush   4 1  0 {c}/{p}
deep  sortlist     4 1  0 {c}/{p}
deep  techbehemoths 4 1 15 {c}/{p}
deep  selectedfirms 4 2  0 {c}/{p}
"""


def default_rows(raw: str | None = None) -> tuple[list[tuple], list[tuple]]:
    """Rows of categories and places of the targets that come with the package, or of others in the same JSON form."""
    spec = json.loads(raw if raw is not None else pkgutil.get_data("prospectrum", "data/targets.json").decode())
    categories = [(i, s, c) for i, (term, service) in spec["industries"].items() for s, c in ({MAPS: term} | spec["services"][service]).items()]
    places = [(r, n, s, p, k) for n, (r, own) in enumerate(spec["regions"].items()) for s, names in own.items() for k, p in enumerate(names)]
    return categories, places


def defaults(spark: SparkSession, raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(categories, places) of default_rows."""
    categories, places = default_rows(raw)
    return spark.createDataFrame(categories, "industry string, source string, category string"), spark.createDataFrame(places, "region string, region_ord int, source string, place string, place_ord int")


def asked(spark: SparkSession) -> DataFrame:
    """(depth, source, source_ord, most, pages, results, wording): a row for each depth and source."""
    rows = [line.split(None, 5) for line in ASKED.strip().splitlines()]
    return spark.createDataFrame([(d, s, i, int(m), int(p), int(r), w) for i, (d, s, m, p, r, w) in enumerate(rows)], "depth string, source string, source_ord int, most int, pages int, results int, wording string")


def _wanted(searches: DataFrame, categories: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each search and source of its depth: what the source calls the industry, and the region's key."""
    spark = searches.sparkSession
    own = searches.select(F.col("id").alias("search_id"), F.nullif("industry", F.lit("")).alias("industry"), F.nullif("region", F.lit("")).alias("region"), F.when(F.col("depth") == "deep", "deep").otherwise("quick").alias("depth"))
    industries = categories.where(F.col("industry") != ANY).select("industry", F.lit(True).alias("industry_known")).distinct()
    regions = places.select("region", F.lit(True).alias("region_known")).distinct()
    own = own.join(industries, "industry", "left").join(regions, "region", "left").withColumns({
        "industry_known": F.col("industry").isNull() | F.col("industry_known").isNotNull(), "region_known": F.col("region").isNull() | F.col("region_known").isNotNull(),
        "_industry": F.when(F.col("industry_known"), F.col("industry")),
    })
    called = categories.select(F.col("industry").alias("_industry"), "source", "category")
    broad = categories.where(F.col("industry") == ANY).select("source", F.col("category").alias("_broad"))
    every = own.withColumn("_industry", F.coalesce("_industry", F.lit(ANY))).join(asked(spark), "depth").join(called, ["_industry", "source"], "left").join(broad, "source", "left")
    # The map takes free words, so the broad term does where an industry has none.
    return every.withColumn("category", F.coalesce("category", F.when(F.col("source") == MAPS, F.col("_broad")))).drop("_industry", "_broad")


def planned_jobs(searches: DataFrame, categories: DataFrame, places: DataFrame) -> DataFrame:
    """Jobs of searches (id, industry, region, depth): search_id, source, nth, query, pages, results. A search without
    a region asks for all, region by region; each source takes its first places, as many as its depth allows."""
    everywhere = places.withColumn("region", F.lit(ANY))
    where = places.unionByName(everywhere).select(F.col("region").alias("_region"), "source", "region_ord", "place_ord", "place")
    rows = _wanted(searches, categories, places).where(F.col("category").isNotNull()).withColumn("_region", F.coalesce("region", F.lit(ANY))).join(where, ["_region", "source"])
    nth = F.row_number().over(W.partitionBy("search_id", "source").orderBy("region_ord", "place_ord", "place"))
    query = F.replace(F.replace("wording", F.lit("{c}"), F.col("category")), F.lit("{p}"), F.col("place"))
    return rows.withColumn("nth", nth).where("nth <= most").select("search_id", "source", "nth", query.alias("query"), "pages", "results")


def coverage(searches: DataFrame, jobs: DataFrame, categories: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each search: jobs, the sources that have some, those left out with why (``region``: unknown;
    ``category``: the source has none for the industry; ``place``: it has none in the region), whether the industry
    is known, and a sentence that says so."""
    per = jobs.groupBy("search_id", "source").agg(F.count(F.lit(1)).alias("n"))
    rows = _wanted(searches, categories, places).join(per, ["search_id", "source"], "left")
    why = F.when(F.col("n").isNotNull(), F.lit(None)).when(~F.col("region_known"), "region").when(F.col("category").isNull(), "category").otherwise("place")
    item = F.struct("source_ord", "source", why.alias("why"))
    out = rows.groupBy("search_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("jobs"), F.array_sort(F.collect_list(item)).alias("s"), F.first("industry_known").alias("industry_known"), F.first("depth").alias("depth"))  # at most ten sources
    have = F.transform(F.filter("s", lambda x: x["why"].isNull()), lambda x: x["source"])
    lack = F.transform(F.filter("s", lambda x: x["why"].isNotNull()), lambda x: F.concat(x["source"], F.lit(": "), x["why"]))
    out = out.withColumns({"covered": F.array_join(have, ";"), "left_out": F.array_join(lack, ";")})
    said = F.when(F.col("jobs") == 0, "Nothing to gather").otherwise(F.concat(F.lit("Gathering by "), F.col("jobs").cast("string"), F.lit(" requests, depth "), "depth"))
    more = F.when(F.col("left_out") != "", F.concat(F.lit("; without "), F.col("left_out"))).otherwise("")
    broad = F.when(F.col("industry_known"), "").otherwise("; industry unknown, asked broadly")
    return out.select("search_id", "jobs", "covered", "left_out", "industry_known", F.concat(said, more, broad).alias("note"))


def backoff_seconds(attempt: int, retry_after: str | None = None, most: float = 60.0, now: datetime | None = None) -> float:
    """Wait before a call is tried again (attempt from 0): what the provider asks for, in seconds or as a date, else doubled each time."""
    asked_for = None
    try:
        asked_for = float(retry_after) if retry_after else None
    except ValueError:
        try:
            at = parsedate_to_datetime(retry_after or "")
            asked_for = max(0.0, (at - (now or datetime.now(at.tzinfo))).total_seconds())
        except (TypeError, ValueError):
            pass
    return min(most, asked_for if asked_for is not None and asked_for >= 0 else 2.0**attempt)

