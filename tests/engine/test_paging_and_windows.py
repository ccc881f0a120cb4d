import datetime as dt

import pytest
from pyspark.sql import functions as F

from prospectrum.operators.paging import Ordered
from prospectrum.operators.service import LeadsQuery, query_leads
from prospectrum.plans import rollups
from prospectrum.state_queries import leads
from prospectrum.streaming import incremental

SCORE = [("score", "desc"), ("score", "asc"), ("scraped_at", "desc")]


@pytest.mark.parametrize(("col", "way"), SCORE)
def test_seek_pages_equal_offset_pages(spark, sf_dir, tmp_path, col, way):
    """Ties and missing scores over several ranges; every page, one beyond the end, with and without a filter."""
    day = F.make_date(F.lit(2026), F.lit(1), (F.col("id") % 28 + 1).cast("int")).cast("timestamp")
    own = leads(spark, sf_dir).withColumns({"scraped_at": F.when(F.col("id") % 4 > 0, day), "deleted_at": F.when(F.col("id") % 10 == 0, "x")})
    table = Ordered(str(tmp_path / "t"), col, way)
    table.write(own, 5)
    stored = spark.read.parquet(table.path)
    assert stored.select("range").distinct().count() > 1
    for spec in ({}, {"region": "r2"}, {"search": "no such thing"}):
        for page in (1, 2, 3, 9):
            q = LeadsQuery(sort_col=col, sort_dir=way, page=page, page_size=40, **spec)
            want, total = query_leads(own, q)
            got, n = table.page(spark, q)
            assert [r.id for r in got.collect()] == [r.id for r in want.collect()] and n == total.first().total


def test_a_page_reads_its_ranges_only(spark, sf_dir, tmp_path):
    table = Ordered(str(tmp_path / "t"))
    table.write(leads(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("string")), 6)
    page, _ = table.page(spark, LeadsQuery(page=3, page_size=10))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan and "rangepartitioning" not in plan
    assert len({r.f for r in page.select(F.lit(1).alias("f")).collect()}) == 1
    with pytest.raises(ValueError, match="another order"):
        table.page(spark, LeadsQuery(sort_dir="asc"))


def at(hours, minutes=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours, minutes=minutes)


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """A late row joins two sessions; a row beyond the watermark is left out; open sessions aren't given."""
    kind = "user_id long, ts timestamp, value double"
    for rows in ([(1, at(1), 1.0), (1, at(1, 50), 1.0), (2, at(1), 5.0), (3, None, 9.0)], [(1, at(1, 25), 1.0), (2, at(2, 10), 5.0)], [(2, at(0, 10), 7.0), (2, at(6), 5.0)], [(9, at(6, 1), 1.0)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    incremental.sessions(stream, "30 minutes", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.user_id, r.start, r.last, r.n, r.value) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(1), at(1, 50), 3, 3.0), (2, at(1), at(1), 1, 5.0), (2, at(2, 10), at(2, 10), 1, 5.0)]


def test_rollups_of_days_add_up(spark):
    rows = [(i % 5, "A" if i % 3 else "B", f"k{i % 3000}", "e" if i % 2 else "", "", None, i % 100 if i % 7 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, tier string, dedupe_key string, email string, phone string, linkedin string, score int")
    whole = rollups.merged(rollups.daily(df, F.col("day"), "tier")).first()
    assert (whole.n, whole.with_email, whole.with_phone, whole.with_email_percent) == (20_000, 10_000, 0, 50)
    assert abs(whole.distinct_keys - 3000) <= 180 and abs(whole.score_50 - 50) <= 3 and abs(whole.score_90 - 90) <= 3
    exact = [r[6] for r in rows if r[6] is not None]
    assert abs(whole.average - sum(exact) / len(exact)) < 1e-9
    some = {r.tier: r.n for r in rollups.merged(rollups.daily(df, F.col("day"), "tier").where("day in (1, 3)"), "tier").collect()}
    assert some == {t: sum(r[0] in (1, 3) and r[1] == t for r in rows) for t in "AB"}
    none = rollups.merged(rollups.daily(df.where("score is null"), F.col("day"))).first()
    assert none.average is None and none.score_50 is None and none.scored == 0
