import pytest
from pyspark.sql import functions as F

from prospectrum.sources import datasource, directories


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures"))
    rows = [(s, f"2026-01-0{d}", d * 10 + i, f"https://x/{s}/{d}/{i}", f"<li class='firm-wrapper' entity-name='{s} {d}'>") for s in ("clutch", "goodfirms") for d in (1, 2, 3) for i in (0, 1)]
    rows.append(("clutch", "2026-01-03", None, None, None))
    datasource.write_captures(spark.createDataFrame(rows, "source string, day string, ord long, url string, body string").coalesce(1), path)
    return path


def test_read_and_parse(spark, folder):
    df = datasource.captures(spark, folder)
    assert df.count() == 13 and df.where("body is null").count() == 1
    names = directories.goodfirms(df.where("source = 'goodfirms'").select("ord", F.col("body").alias("html"))).select("name").collect()
    assert sorted(r.name for r in names) == ["goodfirms 1", "goodfirms 2", "goodfirms 3"]


@pytest.mark.parametrize(("test", "files", "rows"), [("source = 'clutch' and day >= '2026-01-02'", 2, 5), ("day = '2026-01-01'", 2, 4), ("source in ('goodfirms', 'none')", 3, 6), ("day < '2025-01-01'", 0, 0), ("url like '%/2/%'", 6, 4), ("source = 'clutch' and ord = 10", 3, 1)])
def test_filters_prune_files(spark, folder, test, files, rows):
    df = datasource.captures(spark, folder).where(test)
    assert df.rdd.getNumPartitions() == max(1, files)  # without files Spark plans one empty partition
    assert df.count() == rows


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def add(day):
        datasource.write_captures(spark.createDataFrame([("clutch", day, 1, f"u{day}", "b"), ("pseb", day, 2, f"v{day}", "b")], "source string, day string, ord long, url string, body string").coalesce(1), path)

    def run():
        datasource.register(spark)
        s = spark.readStream.format("captures").option("path", path).option("filesPerTrigger", "1").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime="0 seconds").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    add("2026-01-01")
    assert run() == ["u2026-01-01", "v2026-01-01"]
    add("2026-01-02")
    assert run() == ["u2026-01-01", "u2026-01-02", "v2026-01-01", "v2026-01-02"]


def test_no_files(spark, tmp_path):
    assert datasource.captures(spark, str(tmp_path / "none")).count() == 0
