"""Structured Streaming: crash-safe appends and the incremental master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospectrum.operators import leads


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows as they come, to Parquet files; the checkpoint makes a restart go on without loss or repeats."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def master_versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def read_master(spark: SparkSession, path: str) -> DataFrame | None:
    done = master_versions(spark, path)
    return spark.read.parquet(f"{path}/v={done[-1]}") if done else None


def dropped(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merge_into_master(path: str, keep: int = 3):  # noqa: ANN201
    """A foreachBatch function: merges a batch of leads (with ord and seen_at) into the next version of the master.
    A version is written beside the last and counts when complete, so a batch that is run again changes nothing; the
    last ``keep`` versions stay. An empty batch makes no version. The batch's own time is its greatest seen_at: one
    value, found in the same pass that writes its merged rows beside the master."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = master_versions(spark, path)
        if number + 1 in done:
            return
        staged = f"{path}-batch/{number}"
        last = Observation()
        rows = batch.observe(last, F.max("seen_at").alias("now"))
        leads.merge_duplicates(leads.as_leads(rows)).drop("ord").write.mode("overwrite").parquet(staged)
        if (at := last.get["now"]) is None:
            return
        now, fresh = F.lit(at).cast("timestamp"), spark.read.parquet(staged)
        old = spark.read.parquet(f"{path}/v={done[-1]}") if done else fresh.limit(0)
        merged = leads.merge_master(leads.not_expired(old, now), fresh, now)
        merged.write.mode("overwrite").parquet(f"{path}/v={number + 1}")
        dropped(spark, staged)
        for v in done[: max(0, len(done) + 1 - keep)]:
            dropped(spark, f"{path}/v={v}")

    return run


def _zoned(events: DataFrame) -> tuple[DataFrame, bool]:
    """Events with ts as a time with a zone; whether it had none (UTC then)."""
    bare = dict(events.dtypes)["ts"] == "timestamp_ntz"
    ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp") if bare else F.col("ts")
    return events.withColumn("ts", ts), bare


def _plain(c: Column, bare: bool) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")) if bare else c


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of event types in windows, tumbling or, with a slide, overlapping; rows later than the watermark are left
    out. Times without a zone are taken as UTC and come back without one."""
    own, bare = _zoned(events)
    counted = own.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_plain(F.col("window.start"), bare).alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, last, n, value): each user's stretches of events with no gap of so long or longer between them. In a stream
    a session is given once, when the watermark has passed its end; until then rows that come late join it, also two
    sessions to one. Rows later than the watermark, or without time, are left out."""
    own, bare = _zoned(events)
    found = own.where("ts is not null").withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return found.select("user_id", _plain(F.col("w.start"), bare).alias("start"), _plain(F.col("last"), bare).alias("last"), "n", "value")
