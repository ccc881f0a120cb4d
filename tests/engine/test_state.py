import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from prospectrum.operators import matching, service
from prospectrum.operators.service import LeadsQuery
from prospectrum.state_queries import PARTS, in_parts, leads, searches
from prospectrum.streaming import state

DAY = state.DAY
KIND = "dedupe_key string, seen_us bigint, category string"


def stream_of(spark, folder, *batches):
    for rows in batches:
        later = [(d, None if t is None else t + 100 * DAY, c) for d, t, c in rows]  # not at the epoch, where the first watermark is
        spark.createDataFrame(later, KIND).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def test_keys_expire_and_come_back(spark, tmp_path):
    """a lives on, b ends by its timer, c is revived in one batch and in a later one, d fills a gap; null keys go."""
    folder, out = str(tmp_path / "in"), []
    stream = stream_of(
        spark, folder,
        [("a", 4 * DAY, "late"), ("a", 0, "x"), ("a", 2 * DAY, None), ("b", 0, "y"), ("c", 0, "z"), ("c", 4 * DAY, "w"), ("d", 4 * DAY, ""), (None, 0, "n"), ("e", None, "n")],
        [("a", 6 * DAY, "later"), ("d", 5 * DAY, "filled")],
        [("c", 20 * DAY, "again"), ("a", 8 * DAY, "q")],
        [("f", 21 * DAY, None)],
    )

    def keep(df, number):
        out.extend((number, *r) for r in df.collect())

    state.living_master(stream, ["category"], days=3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    updates = spark.createDataFrame([r[1:] for r in out], "dedupe_key string, first_seen bigint, last_seen bigint, n_seen bigint, category string, over boolean")
    got = {(r.dedupe_key, r.first_seen // DAY - 100): (r.last_seen // DAY - 100, r.n_seen, r.category, r.over) for r in state.latest_lives(updates).collect()}
    assert got[("a", 0)] == (8, 5, "x", True)
    assert got[("b", 0)] == (0, 1, "y", True) and got[("c", 0)] == (0, 1, "z", True) and got[("c", 4)] == (4, 1, "w", True)
    assert got[("c", 20)] == (20, 1, "again", False) and got[("d", 4)] == (5, 2, "filled", True) and got[("f", 21)] == (21, 1, None, False)
    assert len(got) == 7
    # A batch's updates name only its own keys and those whose time is over.
    assert {r[1] for r in out if r[0] == 1} <= {"a", "b", "c", "d"} and {r[1] for r in out if r[0] == 3} <= {"a", "c", "d", "f"}


def test_lives_of_many_keys_take_few_rows_of_state(spark, tmp_path):
    """The state store is asked for slots, not keys; lives are those of a plain loop, odd texts and gaps at the limit included."""
    draw, ttl, rows = random.Random(3), 3 * DAY, []
    for i in range(2400):
        rows.append((f"k{draw.randrange(400)}", draw.randrange(30 * DAY), draw.choice([None, "", "x", "nan", "é"]), draw.choice([None, str(i)])))
    rows += [("edge", 2 * DAY, "", None), ("edge", 5 * DAY, "at", "1"), ("edge", 8 * DAY + 1, None, None)]
    rows.sort(key=lambda r: r[1])
    kind = "dedupe_key string, seen_us bigint, category string, phone string"
    for n in range(0, len(rows), 900):
        spark.createDataFrame([(d, t + 100 * DAY, *x) for d, t, *x in rows[n : n + 900]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.living_master(stream, ["category", "phone"], days=3, slots=8).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress][:3] == [900, 900, 603]
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 8 and p["stateOperators"][0]["numRowsUpdated"] <= 16 for p in query.recentProgress)
    want, now = {}, {}
    for d, t, *x in rows:
        life = now.get(d)
        if life is None or t - life[1] > ttl:
            life = now[d] = [t, t, 0, list(x)]
            want[d, t] = life
        life[1], life[2], life[3] = t, life[2] + 1, [a or b or a for a, b in zip(life[3], x, strict=True)]
    got = state.latest_lives(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")).collect()
    assert len(got) == len(want)
    assert {(r.dedupe_key, r.first_seen - 100 * DAY): [r.last_seen - 100 * DAY, r.n_seen, [r.category, r.phone]] for r in got} == {k: v[1:] for k, v in want.items()}
    assert {(r.dedupe_key, r.first_seen - 100 * DAY) for r in got if r.over} == {k for k, v in want.items() if v is not now[k[0]] or v[1] + ttl < rows[-1][1] - 1000}


def test_parts_follow_each_other_and_are_written_in_parallel(spark, tmp_path):
    rows, seen = spark.range(5000).selectExpr("(id * 7919) % 5000 as at", "cast(id as string) as name"), []
    stream = in_parts(spark, "", rows, "at", "at bigint, name string", lambda _: str(tmp_path / "in"))
    stream.writeStream.foreachBatch(lambda df, n: seen.append(df.agg(F.min("at"), F.max("at"), F.count("at")).first())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == PARTS and sum(r[2] for r in seen) == 5000
    assert all(a[1] < b[0] for a, b in zip(seen[:-1], seen[1:], strict=True))
    assert len(list((tmp_path / "in").glob("part-*"))) > PARTS


SCHEMA = "user_id string, lead_id bigint, n int"


def test_a_replayed_batch_delivers_once(spark, tmp_path):
    path = str(tmp_path / "d")
    write = state.deliver_into(path)
    one = spark.createDataFrame([("u", 1, 0), ("u", 2, 0), ("v", 1, 0), ("u", 1, 0)], SCHEMA)
    two = spark.createDataFrame([("u", 2, 1), ("u", 3, 1)], SCHEMA)
    write(one, 0)
    write(two, 1)
    os.remove(f"{path}/batch-1/_SUCCESS")  # the write broke off: what it left doesn't count
    assert state.deliveries(spark, path, SCHEMA).count() == 3
    write(two, 1)
    write(two, 1)
    write(spark.createDataFrame([("u", 3, 2), ("w", 9, 2)], SCHEMA), 2)
    want = [("u", 1, 0), ("u", 2, 0), ("u", 3, 1), ("v", 1, 0), ("w", 9, 2)]
    assert sorted(map(tuple, state.deliveries(spark, path, SCHEMA).collect())) == want
    assert state.compacted(spark, path, SCHEMA) == 2 and state.batches(spark, path) == [1, 2]
    assert sorted(map(tuple, state.deliveries(spark, path, SCHEMA).collect())) == want
    write(spark.createDataFrame([("u", 1, 3)], SCHEMA), 3)
    assert sorted(map(tuple, state.deliveries(spark, path, SCHEMA).collect())) == want


def test_repeats_within_the_delay_go(spark, tmp_path):
    rows = [("u", 1, "2026-01-01 00:00:00"), ("u", 1, "2026-01-01 00:05:00"), ("u", 2, "2026-01-01 00:06:00")]
    spark.createDataFrame(rows, "user_id string, lead_id bigint, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, lead_id bigint, at timestamp").parquet(str(tmp_path / "in"))
    name = f"t{uuid.uuid4().hex}"
    state.once_within(stream, "at", "1 hour").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, r.lead_id) for r in spark.table(name).collect()) == [("u", 1), ("u", 2)]


@pytest.mark.parametrize("salts", [1, 8])
def test_filters_as_rows_equal_one_plan_each(spark, sf_dir, salts):
    own = leads(spark, sf_dir).withColumn("tags", F.when(F.col("id") % 13 > 0, F.col("tags"))).cache()
    specs = [{}, {"tier": "A"}, {"tag": "t3"}, {"tag": "t3", "region": "r1", "minScore": 10}, {"industry": "i2", "maxScore": 50}, {"hasEmail": True, "search": " TOWN 3"}, {"firmSizeBand": "mid", "source": "clutch"}, {"region": "nowhere"}, {"minScore": 0}, {"tag": ""}, {"hasEmail": False, "search": "  "}]
    rows = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(specs)], "search_id long, filter_json string")
    got = {}
    for r in matching.matched(own, rows, ["id"], ["search_id"], salts).collect():
        got.setdefault(r.search_id, []).append(r.id)
    for i, s in enumerate(specs):
        want = sorted(r.id for r in own.where(service.matches_saved(LeadsQuery.parse(json.dumps(s)))).select("id").collect())
        assert sorted(got.get(i, [])) == want, s


def test_filters_that_cannot_be_read_and_none(spark, sf_dir):
    own = leads(spark, sf_dir)
    odd = spark.createDataFrame([(1, "{broken"), (2, None)], "search_id long, filter_json string")
    assert matching.matched(own, odd, ["id"], ["search_id"]).groupBy("search_id").count().collect()[0]["count"] == own.count()
    assert matching.matched(own, odd.limit(0), ["id"], ["search_id"]).collect() == []


def test_ten_thousand_filters_are_one_equality_join(spark, sf_dir):
    many = searches(spark, sf_dir).select("id", "filter_json", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select((F.col("id") * 7 + F.col("k")).alias("search_id"), "filter_json")
    assert many.count() >= 10_000
    both = matching.matched(leads(spark, sf_dir), many, ["id"], ["search_id"])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") == 1
    assert both.count() > 10_000


def test_counts_of_filters_are_those_of_their_pairs(spark, sf_dir):
    own = leads(spark, sf_dir).withColumn("tags", F.when(F.col("id") % 13 > 0, F.col("tags")))
    specs = [{}, {"tier": "A"}, {"tag": "t3", "region": "r1", "minScore": 10}, {"hasEmail": True, "search": " TOWN 3"}, {"search": "town 3"}, {"search": " "}, {"region": "nowhere"}, {"tag": "t3", "search": "town", "maxScore": 40}]
    rows = spark.createDataFrame([(i, json.dumps(specs[i % len(specs)])) for i in range(40)] + [(40, None), (41, "{broken")], "search_id long, filter_json string")
    want = matching.matched(own, rows, ["id"], ["search_id"]).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id"))
    got = matching.counted(own, rows, "id", ["search_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert matching.counted(own, rows.limit(0), "id", ["search_id"]).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_deliveries_need_only_the_leading_filters(spark, sf_dir):
    own = leads(spark, sf_dir)
    specs = [(1, "u", {"tier": "A", "minScore": 50}), (2, "u", {"tier": "A", "minScore": 50.0}), (3, "u", {"tier": "A", "region": "r1", "minScore": 60}), (4, "u", {"tier": "A", "region": "r1"}), (5, "v", {"search": "TOWN"}),
             (6, "v", {"search": " town 3", "tag": "t3"}), (7, "v", {"search": "x"}), (8, "v", {"hasEmail": True}), (9, "v", {"hasEmail": True, "maxScore": 9}), (10, "v", {}), (11, "v", {"tier": "B"}), (12, None, {"tier": "B"})]
    rows = spark.createDataFrame([(i, u, json.dumps(s)) for i, u, s in specs], "id long, user_id string, filter_json string")
    assert sorted(r.id for r in matching.leading(rows).collect()) == [1, 4, 5, 7, 8, 10, 12]
    pairs = matching.matched(own, rows.withColumnRenamed("id", "saved_search_id"), ["id"], ["saved_search_id", "user_id"]).where("id % 2 = 0").groupBy("user_id", "id").agg(F.min("saved_search_id").alias("s"))
    got = matching.attributed_all(own, own.where("id % 2 = 0"), rows).select("user_id", "lead_id", "saved_search_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, pairs.collect())))
    assert matching.attributed_all(own, own, rows.limit(0)).collect() == []
