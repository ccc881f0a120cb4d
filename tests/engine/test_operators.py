from datetime import datetime

import pytest
from pyspark.sql import functions as F

from prospectrum.functions import rules
from prospectrum.operators import leads, service
from prospectrum.operators.service import LeadsQuery
from prospectrum.plans import pipeline
from prospectrum.sources import captured
from prospectrum.streaming import incremental

def now():
    return F.lit("2026-02-01 00:00:00").cast("timestamp")


def frame(spark, rows):
    cols = sorted({k for r in rows for k in r})
    kinds = leads.KINDS | {"ord": "long", "seen_at": "timestamp", "status": "string", "id": "long", "dedupe_key": "string", "reviews": "string", "name": "string"}
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in cols))


def test_merge_keeps_first_filled_and_drops_keyless(spark):
    rows = [{"ord": 0, "name": "A", "website": "http://a.com", "email": "", "tags": []}, {"ord": 1, "name": "", "website": "www.a.com/x", "email": "x@a.com", "phone": "1", "tags": ["t"]}, {"ord": 2, "name": "", "website": ""}]
    out = leads.merge_duplicates(leads.as_leads(frame(spark, rows)).repartition(3)).collect()
    assert len(out) == 1 and (out[0].dedupe_key, out[0].company_name, out[0].email, out[0].phone, out[0].tags, out[0].ord) == ("a.com", "A", "x@a.com", "1", [], 0)


def test_score_deltas(spark):
    base = {"ord": 1, "company_name": "Plain", "category": "Shop", "phone": "1", "address": "x", "source": "other", "tag_source": "rules", "tags": []}
    variants = [{}, {"tags": ["ai-ml"]}, {"is_enterprise": True}, {"source": "google_maps"}, {"website": "w"}, {"website": "w", "email": "e@x.com"}, {"tag_source": None, "category": "AI lab"}]
    out = leads.scored(leads.as_leads(frame(spark, [base | v | {"ord": i} for i, v in enumerate(variants)]))).orderBy("ord").collect()
    s = [r.score for r in out]
    assert [s[1] - s[0], s[2] - s[0], s[3] - s[0], s[6] - s[0]] == [5, 3, 5, 5]
    assert s[0] < 22 and s[5] == s[4] + 12 and all(0 <= x <= 100 for x in s)


def test_master_merge_and_expiry(spark):
    day = lambda n: datetime(2026, 1, n)
    old = leads.with_key(leads.as_leads(frame(spark, [{"website": "a.com", "first_seen_at": day(20), "last_seen_at": day(20)}, {"website": "b.com", "first_seen_at": day(1), "last_seen_at": day(1), "email": "b@b.com"}])))
    new = leads.with_key(leads.as_leads(frame(spark, [{"website": "a.com", "email": "a@a.com"}, {"website": "c.com"}])))
    got = {r.dedupe_key: r for r in leads.merge_master(leads.not_expired(old, now()), new, now()).collect()}
    assert set(got) == {"a.com", "c.com"}
    assert got["a.com"].first_seen_at == day(20) and got["a.com"].last_seen_at == datetime(2026, 2, 1) and got["a.com"].email == "a@a.com"
    assert got["c.com"].first_seen_at == datetime(2026, 2, 1)


def test_upsert_keeps_user_columns_and_takes_the_last(spark):
    target = frame(spark, [{"dedupe_key": "a", "score": 1, "status": "won", "id": 7}])
    batch = frame(spark, [{"dedupe_key": "a", "score": 2, "ord": 1}, {"dedupe_key": "a", "score": 3, "ord": 2}, {"dedupe_key": "b", "score": 4, "ord": 3}])
    got = {r.dedupe_key: r for r in leads.upsert(target, batch, now()).collect()}
    assert (got["a"].score, got["a"].status, got["a"].id) == (3, "won", 7) and got["b"].status is None and got["b"].id is not None


def test_web_tags_need_two_hits(spark):
    df = leads.with_key(leads.as_leads(frame(spark, [{"ord": 1, "website": "a.com"}, {"ord": 2, "website": "b.com"}, {"ord": 3, "company_name": "x"}])))
    pages = spark.createDataFrame([("a.com", "Dental clinic"), ("b.com", "one clinic")], "host string, page_text string")
    got = {r.dedupe_key: (r.industry, r.tag_source, r.tag_confidence) for r in leads.tag_from_pages(df, pages).collect()}
    assert got == {"a.com": ("healthcare", "web", 0.5), "b.com": (None, None, None), "x": (None, None, None)}


def test_query_clamps_and_null_order(spark):
    df = spark.range(250).select("id", F.when(F.col("id") > 3, F.col("id").cast("int")).alias("score"), F.lit("A").alias("tier"))
    page, total = service.query_leads(df, LeadsQuery(page=0, page_size=900, sort_dir="asc"))
    assert page.count() == 200 and total.first()["total"] == 250 and page.first()["id"] == 4
    page, _ = service.query_leads(df, LeadsQuery(page=2, page_size=200))
    assert [r.id for r in page.collect()][-4:] == [0, 1, 2, 3]
    assert LeadsQuery.parse('{"minScore": 5, "firmSizeBand": "mid", "odd": 1}') == LeadsQuery(min_score=5, firm_size_band="mid")


def test_answers(spark):
    raw = ['{"primary_industry": "ai-ml", "secondary_services": ["erp-sap", "zzz", "ai-ml"], "confidence": 7, "rationale_short": "' + "r" * 300 + '"}', '```json\n{"primary_industry": "ai-ml"}\n```', 'so {"primary_industry": "nope"} ok', "garbage", None, "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, answer string")
    got = [r.p for r in df.select("i", service.parsed_answer(F.col("answer"), [s for s, _ in rules.TAXONOMY.buckets]).alias("p")).orderBy("i").collect()]
    assert (got[0].industry, got[0].secondary, got[0].confidence, len(got[0].rationale)) == ("ai-ml", ["erp-sap"], 1.0, 200)
    assert got[1].industry == "ai-ml" and got[2].industry is None and got[2] is not None and got[3:] == [None, None, None]


def test_model_calls_keep_errors(spark):
    def call(p):
        if p == "bad":
            raise ValueError("no answer")
        return '{"primary_industry": "healthcare"}'

    df = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    assert {r.prompt: (r.answer is not None, r.error) for r in service.classify_with(df, call, 2).collect()} == {"ok": (True, None), "bad": (False, "no answer")}


def test_status_changes_are_limited(spark):
    df = frame(spark, [{"id": 1, "status": "new"}]).withColumn("updated_at", F.lit(None).cast("timestamp"))
    assert service.set_status(df, 1, now(), status="won").first()["status"] == "won"
    with pytest.raises(ValueError):
        service.set_status(df, 1, now(), score=3)


def test_sources(spark):
    payload = '{"elements": [{"type": "node", "id": 1, "tags": {"name": "A", "amenity": "clinic", "website": "a.com"}}, {"tags": {"amenity": "cafe"}}, {"tags": {"name": "A2", "office": "it", "contact:website": "A.com"}}]}'
    maps = spark.createDataFrame([(0, payload)], "ord long, payload string")
    ld = spark.createDataFrame([(0, "https://d.pk/x", '<script type="application/ld+json">[{"name": "B", "url": "https://www.d.pk/b", "telephone": "1"}]</script>')], "ord long, url string, html string")
    got = captured.gather({"openstreetmap": maps, "businesslist": ld}, now()).orderBy("ord").collect()
    assert [(r.company_name, r.source, r.website) for r in got] == [("A", "openstreetmap", "a.com"), ("B", "businesslist_pk", "")]
    assert captured.gather({"openstreetmap": maps, "businesslist": ld}, now(), only=("businesslist",)).count() == 1
    assert 'area["name"="Lahore"]' in captured.tag_query("Lahore", ['["office"="it"]'])
    html = '<script id="__NEXT_DATA__" type="application/json">{"a": [{"id": "1", "name": "x"}], "b": [{"id": "1", "name": "y"}, {"id": "2", "name": "z"}]}</script>'
    pages = spark.createDataFrame([(0, html)], "ord long, html string")
    assert [(r.id, r.name) for r in captured.embedded_json(pages, ("$.a", "$.b"), "id: string, name: string").orderBy("ord").collect()] == [("1", "x"), ("2", "z")]


def test_csv_round_trip(spark, tmp_path):
    df = frame(spark, [{"company_name": 'A "q", b', "category": "x\ny", "tags": ["a", "b"]}, {"company_name": "", "category": "z"}])
    captured.write_csv(leads.as_leads(df), str(tmp_path / "c"))
    got = captured.read_runs(spark, str(tmp_path / "c")).collect()
    assert [(r.company_name, r.category, r.tags) for r in got] == [('A "q", b', "x\ny", ["a", "b"])]


def test_pipeline_is_deterministic_and_idempotent(spark, sf_dir):
    from prospectrum.queries import flagship, raw_leads

    a, b = flagship(spark, sf_dir).collect(), flagship(spark, sf_dir).collect()
    assert a == b and a and [r.score for r in a] == sorted((r.score for r in a), reverse=True)
    once = leads.merge_duplicates(raw_leads(spark, sf_dir))
    assert leads.merge_duplicates(once.drop("dedupe_key")).count() == once.count()
    assert pipeline.run(raw_leads(spark, sf_dir).limit(0)).collect() == []


def test_streams(spark, tmp_path):
    src, master, ck = (str(tmp_path / x) for x in ("src", "master", "ck"))
    rows = [{"ord": 0, "company_name": "A", "website": "a.com", "seen_at": datetime(2026, 1, 1)}, {"ord": 1, "company_name": "B", "website": "b.com", "seen_at": datetime(2026, 1, 2)}]
    frame(spark, rows).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(frame(spark, rows).schema).parquet(src)

    def go():
        stream().writeStream.foreachBatch(incremental.merge_into_master(master)).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    go()
    frame(spark, [{"ord": 0, "company_name": "A", "website": "a.com", "seen_at": datetime(2026, 1, 20)}]).write.mode("append").parquet(src)
    go()
    got = {r.dedupe_key: (r.first_seen_at, r.last_seen_at) for r in incremental.read_master(spark, master).collect()}
    assert got == {"a.com": (datetime(2026, 1, 2), datetime(2026, 1, 20)), "b.com": (datetime(2026, 1, 2), datetime(2026, 1, 2))}
    merge = incremental.merge_into_master(master)
    merge(frame(spark, rows), 1)  # again: nothing changes
    assert len(incremental.master_versions(spark, master)) == 2
    q = incremental.append_rows(stream(), str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
