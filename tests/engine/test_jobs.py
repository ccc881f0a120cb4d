import sys
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from prospectrum import __main__ as cli
from prospectrum.more_queries import gathered
from prospectrum.operators import leads, searches, service, sync
from prospectrum.plans import maintenance, targeting
from prospectrum.source_queries import pages as source_pages
from prospectrum.sources import captured, directories

def vocabularies(spark):
    categories = [("ai-ml", "google_maps", "ai firms"), ("ai-ml", "clutch", "ai"), ("ai-ml", "goodfirms", "ai"), ("marketing", "clutch", "ads"), ("*", "google_maps", "software firms"), ("*", "clutch", "developers")]
    places = [("europe", 0, "google_maps", p, i) for i, p in enumerate("AB")] + [("europe", 0, "clutch", f"c{i}", i) for i in range(9)] + [("asia", 1, "google_maps", p, i) for i, p in enumerate("CDE")]
    return spark.createDataFrame(categories, "industry string, source string, category string"), spark.createDataFrame(places, "region string, region_ord int, source string, place string, place_ord int")


def test_jobs_of_searches(spark):
    categories, places = vocabularies(spark)
    searches = spark.createDataFrame([(1, "ai-ml", "europe", "quick"), (2, None, None, None), (3, "odd", "moon", "deep"), (4, "marketing", "europe", "deep"), (5, "odd", "europe", "quick")], "id long, industry string, region string, depth string")
    jobs = targeting.planned_jobs(searches, categories, places)
    asked = {}
    for r in sorted(jobs.collect(), key=lambda r: (r.search_id, r.source, r.nth)):
        asked.setdefault((r.search_id, r.source), []).append(r.query)
    assert asked[1, "google_maps"] == ["ai firms in A", "ai firms in B"] and asked[1, "clutch"] == [f"c{i}/ai" for i in range(6)]
    assert asked[2, "google_maps"] == [f"software firms in {x}" for x in "ABCD"] and asked[2, "clutch"] == [f"c{i}/developers" for i in range(6)]
    assert asked[4, "google_maps"] == ["software firms in A", "software firms in B"] and asked[4, "clutch"] == [f"c{i}/ads" for i in range(4)]
    assert asked[5, "clutch"][0] == "c0/developers" and not any(k[0] == 3 for k in asked)
    told = {r.search_id: r for r in targeting.coverage(searches, jobs, categories, places).collect()}
    assert (told[1].jobs, told[1].covered, told[1].left_out) == (8, "google_maps;clutch", "goodfirms: place")
    assert told[3].jobs == 0 and not told[3].industry_known and told[3].left_out.startswith("google_maps: region;clutch: region")
    assert told[3].note.startswith("Nothing to gather; without google_maps: region") and told[3].note.endswith("asked broadly")
    assert "designrush: category" in told[4].left_out and told[5].industry_known is False and told[2].industry_known


def test_backoff():
    assert [targeting.backoff_seconds(i) for i in (0, 3, 9)] == [1, 8, 60] and targeting.backoff_seconds(0, "7") == 7 and targeting.backoff_seconds(1, "soon") == 2
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert targeting.backoff_seconds(0, "Thu, 01 Jan 2026 00:00:30 GMT", now=now) == 30 and targeting.backoff_seconds(0, "Wed, 31 Dec 2025 00:00:00 GMT", now=now) == 0


def lead_rows(spark, rows):
    cols = sorted({k for r in rows for k in r})
    kinds = leads.KINDS | {"ord": "long"}
    return leads.as_leads(spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in cols)))


def test_backfill_keeps_scores(spark):
    df = lead_rows(spark, [{"ord": 1, "website": "a.com", "score": 77, "tier": "A"}, {"ord": 2, "website": "b.com"}, {"ord": 3, "website": "www.b.com/x", "email": "x@b.com"}])
    got = {r.dedupe_key: (r.score, r.tier) for r in maintenance.backfilled(df).collect()}
    assert got["a.com"] == (77, "A") and got["b.com"][0] > 0 and got["b.com"][1] == "D" and len(got) == 2


def test_empty_export_is_refused(spark):
    with pytest.raises(ValueError):
        maintenance.exported(lead_rows(spark, [{"ord": 1, "website": "a.com"}]).limit(0))


def test_second_captures_and_empty_pages(spark):
    pages = spark.createDataFrame([(0, '<article class="co-box"><p class="co-box__name">A</p><a href="/company/a">p</a></article>'), (1, None), (2, "")], "ord long, html string")
    own = spark.createDataFrame([("/company/a", '<a href="https://a.com?x">Visit Website</a>')] * 2, "url string, html string")
    got = captured.gather({"techbehemoths": pages, "techbehemoths_pages": own}, F.lit("2026-01-01").cast("timestamp")).collect()
    assert [(r.company_name, r.website, r.source) for r in got] == [("A", "https://a.com", "techbehemoths")]
    assert captured.gather({"techbehemoths": pages}, F.lit("2026-01-01").cast("timestamp")).collect() == []
    for parse in (directories.clutch, directories.goodfirms, directories.topdevelopers, directories.designrush, directories.selectedfirms, directories.pseb, directories.sortlist):
        assert parse(pages.where("ord > 0")).collect() == []


def test_profile_visits_are_capped_per_page(spark):
    html = "".join(f'<article class="co-box"><p class="co-box__name">N{i}</p><a href="/company/{i}">p</a></article>' for i in range(5))
    pages = spark.createDataFrame([(0, html), (1, html.replace("N", "M"))], "ord long, html string")
    own = spark.createDataFrame([(f"/company/{i}", f'<a href="https://s{i}.com">visit website</a>') for i in range(5)], "url string, html string")
    assert sorted(r.name for r in directories.techbehemoths(pages, own, visits=2).collect()) == ["M0", "M1", "N0", "N1"]


def test_commands(spark, tmp_path):
    lead_rows(spark, [{"ord": 1, "company_name": "Dental clinic", "website": "a.com"}, {"ord": 2, "company_name": "B", "website": "b.com", "industry": "odd", "tag_source": "rules"}]).write.parquet(str(tmp_path / "t"))
    cli.main(["rescore", str(tmp_path / "t"), str(tmp_path / "r")], spark)
    assert {r.tier for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"D"}
    cli.main(["reclassify", str(tmp_path / "t"), str(tmp_path / "c")], spark)
    assert {r.outcome: r.n for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"gained": 1, "cleared": 1}
    cli.main(["reclassify", str(tmp_path / "t"), str(tmp_path / "a"), "--apply"], spark)
    assert {r.dedupe_key: (r.industry, r.tag_source) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {"a.com": ("healthcare", "rules"), "b.com": (None, None)}
    cli.main(["export", str(tmp_path / "t"), str(tmp_path / "csv")], spark)
    assert captured.read_runs(spark, str(tmp_path / "csv")).count() == 2
    cli.main(["clean", str(tmp_path / "t"), str(tmp_path / "k")], spark)
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2


def test_commands_use_the_whole_vocabularies(spark, tmp_path):
    """A bank in Nairobi and a courier in Sydney pass and get their classes; --vocabulary puts others in place."""
    rows = [{"ord": i, "company_name": n, "website": f"x{i}.com", "phone": "+1 555 1", "linkedin": "https://linkedin.com/company/x", "address": a, "rating": "5", "review_count": "500", "source": "businesslist_ng"} for i, (n, a) in enumerate([("First Bank", "Nairobi, Kenya"), ("Fast Courier", "Sydney"), ("Cemetery", "Lagos")])]
    captured.write_csv(lead_rows(spark, rows), str(tmp_path / "in"))
    cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    assert {(r.company_name, r.industry, r.region) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("First Bank", "finance-insurance", "africa"), ("Fast Courier", "logistics-transport", "apac-anz")}
    (tmp_path / "v.json").write_text('{"icp_words": ["cemetery"], "regions": [{"slug": "nigeria", "keywords": ["lagos"]}]}')
    cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "own"), "--vocabulary", str(tmp_path / "v.json")], spark)
    assert [(r.company_name, r.region) for r in spark.read.parquet(str(tmp_path / "own")).collect()] == [("Cemetery", "nigeria")]


def test_sync_counts_every_row_once(spark, tmp_path):
    """A batch that fails for good is in the recovery table, one that fails once is written; the others go on."""
    rows = lead_rows(spark, [{"ord": i, "website": f"s{i}.com", "company_name": f"N{i}", "score": i} for i in range(20)]).withColumn("dedupe_key", F.when(F.col("ord") < 18, F.concat(F.lit("k"), F.col("ord").cast("string"))))
    empty = leads.to_row(rows).withColumns({"id": F.lit(None).cast("long"), "status": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")}).drop("ord").limit(0)
    empty = spark.createDataFrame([], empty.schema)
    store = sync.Store(spark, str(tmp_path / "store"), empty, F.lit("2026-01-01").cast("timestamp"))
    tries, pauses = {}, []

    def write(number, part):
        tries[number] = tries.get(number, 0) + 1
        if number == 1 or (number == 2 and tries[2] < 2):
            raise OSError("no answer")
        store.write(number, part)

    got = sync.sync(rows, write, str(tmp_path / "s1"), 4, (F.col("ord") % 4).cast("int"), sleep=pauses.append)
    assert (got.synced, got.failed, got.keyless) == (13, 5, 2) and tries == {0: 1, 1: 3, 2: 2, 3: 1} and pauses == [2.0, 5.0, 2.0]
    assert sorted(r.ord for r in spark.read.parquet(got.recovery).collect()) == [1, 5, 9, 13, 17]
    stored = store.read(4)
    assert stored.count() == 13 and got.ids(stored).where("id is not null").count() == 13
    again = sync.sync(spark.read.parquet(got.recovery), store.write, str(tmp_path / "s2"), 4, (F.col("ord") % 4).cast("int"))
    assert (again.synced, again.failed, again.recovery) == (5, 0, None) and store.read(4).count() == 18


def test_master_of_repeated_keys(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    old = spark.createDataFrame([("a", "first", "x", 1), ("a", "last", "", 2), (None, "keyless", "", 3), ("b", "B", "", 4)], "dedupe_key string, company_name string, category string, ord int")
    new = spark.createDataFrame([("a", "new", "y", 1), ("a", "", "z", 0), ("c", "", "cat", 1), ("c", "C", "", 2), (None, "gone", "", 3)], "dedupe_key string, company_name string, category string, ord int")
    got = {r.dedupe_key: (r.company_name, r.category) for r in leads.merge_master(old, new, now).collect()}
    assert got == {"a": ("last", "z"), "b": ("B", ""), "c": ("C", "cat")}
    up = leads.upsert(old.where("dedupe_key = 'b'").drop("ord"), new.drop("ord"), now).collect()
    assert sorted(r.dedupe_key for r in up) == ["a", "b", "c"]


def test_saved_search_requests(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    own = spark.createDataFrame([(3, "u1", "old", "{}", "daily", True, "deep", None, None), (4, "u2", "theirs", "{}", "off", True, "quick", None, None)], "id long, user_id string, name string, filter_json string, schedule string, is_active boolean, depth string, created_at timestamp, last_run_at timestamp")
    asked = spark.createDataFrame([(1, "u1", " new ", '{"tier": "A", "minScore": 50, "hasEmail": true}'), (2, "u1", "  ", "{}"), (3, "u1", "n", '{"tier": 5}'), (4, "u1", "x" * 121, "{}"), (5, "u2", "n", "[]"), (6, "u2", "ok", '{"sortDir": "up"}'), (7, "u2", "z", '{"minScore": "9"}')], "request_id long, user_id string, name string, filter_json string")
    table, judged = searches.created(own, asked, now)
    assert {r.request_id: r.problem for r in judged.collect()} == {1: None, 2: "a name is needed", 3: "filter has an odd tier", 4: "the name is too long", 5: "filter is no JSON object", 6: "filter has an odd sortDir", 7: "filter has an odd minScore"}
    assert [(r.id, r.name) for r in searches.listed(table, "u1").collect()] == [(5, "new"), (3, "old")]
    change = spark.createDataFrame([(1, 3, "u1", " better ", None), (2, 4, "u1", "stolen", False), (3, 3, "u1", None, False)], "request_id long, id long, user_id string, name string, is_active boolean")
    assert {(r.id, r.name, r.is_active) for r in searches.changed(own, change).collect()} == {(3, "old", False), (4, "theirs", True)}
    assert [r.id for r in searches.deleted(own, change.select("id", "user_id")).collect()] == [4]
    runs = spark.createDataFrame([(8, 4, "u2", "running")], "id long, saved_search_id long, user_id string, status string").withColumns({c: F.lit(None).cast(k) for c, k in (("created_at", "timestamp"), ("finished_at", "timestamp"), ("error", "string"), ("depth", "string"))})
    ask = spark.createDataFrame([(1, 3, "u1", "odd"), (2, 3, "u1", "quick"), (3, 4, "u1", None), (4, 4, "u2", None), (5, 9, "u1", None)], "request_id long, saved_search_id long, user_id string, depth string")
    after, answers = searches.queued(runs, own, ask, now)
    assert {r.request_id: (r.answer, r.run_id) for r in answers.collect()} == {1: (202, None), 2: (409, None), 3: (404, None), 4: (409, 8), 5: (404, None)}
    assert {(r.id, r.saved_search_id, r.status, r.depth) for r in after.collect()} == {(8, 4, "running", None), (9, 3, "pending", "deep")}
    assert {(r.id, r.status, r.error) for r in searches.not_started(after, after.where("id = 9").select("id"), now, "no worker").collect()} == {(8, "running", None), (9, "failed", "no worker")}


def test_a_source_that_fails_is_left_out(spark):
    pages = spark.createDataFrame([(0, '{"login": "l", "name": "Org", "blog": "org.com"}')], "ord long, payload string")
    failed = {}
    got = captured.gather({"github_orgs": pages, "clutch": pages}, F.lit("2026-01-01").cast("timestamp"), failed=failed)
    assert [r.company_name for r in got.collect()] == ["Org"] and list(failed) == ["clutch"]
    assert captured.gather({}, F.current_timestamp()).collect() == [] and captured.gather({"clutch": pages}, F.current_timestamp(), only=("pseb",)).collect() == []


def test_a_firm_that_a_page_shows_twice_is_gathered_once(spark, sf_dir):
    page = source_pages(spark, sf_dir, "clutch", other="")
    assert {r.html.count('class="provider row"') for r in page.collect()} == {2}
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert {r.source: r["count"] for r in gathered(spark, sf_dir).groupBy("source").count().collect()} == dict.fromkeys(("google_maps", "github_orgs", "clutch", "goodfirms"), n)


def test_readers_of_files(spark, tmp_path):
    for name, rows in (("leads-2026-01-02.csv", [{"ord": 0, "company_name": "B", "tags": ["x", "y"]}, {"ord": 1, "company_name": ""}]), ("leads-2026-01-01.csv", [{"ord": 0, "company_name": "A\nline"}, {"ord": 1, "company_name": "C"}])):
        captured.write_csv(lead_rows(spark, rows).coalesce(1), str(tmp_path / "d" / name))
    got = captured.read_runs(spark, str(tmp_path / "d" / "*"))
    assert [(r.company_name, r.tags) for r in got.orderBy("ord").collect()] == [("A\nline", None), ("C", None), ("B", ["x", "y"])]
    both = captured.read_recovered(spark, [str(tmp_path / "d/leads-2026-01-02.csv"), str(tmp_path / "none"), str(tmp_path / "d/leads-2026-01-01.csv")])
    assert [r.company_name for r in both.orderBy("ord").collect()] == ["B", "A\nline", "C"]
    (tmp_path / "master.json").write_text('[{"name": "A", "reviews": "5", "tags": ["t"], "score": 7}, {"company_name": "B"}]')
    (tmp_path / "broken.json").write_text("{not json")
    assert [(r.company_name, r.review_count, r.tags, r.score) for r in captured.read_master(spark, str(tmp_path / "master.json")).orderBy("ord").collect()] == [("A", "5", ["t"], 7), ("B", None, None, None)]
    assert captured.read_master(spark, str(tmp_path / "broken.json")).collect() == [] == captured.read_master(spark, str(tmp_path / "absent.json")).collect()


def test_contacts_of_many_and_deep_pages(spark):
    rows = [("h", "", '<a href="mailto:name@h.com">x</a> img@2x.png Info@H.com %20sales@h.com <footer><a href="/team-page">t</a><a href="/about/">a</a></footer>'), ("h", "/contact", "third@h.com fourth@h.com"), ("h", "/team-page", '<a href="https://www.linkedin.com/company/h?x=1">l</a> late@h.com'), ("h", "/blog", "blog@h.com"), ("g", "/about", "a@yourdomain.com b@g.css user@g.com no-reply@g.com")]
    pages = spark.createDataFrame(rows, "host string, path string, html string")
    bulk = {r.host: r for r in captured.contacts(captured.in_path_order(pages)).collect()}
    assert bulk["h"].emails == ["info@h.com", "sales@h.com", "third@h.com"] and bulk["h"].linkedin is None and bulk["g"].emails == ["no-reply@g.com"]
    deep = captured.in_path_order(pages, deep=True)
    assert {(r.host, r.path): r.path_ord for r in deep.collect()} == {("h", ""): 1, ("h", "/contact"): 2, ("g", "/about"): 3, ("h", "/team-page"): 9}
    assert {r.host: r.linkedin for r in captured.contacts(deep).collect()}["h"] == "https://www.linkedin.com/company/h"


def test_model_calls_take_turns_and_are_retried(spark):
    def bad(prompt):
        raise OSError("busy")

    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    got = service.classify_with(df, [bad, lambda p: p.upper()], attempts=4, pauses=(0.0,)).collect()
    assert sorted((r.prompt, r.answer, r.error) for r in got) == [("a", "A", None), ("b", "B", None)]
    assert [r.error for r in service.classify_with(df, bad, attempts=2, pauses=(0.0,)).collect()] == ["busy", "busy"]


def test_commands_on_demand(spark, tmp_path):
    """One site, a list of names that is taken up again, a pass of model answers and the saved searches."""
    at = lambda n: str(tmp_path / n)
    html = '<a href="mailto:info@clinic.com">m</a><a href="https://www.linkedin.com/company/clinic">l</a>'
    spark.createDataFrame([("clinic.com", "", html), ("softwarehouse.com", "/about", html.replace("clinic", "softwarehouse"))], "host string, path string, html string").write.parquet(at("caps/pages"))
    spark.createDataFrame([("Software House", "https://softwarehouse.com"), ("Nobody", "")], "name string, website string").write.parquet(at("caps/resolved"))
    cli.main(["url", "www.clinic.com", at("caps/pages"), at("one")], spark)
    assert [(r.company_name, r.email, r.source) for r in spark.read.parquet(at("one")).collect()] == [("clinic", "info@clinic.com", "on_demand_url")]
    (tmp_path / "names.txt").write_text("Software House\n\nNobody\nsoftware house\n")
    for _ in range(2):
        cli.main(["firms", at("names.txt"), at("caps"), at("firms")], spark)
    assert [(r.company_name, r.email) for r in spark.read.parquet(at("firms")).collect()] == [("Software House", "info@softwarehouse.com")]

    stored = lead_rows(spark, [{"ord": 1, "company_name": "A", "email": "a@a.com", "score": 80, "industry": "healthcare", "tag_source": "rules", "tag_confidence": 0.9}, {"ord": 2, "company_name": "B", "score": 10}])
    stored = stored.withColumns({"dedupe_key": F.lower("company_name"), "id": F.col("ord"), "llm_model": F.lit(None).cast("string"), "classified_at": F.lit(None).cast("timestamp")})
    stored.write.parquet(at("db/leads"))
    spark.createDataFrame([("a", '{"primary_industry": "ai-ml", "confidence": 1}'), ("b", '{"primary_industry": "ai-ml", "confidence": 0.8}')], "dedupe_key string, answer string").write.parquet(at("answers"))
    cli.main(["classify", at("db/leads"), at("answers"), at("m1")], spark)
    assert {r.dedupe_key: (r.industry, r.tag_source) for r in spark.read.parquet(at("m1")).collect()} == {"a": ("healthcare", "rules"), "b": ("ai-ml", "llm")}
    cli.main(["classify", at("db/leads"), at("answers"), at("m2"), "--force", "--dry-run"], spark)
    assert {(r.dedupe_key, r.industry, r.confidence) for r in spark.read.parquet(at("m2")).collect()} == {("a", "ai-ml", 1.0), ("b", "ai-ml", 0.8)}

    spark.createDataFrame([(1, "u1", '{"hasEmail": true}', "daily", True, "quick", None, None, None), (2, "u2", "{}", "off", True, "quick", None, None, None)], "id long, user_id string, filter_json string, schedule string, is_active boolean, depth string, last_run_at timestamp, industry string, region string").write.parquet(at("db/searches"))
    spark.createDataFrame([(5, 2, "done", None), (6, 9, "pending", None)], "id long, saved_search_id long, status string, created_at timestamp").withColumns({c: F.lit(None).cast(k) for c, k in (("started_at", "timestamp"), ("finished_at", "timestamp"), ("error", "string"), ("leads_found", "long"), ("user_id", "string"), ("depth", "string"))}).write.parquet(at("db/runs"))
    cli.main(["saved-searches", at("db"), at("next")], spark)
    assert [(r.user_id, r.lead_id, r.saved_search_id, r.scrape_run_id) for r in spark.read.parquet(at("next/user_leads")).collect()] == [("u1", 1, 1, 7)]
    assert {(r.id, r.status, r.leads_found) for r in spark.read.parquet(at("next/runs")).collect()} == {(5, "done", None), (6, "failed", None), (7, "done", 1)}


def test_a_program_on_the_executors(spark):
    import sys

    df = spark.createDataFrame([("a\nb",), (None,), ("c",)], "html string").coalesce(1)
    shout = [sys.executable, "-c", "import sys, json\nfor x in sys.stdin: print(json.dumps((json.loads(x) or '').upper()))"]
    assert [r.text for r in service.through_process(df, shout, "html", "text").collect()] == ["A\nB", "", "C"]
    assert [r.text for r in service.through_process(df, [sys.executable, "-c", "print(1)"], "html", "text").collect()] == [None] * 3


def test_drift_and_migration(spark, tmp_path):
    (tmp_path / "same.json").write_text("{}")
    cli.main(["drift", str(tmp_path / "same.json")], spark)
    (tmp_path / "other.json").write_text('{"icp_words": ["x"], "regions": []}')
    with pytest.raises(SystemExit) as e:
        cli.main(["drift", str(tmp_path / "other.json")], spark)
    assert "region europe" in str(e.value) and "icp word x" in str(e.value)
    old = spark.createDataFrame([("A Ltd", "5", "kept")], "company_name string, score string, extra string")
    once = maintenance.migrated(old)
    assert [(r.dedupe_key, r.score, r.status, r.extra) for r in once.collect()] == [("a", 5, "new", "kept")]
    assert maintenance.migrated(once).collect() == once.collect()


def test_a_source_that_breaks_while_it_runs_is_left_out(spark, tmp_path):
    """One can't be read, one fails in its rows; the third's rows come through, and the command says what is missing."""
    good = spark.createDataFrame([(1, '[{"name": "Acme Software", "website": "https://acme.example", "phone": "+1"}]')], "ord long, payload string")
    broken = spark.range(3).select(F.col("id").alias("ord"), F.when(F.col("id") == 2, F.raise_error(F.lit("torn capture"))).otherwise("{}").alias("payload"))

    def absent():
        return spark.read.parquet(str(tmp_path / "nowhere"))

    rows, failed = captured.gather_into({"google_maps": good, "github_orgs": broken, "clutch": absent}, F.current_timestamp(), str(tmp_path / "g"))
    assert [r.company_name for r in rows.collect()] == ["Acme Software"]
    assert set(failed) == {"github_orgs", "clutch"} and "torn capture" in failed["github_orgs"]
    none, failed = captured.gather_into({"clutch": absent}, F.current_timestamp(), str(tmp_path / "h"))
    assert none.collect() == [] and set(failed) == {"clutch"} and "company_name" in none.columns


def test_one_bad_line_costs_one_row(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, html string").coalesce(1)
    odd = "import sys, json\nfor n, line in enumerate(sys.stdin):\n    print('not json' if n == 1 else '{}' if n == 2 else json.dumps(json.loads(line).upper()))\n    if n == 3: break"
    got = [r.text for r in service.through_process(df, [sys.executable, "-c", odd], "html", "text").orderBy("i").collect()]
    assert got == ["T0", None, None, "T3", None]


def test_a_cut_off_master_counts_as_empty(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"name": "A"}, {"name": "B"')
    assert captured.read_master(spark, str(tmp_path / "cut.json")).collect() == []


def test_default_targets(spark):
    categories, places = targeting.defaults(spark)
    s = spark.createDataFrame([(1, "ai-ml", "europe", "quick"), (2, "digital-marketing", "africa", "deep"), (3, None, None, "quick"), (4, "cloud-devops", "europe", "deep")], "id long, industry string, region string, depth string")
    jobs = {}
    for r in targeting.planned_jobs(s, categories, places).orderBy("search_id", "source", "nth").collect():
        jobs.setdefault((r.search_id, r.source), []).append(r["query"])
    assert jobs[(1, "google_maps")] == [f"AI companies in {c}" for c in ("London", "Berlin", "Amsterdam", "Warsaw")]
    assert jobs[(1, "clutch")] == [f"{c}/developers" for c in ("gb", "de", "nl", "tr")]
    assert (2, "goodfirms") not in jobs and jobs[(2, "designrush")] == [f"digital-marketing/{c}" for c in ("NG", "ZA", "EG")]
    assert jobs[(3, "google_maps")] == [f"software companies in {c}" for c in ("Dubai", "Abu Dhabi", "Riyadh", "Doha")]
    assert (4, "selectedfirms") not in jobs and jobs[(4, "techbehemoths")] == ["it-services/united-kingdom"]


def test_a_pace_that_workers_share(spark):
    """Two workers at one call a tenth of a second: a worker's own calls are two tenths apart."""
    import time

    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "i int, prompt string").repartition(6)
    out = service.classify_with(df, lambda p: str(time.time()), least_gap=0.1, workers=2)
    assert out.rdd.getNumPartitions() == 2
    at = sorted(float(r.answer) for r in out.collect())
    assert len(at) == 6 and all(b - a >= 0.19 for a, b in zip(at[:-2], at[2:], strict=True))


def test_an_empty_export_leaves_the_old_one(spark, tmp_path):
    rows = lead_rows(spark, [{"ord": 1, "company_name": "A", "website": "a.com"}, {"ord": 2, "company_name": "B", "website": "b.com"}])
    at = str(tmp_path / "out")
    assert captured.replace_csv(rows, at) == 2 and captured.replace_csv(rows.where("ord = 2"), at) == 1
    with pytest.raises(ValueError, match="nothing"):
        captured.replace_csv(rows.limit(0), at)
    assert [r.company_name for r in captured.read_runs(spark, at).collect()] == ["B"]
    assert not (tmp_path / "out.new").exists()
