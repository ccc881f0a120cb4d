"""Queries, dashboard figures, saved searches and deliveries, and model classifications on stored leads."""

from __future__ import annotations

import itertools
import json
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.functions.text import clean_email, clean_phone, clean_url, present

DEFAULT_PAGE, LARGEST_PAGE = 50, 200
RUNS_A_CALL, GROUPS_A_CALL, BACKFILL = 10, 5, 200
EXPORTED = ["company_name", "category", "website", "email", "all_emails", "phone", "address", "linkedin", "facebook", "instagram", "rating", "review_count", "company_size", "source", "industry", "region", "firm_size_band", "score", "tier", "scraped_at"]


@dataclass(frozen=True)
class LeadsQuery:
    tier: str | None = None
    source: str | None = None
    industry: str | None = None
    tag: str | None = None
    region: str | None = None
    firm_size_band: str | None = None
    min_score: float | None = None
    max_score: float | None = None
    has_email: bool = False
    search: str | None = None
    sort_col: str = "score"
    sort_dir: str = "desc"
    page: int = 1
    page_size: int = DEFAULT_PAGE

    @staticmethod
    def parse(filter_json: str) -> LeadsQuery:
        """From a stored filter; its keys are in camel case, unknown ones are ignored."""
        snake = {"".join("_" + c.lower() if c.isupper() else c for c in k): v for k, v in json.loads(filter_json or "{}").items()}
        return LeadsQuery(**{f.name: snake[f.name] for f in fields(LeadsQuery) if snake.get(f.name) is not None})


#: The user interface's named filters.
PRESETS = {
    "hot": LeadsQuery(tier="A", has_email=True),
    "warm": LeadsQuery(tier="B", has_email=True),
    "reachable": LeadsQuery(has_email=True),
    "top_scores": LeadsQuery(min_score=75),
    "enterprise": LeadsQuery(firm_size_band="enterprise"),
    "newest": LeadsQuery(sort_col="scraped_at"),
    "ai": LeadsQuery(tag="ai-ml"),
    "low": LeadsQuery(max_score=34),
}


def _equal(q: LeadsQuery) -> Column:
    out = F.lit(True)
    for name in ("tier", "source", "industry", "region", "firm_size_band"):
        if (v := getattr(q, name)) is not None:
            out = out & (F.col(name) == v)
    if q.tag:
        out = out & F.array_contains("tags", q.tag)
    if q.has_email:
        out = out & present(F.col("email"))
    return out


def matches(q: LeadsQuery) -> Column:
    """The stored table's predicate: a missing score fails any bound; text is sought in four columns."""
    out = _equal(q)
    if q.min_score is not None:
        out = out & (F.col("score") >= q.min_score)
    if q.max_score is not None:
        out = out & (F.col("score") <= q.max_score)
    if q.search and q.search.strip():
        s = q.search.strip().lower()
        anywhere = F.lit(False)
        for c in ("company_name", "email", "address", "category"):
            anywhere = anywhere | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(s)), F.lit(False))
        out = out & anywhere
    return out


def matches_saved(q: LeadsQuery) -> Column:
    """A saved search's predicate after a run: a missing score is 0; text is sought in one string of all columns."""
    score = F.coalesce("score", F.lit(0))
    out = _equal(q)
    if q.min_score is not None:
        out = out & (score >= q.min_score)
    if q.max_score is not None:
        out = out & (score <= q.max_score)
    if q.search and q.search.strip():
        hay = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("company_name", "email", "address", "category", "search_query"))))
        out = out & F.contains(hay, F.lit(q.search.strip().lower()))
    return out


def ordered(df: DataFrame, q: LeadsQuery, tiebreak: str = "id") -> DataFrame:
    c = F.col("scraped_at" if q.sort_col == "scraped_at" else "score")
    return df.orderBy(c.asc_nulls_last() if q.sort_dir == "asc" else c.desc_nulls_last(), tiebreak)


def visible(df: DataFrame) -> Column:
    """Rows that no user has deleted; all where the table has no such column."""
    return F.col("deleted_at").isNull() if "deleted_at" in df.columns else F.lit(True)


def query_leads(df: DataFrame, q: LeadsQuery, tiebreak: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the page, a one-row table with the exact total) of visible rows."""
    own = df.where(visible(df) & matches(q))
    size = min(LARGEST_PAGE, max(1, q.page_size))
    return ordered(own, q, tiebreak).offset((max(1, q.page) - 1) * size).limit(size), own.agg(F.count(F.lit(1)).alias("total"))


def export_leads(df: DataFrame, q: LeadsQuery, tiebreak: str = "id") -> DataFrame:
    return ordered(df.where(visible(df) & matches(q)), q, tiebreak).select(*EXPORTED)


def facet(df: DataFrame, column: str = "source") -> DataFrame:
    return df.where(visible(df) & F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def totals(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    out = [n.alias("total"), F.floor(F.coalesce(F.avg("score"), F.lit(0)) + 0.5).cast("long").alias("avg_score"), F.max("scraped_at").alias("latest_run")]
    for c in ("email", "phone", "linkedin"):
        own = F.count_if(present(F.col(c)))
        out += [own.alias(f"with_{c}"), F.when(n > 0, F.floor(100 * own / n + 0.5)).otherwise(0).cast("long").alias(f"{c}_percent")]
    return df.agg(*out)


def counts_by(df: DataFrame, column: str, unknown: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def score_histogram(df: DataFrame) -> DataFrame:
    """Ten buckets, empty ones too; 100 falls into the last."""
    bucket = F.least(F.lit(9), F.floor(F.coalesce("score", F.lit(0)) / 10)).cast("long")
    got = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(10).withColumnRenamed("id", "bucket").join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_scores(df: DataFrame, n: int = 10, tiebreak: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last("score"), tiebreak).limit(n)


def reclassification(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """What a new rules pass would change: counts of protected (not from rules), cleared, gained, changed and unchanged rows."""
    b, a = before.select(key, F.col("industry").alias("old"), "tag_source"), after.select(key, F.col("industry").alias("new"))
    kept = F.coalesce(F.col("tag_source").isin("web", "llm"), F.lit(False))
    same = F.col("old").eqNullSafe(F.col("new"))
    kind = F.when(kept, "protected").when(same, "unchanged").when(F.col("new").isNull(), "cleared").when(F.col("old").isNull(), "gained").otherwise("changed")
    return b.join(a, key).groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Saved searches and deliveries.


def signature() -> Column:
    """Searches that would gather the same: any industry, all regions and a quick look where none is named."""
    named = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    return F.concat_ws("|", named("industry", "any"), named("region", "all"), F.when(F.col("depth") == "deep", "deep").otherwise("quick"))


def signature_groups(searches: DataFrame) -> DataFrame:
    """(signature, n, first): the searches that one run can serve."""
    return searches.groupBy(signature().alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def due(now: Column) -> Column:
    """Active, scheduled, and not run within the schedule's day or week."""
    last = F.col("last_run_at")
    return F.col("is_active") & F.when(F.col("schedule") == "daily", last.isNull() | (last <= now - F.expr("interval 1 day"))).when(F.col("schedule") == "weekly", last.isNull() | (last <= now - F.expr("interval 7 days"))).otherwise(F.lit(False))


def claim(runs: DataFrame, searches: DataFrame, now: Column, most: int = RUNS_A_CALL, groups: int = GROUPS_A_CALL) -> DataFrame:
    """The run table after a worker's claim: the oldest pending runs are running; those whose search is gone
    failed; those beyond the first groups of equal signature are pending again."""
    picked = runs.where("status = 'pending'").orderBy("created_at", "id").limit(most)
    held = picked.join(searches.select(F.col("id").alias("saved_search_id"), signature().alias("signature")), "saved_search_id", "left")
    first = held.where("signature is not null").groupBy("signature").agg(F.min(F.struct("created_at", "id")).alias("first")).orderBy("first").limit(groups).select("signature", F.lit(True).alias("mine"))
    state = held.join(first, "signature", "left").select("id", F.when(F.col("signature").isNull(), "failed").when(F.col("mine"), "running").otherwise("pending").alias("_status"))
    out = runs.join(state, "id", "left")
    return out.withColumns({
        "status": F.coalesce("_status", "status"), "started_at": F.when(F.col("_status") == "running", now).otherwise(F.col("started_at")),
        "finished_at": F.when(F.col("_status") == "failed", now).otherwise(F.col("finished_at")), "error": F.when(F.col("_status") == "failed", "its search was deleted").otherwise(F.col("error")),
    }).drop("_status")


def finish(runs: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Running runs with a row in found (id, leads_found) are done."""
    out = runs.join(found.select("id", F.col("leads_found").alias("_found")), "id", "left")
    done = F.col("_found").isNotNull() & (F.col("status") == "running")
    return out.withColumns({"leads_found": F.when(done, F.col("_found")).otherwise(F.col("leads_found")), "finished_at": F.when(done, now).otherwise(F.col("finished_at")), "status": F.when(done, "done").otherwise(F.col("status"))}).drop("_found")


def attributed(leads: DataFrame, stored: DataFrame, q: LeadsQuery, user_id: str, search_id: int, run_id: int | None, reason: str = "fresh") -> DataFrame:
    """Deliveries of a run: its matching leads that are stored, each once."""
    own = leads.where(matches_saved(q)).select("dedupe_key").where("dedupe_key is not null").distinct()
    got = own.join(stored.select("dedupe_key", F.col("id").alias("lead_id")), "dedupe_key")
    return got.select(F.lit(user_id).alias("user_id"), "lead_id", F.lit(search_id).cast("long").alias("saved_search_id"), F.lit(run_id).cast("long").alias("scrape_run_id"), F.lit(reason).alias("delivery_reason"))


def new_deliveries(delivered: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose (user_id, lead_id) isn't delivered yet: what an insert that ignores conflicts adds."""
    return rows.dropDuplicates(["user_id", "lead_id"]).join(delivered.select("user_id", "lead_id"), ["user_id", "lead_id"], "left_anti")


def backfill(stored: DataFrame, q: LeadsQuery, most: int = BACKFILL) -> DataFrame:
    return top_scores(stored.where(matches(q)), most)


def my_leads(delivered: DataFrame, stored: DataFrame, user_id: str, page: int = 1, size: int = 100) -> DataFrame:
    own = delivered.where(F.col("user_id") == user_id).join(stored.where("deleted_at is null").withColumnRenamed("id", "lead_id"), "lead_id")
    return own.orderBy(F.desc("first_delivered_at"), "lead_id").offset((max(1, page) - 1) * size).limit(size)


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest n (1 to 20) runs of each search."""
    rank = F.row_number().over(W.partitionBy("saved_search_id").orderBy(F.desc("created_at"), F.desc("id")))
    return runs.withColumn("nth", rank).where(F.col("nth") <= min(20, max(1, n)))


def set_status(stored: DataFrame, lead_id: int, now: Column, **changes: object) -> DataFrame:
    """Only status and deleted_at may be changed by a user."""
    if odd := set(changes) - {"status", "deleted_at"}:
        raise ValueError(f"not changeable: {sorted(odd)}")
    own = F.col("id") == lead_id
    return stored.withColumns({c: F.when(own, F.lit(v).cast(dict(stored.dtypes)[c])).otherwise(F.col(c)) for c, v in changes.items()} | {"updated_at": F.when(own, now).otherwise(F.col("updated_at"))})


# Classification by a model.

ANSWER = "primary_industry string, secondary_services array<string>, confidence double, rationale_short string"


def parsed_answer(raw: Column, allowed: list[str]) -> Column:
    """struct<industry, secondary, confidence, rationale> of a model's answer: fences and chatter around the JSON are
    cut off, unknown slugs dropped, the confidence clamped; null where there is no JSON with an industry."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(raw))
    direct = F.from_json(body, ANSWER)
    sliced = F.from_json(F.regexp_extract(body, r"(?s)\{.*\}", 0), ANSWER)
    a = F.when(direct["primary_industry"].isNotNull(), direct).otherwise(sliced)
    slugs = F.array(*map(F.lit, allowed))
    industry = F.when(F.array_contains(slugs, a["primary_industry"]), a["primary_industry"])
    second = F.filter(F.coalesce(a["secondary_services"], F.array().cast("array<string>")), lambda s: F.array_contains(slugs, s) & ~s.eqNullSafe(industry))
    out = F.struct(industry.alias("industry"), second.alias("secondary"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"], F.lit(0.0)))).alias("confidence"), F.substring(F.coalesce(a["rationale_short"], F.lit("")), 1, 200).alias("rationale"))
    return F.when(F.coalesce(a["primary_industry"], F.lit("")) != "", out)


# Fixed value: the fields of a contact answer.
CONTACT_ANSWER = "email string, phone string, linkedin string, facebook string, instagram string"


def contact_answers(answers: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """(key, email, phone, linkedin, facebook, instagram) of a model's answers (key, answer) about a page: fences and
    chatter around the JSON are cut off, values cleaned, and those that are none ('' or no address) are null. An answer that
    can't be read gives no row; plans.maintenance.filled puts the rest where a lead has gaps."""
    fenced = F.regexp_extract("answer", r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(F.col("answer")), r"(?s)\{.*\}", 0)
    parsed = answers.select(key, F.from_json(body, CONTACT_ANSWER, {"mode": "PERMISSIVE"}).alias("c")).where(F.col("c").isNotNull())
    fields = {"email": clean_email(F.col("c.email")), "phone": clean_phone(F.col("c.phone"))} | {n: clean_url(F.col(f"c.{n}")) for n in ("linkedin", "facebook", "instagram")}
    out = parsed.select(key, *(F.nullif(e, F.lit("")).alias(n) for n, e in fields.items()))
    return out.where(F.coalesce(*fields.keys()).isNotNull())


def needs_classification(model: str, threshold: float = 0.65, force: bool = False) -> Column:
    coarse = F.col("tag_source").isNull() | F.col("industry").isNull() | (F.col("tag_source") == "llm") | (F.col("tag_confidence") < threshold)
    fine = F.when(F.col("tag_source").isNull() | F.col("industry").isNull(), True).when(F.col("tag_source") == "llm", ~F.col("llm_model").eqNullSafe(F.lit(model))).otherwise(F.coalesce("tag_confidence", F.lit(0.0)) < threshold)
    return F.lit(True) if force else F.coalesce(coarse, F.lit(False)) & fine


def prompt(page_text: str = "page_text") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Company: "), "company_name"), F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Website: "), "website"), F.concat(F.lit("Text: "), F.substring(F.col(page_text), 1, 2800)))


# Attempts of a call, the pauses between them in seconds, and calls at a time in a worker.
ATTEMPTS, PAUSES, AT_A_TIME = 3, (2.0, 5.0), 4


def with_retry(call: Callable, attempts: int = ATTEMPTS, pauses: tuple[float, ...] = PAUSES, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """What call gives, tried again after a pause; the last error where none succeeds."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # the provider's own
            if i == attempts - 1:
                raise
            sleep(pauses[min(i, len(pauses) - 1)])


def classify_with(df: DataFrame, calls: Callable[[str], str] | list[Callable[[str], str]], attempts: int = ATTEMPTS, pauses: tuple[float, ...] = PAUSES, least_gap: float = 0.0, workers: int | None = None) -> DataFrame:
    """Adds answer and error to rows with a prompt. Calls run on the executors, AT_A_TIME at once in a worker and
    least_gap seconds apart; several calls (one for each key) take turns, and a call that fails is tried again with
    the next. A row for which all attempts fail keeps the last error. With workers the gap is kept by all of them together:
    there are so many tasks at most, and each waits its share of turns, so no clock has to be shared."""
    if workers is not None:
        df, least_gap = df.coalesce(workers), least_gap * workers
    turns = calls if isinstance(calls, list) else [calls]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, lock, last = itertools.count(), threading.Lock(), [0.0]

        def paced(prompt: str) -> str:
            with lock:
                wait = last[0] + least_gap - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[0] = time.monotonic()
                call = turns[next(turn) % len(turns)]
            return call(prompt)

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return with_retry(lambda: paced(prompt), attempts, pauses), None
            except Exception as e:  # the provider's own
                return None, str(e)

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            for pdf in frames:
                got = list(pool.map(one, pdf["prompt"]))
                yield pdf.assign(answer=[a for a, _ in got], error=[e for _, e in got])

    return df.mapInPandas(run, f"{schema}, answer string, error string")


def through_process(df: DataFrame, command: list[str], column: str, into: str, wait: float = 60.0) -> DataFrame:
    """Adds what a program says about a column: it gets a JSON string a line and answers with one a line, in order. One
    program runs for each Arrow batch. A line that is no JSON string costs its own row its answer, lines that lack
    theirs; where the program fails or takes too long, the batch's rows get null."""

    def answer(line: str) -> str | None:
        try:
            said = json.loads(line)
        except ValueError:
            return None
        return said if isinstance(said, str) else None

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            try:
                said = subprocess.run(command, input="".join(json.dumps(x) + "\n" for x in pdf[column]), capture_output=True, text=True, timeout=wait, check=True).stdout
                out = [answer(x) for x in said.split("\n")[: len(pdf)]]
                out += [None] * (len(pdf) - len(out))
            except (OSError, subprocess.SubprocessError):
                out = [None] * len(pdf)
            yield pdf.assign(**{into: out})

    return df.mapInPandas(run, f"{schema}, `{into}` string")


def classified(df: DataFrame, allowed: list[str], model: str, now: Column) -> DataFrame:
    """Rows with an answer, updated by what it says; others stay."""
    p = parsed_answer(F.col("answer"), allowed)
    df = df.withColumn("_p", p)
    ok = F.col("_p").isNotNull()
    i, s = F.col("_p")["industry"], F.col("_p")["secondary"]
    new = {"industry": i, "tags": F.when(i.isNotNull(), F.concat(F.array(i), s)).otherwise(F.array().cast("array<string>")), "sub_industries": s, "tag_confidence": F.col("_p")["confidence"], "tag_source": F.lit("llm"), "llm_model": F.lit(model), "classified_at": now}
    return df.withColumns({c: F.when(ok, e).otherwise(F.col(c)) for c, e in new.items()}).drop("_p")
