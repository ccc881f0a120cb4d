"""Operators on lead tables: cleaning, merging, filters, classification, scoring, master and upsert."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.functions import rules, text
from prospectrum.functions.rules import ICP_WORDS, REGIONS, TAXONOMY, Vocabulary

# Fixed value: the columns of a lead, in order, with their types.
LEAD = (
    "company_name string, category string, website string, email string, all_emails string, phone string, address string, linkedin string, facebook string, instagram string, "
    "rating string, review_count string, company_size string, hourly_rate string, min_project string, search_query string, profile_url string, source string, engine string, "
    "email_verified string, score int, tier string, scraped_at timestamp, first_seen_at timestamp, last_seen_at timestamp, industry string, tags array<string>, sub_industries array<string>, "
    "employee_count int, firm_size_band string, is_enterprise boolean, tag_confidence double, tag_source string, region string"
)
KINDS = dict(x.split(" ") for x in LEAD.split(", "))
COLUMNS = list(KINDS)
#: Names of the raw layer and what they are called here.
RAW_NAMES = {"name": "company_name", "reviews": "review_count", "maps_url": "profile_url"}
CLEANED_TEXT = ("company_name", "category", "address", "search_query", "engine", "source", "company_size", "hourly_rate", "min_project", "rating", "review_count", "email_verified")
CLEANED_URLS = ("website", "linkedin", "facebook", "instagram", "profile_url")
#: Columns of the stored table that users own; syncing leaves them alone.
USER_OWNED = ("status", "deleted_at")
TTL_DAYS = 30


def as_leads(df: DataFrame) -> DataFrame:
    """Raw rows under either naming, with every lead column (null where lacking) and ord, the input order, if it is there."""
    for old, new in RAW_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    own = [F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in KINDS.items()]
    return df.select(*(["ord"] if "ord" in df.columns else []), *own)


def clean(df: DataFrame) -> DataFrame:
    """Each kind of column goes through its cleaning as one array, so that a plan holds each chain once; the arrays stand
    behind a generator (see once), as the columns are used more than once."""
    kinds = {text.clean_text: CLEANED_TEXT, text.clean_url: CLEANED_URLS, text.clean_email: ("email",), text.clean_emails: ("all_emails",), text.clean_phone: ("phone",)}
    own = {fn: [c for c in names if c in df.columns] for fn, names in kinds.items()}
    guarded = lambda fn: lambda x: F.when(text.present(x), fn(x)).otherwise(x)
    arrays = [F.transform(F.array(*names), guarded(fn)).alias(fn.__name__) for fn, names in own.items() if names]
    if not arrays:
        return df
    where = {c: F.col("_clean")[fn.__name__][i] for fn, names in own.items() for i, c in enumerate(names)}
    return once(df, "_clean", F.struct(*arrays)).select(*(where.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", text.dedupe_key(F.col("website"), F.col("company_name")))


def merge_duplicates(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each key: each column takes its first filled value in input order, other columns the first row's.
    Rows without a key go. One aggregation, so hot keys are combined before the shuffle."""
    keyed = with_key(df).where("dedupe_key is not null")
    kinds = dict(keyed.dtypes)
    first = lambda c: F.min_by(F.col(c), F.when(text.truthy(F.col(c), kinds[c]), F.col(order)))
    aggs = [F.coalesce(first(c), F.min_by(c, order)).alias(c) for c in COLUMNS if c in kinds]
    rest = [F.min_by(F.struct(c), order).getField(c).alias(c) for c in keyed.columns if c not in (*COLUMNS, order, "dedupe_key")]
    return keyed.groupBy("dedupe_key").agg(F.min(order).alias(order), *aggs, *rest)


def first_seen(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each non-empty key (duplicates inside one source). An aggregation, so hot keys are combined
    before the shuffle."""
    keyed = df.withColumn("_key", key).where(text.present(F.col("_key")))
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("_row")).select(*(F.col(f"_row.`{c}`") for c in df.columns))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later expressions share: a generator of one row, which the optimizer doesn't copy
    into each of its uses."""
    return df.withColumn(name, F.explode(F.array(value)))


def first_rows(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows in input order: a cap that gives the same rows each time."""
    return df.orderBy(order).limit(n)


def icp_test(words: tuple[str, ...] = ICP_WORDS) -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("company_name", F.lit(""))))
    return hay.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def icp(df: DataFrame, words: tuple[str, ...] = ICP_WORDS) -> DataFrame:
    return df.where(icp_test(words))


def _dead() -> Column:
    return F.coalesce(F.col("email_verified") == "dead", F.lit(False))


def contact_test() -> Column:
    """A phone, a LinkedIn page or an email that isn't dead."""
    return text.present(F.col("phone")) | text.present(F.col("linkedin")) | (text.present(F.col("email")) & ~_dead())


def contactable(df: DataFrame) -> DataFrame:
    return df.where(contact_test())


def alive_test() -> Column:
    """Not a dead email and nothing else."""
    return ~(_dead() & text.missing(F.col("phone")) & text.missing(F.col("linkedin")))


def not_only_dead_email(df: DataFrame) -> DataFrame:
    return df.where(alive_test())


def score_floor(df: DataFrame, least: int = 35) -> DataFrame:
    return df.where(F.col("score") >= least)


def not_expired(df: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Seen within the days before now; rows never seen stay, an unreadable time counts as expired."""
    seen = F.coalesce(F.nullif(F.col("last_seen_at").cast("string"), F.lit("")), F.nullif(F.col("scraped_at").cast("string"), F.lit("")))
    return df.where(seen.isNull() | F.coalesce(F.try_to_timestamp(seen) > now - F.expr(f"interval {days} days"), F.lit(False)))


def classify(df: DataFrame, taxonomy: Vocabulary = TAXONOMY) -> DataFrame:
    hay = rules.haystack(*(F.col(c) for c in ("category", "company_name", "search_query", "website", "profile_url")))
    df = once(once(df, "_hay", hay), "_hits", rules.hits(F.col("_hay"), taxonomy, words=True))
    return df.withColumns({
        "industry": F.get(rules.slugs(F.col("_hits")), F.lit(0)), "tags": rules.slugs(F.col("_hits")),
        "sub_industries": rules.slugs(F.slice("_hits", F.lit(2), F.greatest(F.size("_hits") - 1, F.lit(0)))),
        "tag_confidence": rules.confidence(F.col("_hits"), 0.5, 0.1, 0.95), "tag_source": F.lit("rules"),
    }).drop("_hay", "_hits")


def tag_from_pages(df: DataFrame, pages: DataFrame, taxonomy: Vocabulary = TAXONOMY, most: int = 300) -> DataFrame:
    """Industries of the first unclassified rows with a website, from their site's text: pages (host, page_text).
    Buckets need two hits; the text join is only for those rows."""
    todo = F.col("industry").isNull() & text.present(F.col("website"))
    picked = first_rows(df.where(todo), most).select("dedupe_key", text.site_key(F.col("website")).alias("host"))
    hit = F.filter(rules.hits(F.lower("page_text"), taxonomy, words=True), lambda r: r["less"] <= -2)
    got = picked.join(pages, "host").select("dedupe_key", hit.alias("_web")).where(F.size("_web") > 0)
    out = df.join(got, "dedupe_key", "left")
    web = F.col("_web").isNotNull()
    return out.withColumns({
        "industry": F.when(web, F.get(rules.slugs(F.col("_web")), F.lit(0))).otherwise(F.col("industry")), "tags": F.when(web, rules.slugs(F.col("_web"))).otherwise(F.col("tags")),
        "sub_industries": F.when(web, rules.slugs(F.slice("_web", F.lit(2), F.greatest(F.size("_web") - 1, F.lit(0))))).otherwise(F.col("sub_industries")),
        "tag_confidence": F.when(web, F.round(rules.confidence(F.col("_web"), 0.3, 0.05, 0.75), 2)).otherwise(F.col("tag_confidence")), "tag_source": F.when(web, "web").otherwise(F.col("tag_source")),
    }).drop("_web")


def firmographics(df: DataFrame) -> DataFrame:
    n = rules.employee_count(F.col("company_size"))
    df = df.withColumn("employee_count", n)
    return df.withColumns({"firm_size_band": rules.size_band(F.col("employee_count")), "is_enterprise": rules.is_enterprise(F.col("employee_count"))})


def regions(df: DataFrame, vocabulary: Vocabulary = REGIONS) -> DataFrame:
    return df.withColumn("region", rules.region(F.col("address"), F.col("search_query"), vocabulary))


def scored(df: DataFrame) -> DataFrame:
    df = once(df.drop("score"), "score", rules.score({c: F.col(c) for c in COLUMNS}))
    return df.withColumn("tier", rules.tier(F.col("score")))


# Resolver errors that say a domain takes no mail; any other error says nothing.
NO_MAIL = ("ENOTFOUND", "ENODATA")


def domain_statuses(answers: DataFrame) -> DataFrame:
    """(domain, status) of captured resolver answers (domain, records, error): alive with records, dead without or
    where the resolver says so, else unknown. Of several answers the best counts."""
    status = F.when(F.coalesce("records", F.lit(0)) > 0, "alive").when(F.col("error").isNull() | F.col("error").isin(*NO_MAIL), "dead").otherwise("unknown")
    rank = F.when(status == "alive", 0).when(status == "dead", 1).otherwise(2)
    return answers.groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.min_by(status, rank).alias("status"))


def verify_emails(df: DataFrame, domains: DataFrame) -> DataFrame:
    """email_verified from a captured table (domain, status); unknown where it has none, '' without an email."""
    keyed = df.withColumn("_domain", F.when(text.present(F.col("email")), F.lower(F.element_at(F.split("email", "@"), -1))))
    return keyed.drop("email_verified").join(domains.select(F.col("domain").alias("_domain"), F.col("status").alias("_status")), "_domain", "left").withColumn("email_verified", F.when(text.missing(F.col("email")), "").otherwise(F.coalesce("_status", F.lit("unknown")))).drop("_domain", "_status")


def last_rows(df: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """The last row of each key that isn't null: by ord if there is one, else the one seen last; ties by the row's hash."""
    rest = [c for c in df.columns if c != key]
    times = [c for c in ("last_seen_at", "scraped_at", "updated_at") if c in rest]
    order = F.struct(*([F.col("ord")] if "ord" in rest else [F.col(c) for c in times]), F.xxhash64(*(F.col(f"`{c}`") for c in rest)).alias("_hash"))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_row"))
    return out.select(key, *(F.col(f"_row.`{c}`") for c in rest))


def filled_rows(df: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One row of each key that isn't null: each column's first filled value, by ord if there is one, else by the row's hash."""
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in (key, "ord")]
    df = df.where(F.col(key).isNotNull()).withColumn("_order", F.col("ord").cast("long") if "ord" in kinds else F.xxhash64(*(F.col(f"`{c}`") for c in rest)))
    first = lambda c: F.min_by(c, F.when(text.truthy(F.col(c), kinds[c]), F.col("_order")))
    return df.groupBy(key).agg(*(F.coalesce(first(c), F.min_by(c, "_order")).alias(c) for c in rest))


def merge_master(master: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Full outer join on dedupe_key; rows without one are in neither. Of a key that the master repeats the last row
    counts; rows of a key that the batch repeats fill each other's gaps. Known rows keep their values, have gaps
    filled, and are seen now; new rows come in. Both sides are grouped by the key that joins them: one shuffle each."""
    m, b = last_rows(master).alias("m"), filled_rows(batch).alias("b")
    both, new = F.col("b.dedupe_key").isNotNull(), F.col("m.dedupe_key").isNull()
    out = [F.coalesce("m.dedupe_key", "b.dedupe_key").alias("dedupe_key")]
    for c, k in KINDS.items():
        if c not in master.columns:
            continue
        if c in ("last_seen_at", "scraped_at"):
            e = F.when(both, now).otherwise(F.col(f"m.{c}"))
        elif c == "first_seen_at":
            e = F.when(new, F.coalesce("b.first_seen_at", now)).otherwise(F.coalesce("m.first_seen_at", "b.first_seen_at"))
        else:
            e = F.when(text.truthy(F.col(f"m.{c}"), k), F.col(f"m.{c}")).when(text.truthy(F.col(f"b.{c}"), k), F.col(f"b.{c}")).otherwise(F.coalesce(f"m.{c}", f"b.{c}"))
        out.append(e.alias(c))
    return m.join(b, F.col("m.dedupe_key") == F.col("b.dedupe_key"), "full_outer").select(*out)


def to_row(df: DataFrame) -> DataFrame:
    """Types of the stored table: '' becomes null, numbers are read from their strings, a score of 0 becomes null."""
    out = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, k in KINDS.items() if k == "string" and c in df.columns})
    num = lambda c: F.when(F.col(c).isNotNull(), F.nullif(text.leading_number(F.col(c)), F.lit(0.0)))
    numbers = {"rating": num("rating"), "review_count": num("review_count").cast("int"), "score": F.nullif(F.col("score"), F.lit(0))}
    return out.withColumns({c: e for c, e in numbers.items() if c in df.columns})


def from_row(df: DataFrame) -> DataFrame:
    """Back to pipeline types: numbers as strings, null strings as ''."""
    return df.withColumns({c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit("")) for c, k in KINDS.items() if k == "string" and c in df.columns})


def upsert(target: DataFrame, batch: DataFrame, now: Column, key: str = "dedupe_key") -> DataFrame:
    """The stored table after a sync: rows of the batch (its last for each key; without a key they are left out)
    replace the target's, but users' columns, id and created_at stay; updated_at is now where something came."""
    batch = last_rows(batch, key)
    t, b = target.alias("t"), batch.drop("ord").alias("b")
    came = F.col(f"b.{key}").isNotNull()
    out = [F.coalesce(f"t.{key}", f"b.{key}").alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c == "id":
            e = F.coalesce("t.id", F.xxhash64(f"b.{key}"))
        elif c == "updated_at":
            e = F.when(came, now).otherwise(F.col("t.updated_at"))
        elif c == "created_at":
            e = F.coalesce("t.created_at", now)
        elif c in USER_OWNED or c not in batch.columns:
            e = F.col(f"t.{c}")
        else:
            e = F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
        out.append(e.alias(c))
    return t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer").select(*out)
