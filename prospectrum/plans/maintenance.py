"""Jobs over the stored table. Each gives a DataFrame and writes nothing; the caller stores the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.functions.rules import TAXONOMY, Vocabulary
from prospectrum.functions.text import dedupe_key, present, truthy
from prospectrum.operators import leads

# Fixed value: sources of a classification that the rules leave alone.
PROTECTED = ("web", "llm")
CLASSES = ("industry", "tags", "sub_industries", "tag_confidence", "tag_source")
CONTACTS = ("email", "phone", "linkedin", "facebook", "instagram")


def rescored(df: DataFrame) -> DataFrame:
    """Rows with regions, firm size, score and tier made anew."""
    return leads.scored(leads.regions(leads.firmographics(df)))


def cleaned_table(df: DataFrame) -> DataFrame:
    """The whole table cleaned and merged by the key that the cleaned values give; rows without a key go. ord is kept."""
    return leads.merge_duplicates(leads.clean(df))


def reclassified(df: DataFrame, taxonomy: Vocabulary = TAXONOMY) -> DataFrame:
    """Rows with the rules' classes and outcome: protected (web or model classes stay), unchanged, cleared, gained or
    changed. Only the last three get new classes; a cleared row has no source of its tags."""
    old = df.withColumnsRenamed({c: f"_{c}" for c in CLASSES})
    new = leads.classify(old, taxonomy)
    kept = F.coalesce(F.col("_tag_source").isin(*PROTECTED), F.lit(False))
    a, b = F.nullif(F.col("_industry"), F.lit("")), F.col("industry")
    outcome = F.when(kept, "protected").when(a.eqNullSafe(b), "unchanged").when(b.isNull(), "cleared").when(a.isNull(), "gained").otherwise("changed")
    own = new.withColumns({"outcome": outcome, "before": a, "tag_source": F.when(b.isNotNull(), "rules")})
    moved = F.col("outcome").isin("cleared", "gained", "changed")
    return own.select(*(F.when(moved, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in CLASSES else F.col(c) for c in df.columns), "outcome", "before")


def industry_losses(df: DataFrame) -> DataFrame:
    """Of reclassified rows: how many each industry lost, most first."""
    return df.where(F.col("outcome").isin("changed", "cleared")).groupBy(F.col("before").alias("industry")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry")


def collapsed(df: DataFrame, order: str = "id") -> DataFrame:
    """The first row of each key computed anew: stored keys may differ where the new ones don't, and an upsert takes a
    key once. Rows without a key go."""
    return leads.first_seen(leads.with_key(df), F.col("dedupe_key"), order)


def backfilled(df: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of several files (with ord) merged by key; those without a score are scored, others keep theirs."""
    merged = leads.merge_duplicates(df, order)
    new = leads.scored(merged.withColumnsRenamed({"score": "_score", "tier": "_tier"}).withColumn("score", F.lit(None).cast("int")))
    return new.withColumns({"tier": F.when(F.col("_score").isNull(), F.col("tier")).otherwise(F.col("_tier")), "score": F.coalesce("_score", "score")}).select(*merged.columns)


def filled(df: DataFrame, found: DataFrame, key: str = "dedupe_key", columns: tuple[str, ...] = CONTACTS, most: int | None = None, order: str = "ord") -> DataFrame:
    """A later rung of enrichment: gaps in columns filled from a captured table by key, nothing that is filled changed.
    Of rows with a website and without an email only the first ones, as many as most, are looked up."""
    if most is None:
        todo = found
    else:
        lacking = df.where(present(F.col("website")) & ~present(F.col("email")))
        todo = found.join(leads.first_rows(lacking, most, order).select(key), key, "left_semi")
    got = todo.groupBy(key).agg(*(F.min(F.nullif(F.col(c), F.lit(""))).alias(f"_{c}") for c in columns))
    return df.join(got, key, "left").select(*(F.when(truthy(F.col(c), "string"), F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def pending(firms: DataFrame, done: DataFrame, key: Column) -> DataFrame:
    """Firms that a checkpoint table of keys doesn't hold: what a batch that is taken up again has left."""
    return firms.withColumn("_key", key).where(present(F.col("_key"))).join(done.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")


def outcomes(df: DataFrame) -> DataFrame:
    """One row about a pass of model calls (answer, error, parsed, and tokens if known): classified, failed, unusable,
    total, and the tokens used."""
    ok, failed = F.col("parsed").isNotNull(), F.col("error").isNotNull()
    tokens = [F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")] if "tokens" in df.columns else []
    return df.agg(F.count_if(ok).alias("classified"), F.count_if(failed).alias("failed"), F.count_if(~ok & ~failed).alias("unusable"), F.count(F.lit(1)).alias("total"), *tokens)


# Fixed value: columns of the stored table beside those of a lead, in the order in which they were added.
STORED = {"id": "long", "dedupe_key": "string", "created_at": "timestamp", "updated_at": "timestamp", "status": "string", "deleted_at": "timestamp", "llm_model": "string", "classified_at": "timestamp"}


def migrated(df: DataFrame) -> DataFrame:
    """A stored table of any earlier form in the present one: columns that came later are null (status: new), types are
    cast, and a missing key or id is made. Columns that aren't known stay at the end. Doing it again changes nothing."""
    have = set(df.columns)
    own = {c: F.col(c).cast(k) if c in have else F.lit(None).cast(k) for c, k in (leads.KINDS | STORED).items()}
    out = df.select(*(e.alias(c) for c, e in own.items()), *(c for c in df.columns if c not in own))
    out = out.withColumn("dedupe_key", F.coalesce("dedupe_key", dedupe_key(F.col("website"), F.col("company_name"))))
    return out.withColumns({"id": F.coalesce("id", F.xxhash64("dedupe_key")), "status": F.coalesce("status", F.lit("new"))})


def exported(df: DataFrame) -> DataFrame:
    """The table, refused if it is empty: an empty export would replace a good one. Where df is a plan and not a
    stored table, store it first: it is looked at here and read again to be written."""
    if df.isEmpty():
        raise ValueError("nothing to export")
    return df
