"""The batch pipeline: one lazy plan whose only shuffles are the merge by key and the joins of captured tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectrum.functions.rules import ICP_WORDS, REGIONS, TAXONOMY, Vocabulary
from prospectrum.operators import leads
from prospectrum.sources.captured import enriched


@dataclass(frozen=True)
class Settings:
    icp_words: tuple[str, ...] = ICP_WORDS
    least_score: int = 22
    taxonomy: Vocabulary = field(default=TAXONOMY)
    regions: Vocabulary = field(default=REGIONS)


def run(raw: DataFrame, settings: Settings = Settings(), contacts: DataFrame | None = None, domains: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """raw: leads with ord. Optional captured tables: contacts by host, email domains, page texts by host."""
    df = leads.merge_duplicates(leads.clean(leads.as_leads(raw)))
    df = leads.icp(df, settings.icp_words)
    if contacts is not None:
        df = leads.clean(enriched(df, contacts))
    if domains is not None:
        df = leads.verify_emails(df, domains)
    df = leads.not_only_dead_email(leads.contactable(df))
    df = leads.classify(df, settings.taxonomy)
    if pages is not None:
        df = leads.tag_from_pages(df, pages, settings.taxonomy)
    df = leads.scored(leads.regions(leads.firmographics(df), settings.regions))
    return leads.score_floor(df, settings.least_score).orderBy(F.desc("score"), "ord")


def drop_counts(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(step, step_ord, rows): how many rows each step of run() leaves, in one pass over the merged rows."""
    whole = leads.as_leads(raw)
    merged = leads.merge_duplicates(leads.clean(whole))
    kept = {"icp": leads.icp_test(settings.icp_words), "contact": leads.contact_test(), "dead_email": leads.alive_test()}
    df = leads.scored(leads.regions(leads.firmographics(leads.classify(merged, settings.taxonomy)), settings.regions))
    flags, so_far = [F.count(F.lit(1)).alias("merged")], F.lit(True)
    for name, test in (*kept.items(), ("score", F.col("score") >= settings.least_score)):
        so_far = so_far & F.coalesce(test, F.lit(False))
        flags.append(F.count_if(so_far).alias(name))
    steps = ["merged", *kept, "score"]
    rest = df.agg(*flags).select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("step"), F.col(n).alias("rows")) for n in steps))).alias("at", "x")).select("x.step", (F.col("at") + 1).alias("step_ord"), "x.rows")
    return whole.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("raw").alias("step"), F.lit(0).alias("step_ord"), "rows").unionByName(rest)
