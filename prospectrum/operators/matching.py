"""Saved filters as rows: all of them meet all leads in one join.

A filter's equalities (tier, source, industry, region, firm size, tag) are its key. Few sets of columns occur among filters, so a
lead has one key for each of these sets, and one for each of its tags where the set has the tag; the join is one on equal
keys, and bounds and text are tested on what meets. Many users save the same filter, so counts and deliveries ask for each
different filter once, counts without making pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.functions.text import present

EQUAL = ("tier", "source", "industry", "region", "firm_size_band")
TEXT = ("company_name", "email", "address", "category", "search_query")
#: Parts that a key without any equality, which all leads have, is cut into.
SALTS = 64
#: What filters have in common that match the same leads.
KIND = ("set", "key", "sought", "bounds")
#: Filters of a user and key that are tried as covers of later ones.
EARLIEST = 16
FILTER = "tier string, source string, industry string, tag string, region string, firmSizeBand string, minScore double, maxScore double, hasEmail boolean, search string"


def filters(searches: DataFrame) -> DataFrame:
    """searches (filter_json and others) with filter, its fields, and set, which columns it names, as bits."""
    parsed = F.coalesce(F.from_json(F.coalesce("filter_json", F.lit("{}")), FILTER), F.from_json(F.lit("{}"), FILTER))
    f = searches.withColumn("filter", parsed)
    own = [F.col("filter.tier"), F.col("filter.source"), F.col("filter.industry"), F.col("filter.region"), F.col("filter.firmSizeBand"), F.nullif("filter.tag", F.lit(""))]
    bits = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(own)), F.lit(0))
    return f.select("*", bits.alias("set"), F.array(*own).alias("key"))


def bounds_fit() -> Column:
    """Whether a lead's _score and _mail are within a filter's bounds."""
    low, high = F.col("bounds.low"), F.col("bounds.high")
    return (low.isNull() | (F.col("_score") >= low)) & (high.isNull() | (F.col("_score") <= high)) & (~F.col("bounds.mail") | F.col("_mail"))


def by_key(leads: DataFrame, columns: list[str], sets: list[int], salts: int) -> DataFrame:
    """columns of leads with _score, _mail, _text, and a row for each key that a lead has for one of the sets: set, key, salt."""
    text = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in TEXT if c in leads.columns)))
    own = leads.select(*columns, F.coalesce("score", F.lit(0)).alias("_score"), present(F.col("email")).alias("_mail"), text.alias("_text"), *(F.col(c).alias(f"_{c}") for c in EQUAL), F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("_tags"))

    def keys(bits: int) -> Column:
        """The lead's keys for one set of columns: none if it lacks one of them."""
        named = [F.col(f"_{c}") if bits >> i & 1 else F.lit(None).cast("string") for i, c in enumerate(EQUAL)]
        there = [c.isNotNull() for i, c in enumerate(named) if bits >> i & 1]
        tags = F.filter("_tags", lambda t: t.isNotNull()) if bits >> len(EQUAL) & 1 else F.array(F.lit(None).cast("string"))
        salt = F.pmod(F.xxhash64(*columns), F.lit(salts)) if bits == 0 else F.lit(0)
        rows = F.transform(tags, lambda t: F.struct(F.lit(bits).alias("set"), F.array(*named, t).alias("key"), salt.cast("int").alias("salt")))
        ok = there[0] if there else F.lit(True)
        for t in there[1:]:
            ok = ok & t
        return F.when(ok, rows).otherwise(F.array().cast("array<struct<set: int, key: array<string>, salt: int>>"))

    return own.select(*columns, "_score", "_mail", "_text", F.explode(F.concat(*map(keys, sets))).alias("k")).select(*columns, "_score", "_mail", "_text", "k.*")


def sets_of(f: DataFrame) -> list[int]:
    return sorted(r[0] for r in f.select("set").distinct().collect())  # 64 at most


def dealt(f: DataFrame, salts: int) -> DataFrame:
    """Rows of filters with a salt; those that name no column once for each."""
    return f.withColumn("salt", F.explode(F.when(F.col("set") == 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))


def kinds(searches: DataFrame, columns: list[str]) -> DataFrame:
    """columns of searches with what decides of a filter: set, key, sought (text, null for none) and bounds. Filters that
    say the same have equal values, however their JSON is written."""
    text, mail = F.nullif(F.lower(F.trim("filter.search")), F.lit("")), F.coalesce("filter.hasEmail", F.lit(False))
    bounds = F.struct(F.col("filter.minScore").alias("low"), F.col("filter.maxScore").alias("high"), mail.alias("mail"))
    return filters(searches).select(*columns, "set", "key", text.alias("sought"), bounds.alias("bounds"))


def meeting(leads: DataFrame, asked: DataFrame, columns: list[str], given: list[str], salts: int = SALTS) -> DataFrame:
    """Pairs of leads and rows of kinds() that match: columns and given columns."""
    if not (sets := sets_of(asked)):
        return leads.limit(0).crossJoin(asked.limit(0)).select(*columns, *given)
    both = by_key(leads, columns, sets, salts).join(dealt(asked, salts), ["set", "key", "salt"])
    return both.where(bounds_fit() & (F.col("sought").isNull() | F.contains("_text", "sought"))).select(*columns, *given)


def matched(leads: DataFrame, searches: DataFrame, columns: list[str], given: list[str], salts: int = SALTS) -> DataFrame:
    """columns of leads beside given columns of searches (filter_json), for each pair that matches as a saved search's
    predicate says after a run: a missing score is 0, text is sought in one string of all text columns. A lead that
    lacks a column doesn't match a filter that names it; a filter that can't be read matches all, as an empty one does."""
    return meeting(leads, kinds(searches, given), columns, given, salts)


def counted(leads: DataFrame, searches: DataFrame, amount: str, given: list[str], salts: int = SALTS) -> DataFrame:
    """given columns of searches that match any lead, the number n of leads that matched() has for each, and the sum of
    their amount. No pairs are made: leads are counted by key, text found, score and email, and equal filters ask once."""
    own = kinds(searches, given)
    asked = own.select(*KIND).distinct().persist()  # asked several times, parsed once
    texts = asked.where("sought is not null").select("set", "key", "sought").distinct()
    if not (sets := sets_of(asked)):
        return leads.limit(0).crossJoin(own.limit(0)).select(*given, F.lit(0).cast("long").alias("n"), amount)
    total = F.count(F.lit(1)).alias("n"), F.sum(amount).alias(amount)
    groups = by_key(leads, [amount], sets, salts).groupBy("set", "key", F.lit(None).cast("string").alias("sought"), "_score", "_mail").agg(*total)
    if with_text := sets_of(texts):
        found = by_key(leads, [amount], with_text, salts).join(dealt(texts, salts), ["set", "key", "salt"]).where(F.contains("_text", "sought"))
        groups = groups.unionByName(found.groupBy("set", "key", "sought", "_score", "_mail").agg(*total))
    same = (F.col("a.set") == F.col("g.set")) & (F.col("a.key") == F.col("g.key")) & F.col("a.sought").eqNullSafe(F.col("g.sought"))
    met = asked.alias("a").join(groups.alias("g"), same).where(bounds_fit()).select(F.struct(*(f"a.{c}" for c in KIND)).alias("_kind"), "n", amount)
    each = met.groupBy("_kind").agg(F.sum("n").alias("n"), F.sum(amount).alias(amount))
    return own.select(*given, F.struct(*KIND).alias("_kind")).join(each, "_kind").select(*given, "n", amount)


def leading(searches: DataFrame) -> DataFrame:
    """Of searches (id, user_id, filter_json) those that can be the least of its user's that a lead matches, as rows of kinds():
    the least id of a user's equal filters, and none that one of the user's earlier and broader filters covers. As broader
    ones count the EARLIEST of each key; others cover nothing, and what they would cover stays."""
    least = kinds(searches, ["id", "user_id"]).groupBy("user_id", *KIND).agg(F.min("id").alias("id")).persist()
    if not (sets := sets_of(least)):
        return least
    part = lambda bits: F.struct(F.lit(bits).alias("set"), F.array(*(F.get("key", F.lit(i)) if bits >> i & 1 else F.lit(None).cast("string") for i in range(len(EQUAL) + 1))).alias("key"))
    broader = F.filter(F.array(*(F.when(F.col("set").bitwiseAND(F.lit(s)) == s, part(s)) for s in sets)), lambda x: x.isNotNull())
    nth = F.row_number().over(W.partitionBy("user_id", "set", "key").orderBy("id"))
    by = least.withColumn("_nth", nth).where(F.col("_nth") <= EARLIEST).select("user_id", "set", "key", F.col("sought").alias("_sought"), F.col("bounds").alias("_b"), F.col("id").alias("_by"))
    up = least.select("user_id", "id", F.struct(*KIND).alias("_kind"), F.explode(broader).alias("_up")).select("user_id", "id", "_kind", "_up.*")
    low, high = (lambda c: F.coalesce(F.col(f"{c}.low"), F.lit(float("-inf")))), (lambda c: F.coalesce(F.col(f"{c}.high"), F.lit(float("inf"))))
    covers = (F.col("_by") < F.col("id")) & (low("_b") <= low("_kind.bounds")) & (high("_b") >= high("_kind.bounds")) & (~F.col("_b.mail") | F.col("_kind.bounds.mail"))
    covers = covers & (F.col("_sought").isNull() | F.coalesce(F.contains("_kind.sought", "_sought"), F.lit(False)))
    covered = up.join(by, ["user_id", "set", "key"]).where(covers).select("user_id", "_kind").distinct()
    return least.withColumn("_kind", F.struct(*KIND)).join(covered, ["user_id", "_kind"], "left_anti").drop("_kind")


def attributed_all(leads: DataFrame, stored: DataFrame, searches: DataFrame) -> DataFrame:
    """Deliveries of a run to all searches (id, user_id, filter_json) that it serves: each stored lead once a user, for the
    least search that it matches."""
    run = leads.where("dedupe_key is not null").join(stored.select("dedupe_key"), "dedupe_key", "left_semi")
    own = meeting(run, leading(searches).withColumnRenamed("id", "saved_search_id"), ["dedupe_key"], ["saved_search_id", "user_id"])
    first = own.groupBy("user_id", "dedupe_key").agg(F.min("saved_search_id").alias("saved_search_id"))
    return first.join(stored.select("dedupe_key", F.col("id").alias("lead_id")), "dedupe_key").select("user_id", "lead_id", "saved_search_id", F.lit("fresh").alias("delivery_reason"))
