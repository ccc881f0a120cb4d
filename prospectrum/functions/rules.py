"""Firm size, taxonomy, region and score rules, as Column expressions. Vocabularies are parameters."""

from __future__ import annotations

import json
import pkgutil
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectrum.functions.text import leading_number, missing, present


@dataclass(frozen=True)
class Vocabulary:
    """Ordered buckets (slug, keywords); order breaks ties."""

    buckets: tuple[tuple[str, tuple[str, ...]], ...]

    @staticmethod
    def of(spec: dict[str, str]) -> Vocabulary:
        return Vocabulary(tuple((slug, tuple(dict.fromkeys(words.split("|")))) for slug, words in spec.items()))


@dataclass(frozen=True)
class Vocabularies:
    icp_words: tuple[str, ...]
    taxonomy: Vocabulary
    regions: Vocabulary

    @staticmethod
    def read(raw: str) -> Vocabularies:
        """JSON with icp_words, industries and regions (lists of slug and keywords); what it lacks is the default's."""
        spec = json.loads(DEFAULTS) | json.loads(raw)
        of = lambda rows: Vocabulary(tuple((x["slug"], tuple(dict.fromkeys(x["keywords"]))) for x in rows))
        return Vocabularies(tuple(spec["icp_words"]), of(spec["industries"]), of(spec["regions"]))


def differences(ours: Vocabularies, theirs: Vocabularies) -> list[str]:
    """What two copies of the vocabularies don't have in common, by slug or word; nothing if they are equal."""
    out = [f"icp word {w}" for w in sorted(set(ours.icp_words) ^ set(theirs.icp_words))]
    for kind, a, b in (("industry", ours.taxonomy, theirs.taxonomy), ("region", ours.regions, theirs.regions)):
        x, y = dict(a.buckets), dict(b.buckets)
        out += [f"{kind} {s}" for s in sorted(x.keys() | y.keys()) if x.get(s) != y.get(s)]
        if not out and [s for s, _ in a.buckets] != [s for s, _ in b.buckets]:
            out.append(f"order of the {kind} list")
    return out


DEFAULTS = pkgutil.get_data("prospectrum", "data/vocabularies.json").decode()
_DEFAULT = Vocabularies.read("{}")
ICP_WORDS, TAXONOMY, REGIONS = _DEFAULT.icp_words, _DEFAULT.taxonomy, _DEFAULT.regions

# Size bands, enterprise size, points for sources, premium industries and words, tiers.
SIZE_BANDS = ((1, "solo"), (10, "small"), (249, "mid"), (999, "large"))
ENTERPRISE = 1000
SOURCE_POINTS = {"clutch": 20, "goodfirms": 18, "topdevelopers": 14, "designrush": 12, "sortlist": 12, "google_maps": 10, "businesslist_pk": 10, "businesslist_ng": 10, "github_orgs": 8, "pseb": 8, "openstreetmap": 6, "opencorporates": 6, "eventbrite": 5}
OTHER_SOURCE = 5
PREMIUM = ("ai-ml", "cloud-devops", "cybersecurity", "erp-sap", "blockchain", "data-analytics-bi")
PREMIUM_WORDS = ("ai", "artificial intelligence", "machine learning", "fintech", "saas", "blockchain", "cloud", "cybersecurity", "data", "devops", "iot", "automation", "erp", "enterprise")
TIERS = ((75, "A"), (55, "B"), (35, "C"))
RATING_POINTS = ((4.7, 15), (4.5, 12), (4.0, 8), (3.5, 4))
REVIEW_POINTS = ((200, 15), (100, 12), (50, 8), (20, 5), (5, 2))


def employee_count(c: Column) -> Column:
    """The number, or the rounded middle of the first two; null without digits."""
    runs = F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))
    a, b = F.get(runs, F.lit(0)), F.get(runs, F.lit(1))
    return F.when(b.isNull(), a).otherwise(F.floor((a + b) / 2 + F.lit(0.5))).try_cast("int")


def size_band(n: Column) -> Column:
    out = F.when(n.isNull(), F.lit(None).cast("string"))
    for most, name in SIZE_BANDS:
        out = out.when(n <= most, name)
    return out.otherwise("enterprise")


def hourly_floor(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("int")


def is_enterprise(n: Column) -> Column:
    return F.coalesce(n >= ENTERPRISE, F.lit(False))


def word_pattern(keyword: str) -> str:
    """The keyword, a plural of it too, between characters that are no ASCII letter or digit."""
    return "(?:^|[^a-z0-9])" + re.escape(keyword).replace("\\ ", " ") + "s?(?:[^a-z0-9]|$)"


def haystack(category: Column, name: Column, query: Column, website: Column, profile_url: Column) -> Column:
    domain = F.regexp_replace(F.regexp_replace(F.regexp_replace(website, r"(?i)^https?://", ""), r"(?i)^www\.", ""), r"[.\-/]", " ")
    slug = F.element_at(F.split(profile_url, "/"), -1)
    words = F.when(~slug.rlike("[=!%]"), F.regexp_replace(slug, "[-_]", " "))
    return F.lower(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in (category, name, query, domain, words))))


@cache
def automaton(keywords: tuple[str, ...]):  # noqa: ANN201
    """An Aho-Corasick automaton over the keywords, built once in a worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, k in enumerate(keywords):
        out.add_word(k, (i, len(k)))
    out.make_automaton()
    return out


_WORD_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def found_keywords(text: str, keywords: tuple[str, ...], words: bool) -> set[int]:
    """Places of the keywords in a text, in one pass over it. words: only those between characters that are no ASCII
    letter or digit, or the text's ends; a plural s may follow."""
    out, n = set(), len(text)
    for last, (i, size) in automaton(keywords).iter(text):
        if words and i not in out:
            begin, end = last - size, last + 1
            if begin >= 0 and text[begin] in _WORD_LETTERS:
                continue
            if end < n and text[end] in _WORD_LETTERS and not (text[end] == "s" and (end + 1 == n or text[end + 1] not in _WORD_LETTERS)):
                continue
        out.add(i)
    return out


def hits(text: Column, vocabulary: Vocabulary, words: bool) -> Column:
    """Buckets with hits, most first: array<struct<less, ord, slug>>, less being minus the distinct keywords found.
    One automaton holds all keywords, so that a row costs one pass over its text, whatever the vocabulary's size."""
    keywords = tuple(dict.fromkeys(k for _, own in vocabulary.buckets for k in own))
    place = {k: i for i, k in enumerate(keywords)}
    buckets = [(n, slug, frozenset(place[k] for k in own)) for n, (slug, own) in enumerate(vocabulary.buckets)]
    of_keyword = [[n for n, _, own in buckets if i in own] for i in range(len(keywords))]

    def run(column):  # noqa: ANN001, ANN202
        import pyarrow as pa

        kind = pa.list_(pa.struct([("less", pa.int32()), ("ord", pa.int32()), ("slug", pa.string())]))
        out = []
        for t in column.to_pylist():
            if t is None:
                out.append(None)
                continue
            counts = Counter(n for i in found_keywords(t, keywords, words) for n in of_keyword[i])
            out.append([{"less": less, "ord": n, "slug": buckets[n][1]} for less, n in sorted((-k, n) for n, k in counts.items())])
        return pa.array(out, kind)

    if not keywords:
        return F.when(text.isNotNull(), F.array().cast("array<struct<less: int, ord: int, slug: string>>"))
    return F.arrow_udf(run, "array<struct<less: int, ord: int, slug: string>>")(text)


def slugs(found: Column) -> Column:
    return F.transform(found, lambda r: r["slug"])


def confidence(found: Column, base: float, step: float, most: float) -> Column:
    """From the best bucket's hits and its lead over the second; 0 without any."""
    top, second = -F.get(found, F.lit(0))["less"], F.coalesce(-F.get(found, F.lit(1))["less"], F.lit(0))
    return F.when(F.size(found) > 0, F.least(F.lit(most), F.lit(base) + F.lit(step) * top + F.lit(step) * (top - second))).otherwise(F.lit(0.0))


def region(address: Column, query: Column, regions: Vocabulary = REGIONS) -> Column:
    text = F.lower(F.concat_ws(" ", address, query))
    return F.get(slugs(hits(text, regions, words=False)), F.lit(0))


def points(value: Column, steps: tuple[tuple[float, int], ...], rest: Column | None = None) -> Column:
    out = None
    for least, n in steps:
        out = F.when(value >= least, n) if out is None else out.when(value >= least, n)
    return out.otherwise(F.lit(0) if rest is None else rest)


def score(c: dict[str, Column]) -> Column:
    """0 to 100 from a lead's columns (email, email_verified, phone, ...)."""
    one = lambda test, n: F.when(test, n).otherwise(0)
    rating, reviews = leading_number(c["rating"]), F.floor(leading_number(c["review_count"]))
    source = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_POINTS.items() for x in kv]), F.coalesce(c["source"], F.lit(""))), F.lit(OTHER_SOURCE))
    text = F.lower(F.concat_ws(" ", F.coalesce(c["category"], F.lit("")), F.coalesce(c["company_name"], F.lit(""))))
    words = F.lit(False)
    for w in PREMIUM_WORDS:
        words = words | F.contains(text, F.lit(w))
    tagged = c["tags"].isNotNull() & present(c["tag_source"])
    premium = F.when(tagged, F.arrays_overlap(c["tags"], F.array(*map(F.lit, PREMIUM)))).otherwise(words)
    total = (
        F.when(missing(c["email"]), 0).when(c["email_verified"] == "alive", 22).when(F.coalesce(c["email_verified"] == "dead", F.lit(False)), 0).otherwise(12)
        + one(present(c["phone"]), 8) + one(present(c["linkedin"]), 7) + one(present(c["website"]), 3) + one(F.contains(c["all_emails"], F.lit(";")), 2)
        + points(rating, RATING_POINTS, F.when(rating > 0, 1).otherwise(0)) + points(reviews, REVIEW_POINTS)
        + one(present(c["company_size"]), 3) + one(present(c["hourly_rate"]), 2) + source
        + one(present(c["address"]), 2) + one(present(c["min_project"]), 2) + one(present(c["facebook"]) | present(c["instagram"]), 1)
        + one(premium, 5) + one(c["is_enterprise"], 3)
    )
    return F.least(F.lit(100), total).cast("int")


def tier(s: Column) -> Column:
    out = None
    for least, name in TIERS:
        out = F.when(s >= least, name) if out is None else out.when(s >= least, name)
    return out.otherwise("D")


def name_confidence(wanted: Column, found: Column) -> Column:
    """1 for equal names, 0.7 where one holds the other, else 0.3."""
    a, b = F.lower(F.trim(wanted)), F.lower(F.trim(found))
    return F.when(missing(a) | missing(b), 0.3).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).otherwise(0.3)
