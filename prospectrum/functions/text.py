"""Cleaning of scraped strings, as Column expressions. A missing value is null or the empty string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named HTML entities that are decoded, legal forms that names lose.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»"}
LEGAL_FORMS = ["inc", "incorporated", "llc", "l\\.l\\.c", "ltd", "limited", "corp", "corporation", "co", "company", "pvt", "private", "fz-llc", "fze", "llp", "plc", "gmbh", "sa", "srl", "pty"]
# The patterns that decide what is an address and what stands for no phone number.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,}$"
PLACEHOLDER_PHONE = r"(?i)^(\+?0+|n/?a|none|null|undefined)$"
ASCII_EDGE = "(?<![A-Za-z0-9_])(?:{})\\.?(?![A-Za-z0-9_])"


def missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def present(c: Column) -> Column:
    return ~missing(c)


def truthy(c: Column, kind: str) -> Column:
    """What counts as filled: arrays and timestamps when not null, false and 0 and '' do not."""
    if kind == "string":
        return present(c)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("int", "bigint", "long", "double", "float"):
        return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    return c.isNotNull()


def trim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def url_decoded(c: Column) -> Column:
    """Percent escapes decoded; unchanged where one is malformed or no UTF-8; a plus stays."""
    return let(c, _url_decoded)


def _url_decoded(c: Column) -> Column:
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bad = out.isNull() | (F.contains(out, F.lit("�")) & ~F.contains(c, F.lit("�")))
    return F.when(F.contains(c, F.lit("%")) & ~bad, out).otherwise(c)


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def _code_points(c: Column, pattern: str, base: int) -> Column:
    """Numeric character references as the character of their low 16 bits."""

    def one(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, pattern, 1)
        number = F.conv(digits, base, 10).cast("decimal(20,0)") % 65536
        char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 4, "0")), "UTF-16BE")
        return F.replace(acc, ref, char)

    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.when(F.contains(c, F.lit("&#")), F.aggregate(refs, c, one)).otherwise(c)


def entities_decoded(c: Column) -> Column:
    for name, char in ENTITIES.items():
        if name.startswith("&#"):
            continue
        c = F.regexp_replace(c, f"(?i){name}", char)
    c = let(c, lambda x: _code_points(x, r"&#(\d+);", 10))
    return let(c, lambda x: _code_points(x, r"(?i)&#x([0-9a-f]+);", 16))


def clean_text(c: Column) -> Column:
    out = entities_decoded(without_tags(url_decoded(c)))
    return F.coalesce(trim(F.regexp_replace(out, r"(?U)\s+", " ")), F.lit(""))


def clean_email(c: Column) -> Column:
    s = F.regexp_replace(entities_decoded(without_tags(url_decoded(F.lower(trim(c))))), r"(?U)\s+", "")
    return let(s, lambda x: F.when(x.rlike(EMAIL), x).otherwise(F.lit("")))


def clean_emails(c: Column) -> Column:
    """A list in one string, split at ; and , cleaned, distinct, joined again."""
    parts = F.transform(F.split(c, "[;,]"), clean_email)
    return F.array_join(F.array_distinct(F.filter(parts, lambda e: e != "")), "; ")


def clean_phone(c: Column) -> Column:
    return let(clean_text(c), lambda s: F.when(s.rlike(PLACEHOLDER_PHONE), F.lit("")).otherwise(s))


def clean_url(c: Column) -> Column:
    """The URL without blanks and markup; the trimmed original where that is no URL."""
    s = F.regexp_replace(entities_decoded(without_tags(trim(c))), r"(?U)\s+", "")
    return let(s, lambda x: F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]+|[^/])"), x).otherwise(trim(c)))


def site_key(c: Column) -> Column:
    """A URL's host: no scheme, no www., nothing from the first slash or question mark on."""
    v = F.regexp_replace(F.lower(trim(c)), r"^https?://", "")
    return F.split_part(F.split_part(F.regexp_replace(v, r"^www\.", ""), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def name_key(c: Column) -> Column:
    v = F.translate(F.lower(trim(c)), ".,", "")
    v = F.regexp_replace(v, "(?i)" + ASCII_EDGE.format("|".join(LEGAL_FORMS)), "")
    return trim(F.regexp_replace(v, r"(?U)\s+", " "))


def dedupe_key(website: Column, name: Column) -> Column:
    """Null where neither gives a key."""
    return F.coalesce(F.nullif(site_key(website), F.lit("")), F.nullif(name_key(name), F.lit("")))


def leading_number(c: Column) -> Column:
    """The number a string begins with, else 0: '4.7 stars' is 4.7, '1,234' is 1."""
    return F.coalesce(F.regexp_extract(trim(c.cast("string")), r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)", 0).try_cast("double"), F.lit(0.0))
