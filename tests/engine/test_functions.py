import pytest
from pyspark.sql import functions as F

from prospectrum.functions import rules, text


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("url", ["http://acme.com", "https://www.acme.com/", "HTTPS://WWW.ACME.COM", "https://acme.com/contact?ref=footer", " acme.com?x "])
def test_site_key(spark, url):
    assert one(spark, text.site_key, url) == "acme.com"


def test_name_key(spark):
    for name in ("Acme, LLC", "Acme Pvt Ltd", "ACME Corp.", "Acme  Corporation"):
        assert one(spark, text.name_key, name) == "acme"
    assert one(spark, text.name_key, "écoco éco") == "écoco é"  # only ASCII letters make a word


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Acme &amp; Co<br>x", "Acme & Co x"), ("a%20b+c", "a b+c"), ("100% sure", "100% sure"), ("%E2%82", "%E2%82"), ("x  \t y ", "x y"),
        ("&#8211;&#x2013;&unknown;", "––&unknown;"), (" &NBSP;a", "a"), ("", ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text, raw) == clean


def test_clean_email_phone_url(spark):
    assert one(spark, text.clean_email, " %20Info@Acme.COM ") == "info@acme.com"
    assert one(spark, text.clean_email, "no at sign") == ""
    assert one(spark, text.clean_emails, "A@x.com, b@x.com;a@x.com; bad") == "a@x.com; b@x.com"
    for p in ("N/A", "000", "+00", "none", "undefined"):
        assert one(spark, text.clean_phone, p) == ""
    assert one(spark, text.clean_phone, " +92  300 ") == "+92 300"
    assert one(spark, text.clean_url, " https://a.com/x y ") == "https://a.com/xy"
    assert one(spark, text.clean_url, " acme ") == "acme"


def test_numbers(spark):
    assert [one(spark, text.leading_number, x) for x in ("1,234", "4.7 stars", "x", "", None)] == [1, 4.7, 0, 0, 0]
    assert [one(spark, rules.employee_count, x) for x in ("50 - 249", "1,000+", "unknown", "", None)] == [150, 1000, None, None, None]
    assert [one(spark, rules.hourly_floor, x) for x in ("$25 - $49 / hr", "$150+", "")] == [25, 150, None]
    assert [one(spark, lambda c: rules.size_band(c.try_cast("int")), x) for x in ("1", "10", "150", "500", "5000", None)] == ["solo", "small", "mid", "large", "enterprise", None]


def test_region(spark):
    got = [one(spark, rules.region, a, q) for a, q in (("Shop 1, Dubai", None), (None, "software house Karachi"), ("", ""), ("Toronto, Canada, Dubai", ""))]
    assert got == ["middle-east", "south-asia", None, "north-america"]


def test_words_are_not_substrings(spark):
    hits = lambda c: rules.slugs(rules.hits(F.lower(c), rules.TAXONOMY, words=True))
    assert one(spark, hits, "An ambient and ambitious kettle") == []
    assert one(spark, hits, "HairSense Asad Enterprises Ismail Estate") == []
    assert one(spark, hits, "estate agents") == ["real-estate"] == one(spark, hits, "estate agent")
    assert one(spark, hits, "web / seo / ppc / digital marketing") == ["digital-marketing", "web-development"]


def test_haystack_ignores_blobs(spark):
    hay = lambda u: rules.haystack(F.lit("Hospital"), F.lit(None).cast("string"), F.lit(""), F.lit("https://www.a-b.com"), u)
    assert one(spark, hay, "https://maps.x/General/data=!4m7") == "hospital a b com"
    assert one(spark, hay, "https://clutch.co/profile/acme-web-agency") == "hospital a b com acme web agency"


def test_name_confidence(spark):
    assert [one(spark, rules.name_confidence, a, b) for a, b in (("Acme", "acme "), ("Acme", "Acme Labs"), ("Acme", "Other"), ("", "x"))] == [1.0, 0.7, 0.3, 0.3]


def test_automaton_equals_patterns():
    """One pass finds the keywords that a pattern each finds, on texts made of keywords, letters and marks."""
    import random
    import re

    rng = random.Random(1)
    keywords = ("ai", "data", "cloud data", "c++", ".net", "s", "as", "e-commerce", "data s", "it services", "ß", "1c")
    bits = [*keywords, " ", " ", "-", "s", "ss", "x", ".", "é", "9"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        words = {i for i, k in enumerate(keywords) if re.search(rules.word_pattern(k), t)}
        assert rules.found_keywords(t, keywords, True) == words, t
        assert rules.found_keywords(t, keywords, False) == {i for i, k in enumerate(keywords) if k in t}


def test_hits_of_nulls_and_ties(spark):
    from prospectrum.functions.rules import Vocabulary, hits

    v = Vocabulary.of({"a": "x|yy", "b": "yy|zz", "c": "q"})
    rows = spark.createDataFrame([(1, "yy"), (2, None), (3, ""), (4, "zz yys x x"), (5, "none")], "i int, t string")
    got = {r.i: r.h if r.h is None else [tuple(x) for x in r.h] for r in rows.select("i", hits(F.col("t"), v, True).alias("h")).collect()}
    assert got == {1: [(-1, 0, "a"), (-1, 1, "b")], 2: None, 3: [], 4: [(-2, 0, "a"), (-2, 1, "b")], 5: []}
    none = rows.select("i", hits(F.col("t"), Vocabulary(()), True).alias("h")).collect()
    assert {r.i: r.h for r in none} == {1: [], 2: None, 3: [], 4: [], 5: []}
