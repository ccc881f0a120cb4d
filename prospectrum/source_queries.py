"""Parsers of captured pages bound to the driver's suppliers: a page for each, in a directory's form, and SQL that gives
the rows straight from the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.runtime import table
from prospectrum.sources import directories as d

KEY, NATION = "{s_suppkey}", "{s_nationkey}"
SITE = "https://firm{s_suppkey}.example/home"
NOISE = "<nav><a href='/companies/x'>menu</a></nav>"

PAGES = {
    "clutch": '<div class="provider row" data-title="{s_name}"><h3 class="t">x</h3><a class="b" href="https://r.clutch.co/redirect?a=1&amp;u=https%3A%2F%2Ffirm{s_suppkey}.example%2Fhome%3Fq%3D1">Visit</a><a class="provider__title-link" href="/profile/{s_suppkey}">p</a><span class="sg-rating__number">4.{s_nationkey}</span><a class="sg-rating__reviews">{s_nationkey} reviews</a><div class="provider__highlights-item location"><div>Location</div> <div>Town {s_nationkey}</div></div><span class="employees-count">Employees 10 - 49</span></div>',
    "goodfirms": '<ul><li class="firm-wrapper big" entity-name="{s_name}"><a class="visit-website" href="' + SITE + '?utm=1">w</a><a class="visit-profile" href="/c/{s_suppkey}">{s_nationkey} Reviews</a><span class="rating-number">4.5</span><ul class="firm-pricing"><li>$25 - $49<ul><li>/hr</ul><li>10 - 49<li>Town {s_nationkey}, Land</ul></ul>',
    "topdevelopers": '<div class="comp_main_box new_company_listing" itemid="/c/{s_suppkey}"><h3 class="comp_title"><a itemprop="url" href="' + SITE + '?x=1"><span itemprop="name">{s_name}</span></a></h3><input class="ratingInput" value="4.{s_nationkey}"><div class="inputDiv"><span>{s_nationkey} reviews</span></div><ul class="company_reviews"><li><div class="set_es_p"><div>10</div> - <div>49</div></div><li><p class="set_es_p">$25<li><i>least</i><li><p class="set_es_p">Town {s_nationkey}</ul></div>',
    "designrush": '<article class="js-agency-item" data-agency-name="{s_name}" data-gtm-agency-category="web-design"><a class="gtm-agency-website-link" href="' + SITE + '?x=1">w</a><a class="gtm-agency-profile-link" href="/a/{s_suppkey}">p</a><div class="rate"><div>of 5</div><strong>4.1</strong> <small>({s_nationkey} reviews)</small></div></article>',
    "selectedfirms": '<div class="listing_box_wpr"><a class="website-click" href="' + SITE + '?x=1"> {s_name} </a><a class="profile-click" href="/f/{s_suppkey}">p</a><div class="company-rating"><span>4.2</span></div>View all {s_nationkey} Reviews<div class="in-point people"><div></div><span class="bm-text">10 <span>-</span> 49</span></div><div class="in-point location"><span class="bm-text">Town {s_nationkey}</span></div></div>',
    "techbehemoths": '<article class="co-box"><p class="co-box__name">{s_name} Verified Company</p><a href="/company/f{s_suppkey}">more</a>{inline}<a href="/companies/town">Town {s_nationkey}</a><a href="/companies/land">Land</a></article>',
    "pseb": '<section><div class="tech-company-profile"><div class="tech-api-profile"><div><div>x</div></div><h4 class="name">{s_name}</h4><a href="' + SITE + '">w</a><p class="location">Town {s_nationkey}</p></div></div><div class="tech-user-profile"><div class="tech-api-profile"><h4 class="name">Dev {s_suppkey}</h4><div class="View-Profile"><a href="https://www.linkedin.com/in/d{s_suppkey}">v</a></div><p class="location">Town</p></div><div class="tech-api-profile"><h4 class="name">No link</h4></div></div></section>',
    "sortlist": '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"data": {"organicAgencies": {"included": [{"id": "{s_suppkey}", "type": "agency", "attributes": {"name": "{s_name}", "website_url": "' + SITE + '", "address": {"en": "Town {s_nationkey}"}, "reviews_count": {s_nationkey}, "team_size": 12, "slug": "f{s_suppkey}"}}, {"id": "x{s_suppkey}", "type": "ad"}]}, "paidAgencies": {"included": [{"id": "{s_suppkey}", "type": "agency", "attributes": {"name": "again"}}]}}}}}</script>',
    "eventbrite": '<script>window.__SERVER_DATA__ = {"search_data": {"events": {"results": [{"name": "e } \\" f", "primary_organizer_id": "{s_suppkey}", "primary_venue": {"address": {"localized_address_display": "Town {s_nationkey}"}}, "tags": []}, {"name": "later", "primary_organizer_id": "{s_suppkey}"}]}}}; window.x = {"search_data": {"y": "{"}};</script>',
    "google_maps": '[{"name": "{s_name}", "url": "/m/{s_suppkey}", "category": "clinic", "website": "' + SITE + '", "phone": "Phone: +{s_nationkey}", "address": "Address: Town {s_nationkey}", "rating": "4.3", "reviews": "({s_nationkey})"}, {"name": ""}]',
    "github_orgs": '{"login": "l{s_suppkey}", "name": "{s_name}", "blog": "firm{s_suppkey}.example/home", "email": "bad@", "public_repos": {s_nationkey}, "html_url": "/g/{s_suppkey}"}',
    "opencorporates": '{"results": {"companies": [{"company": {"name": "{s_name}", "company_type": null, "registered_address_in_full": "Town {s_nationkey}", "opencorporates_url": "/o/{s_suppkey}"}}]}}',
}
#: Sources whose pages have two cards.
TWICE = ("clutch", "goodfirms", "topdevelopers", "designrush", "selectedfirms")
COMPANY = '<body><h1 id="company_name">{s_name}<b> plc</b></h1><div class="text phone"><div>+{s_nationkey}</div></div><div id="company_address">Town {s_nationkey}</div>'
DATA = '<script type="application/ld+json">[{"@type": "x"}, {"name": "{s_name} Ltd", "telephone": "", "url": "https://firm{s_suppkey}.example/home", "address": {"streetAddress": "{s_nationkey} Street", "addressRegion": "North"}}]</script>'
ORGANIZER = '<meta property="og:title" content="{s_name}"><div class="x socialBlock"><ul><a href="https://www.facebook.com/f{s_suppkey}">f</a><a href="' + SITE + '">w</a></ul></div><a href="https://other.example">o</a>'
PROFILE = '<a class="b" href="' + SITE + '?p=1"><b>Visit website</b></a><a href="tel:1"> +{s_nationkey} </a>'
INLINE = '<a href="' + SITE + '?x=1">Visit website</a>'
RESULTS = '<a href="https://news.example/{s_suppkey}">n</a><a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fwww.clutch.co%2Fp{s_suppkey}&rut=1">r</a><a href="https://goodfirms.co/2">g</a>'
OUTBOUND = '<a href="https://clutch.co/x">own</a><a href="https://www.linkedin.com/company/x">li</a><a href="' + SITE + '?x=1">site</a><a href="https://later.example">l</a>'
FOOTER = '<a href="/about">top</a><footer><a href="/contact?x=1">c</a><a href="https://firm.example/Team{s_suppkey}#a">t</a><a href="/contact">c</a><a href="/blog">b</a></footer>'


def filled(pattern: str) -> Column:
    out = F.lit(pattern)
    for c in ("s_name", "s_suppkey", "s_nationkey"):
        out = F.replace(out, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return out


def pages(spark: SparkSession, sf: str, name: str, column: str = "html", other: str = "Other ") -> DataFrame:
    """A page for each supplier. The name of its second card, where it has one, begins with other; '' repeats the first."""
    body = PAGES[name] if column == "payload" else NOISE + PAGES[name]
    if name in TWICE:  # a second card, the same but for its name
        body += PAGES[name].replace("{s_name}", other + "{s_name}")
    html = F.replace(filled(body), F.lit("{inline}"), F.when(F.col("s_suppkey") % 2 == 0, filled(INLINE)).otherwise(F.lit("")))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), html.alias(column))


def _of(name: str, parse: Callable[..., DataFrame], column: str = "html") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return parse(pages(spark, sf, name, column)).drop("ord")

    return run


def _eventbrite(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("organizer_id"), filled(ORGANIZER).alias("html"))
    return d.eventbrite(pages(spark, sf, "eventbrite"), own).drop("ord")


def _techbehemoths(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("/company/f"), F.col("s_suppkey").cast("string")).alias("url"), filled(PROFILE).alias("html"))
    return d.techbehemoths(pages(spark, sf, "techbehemoths"), own).drop("ord")


def _profile_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", d.profile_hit(filled(RESULTS), ("clutch.co", "goodfirms.co")).alias("profile"), d.outbound_link(filled(OUTBOUND), "clutch.co").alias("website"), F.array_join(d.footer_paths(filled(FOOTER)), ";").alias("paths"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    hit = lambda n, host, sure: s.where(F.col("s_suppkey") % n == 0).select("name", F.concat(F.lit(f"https://{host}/"), F.col("s_suppkey").cast("string")).alias("website"), F.lit("").alias("profile_url"), F.lit(sure).alias("confidence"))
    return d.resolved(s.select("name"), ("maps", hit(2, "m.example", 0.7)), ("orgs", hit(3, "o.example", 1.0)))


def _sql(**fields: str) -> str:
    own = {"name": "s_name", "category": "'software developer'", "website": "'https://firm' || cast(s_suppkey as varchar) || '.example/home'"} | fields
    return "select " + ", ".join(f"{v} as {k}" for k, v in own.items()) + " from supplier"


def _two(**fields: str) -> str:
    return _sql(**fields) + " union all " + _sql(**fields | {"name": "'Other ' || s_name"})


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """A category page for each ten suppliers (page 4 of each category is empty, so page 5 isn't reached) and a page for each
    company, one in three with JSON-LD."""
    s = table(spark, sf, "supplier")
    nth = (F.col("s_suppkey") / 10).cast("long")
    category, number = F.concat(F.lit("cat-"), (nth % 3).cast("string")), (nth / 3).cast("long") + 1
    link = F.when((number != 4) & (F.col("s_suppkey") % 7 != 0), F.concat(F.lit("<li><a href='/company/"), F.col("s_suppkey").cast("string"), F.lit("/f?x'>f</a>"))).otherwise("")
    lists = s.select(F.concat(F.lit("https://list.example/category/"), category, F.when(number > 1, F.concat(F.lit("/"), number.cast("string"))).otherwise("")).alias("url"), link.alias("link")).groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("link")), "").alias("html"))
    own = s.select(F.concat(F.lit("https://list.example/company/"), F.col("s_suppkey").cast("string"), F.lit("/f?x")).alias("url"), F.concat(filled(COMPANY), F.when(F.col("s_suppkey") % 3 == 0, filled(DATA)).otherwise("")).alias("html"))
    return lists.unionByName(own).select(F.xxhash64("url").alias("ord"), "url", "html")


CRAWLED = """
with s as (select *, cast(floor(s_suppkey / 10) as bigint) as nth from supplier),
p as (select *, 'cat-' || cast(nth % 3 as varchar) as category, cast(floor(nth / 3) as bigint) + 1 as number from s)
select case when s_suppkey % 3 = 0 then s_name || ' Ltd' else s_name || ' plc' end as name, replace(category, '-', ' ') as category,
  case when s_suppkey % 3 = 0 then 'https://firm' || cast(s_suppkey as varchar) || '.example/home' else '' end as website, '+' || cast(s_nationkey as varchar) as phone,
  case when s_suppkey % 3 = 0 then cast(s_nationkey as varchar) || ' Street, North' else 'Town ' || cast(s_nationkey as varchar) end as address,
  'https://list.example/company/' || cast(s_suppkey as varchar) || '/f?x' as maps_url, category as search_query
from p where number < 4 and s_suppkey % 7 <> 0"""
K, N = "cast(s_suppkey as varchar)", "cast(s_nationkey as varchar)"
TOWN = f"'Town ' || {N}"
SOURCE_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "source_clutch": (_of("clutch", d.clutch), _two(address=TOWN, rating=f"'4.' || {N}", reviews=N, company_size="'10 - 49'", hourly_rate="''", min_project="''", maps_url=f"'/profile/' || {K}")),
    "source_goodfirms": (_of("goodfirms", d.goodfirms), _two(address=TOWN + " || ', Land'", rating="'4.5'", reviews=N, company_size="'10 - 49'", hourly_rate="'$25 - $49/hr'", maps_url=f"'/c/' || {K}")),
    "source_topdevelopers": (_of("topdevelopers", d.topdevelopers), _two(address=TOWN, rating=f"'4.' || {N}", reviews=N, company_size="'10 - 49'", hourly_rate="'$25'", min_project="''", maps_url=f"'/c/' || {K}")),
    "source_designrush": (_of("designrush", d.designrush), _two(category="'web design'", rating="'4.1'", reviews=N, maps_url=f"'/a/' || {K}")),
    "source_selectedfirms": (_of("selectedfirms", d.selectedfirms), _two(address=TOWN, rating="'4.2'", reviews=N, company_size="'10 - 49'", hourly_rate="''", min_project="''", maps_url=f"'/f/' || {K}")),
    "source_techbehemoths": (_techbehemoths, _sql(phone=f"case when s_suppkey % 2 = 0 then '' else '+' || {N} end", address=TOWN + " || ', Land'", maps_url=f"'/company/f' || {K}") + " where s_suppkey % 2 = 0 or s_suppkey % 3 <> 0"),
    "source_pseb": (_of("pseb", d.pseb), _sql(address=TOWN, linkedin="''") + " union all " + _sql(name=f"'Dev ' || {K}", category="'freelance tech professional'", website="''", address="'Town'", linkedin=f"'https://www.linkedin.com/in/d' || {K}")),
    "source_sortlist": (_of("sortlist", d.sortlist), _sql(address=TOWN, reviews=N, company_size="'12'", maps_url=f"'https://www.sortlist.com/agency/f' || {K}")),
    "source_eventbrite": (_eventbrite, _sql(category="'tech events / community'", address=TOWN, linkedin="''", facebook=f"'https://www.facebook.com/f' || {K}", instagram="''", maps_url=f"'https://www.eventbrite.com/o/' || {K}")),
    "source_businesslist": (lambda s, d_: d.directory_crawl(crawl(s, d_), "list.example").drop("ord"), CRAWLED),
    "source_google_maps": (_of("google_maps", d.google_maps, "payload"), _sql(category="'clinic'", phone=f"'+' || {N}", address=TOWN, rating="'4.3'", reviews=N, maps_url=f"'/m/' || {K}")),
    "source_github_orgs": (_of("github_orgs", d.github_orgs, "payload"), _sql(category="'software / open source'", email="''", address="''", reviews=N, maps_url=f"'/g/' || {K}")),
    "source_opencorporates": (_of("opencorporates", d.opencorporates, "payload"), "select s_name as name, 'registered company' as category, " + f"{TOWN} as address, '/o/' || {K} as maps_url from supplier"),
    "directory_links": (_profile_hits, f"select s_suppkey, 'https://www.clutch.co/p' || {K} as profile, 'https://firm' || {K} || '.example/home' as website, '/contact;/Team' || {K} as paths from supplier"),
    "resolved_firms": (_resolved, f"select s_name as name, case when s_suppkey % 2 = 0 then 'https://m.example/' || {K} when s_suppkey % 3 = 0 then 'https://o.example/' || {K} end as website, case when s_suppkey % 2 = 0 or s_suppkey % 3 = 0 then '' end as profile_url, case when s_suppkey % 2 = 0 then 'maps' when s_suppkey % 3 = 0 then 'orgs' end as strategy, case when s_suppkey % 2 = 0 then 0.7::double when s_suppkey % 3 = 0 then 1.0::double end as confidence from supplier"),
}
