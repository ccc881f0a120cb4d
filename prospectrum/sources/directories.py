"""Parsers of captured directory pages and API answers into raw leads.

Pages are rows (ord, html); their cards and fields are found by selectors in the page's element tree. Payloads are
rows (ord, payload). A lead's ord is its page's times PER_PAGE plus its place there. Missing values are ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.functions.rules import name_confidence
from prospectrum.functions.text import EMAIL, present, site_key, url_decoded
from prospectrum.operators.leads import first_seen
from prospectrum.runtime import ship
from prospectrum.sources.elements import balanced_after, cards, filled, first

PER_PAGE = 1_000_000
# Categories of sources that name none, networks that are no company's own site.
DEVELOPER, COMMUNITY, FREELANCE = "software developer", "tech events / community", "freelance tech professional"
OPEN_SOURCE, REGISTERED = "software / open source", "registered company"
SOCIAL = r"(?i)(^|\.)(linkedin\.com|facebook\.com|instagram\.com|twitter\.com|x\.com|youtube\.com|google\.com)$"
LINK = r"(?is)<a\b[^>]*?\shref=[\"']([^\"']+)"


def plain(c: Column) -> Column:
    """Text of markup, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"(?U)\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_extract(c, r"\d+", 0)


def no_query(c: Column) -> Column:
    return F.split_part(c, F.lit("?"), F.lit(1))


def pick(found: Column, nth: int = 0) -> Column:
    return F.coalesce(F.get(found, F.lit(nth)), F.lit(""))


def leads_of(rows: DataFrame, key: Column | None = None, **fields: Column) -> DataFrame:
    """Leads with a name, the first of each key (by default the name, in lower case)."""
    own = rows.select("ord", *(F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items())).where(present(F.col("name")))
    return first_seen(own, F.lower("name") if key is None else key)


def site(c: str) -> Column:
    return no_query(first(c))


def clutch(pages: DataFrame) -> DataFrame:
    """Cards with redirect links: the target is parameter u; the directory's own host is no website."""
    fields = {
        "title": ("", "data-title"), "heading": ("h3", "text"), "link": ('a[href*="r.clutch.co/redirect"]', "href"), "place": (".provider__highlights-item.location", "text"), "rating": (".sg-rating__number", "text"),
        "reviews": (".sg-rating__reviews", "text"), "size": (".employees-count", "text"), "rate": (".hourly-rate", "text"), "least": (".min-project-size", "text"), "profile": (".provider__title-link", "href"),
    }
    target = url_decoded(F.regexp_extract(first("link"), r"[?&]u=([^&#]*)", 1))
    cut = lambda c, label: F.regexp_replace(first(c), rf"(?i)^{label}\s*", "")
    return leads_of(
        cards(pages, ".provider", PER_PAGE, fields), name=F.coalesce(filled("title"), filled("heading")), category=F.lit(DEVELOPER), website=F.when(~site_key(target).rlike(r"clutch\.co"), no_query(target)), address=cut("place", "Location"),
        rating=first("rating"), reviews=F.regexp_replace(first("reviews"), "[^0-9]", ""), company_size=cut("size", "Employees"), hourly_rate=cut("rate", "Hourly rate"), min_project=cut("least", r"Min\.?\s*project size"), maps_url=first("profile"),
    )


def goodfirms(pages: DataFrame) -> DataFrame:
    """Highlights are told apart by their form: a price, a range of people, a place."""
    fields = {
        "title": ("", "entity-name"), "heading": (".firm-name", "text"), "link": ("a.visit-website", "href"), "profile": ("a.visit-profile", "href"), "reviews": (".visit-profile", "text"), "rating": (".rating-number", "text"),
        "points": (".firm-pricing li, .firm-practices li, .firm-highlights li", "text"), "place": (".firm-location", "text"),
    }
    which = lambda test: pick(F.filter("points", test))
    place = which(lambda h: F.contains(h, F.lit(",")) & ~F.contains(h, F.lit("$")))
    return leads_of(
        cards(pages, "li.firm-wrapper", PER_PAGE, fields), name=F.coalesce(filled("title"), filled("heading")), category=F.lit(DEVELOPER), website=site("link"), address=F.coalesce(F.nullif(place, F.lit("")), filled("place")),
        rating=first("rating"), reviews=digits(first("reviews")), company_size=which(lambda h: h.rlike(r"^\d[\d,]*\s*-\s*\d")), hourly_rate=which(lambda h: h.rlike(r"/\s*hr|\$\d")), maps_url=first("profile"),
    )


def topdevelopers(pages: DataFrame) -> DataFrame:
    """Highlights are known by place: size, hourly rate, least project, location."""
    link = 'h3.comp_title a[itemprop="url"]'
    fields = {
        "title": (f'{link} span[itemprop="name"]', "text"), "heading": (link, "text"), "link": (link, "href"), "item": ("", "itemid"), "profile": ("a.company_prof", "href"), "rating": (".ratingInput", "value"),
        "reviews": (".inputDiv span", "text"), "points": (".company_reviews li", "text:.set_es_p"),
    }
    return leads_of(
        cards(pages, ".comp_main_box.new_company_listing", PER_PAGE, fields), name=F.coalesce(filled("title"), first("heading")), category=F.lit(DEVELOPER), website=site("link"), address=pick(F.col("points"), 3), rating=first("rating"),
        reviews=digits(first("reviews")), company_size=pick(F.col("points")), hourly_rate=pick(F.col("points"), 1), min_project=pick(F.col("points"), 2), maps_url=F.coalesce(filled("item"), first("profile")),
    )


def designrush(pages: DataFrame) -> DataFrame:
    fields = {
        "title": ("", "data-agency-name"), "heading": (".item-title", "text"), "kind": ("", "data-gtm-agency-category"), "service": (".js-item-services-item span", "text"), "link": ("a.gtm-agency-website-link", "href"),
        "profile": ("a.gtm-agency-profile-link", "href"), "rating": (".rate strong", "text"), "reviews": (".rate small", "text"),
    }
    return leads_of(
        cards(pages, "article.js-agency-item", PER_PAGE, fields), name=F.coalesce(filled("title"), filled("heading")), category=F.coalesce(F.nullif(first("service"), F.lit("")), F.nullif(F.replace(first("kind"), F.lit("-"), F.lit(" ")), F.lit("")), F.lit(DEVELOPER)),
        website=site("link"), rating=first("rating"), reviews=digits(first("reviews")), maps_url=first("profile"),
    )


def selectedfirms(pages: DataFrame, category: str = DEVELOPER) -> DataFrame:
    points = {"size": "people", "place": "location", "rate": "rate", "least": "purse"}
    fields = {"title": ("a.website-click", "text"), "link": ("a.website-click", "href"), "profile": ("a.profile-click", "href"), "rating": (".company-rating span, .review-text span", "text"), "all": ("", "text")}
    return leads_of(
        cards(pages, ".listing_box_wpr", PER_PAGE, fields | {n: (f".in-point.{css} .bm-text", "text") for n, css in points.items()}), name=first("title"), category=F.lit(category), website=site("link"), address=first("place"), rating=first("rating"),
        reviews=F.regexp_extract(first("all"), r"(?i)View all\s*(\d+)\s*Reviews?", 1), company_size=first("size"), hourly_rate=first("rate"), min_project=first("least"), maps_url=first("profile"),
    )


def visit_link() -> Column:
    """The address of the first link that says 'visit website', without its query; links and words are those of a[href]."""
    said = F.filter(F.arrays_zip("links", "words"), lambda x: x["words"].rlike("(?i)visit website"))
    return no_query(F.coalesce(F.get(said, F.lit(0))["links"], F.lit("")))


def techbehemoths(pages: DataFrame, profiles: DataFrame | None = None, category: str = DEVELOPER, visits: int = 15) -> DataFrame:
    """Cards with a website, on the card or on their profile (url, html): the first profiles of each page count, as many
    as visits. Cards without either go."""
    links = {"links": ("a[href]", "href"), "words": ("a[href]", "text")}
    fields = links | {"title": (".co-box__name", "text"), "profile": ('a[href*="/company/"]', "href"), "places": ('a[href^="/companies/"]', "text")}
    name = F.trim(F.regexp_replace(first("title"), "(?i)Verified Company", ""))
    places = F.filter("places", lambda x: x != "")
    rows = cards(pages, "article.co-box", PER_PAGE, fields).select("ord", name.alias("name"), visit_link().alias("website"), first("profile").alias("maps_url"), F.array_join(F.slice(places, 1, 2), ", ").alias("address")).where(present(F.col("name")))
    if profiles is None:
        rows = rows.withColumn("phone", F.lit(""))
    else:
        seen = profiles.groupBy(F.col("url").alias("maps_url")).agg(F.min("html").alias("html"))
        # Few cards lack a website, so the profiles to read are picked before the join: an array per page keeps their order.
        lacking = rows.where((F.col("website") == "") & (F.col("maps_url") != "")).groupBy(F.floor(F.col("ord") / PER_PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("ord", "maps_url"))).alias("todo"))
        todo = lacking.select(F.inline(F.slice("todo", 1, visits))).join(seen, "maps_url").select("ord", "html")
        read = cards(todo, "", 1, links | {"tel": ('a[href^="tel:"]', "text")}).select("ord", visit_link().alias("_site"), first("tel").alias("_phone"))
        rows = rows.join(read, "ord", "left").select("ord", "name", F.coalesce(F.nullif("website", F.lit("")), "_site", F.lit("")).alias("website"), "maps_url", "address", F.coalesce("_phone", F.lit("")).alias("phone"))
    rows = rows.where(present(F.col("website")))
    return leads_of(rows, name=F.col("name"), category=F.lit(category), website=F.col("website"), phone=F.col("phone"), address=F.col("address"), maps_url=F.col("maps_url"))


def pseb(pages: DataFrame) -> DataFrame:
    """Companies first, then freelancers, who need a LinkedIn page."""
    fields = {"title": (".name", "text"), "link": ('a[href^="http"]', "href"), "profile": (".View-Profile a", "href"), "place": (".location", "text"), "skills": (".ecperties-overflow div", "text")}

    def part(box: str, other: str, later: int, **own: Column) -> DataFrame:
        rows = cards(pages, f"{box} .tech-api-profile", PER_PAGE, fields)
        return rows.select((F.col("ord") + later).alias("ord"), first("title").alias("name"), F.coalesce(filled("skills"), F.lit(other)).alias("category"), first("place").alias("address"), *(c.alias(n) for n, c in own.items()))

    firms = part(".tech-company-profile", DEVELOPER, 0, website=first("link"), linkedin=F.lit(""))
    people = part(".tech-user-profile", FREELANCE, PER_PAGE // 2, website=F.lit(""), linkedin=first("profile")).where(F.contains("linkedin", F.lit("linkedin.com")))
    key = F.lower(F.coalesce(F.nullif("website", F.lit("")), F.nullif("linkedin", F.lit("")), "name"))
    return leads_of(firms.unionByName(people), key, **{n: F.col(n) for n in ("name", "category", "website", "address", "linkedin")})


# Pages of a crawled directory, and where a company's page has what its JSON-LD lacks.
CATEGORY_PAGE, COMPANY_PAGE = r"/category/([^/?#]+)(?:/(\d+))?/?(?:[?#].*)?$", r"/company/\d+/"
FALLBACK = {"title": ("#company_name", "text"), "tel": (".text.phone", "text"), "place": ("#company_address", "text"), "data": ('script[type="application/ld+json"]', "text")}


def category_links(pages: DataFrame, most: int = 10) -> DataFrame:
    """(path, category, nth) of the companies that category pages (url, html) link to: pages up to most of a category, as
    far as each before has links; a company belongs to the category and page that link to it first, by nth and name."""
    number = F.coalesce(F.nullif(F.regexp_extract("url", CATEGORY_PAGE, 2), F.lit("")).cast("int"), F.lit(1))
    own = pages.where(F.col("url").rlike(CATEGORY_PAGE)).select(F.lit(0).alias("ord"), F.regexp_extract("url", CATEGORY_PAGE, 1).alias("category"), number.alias("nth"), "html").where(F.col("nth") <= most)
    found = cards(own, "", 1, {"links": ('a[href*="/company/"]', "href")}).groupBy("category", "nth").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    reached = found.where(F.size("links") > 0).groupBy("category").agg(F.array_sort(F.collect_set("nth")).alias("with_links")).select("category", F.expr("1 + coalesce(element_at(filter(with_links, (n, i) -> n = i + 1), -1), 0)").alias("reach"))
    links = found.join(reached, "category").where(F.col("nth") <= F.col("reach")).select("category", "nth", F.explode("links").alias("link")).where(F.col("link").rlike(COMPANY_PAGE))
    return links.groupBy(F.regexp_replace("link", "(?i)^https?://[^/]*", "").alias("path")).agg(F.min(F.struct("nth", "category")).alias("x")).select("path", "x.category", "x.nth")


def directory_crawl(pages: DataFrame, domain: str, most: int = 10) -> DataFrame:
    """Leads of a crawl (ord, url, html) of category and company pages: a company's JSON-LD counts (the first block with a
    name), and selectors fill what it lacks; the directory's own addresses are no website. Companies that no category
    page links to are left out, as a crawl doesn't come to them."""
    linked = category_links(pages, most)
    company = pages.where(F.col("url").rlike(COMPANY_PAGE)).select("ord", "url", F.regexp_replace("url", "(?i)^https?://[^/]*", "").alias("path"), "html").join(linked, "path")
    kind = "array<struct<name: string, telephone: string, url: string, address: struct<streetAddress: string, addressLocality: string, addressRegion: string>>>"
    read = F.transform("data", lambda t: F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), kind))
    named = F.filter(F.flatten(F.filter(read, lambda x: x.isNotNull())), lambda x: present(x["name"]))
    rows = cards(company, "", 1, FALLBACK).withColumn("x", F.get(named, F.lit(0)))
    parts = F.concat_ws(", ", *(F.nullif(F.col(f"x.address.{k}"), F.lit("")) for k in ("streetAddress", "addressLocality", "addressRegion")))
    or_else = lambda c, field: F.coalesce(F.nullif(F.trim(c), F.lit("")), first(field))
    site_url = F.trim("x.url")
    return leads_of(
        rows, F.col("maps_url"), name=or_else(F.col("x.name"), "title"), category=F.replace("category", F.lit("-"), F.lit(" ")), website=F.when(~F.contains(site_url, F.lit(domain)), site_url), phone=or_else(F.col("x.telephone"), "tel"),
        address=or_else(parts, "place"), maps_url=F.col("url"), search_query=F.col("category"),
    )


def sortlist(pages: DataFrame, category: str = DEVELOPER) -> DataFrame:
    """Agencies of a page's embedded JSON, organic before paid, the first of each id."""
    kind = "array<struct<id: string, type: string, attributes: struct<name: string, website_url: string, website: string, address: map<string, string>, reviews_count: string, team_size: string, slug: string>>>"
    body = F.regexp_extract("html", r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    part = lambda which: F.coalesce(F.from_json(F.get_json_object("j", f"$.props.pageProps.data.{which}.included"), kind), F.array().cast(kind))
    found = pages.select("ord", body.alias("j")).select("ord", F.posexplode(F.concat(part("organicAgencies"), part("paidAgencies"))).alias("nth", "x")).where("x.type = 'agency'")
    a = F.col("x.attributes")
    rows = found.select(
        (F.col("ord") * PER_PAGE + F.col("nth")).alias("ord"), F.col("x.id").alias("id"), a["name"].alias("name"), F.coalesce(F.nullif(a["website_url"], F.lit("")), a["website"], F.lit("")).alias("website"),
        F.coalesce(F.nullif(a["address"]["en"], F.lit("")), F.get(F.map_values(a["address"]), F.lit(0)), F.lit("")).alias("address"), a["reviews_count"].alias("reviews"), a["team_size"].alias("company_size"),
        F.when(present(a["slug"]), F.concat(F.lit("https://www.sortlist.com/agency/"), a["slug"])).alias("maps_url"),
    )
    own = first_seen(rows, F.col("id")).where(present(F.col("name")))
    return own.select("ord", "name", F.lit(category).alias("category"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("website", "address", "reviews", "company_size", "maps_url")))


def eventbrite(pages: DataFrame, organizers: DataFrame) -> DataFrame:
    """Organizers of the events in pages (the balanced object after __SERVER_DATA__), each once, with the links of their
    own page (organizer_id, html)."""
    ship(pages.sparkSession)
    kind = "search_data struct<events: struct<results: array<struct<name: string, primary_organizer_id: string, primary_venue: struct<name: string, address: struct<localized_address_display: string>>, tags: array<struct<display_name: string>>>>>>"
    data = F.from_json("data", kind)
    e = pages.select("ord", balanced_after(F.col("html"), "window.__SERVER_DATA__").alias("data")).select("ord", F.posexplode(data["search_data"]["events"]["results"]).alias("nth", "e")).where(present(F.col("e.primary_organizer_id")))
    topic = pick(F.filter(F.transform("e.tags", lambda t: t["display_name"]), present))
    events = first_seen(e.select((F.col("ord") * PER_PAGE + F.col("nth")).alias("ord"), F.col("e.primary_organizer_id").alias("organizer_id"), F.coalesce(F.nullif(topic, F.lit("")), F.lit(COMMUNITY)).alias("category"), F.col("e.primary_venue.address.localized_address_display").alias("address")), F.col("organizer_id"))
    own = organizers.select(F.lit(0).alias("ord"), F.col("organizer_id").cast("string").alias("organizer_id"), "html")
    found = cards(own, "", 1, {"meta": ('meta[property="og:title"]', "content"), "title": ("title", "text"), "links": ('[class*="socialBlock"] a[href]', "href")})
    page = found.select("organizer_id", F.coalesce(filled("meta"), first("title")).alias("name"), "links").dropDuplicates(["organizer_id"])
    to = lambda host: pick(F.filter("links", lambda h: h.rlike(host)))
    other = pick(F.filter("links", lambda h: ~h.rlike(r"(?i)facebook\.com|instagram\.com|twitter\.com|x\.com|linkedin\.com|eventbrite\.")))
    rows = events.join(page, "organizer_id").where("name <> 'Organizer'")
    return leads_of(rows, F.concat(F.lit("o"), "maps_url"), name=F.col("name"), category=F.col("category"), website=other, address=F.col("address"), linkedin=to(r"(?i)linkedin\.com"), facebook=to(r"(?i)facebook\.com"), instagram=to(r"(?i)instagram\.com"), maps_url=F.concat(F.lit("https://www.eventbrite.com/o/"), "organizer_id"))


def google_maps(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """Places of a search's capture (a JSON list); labels and parentheses are cut off."""
    kind = "array<struct<name: string, url: string, category: string, website: string, phone: string, address: string, rating: string, reviews: string>>"
    found = F.from_json("payload", kind)
    x = payloads.select("ord", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("nth", "x")).where(present(F.col("x.name")))
    cut = lambda c, label: F.trim(F.regexp_replace(F.col(f"x.{c}"), rf"^{label}:\s*", ""))
    rows = {"name": F.col("x.name"), "category": F.trim("x.category"), "website": F.col("x.website"), "phone": cut("phone", "Phone"), "address": cut("address", "Address"), "rating": F.trim("x.rating"), "reviews": F.trim(F.translate("x.reviews", "()", "")), "maps_url": F.col("x.url")}
    return x.select((F.col("ord") * PER_PAGE + F.col("nth")).alias("ord"), *(F.coalesce(c, F.lit("")).alias(n) for n, c in rows.items()))


def github_orgs(payloads: DataFrame, location: str = "") -> DataFrame:
    """An organization's answer a row; its number of repositories stands for reviews."""
    o = payloads.select("ord", F.from_json("payload", "login string, name string, blog string, email string, location string, public_repos string, html_url string").alias("o"))
    g = lambda c: F.nullif(F.col(f"o.{c}"), F.lit(""))
    site = F.when(g("blog").rlike(r"^https?://"), g("blog")).otherwise(F.concat(F.lit("https://"), g("blog")))
    rows = {"name": F.coalesce(g("name"), g("login")), "category": F.lit(OPEN_SOURCE), "website": site, "email": F.when(g("email").rlike(EMAIL), g("email")), "address": F.coalesce(g("location"), F.lit(location)), "reviews": g("public_repos"), "maps_url": g("html_url")}
    return o.select((F.col("ord") * PER_PAGE).alias("ord"), *(F.coalesce(c, F.lit("")).alias(n) for n, c in rows.items())).where(present(F.col("name")))


def opencorporates(payloads: DataFrame, most: int = 30) -> DataFrame:
    kind = "results struct<companies: array<struct<company: struct<name: string, company_type: string, registered_address_in_full: string, opencorporates_url: string>>>>"
    x = payloads.select("ord", F.posexplode(F.slice(F.from_json("payload", kind)["results"]["companies"], 1, most)).alias("nth", "x")).select((F.col("ord") * PER_PAGE + F.col("nth")).alias("ord"), "x.company.*")
    rows = {"name": F.col("name"), "category": F.coalesce(F.nullif("company_type", F.lit("")), F.lit(REGISTERED)), "address": F.col("registered_address_in_full"), "maps_url": F.col("opencorporates_url")}
    return x.select("ord", *(F.coalesce(c, F.lit("")).alias(n) for n, c in rows.items()))


# Finding one firm's site.


def profile_hit(html: Column, hosts: tuple[str, ...]) -> Column:
    """The first link of a page of search results that leads to a directory; redirects (uddg) are unwrapped. '' for none."""
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda h: F.coalesce(url_decoded(F.nullif(F.regexp_extract(h, r"uddg=([^&]+)", 1), F.lit(""))), h))
    known = "|".join(h.replace(".", r"\.") for h in hosts)
    return pick(F.filter(links, lambda h: site_key(h).rlike(rf"(^|\.)({known})$")))


def outbound_link(html: Column, directory_host: str) -> Column:
    """The first link out of a directory's page that is no social network's, without its query. '' for none."""
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda h: h.rlike("(?i)^https?://"))
    own = directory_host.replace(".", r"\.")
    return no_query(pick(F.filter(links, lambda h: present(site_key(h)) & ~site_key(h).rlike(rf"(^|\.){own}$") & ~site_key(h).rlike(SOCIAL))))


def footer_paths(html: Column) -> Column:
    """Paths in a page's footer that look like contact, about, team, leadership or company pages, each once, in order."""
    footer = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)(<footer\b.*?</footer>)"), F.lit(1)), " ")
    paths = F.transform(F.regexp_extract_all(footer, F.lit(LINK), F.lit(1)), lambda h: F.regexp_replace(F.regexp_replace(h, r"(?i)^https?://[^/?#]*", ""), r"[?#].*$", ""))
    return F.array_distinct(F.filter(paths, lambda p: p.rlike(r"(?i)^/?[^:]*(contact|about|team|leadership|company)")))


def github_by_name(searches: DataFrame, organisations: DataFrame) -> DataFrame:
    """A strategy's table (name, website, profile_url, confidence) from captured organisation searches (name, payload)
    and the organisations' own answers (payload): the first hit of a search counts, if its organisation has a site."""
    kind = "items array<struct<login: string>>"
    first = searches.select("name", F.lower(F.get(F.from_json("payload", kind)["items"], F.lit(0))["login"]).alias("login")).where("login is not null")
    own = organisations.select(F.from_json("payload", "login string, name string, blog string, html_url string").alias("o")).select(F.lower("o.login").alias("login"), F.coalesce(F.nullif("o.name", F.lit("")), "o.login").alias("found"), F.nullif("o.blog", F.lit("")).alias("blog"), F.coalesce("o.html_url", F.lit("")).alias("profile_url")).where("blog is not null").dropDuplicates(["login"])
    site = F.when(F.col("blog").rlike(r"^https?://"), F.col("blog")).otherwise(F.concat(F.lit("https://"), "blog"))
    return first.join(own, "login").select("name", site.alias("website"), "profile_url", name_confidence(F.col("name"), F.col("found")).alias("confidence"))


def resolved(firms: DataFrame, *strategies: tuple[str, DataFrame]) -> DataFrame:
    """firms (name) with website, profile_url, strategy and confidence of the first strategy that has a website for the
    name. A strategy's table is (name, website, profile_url, confidence); its first row of a name by website counts."""
    out, hits = firms, []
    for i, (label, found) in enumerate(strategies):
        hit = F.struct("website", "profile_url", F.lit(label).alias("strategy"), F.col("confidence").cast("double").alias("confidence"))
        out = out.join(found.where(present(F.col("website"))).groupBy("name").agg(F.min(hit).alias(f"_{i}")), "name", "left")
        hits.append(F.col(f"_{i}"))
    return out.withColumn("_hit", F.coalesce(*hits)).select(*firms.columns, "_hit.*")
