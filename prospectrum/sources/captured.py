"""Parsers of captured payloads into raw leads. Nothing here uses a network."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.functions.text import clean_email, present, site_key, url_decoded
from prospectrum.operators.leads import KINDS, RAW_NAMES, as_leads, first_seen
from prospectrum.sources import directories

TAGS = "array<struct<type: string, id: bigint, tags: map<string, string>>>"


#: Items of one payload whose order can be told; orders of payloads go up to 2 ** 30.
ITEMS = 1 << 20


def nested(order: Column, nth: Column) -> Column:
    """An order over the items of ordered payloads."""
    return order.cast("long") * ITEMS + nth


def map_elements(payloads: DataFrame) -> DataFrame:
    """Leads of map payloads (payload string, ord): named elements; category and contacts from the tags."""
    el = payloads.select("ord", F.posexplode(F.from_json("payload", f"elements {TAGS}")["elements"]).alias("nth", "el"))
    t = lambda *keys: F.coalesce(*(F.nullif(F.col("el.tags")[k], F.lit("")) for k in keys))
    rows = el.where(t("name").isNotNull()).select(
        nested(F.col("ord"), F.col("nth")).alias("ord"), t("name").alias("name"), t("amenity", "office", "shop", "craft", "tourism").alias("category"),
        t("website", "contact:website").alias("website"), t("phone", "contact:phone").alias("phone"), t("email", "contact:email").alias("email"),
        F.concat_ws(", ", *(t(f"addr:{k}") for k in ("housenumber", "street", "city", "postcode"))).alias("address"),
    )
    return first_seen(rows, F.lower(F.coalesce("website", "name")))


# The tags of a map's elements for each line of business.
TAG_FILTERS = {
    "tech": ('["office"="it"]', '["office"="software"]', '["office"="telecommunication"]', '["office"="web_design"]', '["shop"="computer"]', '["craft"="electronics"]'),
    "healthcare": ('["amenity"="dentist"]', '["amenity"="hospital"]', '["amenity"="clinic"]', '["amenity"="doctors"]', '["amenity"="pharmacy"]', '["amenity"="veterinary"]'),
    "general": ('["office"="lawyer"]', '["office"="insurance"]', '["office"="estate_agent"]', '["office"="accountant"]', '["amenity"="restaurant"]', '["amenity"="cafe"]', '["tourism"="hotel"]', '["shop"="hairdresser"]', '["shop"="beauty"]'),
}


def tag_query(city: str, filters: list[str]) -> str:
    """A map query for elements of a city that have one of the tags."""
    body = "\n".join(f"  nwr{f}(area.a);" for f in filters)
    return f'[out:json][timeout:50];\narea["name"="{city}"]->.a;\n(\n{body}\n);\nout center tags;'


def linked_data(pages: DataFrame) -> DataFrame:
    """Leads of pages (url, html, ord) with JSON-LD: name, telephone, url (blank where it is the page's own host), address."""
    blocks = pages.select("ord", "url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("ld"))
    kind = "array<struct<name: string, telephone: string, url: string, address: struct<streetAddress: string, addressLocality: string, addressRegion: string>>>"
    one = F.when(F.trim("ld").startswith("["), F.from_json("ld", kind)).otherwise(F.from_json(F.concat(F.lit("["), "ld", F.lit("]")), kind))
    x = blocks.select("ord", "url", F.explode(one).alias("x")).where(present(F.col("x.name")))
    own = site_key(F.col("x.url")) == site_key(F.col("url"))
    return x.select("ord", F.col("x.name").alias("name"), F.col("x.telephone").alias("phone"), F.when(own, "").otherwise(F.col("x.url")).alias("website"), F.concat_ws(", ", *(F.nullif(F.col(f"x.address.{k}"), F.lit("")) for k in ("streetAddress", "addressLocality", "addressRegion"))).alias("address"), F.col("url").alias("maps_url"))


def embedded_json(pages: DataFrame, lists: tuple[str, ...], schema: str) -> DataFrame:
    """Rows of JSON in a page's __NEXT_DATA__ script: the lists at the paths, one after another, first row of each id."""
    body = pages.select("ord", F.regexp_extract("html", r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1).alias("j"))
    parts = [body.select("ord", F.lit(i).alias("which"), F.posexplode(F.from_json(F.get_json_object("j", p), f"array<struct<{schema}>>")).alias("nth", "x")) for i, p in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, parts).select(nested(F.col("ord"), F.col("which") * (1 << 17) + F.col("nth")).alias("ord"), "x.*")
    return first_seen(rows, F.col("id").cast("string"))


def unwrapped(href: Column, own_host: str) -> Column:
    """The target of a directory's redirect link (parameter u); null where that is the directory itself."""
    target = F.coalesce(url_decoded(F.try_parse_url(href, F.lit("QUERY"), F.lit("u"))), href)
    return F.when(site_key(target) != own_host, target)


# What is no address though it looks like one, and the paths of a site in the order they are looked at.
JUNK = r"(?i)\.(png|jpe?g|gif|svg|webp|css|js)$|sentry|wixpress|example\.(com|org)|@2x|@3x|^(xxx|email|name|user|your|test|firstname|lastname)@|@(xxx|domain|yourdomain|yoursite|sentry|example)\.|placeholder"
PATHS = ("", "/contact", "/about")
DEEP_PATHS = ("/team", "/about-us", "/leadership", "/contact-us", "/company")
NETWORKS = {"linkedin": r"linkedin\.com", "facebook": r"facebook\.com", "instagram": r"instagram\.com"}
MOST_EMAILS = 3


def in_path_order(pages: DataFrame, deep: bool = False) -> DataFrame:
    """Pages (host, path, html) that a look at a site takes in, with path_ord: the known paths, and in a deep look
    the home page's footer links that those lack, in the order they stand there."""
    known = [*PATHS, *(DEEP_PATHS if deep else ())]
    plain = lambda p: F.when(F.trim(p, F.lit("/")) == "", "").otherwise(F.concat(F.lit("/"), F.trim(p, F.lit("/"))))
    path = plain(F.coalesce("path", F.lit("")))
    own = pages.withColumn("path_ord", F.array_position(F.array(*map(F.lit, known)), path).cast("long"))
    if deep:
        home = own.where("path_ord = 1").groupBy("host").agg(F.min("html").alias("_home"))
        footer = F.array_except(F.transform(directories.footer_paths(F.col("_home")), plain), F.array(*map(F.lit, known)))
        later = F.array_position(footer, path)
        own = own.join(home, "host", "left").withColumn("path_ord", F.when(F.col("path_ord") > 0, F.col("path_ord")).when(later > 0, later + len(known)).otherwise(0).cast("long")).drop("_home")
    return own.where("path_ord > 0")


def page_emails(html: Column) -> Column:
    """Distinct addresses of a page: those of mailto links, then all that stand in it, cleaned, without junk."""
    mail = F.regexp_extract_all(html, F.lit(r"(?i)mailto:([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})"), F.lit(1))
    free = F.regexp_extract_all(html, F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"), F.lit(1))
    clean = lambda e: F.when(F.contains(e, F.lit("%")), clean_email(e)).otherwise(F.lower(e))
    return F.array_distinct(F.filter(F.transform(F.concat(mail, free), clean), lambda e: (e != "") & ~e.rlike(JUNK)))


def contacts(pages: DataFrame) -> DataFrame:
    """Per host of pages (host, path_ord, html): up to three distinct emails in order of paths, and the first link to
    each network. Pages after the first by which an email and a LinkedIn link are found aren't looked at.

    Least places by host and by address are combined before the shuffle, so a host may have any number of pages."""
    link = lambda site: F.nullif(F.regexp_extract("html", rf"(?i)href=[\"'](https?://(?:[a-z]+\.)?{site}/[^\"'#? ]+)", 1), F.lit(""))
    seen = pages.select("host", "path_ord", F.explode(F.array(F.struct(page_emails(F.col("html")).alias("emails"), *(link(h).alias(n) for n, h in NETWORKS.items())))).alias("x")).select("host", "path_ord", "x.*")
    place = lambda c: F.when(F.col(c).isNotNull(), F.col("path_ord"))
    per_host = seen.groupBy("host").agg(F.min(F.when(F.size("emails") > 0, F.col("path_ord"))).alias("_mail"), *(x for n in NETWORKS for x in (F.min(place(n)).alias(f"_{n}"), F.min_by(n, place(n)).alias(n))))
    last = F.when(F.col("_mail").isNotNull() & F.col("_linkedin").isNotNull(), F.greatest("_mail", "_linkedin"))
    per_host = per_host.withColumn("_last", last)
    own = seen.select("host", "path_ord", F.posexplode("emails").alias("nth", "email")).groupBy("host", "email").agg(F.min(F.struct("path_ord", "nth")).alias("at"))
    rank = F.row_number().over(W.partitionBy("host").orderBy("at", "email"))
    few = own.withColumn("rank", rank).where(F.col("rank") <= MOST_EMAILS).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "at", "email"))).alias("few"))  # three at most
    in_time = lambda at: F.col("_last").isNull() | (at <= F.col("_last"))
    found = F.transform(F.filter(F.coalesce("few", F.array()), lambda e: in_time(e["at"]["path_ord"])), lambda e: e["email"])
    return per_host.join(few, "host", "left").select("host", found.alias("emails"), *(F.when(in_time(F.col(f"_{n}")), F.col(n)).alias(n) for n in NETWORKS))


def enriched(leads: DataFrame, found: DataFrame) -> DataFrame:
    """Leads with what was found on their site: its first email is preferred, emails are united, gaps in links filled."""
    key = site_key(F.col("website"))
    got = found.select(F.col("host").alias("_host"), F.col("emails").alias("_emails"), *(F.col(c).alias(f"_{c}") for c in ("linkedin", "facebook", "instagram")))
    j = leads.withColumn("_host", key).join(got, "_host", "left")
    old = F.filter(F.transform(F.split(F.coalesce("all_emails", F.lit("")), ";"), lambda x: F.trim(x)), lambda e: e != "")
    merged = F.array_distinct(F.concat(F.coalesce("_emails", F.array().cast("array<string>")), old))
    cols = {"email": F.coalesce(F.get("_emails", F.lit(0)), "email"), "all_emails": F.array_join(merged, "; ")} | {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in ("linkedin", "facebook", "instagram")}
    return j.withColumns(cols).drop("_host", "_emails", "_linkedin", "_facebook", "_instagram")


def page_text(captured: Column, html: Column) -> Column:
    """Captured text if it has 50 characters, else the page's own; 20,000 characters at most."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]+>", " "), r"\s+", " "))
    ok = lambda c: F.when(F.length(F.trim(c)) >= 50, F.substring(c, 1, 20_000))
    return F.coalesce(ok(captured), ok(plain))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Leads of run files (CSV with a header in either naming): unknown columns are ignored, rows without a name
    dropped. ord follows the files' names (a run's name has its time) and places: a file is read by one task, as its
    values may hold line breaks, and its rows are numbered in it; so it doesn't depend on how files are dealt."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    own = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]
    raw = raw.select(*own, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_nth"))
    files = raw.groupBy("_file").agg(F.min("_nth").alias("_first"))  # a row for each file
    files = files.select("_file", "_first", F.row_number().over(W.orderBy("_file")).alias("_which"))
    raw = raw.join(files, "_file").withColumn("ord", F.col("_which").cast("long") * (1 << 40) + F.col("_nth") - F.col("_first"))
    for c in ("tags", "sub_industries"):
        if c in raw.columns:
            raw = raw.withColumn(c, F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""))
    return as_leads(raw.drop("_file", "_nth", "_first", "_which")).where(present(F.col("company_name")))


def read_recovered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Leads of several run or recovery files, later paths after earlier ones; paths that aren't there are passed over."""
    parts = []
    for i, p in enumerate(paths):
        if exists(spark, p):
            rows = read_runs(spark, p)
            parts.append(rows.withColumn("ord", F.lit(i).cast("long") * (1 << 55) + F.col("ord")))
    return reduce(DataFrame.unionByName, parts) if parts else as_leads(spark.createDataFrame([], "ord long"))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Leads of a master file (a JSON list); an absent or unreadable one counts as empty. A list is read as a
    stream of its objects, so its length isn't bounded by what one value holds."""
    if not exists(spark, path):
        return as_leads(spark.createDataFrame([], "ord long"))
    kinds = ", ".join([*(f"{c} string" for c in RAW_NAMES), *(f"{c} {k}" for c, k in KINDS.items()), "_unread string"])
    raw = spark.read.schema(kinds).option("multiLine", True).option("columnNameOfCorruptRecord", "_unread").json(path)
    raw = raw.withColumn("ord", F.monotonically_increasing_id()).where("_unread is null").drop("_unread")
    for was, now in RAW_NAMES.items():
        raw = raw.withColumn(now, F.coalesce(now, was)).drop(was)
    return as_leads(raw)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored_or_files(spark: SparkSession, stored: DataFrame | None, paths: list[str]) -> DataFrame:
    """The stored table if it has rows, else what the run files hold."""
    return stored if stored is not None and not stored.isEmpty() else read_recovered(spark, paths)


def csv_cells(df: DataFrame) -> DataFrame:
    """Strings as a CSV cell holds them: arrays joined by '; ', null as ''."""
    return df.select(*(F.coalesce(F.array_join(c, "; ") if k.startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", lineSep="\r\n")


def replace_csv(df: DataFrame, path: str) -> int:
    """The table as CSV in place of what is at the path; how many rows. It is written beside the old export, counted in the same
    pass, and takes its place when it is whole: an empty table is refused, and a write that breaks off or finds the old
    export in use leaves that as it was."""
    spark, beside, seen = df.sparkSession, f"{path.rstrip('/')}.new", Observation()
    write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), beside)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not seen.get["rows"]:
        store.delete(new, True)
        raise ValueError("nothing to export")
    if store.exists(old) and not store.delete(old, True) or not store.rename(new, old):
        raise OSError(f"{path} can't be replaced; the new export is at {beside}")
    return seen.get["rows"]


#: Sources in order: key -> (source, engine, parser of captured rows). Parsers that need a second capture take it as "<key>_pages".
REGISTRY: dict[str, tuple[str, str, Callable[..., DataFrame]]] = {
    "google_maps": ("google_maps", "capture", directories.google_maps),
    "google_maps_general": ("google_maps", "capture", directories.google_maps),
    "openstreetmap": ("openstreetmap", "capture", map_elements),
    "github_orgs": ("github_orgs", "capture", directories.github_orgs),
    "clutch": ("clutch", "capture", directories.clutch),
    "goodfirms": ("goodfirms", "capture", directories.goodfirms),
    "opencorporates": ("opencorporates", "capture", directories.opencorporates),
    "pseb": ("pseb", "capture", directories.pseb),
    "topdevelopers": ("topdevelopers", "capture", directories.topdevelopers),
    "sortlist": ("sortlist", "capture", directories.sortlist),
    "eventbrite": ("eventbrite", "capture", directories.eventbrite),
    "designrush": ("designrush", "capture", directories.designrush),
    "techbehemoths": ("techbehemoths", "capture", directories.techbehemoths),
    "selectedfirms": ("selectedfirms", "capture", directories.selectedfirms),
    "businesslist": ("businesslist_pk", "capture", linked_data),
}


def stamped(df: DataFrame, source: str, engine: str, query: str, at: Column) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "engine": F.lit(engine), "search_query": F.lit(query), "scraped_at": at})


def gather(captures: dict[str, DataFrame], at: Column, only: tuple[str, ...] | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """All captured sources in the registry's order, with an input order over all. A source whose capture can't be
    read or parsed is left out and named in failed; no captures give no rows."""
    parts = []
    for i, (key, (source, engine, parse)) in enumerate(REGISTRY.items()):
        if key in captures and (only is None or key in only):
            more = [captures[f"{key}_pages"]] if f"{key}_pages" in captures else []
            try:
                rows = stamped(parse(captures[key], *more), source, engine, key, at)
                rows.schema  # analysed here, so that a wrong capture shows itself  # noqa: B018
            except Exception as e:  # one broken source doesn't end the others
                if failed is None:
                    raise
                failed[key] = str(e).split("\n", 1)[0]
                continue
            parts.append(as_leads(rows.withColumn("ord", F.lit(i).cast("long") * (1 << 55) + F.col("ord"))))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    spark = next((df.sparkSession for df in captures.values()), None) or SparkSession.active()
    return as_leads(spark.createDataFrame([], "ord long"))


def gather_into(captures: dict[str, DataFrame | Callable[[], DataFrame]], at: Column, folder: str, only: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(the rows of gather(), why sources failed). Each source is read, parsed and written apart, so one that breaks while it runs
    is left out as one that can't be read is, and the others' work stays."""
    spark = SparkSession.active()
    failed: dict[str, str] = {}
    done = []
    for key in REGISTRY:
        if key not in captures or (only is not None and key not in only):
            continue
        read = lambda k: captures[k]() if callable(captures[k]) else captures[k]
        try:
            own = {k: read(k) for k in (key, f"{key}_pages") if k in captures}
            gather(own, at, (key,)).write.mode("overwrite").parquet(f"{folder}/{key}")
            done.append(f"{folder}/{key}")
        except Exception as e:  # one broken source doesn't end the others
            failed[key] = str(e).split("\n", 1)[0]
    schema = as_leads(spark.createDataFrame([], "ord long")).schema
    return (spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)), failed


def site_name(url: Column) -> Column:
    """The first label of a URL's host, without www."""
    return F.split_part(site_key(url), F.lit("."), F.lit(1))
