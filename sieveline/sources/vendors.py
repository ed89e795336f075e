"""Raw vendor payloads to postings. A parser maps (source, company, payload) rows; malformed payloads and entries give none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import city_from_slug, drop_location_suffix, page_title, strip_html, unescape_in_jvm, when_reported
from ..operators.extract import LABELS_OF_PLACE, itemprops, job_postings, labelled_fields, posting_identifier, posting_location, rss_items
from ..operators.urls import first_of_each

POSTING = ["source", "company", "pos", "external_id", "title", "location", "hint", "url", "source_posted_at", "posted_at", "description"]
POSTINGS = "source string, company string, pos long, external_id string, title string, location string, hint string, url string, source_posted_at string, posted_at timestamp, description string"
#: Columns of raw payloads that postings keep, where there are any: which search term and page gave them.
CARRIED = ["term", "term_no", "page"]
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str):
    def keep(f):
        PARSERS[name] = f
        return f

    return keep


def entries(raw: DataFrame, kind: str, path: str = "") -> DataFrame:
    """A row per entry of the payload's list (at path, or the payload itself), with its place. Payloads that don't parse have none; each entry is parsed by itself, so that a bad one spoils no other."""
    lists = F.from_json("payload", f"{path} array<string>" if path else "array<string>")
    d = raw.select("source", "company", *carried(raw), F.posexplode(lists[path] if path else lists).alias("pos", "e"))
    return d.withColumn("e", F.from_json("e", kind))


def carried(d: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in d.columns]


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def or_else(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def posting(d: DataFrame, id_: Column, title: Column, url: Column, location=None, hint=None, at=None, posted=None, description=None) -> DataFrame:
    """The common columns; entries without title or address are dropped."""
    none = F.lit(None)
    out = d.select(
        "source", "company", "pos", id_.cast("string").alias("external_id"), title.alias("title"), (location if location is not None else F.lit("")).alias("location"),
        (hint if hint is not None else F.lit("")).alias("hint"), url.alias("url"), (at if at is not None else none).cast("string").alias("source_posted_at"),
        (posted if posted is not None else when_reported(at) if at is not None else none).cast("timestamp").alias("posted_at"), (description if description is not None else F.lit("")).alias("description"), *carried(d),
    )
    return out.where((F.trim("title") != "") & (F.col("url") != ""))


@parser("greenhouse")
def greenhouse(raw: DataFrame) -> DataFrame:
    d = entries(raw, "struct<id:bigint,title:string,updated_at:string,location:struct<name:string>,absolute_url:string,content:string>", "jobs")
    p = posting(d, F.col("e.id"), F.col("e.title"), F.col("e.absolute_url"), text("e.location.name"), None, F.col("e.updated_at"), None, strip_html(F.col("e.content")))
    return p.where("source_posted_at IS NULL OR posted_at IS NOT NULL")  # a bad date loses the entry


@parser("lever")
def lever(raw: DataFrame) -> DataFrame:
    d = entries(raw, "struct<id:string,text:string,hostedUrl:string,createdAt:bigint,categories:struct<location:string,commitment:string>,descriptionPlain:string,description:string>")
    at = F.timestamp_millis("e.createdAt")
    return posting(d, F.col("e.id"), F.col("e.text"), F.col("e.hostedUrl"), text("e.categories.location"), text("e.categories.commitment"), at, at, or_else(F.col("e.descriptionPlain"), strip_html(F.col("e.description"))))


@parser("ashby")
def ashby(raw: DataFrame) -> DataFrame:
    d = entries(raw, "struct<id:string,title:string,jobUrl:string,location:string,employmentType:string,publishedAt:string,descriptionPlain:string,descriptionHtml:string>", "jobs")
    p = posting(d, F.col("e.id"), F.col("e.title"), F.col("e.jobUrl"), text("e.location"), text("e.employmentType"), F.col("e.publishedAt"), None, or_else(F.col("e.descriptionPlain"), strip_html(F.col("e.descriptionHtml"))))
    return p.where("source_posted_at IS NULL OR posted_at IS NOT NULL")


@parser("workday")
def workday(raw: DataFrame) -> DataFrame:
    """company is tenant.wdN.site; addresses are built from it."""
    d = entries(raw, "struct<title:string,externalPath:string,timeType:string,locationsText:string,bulletFields:array<string>>", "jobPostings").where("e.externalPath IS NOT NULL")
    host = F.regexp_extract("company", r"^([^.]+\.wd\d+)\.", 1)
    site = F.regexp_extract("company", r"^[^.]+\.wd\d+\.([^|]+)", 1)
    url = F.concat(F.lit("https://"), host, F.lit(".myworkdayjobs.com/"), site, F.col("e.externalPath"))
    bullet = F.try_element_at(F.filter("e.bulletFields", lambda b: ~b.rlike(r"^R\d+$")), F.lit(1))
    return posting(d, F.col("e.externalPath"), F.col("e.title"), url, or_else(F.col("e.locationsText"), bullet), text("e.timeType"))


@parser("smartrecruiters")
def smartrecruiters(raw: DataFrame) -> DataFrame:
    d = entries(raw, "struct<id:string,name:string,releasedDate:string,location:struct<fullLocation:string>,typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>", "content")
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("company"), F.lit("/"), F.col("e.id"))
    hint = F.trim(F.concat_ws(" ", "e.typeOfEmployment.label", "e.experienceLevel.label"))
    return posting(d, F.col("e.id"), F.col("e.name"), url, text("e.location.fullLocation"), hint, F.col("e.releasedDate"))


@parser("jibe")
def jibe(raw: DataFrame) -> DataFrame:
    one = "struct<slug:string,req_id:string,title:string,description:string,full_location:string,location_name:string,city:string,employment_type:string,apply_url:string,posted_date:string>"
    d = entries(raw, f"map<string,{one}>", "jobs").where("size(e) = 1").withColumn("e", F.map_values("e")[0])
    id_ = or_else(F.col("e.slug"), F.col("e.req_id"))
    url = or_else(F.col("e.apply_url"), F.concat(F.col("company"), F.lit("/jobs/"), id_))
    place = or_else(F.col("e.full_location"), F.col("e.location_name"), F.col("e.city"))
    return posting(d.where(id_ != ""), id_, F.col("e.title"), url, place, text("e.employment_type"), F.col("e.posted_date"), None, strip_html(F.col("e.description")))


@parser("eightfold")
def eightfold(raw: DataFrame) -> DataFrame:
    """Payloads are single details."""
    ddl = "id bigint, displayJobId string, name string, locations array<string>, standardizedLocations array<string>, postedTs bigint, creationTs bigint, positionUrl string, publicUrl string, jobDescription string"
    d = raw.select("source", "company", F.lit(0).alias("pos"), F.from_json("payload", ddl).alias("e")).where("e.id IS NOT NULL")
    at = F.timestamp_seconds(F.coalesce("e.postedTs", "e.creationTs"))
    place = or_else(F.try_element_at("e.standardizedLocations", F.lit(1)), F.try_element_at("e.locations", F.lit(1)))
    return posting(d, or_else(F.col("e.displayJobId"), F.col("e.id").cast("string")), F.col("e.name"), or_else(F.col("e.publicUrl"), F.col("e.positionUrl")), place, None, at, at, strip_html(F.col("e.jobDescription")))


def from_json_ld(raw: DataFrame, own_url: Column, id_of_url: bool, unescaped: bool) -> DataFrame:
    """Postings in the JSON-LD of pages; own_url, a column of raw, stands in for a posting's missing address."""
    d = job_postings(raw.select("source", "company", own_url.alias("__own"), "payload"), "payload").withColumn("pos", F.col("block") * 100_000 + F.col("pos"))
    get = lambda p: F.try_variant_get("posting", p, "string")
    hint = F.coalesce(F.array_join(F.try_variant_get("posting", "$.employmentType", "array<string>"), " "), get("$.employmentType"), F.lit(""))
    url = or_else(get("$.url"), F.col("__own"))
    body = get("$.description")
    id_ = F.coalesce(posting_identifier(), url if id_of_url else F.sha2(url, 256))
    return posting(d, id_, get("$.title"), url, posting_location(), hint, get("$.datePosted"), None, strip_html(unescape_in_jvm(body) if unescaped else body))


def page_url(raw: DataFrame) -> Column:
    return F.col("page_url") if "page_url" in raw.columns else F.col("company")


@parser("jsonld")
def jsonld(raw: DataFrame) -> DataFrame:
    """Payloads are a board's pages. The board's own address (page_url, else company) stands in for a posting's missing one."""
    return from_json_ld(raw, page_url(raw), False, False)


@parser("sitemap_jsonld")
def sitemap_jsonld(raw: DataFrame) -> DataFrame:
    """Payloads are the pages (page_url) that a sitemap's traversal chose. Descriptions are escaped once more; the address is the identifier where there is none."""
    return from_json_ld(raw, page_url(raw), True, True)


@parser("rendered")
def rendered(raw: DataFrame) -> DataFrame:
    """Payloads are pages after scripts ran, that have JSON-LD."""
    return from_json_ld(raw, page_url(raw), True, False)


@parser("rendered_sitemap")
def rendered_sitemap(raw: DataFrame) -> DataFrame:
    """Payloads are the texts of rendered posting pages (page_url) below their titles (page_title): labels and values, then the description."""
    split = labelled_fields()
    raw = raw if "page_title" in raw.columns else raw.withColumn("page_title", F.regexp_extract("payload", r"^\s*([^\r\n]*)", 1))
    d = raw.select("source", "company", F.lit(0).cast("long").alias("pos"), page_url(raw).alias("url"), F.trim("page_title").alias("title"), split(F.col("payload")).alias("f"))
    of = lambda name: F.try_element_at("f.fields", F.lit(name))
    place = F.concat_ws(", ", *[F.nullif(of(x), F.lit("")) for x in LABELS_OF_PLACE])
    return posting(d, F.col("url"), F.col("title"), F.col("url"), place, F.coalesce(of("Type of contract"), F.lit("")), None, None, F.col("f.description"))


@parser("successfactors_sitemap")
def successfactors_sitemap(raw: DataFrame) -> DataFrame:
    """Payloads are posting pages (page_url) with microdata. Title tag and address stand in for a missing title and place."""
    d = raw.select("source", "company", F.lit(0).cast("long").alias("pos"), page_url(raw).alias("url"), "payload", itemprops(F.col("payload")).alias("m"))
    first = lambda n: F.trim(F.coalesce(F.try_element_at(F.try_element_at("m", F.lit(n)), F.lit(1)), F.lit("")))
    title = or_else(strip_html(first("title")), page_title(F.col("payload")))
    return posting(d, F.col("url"), title, F.col("url"), or_else(strip_html(first("streetaddress")), city_from_slug(F.col("url"))), None, None, None, strip_html(first("description")))


def is_feed(payload: Column) -> Column:
    """Whether a sitemap's address gave a feed instead: its first 500 characters tell."""
    return F.substring(payload, 1, 500).rlike(r"(?i)<rss\b")


@parser("successfactors_rss")
def successfactors_rss(raw: DataFrame) -> DataFrame:
    d = rss_items(raw.select("source", "company", "payload"), "payload").where("NOT error")
    place = text("glocation")
    return posting(d, F.col("gid"), drop_location_suffix(F.col("title"), place), F.col("link"), place, None, None, None, strip_html(strip_html(F.col("description"))))


@parser("successfactors")
def successfactors(raw: DataFrame) -> DataFrame:
    """Feeds and posting pages, told apart by their beginnings."""
    return successfactors_rss(raw.where(is_feed(F.col("payload")))).unionByName(successfactors_sitemap(raw.where(~is_feed(F.col("payload")))))


@parser("talentsoft_rss")
def talentsoft_rss(raw: DataFrame) -> DataFrame:
    d = rss_items(raw.select("source", "company", "payload"), "payload").where("NOT error")
    body = strip_html(F.col("description"))
    place = or_else(F.trim(F.regexp_extract(body, r"(?m)^Ville\s*:\s*(.+)$", 1)), F.try_element_at("category", F.lit(-1)))
    return posting(d, F.regexp_extract("link", r"idOffre=(\d+)", 1), F.regexp_replace("title", r"^\d{4}-\d+ - ", ""), F.col("link"), place, F.coalesce(F.try_element_at("category", F.lit(2)), F.lit("")), F.col("pubDate"), None, body)


@parser("talentsoft_cards")
def talentsoft_cards(raw: DataFrame) -> DataFrame:
    """Listing pages: a title link and its badges; the first badge is the hint, the others the place."""
    card = r'(?is)<a[^>]*class="[^"]*title-link[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>\s*<ul[^>]*>(.*?)</ul>'
    part = lambda i: F.regexp_extract_all("payload", F.lit(card), i)
    d = raw.select("source", "company", F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("title"), part(3).alias("badges"))).alias("pos", "e"))
    badges = F.transform(F.regexp_extract_all("e.badges", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1), lambda b: strip_html(b))
    place = F.when(F.size(badges) > 1, F.array_join(F.slice(badges, F.lit(2), F.size(badges)), ", ")).otherwise("")
    id_ = F.regexp_extract("e.href", r"_(\d+)\.aspx", 1)
    return posting(d.where(id_ != ""), id_, strip_html(F.col("e.title")), F.col("e.href"), place, F.coalesce(F.try_element_at(badges, F.lit(1)), F.lit("")))


def cards_total(payload: Column) -> Column:
    """How many offers a listing page says there are; 0 where it says nothing."""
    return F.coalesce(F.regexp_extract(payload, r"(?i)(\d+)\s*offre", 1).try_cast("int"), F.lit(0))


def needs_feed(raw: DataFrame) -> DataFrame:
    """Sources (source, company) whose listing pages say that there are offers, but show none: their feed is to be read."""
    shown = talentsoft_cards(raw).select("source", "company").distinct()
    said = raw.groupBy("source", "company").agg(F.max(cards_total(F.col("payload"))).alias("total")).where("total > 0")
    return said.join(shown, ["source", "company"], "left_anti").select("source", "company")


@parser("talentsoft")
def talentsoft(raw: DataFrame) -> DataFrame:
    """Listing pages, and feeds for those that show no offers."""
    feed = is_feed(F.col("payload"))
    pages = raw.where(~feed)
    return talentsoft_cards(pages).unionByName(talentsoft_rss(raw.where(feed).join(needs_feed(pages), ["source", "company"])))


def merged(postings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One posting per source and external id, of several pages and search terms: the first by `order` (columns that number them), then place."""
    return first_of_each(postings, ["source", "company", "external_id"], [*(order or []), "pos"])


def eightfold_ids(raw: DataFrame) -> DataFrame:
    """Search pages -> (source, company, id): the details to ask for, each once."""
    inner = F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload"))
    d = entries(raw.withColumn("payload", inner), "struct<id:bigint>", "positions")
    return d.select("source", "company", F.col("e.id").alias("id")).where("id IS NOT NULL").distinct()


#: The key that holds a payload's entries ('' where the payload is the list).
ENTRIES = {"greenhouse": "jobs", "lever": "", "ashby": "jobs", "workday": "jobPostings", "smartrecruiters": "content", "jibe": "jobs"}


def broken(raw: DataFrame, ats: str) -> DataFrame:
    """(source, company, error) of payloads that can't be read: no JSON, no list of entries, no XML, no posting's JSON-LD."""
    key = ["source", "company"]
    if ats in ENTRIES:
        v = F.try_parse_json("payload")
        path = "$" + (f".{ENTRIES[ats]}" if ENTRIES[ats] else "")
        return raw.where(F.try_variant_get(v, path, "array<variant>").isNull()).select(*key, F.lit(f"{ats}: malformed payload").alias("error"))
    if ats == "eightfold":
        return raw.where(F.try_parse_json("payload").isNull()).select(*key, F.lit("eightfold: malformed payload").alias("error"))
    if ats in ("successfactors_rss", "talentsoft_rss", "successfactors", "talentsoft"):
        feeds = raw.where(is_feed(F.col("payload"))) if ats in ("successfactors", "talentsoft") else raw
        return rss_items(feeds.select(*key, "payload"), "payload").where("error").select(*key, F.lit(f"{ats}: malformed feed").alias("error")).distinct()
    if ats == "jsonld":
        has = job_postings(raw.select(*key, "payload"), "payload").select(*key).distinct()
        return raw.select(*key).distinct().join(has, key, "left_anti").select(*key, F.lit("jsonld: no posting found").alias("error"))
    return raw.where("payload IS NULL").select(*key, F.lit(f"{ats}: no payload").alias("error"))


def parse(raw: DataFrame, ats: str) -> DataFrame:
    if ats not in PARSERS:
        raise ValueError(f"no parser for {ats}; there are {sorted(PARSERS)}")
    return PARSERS[ats](raw)
