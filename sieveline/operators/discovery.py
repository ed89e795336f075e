"""Which vendor's board a page belongs to, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bare_host, url_host, vendor_domain
from ..sources import scratch
from .extract import CAREERS, careers_links, locs, ranked
from .urls import first_of_each, is_job_url

#: What a board's name is made of; vendor, address pattern, in the order in which they are tried; then marks of vendors without a host of their own.
TOKEN = r"([a-zA-Z0-9_-]+)"
SIGNATURES = [
    ("greenhouse", rf"(?i)boards-api\.greenhouse\.io/v1/boards/{TOKEN}"),
    ("greenhouse", rf"(?i)job-boards\.greenhouse\.io/{TOKEN}"),
    ("greenhouse", rf"(?i)boards\.greenhouse\.io/{TOKEN}"),
    ("lever", rf"(?i)api\.lever\.co/v0/postings/{TOKEN}"),
    ("lever", rf"(?i)jobs\.lever\.co/{TOKEN}"),
    ("ashby", rf"(?i)api\.ashbyhq\.com/posting-api/job-board/{TOKEN}"),
    ("ashby", rf"(?i)jobs\.ashbyhq\.com/{TOKEN}"),
    ("workday", r"(?i)([a-zA-Z0-9-]+\.wd\d+\.myworkdayjobs\.com/(?:[a-zA-Z]{2}-[a-zA-Z]{2}/)?[a-zA-Z0-9_-]+)"),
    ("smartrecruiters", rf"(?i)careers\.smartrecruiters\.com/{TOKEN}"),
    ("smartrecruiters", rf"(?i)api\.smartrecruiters\.com/v1/companies/{TOKEN}"),
    ("talentsoft", r"(?i)https?://([a-zA-Z0-9-]+\.talent-soft\.com)"),
]
JIBE, SUCCESSFACTORS, EIGHTFOLD = r"(?i)jibecdn\.com", r"(?i)/platform/js/j2w/j2w\.fallbacks\.js", r"(?i)eightfold\.ai"
JOB_POSTING = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(?:(?!</script>).)*JobPosting"""
#: Paths that may lead to careers pages, with their language, in order; those of robots.txt files of one vendor; domains and headers that give vendors away; words of links to listings.
CAREERS_PATHS = [("/careers", "en"), ("/jobs", "en"), ("/carrieres", "fr"), ("/recrutement", "fr"), ("/nous-rejoindre", "fr"), ("/rejoignez-nous", "fr"), ("/emplois", "fr"), ("/join-us", "en"), ("/careers/jobs", "en"), ("/fr/carrieres", "fr")]
LISTINGS = ("offres", "postes", "opportunit", "openings", "positions", "all-jobs", "nos-offres", "voir-les-offres")
RMK_ROBOTS = ["/applybutton/", "/talentcommunity/", "/mobile/talentcommunity/", "/emailsubscribe/", "/email/image/", "/services/", "/preapply/", "/error", "/unsubscribe/", "/reset/"]
RMK_STYLESHEET = r"""<\?xml-stylesheet[^>]*href="[^"]*view/xsl/sitemapssl\.xsl\""""
RMK_DOMAINS, EIGHTFOLD_DOMAINS, EIGHTFOLD_HEADERS = ["jobs2web.com", "rmkcdn.successfactors.com", "sapsf.com"], ["eightfold.ai", "eightfold-gov.ai"], ["x-ef-trace-id", "x-ef-iid", "x-ef-ns"]


def detect(page: Column, url: Column, signatures=SIGNATURES) -> Column:
    """struct(ats, identifier): the first signature that occurs in the page; null ats where none does."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    out = lambda a, i: F.struct(F.lit(a).cast("string").alias("ats"), i.cast("string").alias("identifier"))
    tried = []
    for name, pattern in signatures:
        found = F.regexp_extract(page, pattern, 1)
        if name == "workday":
            found = F.regexp_replace(found, r"(?i)\.myworkdayjobs\.com/(?:[a-z]{2}-[a-z]{2}/)?", ".")
        if name == "talentsoft":
            found = F.concat(F.lit("https://"), found)
        tried.append((page.rlike(pattern), out(name, found)))
    tried += [
        (page.rlike(JIBE), out("jibe", origin)),
        (page.rlike(SUCCESSFACTORS), out("successfactors", F.concat(origin, F.lit("/sitemap.xml")))),
        (page.rlike(EIGHTFOLD), out("eightfold", F.concat(origin, F.lit("|"), vendor_domain(url_host(url))))),
        (page.rlike(JOB_POSTING), out("jsonld", url)),
    ]
    chain = None
    for cond, value in tried:
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(out(None, F.lit(None)))


def verified(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found (ats, identifier) with counts of postings: confirmed if there are any, else probable; none without a board."""
    m = found.join(counts.select("ats", "identifier", F.col("n").alias("job_count")), ["ats", "identifier"], "left")
    return m.withColumn("confidence", F.when(F.col("ats").isNull(), "none").when(F.col("job_count") > 0, "confirmed").otherwise("probable"))


def summary(results: DataFrame) -> DataFrame:
    """Per ats: confirmed, probable and the postings of confirmed ones; unresolved ones under a null ats."""
    sure = F.col("confidence") == "confirmed"
    return results.groupBy("ats").agg(
        F.count_if(sure).alias("confirmed"), F.count_if(F.col("confidence") == "probable").alias("probable"), F.count_if(F.col("confidence") == "none").alias("unresolved"),
        F.coalesce(F.sum(F.when(sure, F.col("job_count"))), F.lit(0)).cast("long").alias("postings"),
    )


def vendor_signals(hosts: DataFrame) -> DataFrame:
    """hosts (robots, sitemap, csp strings, headers array of names; null where a fetch failed) -> with the signals of two vendors, and the verdict."""
    has = lambda c, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.coalesce(F.col(c), F.lit("")), m))
    d = hosts.withColumn("rmk_robots_boilerplate", F.forall(F.array(*map(F.lit, RMK_ROBOTS)), lambda m: F.contains(F.coalesce("robots", F.lit("")), m)))
    d = d.withColumn("rmk_sitemap_stylesheet", F.coalesce(F.substring("sitemap", 1, 4096).rlike(RMK_STYLESHEET), F.lit(False)))
    d = d.withColumn("rmk_csp_domain", has("csp", RMK_DOMAINS)).withColumn("eightfold_csp_domain", has("csp", EIGHTFOLD_DOMAINS))
    names = F.transform(F.coalesce("headers", F.array().cast("array<string>")), F.lower)
    d = d.withColumn("eightfold_ef_headers", F.arrays_overlap(names, F.array(*map(F.lit, EIGHTFOLD_HEADERS))))
    rmk, other = F.expr("rmk_robots_boilerplate OR rmk_sitemap_stylesheet OR rmk_csp_domain"), F.expr("eightfold_csp_domain OR eightfold_ef_headers")
    return d.withColumn("vendor", F.when(rmk & other, "both").when(rmk, "successfactors_rmk").when(other, "eightfold").otherwise("no match"))


def board_hits(answers: DataFrame) -> DataFrame:
    """answers (ats, status, body) of boards' addresses -> with n, the number of postings; null where there is no board. One vendor answers for names that it doesn't know, so none there is no board."""
    v = F.try_parse_json("body")
    size = lambda p: F.size(F.try_variant_get(v, p, "array<variant>"))
    listed = lambda p: F.when(F.try_variant_get(v, p, "array<variant>").isNotNull(), size(p))
    total = F.coalesce(F.try_variant_get(v, "$.totalFound", "int"), listed("$.content"))
    n = F.when(F.col("ats").isin("greenhouse", "ashby"), listed("$.jobs")).when(F.col("ats") == "lever", listed("$")).when(F.col("ats") == "smartrecruiters", F.when(total > 0, total))
    return answers.withColumn("n", F.when(F.col("status") == 200, n).cast("int"))


def careers_urls(sites: DataFrame, website: str = "website") -> DataFrame:
    """A row per address that may be a careers page (pos, url), most promising first: French paths first for .fr hosts, the root last."""
    root = F.regexp_replace(website, "/+$", "")
    paths = lambda ps: F.array(*[F.lit(p) for p in ps])
    french = [p for p, lang in CAREERS_PATHS if lang == "fr"] + [p for p, lang in CAREERS_PATHS if lang == "en"]
    order = F.when(url_host(root).endswith(".fr"), paths(french)).otherwise(paths([p for p, _ in CAREERS_PATHS]))
    return sites.select("*", F.posexplode(F.concat(F.transform(order, lambda p: F.concat(root, p)), F.array(root))).alias("pos", "url"))


def sitemap_pages(sites: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """sites (key, sitemap), files (url, text) -> (key, url, pos): the addresses of a sitemap, or of the sitemaps that it lists, one level down."""
    f = files.select(F.col("url").alias("__file"), "text")
    top = locs(sites.join(f, F.col("sitemap") == F.col("__file")).drop("__file"), "text", "sitemap").drop("text")
    is_map = F.col("loc").endswith(".xml")
    maps = top.where(is_map)
    pages = top.join(maps.select(*key).distinct(), key, "left_anti").select(*key, F.col("loc").alias("url"), F.col("pos").cast("long").alias("pos"))
    below = maps.withColumnRenamed("pos", "__at").withColumnRenamed("loc", "__map").join(f, F.col("__map") == F.col("__file"))
    below = locs(below.select(*key, "__at", "__map", "text"), "text", "__map")
    return pages.unionByName(below.select(*key, F.col("loc").alias("url"), (F.col("__at").cast("long") * (1 << 32) + F.col("pos")).alias("pos")))


def walk(sites: DataFrame, pages: DataFrame, most: int = 8) -> DataFrame:
    """sites (company, website), pages (url, html) that were fetched -> a row per company: ats, identifier, and the page that told (url).

    The order is the root, its careers links, two links of each of those, then guessed paths; an address counts once, and
    `most` of them in all. The first page with a signature decides. Pages that weren't fetched count as tried.
    """
    key = ["company"]
    p = pages.select("url", "html")
    root = sites.select("company", F.regexp_replace("website", "/+$", "").alias("url"))
    at = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c")).alias("at")
    zero = F.lit(0)
    first = careers_links(root.join(p, "url"), key).select("company", F.col("link").alias("url"), F.col("n").alias("k"))
    own = ["company", "k"]
    second = ranked(careers_links(first.join(p, "url"), own, (*CAREERS, *LISTINGS)), own, LISTINGS)
    guessed = careers_urls(sites).select("company", "url", "pos")
    tried = root.select("company", "url", at(zero, zero, zero))
    tried = tried.unionByName(first.select("company", "url", at(F.lit(1), F.col("k"), zero)))
    tried = tried.unionByName(second.select("company", F.col("link").alias("url"), at(F.lit(1), F.col("k"), F.col("rank"))))
    tried = tried.unionByName(guessed.select("company", "url", at(F.lit(2), F.col("pos"), zero)))
    tried = tried.groupBy("company", "url").agg(F.min("at").alias("at"))
    tried = tried.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("at"))).where(F.col("__n") <= most)
    seen = tried.join(p, "url").withColumn("f", detect(F.col("html"), F.col("url"))).where("f.ats IS NOT NULL")
    best = seen.groupBy(*key).agg(F.min_by(F.struct("f.ats", "f.identifier", "url"), "at").alias("f"))
    return sites.select("company", "website").join(best, key, "left").select("company", "website", "f.ats", "f.identifier", "f.url")


def frontier(sites: DataFrame, pages: DataFrame, budget: int = 8, rounds: int = 6) -> DataFrame:
    """sites (company, website), pages (url, html) -> a row per company: ats, identifier, the page that told (url) and its depth.

    Breadth first, from the root: each round visits the addresses that are new to the company, by an anti-join, in the order of the links that
    led there, as long as its host's budget lasts; then follows the careers links of those pages. It ends when nothing
    new is left, so pages that link to each other do no harm. A company that has told is not walked on. Each round is written,
    so that no plan grows with the rounds.
    """
    spark, root = sites.sparkSession, scratch.folder(sites.sparkSession, "walk")
    p, key = pages.select("url", "html"), ["company"]
    edge = sites.select("company", F.regexp_replace("website", "/+$", "").alias("url"), F.lit("").alias("place"))
    visited = told = None
    for depth in range(rounds + 1):
        edge = edge.groupBy("company", "url").agg(F.min("place").alias("place")).withColumn("host", bare_host(F.col("url")))
        edge = edge.withColumn("__n", F.row_number().over(W.partitionBy("company", "host").orderBy("place", "url")))
        if visited is not None:
            used = visited.groupBy("company", "host").agg(F.count("*").alias("used"))
            edge = edge.join(visited.select("company", "url"), ["company", "url"], "left_anti").join(used, ["company", "host"], "left")
            edge = edge.withColumn("__n", F.row_number().over(W.partitionBy("company", "host").orderBy("place", "url")) + F.coalesce("used", F.lit(0)))
        edge.where(F.col("__n") <= budget).select("company", "url", "place", "host").write.parquet(f"{root}/visited/depth={depth}")
        visited = spark.read.parquet(f"{root}/visited")
        new = spark.read.parquet(f"{root}/visited/depth={depth}")
        if depth and new.isEmpty():
            break
        seen = new.join(p, "url")
        seen.withColumn("f", detect(F.col("html"), F.col("url"))).where("f.ats IS NOT NULL").select("company", "f.ats", "f.identifier", "url", "place").write.parquet(f"{root}/told/depth={depth}")
        told = spark.read.parquet(f"{root}/told")
        on = seen.join(told.select("company").distinct(), "company", "left_anti")
        links = careers_links(on, [*key, "place"], (*CAREERS, *LISTINGS))
        edge = links.select("company", F.col("link").alias("url"), F.concat("place", F.lpad(F.col("n").cast("string"), 6, "0")).alias("place"))
    best = told.groupBy("company").agg(F.min_by(F.struct("ats", "identifier", "url", "depth"), F.struct("depth", "place")).alias("f"))
    return sites.select("company", "website").join(best, key, "left").select("company", "website", "f.ats", "f.identifier", "f.url", F.col("f.depth").cast("int").alias("depth"))


def resolved(sites: DataFrame, pages: DataFrame, files: DataFrame, budget: int = 8, rounds: int = 6, samples: int = 3) -> DataFrame:
    """The whole walk: sites (company, website, sitemap) by their pages, then those that tell nothing by their sitemaps (files: url, text)."""
    walked = frontier(sites, pages, budget, rounds)
    open_ = sites.join(walked.where("ats IS NULL").select("company"), "company", "left_semi")
    last = sitemap_board(open_.select("company", "sitemap"), files, pages, samples).select("company", F.col("ats").alias("__ats"), F.col("identifier").alias("__id"))
    m = walked.join(last, "company", "left")
    return m.select("company", "website", F.coalesce("ats", "__ats").alias("ats"), F.coalesce("identifier", "__id").alias("identifier"), F.when(F.col("ats").isNotNull(), "page").when(F.col("__ats").isNotNull(), "sitemap").alias("told_by"), "depth")


def sitemap_board(sites: DataFrame, files: DataFrame, pages: DataFrame, samples: int = 3) -> DataFrame:
    """The last resort: sites (company, sitemap) whose first posting pages (of `samples`) have a posting's JSON-LD -> (company, ats, identifier)."""
    found = sitemap_pages(sites, files, ["company"]).where(is_job_url(F.col("url")))
    some = found.withColumn("__n", F.row_number().over(W.partitionBy("company").orderBy("pos"))).where(F.col("__n") <= samples)
    has = some.join(pages.select("url", "html"), "url").where(F.col("html").rlike(JOB_POSTING)).select("company").distinct()
    return sites.join(has, "company").select("company", F.lit("sitemap_jsonld").alias("ats"), F.col("sitemap").alias("identifier"))


def new_entries(results: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Catalog entries of results (company, ats, identifier, confidence) that the catalog (ats, identifier) lacks, the first of each board; cold until someone looks at them."""
    found = first_of_each(results.where("confidence <> 'none'"), ["ats", "identifier"], order).join(existing.select("ats", "identifier"), ["ats", "identifier"], "left_anti")
    return found.select(*[c for c in order if c not in ("ats", "identifier")], F.col("company").alias("name"), "ats", "identifier", F.lit(True).alias("enabled"), F.lit("cold").alias("tier"), F.array().cast("array<string>").alias("tags"))


def entry_line(entries: DataFrame) -> DataFrame:
    """Entries as lines of a YAML list (JSON is YAML), in column value; write them with write.text."""
    return entries.select(F.concat(F.lit("- "), F.to_json(F.struct("name", "ats", "identifier", "enabled", "tier", "tags"))).alias("value"))


def unresolved_line(results: DataFrame) -> DataFrame:
    """Results (company, website, notes) without a board as lines of a log."""
    return results.where("confidence = 'none'").select(F.concat_ws("\t", "company", "website", F.coalesce("notes", F.lit(""))).alias("value"))
