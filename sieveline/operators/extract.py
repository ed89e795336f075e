"""From text to rows: links, sitemaps, structured data, feeds, microdata, labelled fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bare_host, bind, normalize, resolve, strip_html
from .urls import contains_any

#: Words of careers links, their phrases, and hosts of boards.
CAREERS = ("career", "careers", "jobs", "emploi", "emplois", "carriere", "carrieres", "recrutement", "rejoign", "join-us", "nous-rejoindre")
CAREERS_PHRASES = ("nous recrutons", "on recrute", "we're hiring")
BOARD_HOSTS = ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards-api.greenhouse.io", "jobs.lever.co", "api.lever.co", "jobs.ashbyhq.com", "api.ashbyhq.com")
#: Fixed value: an anchor with an address.
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def locs(df: DataFrame, text: str = "text", base: str | None = None) -> DataFrame:
    """A row per <loc>; pos is its place. Relative addresses are resolved against column `base`; without one, or where that gives no web address, they are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    d = df.select("*", F.posexplode(found).alias("pos", "loc"))
    if base:
        plain = absolute(F.col(base), F.col("loc"))
        # only relative paths need the general rule
        odd = F.when(plain.isNull() & (F.col("loc") != ""), F.col("loc"))
        d = d.withColumn("loc", F.coalesce(plain, F.when(odd.isNotNull(), resolve(F.when(odd.isNotNull(), F.col(base)), odd))))
    return d.where(F.col("loc").rlike("(?i)^https?://[^/?#]"))


def sitemap_declarations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^Sitemap:\s*(\S+)"), 1)


def anchors(df: DataFrame, page: str = "html") -> DataFrame:
    """A row per <a href>: pos, href, inner."""
    pairs = F.arrays_zip(F.regexp_extract_all(page, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(page, F.lit(ANCHOR), 2).alias("inner"))
    d = df.select(*[c for c in df.columns if c != page], F.posexplode(pairs).alias("pos", "__a"))
    return d.select(*[c for c in d.columns if c != "__a"], F.col("__a.href").alias("href"), F.col("__a.inner").alias("inner"))


def absolute(base: Column, href: Column) -> Column:
    """The common forms of a link in the JVM; relative paths need `resolve`."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))


def careers_links(pages: DataFrame, key: list[str], words=CAREERS, cap: int = 6, exact: bool = False) -> DataFrame:
    """pages (key, url, html) -> (key, link, link_text, n): links that suggest careers pages, of the same host or a board's, distinct, at most cap."""
    a = anchors(pages.select(*key, "url", "html")).where(~F.col("href").rlike("^(#|mailto:|tel:|javascript:)") & (F.col("href") != ""))
    a = a.withColumn("link_text", strip_html(F.col("inner"), exact))
    fold = lambda c: F.replace(normalize(c, exact), F.lit("’"), F.lit("'"))
    # folded once each, however many words are looked for
    both = F.struct(fold(F.col("href")).alias("href"), fold(F.col("link_text")).alias("text"))
    a = a.where(bind(both, lambda x: contains_any(x["href"], words) | contains_any(x["text"], words) | contains_any(x["text"], CAREERS_PHRASES)))
    a = a.withColumn("link", resolve(F.col("url"), F.col("href")) if exact else absolute(F.col("url"), F.col("href"))).where(F.col("link").rlike("^https?://"))
    a = a.where((bare_host(F.col("link")) == bare_host(F.col("url"))) | bare_host(F.col("link")).isin(*BOARD_HOSTS))
    a = a.withColumn("__d", F.row_number().over(W.partitionBy(*key, "link").orderBy("pos"))).where("__d = 1")
    return a.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("pos"))).where(F.col("n") <= cap).select(*key, "link", "link_text", "pos", "n")


def ranked(links: DataFrame, key: list[str], prefers: tuple[str, ...], take: int = 2) -> DataFrame:
    """Links that look like listings first, else in their order; the first `take`."""
    both = F.struct(normalize(F.col("link")).alias("link"), normalize(F.col("link_text")).alias("text"))
    likes = bind(both, lambda x: contains_any(x["link"], prefers) | contains_any(x["text"], prefers))
    return links.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy((~likes).cast("int"), "pos"))).where(F.col("rank") <= take)


def job_postings(df: DataFrame, page: str = "html") -> DataFrame:
    """A row per JobPosting in the page's JSON-LD: an object, an array's or a @graph's; bad JSON is passed over. Adds block, pos, posting (variant)."""
    block = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), 1)
    keep = [c for c in df.columns if c != page]
    d = df.select(*keep, F.posexplode(block).alias("block", "__t")).withColumn("__v", F.try_parse_json("__t")).where("__v IS NOT NULL")
    d = d.withColumn("__l", F.coalesce(F.try_variant_get("__v", "$['@graph']", "array<variant>"), F.try_variant_get("__v", "$", "array<variant>"), F.array("__v")))
    d = d.select(*keep, "block", F.posexplode("__l").alias("pos", "posting"))
    kind = F.coalesce(F.try_variant_get("posting", "$['@type']", "array<string>"), F.array(F.try_variant_get("posting", "$['@type']", "string")))
    return d.where(F.array_contains(kind, "JobPosting"))


def posting_location(v: str = "posting") -> Column:
    """The first place; a string address as it is, else locality, region and country."""
    get = lambda p: F.coalesce(F.try_variant_get(v, f"$.jobLocation[0].address{p}", "string"), F.try_variant_get(v, f"$.jobLocation.address{p}", "string"))
    parts = [F.nullif(get(f".{p}"), F.lit("")) for p in ("addressLocality", "addressRegion", "addressCountry")]
    made = F.concat_ws(", ", *parts)
    whole = get("")
    return F.when(made != "", made).when(whole.isNotNull() & ~whole.startswith("{"), whole).otherwise("")


def posting_identifier(v: str = "posting") -> Column:
    get = lambda p: F.try_variant_get(v, p, "string")
    plain = get("$.identifier")
    return F.coalesce(get("$.identifier.value"), get("$.identifier.name"), F.when(~plain.startswith("{"), plain))


def rss_items(df: DataFrame, text: str = "text") -> DataFrame:
    """A row per <item> of a feed: title, link, description, category array, pubDate, gid, glocation. A feed that isn't XML has a null row with error set."""
    item = "struct<title:string,link:string,description:string,category:array<string>,pubDate:string,`g:id`:string,`g:location`:string>"
    feed = F.from_xml(F.col(text), f"channel struct<item:array<{item}>>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "false"})
    d = df.withColumn("__f", feed).withColumn("error", F.col("__f._corrupt").isNotNull())
    d = d.select(*[c for c in df.columns if c != text], "error", F.posexplode_outer("__f.channel.item").alias("pos", "i"))
    d = d.where(F.col("i").isNotNull() | F.col("error"))
    return d.select(*[c for c in d.columns if c != "i"], "i.title", "i.link", "i.description", "i.category", "i.pubDate", F.col("i.`g:id`").alias("gid"), F.col("i.`g:location`").alias("glocation"))


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def microdata(s: pd.Series) -> pd.Series:
    """itemprop -> its texts. Nesting of equal tags needs a stack, which patterns lack."""
    from html.parser import HTMLParser

    empty = {"meta", "link", "img", "br", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found: dict[str, list[str]] = {}
            self.open: list[list] = []

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            for o in self.open:
                if o[0] == tag and tag not in empty:
                    o[1] += 1
            if name := attrs.get("itemprop"):
                if tag in empty:
                    self.found.setdefault(name, []).append(attrs.get("content") or "")
                else:
                    self.open.append([tag, 1, name, []])

        def handle_endtag(self, tag):
            for o in [o for o in self.open if o[0] == tag]:
                o[1] -= 1
                if not o[1]:
                    self.open.remove(o)
                    self.found.setdefault(o[2], []).append(" ".join("".join(o[3]).split()))

        def handle_data(self, data):
            for o in self.open:
                o[3].append(data)

    def one(page):
        r = Reader()
        r.feed(page or "")
        return r.found

    return s.map(one)


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def itemprops(s: pd.Series) -> pd.Series:
    """itemprop (in lower case) -> the markup inside each, for strip_html; a meta's content. No item scope is asked for."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found: dict[str, list[str]] = {}
            self.open: list[list] = []  # tag, open tags of that name, name, markup

        def put(self, markup):
            for o in self.open:
                o[3].append(markup)

        def handle_starttag(self, tag, attrs):
            for o in self.open:
                o[1] += o[0] == tag
            self.put(self.get_starttag_text() or "")
            values = dict(attrs)
            name = (values.get("itemprop") or "").strip().lower()
            if name and tag == "meta":
                self.found.setdefault(name, []).append(values.get("content") or "")
            elif name:
                self.open.append([tag, 1, name, []])

        def handle_endtag(self, tag):
            for o in self.open:
                o[1] -= o[0] == tag
            done = [o for o in self.open if not o[1]]
            self.open = [o for o in self.open if o[1]]
            self.put(f"</{tag}>")
            for o in done:
                self.found.setdefault(o[2], []).append("".join(o[3]))

        def handle_data(self, data):
            self.put(data)

    def one(page):
        r = Reader()
        r.feed(page or "")
        return r.found

    return s.map(one)


#: The labels of a rendered posting, where its description begins and where it ends.
LABELS = ("Country", "Area", "Domain", "Workplace location", "Type of contract", "Experience", "Employer company")
LABELS_OF_PLACE = ("Workplace location", "Area", "Country")
BEGINS, ENDS = "Activities", ("Additional Information", "Context & Environment")


def labelled_fields(labels: tuple[str, ...] = LABELS, begins: str = BEGINS, ends: tuple[str, ...] = ENDS):
    """A UDF: text -> (fields, description). A label takes the next line with text, unless that is a label itself."""
    known = set(labels)

    @F.pandas_udf("fields map<string,string>, description string")
    def split(s: pd.Series) -> pd.DataFrame:
        def one(t):
            lines = [x.strip() for x in (t or "").splitlines()]
            stop = lines.index(begins) if begins in lines else len(lines)
            head = [x for x in lines[:stop] if x]
            fields = {a: b for a, b in zip(head, head[1:], strict=False) if a in known and b not in known}
            body = lines[stop + 1 :] if begins in lines else lines
            cut = min((body.index(e) for e in ends if e in body), default=len(body))
            return fields, "\n".join(x for x in body[:cut] if x)

        rows = [one(t) for t in s]
        return pd.DataFrame({"fields": [r[0] for r in rows], "description": [r[1] for r in rows]})

    return split
