"""Paged boards as a batch source: a partition is some pages of one board and search term, planned from its first page's total.

    spark.dataSource.register(PagedBoards)
    spark.read.format("paged_boards").option("boards", json).option("terms", json).option("transport", "module:factory").load()

A row is a page's payload, in the shape that the vendors' parsers read. Conditions on source, company, term and facet that
compare with values (=, IN) are pushed: boards and terms that they exclude are never asked, and a facet goes into the
request. A board without search terms is crawled plainly, with the empty term. Pages beyond the vendor's cap aren't read,
and the last page that is read says so (`warning`); a board whose first page can't be had gives one row with `error`. A
page with fewer entries than the first ends its partition, as the total may have shrunk since.

A transport is what factory(options) gives (module:factory, or `recorded`): page(Request) -> str. It raises Transient for what may go away, which is tried
once more, and any other error for what won't. `Recorded` plays back pages from Parquet; live ones are injected.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

PAGE = "source string, company string, term string, term_no int, facet string, page int, start int, total long, entries int, payload string, warning string, error string"
ATTEMPTS = 2


@dataclass(frozen=True)
class Vendor:
    """Where a page's entries and the total are, entries asked for a page (None: what the first one has), and most pages of a plain crawl and of one term."""

    entries: tuple[str, ...]
    total: tuple[str, ...]
    size: int | None
    pages: int
    term_pages: int


VENDORS = {
    "workday": Vendor(("jobPostings",), ("total",), 20, 20, 30),
    "smartrecruiters": Vendor(("content",), ("totalFound",), 100, 20, 30),
    "jibe": Vendor(("jobs",), ("totalCount",), 100, 20, 30),
    "eightfold": Vendor(("data", "positions"), ("data", "count"), None, 20, 30),
}


class Transient(Exception):
    """A timeout or a server's error, which may go away."""


@dataclass(frozen=True)
class Request:
    vendor: str
    company: str
    term: str
    facet: str
    page: int  # from 1
    start: int  # entries before it
    size: int | None


def _at(payload: object, path: tuple[str, ...]):
    for k in path:
        payload = payload.get(k) if isinstance(payload, dict) else None
    return payload


def asked(transport, request: Request) -> tuple[str, list, int | None]:
    """A page, its entries and the total that it states. Tried again once where the error is transient; a page without entries is an error."""
    for attempt in range(ATTEMPTS):
        try:
            text = transport.page(request)
            break
        except Transient:
            if attempt + 1 == ATTEMPTS:
                raise
    vendor = VENDORS[request.vendor]
    payload = json.loads(text)
    found, total = _at(payload, vendor.entries), _at(payload, vendor.total)
    if not isinstance(found, list):
        raise ValueError(f"{request.vendor}: no list of entries in page {request.page} of {request.company}")
    return text, found, total if isinstance(total, int) and not isinstance(total, bool) else None


@dataclass
class Pages(InputPartition):
    """Pages first to last of a board and term, of all that there are, of which cap are read; read: the first one, which planning has already."""

    source: str
    request: Request
    term_no: int
    first: int = 1
    last: int = 0
    size: int = 0
    total: int | None = None
    all: int = 0
    cap: int = 0
    error: str | None = None
    read: tuple[str, int] | None = None


@dataclass
class Plan:
    vendor: str
    boards: list[dict]
    terms: list[str]
    most: int | None = None
    each: int = 5
    wanted: dict[str, set] = field(default_factory=dict)

    def requests(self) -> Iterator[tuple[str, int, Request]]:
        keep = lambda c, v: c not in self.wanted or v in self.wanted[c]
        vendor = VENDORS[self.vendor]
        for b in self.boards:
            if not (keep("source", b.get("source", self.vendor)) and keep("company", b["company"])):
                continue
            own = b.get("facet", "")
            facets = sorted(self.wanted["facet"]) if "facet" in self.wanted and not own else [own]
            for facet in facets:
                if own and not keep("facet", own):
                    continue
                for i, term in enumerate(self.terms or [""]):
                    if keep("term", term):
                        yield b.get("source", self.vendor), i, Request(self.vendor, b["company"], term, facet, 1, 0, vendor.size)

    def split(self, transport, source: str, term_no: int, request: Request) -> list[Pages]:
        """The first page, which tells how many there are, and the others in runs of `each`."""
        vendor = VENDORS[self.vendor]
        try:
            text, found, total = asked(transport, request)
        except Exception as e:  # noqa: BLE001  a board's failure is a row of its own
            return [Pages(source, request, term_no, error=f"{type(e).__name__}: {e}")]
        size = vendor.size or len(found)
        # without a total, or with a short first page, there is no second one
        pages = -(-total // size) if total and size and len(found) >= size else 1
        cap = min(pages, self.most or (vendor.term_pages if request.term else vendor.pages))
        rest = [Pages(source, request, term_no, p, min(p + self.each - 1, cap), size, total, pages, cap) for p in range(2, cap + 1, self.each)]
        return [Pages(source, request, term_no, 1, 1, size, total, pages, cap, read=(text, len(found))), *rest]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        vendor = options["vendor"]
        if vendor not in VENDORS:
            raise ValueError(f"no paged vendor {vendor}; there are {sorted(VENDORS)}")
        self.plan = Plan(vendor, json.loads(options["boards"]), json.loads(options.get("terms", "[]")), int(options["pages"]) if "pages" in options else None, int(options.get("each", 5)))

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("source", "company", "term", "facet"):
                name = f.attribute[0]
                self.plan.wanted[name] = self.plan.wanted[name] & values if name in self.plan.wanted else values
            else:
                yield f

    def _transport(self):
        module, _, name = self.options.get("transport", "recorded").partition(":")
        return (getattr(importlib.import_module(module), name) if name else {"recorded": Recorded}[module])(self.options)

    def partitions(self) -> list[Pages]:
        transport, wanted = self._transport(), list(self.plan.requests())
        with ThreadPoolExecutor(int(self.options.get("threads", 16))) as pool:  # first pages only, and they wait for the network
            found = [p for ps in pool.map(lambda r: self.plan.split(transport, *r), wanted) for p in ps]
        return found or [Pages("", Request(self.plan.vendor, "", "", "", 1, 0, None), -1)]

    def read(self, part: Pages):
        if part.term_no < 0:  # nothing is asked for
            return
        r = part.request

        def row(page, start, n, text, error=None):
            warning = f"{part.all - part.cap} pages beyond the cap of {part.cap} were not read" if not error and page == part.cap < part.all else None
            return (part.source, r.company, r.term, part.term_no, r.facet, page, start, part.total, n, text, warning, error)

        if part.error:
            yield row(1, 0, None, None, part.error)
            return
        transport = None if part.read else self._transport()
        for page in range(part.first, part.last + 1):
            start = (page - 1) * part.size
            if part.read:
                text, n = part.read
            else:
                try:
                    text, entries, _ = asked(transport, replace(r, page=page, start=start))
                except Exception as e:  # noqa: BLE001
                    yield row(page, start, None, None, f"{type(e).__name__}: {e}")
                    return
                n = len(entries)
            yield row(page, start, n, text)
            if n < part.size:
                return


class PagedBoards(DataSource):
    """Options: vendor; boards, a JSON list of {company, source?, facet?}; terms, a JSON list; transport, module:factory or recorded; pages, a cap of one's own; each, pages of a partition; threads, for first pages; the transport's own."""

    @classmethod
    def name(cls) -> str:
        return "paged_boards"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class Recorded:
    """Pages from Parquet files (vendor, company, term, facet, page, payload) below a folder that all machines see, in folders part=<number> by `part_of`. With `log`, a folder, each request leaves a file there."""

    PARTS = 64

    def __init__(self, options):
        from pyarrow.fs import FileSystem

        self.fs, self.path = FileSystem.from_uri(options["root"])
        self.log = options.get("log")
        self.held: tuple[tuple, dict] | None = None

    @classmethod
    def part_of(cls, company: str) -> int:
        import zlib

        return zlib.crc32(company.encode()) % cls.PARTS

    def page(self, request: Request) -> str:
        import pyarrow.dataset as ds

        if self.log:
            import os
            import uuid

            with open(os.path.join(self.log, uuid.uuid4().hex), "w") as f:
                json.dump(asdict(request), f)
        key = (request.vendor, request.company, request.term, request.facet)
        held = self.held
        if not held or held[0] != key:
            folder = f"{self.path}/part={self.part_of(request.company)}"
            if self.fs.get_file_info(folder).type.name == "NotFound":
                raise LookupError(f"{request.vendor}: no board {request.company}")
            match = [ds.field(c) == v for c, v in zip(("vendor", "company", "term", "facet"), key, strict=True)]
            t = ds.dataset(folder, filesystem=self.fs, format="parquet").to_table(["page", "payload"], filter=match[0] & match[1] & match[2] & match[3])
            held = self.held = (key, dict(zip(t.column("page").to_pylist(), t.column("payload").to_pylist(), strict=True)))
        if not held[1]:
            raise LookupError(f"{request.vendor}: no board {request.company} for {request.term!r}")
        # a page past the end is an empty one
        return held[1].get(request.page) or json.dumps(_nested(VENDORS[request.vendor].entries, []))


def _nested(path: tuple[str, ...], value):
    for k in reversed(path):
        value = {k: value}
    return value


def record(pages: DataFrame, root: str) -> None:
    """Write pages (vendor, company, term, facet, page, payload) for Recorded to play back."""
    part = (F.crc32(F.col("company").cast("binary")) % Recorded.PARTS).cast("int").alias("part")
    pages.select("vendor", "company", "term", "facet", F.col("page").cast("int").alias("page"), "payload", part).repartition("part").write.partitionBy("part").mode("overwrite").parquet(root)


def scan(spark: SparkSession, vendor: str, boards: list[dict], terms: list[str] | None = None, transport: str = "recorded", **options) -> DataFrame:
    """The pages of some boards (company, perhaps source and facet). Conditions on the frame are pushed into the requests."""
    spark.dataSource.register(PagedBoards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("paged_boards").option("vendor", vendor).option("boards", json.dumps(boards)).option("terms", json.dumps(terms or [])).option("transport", transport)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def complete(pages: DataFrame) -> DataFrame:
    """Pages of the boards (source, company) of which none failed; a board that lacks a page has failed as a whole."""
    by = ["source", "company"]
    return pages.join(pages.where("error IS NOT NULL").select(*by).distinct(), by, "left_anti")


def budgeted(postings: DataFrame, most: int, key: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The first `most` postings of each board that differ by key, in the order of terms, pages and places. Later ones of the same key go first, so terms after the one that filled the budget add nothing, as if they had not been asked."""
    key, by = key or ["external_id"], by or ["source", "company"]
    order = ["term_no", "page", "pos"]
    first = postings.withColumn("__n", F.row_number().over(W.partitionBy(*by, *key).orderBy(*order))).where("__n = 1")
    return first.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def report(pages: DataFrame, postings: DataFrame, kept: DataFrame) -> DataFrame:
    """(source, company, pages, page_warnings, errors, found, kept): what budgets have cut, a row for each board."""
    by = ["source", "company"]
    p = pages.groupBy(*by).agg(F.count("page").alias("pages"), F.count("warning").alias("page_warnings"), F.count("error").alias("errors"))
    n = postings.groupBy(*by).agg(F.count_distinct("external_id").alias("found"))
    k = kept.groupBy(*by).agg(F.count("*").alias("kept"))
    return p.join(n, by, "left").join(k, by, "left").na.fill(0, ["found", "kept"])
