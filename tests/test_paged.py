"""Paged boards: what is planned, pushed and read, and what budgets and failures leave."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sieveline.sources import paged, vendors


def payload(vendor, entries, total):
    v = paged.VENDORS[vendor]
    out = {}
    for path, x in ((v.entries, entries), (v.total, total)):
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = x
    return json.dumps(out)


def workday(n, total, start=0):
    return payload("workday", [{"title": f"Job {i}", "externalPath": f"/job/{i}", "locationsText": "Paris"} for i in range(start, start + n)], total)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rows = []
    for c, n in (("a.wd1.X", 45), ("b.wd1.X", 700), ("c.wd1.X", 3)):
        for p in range(1, -(-n // 20) + 1):
            rows.append(("workday", c, "", "", p, workday(min(20, n - 20 * (p - 1)), n, 20 * (p - 1))))
    for term, first in (("data", 0), ("ml", 10)):
        rows += [("workday", "d.wd1.X", term, f, p, workday(n, 25, first + 20 * (p - 1))) for f in ("", "fr") for p, n in ((1, 20), (2, 5))]
    rows += [("workday", "e.wd1.X", "", "", 1, "<html>"), ("workday", "f.wd1.X", "", "", 1, workday(20, 60)), ("workday", "f.wd1.X", "", "", 2, workday(4, 24, 20)), ("workday", "g.wd1.X", "", "", 1, workday(20, 40)), ("workday", "g.wd1.X", "", "", 2, '{"jobPostings": null}')]
    rows += [("eightfold", "h|x", "", "", p, payload("eightfold", [{"id": 10 * p + i} for i in range(10 if p < 4 else 2)], 32)) for p in range(1, 5)]
    rows += [("jibe", "j", "", "", 1, payload("jibe", [{"data": {"slug": "s1", "title": "T"}}, {"bad": 1}, {"data": {"slug": "s2", "title": "U"}}], 3)), ("smartrecruiters", "s", "", "", 1, payload("smartrecruiters", [{"id": "1", "name": "A"}, {"name": None}, {"id": "3", "name": "C"}], 3))]
    path = "file://" + str(tmp_path_factory.mktemp("pages"))
    paged.record(spark.createDataFrame(rows, "vendor string, company string, term string, facet string, page int, payload string"), path)
    return path


def boards(*names):
    return [{"company": f"{n}.wd1.X"} for n in names]


def requests(log):
    return sorted((r["company"], r["term"], r["facet"], r["page"], r["start"]) for r in (json.load(open(os.path.join(log, f))) for f in os.listdir(log)))


def test_pages_follow_the_first_ones_total(spark, root, tmp_path):
    pages = paged.scan(spark, "workday", boards("a", "c"), root=root, log=tmp_path, each=1)
    assert pages.rdd.getNumPartitions() == 4  # three pages of a, one of c
    got = sorted((r.company, r.page, r.start, r.total, r.entries, r.warning, r.error) for r in pages.collect())
    assert got == [("a.wd1.X", 1, 0, 45, 20, None, None), ("a.wd1.X", 2, 20, 45, 20, None, None), ("a.wd1.X", 3, 40, 45, 5, None, None), ("c.wd1.X", 1, 0, 3, 3, None, None)]
    ids = [r.external_id for r in vendors.parse(pages.where("company = 'a.wd1.X'"), "workday").collect()]
    assert sorted(ids) == sorted(f"/job/{i}" for i in range(45))


def test_conditions_are_pushed_into_requests(spark, root, tmp_path):
    d = paged.scan(spark, "workday", boards("a", "d", "c"), ["data", "ml", "none"], root=root, log=tmp_path)
    d = d.where((F.col("company") == "d.wd1.X") & F.col("term").isin("ml", "other") & (F.col("facet") == "fr"))
    assert sorted((r.company, r.term, r.facet, r.page) for r in d.collect()) == [("d.wd1.X", "ml", "fr", 1), ("d.wd1.X", "ml", "fr", 2)]
    assert set(requests(tmp_path)) == {("d.wd1.X", "ml", "fr", 1, 0), ("d.wd1.X", "ml", "fr", 2, 20)}
    assert d.where("term = 'data'").count() == 0


def test_caps_warn_and_short_pages_end(spark, root):
    pages = paged.scan(spark, "workday", boards("b", "f"), root=root).collect()
    b = sorted((r.page, r.warning) for r in pages if r.company == "b.wd1.X")
    assert [p for p, _ in b] == list(range(1, 21)) and [w for _, w in b] == [None] * 19 + ["15 pages beyond the cap of 20 were not read"]
    assert sorted((r.page, r.entries) for r in pages if r.company == "f.wd1.X") == [(1, 20), (2, 4)]  # its total has shrunk
    own = paged.scan(spark, "workday", boards("b"), root=root, pages=3).collect()
    assert max(r.page for r in own) == 3 and sum(r.warning is not None for r in own) == 1


def test_failures_are_rows_and_fail_the_board(spark, root):
    pages = paged.scan(spark, "workday", boards("c", "e", "g", "nobody"), root=root)
    errors = {r.company: r.page for r in pages.where("error IS NOT NULL").collect()}
    assert errors == {"e.wd1.X": 1, "g.wd1.X": 2, "nobody.wd1.X": 1}
    assert {r.company for r in paged.complete(pages).collect()} == {"c.wd1.X"}


def test_page_size_measured_from_the_first(spark, root):
    pages = paged.scan(spark, "eightfold", [{"company": "h|x"}], root=root)
    assert sorted((r.page, r.start, r.entries) for r in pages.collect()) == [(1, 0, 10), (2, 10, 10), (3, 20, 10), (4, 30, 2)]
    assert spark.createDataFrame([], "company string").count() == 0 == paged.scan(spark, "eightfold", [], root=root).count()


@pytest.mark.parametrize(("vendor", "company", "ids"), [("jibe", "j", ["s1", "s2"]), ("smartrecruiters", "s", ["1", "3"])])
def test_bad_entries_between_good_ones(spark, root, vendor, company, ids):
    pages = paged.scan(spark, vendor, [{"company": company}], root=root)
    assert sorted(r.external_id for r in vendors.parse(pages, vendor).collect()) == ids


def test_budget_keeps_the_first_over_terms(spark, root):
    pages = paged.scan(spark, "workday", boards("d"), ["data", "ml"], root=root)
    found = vendors.parse(pages, "workday")
    assert found.count() == 50
    kept = paged.budgeted(found, 30)
    assert {r.external_id for r in kept.collect()} == {f"/job/{i}" for i in range(30)}
    r = paged.report(pages, found, kept).first()
    assert (r.pages, r.page_warnings, r.errors, r.found, r.kept) == (4, 0, 0, 35, 30)


class Flaky:
    """Fails once, or always."""

    def __init__(self, options):
        self.left = int(options["fails"])

    def page(self, request):
        if self.left:
            self.left -= 1
            raise paged.Transient("later")
        return workday(2, 2)


def test_transient_errors_are_tried_once_more():
    request = paged.Request("workday", "a", "", "", 1, 0, 20)
    assert len(paged.asked(Flaky({"fails": 1}), request)[1]) == 2
    with pytest.raises(paged.Transient):
        paged.asked(Flaky({"fails": 2}), request)


def test_folding_is_exact_for_every_character(spark):
    """Over all code points, but for letters that only one of the two tables of cases has."""
    import unicodedata

    from sieveline.functions import text as t

    points = [n for n in range(1, 0x30000) if not 0xD800 <= n < 0xE000]
    d = spark.createDataFrame([(n, f"a{chr(n)}B") for n in points], "n int, x string")
    got = {r.n: r.y for r in d.select("n", t.normalize(F.col("x")).alias("y")).collect()}

    def fold(x):
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return " ".join(x.lower().split())

    wrong = [n for n in points if got[n] != fold(f"a{chr(n)}B")]
    assert len(wrong) <= 40 and all(unicodedata.category(chr(n)) in ("Lu", "Ll", "Lt", "Cn", "Mn") for n in wrong), [hex(n) for n in wrong]
