"""Small cases of the listing operators."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as t
from sieveline.operators import classify, discovery, extract, filters, publish, robots, urls
from sieveline.plans.cycle import run_cycle
from sieveline.sources import config, state, vendors


def one(spark, column, **values):
    d = spark.range(1)
    for k, v in values.items():
        d = d.withColumn(k, F.lit(v))
    return d.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw", ["Élève  à\tParis ", "ﬁn ①", "straße ÇA", "", "a b"])
def test_normalize_exact(spark, raw):
    import unicodedata

    want = " ".join("".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower().split())
    assert one(spark, t.normalize(F.col("a"), exact=True), a=raw) == want


def test_text(spark):
    assert one(spark, t.strip_html(F.col("a"), True), a="<p>A &lt;b&gt;</p><b>x</b>  y<br>&eacute;") == "A <b>\nx y\né"
    assert one(spark, t.truncate(F.col("a"), 5), a="abcdefg") == "abcd…"
    assert one(spark, t.drop_location_suffix(F.col("a"), F.col("b")), a="Dev (Paris)", b="Paris") == "Dev"
    assert one(spark, t.city_from_slug(F.col("a")), a="https://x.example/job/Paris-Dev-75/123/") == "Paris"
    assert one(spark, t.when_reported(F.col("a")), a="Fri, 04 Sep 2026 10:23:59 Z").isoformat() == "2026-09-04T10:23:59"
    assert one(spark, t.retry_after(F.col("a")), a='{"retry_after": 2.5}') == 2.5
    assert one(spark, t.retry_after(F.col("a")), a="x") == 1.0


def test_classifier_window(spark):
    rows = [("Dev", "", "nous offrons un contrat d'alternance"), ("Dev", "", "vous encadrerez des stagiaires " + "x " * 80 + "poste"), ("Internal audit", "", ""), ("Stage dev", "", "au sein de"), ("Growth Stage Manager", "", "we grow"), ("Dev", "Apprenticeship", "")]
    d = spark.createDataFrame(rows, "title string, hint string, description string").select(classify.contract_type().alias("k"))
    assert [r.k for r in d.collect()] == ["apprenticeship", "other", "other", "internship", "other", "apprenticeship"]


def test_filter_portability(spark):
    d = spark.createDataFrame([("Paris 75001", "internship", "data"), ("", "internship", "data"), ("Lyon", "other", "data")], "location string, contract_type string, title string").withColumn("description", F.lit("")).withColumn("company", F.lit("c"))
    f = filters.Filters(filters.Locations(["75"]), filters.Keywords(["data"]))
    got = d.select(filters.apply(f).alias("f")).select("f.*").collect()
    assert [(r.passed, r.reason, r.matched_keywords) for r in got] == [(True, None, ["data"]), (True, None, ["data"]), (False, "contract_type", [])]
    with pytest.raises(ValueError):
        filters.Locations([])


def test_robots(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y$\nDisallow:\n\nUser-agent: b\nDisallow: /\n"
    r = robots.rules(spark.createDataFrame([("h", text)], "host string, text string"))
    assert sorted((x.path, x.allow) for x in r.collect()) == [("/x", False), ("/x/y$", True)]
    u = spark.createDataFrame([(1, "h", "https://h/x/y"), (2, "h", "https://h/x/yz"), (3, "h", "https://h"), (4, "g", "https://g/x")], "id int, host string, url string")
    assert {x.id: x.allowed for x in robots.decided(u, r, ["id"], ["host"]).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_even_sample_matches_indices(spark):
    for n in (0, 5, 41, 97):
        got = [r.pos for r in urls.even_sample(spark.range(n).withColumnRenamed("id", "pos"), 40).orderBy("pos").collect()]
        assert got == (list(range(n)) if n <= 40 else [int(i * n / 40) for i in range(40)])


def test_chunks(spark):
    d = spark.createDataFrame([(1, i, 100) for i in range(25)] + [(2, 0, 9000), (2, 1, 4000), (2, 2, 3000)], "g int, o int, c int")
    got = {}
    for r in publish.chunks(d, ["g"], "o", "c").collect():
        got.setdefault((r.g, r.chunk), []).append(r.o)
    assert [len(got[1, k]) for k in range(3)] == [10, 10, 5]
    assert [sorted(got[2, k]) for k in range(3)] == [[0], [1], [2]]


def test_sender_isolates_failures(spark):
    d = spark.createDataFrame([(0, ["a"], ["p0"]), (1, ["b"], ["p1"]), (2, ["c"], ["p2"])], "chunk int, job_ids array<string>, payloads array<string>")
    said = {"p0": [429, 200], "p1": [400], "p2": [500, 204]}
    assert publish.send(d, lambda p: (said[p[0]].pop(0), 0.0), sleep=lambda s: None) == ["a", "c"]
    assert publish.send(d, None, dry_run=True) == []


def test_microdata_and_fields(spark):
    page = '<div itemprop="description"><div>a</div><div>b <b>c</b></div></div><meta itemprop="city" content="Paris">'
    assert one(spark, extract.microdata(F.col("a")), a=page) == {"description": ["ab c"], "city": ["Paris"]}
    got = one(spark, extract.labelled_fields()(F.col("a")), a="Country\n\nFrance\nArea\nDomain\nIT\nActivities\nWork\n\nhard\nAdditional Information\nx")
    assert got.fields == {"Country": "France", "Domain": "IT"} and got.description == "Work\nhard"


def test_vendors(spark):
    raw = lambda p, c="co": spark.createDataFrame([("s", c, p if isinstance(p, str) else json.dumps(p))], "source string, company string, payload string")
    gh = {"jobs": [{"id": 1, "title": "A", "absolute_url": "https://x/1", "updated_at": "2024-01-02T03:04:05Z", "location": {"name": "Paris"}, "content": "<p>hi</p>"}, {"id": 2, "title": "B", "absolute_url": "https://x/2", "updated_at": "bad"}]}
    assert [(r.external_id, r.description) for r in vendors.parse(raw(gh), "greenhouse").collect()] == [("1", "hi")]
    wd = {"jobPostings": [{"title": "T", "externalPath": "/job/1", "bulletFields": ["R123", "Lyon"]}, {"title": "no path"}]}
    r = vendors.parse(raw(wd, "acme.wd3.jobs"), "workday").collect()
    assert [(x.location, x.url) for x in r] == [("Lyon", "https://acme.wd3.myworkdayjobs.com/jobs/job/1")]
    jb = {"jobs": [{"data": {"req_id": "9", "title": "J", "city": "Nice", "apply_url": "https://x/9"}}]}
    assert vendors.parse(raw(jb), "jibe").first().location == "Nice"
    assert vendors.parse(raw("{bad"), "smartrecruiters").count() == 0
    with pytest.raises(ValueError):
        vendors.parse(raw("{}"), "none")


def test_detection(spark):
    d = spark.createDataFrame([("see https://boards.greenhouse.io/acme", "https://a.example/"), ("x eightfold.ai", "https://careers.b.example/x"), ("acme.wd3.myworkdayjobs.com/en-US/ext", "u"), ("", "u")], "html string, url string")
    got = [tuple(r.f) for r in d.select(discovery.detect(F.col("html"), F.col("url")).alias("f")).collect()]
    assert got == [("greenhouse", "acme"), ("eightfold", "https://careers.b.example|b.example"), ("workday", "acme.wd3.ext"), (None, None)]


def test_two_cycles_publish_once(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    rows = [("s", "c", 0, i, str(i), f"Stage {i}", "Paris", "", f"https://x/{i}", None, f"un poste de stage {i}") for i in range(5)]
    p = spark.createDataFrame(rows, "source string, company string, company_idx int, pos int, external_id string, title string, location string, hint string, url string, source_posted_at string, description string")
    o = spark.createDataFrame([("s", "c", None, None, 5)], "source string, company string, build_error string, fetch_error string, n long")
    f = filters.Filters(filters.Locations(["paris"]))
    for day, want in ((1, 5), (2, 0)):
        c = run_cycle(p, o, state.load(spark, root), f, F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
        assert c.publishable.count() == want
        state.save(spark, root, f"d{day}", c.state)
    s = state.load(spark, root)
    assert s["jobs"].count() == 5 and s["health"].first().consecutive_failures == 0


def test_replayed_batch_starts_from_the_state_before_it(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    rows = [("s", "c", 0, i, str(i), f"Stage {i}", "Paris", "", f"https://x/{i}", None, f"un poste de stage {i}") for i in range(5)]
    p = spark.createDataFrame(rows, "source string, company string, company_idx int, pos int, external_id string, title string, location string, hint string, url string, source_posted_at string, description string")
    o = spark.createDataFrame([("s", "c", None, None, 5)], "source string, company string, build_error string, fetch_error string, n long")
    f = filters.Filters(filters.Locations(["paris"]))
    now = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")

    def run(batch, part, day):
        c = run_cycle(part, o, state.load(spark, root, batch), f, now(day))
        verdicts = sorted((r.job_id, r.verdict) for r in c.judged.collect())
        folder = state.save(spark, root, batch, c.state)
        held = sorted(map(str, state.load(spark, root)["jobs"].collect()))
        c.release()
        return verdicts, held, folder

    run("b0", p.where("pos < 3"), 1)
    once = run("b1", p, 2)
    again = run("b1", p, 2)  # the pointer had moved already
    assert once[:2] == again[:2] and once[2] != again[2] and {v for _, v in again[0]} == {"known", "new"}
    assert run("b2", p, 3)[0] == [(j, "known") for j, _ in once[0]]
    # an attempt that dies before the pointer moves leaves the state as it is
    before = sorted(map(str, state.load(spark, root)["jobs"].collect()))
    with pytest.raises(Exception):
        state.save(spark, root, "b3", {"jobs": state.load(spark, root)["jobs"], "fingerprints": p.select(F.raise_error(F.lit("lost")).alias("x"))})
    assert sorted(map(str, state.load(spark, root)["jobs"].collect())) == before
    assert len(state.prune(spark, root)) >= 3 and sorted(map(str, state.load(spark, root, "b2")["jobs"].collect())) and state.current(spark, root)["batch"] == "b2"


def test_stream_of_polls(spark, tmp_path):
    """A broken payload fails its source, and its jobs stay; a source that isn't known is skipped."""
    from sieveline.streaming import poll

    raw, root = tmp_path / "raw", f"file://{tmp_path}/state"
    raw.mkdir()
    jobs = lambda n, first=0: json.dumps({"jobs": [{"id": first + i, "title": f"Stage {i}", "absolute_url": f"https://x/{i}", "location": {"name": "Paris"}, "content": "un poste de stage"} for i in range(n)]})
    row = lambda ats, company, payload, day: json.dumps({"ats": ats, "source": ats, "company": company, "company_idx": 0, "payload": payload, "polled_at": f"2024-01-{day:02d}T00:00:00Z"})
    f = filters.Filters(filters.Locations(["paris"]))
    seen = []
    for day, lines in ((1, [row("greenhouse", "a", jobs(3), 1), row("greenhouse", "b", jobs(2, 10), 1)]), (2, [row("greenhouse", "a", "{bad", 2), row("greenhouse", "b", jobs(1, 10), 2), row("nobody", "z", "{}", 2)])):
        (raw / f"{day}.json").write_text("\n".join(lines))
        poll.start(spark, str(raw), root, f, str(tmp_path / "checkpoint"), on_new=lambda d, n: seen.append(d.count())).awaitTermination()
    s = state.load(spark, root)
    gone = {(r.company, r.external_id) for r in s["jobs"].where("disappeared_at IS NOT NULL").collect()}
    health = {r.company: (r.consecutive_failures, r.last_error) for r in s["health"].collect()}
    assert seen == [5, 0] and gone == {("b", "11")} and health["a"] == (1, "greenhouse: malformed payload") and health["b"][0] == 0 and "z" not in health


def test_delivery_marks_what_was_confirmed(spark):
    from sieveline.plans import cycle

    rows = [("s", "c", 0, i, str(i), f"Stage {i}", "Paris", "", f"https://x/{i}", "2024-01-01T00:00:00Z", f"un poste de stage {i}") for i in range(12)]
    p = spark.createDataFrame(rows, "source string, company string, company_idx int, pos int, external_id string, title string, location string, hint string, url string, source_posted_at string, description string")
    o = spark.createDataFrame([("s", "c", None, None, 12), ("s", "d", "no parser", None, 0)], "source string, company string, build_error string, fetch_error string, n long")
    empty = {n: spark.createDataFrame([], ddl) for n, ddl in state.TABLES.items()}
    c = cycle.run_cycle(p, o, empty, filters.Filters(filters.Locations(["paris"])), F.lit("2024-01-02").cast("timestamp"))
    sizes, now = [], F.lit("2024-01-02").cast("timestamp")

    def post(payloads):
        sizes.append(len(payloads))
        assert json.loads(payloads[0])["footer"] == "Source: s · Date reported by the company: 2024-01-01"
        return (400 if len(payloads) == 2 else 200), 0.0

    jobs, sent, failed = cycle.deliver(c, post, now)
    assert sizes == [10, 2] and len(sent) == 10 and failed == 2
    assert jobs.where("publish_pending = 1").count() == 2 and jobs.where("published_at IS NOT NULL").count() == 10
    assert cycle.deliver(c, None, now, dry_run=True)[1:] == ([], 0)
    said = publish.error_summary(cycle.errors(o), ["source", "company"], "poll").first()
    assert (said.failed, said.message) == (1, "poll: 1 source(s) failed this run:\n- no parser")
    assert publish.error_summary(cycle.errors(o).where("false"), ["source"], "poll").count() == 0
    assert cycle.all_failed(2, 2) and not cycle.all_failed(0, 0) and cycle.report(o, c).first().failed == 1
    c.release()


def test_webhooks_and_logs(spark):
    d = spark.createDataFrame([("https://discord.com/api/webhooks/12/ab-c",), ("https://discord.example/api/webhooks/12/a",), (None,)], "u string")
    assert [r.x for r in d.select(publish.is_webhook(F.col("u")).alias("x")).collect()] == [True, False, False]
    r = spark.createDataFrame([("a", "https://a", None, "lever", "x", "probable"), ("b", "https://b", "seen", None, None, "none")], "company string, website string, notes string, ats string, identifier string, confidence string")
    assert [x.value for x in discovery.unresolved_line(r).collect()] == ["b\thttps://b\tseen"]
    e = discovery.new_entries(r, spark.createDataFrame([], "ats string, identifier string"), ["company"])
    line = discovery.entry_line(e).first().value
    assert json.loads(line[2:]) == {"name": "a", "ats": "lever", "identifier": "x", "enabled": True, "tier": "cold", "tags": []}


def test_sitemap_board(spark):
    sites = spark.createDataFrame([("a", "https://a.example/sitemap.xml"), ("b", "https://b.example/sitemap.xml")], "company string, sitemap string")
    files = spark.createDataFrame([("https://a.example/sitemap.xml", "<loc>/jobs/1234</loc>"), ("https://b.example/sitemap.xml", "<loc>/about</loc>")], "url string, text string")
    pages = spark.createDataFrame([("https://a.example/jobs/1234", '<script type="application/ld+json">{"@type": "JobPosting"}</script>')], "url string, html string")
    assert [tuple(r) for r in discovery.sitemap_board(sites, files, pages).collect()] == [("a", "sitemap_jsonld", "https://a.example/sitemap.xml")]


def test_vendor_modes(spark):
    raw = lambda *rows: spark.createDataFrame(list(rows), "source string, company string, payload string")
    feed = '<rss xmlns:g="http://base.google.com/ns/1.0"><channel><item><title>A</title><link>https://x/1</link><g:id>1</g:id></item></channel></rss>'
    page = '<title>B Job Details | X</title><span itemprop="description">d</span>'
    got = vendors.parse(raw(("s", "c", feed), ("s", "https://x/job/Paris-B/2/", page)), "successfactors").collect()
    assert sorted((r.title, r.location) for r in got) == [("A", ""), ("B", "Paris")]
    assert [r.error for r in vendors.broken(raw(("s", "c", "<rss><channel>")), "successfactors_rss").collect()] == ["successfactors_rss: malformed feed"]
    assert [r.error for r in vendors.broken(raw(("s", "c", "<p>none</p>")), "jsonld").collect()] == ["jsonld: no posting found"]
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "T"}</script>'
    assert [r.url for r in vendors.parse(raw(("s", "https://board.example", ld)), "jsonld").collect()] == ["https://board.example"]
    assert vendors.parse(raw(("s", "https://p", ld)), "rendered").first().external_id == "https://p"
    ids = vendors.eightfold_ids(raw(("s", "c", '{"count": 3, "positions": [{"id": 1}, {"id": 2}]}'), ("s", "c", '{"positions": [{"id": 2}]}')))
    assert sorted(r.id for r in ids.collect()) == [1, 2]


def test_global_ranks(spark):
    for n in (0, 1, 1000):
        d = spark.range(n).select((F.col("id") * 7 % 1009).alias("o")).repartition(3)
        got = sorted((r.o, r["__n"]) for r in urls.global_rank(d, "o").collect())
        assert [x for _, x in got] == list(range(n))


def test_files_of_catalogs_and_settings(spark, tmp_path):
    (tmp_path / "b.yaml").write_text('[{"name": "b", "ats": "lever", "identifier": "y", "enabled": false}]')
    (tmp_path / "a.yaml").write_text('[{"name": "a", "ats": "workday", "identifier": "x"}]')
    c = config.requests(config.load_catalog(spark, str(tmp_path), {"lever", "workday"}), ["stage"], ["paris"])
    assert [(r.name, r.search_terms, r.locations) for r in c.collect()] == [("a", ["stage"], None)]
    (tmp_path / "c.yaml").write_text('[{"name": "a", "ats": "workday", "identifier": "x", "enabled": false}]')
    with pytest.raises(ValueError):
        config.load_catalog(spark, str(tmp_path), {"lever", "workday"})
    for text in ("{", '{"a": 1}', '[{"name": "a"}]'):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.load_catalog(spark, str(tmp_path), {"lever", "workday"})
    (tmp_path / "s.json").write_text('{"poll_concurrency": 2, "stale_after_days": 5}')
    s = config.load_settings(str(tmp_path / "s.json"), {"SIEVELINE_POLL_CONCURRENCY": "3"})
    assert (s.poll_concurrency, s.stale_after_days) == (3, 5)
    with pytest.raises(ValueError):
        config.load_settings(str(tmp_path / "none.json"))


def test_catalog_and_settings(spark):
    e = {"name": "a", "ats": "lever", "identifier": "x"}
    with pytest.raises(ValueError):
        config.catalog(spark, [e, e | {"enabled": False}], {"lever"})
    assert config.Settings.load({}, {"SIEVELINE_POLL_CONCURRENCY": "3"}).poll_concurrency == 3
    s = config.seeds(spark.createDataFrame([("# c",), ("Acme, acme.example",), ("https://jobs-x.example/a",)], "value string"))
    assert sorted(map(tuple, s.collect())) == [("Acme", "https://acme.example"), ("Jobs X", "https://jobs-x.example/a")]
