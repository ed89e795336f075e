"""Walks with cycles and budgets, and rules of hosts by what they begin with."""

import random
import re

from pyspark.sql import functions as F

from sieveline.operators import discovery, robots


def test_walk_ends_and_keeps_its_budget(spark):
    link = lambda *to: "".join(f'<a href="{x}">jobs</a>' for x in to)
    pages = {"https://a.example": link("/jobs/1", "/jobs/2"), "https://a.example/jobs/1": link("/jobs/2", "/jobs/3"), "https://a.example/jobs/2": link("/jobs/1", "https://a.example"), "https://a.example/jobs/3": "https://jobs.lever.co/aa " + link("/jobs/4"), "https://a.example/jobs/4": "https://boards.greenhouse.io/late"}
    pages |= {"https://b.example": link(*(f"/jobs/{i}" for i in range(5))), "https://b.example/jobs/4": "https://jobs.lever.co/bb"}
    p = spark.createDataFrame(list(pages.items()), "url string, html string")
    sites = spark.createDataFrame([("a", "https://a.example/"), ("b", "https://b.example"), ("c", "https://c.example")], "company string, website string")
    got = {r.company: (r.ats, r.identifier, r.url, r.depth) for r in discovery.frontier(sites, p, budget=6).collect()}
    assert got == {"a": ("lever", "aa", "https://a.example/jobs/3", 2), "b": ("lever", "bb", "https://b.example/jobs/4", 1), "c": (None,) * 4}
    got = {r.company: r.ats for r in discovery.frontier(sites, p, budget=4).collect()}
    assert got == {"a": "lever", "b": None, "c": None}
    assert {r.company: r.ats for r in discovery.frontier(sites, p, budget=6, rounds=1).collect()} == {"a": None, "b": "lever", "c": None}
    assert discovery.frontier(sites.limit(0), p).count() == 0


def test_rules_by_their_beginnings(spark):
    r = random.Random(2)
    bit = lambda: r.choice(["/a", "/b", "c", "*", "?x=1", ".", "+", "/", "é"])
    rules = [(f"h{r.randrange(3)}", "/" + "".join(bit() for _ in range(r.randrange(5))) + r.choice(["", "", "$"]), r.random() < 0.5) for _ in range(150)]
    urls = [(i, f"h{r.randrange(4)}", "https://h.example" + "".join(r.choice(["/a", "/b", "c", ".", "+", "/", "é"]) for _ in range(r.randrange(6)))) for i in range(300)]

    def allowed(host, url):
        target = url.removeprefix("https://h.example")
        if not target.startswith("/"):
            return None
        hits = [(len(p), a) for h, p, a in rules if h == host and re.match("^" + re.escape(p.removesuffix("$")).replace(r"\*", ".*") + ("$" if p.endswith("$") else ""), target)]
        return max(hits)[1] if hits else True

    u, t = spark.createDataFrame(urls, "i int, host string, url string"), spark.createDataFrame(rules, "host string, path string, allow boolean")
    out = robots.decided(u, t, ["i"], ["host"])
    got = {x.i: x.allowed for x in out.collect()}
    want = {i: allowed(h, x) for i, h, x in urls}
    assert all(got[i] == w for i, w in want.items() if w is not None) and len(set(want.values())) == 3
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.allowed for x in robots.decided(u, t.limit(0), ["i"]).collect()} == {True}


def test_many_rules(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("/p"), F.col("id"), F.lit("/*x")).alias("path"), (F.col("id") % 2 == 0).alias("allow"))
    urls = spark.range(2000).select("id", F.concat(F.lit("https://h/p"), F.col("id"), F.when(F.col("id") % 3 == 0, "/yx").otherwise("/y")).alias("url"))
    out = robots.decided(urls, rules, ["id"])
    assert out.where("allowed").count() == sum(i % 3 > 0 or i % 2 == 0 for i in range(2000))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
