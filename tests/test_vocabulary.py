"""Vocabularies of many terms and windows around matches, against plain patterns of Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import automaton, classify, filters


def test_many_terms_as_patterns_have_them(spark):
    r = random.Random(4)
    letters = ["a", "b", "é", "_", "1", " ", "+", "-", "c"]
    folded = ["c++", "a b", "-a", "b", "ab", "1", "", "é", "_", *{"".join(r.choice(letters) for _ in range(r.randrange(1, 4))).strip() for _ in range(120)}]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(150)] + ["", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for mode in ("word", "substring"):
        got = {row.i: row.h for row in d.select("i", automaton.terms_in(F.col("x"), folded, folded, mode).alias("h")).collect()}
        for i, t in enumerate(texts):
            has = (lambda w: w and re.search(rf"\b{re.escape(w)}\b", t)) if mode == "word" else (lambda w: w in t)
            assert got[i] == ([] if t is None else [w for w in folded if has(w)]), (mode, t)


def test_large_lists_filter_like_small_ones(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(" ".join(r.choices(words, k=6)), r.choice(["Paris", "Lyon", "", "Oslo"]), r.choice(["internship", "other"])) for _ in range(80)]
    d = spark.createDataFrame(rows, "title string, location string, contract_type string").withColumns({"description": F.lit("Ünïque Term"), "company": F.lit("c")})
    f = filters.Filters(filters.Locations(["paris", "lyon"], ["x"]), filters.Keywords([*words[:70], "unique term"], words[150:], "word"))
    answers = []
    for many in (64, 10**6):
        monkeypatch.setattr(filters, "MANY", many)
        answers.append(d.select(filters.apply(f).alias("f")).select("f.*").collect())
    assert answers[0] == answers[1] and {x.reason for x in answers[0]} == {None, "contract_type", "location_not_included", "keyword_excluded"}


def test_time_does_not_grow_with_the_terms():
    """States that are visited are those of the text: many terms give no more steps than few."""
    few, many = (automaton.build([f"term{i:05d}" for i in range(n)])[0] for n in (5, 5000))
    text = "a text without any of them " * 50
    assert list(few.iter(text)) == list(many.iter(text)) == []
    assert automaton.found(many, "x term00007 term04999.", True) == {7, 4999}
    with pytest.raises(ValueError, match="bound"):
        automaton.build(["x"] * (automaton.MAX_TERMS + 1))


@pytest.mark.parametrize("window", [0, 1, 7, 60])
def test_windows_as_cut_by_characters(spark, window):
    r = random.Random(window)
    lex = classify.Lexicon(("alpha", r"be(?:t)a"), ("intern",), ("stage",), ("de",), ("offer", "job now"), window)
    pool = ["alpha", "beta", "offer", "joffer", "job now", "x", "offers", "\U0001f600", "\U00020000", "élan", "\n", "alphabet", "beta-offer"]
    texts = ["".join(r.choice(pool) + r.choice([" ", "", " " * 5, " xxxxxxx "]) for _ in range(r.randrange(30))) for _ in range(300)] + ["", "alpha", "offer" + " " * 60 + "alpha", "offer" + " " * 61 + "alpha", "alpha" + " " * 55 + "offer", "alpha" + " " * 56 + "offer"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {row.i: row.n for row in d.select("i", classify.near_offer(lex, lex.apprenticeship, F.col("x")).alias("n")).collect()}
    hit, offer = re.compile(classify.pattern(lex.apprenticeship)), re.compile(classify.pattern(lex.offer))
    for i, t in enumerate(texts):
        assert got[i] == any(offer.search(t[max(0, m.start() - window) : m.end() + window]) for m in hit.finditer(t)), t
