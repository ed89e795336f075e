"""What the reviewer of round 3 found."""

import random
import types

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from sieveline.functions import text as t
from sieveline.llm import toxicity
from sieveline.operators.classify import Lexicon, contract_type
from sieveline.streaming import stateful


def test_known_entities_alone(spark):
    """A title that is cut within an entity keeps what is left of it, where only a table's entities count."""
    d = spark.createDataFrame([("<title>a&amp;&am</title><p>b&amp</p>{c&amp;lt;&lt;}&eacute;",)], ["x"])
    known = {"&amp;": "&", "&lt;": "<"}
    assert d.select(t.strip_html(F.col("x"), known=known)).first()[0] == "a&&am\nb&amp\n{c&lt;<}&eacute;"
    assert d.select(t.strip_html(F.col("x"))).first()[0] == "a&&am\nb&\n{c&lt;<}é"


def test_texts_are_folded_once(spark):
    """The plan of a contract type folds title, hint and description once each, and windows are cut as before."""
    lex = Lexicon(("aa",), ("bb",), ("cc",), ("dd",), ("ok",))
    rows = [("", "", x) for x in ("aa" + "." * 58 + "okay", "aa" + "." * 59 + "okay", "ok" + "." * 58 + "aa", "ok" + "." * 59 + "aa", "ok aa", "bok aa", "ok bb", "ok cc dd", "ok cc", "ok" + "." * 70 + "aa bb ok")]
    d = spark.createDataFrame(rows, "title string, hint string, description string").select("description", contract_type(lex).alias("k"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(trim(") == 3  # one fold each
    assert [r.k for r in d.collect()] == ["apprenticeship", "other", "apprenticeship", "other", "apprenticeship", "other", "internship", "internship", "other", "apprenticeship"]


class Held:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows


def test_state_is_read_and_written_by_bucket():
    """A thousand jobs of a bucket take two calls of the store and one timer; the timer ages those that are due, and sets the next."""
    held, timers = Held(), []
    jobs = stateful.Jobs(7, 180, 90)
    jobs.init(types.SimpleNamespace(getListState=lambda *a: held, registerTimer=timers.append))
    day = stateful.DAY_US
    rows = [Row(job_id=f"j{i}", seq=i, at=(i % 2) * day, mark="m", fp_seen=None, fp_again=False) for i in range(1000)]
    out = list(jobs.handleInputRows((3,), iter(rows), None))
    assert len(out) == 2000 and held.calls == 2 and timers == [90 * day // 1000 + 1]
    at = lambda ms: (types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), types.SimpleNamespace(getExpiryTimeInMs=lambda: timers[-1]))
    aged = list(jobs.handleExpiredTimer((3,), *at(timers[0])))
    assert {r.job_id for r in aged} == {f"j{i}" for i in range(0, 1000, 2)} and {r.is_stale for r in aged} == {1}
    assert timers[-1] == 91 * day // 1000 + 1
    assert len(list(jobs.handleExpiredTimer((3,), *at(timers[-1])))) == 500 and sum(x[3] for x in held.rows) == 1000


def test_only_chosen_features_come_to_the_driver(spark, monkeypatch):
    """Of texts with hundreds of words of their own, the driver gets the features that are chosen; the model is that of all of them in memory."""
    r = random.Random(3)
    texts = [" ".join([f"own{r.random()}" for _ in range(300)] + r.sample(("bad worse worst awful" if i % 4 == 0 else "fine good calm mild").split(), 3)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    sizes, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (sizes.append((t := real(self)).nbytes), t)[1])
    names, weights, bias = toxicity.train(docs, labels)
    assert sum(sizes) < 20_000
    out = {x.doc_id for x in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    of = toxicity.WordFeatures()
    rows = sorted(((np.array(toxicity.features(t, of), np.int32), i % 4 == 0) for i, t in enumerate(texts) if i not in out), key=lambda x: (len(x[0]), x[0].tobytes()))
    want = toxicity.fit([f for f, c in rows if c], [f for f, c in rows if not c], len([x for x in rows if x[1]]) / len(rows))
    assert len(names) and (names == want[0]).all() and (weights == want[1]).all() and bias == want[2]
