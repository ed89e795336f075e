"""The sink: messages, confirmations, failures, and tasks that die."""

import json
import os

from pyspark.sql import functions as F

from sieveline.operators import health
from sieveline.sources import delivery


class Picky(delivery.Accepting):
    """Refuses or breaks on some payloads."""

    def post(self, payloads):
        if any("break" in p for p in payloads) and not os.path.exists(self.posts + "-mended"):
            raise ConnectionError("gone")
        if any("refuse" in p for p in payloads):
            return 400, 0.0
        return super().post(payloads)


def rows(spark, n, **odd):
    return spark.createDataFrame([(f"j{i:03d}", i, odd.get(f"x{i}", "p") + f"{i}") for i in range(n)], "job_id string, seq long, payload string")


def sent(d):
    return sorted(r.job_id for r in d.collect())


def posts(folder):
    return sorted(len(json.load(open(os.path.join(folder, f)))) for f in os.listdir(folder))


def test_messages_are_bounded_and_confirmed(spark, tmp_path):
    root, box = f"file://{tmp_path}/r", str(tmp_path / "box")
    os.mkdir(box)
    d = rows(spark, 25)
    got = delivery.deliver(d, F.col("seq"), F.col("payload"), root, posts=box)
    assert sent(got) == [f"j{i:03d}" for i in range(25)] and posts(box) == [5, 10, 10]
    assert json.load(open(tmp_path / "r/_outcome")) == {"outcome": "committed", "tasks": 1, "messages": 3, "sent": 25, "repeated": 0, "failed": 0}
    # once more: nothing is sent twice
    assert len(sent(delivery.deliver(d, F.col("seq"), F.col("payload"), root, posts=box))) == 25 and posts(box) == [5, 10, 10]
    assert delivery.confirmed(spark, f"file://{tmp_path}/none").count() == 0


def test_refused_messages_stay_pending(spark, tmp_path):
    box = str(tmp_path / "box")
    os.mkdir(box)
    got = delivery.deliver(rows(spark, 30, x12="refuse"), F.col("seq"), F.col("payload"), f"file://{tmp_path}/r", "tests.test_delivery:Picky", posts=box)
    assert sent(got) == [f"j{i:03d}" for i in [*range(10), *range(20, 30)]]


def test_a_lost_tasks_rows_stay_pending_until_it_is_tried_again(spark, tmp_path):
    root, box = f"file://{tmp_path}/r", str(tmp_path / "box")
    os.mkdir(box)
    d = rows(spark, 40, x25="break")
    got = sent(delivery.deliver(d, F.col("seq"), F.col("payload"), root, "tests.test_delivery:Picky", must_end=False, posts=box))
    assert got == [f"j{i:03d}" for i in range(20)] and json.load(open(tmp_path / "r/_outcome"))["outcome"] == "aborted"
    open(box + "-mended", "w").close()
    got = sent(delivery.deliver(d, F.col("seq"), F.col("payload"), root, "tests.test_delivery:Picky", posts=box))
    assert len(got) == 40 and posts(box) == [10] * 4


def test_what_is_tried_again():
    class Scripted:
        def __init__(self, *said):
            self.said = list(said)

        def post(self, payloads):
            return self.said.pop(0)

    waits = []
    assert delivery.posted(Scripted((429, 2.5), (204, 0)), [], sleep=waits.append) and waits == [2.5]
    assert delivery.posted(Scripted((503, 0), (200, 0)), []) and not delivery.posted(Scripted((503, 0), (503, 0)), [])
    assert not delivery.posted(Scripted((404, 0)), [])
    long = [delivery_row(3), delivery_row(9000), delivery_row(5999), delivery_row(1), delivery_row(1)]
    assert [len(m) for m in delivery.messages(iter(long), 10, 6000)] == [1, 1, 2, 1]


def delivery_row(n):
    from types import SimpleNamespace

    return SimpleNamespace(chars=n)


def test_health_is_combined_before_its_shuffle(spark):
    data = [(k, t, o == "+", 1, "e" + o) for k, s in (("a", "+--+--"), ("b", "---"), ("c", "-+"), (None, "+-"), ("d", "+")) for t, o in enumerate(s)]
    d = spark.createDataFrame(data, "k string, at int, ok boolean, n int, error string")
    out = health.fold(d, ["k"], ["at"])
    assert {r.k: (r.consecutive_failures, r.last_success_at, r.last_failure_at) for r in out.collect()} == {"a": (2, 3, 5), "b": (3, None, 2), "c": (0, 1, 0), None: (1, 0, 1), "d": (0, 0, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan and "partial_count" in plan
