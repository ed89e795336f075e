"""A poll cycle as one plan: postings -> filter -> verdicts -> next state, and what to publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import fingerprint, job_id
from ..operators import filters, health, publish, verdict
from ..operators.classify import Lexicon, contract_type


@dataclass
class Cycle:
    judged: DataFrame
    rejected: DataFrame
    state: dict[str, DataFrame]
    publishable: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give up what was kept; call it when the state is saved."""
        for d in self.held:
            d.unpersist()


def run_cycle(postings: DataFrame, outcomes: DataFrame, state: dict[str, DataFrame], config: filters.Filters, now, lexicon: Lexicon = Lexicon(), seed: bool = False, exact: bool = False, settings=None) -> Cycle:
    """postings (company_idx, pos, POSTING columns), outcomes (source, company, build_error, fetch_error, n), now a timestamp column.

    Parsing, classifying and judging are done once and kept for all that reads them, until the cycle is released; what a
    lost executor held is computed again. Rejected postings leave no state, but count as present. Only new ones of this cycle are publishable; the backlog of
    earlier failures is verdict.pending(state["jobs"]).
    """
    days = (settings.resurrection_window_days, settings.repost_window_days, settings.stale_after_days) if settings else (7, 180, 90)
    p = postings.withColumn("contract_type", contract_type(lexicon, exact)).withColumn("job_id", job_id(exact)).withColumn("content_fingerprint", fingerprint(exact))
    p = p.withColumn("filter", filters.apply(config, exact)).withColumn("seq", F.col("company_idx").cast("long") * (1 << 32) + F.col("pos"))
    p = p.persist(StorageLevel.DISK_ONLY)
    kept = p.where("filter.passed")
    judged = verdict.verdicts(kept, state["jobs"], state["fingerprints"], now, days[0], days[1], seed).persist(StorageLevel.DISK_ONLY)
    routed = health.routed(outcomes, state["health"], ["source", "company"])
    jobs = verdict.next_jobs(judged, state["jobs"], now)
    jobs = verdict.mark_absent(jobs, p, routed.where("outcome = 'success'"), now)
    jobs = verdict.age_ghosts(jobs, now, days[2])
    heard = routed.where("outcome <> 'skipped'").select("source", "company", (F.col("outcome") == "success").alias("ok"), "n", F.coalesce("fetch_error", F.lit("empty board")).alias("error"))
    h = state["health"].join(heard, ["source", "company"], "full")
    ok, bad = F.coalesce("ok", F.lit(False)), F.coalesce(~F.col("ok"), F.lit(False))
    h = h.select(
        "source", "company", F.when(ok, now).otherwise(F.col("last_success_at")).alias("last_success_at"), F.when(bad, now).otherwise(F.col("last_failure_at")).alias("last_failure_at"),
        F.when(ok, 0).when(bad, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.col("consecutive_failures")).cast("int").alias("consecutive_failures"),
        F.when(bad, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.greatest(F.coalesce("has_seen_postings", F.lit(0)), (ok & (F.col("n") > 0)).cast("int")).alias("has_seen_postings"),
    )
    after = {"jobs": jobs, "fingerprints": verdict.next_fingerprints(judged, state["fingerprints"], now), "health": h}
    return Cycle(judged, p.where("NOT filter.passed"), after, judged.where("verdict = 'new'"), (judged, p))


def report(outcomes: DataFrame, cycle: Cycle) -> DataFrame:
    """One row: attempted, failed, fetched, passing, rejected and the verdicts as a map."""
    o = outcomes.agg(F.count("*").alias("attempted"), F.count_if(F.col("build_error").isNotNull() | F.col("fetch_error").isNotNull()).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"))
    v = cycle.judged.groupBy("verdict").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("verdict", "c"))).alias("verdicts"), F.coalesce(F.sum("c"), F.lit(0)).alias("passing"))
    return o.crossJoin(v)  # one row each


def payloads(publishable: DataFrame, keywords: str = "filter.matched_keywords") -> DataFrame:
    """publishable -> (chunk, job_ids, payloads): messages in order, each within its bounds, embeds as JSON."""
    e = publishable.withColumn("e", publish.embed(F.col(keywords), F.col("posted_at") if "posted_at" in publishable.columns else None)).withColumn("__g", F.lit(0))
    each = e.select("__g", "seq", "job_id", publish.embed_chars("e").alias("chars"), F.to_json("e").alias("payload"))
    placed = publish.chunks(each, ["__g"], "seq", "chars").join(each.select("seq", "job_id", "payload"), "seq")
    rows = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "job_id", "payload"))).alias("r"))  # a message holds ten at most
    return rows.select("chunk", F.col("r.job_id").alias("job_ids"), F.col("r.payload").alias("payloads"))


def deliver(cycle: Cycle, post, now, dry_run: bool = False, **how) -> tuple[DataFrame, list[str], int]:
    """Send what the cycle publishes, then mark what was confirmed: the next jobs table, the ids that were sent, and how many failed.

    Messages that fail leave their postings pending. A dry run sends and marks nothing.
    """
    jobs, spark = cycle.state["jobs"], cycle.judged.sparkSession
    sent = publish.send(payloads(cycle.publishable), post, dry_run=dry_run, **how)
    if dry_run:
        return jobs, [], 0
    failed = cycle.publishable.count() - len(sent)
    return verdict.mark_published(jobs, spark.createDataFrame([(x,) for x in sent], "job_id string"), now), sent, failed


def errors(outcomes: DataFrame) -> DataFrame:
    """Outcomes (source, company, build_error, fetch_error) -> (source, company, error) of those that have one."""
    return outcomes.select("source", "company", F.coalesce("build_error", "fetch_error").alias("error")).where("error IS NOT NULL")


def all_failed(attempted: int, failed: int) -> bool:
    return failed == attempted > 0
