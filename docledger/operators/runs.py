"""Runs, events and cost (OPS-1 to OPS-7, OPS-10)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X

COUNTERS = ("discovered", "downloaded", "parsed", "ingested", "updated", "duplicates", "failed", "need_review", "excluded",
            "attachments_downloaded", "attachments_failed", "attachments_unparsed", "documents_incomplete", "llm_classified",
            "rule_classified", "llm_fallback", "reclassified", "reparsed", "attachments_cached", "input_tokens", "output_tokens",
            "elapsed_seconds")
ERROR_COUNTERS = ("failed", "attachments_failed", "attachments_unparsed", "documents_incomplete", "llm_fallback")


def fetch_queue(ledger: DataFrame, limit: int, retry_only: bool = False, source_id=None) -> DataFrame:
    """Per source: never checked first, then the oldest check, then id (OPS-1)."""
    rows = ledger.where("status = 'failed'") if retry_only else ledger
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    return skew.newest(rows, ["source_id"], [F.coalesce("last_checked_at", F.lit("")), F.col("id")], limit, rank="position")


def document_stats(results: DataFrame) -> DataFrame:
    """Counters of each processed document (OPS-2).

    `results`: run_id, source_id, outcome (ingested / updated / duplicate / reparsed / excluded / failed),
    is_new, downloaded, parsed, parse_error, need_review, method, reclassified, files (downloaded),
    files_failed, files_unparsed, files_cached, input_tokens, output_tokens, seconds.
    """
    def one(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("long")
    outcome, method = F.col("outcome"), F.col("method")
    values = {
        "discovered": one(F.col("is_new")), "downloaded": one(F.col("downloaded")), "parsed": one(F.col("parsed")),
        "ingested": one(outcome == "ingested"), "updated": one(outcome == "updated"), "duplicates": one(outcome == "duplicate"),
        "failed": one((outcome == "failed") | (F.col("files_failed") > 0)), "need_review": one(F.col("need_review") & outcome.isin("ingested", "updated")),
        "excluded": one(outcome == "excluded"), "attachments_downloaded": F.col("files"), "attachments_failed": F.col("files_failed"),
        "attachments_unparsed": F.col("files_unparsed"), "documents_incomplete": one(X.text("parse_error") != ""),
        "llm_classified": one(method == "llm"), "rule_classified": one(method == "rule"), "llm_fallback": one(method == "rule_fallback"),
        "reclassified": one(F.col("reclassified")), "reparsed": one(outcome == "reparsed"), "attachments_cached": F.col("files_cached"),
        "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "elapsed_seconds": F.col("seconds")}
    return results.select("run_id", "source_id", *[F.coalesce(values[c], F.lit(0)).alias(c) for c in COUNTERS])


def _totals():
    return [F.sum(c).alias(c) for c in COUNTERS]


def has_errors() -> Column:
    out = F.lit(False)
    for c in ERROR_COUNTERS:
        out = out | (F.col(c) > 0)
    return out


def run_status() -> Column:
    return F.when((F.col("failed") > 0) & (F.col("downloaded") == 0), "failed").when(has_errors(), "partial").otherwise("ok")


def run_stats(stats: DataFrame) -> DataFrame:
    """Counters and status of each run (OPS-3)."""
    return stats.groupBy("run_id").agg(*_totals()).withColumn("has_errors", has_errors()).withColumn("status", run_status())


def batch_stats(stats: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """Per source and per batch (source_id NULL, level 1) (OPS-4).

    `lost` names (run_id, source_id) of sources whose run raised: they count one failure and do not
    sink the batch. The batch is ok if all sources are, failed if none is, else partial.
    """
    rows = stats if lost is None else stats.unionByName(lost.withColumn("failed", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("_lost", F.lit(False)) if lost is None else rows.withColumn("_lost", F.col("downloaded").isNull())
    per = rows.groupBy("run_id", "source_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.bool_or("_lost").alias("_lost"))
    per = per.withColumn("status", F.when(F.col("_lost"), "failed").when(has_errors(), "partial").otherwise("ok"))
    out = per.rollup("run_id", "source_id").agg(F.grouping_id().alias("level"), *_totals(), F.min("status").alias("_status"),
                                                F.count_if(F.col("status") == "ok").alias("ok_sources"), F.count(F.lit(1)).alias("sources"))
    batch = F.when(F.col("ok_sources") == F.col("sources"), "ok").when(F.col("ok_sources") == 0, "failed").otherwise("partial")
    return out.where("level < 3").withColumn("status", F.when(F.col("level") == 0, F.col("_status")).otherwise(batch)).drop("_status")


def _newest(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    page = rows.orderBy(F.col("id").desc()).offset(offset)
    return page if limit is None else page.limit(limit)


def run_history(runs: DataFrame, limit: int | None = None, offset: int = 0, counters=COUNTERS) -> DataFrame:
    """Runs newest first, a page of them where `limit` is given, with the summary JSON expanded (OPS-5)."""
    shape = ", ".join(f"{c} DOUBLE" for c in counters)
    page = _newest(runs, limit, offset)
    return page.withColumn("_s", F.from_json("summary", shape)).select(*[c for c in runs.columns if c != "summary"], "_s.*")


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_timeline(events: DataFrame, run_id, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A run's events, or a page of them taken newest first, shown oldest first, with the total (OPS-6)."""
    own = events.where(F.col("run_id") == run_id)
    page = _newest(own, limit, offset)
    return page.crossJoin(own.agg(F.count(F.lit(1)).alias("total"))).orderBy("id")


def run_timelines(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The events of every run, or its newest `limit`, oldest first, with totals (OPS-6 for all runs)."""
    totals = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    events = events if limit is None else skew.newest(events, ["run_id"], [F.col("id").desc()], limit)
    return events.join(totals, "run_id").orderBy("run_id", "id")


def policy_timeline(events: DataFrame, links: DataFrame, policy_id=None, k: int = 30) -> DataFrame:
    """Last k events of any ledger row that fed the policy, oldest first (OPS-7)."""
    fed = links.select("policy_id", "fetch_id").distinct()
    fed = fed if policy_id is None else fed.where(F.col("policy_id") == policy_id)
    # the last k of a policy are among the last k of each of its fetches, so the join stays small
    recent = skew.newest(events, ["fetch_id"], [F.col("id").desc()], k)
    return skew.newest(recent.join(fed, "fetch_id"), ["policy_id"], [F.col("id").desc()], k).orderBy("policy_id", "id")


def token_cost(predictions: DataFrame, input_rate: float | None = None, output_rate: float | None = None, by=()) -> DataFrame:
    """Token sums; a cost only if every prediction reported usage and both rates are given (OPS-10)."""
    sums = predictions.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                                        F.bool_and(F.col("usage_reported") & (F.col("method") == "llm")).alias("usage_complete"))
    if input_rate is None or output_rate is None:
        return sums.withColumn("cost", F.lit(None).cast("double"))
    cost = (F.col("input_tokens") * F.lit(float(input_rate)) + F.col("output_tokens") * F.lit(float(output_rate))) / 1_000_000
    return sums.withColumn("cost", F.when(F.col("usage_complete"), cost))
