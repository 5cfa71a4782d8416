"""Queries over runs, events and human review."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import review as V, runs as O
from docledger.operators.identity import latest_version
from docledger.plans import binding as B
from docledger.plans.registry import query


@query("ops_fetch_queue", f"""WITH {B.POLICIES_SQL} SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY page_date, id) AS position FROM policies QUALIFY position <= 50""")
def fetch_queue(spark, sf):
    ledger = B.policies(spark, sf).select("source_id", "id", F.col("page_date").alias("last_checked_at"))
    return O.fetch_queue(ledger, 50).select("source_id", "id", "position")


@query("ops_retry_queue", f"""WITH {B.POLICIES_SQL} SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY updated_at, id) AS position FROM policies WHERE parse_error <> '' QUALIFY position <= 10""")
def retry_queue(spark, sf):
    ledger = B.policies(spark, sf).select("source_id", "id", F.col("updated_at").alias("last_checked_at"), F.when(F.col("parse_error") != "", "failed").otherwise("processed").alias("status"))
    return O.fetch_queue(ledger, 10, retry_only=True).select("source_id", "id", "position")


STATS_SQL = B.EVENTS_SQL + """, stats AS (SELECT user_id AS run_id, k AS source_id, (value > 10)::BIGINT AS discovered, (event_type <> 'error')::BIGINT AS downloaded, (event_type IN ('view', 'click', 'purchase', 'signup'))::BIGINT AS parsed,
  (event_type = 'view')::BIGINT AS ingested, (event_type = 'click')::BIGINT AS updated, (event_type = 'purchase')::BIGINT AS duplicates,
  (event_type = 'error' OR (CASE WHEN value > 60 THEN 1 ELSE 0 END) > 0)::BIGINT AS failed, (value < 20 AND event_type IN ('view', 'click'))::BIGINT AS need_review, (event_type = 'signup')::BIGINT AS excluded,
  1 AS attachments_downloaded, CASE WHEN value > 60 THEN 1 ELSE 0 END AS attachments_failed, CASE WHEN value < 1 THEN 1 ELSE 0 END AS attachments_unparsed, (k > 95)::BIGINT AS documents_incomplete,
  (k < 30)::BIGINT AS llm_classified, (k >= 30)::BIGINT AS rule_classified, 0 AS llm_fallback, (k < 5)::BIGINT AS reclassified, 0 AS reparsed, 0 AS attachments_cached, k AS input_tokens, 1 AS output_tokens, 2 AS elapsed_seconds FROM log)"""


def _stats(spark, sf):
    kind, value, k = F.col("event_type"), F.col("value"), F.col("k")
    outcome = F.when(kind == "view", "ingested").when(kind == "click", "updated").when(kind == "purchase", "duplicate").when(kind == "signup", "excluded").otherwise("failed")
    results = B.log(spark, sf).select(
        F.col("user_id").alias("run_id"), k.alias("source_id"), outcome.alias("outcome"), (value > 10).alias("is_new"), (kind != "error").alias("downloaded"), (kind != "error").alias("parsed"),
        F.when(k > 95, "bad").otherwise("").alias("parse_error"), (value < 20).alias("need_review"), F.when(k < 30, "llm").otherwise("rule").alias("method"), (k < 5).alias("reclassified"),
        F.lit(1).alias("files"), F.when(value > 60, 1).otherwise(0).alias("files_failed"), F.when(value < 1, 1).otherwise(0).alias("files_unparsed"), F.lit(0).alias("files_cached"),
        k.alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(2).alias("seconds"))
    return O.document_stats(results)


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in O.COUNTERS)
_ERR = " OR ".join(f"sum({c}) > 0" for c in O.ERROR_COUNTERS)


@query("ops_document_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def document_stats(spark, sf):
    return _stats(spark, sf)


@query("ops_run_stats", f"WITH {STATS_SQL} SELECT run_id, {_SUMS}, {_ERR} AS has_errors, CASE WHEN sum(failed) > 0 AND sum(downloaded) = 0 THEN 'failed' WHEN {_ERR} THEN 'partial' ELSE 'ok' END AS status FROM stats GROUP BY run_id")
def run_stats(spark, sf):
    return O.run_stats(_stats(spark, sf))


@query("ops_batch_stats", f"""WITH {STATS_SQL}, lost AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS run_id, 1000 AS source_id FROM lineitem),
  a AS (SELECT run_id, source_id, {_SUMS}, CASE WHEN {_ERR} THEN 'partial' ELSE 'ok' END AS status FROM stats GROUP BY 1, 2
    UNION ALL SELECT run_id, source_id, {', '.join('1' if c == 'failed' else '0' for c in O.COUNTERS)}, 'failed' FROM lost)
  SELECT run_id, source_id, CAST(grouping(source_id) AS BIGINT) AS level, {_SUMS}, count(*) FILTER (status = 'ok') AS ok_sources, count(*) AS sources,
    CASE WHEN grouping(source_id) = 0 THEN min(status) WHEN count(*) FILTER (status = 'ok') = count(*) THEN 'ok' WHEN count(*) FILTER (status = 'ok') = 0 THEN 'failed' ELSE 'partial' END AS status
  FROM a GROUP BY GROUPING SETS ((run_id, source_id), (run_id))""")
def batch_stats(spark, sf):
    lost = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.lit(1000).alias("source_id")).distinct()
    return O.batch_stats(_stats(spark, sf), lost)


@query("ops_run_history", """SELECT event_id AS id, event_type AS status, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events ORDER BY event_id DESC LIMIT 20 OFFSET 40""")
def run_history(spark, sf):
    runs = B.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("props").alias("summary"))
    return O.run_history(runs, 20, 40, counters=("k",))


@query("ops_run_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def run_counts(spark, sf):
    return O.run_counts(B.table(spark, sf, "events").select(F.col("event_type").alias("status")))


def _events(spark, sf):
    return B.log(spark, sf).select("id", F.col("user_id").alias("run_id"), F.col("user_id").alias("fetch_id"), "event_type")


@query("ops_run_timeline", "SELECT event_id AS id, event_type, (SELECT count(*) FROM events WHERE user_id = 7) AS total FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 20 OFFSET 10")
def run_timeline(spark, sf):
    return O.run_timeline(_events(spark, sf), 7, 20, 10).select("id", "event_type", "total")


@query("ops_run_timelines", "SELECT user_id AS run_id, event_id AS id, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def run_timelines(spark, sf):
    return O.run_timelines(_events(spark, sf), 50).select("run_id", "id", "total")


@query("ops_policy_timeline", "SELECT o_orderkey AS policy_id, event_id AS id FROM events JOIN orders ON o_custkey = user_id QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY event_id DESC) <= 30")
def policy_timeline(spark, sf):
    links = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("fetch_id"))
    return O.policy_timeline(_events(spark, sf), links).select("policy_id", "id")


_REVIEW_SQL = B.POLICIES_SQL + """, pol AS (SELECT *, parse_error <> '' AS incomplete FROM flagged),
act AS (SELECT event_id // 2 AS policy_id, CASE event_type WHEN 'click' THEN 'adjust' WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'approve' ELSE 'confirm' END AS action,
  event_type = 'click' AND value < 20 AS goodcats, event_id FROM events),
j AS (SELECT act.*, p.category AS category FROM act LEFT JOIN pol p ON p.id = policy_id),
w AS (SELECT *, CASE WHEN category IS NULL THEN '政策不存在' WHEN action = 'approve' THEN '未知审核动作' WHEN action = 'adjust' AND NOT goodcats THEN '请选择有效的政策分类'
  WHEN action = 'confirm' AND category = '' THEN '未分类政策请先调整分类后采纳' ELSE '' END AS bad FROM j),
why AS (SELECT *, CASE WHEN bad = '' AND event_id <> min(event_id) FILTER (bad = '') OVER (PARTITION BY policy_id) THEN '同一批次已有该政策的审核动作' ELSE bad END AS why FROM w)"""


def _reviewed(spark, sf):
    p = B.policies(spark, sf).select("id", "category", "category_names", "review_status", "todo_type", "need_review", "parse_requires_review", F.lit("pending").alias("is_investment_policy"),
                                     (F.col("parse_requires_review") == 1).alias("material_gap"), (F.col("parse_error") != "").alias("incomplete"))
    kind = F.col("event_type")
    actions = B.log(spark, sf).select(
        F.floor(F.col("id") / 2).alias("policy_id"), F.when(kind == "click", "adjust").when(kind == "purchase", "reject").when(kind == "signup", "approve").otherwise("confirm").alias("action"),
        F.when(F.col("value") < 20, F.array(F.lit("guide"), F.lit("access"), F.lit("guide"))).otherwise(F.array(F.lit("bogus"))).alias("categories"),
        F.lit("n").alias("note"), F.lpad(F.col("id").cast("string"), 12, "0").alias("created_at"))
    return V.apply_review(p, actions)


@query("ops_apply_review", f"""WITH {_REVIEW_SQL}, ok AS (SELECT * FROM why WHERE why = '')
  SELECT p.id, CASE action WHEN 'adjust' THEN 'guide,access' ELSE p.category END AS category, CASE action WHEN 'adjust' THEN '引导类,准入类' ELSE p.category_names END AS category_names,
   CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'adjust' THEN 'adjusted' WHEN 'reject' THEN 'rejected' ELSE review_status END AS review_status,
   CASE WHEN action IS NULL THEN todo_type WHEN action <> 'reject' AND incomplete THEN 'material' ELSE 'none' END AS todo_type, CASE WHEN action IS NULL THEN need_review ELSE 0 END AS need_review,
   parse_requires_review, CASE WHEN action IS NULL THEN 'pending' WHEN action = 'reject' THEN 'no' ELSE 'yes' END AS is_investment_policy FROM pol p LEFT JOIN ok ON policy_id = p.id""")
def apply_review(spark, sf):
    return _reviewed(spark, sf)[0]


@query("ops_review_refused", f"WITH {_REVIEW_SQL} SELECT policy_id, action, why FROM why WHERE why <> ''")
def review_refused(spark, sf):
    return _reviewed(spark, sf)[2]


@query("ops_review_history", f"""WITH {_REVIEW_SQL} SELECT policy_id, action, lpad(CAST(event_id AS VARCHAR), 12, '0') AS created_at, p.review_status AS before, CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'adjust' THEN 'adjusted' ELSE 'rejected' END AS after
  FROM why JOIN pol p ON p.id = policy_id WHERE why = ''""")
def review_history(spark, sf):
    e = V.review_history(_reviewed(spark, sf)[1])
    return e.select("policy_id", "action", "created_at", F.get_json_object("before_json", "$.review_status").alias("before"), F.get_json_object("after_json", "$.review_status").alias("after"))


@query("ops_token_cost", """SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS input_tokens, count(*) AS output_tokens, bool_and(value > 0.5) AS usage_complete,
  CASE WHEN bool_and(value > 0.5) THEN round((sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) * 2.5 + count(*) * 10.0) / 1000000, 9) END AS cost FROM events GROUP BY user_id""")
def token_cost(spark, sf):
    p = B.log(spark, sf).select("user_id", F.col("k").alias("input_tokens"), F.lit(1).alias("output_tokens"), (F.col("value") > 0.5).alias("usage_reported"), F.lit("llm").alias("method"))
    return O.token_cost(p, 2.5, 10.0, by=["user_id"]).withColumn("cost", F.round("cost", 9))
