"""Streaming queries, run to completion over the whole event and page tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docledger.functions import skew
from docledger.plans import binding as B
from docledger.plans.classify import RULES, VERDICT_SQL
from docledger.plans.registry import query
from docledger.session import ensure_checkpoint_dir
from docledger.sources import sinks as K
from docledger.streaming import answers as A, streams as T


def _scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    # a pattern for the one table: it can be a file, which is no base path of a stream, or a folder of files
    return spark.readStream.schema(B.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _run(spark, rows, keys, order):
    """Run an update-mode query over everything available; the newest row per key is its result."""
    root = _scratch(spark)

    def save(df, batch_id):
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
    q = rows.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out").drop("batch")
    last = out.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return out.join(last, [*keys, "_batch"], "left_semi").drop("_batch")


def _log(spark, sf):
    return _stream(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("str_run_progress", "SELECT user_id AS run_id, event_type AS action, CASE WHEN value > 20 THEN 'ok' ELSE 'attention' END AS status, count(*) AS n FROM events GROUP BY 1, 2, 3")
def run_progress(spark, sf):
    e = _log(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("action"), F.when(F.col("value") > 20, "ok").otherwise("attention").alias("status"))
    return _run(spark, T.run_progress(e), ["run_id", "action", "status"], "n")


@query("str_latest_attempts", f"WITH {B.ATTEMPTS_SQL} SELECT fetch_id, url, id, download_status FROM attempts QUALIFY row_number() OVER (PARTITION BY fetch_id, url ORDER BY id DESC) = 1")
def latest_attempts(spark, sf):
    a = _log(spark, sf).select("id", F.col("user_id").alias("fetch_id"), F.concat(F.lit("https://files.example.org/"), "k").alias("url"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("download_status"),
                               F.lit("").alias("parse_status"), F.lit("").alias("error"))
    return _run(spark, T.latest_attempts(a), ["fetch_id", "url"], "id").select("fetch_id", "url", "id", "download_status")


@query("str_newest_observations", f"WITH {B.EVENTS_SQL} SELECT user_id AS source_id, CAST(k AS VARCHAR) AS page_url, arg_max(event_type, id) AS title FROM log GROUP BY 1, 2")
def newest_observations(spark, sf):
    o = _log(spark, sf).select(F.col("user_id").alias("source_id"), F.col("k").cast("string").alias("page_url"), F.col("event_type").alias("title"), F.lit(1).alias("admitted"), F.lit("").alias("reason"), F.col("id").alias("observed_at"))
    return _run(spark, T.newest_observations(o), ["source_id", "page_url"], "observed_at").select("source_id", "page_url", "title")


def _batches(spark, rows, fn):
    """Run a foreachBatch function over everything available."""
    rows.writeStream.foreachBatch(fn).option("checkpointLocation", f"{_scratch(spark)}/ck").trigger(availableNow=True).start().awaitTermination()


@query("str_first_sightings", "SELECT user_id AS source_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS page_url, CAST(epoch_us(min(ts)) AS BIGINT) AS first_at, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def first_sightings(spark, sf):
    root = f"{_scratch(spark)}/out"
    o = _log(spark, sf).select(F.col("user_id").alias("source_id"), F.col("k").alias("page_url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("observed_at"))
    _batches(spark, o, T.first_sightings_batch(root))
    return spark.read.parquet(root).groupBy("source_id", "page_url").agg(F.min("observed_at").alias("first_at"), F.count(F.lit(1)).alias("n"))


def _life_events(e):
    kind = F.col("event_type")
    status = F.when(kind == "view", "discovered").when(kind == "click", "downloaded").when(kind == "purchase", "processed").when(kind == "signup", "excluded").otherwise("failed")
    return e.select("id", F.col("user_id").alias("fetch_id"), status.alias("status"))


_LIFE_SQL = """WITH RECURSIVE e AS (SELECT user_id AS fetch_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
    CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'downloaded' WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'excluded' ELSE 'failed' END AS status FROM events),
allowed(a, b) AS (VALUES ('', 'discovered'), ('discovered', 'downloaded'), ('discovered', 'failed'), ('downloaded', 'processed'), ('downloaded', 'excluded'), ('downloaded', 'failed'),
    ('failed', 'downloaded'), ('failed', 'failed'), ('processed', 'downloaded'), ('processed', 'failed'), ('excluded', 'downloaded'), ('excluded', 'failed')),
w AS (SELECT fetch_id, 0 AS n, '' AS status, 0 AS steps, 0 AS refused FROM e GROUP BY 1
    UNION ALL SELECT w.fetch_id, w.n + 1, CASE WHEN a.b IS NULL THEN w.status ELSE e.status END, w.steps + CASE WHEN a.b IS NULL THEN 0 ELSE 1 END, w.refused + CASE WHEN a.b IS NULL THEN 1 ELSE 0 END
    FROM w JOIN e ON e.fetch_id = w.fetch_id AND e.n = w.n + 1 LEFT JOIN allowed a ON a.a = w.status AND a.b = e.status)
SELECT fetch_id, nullif(arg_max(status, n), '') AS status, max(steps)::BIGINT AS steps, max(refused)::BIGINT AS refused FROM w GROUP BY 1"""


@query("str_lifecycle", _LIFE_SQL)
def lifecycle(spark, sf):
    root = f"{_scratch(spark)}/state"
    _batches(spark, _life_events(_log(spark, sf)), T.lifecycle_batch(root))
    return T.lifecycle_state(spark, root)


@query("ops_lifecycle", _LIFE_SQL)
def lifecycle_table(spark, sf):
    return T.lifecycle(_life_events(B.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")))


PAGE_DOCS_SQL = r"""docs AS (
  SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source_name, url AS page_url, '' AS lang,
         trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
         regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '<[^>]*>|\s+', '', 'g') AS content
  FROM pages)"""
#: What becomes of each page when all arrive in one batch at an empty ledger.
INGEST_SQL = VERDICT_SQL.replace(B.DOCS_SQL, PAGE_DOCS_SQL) + r""", k AS (SELECT j.*, d.source_name, d.page_url, is_investment_policy <> 'no' AS kept,
    d.source_name || ':' || lower(regexp_replace(d.title, '[《》"“”\s]', '', 'g')) AS base_key,
    sha256('["' || replace(replace(d.content, '\', '\\'), '"', '\"') || '", []]') AS hash FROM judged j JOIN docs d USING (id)),
f AS (SELECT base_key, min(id) AS founder FROM k WHERE kept GROUP BY 1),
o AS (SELECT k.*, CASE WHEN fh.id < k.id THEN 'duplicate' WHEN NOT k.kept THEN 'excluded' WHEN k.id = f.founder THEN 'ingested' ELSE 'suspected_duplicate' END AS outcome
    FROM k LEFT JOIN f USING (base_key) LEFT JOIN k fh ON fh.id = f.founder AND fh.hash = k.hash),
ledger AS (SELECT *, outcome = 'suspected_duplicate' AS suspected, CASE WHEN outcome = 'suspected_duplicate' THEN base_key || ':variant:' || substr(sha256(page_url), 1, 16) ELSE base_key END AS policy_key FROM o)"""


def fetched_pages(pages):
    return pages.withColumnRenamed("url", "page_url").withColumn("source_name", F.regexp_extract("page_url", "^[a-z]+://([^/?#]*)", 1))


@query("str_ingest", f"""WITH {INGEST_SQL} SELECT id, outcome, CASE WHEN outcome = 'excluded' THEN reason ELSE '' END AS reason,
  CASE WHEN outcome IN ('ingested', 'suspected_duplicate') THEN policy_key END AS policy_key, CASE WHEN outcome IN ('ingested', 'suspected_duplicate') THEN 1::BIGINT END AS version,
  CASE WHEN outcome IN ('ingested', 'suspected_duplicate') THEN todo_type END AS todo_type,
  CASE WHEN outcome IN ('ingested', 'suspected_duplicate') THEN CASE WHEN need_review OR suspected OR is_investment_policy = 'pending' THEN 'pending' ELSE 'confirmed_auto' END END AS review_status FROM ledger""")
def ingest(spark, sf):
    """Pages in micro-batches to the stored ledger; the result lists what became of each page."""
    root = _scratch(spark)
    T.ingest_stream(fetched_pages(_stream(spark, sf, "pages")), f"{root}/ledger", f"{root}/ck", RULES).awaitTermination()
    fetched, stored = K.read_committed(spark, f"{root}/ledger", "fetch_records"), K.read_committed(spark, f"{root}/ledger", "policies")
    return fetched.join(stored.select("id", "policy_key", "version", "todo_type", "review_status"), "id", "left") \
        .select("id", "outcome", "reason", "policy_key", "version", "todo_type", "review_status")


@query("str_late_repost", f"""WITH {INGEST_SQL} SELECT id, turn, CASE WHEN outcome IN ('ingested', 'suspected_duplicate') THEN CASE turn WHEN 1 THEN outcome WHEN 2 THEN 'updated' ELSE 'duplicate' END ELSE outcome END AS outcome
  FROM ledger, (VALUES (1), (2), (3)) AS t(turn) WHERE outcome IN ('ingested', 'suspected_duplicate', 'excluded') OR turn = 1""")
def late_repost(spark, sf):
    """Each page, its revision, and the first text again (STR-6): the repost never becomes a new version."""
    root = _scratch(spark)
    pages = fetched_pages(B.table(spark, sf, "pages"))
    for turn in (1, 2, 3):
        # a revision has one more paragraph; later turns leave out the pages that repeat another one
        html = F.replace("html", F.lit("</article>"), F.lit("<p>(rev)</p></article>")) if turn == 2 else F.col("html")
        now = pages.withColumn("html", html).withColumn("page_id", F.col("page_id") + (turn - 1) * 10**9)
        if turn > 1:
            first = K.read_committed(spark, f"{root}/ledger", "fetch_records").where("id < 1000000000 AND outcome <> 'duplicate'")
            now = now.join(first.select("page_url"), "page_url", "left_semi")
        T.ingest_batch(f"{root}/ledger", RULES)(now, turn)
    out = K.read_committed(spark, f"{root}/ledger", "fetch_records")
    return out.select((F.col("id") % 10**9).alias("id"), (F.floor(F.col("id") / 10**9) + 1).cast("int").alias("turn"), "outcome")


#: Pages by id: 2 mod 4 are answered yes, 3 no; 0 get no answer and 1 one that comes a day late, so both fall back on the rules.
_ANSWERED_SQL = INGEST_SQL.replace("judged AS (SELECT *, todo_type", "ruled AS (SELECT *, todo_type").replace(", k AS (SELECT j.*", """, judged AS (SELECT ruled.* REPLACE (
    CASE id % 4 WHEN 2 THEN 'yes' WHEN 3 THEN 'no' ELSE CASE is_investment_policy WHEN 'no' THEN 'pending' ELSE is_investment_policy END END AS is_investment_policy,
    CASE id % 4 WHEN 2 THEN 'review' WHEN 3 THEN 'none' ELSE 'system' END AS todo_type, id % 4 = 2 AS need_review, CASE id % 4 WHEN 3 THEN 'out of scope' ELSE reason END AS reason) FROM ruled), k AS (SELECT j.*""")


def _answers(pages):
    """Model answers derived from the pages: one chunk each, prompt or a day late."""
    kind = F.col("page_id") % 4
    yes = F.to_json(F.struct(F.lit("yes").alias("is_investment_policy"), F.array(F.lit("guide")).alias("category"), F.lit("").alias("evidence"), F.lit(False).alias("need_review"), F.lit(0.9).alias("confidence")))
    no = F.to_json(F.struct(F.lit("no").alias("is_investment_policy"), F.array().cast("array<string>").alias("category"), F.lit("out of scope").alias("category_reason"), F.lit("正文").alias("evidence"),
                            F.lit(False).alias("need_review"), F.lit(0.9).alias("confidence")))
    at = F.when(kind == 1, F.lit("2026-01-02 00:00:00")).otherwise(F.lit("2026-01-01 00:20:00")).cast("timestamp")
    return pages.where(kind > 0).select(F.col("page_id").alias("id"), F.lit(0).alias("chunk"), at.alias("at"), F.when(kind == 3, no).otherwise(yes).alias("body"))


@query("str_model_answers", f"""WITH {_ANSWERED_SQL}, fin AS (SELECT *, outcome IN ('ingested', 'suspected_duplicate') AS stored FROM ledger)
  SELECT id, outcome, CASE WHEN outcome = 'excluded' THEN reason ELSE '' END AS reason, CASE WHEN stored THEN policy_key END AS policy_key, CASE WHEN stored THEN todo_type END AS todo_type,
    CASE WHEN stored THEN CASE WHEN need_review OR suspected OR is_investment_policy = 'pending' THEN 'pending' ELSE 'confirmed_auto' END END AS review_status,
    CASE WHEN stored THEN CASE WHEN id % 4 < 2 THEN 'rule_fallback' ELSE 'llm' END END AS method, stored AND id % 4 = 1 AS retry FROM fin""")
def model_answers(spark, sf):
    """Pages wait for their answers (STR-1, CLS-11 to CLS-14) and end in the ledger; late answers are candidates for a retry (CLS-18)."""
    root, chunk = _scratch(spark), 100_000
    pages = fetched_pages(_stream(spark, sf, "pages"))
    ended = A.ended_pages(A.questions(pages, F.lit("2026-01-01 00:00:00").cast("timestamp"), chunk), _answers(_stream(spark, sf, "pages")), 4 * 3600)
    _batches(spark, ended, A.ended_batch(root, fetched_pages(B.table(spark, sf, "pages")), RULES, chunk_size=chunk))
    ledger, stored = K.read_committed(spark, f"{root}/ledger", "fetch_records"), K.read_committed(spark, f"{root}/ledger", "policies")
    retry = A.retry_candidates(spark, root).select("id", F.lit(True).alias("retry"))
    return ledger.join(stored.select("id", "policy_key", "todo_type", "review_status", F.col("classification_method").alias("method")), "id", "left").join(retry, "id", "left") \
        .select("id", "outcome", "reason", "policy_key", "todo_type", "review_status", "method", F.coalesce("retry", F.lit(False)).alias("retry"))


@query("str_refetch", f"""WITH {INGEST_SQL}, kept AS (SELECT *, outcome IN ('ingested', 'suspected_duplicate') AS stored, CASE WHEN need_review OR suspected OR is_investment_policy = 'pending' THEN 'pending' ELSE 'confirmed_auto' END AS auto FROM ledger)
  SELECT id, turn, CASE turn WHEN 1 THEN outcome WHEN 2 THEN CASE WHEN stored THEN 'duplicate' ELSE outcome END ELSE CASE WHEN stored THEN 'updated' ELSE outcome END END AS outcome,
    CASE WHEN NOT stored THEN NULL WHEN turn = 3 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN stored THEN CASE WHEN turn > 1 THEN '2026-09-01' ELSE '' END END AS page_date,
    CASE WHEN stored THEN CASE WHEN turn = 3 THEN 'pending' WHEN turn = 2 AND id % 3 = 0 THEN 'adjusted' ELSE auto END END AS review_status,
    CASE WHEN stored AND turn = 2 THEN 'metadata_backfill' END AS action
  FROM kept, (VALUES (1), (2), (3)) AS t(turn) WHERE stored OR turn = 1""")
def refetch(spark, sf):
    """Each page, the same page with a date (no version, human decisions stay, VER-12 to VER-14), and a revision of it (a version)."""
    root, turns = _scratch(spark), None
    pages = fetched_pages(B.table(spark, sf, "pages"))
    for turn in (1, 2, 3):
        html = F.col("html") if turn == 1 else F.replace("html", F.lit("<head>"), F.lit('<head><meta name="PubDate" content="2026-09-01">'))
        html = F.replace(html, F.lit("</article>"), F.lit("<p>(rev)</p></article>")) if turn == 3 else html
        now = pages.withColumn("html", html).withColumn("page_id", F.col("page_id") + (turn - 1) * 10**9)
        if turn > 1:
            # pages that were stored are fetched again; a person has adjusted every third policy in the meantime
            own = T.current_policies(spark, f"{root}/ledger")
            now = now.join(own.where("id < 1000000000").select("page_url"), "page_url", "left_semi")
            if turn == 2:
                K.store_batch(f"{root}/ledger", 11, {"policies": own.where("id % 3 = 0").withColumn("review_status", F.lit("adjusted"))})
        T.ingest_batch(f"{root}/ledger", RULES)(now, turn * 10)
        fetched = K.read_committed(spark, f"{root}/ledger", "fetch_records").where(F.col("batch_id") == turn * 10).drop("batch_id")
        events = K.read_committed(spark, f"{root}/ledger", "review_events").where(F.col("batch_id") == turn * 10).select("policy_id", "action")
        # pages of the second turn stand for the policies of the first
        policy = F.when(F.lit(turn) == 2, F.col("id") % 10**9).otherwise(F.col("id"))
        state = T.current_policies(spark, f"{root}/ledger").select(F.col("id").alias("policy_id"), "version", "page_date", "review_status")
        rows = skew.pinned(fetched.withColumn("policy_id", policy).join(state, "policy_id", "left").join(events, "policy_id", "left")
                           .select((F.col("id") % 10**9).alias("id"), F.lit(turn).alias("turn"), "outcome", "version", "page_date", "review_status", "action"))
        turns = rows if turns is None else turns.unionByName(rows)
    return turns
