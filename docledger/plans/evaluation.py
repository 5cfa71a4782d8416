"""Queries over evaluation and sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import evaluate as E, identity as I, sampling as S
from docledger.plans import binding as B
from docledger.plans.classify import VERDICT_SQL, verdicts
from docledger.plans.registry import query

# labels: quality 1 is relevant; toxic adds classes
GOLD_SQL = """gold AS (SELECT doc_id AS id, quality = 1 AS relevant, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN ['access', 'incentive'] ELSE ['guide'] END ELSE [] END AS categories FROM labels)"""
PRED_SQL = VERDICT_SQL + ", " + GOLD_SQL + """, pred AS (SELECT j.*, CASE lang WHEN 'en' THEN 'llm' WHEN 'fr' THEN 'rule_fallback' ELSE 'rule' END AS method FROM judged j),
p AS (SELECT g.relevant, g.categories AS truth, pred.*, is_investment_policy = 'yes' AS yes,
   CASE WHEN is_investment_policy = 'yes' THEN list_filter(string_split(category, ','), lambda c: c <> '') ELSE [] END AS claimed FROM gold g JOIN pred USING (id)),
q AS (SELECT *, len(list_intersect(truth, claimed)) AS hit, len(claimed) - len(list_intersect(truth, claimed)) AS extra, len(truth) - len(list_intersect(truth, claimed)) AS miss FROM p)"""


def _gold(spark, sf):
    c = F.when(F.col("toxic") == 1, F.array(F.lit("access"), F.lit("incentive"))).otherwise(F.array(F.lit("guide")))
    return B.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant"),
                                               F.when(F.col("quality") == 1, c).otherwise(F.array().cast("array<string>")).alias("categories"),
                                               F.when(F.col("toxic") == 1, "human_reviewed").alias("label_status"))


def _pred(spark, sf):
    lang = F.col("lang")
    return verdicts(spark, sf).withColumn("method", F.when(lang == "en", "llm").when(lang == "fr", "rule_fallback").otherwise("rule")) \
        .select("id", "lang", "is_investment_policy", "category", "need_review", "todo_type", "method")


def _r(a, b):
    return f"round_even(CAST({a} AS DOUBLE) / nullif({b}, 0), 4)"


_SCORE = f"""count(*) AS labeled_records, {_r('count(*) FILTER (yes AND relevant)', 'count(*) FILTER (yes)')} AS relevance_precision,
  {_r('count(*) FILTER (yes AND relevant)', 'count(*) FILTER (relevant)')} AS relevance_recall,
  {_r('2 * count(*) FILTER (yes AND relevant)', 'count(*) FILTER (yes) + count(*) FILTER (relevant)')} AS relevance_f1,
  {_r('sum(hit)', 'sum(hit) + sum(extra)')} AS category_micro_precision, {_r('sum(hit)', 'sum(hit) + sum(miss)')} AS category_micro_recall,
  {_r('2 * sum(hit)', '2 * sum(hit) + sum(extra) + sum(miss)')} AS category_micro_f1,
  {_r("count(*) FILTER (is_investment_policy <> 'pending' AND yes = relevant AND extra = 0 AND miss = 0)", 'count(*)')} AS exact_match,
  {_r("count(*) FILTER (is_investment_policy <> 'pending')", 'count(*)')} AS decision_coverage,
  count(*) FILTER (yes AND relevant) AS tp, count(*) FILTER (yes AND NOT relevant) AS fp, count(*) FILTER (NOT yes AND relevant) AS fn,
  count(*) FILTER (is_investment_policy = 'no' AND NOT relevant) AS tn, count(*) FILTER (is_investment_policy = 'pending') AS pending,
  count(*) FILTER (method = 'rule_fallback') AS rule_fallback, count(*) FILTER (need_review) AS need_review"""


@query("eva_score", f"WITH {PRED_SQL} SELECT {_SCORE} FROM q")
def score(spark, sf):
    return E.score(_gold(spark, sf), _pred(spark, sf))


@query("eva_score_by_class", f"""WITH {PRED_SQL} SELECT c AS category, count(*) FILTER (list_contains(truth, c) AND list_contains(claimed, c)) AS tp, count(*) FILTER (NOT list_contains(truth, c) AND list_contains(claimed, c)) AS fp,
  count(*) FILTER (list_contains(truth, c) AND NOT list_contains(claimed, c)) AS fn FROM q, (SELECT unnest(['guide', 'access', 'guarantee', 'incentive']) AS c) GROUP BY c""")
def score_by_class(spark, sf):
    return E.score_by_class(_gold(spark, sf), _pred(spark, sf))


@query("eva_compare_methods", f"""WITH {PRED_SQL} SELECT lang AS run, {_SCORE}, count(*) FILTER (method = 'llm') AS llm_classified,
  false AS run_complete, 'incomplete' AS evaluation_status FROM q GROUP BY lang""")
def compare_methods(spark, sf):
    labelled = _pred(spark, sf).join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return E.compare_methods(_gold(spark, sf), labelled.withColumnRenamed("lang", "run"))


@query("eva_label_violations", f"""WITH {B.KEYED_SQL}, l AS (SELECT k.id, toxic = 1 AS relevant, CASE WHEN quality = 1 THEN ['guide', 'guide'] WHEN lang = 'fr' THEN ['x'] ELSE [] END AS cats,
    CASE lang WHEN 'es' THEN 'done' ELSE 'ai_draft' END AS label_status, page_url, CASE lang WHEN 'de' THEN 'xyz' ELSE content_sha256 END AS h FROM keyed k JOIN labels ON doc_id = k.id)
  SELECT id, concat_ws(';', CASE WHEN id <= 0 THEN '标注 id 必须为正整数' END, CASE WHEN list_contains(cats, 'x') THEN '非法分类标签，categories 必须为四类字符串数组' END, CASE WHEN len(cats) = 2 THEN '分类标签重复' END,
    CASE WHEN (len(cats) > 0) <> relevant THEN '相关文件必须有分类；非相关文件应无分类标签' END, CASE WHEN label_status = 'done' THEN '非法 label_status' END,
    CASE WHEN h = 'xyz' THEN 'content_sha256 必须为原采集内容指纹' END, CASE WHEN count(*) OVER (PARTITION BY page_url, h) > 1 THEN '标注来源版本重复' END) AS violations FROM l""")
def label_violations(spark, sf):
    d = I.content_fingerprint(B.docs(spark, sf)).join(B.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    lang = F.col("lang")
    cats = F.when(F.col("quality") == 1, F.array(F.lit("guide"), F.lit("guide"))).when(lang == "fr", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = d.select("id", (F.col("toxic") == 1).alias("relevant"), cats.alias("categories"), F.when(lang == "es", "done").otherwise("ai_draft").alias("label_status"),
                    "page_url", F.when(lang == "de", "xyz").otherwise(F.col("content_sha256")).alias("content_sha256"))
    return E.label_violations(rows).select("id", F.array_join("violations", ";").alias("violations"))


@query("eva_label_summary", f"""WITH {B.KEYED_SQL}, l AS (SELECT k.*, toxic FROM keyed k JOIN labels ON doc_id = k.id)
  SELECT count(*) AS total, count(*) FILTER (lang = 'en' AND toxic = 0) AS ai_draft, count(*) FILTER (toxic = 1) AS human_reviewed, count(*) FILTER (lang <> 'en' AND toxic = 0) AS unspecified, count(*) FILTER (lang <> 'fr') AS snapshot_bound FROM l""")
def label_summary(spark, sf):
    d = I.content_fingerprint(B.docs(spark, sf)).join(B.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    status = F.when(F.col("toxic") == 1, "human_reviewed").when(F.col("lang") == "en", "ai_draft")
    return E.label_summary(d.select("id", "page_url", F.when(F.col("lang") == "fr", "").otherwise(F.col("content_sha256")).alias("content_sha256"), status.alias("label_status")))


@query("eva_resolve_labels", f"""WITH {B.KEYED_SQL}, l AS (SELECT k.*, CASE lang WHEN 'de' THEN '' ELSE page_url END AS lu, CASE lang WHEN 'fr' THEN content_sha256 ELSE '' END AS lh, CASE lang WHEN 'es' THEN title || ' x' ELSE title END AS lt FROM keyed k JOIN labels ON doc_id = k.id),
  m AS (SELECT l.*, CASE WHEN lu <> '' AND lh <> '' THEN (SELECT count(*) FROM keyed k WHERE k.page_url = lu AND k.content_sha256 = lh) WHEN lu <> '' THEN (SELECT count(*) FROM keyed k WHERE k.page_url = lu) ELSE 1 END AS n,
    CASE WHEN lu <> '' AND lh <> '' THEN (SELECT max(id) FROM keyed k WHERE k.page_url = lu AND k.content_sha256 = lh) WHEN lu <> '' THEN (SELECT max(id) FROM keyed k WHERE k.page_url = lu) ELSE id END AS pid FROM l),
  t AS (SELECT *, CASE WHEN n = 1 THEN pid END AS policy_id FROM m), u AS (SELECT *, count(policy_id) OVER (PARTITION BY policy_id) AS taken FROM t)
  SELECT id, policy_id, CASE WHEN n <> 1 THEN '来源版本缺失或不唯一' WHEN lt <> title THEN 'title 与数据库不匹配' WHEN taken > 1 THEN '多条标注匹配同一数据库记录' ELSE '' END AS problem FROM u""")
def resolve_labels(spark, sf):
    docs = I.content_fingerprint(B.docs(spark, sf))
    l = docs.join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    lang = F.col("lang")
    labels = l.select("id", F.when(lang == "de", "").otherwise(F.col("page_url")).alias("page_url"), F.when(lang == "fr", F.col("content_sha256")).otherwise("").alias("content_sha256"),
                      F.when(lang == "es", F.concat("title", F.lit(" x"))).otherwise(F.col("title")).alias("title"), F.lit("").alias("wenhao"))
    return E.resolve_labels(labels, docs).select("id", "policy_id", "problem")


@query("eva_material_readiness", f"""WITH {B.ATTACHMENTS_SQL}, t AS (SELECT policy_id, string_agg('[附件：' || name || ']' || chr(10) || parsed_text, chr(10) || chr(10) ORDER BY id) FILTER (parsed_text <> '') AS t, count(*) AS n, count(*) FILTER (parse_status <> 'ok') AS bad FROM attachments GROUP BY 1),
  d AS (SELECT o_orderkey AS id, o_orderpriority AS content, '[正文]' || chr(10) || o_orderpriority || coalesce(chr(10) || chr(10) || t, '') AS a, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM orders JOIN labels ON doc_id = o_orderkey LEFT JOIN t ON policy_id = o_orderkey)
  SELECT id, length(content) AS body_chars, length(a) AS analysis_chars, n AS attachments, bad AS attachments_incomplete, sha256(a) AS analysis_sha256 FROM d""")
def material_readiness(spark, sf):
    docs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    return E.material_readiness(B.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), docs, B.attachments(spark, sf))


@query("eva_error_types", f"""WITH {PRED_SQL} SELECT id, concat_ws(',', CASE WHEN method <> 'llm' THEN 'service_failure_or_fallback' END, CASE WHEN is_investment_policy = 'pending' THEN 'pending' END,
  CASE WHEN relevant AND is_investment_policy = 'no' THEN 'false_exclusion' END, CASE WHEN NOT relevant AND yes THEN 'false_inclusion' END, CASE WHEN miss > 0 THEN 'missing_categories' END, CASE WHEN extra > 0 THEN 'extra_categories' END) AS errors FROM q""")
def error_types(spark, sf):
    return E.error_types(_gold(spark, sf), _pred(spark, sf)).select("id", F.array_join("errors", ",").alias("errors"))


@query("eva_error_counts", f"""WITH {PRED_SQL}, e AS (SELECT unnest(list_filter([CASE WHEN method <> 'llm' THEN 'service_failure_or_fallback' END, CASE WHEN is_investment_policy = 'pending' THEN 'pending' END,
  CASE WHEN relevant AND is_investment_policy = 'no' THEN 'false_exclusion' END, CASE WHEN NOT relevant AND yes THEN 'false_inclusion' END, CASE WHEN miss > 0 THEN 'missing_categories' END, CASE WHEN extra > 0 THEN 'extra_categories' END], lambda x: x IS NOT NULL)) AS error FROM q)
  SELECT error, count(*) AS n FROM e GROUP BY 1""")
def error_counts(spark, sf):
    return E.error_counts(E.error_types(_gold(spark, sf), _pred(spark, sf)))


_CASES_SQL = PRED_SQL + """, b AS (SELECT id, CASE WHEN relevant THEN 'yes' ELSE 'no' END AS expect, is_investment_policy AS got, CASE WHEN method = 'rule' THEN 'none' ELSE todo_type END AS todo FROM q),
c AS (SELECT *, CASE WHEN expect = 'no' AND got = 'yes' AND todo = 'none' THEN 'silent_false_accept' WHEN expect = 'yes' AND got = 'no' THEN 'missed' WHEN todo = 'none' AND got = expect THEN 'auto_ok' ELSE 'to_review' END AS bucket FROM b)"""


def _cases(spark, sf):
    p = _pred(spark, sf).withColumn("todo_type", F.when(F.col("method") == "rule", "none").otherwise(F.col("todo_type")))
    return E.acceptance(_gold(spark, sf).select("id", F.when(F.col("relevant"), "yes").otherwise("no").alias("expect")), p)


@query("eva_acceptance", f"WITH {_CASES_SQL} SELECT id, bucket FROM c")
def acceptance(spark, sf):
    return _cases(spark, sf).select("id", "bucket")


@query("eva_acceptance_rates", f"""WITH {_CASES_SQL} SELECT count(*) AS cases, count(*) FILTER (expect = 'yes') AS positives, count(*) FILTER (expect = 'no') AS negatives, count(*) FILTER (bucket = 'silent_false_accept') AS silent_false_accept,
  count(*) FILTER (bucket = 'missed') AS missed, count(*) FILTER (bucket = 'auto_ok') AS auto_ok, count(*) FILTER (bucket = 'to_review') AS to_review,
  {_r("count(*) FILTER (bucket = 'silent_false_accept')", "count(*) FILTER (expect = 'no')")} AS silent_rate, {_r("count(*) FILTER (bucket = 'missed')", "count(*) FILTER (expect = 'yes')")} AS missed_rate,
  {_r("count(*) FILTER (bucket = 'auto_ok')", 'count(*)')} AS auto_rate, {_r("count(*) FILTER (bucket <> 'auto_ok')", 'count(*)')} AS human_rate FROM c""")
def acceptance_rates(spark, sf):
    return E.acceptance_rates(_cases(spark, sf))


_POOL_SQL = B.DOCS_SQL + """, cand AS (
  SELECT page_url, title, source_name, CASE lang WHEN 'en' THEN 'processed' WHEN 'fr' THEN 'excluded' WHEN 'de' THEN 'failed' ELSE 'discovered' END AS status, 0 AS prio, -id AS ord FROM docs
  UNION ALL SELECT 'https://src' || item_id || '.example.org/en/' || length(text), '', 'bench', 'list_filtered', 1, item_id FROM benchmark
  UNION ALL SELECT url, '', 'reference', 'not_discovered', 2, page_id FROM pages),
pool AS (SELECT page_url, title, source_name, status FROM cand WHERE page_url LIKE 'https://%' QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY prio, ord) = 1)"""


def _pool(spark, sf):
    lang = F.col("lang")
    ledger = B.docs(spark, sf).withColumn("status", F.when(lang == "en", "processed").when(lang == "fr", "excluded").when(lang == "de", "failed").otherwise("discovered"))
    seen = B.table(spark, sf, "benchmark").select(F.concat(F.lit("https://src"), "item_id", F.lit(".example.org/en/"), F.length("text")).alias("page_url"), F.lit("").alias("title"),
                                                  F.lit("bench").alias("source_name"), F.lit(0).alias("admitted"), F.col("item_id").alias("seq"))
    listed = B.table(spark, sf, "pages").select(F.col("url").alias("page_url"), F.lit("").alias("title"), F.lit("reference").alias("source_name"), F.col("page_id").alias("seq"))
    return S.candidate_pools(ledger, seen, listed)


@query("eva_candidate_pools", f"WITH {_POOL_SQL} SELECT * FROM pool")
def candidate_pools(spark, sf):
    return _pool(spark, sf)


@query("eva_stratified_sample", f"""WITH {_POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY sha256('investment-audit-v1' || page_url), page_url) AS turn FROM pool)
  SELECT * FROM r ORDER BY turn, status LIMIT 100""")
def stratified_sample(spark, sf):
    return S.stratified_sample(_pool(spark, sf), 100)


_HIST_SQL = B.DOCS_SQL + r""", f AS (SELECT *, regexp_replace(title, '[\s《》〔〕\[\]【】（）()“”"：:]', '', 'g') AS name FROM docs), known AS (SELECT * FROM f WHERE id IN (SELECT doc_id FROM labels)),
hist AS (SELECT *, page_url IN (SELECT page_url FROM known) OR (name <> '' AND name IN (SELECT name FROM known)) AS historical, CASE WHEN name <> '' THEN name ELSE page_url END AS family FROM f)"""


def _historical(spark, sf):
    docs = B.docs(spark, sf).select("id", "page_url", "wenhao", "title")
    return S.historical_flag(docs, docs.join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi"))


@query("eva_historical_flag", f"WITH {_HIST_SQL} SELECT id, historical FROM hist")
def historical_flag(spark, sf):
    return _historical(spark, sf).select("id", "historical")


@query("eva_split_holdout", f"""WITH {_HIST_SQL} SELECT id, family, CASE WHEN historical OR CAST('0x' || substr(sha256('investment-audit-v1' || family), 1, 8) AS BIGINT) % 5 <> 0 THEN 'development' ELSE 'holdout' END AS split FROM hist""")
def split_holdout(spark, sf):
    return S.split_holdout(_historical(spark, sf)).select("id", "family", "split")


@query("eva_review_funnel", f"""WITH {PRED_SQL} SELECT CASE WHEN method = 'rule' THEN 'list_filter_false_exclusion' WHEN len(content) < 300 THEN 'material_failure' WHEN is_investment_policy = 'no' THEN 'classification_false_exclusion'
  WHEN is_investment_policy = 'pending' THEN 'classification_pending' ELSE 'relevant_retained' END AS outcome, count(*) AS n FROM q WHERE relevant GROUP BY 1""")
def review_funnel(spark, sf):
    p = _pred(spark, sf).join(_gold(spark, sf).select("id", "relevant"), "id").join(B.docs(spark, sf).select("id", "content"), "id")
    return S.review_funnel(p.withColumn("pipeline_stage", F.when(F.col("method") == "rule", "list_filtered").otherwise("processed"))
                           .withColumn("material_complete", F.length("content") >= 300).withColumn("label_status", F.lit("human_reviewed")))


@query("eva_frozen_sample_check", """SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE lang WHEN 'de' THEN 'added' ELSE 'altered' END AS problem FROM documents WHERE lang IN ('de', 'es') UNION ALL SELECT 'b' || item_id, 'removed' FROM benchmark""")
def frozen_sample_check(spark, sf):
    docs = B.docs(spark, sf).select(F.col("id").cast("string").alias("sample_id"), "title", "page_url", "lang")
    then = docs.where("lang <> 'de'").withColumn("title", F.when(F.col("lang") == "es", F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    gone = B.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("sample_id"), F.col("text").alias("title"), F.lit("").alias("page_url"), F.lit("en").alias("lang"))
    return S.frozen_sample_check(docs.withColumn("note", F.lit("seen")), then.unionByName(gone))


@query("eva_source_acceptance", """WITH s AS (SELECT source, count(*) FILTER (lang <> 'es') AS samples, min(CASE WHEN lang <> 'es' AND (n_chars < 60 OR quality = 0 AND toxic = 1) THEN doc_id || '.html' END) AS url, count(*) FILTER (lang <> 'es' AND (n_chars < 60 OR quality = 0 AND toxic = 1)) AS bad FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
  SELECT source, samples, bad, CASE WHEN source = 'src1' THEN '疑似中央文件转载子栏目' WHEN source = 'src2' THEN '列表页完全重复' WHEN bad > 0 THEN '样本异常: ' || url ELSE '' END AS reason,
  source NOT IN ('src1', 'src2') AND bad = 0 AS accepted FROM s""")
def source_acceptance(spark, sf):
    d = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id", "left")
    sources = d.select("source").distinct().withColumn("national_repost", F.col("source") == "src1").withColumn("error", F.when(F.col("source") == "src2", "列表页完全重复").otherwise(""))
    flag = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False)).cast("int")
    samples = d.where("lang <> 'es'").select("source", F.concat("doc_id", F.lit(".html")).alias("url"), F.when(F.col("n_chars") < 60, 0).otherwise(F.col("n_chars")).alias("body_chars"), F.lit(0).alias("failed"),
                                             flag.alias("documents_incomplete"), F.lit(0).alias("attachments_failed"), F.lit(0).alias("attachments_unparsed"))
    return E.source_acceptance(sources, samples).select("source", "samples", "bad", "reason", "accepted")


@query("eva_ingest_verdict", f"""WITH {B.EVENTS_SQL}, r AS (SELECT conv_id, count(*) AS n, arg_max(role = 'user' OR length(text) > 120, turn) AS ended, arg_max(CASE WHEN length(text) > 900 THEN 1 ELSE 0 END, turn) AS inc, bool_or(turn = 1 AND role = 'assistant') AS stable FROM conversations GROUP BY 1),
  l AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error' AND value < 2) AS u, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END, id) AS run FROM log GROUP BY 1),
  a AS (SELECT l_suppkey, count(*) FILTER (l_tax = 0.08 AND l_quantity < 2) AS bad FROM lineitem GROUP BY 1),
  v AS (SELECT conv_id AS source_id, coalesce(l.n, 0) AS candidates_total, coalesce(u, 0) AS unresolved_candidates, ended AND conv_id <> 3 AS discovery_reached_end, coalesce(l.n, 0) > 0 AND coalesce(u, 0) = 0 AS candidate_processing_complete,
    coalesce(bad, 0) = 0 AND inc = 0 AS material_complete, coalesce(run = 'ok', false) AS last_run_ok, r.n >= 2 AS two_rounds_completed, stable AS stable_input_idempotence_verified
    FROM r LEFT JOIN l ON user_id = conv_id LEFT JOIN a ON l_suppkey = conv_id)
  SELECT *, discovery_reached_end AND candidate_processing_complete AND material_complete AND last_run_ok AND two_rounds_completed AND stable_input_idempotence_verified AS overall_ok FROM v""")
def ingest_verdict(spark, sf):
    c = B.table(spark, sf, "conversations")
    rounds = c.select(F.col("conv_id").alias("source_id"), (F.col("turn") + 1).alias("round"), ((F.col("role") == "user") | (F.length("text") > 120)).alias("end_reached"),
                      F.when(F.length("text") > 900, 1).otherwise(0).alias("documents_incomplete"), F.lit(0).alias("ingested"), F.lit(0).alias("updated"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("duplicates"))
    log = B.log(spark, sf)
    ledger = log.select(F.col("user_id").alias("source_id"), F.when((F.col("event_type") == "error") & (F.col("value") < 2), "failed").otherwise("processed").alias("status"))
    runs = log.select(F.col("user_id").alias("source_id"), "id", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    atts = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.when((F.col("l_tax") == 0.08) & (F.col("l_quantity") < 2), "failed").otherwise("ok").alias("parse_status"))
    sources = c.select(F.col("conv_id").alias("source_id")).distinct().withColumn("last_error", F.when(F.col("source_id") == 3, "x").otherwise(""))
    return E.ingest_verdict(rounds, ledger, atts, runs, sources)


_FIELDS_SQL = """f AS (SELECT CAST(o_orderkey AS VARCHAR) AS filename, 'priority' AS field, CASE WHEN o_totalprice > 490000 THEN NULL ELSE o_orderpriority END AS value,
  CASE WHEN o_totalprice < 5000 THEN NULL WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'x' ELSE o_orderpriority END AS actual, o_totalprice >= 5000 AND o_orderstatus <> 'F' AS paged, o_totalprice >= 5000 AND o_orderstatus = 'P' AS review FROM orders),
g AS (SELECT filename, field, value, actual, coalesce(replace(value, ' ', '') = replace(actual, ' ', ''), value IS NULL AND actual IS NULL) AS correct, CASE WHEN value IS NOT NULL THEN paged END AS located, review FROM f)"""


def _fields(spark, sf):
    o = B.table(spark, sf, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    name = F.col("o_orderkey").cast("string").alias("filename")
    gold = o.select(name, F.lit("priority").alias("field"), F.when(price <= 490000, F.col("o_orderpriority")).alias("value"), F.array(F.lit(1)).alias("pages"))
    found = o.where(price >= 5000).select(name, F.lit("priority").alias("field"), F.when((status == "P") & (price > 300000), "x").otherwise(F.col("o_orderpriority")).alias("value"),
                                          F.when(status == "F", F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1))).alias("pages"), F.when(status == "P", "needs_review").otherwise("extracted").alias("status"))
    return E.field_accuracy(gold, found)


@query("eva_field_accuracy", f"WITH {_FIELDS_SQL} SELECT * FROM g")
def field_accuracy(spark, sf):
    return _fields(spark, sf)


@query("eva_field_summary", f"""WITH {_FIELDS_SQL} SELECT count(*) AS total, count(*) FILTER (correct) AS correct, count(located) AS present, count(*) FILTER (located) AS located, count(*) FILTER (review) AS manual_review_fields,
  {_r('count(*) FILTER (correct)', 'count(*)')} AS accuracy, {_r('count(*) FILTER (located)', 'count(located)')} AS recall FROM g""")
def field_summary(spark, sf):
    return E.field_summary(_fields(spark, sf))


_METRIC_SQL = """gm AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS filename, l_returnflag AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '米' AS value FROM lineitem WHERE l_linestatus = 'F'),
xm AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS filename, l_returnflag AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '米' AS value FROM lineitem WHERE l_discount > 0.03)"""


def _metrics(spark, sf):
    li = B.table(spark, sf, "lineitem")
    cols = lambda gap: (F.col("l_orderkey").cast("string").alias("filename"), F.col("l_returnflag").alias("name"), F.concat(F.col("l_quantity").cast("long"), F.lit(gap), F.lit("米")).alias("value"))
    return li.where("l_linestatus = 'F'").select(*cols("")), li.where("l_discount > 0.03").select(*cols(" "))


@query("eva_metric_differences", f"WITH {_METRIC_SQL} SELECT *, 'extra' AS kind FROM (SELECT * FROM xm EXCEPT SELECT * FROM gm) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM gm EXCEPT SELECT * FROM xm)")
def metric_differences(spark, sf):
    return E.metric_differences(*_metrics(spark, sf))


@query("eva_metric_score", f"""WITH {_METRIC_SQL}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM gm INTERSECT SELECT * FROM xm)) AS tp, (SELECT count(*) FROM xm) AS p, (SELECT count(*) FROM gm) AS e)
  SELECT tp AS true_positive, p AS predicted, e AS expected, {_r('tp', 'p')} AS precision, {_r('tp', 'e')} AS recall FROM n""")
def metric_score(spark, sf):
    return E.metric_score(*_metrics(spark, sf))


_RANGE_SQL = """rows AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 2) AS range, sha256(concat({fields})) AS d FROM {source}),
sums AS (SELECT range, count(*) AS n, (sum(('0x' || substr(d, 1, 15))::HUGEINT) % 1152921504606846976)::BIGINT AS low, (sum(('0x' || substr(d, 17, 15))::HUGEINT) % 1152921504606846976)::BIGINT AS high FROM rows GROUP BY 1)""".format(
    fields=", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "lang", "n_chars", "source", "text")), source="documents")


@query("eva_corpus_tree", f"""WITH {_RANGE_SQL}, two AS (SELECT range, n, sha256(n || ':' || low || ':' || high) AS digest FROM sums),
  one AS (SELECT substr(range, 1, 1) AS up, sum(n)::BIGINT AS n, sha256(string_agg(range || digest, '' ORDER BY range)) AS digest FROM two GROUP BY 1),
  top AS (SELECT '' AS range, sum(n)::BIGINT AS n, sha256(string_agg(up || digest, '' ORDER BY up)) AS digest FROM one)
  SELECT range, n, digest FROM two UNION ALL SELECT up, n, digest FROM one UNION ALL SELECT range, n, digest FROM top""")
def corpus_tree(spark, sf):
    """Sums of halves of the corpus add up to those of the whole."""
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source", "text")
    return S.range_tree(S.merged_sums(S.range_sums(d.where("doc_id % 2 = 0"), "doc_id"), S.range_sums(d.where("doc_id % 2 = 1"), "doc_id")))


@query("eva_changed_ranges", """WITH r AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 2) AS range, doc_id FROM documents)
  SELECT range, count(*) AS n_before, (count(*) + count(*) FILTER (doc_id % 97 = 0))::BIGINT AS n_after FROM r GROUP BY 1 HAVING count(*) FILTER (doc_id % 97 = 0 OR doc_id % 50 = 0) > 0""")
def changed_ranges(spark, sf):
    """Rows that change or occur twice are told by their ranges."""
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source", "text")
    later = d.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return S.changed_ranges(S.range_sums(d, "doc_id"), S.range_sums(later.unionByName(later.where("doc_id % 97 = 0")), "doc_id"))
