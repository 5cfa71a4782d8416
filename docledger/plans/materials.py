"""Queries over material quality."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import materials as M
from docledger.plans import binding as B
from docledger.plans.registry import query

PA = "WITH " + B.POLICIES_SQL + ", " + B.ATTACHMENTS_SQL
FILES_SQL = """files AS (SELECT '/store/' || p_partkey AS local_path, CASE WHEN p_size > 5 THEN sha256(CAST(p_partkey AS VARCHAR)) ELSE 'changed' END AS sha256 FROM part)"""
QUALITY_SQL = FILES_SQL + """, quality AS (SELECT a.*, a.sha256 <> '' AND coalesce(f.sha256 = a.sha256, false) AS download_ok,
  a.sha256 <> '' AND coalesce(f.sha256 = a.sha256, false) AND parsed_text <> '' AND parse_status = 'ok' AS parse_complete FROM attachments a LEFT JOIN files f USING (local_path))"""
LINKS_SQL = "links AS (SELECT id AS policy_id, CAST(substr(policy_key, 2) AS BIGINT) AS fetch_id FROM policies)"
ATT_SQL = f"{PA}, {QUALITY_SQL}, {LINKS_SQL}, {B.ATTEMPTS_SQL}, newest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY fetch_id, url ORDER BY id DESC) = 1)"


def _files(spark, sf):
    part = F.col("p_partkey").cast("string")
    return B.table(spark, sf, "part").select(F.concat(F.lit("/store/"), part).alias("local_path"),
                                             F.when(F.col("p_size") > 5, F.sha2(part, 256)).otherwise("changed").alias("sha256"))


def _quality(spark, sf):
    return M.attachment_quality(B.attachments(spark, sf), _files(spark, sf))


def _links(spark, sf):
    return B.policies(spark, sf).select(F.col("id").alias("policy_id"), F.expr("CAST(substr(policy_key, 2) AS BIGINT)").alias("fetch_id"))


@query("mat_attachment_quality", f"{PA}, {QUALITY_SQL} SELECT id, policy_id, download_ok, parse_complete FROM quality")
def attachment_quality(spark, sf):
    return _quality(spark, sf).select("id", "policy_id", "download_ok", "parse_complete")


def _verified(spark, sf):
    part = B.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/store/"), key).alias("local_path")
    listing = part.select(path, F.col("p_size").cast("long").alias("size"), F.length("p_name").cast("long").alias("mtime_ns"))
    expected = part.select(path, F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.sha2(key, 256)).alias("sha256"))
    stored = part.where("p_retailprice < 1000").select(path, F.col("p_size").cast("long").alias("size"), F.when(F.col("p_type") == "PROMO", 0).otherwise(
        F.length("p_name")).cast("long").alias("mtime_ns"), F.sha2(key, 256).alias("sha256"), F.lit(1).alias("ok"))
    hashes = lambda rows: rows.select("local_path", F.when(F.col("size") > 5, F.sha2(F.substring("local_path", 8, 40), 256)).otherwise("changed").alias("actual"))
    return M.verify_files(expected, listing, stored, hashes)


_VERIFY_SQL = """v AS (SELECT '/store/' || p_partkey AS local_path, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE sha256(CAST(p_partkey AS VARCHAR)) END AS sha256,
  p_retailprice < 1000 AS stored, p_retailprice < 1000 AND p_type <> 'PROMO' AS hit, p_size, length(p_name) AS m, p_type FROM part)"""


@query("mat_verify_files", f"""WITH {_VERIFY_SQL} SELECT local_path, sha256, CASE WHEN sha256 = '' THEN 0 WHEN hit THEN 1 WHEN p_size > 5 THEN 1 ELSE 0 END AS ok FROM v""")
def verify_files(spark, sf):
    return _verified(spark, sf)[0]


@query("mat_verify_store", f"""WITH {_VERIFY_SQL}, s AS (SELECT local_path, p_size, CASE WHEN p_type = 'PROMO' AND sha256 = '' THEN 0 ELSE m END AS mtime_ns,
   CASE WHEN sha256 = '' THEN sha256(substr(local_path, 8)) ELSE sha256 END AS sha256, CASE WHEN sha256 <> '' AND NOT hit AND p_size <= 5 THEN 0 ELSE 1 END AS ok FROM v WHERE stored OR sha256 <> '')
  SELECT local_path, CAST(p_size AS BIGINT) AS size, CAST(mtime_ns AS BIGINT) AS mtime_ns, sha256, ok FROM s""")
def verify_store(spark, sf):
    return _verified(spark, sf)[1]


@query("mat_latest_attempt", f"WITH {B.ATTEMPTS_SQL} SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY fetch_id, url ORDER BY id DESC) = 1")
def latest_attempt(spark, sf):
    return M.latest_attempt(B.attempts(spark, sf))


_ROWS_SQL = f"""{ATT_SQL}, tried AS (SELECT l.policy_id, n.url, max(n.id) AS latest_attempt, arg_max(download_status <> 'ok' OR parse_status <> 'ok', n.id) AS issue
    FROM links l JOIN newest n USING (fetch_id) GROUP BY 1, 2),
  r AS (SELECT q.*, s.name AS source_name, t.latest_attempt, NOT parse_complete OR coalesce(issue, false) AS needs_attention
    FROM quality q JOIN latest l ON l.id = q.policy_id LEFT JOIN sources s ON s.id = l.source_id LEFT JOIN tried t ON t.policy_id = q.policy_id AND t.url = q.url)"""


def _rows(spark, sf, **kw):
    return M.attention_rows(_quality(spark, sf), B.policies(spark, sf), _links(spark, sf), B.attempts(spark, sf), B.sources(spark, sf), **kw)


@query("mat_attention_rows", f"{_ROWS_SQL} SELECT id, policy_id, source_name, latest_attempt, needs_attention FROM r")
def attention_rows(spark, sf):
    return _rows(spark, sf).select("id", "policy_id", "source_name", "latest_attempt", "needs_attention")


@query("mat_attachment_report", f"""{_ROWS_SQL} SELECT fmt AS format, CAST(grouping(fmt) AS INTEGER) AS level, count(*) AS total, count(*) FILTER (download_ok) AS download_ok,
  count(*) FILTER (parse_complete) AS parse_complete, count(*) FILTER (needs_attention) AS needs_attention FROM r GROUP BY ROLLUP (fmt)""")
def attachment_report(spark, sf):
    return M.attachment_report(_rows(spark, sf))


@query("mat_affected_policies", f"{_ROWS_SQL} SELECT count(DISTINCT policy_id) FILTER (needs_attention) AS affected_policies FROM r")
def affected_policies(spark, sf):
    return M.affected_policies(_rows(spark, sf))


@query("mat_attachment_gaps", f"""{PA} SELECT policy_id, count(*) FILTER (parsed_text = '' AND sha256 <> '' AND fmt <> 'zip') AS gaps,
  count(*) FILTER (parse_status <> 'ok' AND sha256 = '') AS failures, count(*) FILTER (parsed_text = '' AND fmt <> 'zip') AS without_text FROM attachments GROUP BY policy_id""")
def attachment_gaps(spark, sf):
    return M.attachment_gaps(B.attachments(spark, sf))


@query("mat_document_incomplete", f"{PA} SELECT id, parse_error <> '' OR EXISTS (SELECT 1 FROM attachments a WHERE a.policy_id = p.id AND parsed_text = '' AND fmt <> 'zip') AS incomplete FROM policies p")
def document_incomplete(spark, sf):
    return M.document_incomplete(B.policies(spark, sf), B.attachments(spark, sf)).select("id", "incomplete")


_GAPS_SQL = f"""{ATT_SQL}, g AS (SELECT p.*, parse_error <> '' OR EXISTS (SELECT 1 FROM quality q WHERE q.policy_id = p.id AND NOT parse_complete)
  OR EXISTS (SELECT 1 FROM links l JOIN newest n USING (fetch_id) WHERE l.policy_id = p.id AND (download_status <> 'ok' OR parse_status <> 'ok')) AS material_gap FROM latest p)"""


def _gaps(spark, sf):
    return M.material_gaps(B.policies(spark, sf), _quality(spark, sf), _links(spark, sf), B.attempts(spark, sf))


@query("mat_material_gaps", f"{_GAPS_SQL} SELECT id, material_gap FROM g")
def material_gaps(spark, sf):
    from docledger.operators.identity import latest_version
    return latest_version(_gaps(spark, sf)).select("id", "material_gap")


@query("mat_flag_changes", f"""{_GAPS_SQL} SELECT CASE WHEN (parse_requires_review = 1) = material_gap THEN 'unchanged' WHEN material_gap THEN 'set' ELSE 'clear' END AS action, count(*) AS n
  FROM g WHERE review_status <> 'rejected' GROUP BY 1""")
def flag_changes(spark, sf):
    return M.flag_changes(_gaps(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("mat_parse_errors_by_site", f"""WITH {B.POLICIES_SQL} SELECT s.site, s.name AS source_name, s.region, count(*) AS n, max(l.page_url) AS sample_url, max(parse_error) AS reason
  FROM latest l JOIN sources s ON s.id = l.source_id WHERE parse_error <> '' GROUP BY 1, 2, 3""")
def parse_errors_by_site(spark, sf):
    return M.parse_errors_by_site(_ledger(spark, sf), B.sources(spark, sf), B.policies(spark, sf))


def _ledger(spark, sf):
    return B.policies(spark, sf).select("id", "source_id", "page_url", F.to_json(F.struct("parse_error")).alias("document_json"))


_OWNER = """CASE WHEN contains({t}, '404') OR contains({t}, '410') THEN '无需处理' WHEN contains({t}, '未定位正文容器') THEN '需改代码适配来源'
  WHEN contains({t}, '动态防护') OR contains({t}, 'playwright') THEN '需运维配置' WHEN contains({t}, '附件下载失败') OR contains({t}, '来源不匹配或缺少网页原件') THEN '机器可自修' ELSE '待判断' END"""
_KIND = """CASE {o} WHEN '无需处理' THEN 'gone' WHEN '需改代码适配来源' THEN 'code' WHEN '需运维配置' THEN 'ops' WHEN '机器可自修' THEN 'self' ELSE 'unknown' END"""


@query("mat_attribute_issue", f"WITH {B.ATTEMPTS_SQL}, o AS (SELECT id, {_OWNER.format(t='error')} AS owner FROM attempts) SELECT id, owner, {_KIND.format(o='owner')} AS kind FROM o")
def attribute_issue(spark, sf):
    return B.attempts(spark, sf).select("id", M.attribute_issue(F.col("error")).alias("i")).select("id", "i.owner", "i.kind")


@query("mat_issue_groups", f"""WITH {B.POLICIES_SQL}, e AS (SELECT s.site, count(*) AS n, max(parse_error) AS reason FROM latest l JOIN sources s ON s.id = l.source_id WHERE parse_error <> '' GROUP BY 1),
  o AS (SELECT *, {_OWNER.format(t='reason')} AS owner FROM e) SELECT owner, {_KIND.format(o='owner')} AS kind, CAST(sum(n) AS BIGINT) AS n, string_agg(site || '（' || n || ' 篇）', '、' ORDER BY n DESC, site) AS sites FROM o GROUP BY 1""")
def issue_groups(spark, sf):
    errors = M.parse_errors_by_site(_ledger(spark, sf), B.sources(spark, sf), B.policies(spark, sf))
    return M.issue_groups(errors).select("owner", "kind", "n", "sites")


_FAIL_SQL = B.SOURCES_SQL + ", " + B.ATTEMPTS_SQL + ", f AS (SELECT a.*, s.site, s.name AS source_name FROM attempts a JOIN sources s ON s.id = a.fetch_id % 25)"


def _failures(spark, sf):
    return B.attempts(spark, sf).withColumn("source_id", F.col("fetch_id") % 25)


@query("mat_technical_failures", f"WITH {_FAIL_SQL} SELECT site, source_name, error, count(*) AS n FROM f WHERE error <> '' AND NOT contains(error, '不收录') GROUP BY 1, 2, 3")
def technical_failures(spark, sf):
    return M.technical_failures(_failures(spark, sf), B.sources(spark, sf))


@query("mat_failure_groups", f"""WITH {_FAIL_SQL}, o AS (SELECT *, {_OWNER.format(t='error')} AS owner FROM f WHERE error <> '' AND NOT contains(error, '不收录'))
  SELECT owner, {_KIND.format(o='owner')} AS kind, count(*) AS n FROM o GROUP BY 1""")
def failure_groups(spark, sf):
    return M.issue_groups(M.technical_failures(_failures(spark, sf), B.sources(spark, sf)), "error").select("owner", "kind", "n")


@query("mat_business_skips", f"WITH {B.ATTEMPTS_SQL} SELECT count(*) AS business_skipped FROM attempts WHERE contains(error, '不收录')")
def business_skips(spark, sf):
    return M.business_skips(B.attempts(spark, sf))


_REPAIR_SQL = f"""{PA}, {QUALITY_SQL}, c AS (SELECT id, title, todo_type = 'material' AS stale_verdict, updated_at FROM latest l WHERE parse_error <> '' OR EXISTS (
  SELECT 1 FROM quality q WHERE q.policy_id = l.id AND error <> 'HTTP 404' AND (NOT parse_complete OR parser_version <> '7')))"""


@query("mat_repair_candidates", f"{_REPAIR_SQL} SELECT id, title, stale_verdict, updated_at FROM c")
def repair_candidates(spark, sf):
    return M.repair_candidates(B.policies(spark, sf), _quality(spark, sf), "7").select("id", "title", "stale_verdict", "updated_at")


@query("mat_repair_queue", f"{_REPAIR_SQL} SELECT id, title, stale_verdict FROM c ORDER BY updated_at, id LIMIT 20")
def repair_queue(spark, sf):
    return M.repair_candidates(B.policies(spark, sf), _quality(spark, sf), "7", limit=20).select("id", "title", "stale_verdict")


@query("mat_attempt_rows", """SELECT doc_id AS fetch_id, CAST(i - 1 AS INTEGER) AS pos, 'u' || length(line) AS url, CASE WHEN length(line) % 3 = 0 THEN 'failed' ELSE 'ok' END AS download_status FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def attempt_rows(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("fetch_id"), F.transform(F.split("text", "\n"), lambda l: F.struct(
        F.concat(F.lit("u"), F.length(l)).alias("url"), F.lit("pdf").alias("fmt"), F.when(F.length(l) % 3 == 0, "").otherwise("h").alias("sha256"),
        F.lit("/p").alias("local_path"), F.lit("ok").alias("parse_status"), F.lit("").alias("error"))).alias("attachments"))
    return M.attempt_rows(docs).select("fetch_id", "pos", "url", "download_status")


@query("mat_error_class", f"WITH {B.ATTEMPTS_SQL} SELECT id, CASE error WHEN '' THEN '' WHEN 'HTTP 404' THEN 'permanent' WHEN 'read timeout' THEN 'retryable' ELSE 'other' END AS class FROM attempts")
def error_class(spark, sf):
    return B.attempts(spark, sf).select("id", M.error_class(F.col("error")).alias("class"))


@query("mat_attachment_status", """WITH d AS (SELECT doc_id AS id, lang, source, length(text) > 1500 AS long, quality FROM documents LEFT JOIN labels USING (doc_id)),
  s AS (SELECT *, lang = 'de' AND source <> 'src3' AS html, lang = 'en' AND source = 'src5' AS notpdf FROM d)
  SELECT id, CASE WHEN html OR notpdf THEN 'failed' WHEN long THEN CASE WHEN quality = 1 THEN 'partial' ELSE 'ok' END WHEN lang = 'es' THEN 'unsupported' ELSE 'needs_ocr' END AS parse_status,
  CASE WHEN html THEN '附件返回HTML网页，未取得文件原件' WHEN notpdf THEN 'PDF附件返回非PDF内容' WHEN quality = 1 THEN 'warn' ELSE '' END AS error FROM s""")
def attachment_status(spark, sf):
    d = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    lang = F.col("lang")
    head = F.when((lang == "en") & (F.col("source") != "src5"), "%PDF-1.7").when(lang == "de", "  <!DOCTYPE html>").otherwise("plain")
    fmt = F.when(lang == "en", "pdf").when(lang == "es", "zip").when((lang == "de") & (F.col("source") == "src3"), "txt").otherwise("ofd")
    rows = d.select(F.col("doc_id").alias("id"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"), fmt.alias("fmt"), F.lit("application/x").alias("content_type"),
                    F.when(F.length("text") > 1500, "text").otherwise("").alias("parsed_text"), F.when(F.col("quality") == 1, "warn").otherwise("").alias("parse_error"))
    return M.attachment_status(rows).select("id", "parse_status", "error")
