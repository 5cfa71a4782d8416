"""Queries over identity, deduplication and versions."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import identity as I
from docledger.plans import binding as B
from docledger.plans.registry import query


def _turns(spark, sf):
    return B.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("policy_key"), F.col("turn").alias("version"), F.col("turn").alias("id"), "role", "text")


@query("ver_norm_title", f"WITH {B.KEYED_SQL} SELECT id, lower(regexp_replace(title, '[《》\"“”\\s]', '', 'g')) AS title_norm FROM docs")
def norm_title(spark, sf):
    return B.docs(spark, sf).select("id", X.norm_title(F.col("title")).alias("title_norm"))


@query("ver_policy_key", f"WITH {B.KEYED_SQL} SELECT id, policy_key, 'title' AS key_source FROM keyed")
def policy_key(spark, sf):
    return I.policy_key(B.docs(spark, sf)).select("id", "policy_key", "key_source")


@query("ver_policy_key_numbered", """
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'clerk' || o_custkey % 10 || ':' ELSE '' END ||
    CASE WHEN o_orderpriority = '5-LOW' THEN '公告' ELSE '发改投资' END || '〔' || year(o_orderdate) || '〕' || o_orderkey || '号' AS policy_key
  FROM orders""")
def policy_key_numbered(spark, sf):
    low = F.col("o_orderpriority") == "5-LOW"
    number = F.concat(F.when(low, "公告").otherwise("发改投资"), F.when(F.col("o_orderstatus") == "F", "［").when(
        F.col("o_orderstatus") == "O", "【 ").otherwise("（"), F.year("o_orderdate"), F.when(
        F.col("o_orderstatus") == "F", "］").when(F.col("o_orderstatus") == "O", " 】").otherwise(")"), "o_orderkey", F.lit("号"))
    docs = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), number.alias("wenhao"), F.lit("").alias("title"), F.lit("").alias("page_url"),
        F.concat(F.lit("clerk"), F.col("o_custkey") % 10).alias("issuing_authority"), F.lit("").alias("source_name"))
    return I.policy_key(docs).select("id", "policy_key")


@query("ver_content_fingerprint", f"WITH {B.KEYED_SQL} SELECT id, content_sha256 FROM keyed")
def content_fingerprint(spark, sf):
    return I.content_fingerprint(B.docs(spark, sf)).select("id", "content_sha256")


@query("ver_content_fingerprint_attachments", f"""WITH {B.ATTACHMENTS_SQL}, h AS (
  SELECT policy_id, list_sort(list(DISTINCT CASE WHEN sha256 <> '' THEN sha256 ELSE 'missing:' || url END)) AS hs
  FROM attachments GROUP BY policy_id)
  SELECT o_orderkey AS id, sha256('["' || o_orderpriority[1:2] || o_orderstatus || '", [' ||
     coalesce(array_to_string(list_transform(hs, lambda x: '"' || x || '"'), ', '), '') || ']]') AS content_sha256
  FROM orders LEFT JOIN h ON policy_id = o_orderkey""")
def content_fingerprint_attachments(spark, sf):
    docs = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.substring("o_orderpriority", 1, 2), F.lit(" "), "o_orderstatus").alias("content"))
    return I.content_fingerprint(docs, B.attachments(spark, sf)).select("id", "content_sha256")


@query("ver_latest_version", """SELECT CAST(conv_id AS VARCHAR) AS policy_key, turn AS version, role, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_version(spark, sf):
    return I.latest_version(_turns(spark, sf)).select("policy_key", "version", "role", "text")


@query("ver_latest_version_ledger", f"WITH {B.POLICIES_SQL} SELECT id, policy_key, version, title, region FROM latest")
def latest_version_ledger(spark, sf):
    return I.latest_version(B.policies(spark, sf)).select("id", "policy_key", "version", "title", "region")


# labelled documents are the library, the others the incoming batch (one row per URL: the newest)
_SPLIT_SQL = B.KEYED_SQL + """, library AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY policy_key ORDER BY id) AS BIGINT) AS version FROM keyed WHERE id IN (SELECT doc_id FROM labels)),
incoming AS (SELECT * FROM keyed WHERE id NOT IN (SELECT doc_id FROM labels)
  QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY id DESC) = 1),
origin AS (SELECT page_url, arg_max(policy_key, id) AS origin_key FROM library GROUP BY page_url)"""


def _split(spark, sf):
    keyed = I.content_fingerprint(I.policy_key(B.docs(spark, sf))).select("id", "page_url", "policy_key", "content_sha256", "content")
    seen = B.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    known = keyed.join(seen, "id", "left_semi").withColumn("arrival", F.col("id"))
    library = I.append_version(known, known.limit(0).withColumn("version", F.lit(0).cast("long")))
    newest = keyed.join(seen, "id", "left_anti").groupBy("page_url").agg(F.max("id").alias("id"))
    incoming = keyed.join(newest.select("id"), "id", "left_semi").withColumn("arrival", F.col("id"))
    return library, incoming


_DECISION_SQL = _SPLIT_SQL + """, r AS (
  SELECT i.id, i.page_url, i.content_sha256, coalesce(origin_key, policy_key) AS policy_key, origin_key
  FROM incoming i LEFT JOIN origin USING (page_url)),
r2 AS (SELECT r.*, (SELECT max(version) FROM library l WHERE l.policy_key = r.policy_key) AS lib_version,
         (SELECT arg_max(id, version) FROM library l WHERE l.policy_key = r.policy_key) AS lib_id,
         (SELECT max(version) FROM library l WHERE l.policy_key = r.policy_key AND l.content_sha256 = r.content_sha256) AS same_version,
         (SELECT arg_max(id, version) FROM library l WHERE l.policy_key = r.policy_key AND l.content_sha256 = r.content_sha256) AS same_id,
         min(r.id) OVER (PARTITION BY policy_key) AS founder FROM r),
r3 AS (SELECT *, same_version IS NULL AND (CASE WHEN lib_version IS NULL THEN id = founder ELSE origin_key IS NOT NULL END) AS adds FROM r2),
r4 AS (SELECT *, min(CASE WHEN adds THEN id END) OVER (PARTITION BY policy_key, content_sha256) AS first_at FROM r3),
r5 AS (SELECT *, CASE WHEN same_version IS NOT NULL OR (first_at IS NOT NULL AND first_at < id) THEN 'duplicate_skip'
         WHEN adds AND lib_version IS NULL THEN 'ingested' WHEN adds THEN 'updated' ELSE 'suspected_duplicate' END AS decision FROM r4),
steps AS (SELECT policy_key, content_sha256, coalesce(lib_version, 0) + row_number() OVER (PARTITION BY policy_key ORDER BY id) AS new_version
          FROM r5 WHERE decision IN ('ingested', 'updated')),
decided AS (SELECT r5.*, CASE WHEN decision = 'suspected_duplicate' THEN 1 ELSE coalesce(same_version, new_version) END AS version,
   CASE WHEN decision = 'duplicate_skip' THEN same_id WHEN decision <> 'ingested' THEN lib_id END AS matched_id
   FROM r5 LEFT JOIN steps USING (policy_key, content_sha256))"""


def _decided(spark, sf):
    library, incoming = _split(spark, sf)
    links = library.select(F.col("id").alias("policy_id"), "page_url")
    return I.dedup_decision(incoming.drop("content"), library.select("id", "policy_key", "version", "content_sha256"), links)


@query("ver_dedup_decision", f"WITH {_DECISION_SQL} SELECT id, policy_key, decision, CAST(version AS BIGINT) AS version, matched_id FROM decided")
def dedup_decision(spark, sf):
    return _decided(spark, sf).select("id", "policy_key", "decision", "version", "matched_id")


@query("ver_variant_key", f"""WITH {_DECISION_SQL}
  SELECT id, CASE WHEN decision = 'suspected_duplicate' THEN policy_key || ':variant:' || substr(sha256(page_url), 1, 16) ELSE policy_key END AS policy_key,
  CASE WHEN decision = 'suspected_duplicate' THEN policy_key ELSE '' END AS related_policy_key, decision = 'suspected_duplicate' AS force_review FROM decided""")
def variant_key(spark, sf):
    return I.variant_key(_decided(spark, sf)).select("id", "policy_key", "related_policy_key", "force_review")


@query("ver_append_version", """
  WITH e AS (SELECT event_id, event_type || ':' || user_id AS policy_key, user_id < 75 AS old FROM events)
  SELECT event_id, policy_key, CAST(coalesce((SELECT count(*) FROM events x WHERE x.event_type || ':' || x.user_id = e.policy_key AND x.value < 5), 0)
     + row_number() OVER (PARTITION BY policy_key ORDER BY event_id) AS BIGINT) AS version
  FROM e WHERE event_id IN (SELECT event_id FROM events WHERE value >= 5)""")
def append_version(spark, sf):
    # events of small value are versions already stored, the others arrive now
    e = B.table(spark, sf, "events").withColumn("policy_key", F.concat("event_type", F.lit(":"), "user_id"))
    stored = e.where("value < 5").groupBy("policy_key").agg(F.count(F.lit(1)).alias("version"))
    return I.append_version(e.where("value >= 5"), stored, "event_id").select("event_id", "policy_key", "version")


def _sightings(spark, sf):
    return B.log(spark, sf).select(F.col("user_id").alias("policy_id"), F.lit(1).alias("source_id"), F.col("k").cast("string").alias("page_url"),
                                   F.col("id").alias("fetch_id"), F.col("seen_at").alias("last_seen_at"), "event_type")


@query("ver_link_provenance", f"""WITH {B.EVENTS_SQL}
  SELECT user_id AS policy_id, 1 AS source_id, CAST(k AS VARCHAR) AS page_url, arg_max(id, row(seen_at, id)) AS fetch_id, max(seen_at) AS last_seen_at FROM log GROUP BY user_id, k""")
def link_provenance(spark, sf):
    rows = _sightings(spark, sf)
    first = F.col("event_type").isin("view", "click")
    return I.link_provenance(rows.where(first).drop("event_type"), rows.where(~first).drop("event_type"))


@query("ver_point_ledger", f"""WITH {B.EVENTS_SQL}, fed AS (SELECT k AS id, arg_max(user_id, row(seen_at, id)) AS fed FROM log GROUP BY k)
  SELECT o_orderkey AS id, coalesce(fed, o_custkey) AS policy_id FROM orders LEFT JOIN fed ON id = o_orderkey""")
def point_ledger(spark, sf):
    ledger = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("policy_id"))
    fed = B.log(spark, sf).select(F.col("k").cast("long").alias("fetch_id"), F.col("user_id").alias("policy_id"), F.struct("seen_at", "id").alias("last_seen_at"))
    return I.point_ledger(ledger, fed)


@query("ver_provenance", f"""WITH {B.POLICIES_SQL}, links AS (SELECT id AS policy_id, source_id, page_url, updated_at AS last_seen_at FROM policies)
  SELECT DISTINCT p.policy_key, l.page_url, s.site, s.region, l.last_seen_at FROM links l JOIN policies p ON p.id = l.policy_id LEFT JOIN sources s ON s.id = l.source_id""")
def provenance(spark, sf):
    p = B.policies(spark, sf)
    links = p.select(F.col("id").alias("policy_id"), "source_id", "page_url", F.col("updated_at").alias("last_seen_at"))
    return I.provenance(p, links, B.sources(spark, sf))


@query("ver_version_history", "SELECT CAST(conv_id AS VARCHAR) AS policy_key, turn AS version, role FROM conversations")
def version_history(spark, sf):
    return I.version_history(_turns(spark, sf)).select("policy_key", "version", "role")


@query("ver_policy_for_url", f"""WITH {B.POLICIES_SQL}, {B.ATTACHMENTS_SQL}
  SELECT url AS page_url, max(policy_id) AS policy_id, arg_max(policy_key, policy_id) AS policy_key
  FROM attachments JOIN policies p ON p.id = policy_id GROUP BY url""")
def policy_for_url(spark, sf):
    links = B.attachments(spark, sf).select("policy_id", F.col("url").alias("page_url"))
    return I.policy_for_url(links, B.policies(spark, sf))


# two extractions of the same order: closed line items as the stored one, open ones as the refetch
_PAIR_SQL = """o AS (SELECT l_orderkey AS pid, l_linenumber AS url, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
n AS (SELECT l_orderkey AS pid, l_linenumber AS url, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
oa AS (SELECT pid, url, CASE WHEN flag = 'A' THEN '' ELSE CAST(part // 1000 AS VARCHAR) END AS sha, 'text ' || flag AS txt, CASE WHEN flag = 'R' THEN 'ok' ELSE 'partial' END AS st FROM o),
na AS (SELECT pid, url, CASE WHEN flag = 'A' THEN '' ELSE CAST(part // 1000 AS VARCHAR) END AS sha, 'text ' || flag AS txt, CASE WHEN flag = 'R' THEN 'ok' ELSE 'partial' END AS st FROM n),
pairs AS (SELECT coalesce(oa.pid, na.pid) AS pid, coalesce(oa.url, na.url) AS url, oa.sha AS osha, oa.txt AS otxt, oa.st AS ost, na.sha AS nsha, na.txt AS ntxt, na.st AS nst,
   oa.pid IS NOT NULL AND na.pid IS NOT NULL AND NOT coalesce(oa.sha <> '' AND na.sha <> '' AND oa.sha <> na.sha, false) AS same_file,
   coalesce(na.sha = '' OR (oa.st = 'ok' AND na.st <> 'ok'), false) AS keep
   FROM oa FULL JOIN na ON oa.pid = na.pid AND oa.url = na.url),
g AS (SELECT pid, bool_and(same_file) AS agree, bool_or(NOT keep AND (nsha IS DISTINCT FROM osha OR ntxt IS DISTINCT FROM otxt OR nst IS DISTINCT FROM ost)) AS moved FROM pairs GROUP BY pid),
d AS (SELECT o_orderkey AS id, coalesce(agree, true) AS agree, coalesce(moved, false) AS moved,
   o_orderpriority = '1-URGENT' AS poorer, o_orderstatus <> 'P' AS same_raw FROM orders LEFT JOIN g ON pid = o_orderkey)"""


def _pair(spark, sf):
    li = B.table(spark, sf, "lineitem").groupBy("l_linestatus", F.col("l_orderkey").alias("policy_id"), F.col("l_linenumber").alias("url")) \
        .agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    atts = li.select("l_linestatus", "policy_id", "url", F.when(F.col("flag") == "A", "").otherwise(F.floor(F.col("part") / 1000).cast("string")).alias("sha256"),
                     F.concat(F.lit("text "), "flag").alias("parsed_text"), F.when(F.col("flag") == "R", "ok").otherwise("partial").alias("parse_status"))
    orders = B.table(spark, sf, "orders")
    old = orders.select(F.col("o_orderkey").alias("id"), F.lit("stored").alias("content"), F.lit("").alias("parse_error"), F.lit("c1").alias("content_sha256"), F.lit("r1").alias("raw_page_sha256"))
    new = orders.select(F.col("o_orderkey").alias("id"), F.lit("stored").alias("content"), F.when(F.col("o_orderpriority") == "1-URGENT", "解析失败").otherwise("").alias("parse_error"),
                        F.lit("c2").alias("content_sha256"), F.when(F.col("o_orderstatus") == "P", "r2").otherwise("r1").alias("raw_page_sha256"))
    return I.reconcile_same_original(old, new, atts.where("l_linestatus = 'F'").drop("l_linestatus"), atts.where("l_linestatus = 'O'").drop("l_linestatus"))


@query("ver_reconcile_same_original", f"""WITH {_PAIR_SQL}
  SELECT id, same_raw AND agree AS same_original, same_raw AND agree AND moved AS changed, 'stored' AS content, '' AS parse_error FROM d""")
def reconcile_same_original(spark, sf):
    return _pair(spark, sf)[0]


@query("ver_reconcile_attachments", f"""WITH {_PAIR_SQL}
  SELECT pid AS policy_id, url, CASE WHEN keep THEN osha ELSE nsha END AS sha256, CASE WHEN keep THEN otxt ELSE ntxt END AS parsed_text,
  CASE WHEN keep THEN ost ELSE nst END AS parse_status FROM pairs WHERE pid IN (SELECT id FROM d WHERE same_raw AND agree)""")
def reconcile_attachments(spark, sf):
    return _pair(spark, sf)[1]


_META_SQL = """m AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice < 150000 THEN '' ELSE 'W1' END AS wenhao,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE '2026-01-01' END AS page_date, '' AS doc_date, 'office' AS issuing_authority,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'W2' END AS nw, '2026-02-02' AS np FROM orders)"""


def _meta(spark, sf):
    o = B.table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") < 150000, "").otherwise("W1").alias("wenhao"),
                   F.when(F.col("o_orderstatus") == "P", "").otherwise("2026-01-01").alias("page_date"), F.lit("").alias("doc_date"), F.lit("office").alias("issuing_authority"))
    new = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise("W2").alias("wenhao"),
                   F.lit("2026-02-02").alias("page_date"), F.lit("").alias("doc_date"), F.lit("bureau").alias("issuing_authority"))
    return I.backfill_metadata(old, new)


@query("ver_backfill_metadata", f"""WITH {_META_SQL} SELECT id, CASE WHEN wenhao = '' AND nw <> '' THEN nw ELSE wenhao END AS wenhao,
  CASE WHEN page_date = '' THEN np ELSE page_date END AS page_date, doc_date, issuing_authority FROM m""")
def backfill_metadata(spark, sf):
    return _meta(spark, sf)[0]


@query("ver_backfill_events", f"""WITH {_META_SQL}, f AS (SELECT id, wenhao = '' AND nw <> '' AS w, page_date = '' AS p FROM m)
  SELECT id AS policy_id, 'metadata_backfill' AS action,
  '{{' || concat_ws(',', CASE WHEN w THEN '"wenhao":""' END, CASE WHEN p THEN '"page_date":""' END) || '}}' AS before_json,
  '{{' || concat_ws(',', CASE WHEN w THEN '"wenhao":"W2"' END, CASE WHEN p THEN '"page_date":"2026-02-02"' END) || '}}' AS after_json
  FROM f WHERE w OR p""")
def backfill_events(spark, sf):
    return _meta(spark, sf)[1]


_REFRESH_SQL = B.POLICIES_SQL + """, n AS (SELECT l_orderkey AS id, max(l_returnflag) = 'R' AS changed, 'n' || max(l_suppkey) AS content FROM lineitem GROUP BY l_orderkey),
j AS (SELECT p.*, n.changed, n.content AS new_content, n.id IS NOT NULL AS touched, review_status IN ('confirmed', 'adjusted', 'rejected') AS human FROM policies p LEFT JOIN n ON n.id = p.id)"""


def _refresh(spark, sf):
    old = B.policies(spark, sf).select("id", "review_status", "category", "wenhao", "parse_requires_review", F.lit("").alias("analysis_sha256"), F.lit("old").alias("content"))
    new = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.max("l_returnflag") == "R").alias("changed"), F.concat(F.lit("n"), F.max("l_suppkey")).alias("content")) \
        .withColumn("analysis_sha256", F.sha2("content", 256)).withColumn("category", F.lit("guide")).withColumn("wenhao", F.lit("W9"))
    return I.refresh_analysis(old, new)


@query("ver_refresh_analysis", f"""WITH {_REFRESH_SQL} SELECT id, review_status, CASE WHEN touched AND NOT human THEN 'guide' ELSE category END AS category,
  CASE WHEN touched AND wenhao = '' THEN 'W9' ELSE wenhao END AS wenhao,
  CASE WHEN human AND coalesce(changed, false) THEN 1 ELSE parse_requires_review END AS parse_requires_review,
  CASE WHEN touched THEN sha256(new_content) ELSE '' END AS analysis_sha256, CASE WHEN touched THEN new_content ELSE 'old' END AS content FROM j""")
def refresh_analysis(spark, sf):
    return _refresh(spark, sf)[0]


@query("ver_refresh_events", f"""WITH {_REFRESH_SQL} SELECT id AS policy_id, 'reparse' AS action,
  '{{"analysis_sha256":"' || sha256('old') || '","review_status":"' || review_status || '"}}' AS before_json,
  '{{"analysis_sha256":"' || sha256(new_content) || '","human_decision_preserved":' || CASE WHEN human THEN 'true' ELSE 'false' END || '}}' AS after_json
  FROM j WHERE changed""")
def refresh_events(spark, sf):
    return _refresh(spark, sf)[1]


@query("ver_dedupe_by_bytes", """WITH d AS (SELECT doc_id AS id, sha256(text) AS sha, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents)
  SELECT id, sha AS sha256, coalesce((SELECT min(k.id) FROM d k WHERE k.old AND k.sha = u.sha),
    (SELECT min(k.id) FROM d k WHERE NOT k.old AND k.sha = u.sha AND k.id < u.id)) AS duplicate_of FROM d u WHERE NOT old""")
def dedupe_by_bytes(spark, sf):
    hashed = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.sha256(F.col("text")).alias("sha256"))
    seen = B.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return I.dedupe_by_bytes(hashed.join(seen, "id", "left_anti"), hashed.join(seen, "id", "left_semi"))


@query("ver_initial_provenance", f"""WITH {B.POLICIES_SQL}, links AS (SELECT id AS policy_id, source_fetch_id AS fetch_id, source_id, page_url, updated_at AS last_seen_at FROM policies WHERE review_status = 'pending')
  SELECT * FROM links UNION ALL SELECT id, source_fetch_id, source_id, page_url, updated_at FROM policies WHERE review_status <> 'pending'""")
def initial_provenance(spark, sf):
    p = B.policies(spark, sf).withColumn("created_at", F.col("updated_at"))
    ledger = p.select(F.col("source_fetch_id").alias("id"), "source_id")
    links = p.where("review_status = 'pending'").select(F.col("id").alias("policy_id"), F.col("source_fetch_id").alias("fetch_id"), "source_id", "page_url", F.col("created_at").alias("last_seen_at"))
    return I.initial_provenance(p.drop("source_id"), ledger, links)
