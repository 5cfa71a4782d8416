"""Queries over the library, its exports and its sources."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions import text as X
from docledger.operators import identity as I, library as L
from docledger.plans import binding as B
from docledger.plans.registry import query
from docledger.sources import sinks as K, tables as S

P = "WITH " + B.POLICIES_SQL
PA = "WITH " + B.POLICIES_SQL + ", " + B.ATTACHMENTS_SQL
LIST_COLUMNS = ["id", "title", "wenhao", "region", "page_date", "review_status", "todo_type"]
LIST_SQL = ", ".join(LIST_COLUMNS)


@query("src_read_table", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, max(o_orderkey) AS top FROM orders")
def read_table(spark, sf):
    shape = T.StructType.fromDDL("o_orderkey LONG, o_custkey LONG")
    return spark.read.schema(shape).parquet(f"{sf}/orders.parquet").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("keys"), F.max("o_orderkey").alias("top"))


@query("src_merge_sources", """
  SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey < 2 THEN 'new' ELSE 'old' END AS region FROM nation
  UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_name), r_name, 'new' FROM region""")
def merge_sources(spark, sf):
    n = B.table(spark, sf, "nation")
    existing = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("region"))
    new = n.where("n_regionkey < 2").select(F.col("n_name").alias("name"), F.lit("new").alias("region")) \
        .unionByName(B.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("new").alias("region")))
    return S.merge_sources(existing, new.withColumn("id", F.lit(None).cast("long")))


@query("src_original_format", """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'fr' THEN 'doc' WHEN lang = 'de' THEN 'zip' ELSE 'html' END AS fmt,
  sha256(CASE WHEN lang = 'en' THEN '%PDF-' WHEN lang = 'de' THEN 'PK' ELSE '' END || text) AS sha256 FROM documents""")
def original_format(spark, sf):
    d = B.table(spark, sf, "documents")
    head = F.when(F.col("lang") == "en", "%PDF-").when(F.col("lang") == "de", "PK").otherwise("")
    files = d.select(F.col("doc_id").alias("id"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"),
                     F.concat(F.lit("https://h/"), "doc_id", F.when(F.col("lang") == "fr", ".DOC?x=1").otherwise("")).alias("path"))
    return S.original_format(files).select("id", "fmt", F.sha2("content", 256).alias("sha256"))


@query("src_conform", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, '' AS site, 1 AS enabled FROM customer")
def conform(spark, sf):
    shape = T.StructType.fromDDL("id LONG, name STRING, site STRING, enabled INT")
    return S.conform(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), shape, {"site": "", "enabled": 1})


@query("src_json_feed", """SELECT doc_id AS source_id, i - 1 AS pos, 'p/' || length(line) AS url, line AS title FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def json_feed(spark, sf):
    items = F.transform(F.split("text", "\n"), lambda l: F.struct(F.concat(F.lit("p/"), F.length(l)).alias("URL"), l.alias("TITLE")))
    feeds = B.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.lit("https://h/list").alias("list_url"), F.to_json(items).alias("body"))
    return S.feed_rows(feeds).select("source_id", F.col("pos").cast("long").alias("pos"), "url", "title")


@query("lib_filter_region_category", f"{P} SELECT {LIST_SQL} FROM latest WHERE review_status <> 'rejected' AND region = 'ASIA' AND (category LIKE '%guarantee%' OR category_names LIKE '%guarantee%')")
def filter_region_category(spark, sf):
    return L.filter_policies(B.policies(spark, sf), region="ASIA", category="guarantee").select(*LIST_COLUMNS)


@query("lib_filter_pending", f"{P} SELECT {LIST_SQL} FROM latest WHERE review_status = 'pending' OR parse_requires_review = 1")
def filter_pending(spark, sf):
    return L.filter_policies(B.policies(spark, sf), review_status="pending").select(*LIST_COLUMNS)


@query("lib_filter_todo", f"{P} SELECT {LIST_SQL} FROM latest WHERE todo_type = 'scope'")
def filter_todo(spark, sf):
    return L.filter_policies(B.policies(spark, sf), todo="scope").select(*LIST_COLUMNS)


@query("lib_keyword_search", f"""{PA} SELECT {LIST_SQL} FROM latest p WHERE review_status <> 'rejected' AND (title ILIKE '%by 7%' OR wenhao ILIKE '%by 7%'
  OR EXISTS (SELECT 1 FROM attachments a WHERE a.policy_id = p.id AND a.parsed_text ILIKE '%by 7%'))""")
def keyword_search(spark, sf):
    return L.filter_policies(B.policies(spark, sf), B.attachments(spark, sf), "BY 7").select(*LIST_COLUMNS)


@query("lib_keyword_search_text", f"WITH {B.DOCS_SQL} SELECT id, title FROM docs WHERE title ILIKE '%and th_t%' OR content ILIKE '%and th_t%'")
def keyword_search_text(spark, sf):
    d = B.docs(spark, sf)
    none = B.attachments(spark, sf).select(F.col("policy_id"), "parsed_text").where(F.lit(False))
    return L.keyword_search(d, none, "And th_t").select("id", "title")


@query("lib_attachment_excerpt", f"""{PA}, hit AS (SELECT policy_id, name, parsed_text, greatest(position('by 7' IN lower(parsed_text)) - 1, 0) AS p FROM attachments WHERE parsed_text ILIKE '%by 7%'
    QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY id) = 1)
  SELECT l.id, coalesce(name, '') AS matched_attachment, coalesce(substr(parsed_text, greatest(p - 30, 0) + 1, p + 74 - greatest(p - 30, 0)), '') AS attachment_excerpt
  FROM latest l LEFT JOIN hit ON policy_id = l.id""")
def attachment_excerpt(spark, sf):
    return L.attachment_excerpt(I.latest_version(B.policies(spark, sf)), B.attachments(spark, sf), "by 7").select("id", "matched_attachment", "attachment_excerpt")


@query("lib_page_by_date", f"{P} SELECT {LIST_SQL} FROM latest WHERE review_status <> 'rejected' ORDER BY page_date IS NULL OR page_date = '', page_date DESC, id DESC LIMIT 50 OFFSET 700")
def page_by_date(spark, sf):
    return L.page(L.filter_policies(B.policies(spark, sf)), 15, 50, "date").select(*LIST_COLUMNS)


@query("lib_page_by_title", f"{P} SELECT {LIST_SQL} FROM latest WHERE review_status <> 'rejected' ORDER BY title = '', title ASC, id DESC LIMIT 20 OFFSET 40")
def page_by_title(spark, sf):
    return L.page(L.filter_policies(B.policies(spark, sf)), 3, 7, "title").select(*LIST_COLUMNS)


@query("lib_page_default", f"{P} SELECT {LIST_SQL} FROM latest WHERE review_status <> 'rejected' ORDER BY id DESC LIMIT 20")
def page_default(spark, sf):
    return L.page(L.filter_policies(B.policies(spark, sf)), 0, 20, "unknown column").select(*LIST_COLUMNS)


@query("lib_count", f"{P} SELECT count(*) AS total FROM latest WHERE review_status <> 'rejected' AND region = 'ASIA'")
def count_rows(spark, sf):
    return L.count_rows(L.filter_policies(B.policies(spark, sf), region="ASIA"))


@query("lib_dashboard", f"""{P} SELECT count(*) FILTER (review_status <> 'rejected') AS policies, count(*) FILTER (need_review = 1) AS pending_review,
  count(*) FILTER (review_status IN ('confirmed', 'adjusted')) AS confirmed, count(*) FILTER (review_status = 'rejected') AS rejected,
  count(*) FILTER (todo_type = 'material') AS todo_material, count(*) FILTER (todo_type = 'review') AS todo_review,
  count(*) FILTER (todo_type = 'scope') AS todo_scope, count(*) FILTER (todo_type = 'system') AS todo_system,
  count(*) FILTER (todo_type = 'none' AND review_status = 'confirmed_auto') AS auto_confirmed,
  (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE enabled = 1) AS sources_enabled,
  (SELECT count(*) FROM orders) AS fetches, (SELECT count(*) FROM events) AS runs, (SELECT count(*) FROM lineitem) AS attachments FROM latest""")
def dashboard(spark, sf):
    return L.dashboard(B.policies(spark, sf), B.sources(spark, sf), B.table(spark, sf, "orders"), B.table(spark, sf, "events"), B.table(spark, sf, "lineitem"))


@query("lib_region_overview", f"""{P} SELECT region, count(*) AS total, max(page_date) AS latest_date,
  count(*) FILTER (category LIKE '%guide%') AS guide, count(*) FILTER (category LIKE '%access%') AS access,
  count(*) FILTER (category LIKE '%guarantee%') AS guarantee, count(*) FILTER (category LIKE '%incentive%') AS incentive,
  count(*) FILTER (need_review = 1) AS todo FROM latest WHERE review_status <> 'rejected' GROUP BY region""")
def region_overview(spark, sf):
    return L.region_overview(B.policies(spark, sf))


@query("lib_central_local_split", f"""{P} SELECT CASE region WHEN 'ASIA' THEN 'central' WHEN 'EUROPE' THEN 'unlabelled' WHEN 'AFRICA' THEN 'sample' ELSE 'local' END AS bucket,
  count(DISTINCT region) AS regions, count(*) AS total FROM latest WHERE review_status <> 'rejected' GROUP BY 1""")
def central_local_split(spark, sf):
    o = L.region_overview(B.policies(spark, sf))
    named = F.when(F.col("region") == "ASIA", "国家").when(F.col("region") == "EUROPE", "").when(F.col("region") == "AFRICA", "样例").otherwise(F.col("region"))
    return L.central_local_split(o.withColumn("region", named))


_TODO_VALUES = "(VALUES (0, 'material', '材料待补', '机器自修'), (1, 'system', '系统待修', '运维处理'), (2, 'candidate', '高置信候选', '业务抽检'), (3, 'review', '结论待确认', '业务确认'), (4, 'scope', '待定口径', '业务拍板')) t(position, todo_type, name, owner)"


@query("lib_todo_overview", f"{P} SELECT t.*, (SELECT count(*) FROM latest l WHERE l.review_status <> 'rejected' AND l.todo_type = t.todo_type) AS n FROM {_TODO_VALUES}")
def todo_overview(spark, sf):
    return L.todo_overview(B.policies(spark, sf))


@query("lib_todo_totals", f"""{P} SELECT count(*) AS total, count(*) FILTER (todo_type IN ('review', 'scope')) AS human, count(*) FILTER (todo_type = 'material') AS machine,
  count(*) FILTER (todo_type = 'system') AS system, count(*) FILTER (todo_type = 'none') AS clear FROM latest WHERE review_status <> 'rejected'""")
def todo_totals(spark, sf):
    return L.todo_totals(B.policies(spark, sf))


@query("lib_todo_samples", f"{P} SELECT todo_type, max(id) AS id, arg_max(title, id) AS title FROM latest WHERE review_status <> 'rejected' AND todo_type <> 'none' GROUP BY todo_type")
def todo_samples(spark, sf):
    return L.todo_samples(B.policies(spark, sf))


@query("lib_todo_lists", f"{P} SELECT todo_type, row_number() OVER (PARTITION BY todo_type ORDER BY id DESC) AS position, id, title FROM latest WHERE todo_type <> 'none' QUALIFY position <= 6")
def todo_lists(spark, sf):
    return L.todo_lists(B.policies(spark, sf)).select("todo_type", "position", "id", "title")


@query("lib_category_counts", f"{P} SELECT CASE category_names WHEN '' THEN '未分类' ELSE category_names END AS category_names, count(*) AS n FROM latest WHERE review_status <> 'rejected' GROUP BY 1")
def category_counts(spark, sf):
    return L.category_counts(B.policies(spark, sf))


@query("lib_regions", f"{P} SELECT DISTINCT region FROM latest WHERE review_status <> 'rejected' AND region <> ''")
def regions(spark, sf):
    return L.regions(B.policies(spark, sf))


@query("lib_policy_bundle", f"""{PA}, u AS (SELECT policy_id, 'attachments' AS kind FROM attachments UNION ALL SELECT id, 'versions' FROM policies)
  SELECT policy_id, kind, 0 AS part, count(*) AS items FROM u GROUP BY 1, 2""")
def policy_bundle(spark, sf):
    p = B.policies(spark, sf)
    atts = B.attachments(spark, sf).select("policy_id", "id", "name", "url", "parse_status")
    bundle = L.policy_bundle(p, {"attachments": (atts, "id"), "versions": (p.select(F.col("id").alias("policy_id"), "version", "title"), "version")})
    return bundle.select("policy_id", "kind", "part", F.size("items").cast("long").alias("items"))


@query("lib_list_sources", f"WITH {B.SOURCES_SQL} SELECT id, name, site, region FROM sources WHERE enabled = 1")
def list_sources(spark, sf):
    return L.list_sources(B.sources(spark, sf), enabled_only=True).drop("enabled")


@query("lib_list_ledger", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC")
def list_ledger(spark, sf):
    ledger = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return L.list_ledger(ledger, status="F")


@query("snk_export_csv", f"""{P} SELECT id, title, wenhao, CASE category_names WHEN '' THEN '未分类' ELSE category_names END AS category_names, region, page_date,
  CASE review_status WHEN 'pending' THEN '待复核' WHEN 'confirmed' THEN '人工确认' WHEN 'confirmed_auto' THEN '模型通过' ELSE '已剔除' END AS review_status,
  CASE todo_type WHEN 'material' THEN '材料待补' WHEN 'system' THEN '系统待修' WHEN 'candidate' THEN '高置信候选' WHEN 'review' THEN '结论待确认' WHEN 'scope' THEN '待定口径' ELSE '' END AS todo,
  CASE todo_type WHEN 'material' THEN '机器自修' WHEN 'system' THEN '运维处理' WHEN 'candidate' THEN '业务抽检' WHEN 'review' THEN '业务确认' WHEN 'scope' THEN '业务拍板' ELSE '' END AS owner,
  site, page_url FROM latest WHERE review_status <> 'rejected' ORDER BY region = '', region ASC, id DESC""")
def export_csv(spark, sf):
    return K.export_rows(L.filter_policies(B.policies(spark, sf)), "region")


@query("snk_formula_safe", """WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN '=' WHEN 'view' THEN '  -' WHEN 'click' THEN '@' ELSE '' END || CAST(user_id AS VARCHAR) AS cell FROM events)
  SELECT event_id, CASE WHEN ltrim(cell)[1] IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM t""")
def formula_safe(spark, sf):
    kind = F.col("event_type")
    head = F.when(kind == "error", "=").when(kind == "view", "  -").when(kind == "click", "@").otherwise("")
    return K.formula_safe(B.table(spark, sf, "events").select("event_id", F.concat(head, "user_id").alias("cell")))


@query("snk_nested_policies", f"""{PA}, a AS (SELECT policy_id, string_agg(name || '|' || url, ';' ORDER BY id) AS atts FROM attachments GROUP BY policy_id),
  s AS (SELECT p.id, string_agg(q.page_url, ';' ORDER BY q.updated_at, q.page_url) AS urls FROM policies p JOIN policies q ON p.policy_key = q.policy_key GROUP BY p.id)
  SELECT l.id, 0 AS part, coalesce(atts, '') AS attachments, coalesce(urls, '') AS sources FROM latest l LEFT JOIN a ON policy_id = l.id LEFT JOIN s ON s.id = l.id""")
def nested_policies(spark, sf):
    p = B.policies(spark, sf)
    seen = p.select("policy_key", "page_url", F.col("updated_at").alias("last_seen_at"))
    atts = B.attachments(spark, sf).select("policy_id", "id", "name", "url")
    rows = K.nested_policies(I.latest_version(p).select("id", "policy_key"), atts, seen)
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ";"), F.lit(""))
    return rows.select("id", "part", joined("attachments", lambda a: F.concat(a["name"], F.lit("|"), a["url"])).alias("attachments"),
                       joined("sources", lambda s: s["page_url"]).alias("sources"))


@query("snk_scoped_clear", """SELECT 'fetch_records' AS "table", count(*) AS n FROM orders UNION ALL SELECT 'policies', 0 UNION ALL SELECT 'run_logs', count(*) FROM events""")
def scoped_clear(spark, sf):
    tables = {"policies": B.policies(spark, sf), "run_logs": B.table(spark, sf, "events"),
              "fetch_records": B.table(spark, sf, "orders").withColumn("policy_id", F.col("o_custkey"))}
    return K.table_stats(K.scoped_clear(spark, tables, "library"))


@query("snk_table_stats", """SELECT 'documents' AS "table", count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def table_stats(spark, sf):
    return K.table_stats({n: B.table(spark, sf, n) for n in ("documents", "events", "lineitem")})
