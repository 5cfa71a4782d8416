"""The warehouse tables seen as ledger tables, as DataFrames and as the equal SQL views.

`documents` and `labels` supply documents with text; `orders`, `lineitem`, `customer`, `nation`
and `region` supply a relational ledger (policy = order, key = customer, attachment = line item,
source = nation); `events` supplies append-only logs; `pages` supplies fetched HTML.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores when the file splits are fewer; a large table is left as it is.

    For work that is heavy per byte (HTML, long texts): one small file is one split, hence one task.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


# ---- documents -------------------------------------------------------------------------------

DOCS_SQL = """docs AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, '' AS wenhao,
         source AS issuing_authority, source AS source_name, text AS content, lang, n_chars,
         'https://' || source || '.example.org/' || lang || '/' || n_chars AS page_url
  FROM documents)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.lit("").alias("wenhao"), F.col("source").alias("issuing_authority"), F.col("source").alias("source_name"),
        F.col("text").alias("content"), "lang", "n_chars",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), "n_chars").alias("page_url"))


KEYED_SQL = DOCS_SQL + """, keyed AS (
  SELECT *, source_name || ':' || lower(regexp_replace(title, '[《》"“”\\s]', '', 'g')) AS policy_key,
         sha256('["' || replace(replace(regexp_replace(content, '\\s+', '', 'g'), '\\', '\\\\'), '"', '\\"')
                || '", []]') AS content_sha256
  FROM docs)"""

# ---- relational ledger -----------------------------------------------------------------------

SOURCES_SQL = """sources AS (
  SELECT n_nationkey AS id, n_name AS name, lower(n_name) || '.example.org' AS site, r_name AS region,
         CASE WHEN n_regionkey < 4 THEN 1 ELSE 0 END AS enabled
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def sources(spark, sf) -> DataFrame:
    # nation and region are fixed dimensions of 25 and 5 rows; the planner broadcasts them by size.
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lower("n_name"), F.lit(".example.org")).alias("site"), F.col("r_name").alias("region"),
        F.when(F.col("n_regionkey") < 4, 1).otherwise(0).alias("enabled"))


POLICIES_SQL = SOURCES_SQL + """, policies AS (
  SELECT o_orderkey AS id, 'K' || o_custkey AS policy_key, o_orderkey AS version,
    substr(o_orderpriority, 3) || ' ' || year(o_orderdate) AS title,
    CASE WHEN o_totalprice < 50000 THEN '' ELSE 'No.' || CAST(floor(o_totalprice / 1000) AS BIGINT) END AS wenhao,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS page_date,
    s.region AS region, s.site AS site, s.id AS source_id, o_orderkey AS source_fetch_id,
    'https://' || s.site || '/' || o_orderkey AS page_url,
    CASE WHEN o_totalprice > 450000 THEN 'system'
         ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'material' WHEN '2-HIGH' THEN 'review'
              WHEN '3-MEDIUM' THEN 'scope' WHEN '4-NOT SPECIFIED' THEN 'candidate' ELSE 'none' END END AS todo_type,
    CASE WHEN o_totalprice < 20000 THEN 'rejected'
         ELSE CASE o_orderstatus WHEN 'F' THEN 'confirmed_auto' WHEN 'O' THEN 'confirmed' ELSE 'pending' END END AS review_status,
    CASE WHEN o_totalprice > 400000 THEN 'guide,access,guarantee,incentive' WHEN o_totalprice > 300000 THEN 'access,incentive'
         WHEN o_totalprice > 200000 THEN 'guarantee' WHEN o_totalprice > 100000 THEN 'guide' ELSE '' END AS category,
    CASE WHEN o_totalprice > 400000 THEN '引导类,准入类,保障类,激励约束类' WHEN o_totalprice > 300000 THEN '准入类,激励约束类'
         WHEN o_totalprice > 200000 THEN '保障类' WHEN o_totalprice > 100000 THEN '引导类' ELSE '' END AS category_names,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '未定位正文容器，整页文本仅供复核'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN '附件下载失败' ELSE '' END AS parse_error,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS parse_requires_review,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN sources s ON c_nationkey = s.id),
flagged AS (SELECT *, CASE WHEN todo_type IN ('candidate', 'review', 'scope') THEN 1 ELSE 0 END AS need_review FROM policies),
latest AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY policy_key ORDER BY version DESC) = 1)"""


def policies(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = sources(spark, sf).select(F.col("id").alias("source_id"), "region", "site")
    price, status, prio = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    day = F.col("o_orderdate").cast("date").cast("string")
    todo = F.when(price > 450000, "system").when(prio == "1-URGENT", "material").when(prio == "2-HIGH", "review") \
        .when(prio == "3-MEDIUM", "scope").when(prio == "4-NOT SPECIFIED", "candidate").otherwise("none")
    rows = o.join(s, F.col("c_nationkey") == F.col("source_id")).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("K"), "o_custkey").alias("policy_key"),
        F.col("o_orderkey").alias("version"), F.concat(F.expr("substr(o_orderpriority, 3)"), F.lit(" "), F.year("o_orderdate")).alias("title"),
        F.when(price < 50000, "").otherwise(F.concat(F.lit("No."), F.floor(price / 1000))).alias("wenhao"),
        F.when(status == "P", "").otherwise(day).alias("page_date"), "region", "site", "source_id",
        F.col("o_orderkey").alias("source_fetch_id"),
        F.concat(F.lit("https://"), "site", F.lit("/"), "o_orderkey").alias("page_url"), todo.alias("todo_type"),
        F.when(price < 20000, "rejected").when(status == "F", "confirmed_auto").when(status == "O", "confirmed")
        .otherwise("pending").alias("review_status"),
        F.when(price > 400000, "guide,access,guarantee,incentive").when(price > 300000, "access,incentive")
        .when(price > 200000, "guarantee").when(price > 100000, "guide").otherwise("").alias("category"),
        F.when(price > 400000, "引导类,准入类,保障类,激励约束类").when(price > 300000, "准入类,激励约束类")
        .when(price > 200000, "保障类").when(price > 100000, "引导类").otherwise("").alias("category_names"),
        F.when((status == "P") & (prio == "1-URGENT"), "未定位正文容器，整页文本仅供复核")
        .when((status == "P") & (prio == "2-HIGH"), "附件下载失败").otherwise("").alias("parse_error"),
        F.when(status == "P", 1).otherwise(0).alias("parse_requires_review"), day.alias("updated_at"))
    return rows.withColumn("need_review", F.col("todo_type").isin("candidate", "review", "scope").cast("int"))


ATTACHMENTS_SQL = """attachments AS (
  SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS id,
    l_orderkey AS policy_id,
    'file ' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.pdf' WHEN 'N' THEN '.docx' ELSE '.zip' END AS name,
    'https://files.example.org/' || l_partkey AS url,
    CASE l_returnflag WHEN 'A' THEN 'pdf' WHEN 'N' THEN 'docx' ELSE 'zip' END AS fmt,
    CASE WHEN l_discount < 0.02 THEN '' ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS sha256,
    CASE WHEN l_linestatus = 'F' THEN 'ok' WHEN l_quantity < 10 THEN 'failed' ELSE 'partial' END AS parse_status,
    CASE WHEN l_quantity < 10 THEN '' ELSE 'Part ' || l_partkey || ' supplied by ' || l_suppkey END AS parsed_text,
    CASE WHEN l_tax >= 0.07 THEN 'HTTP 404' WHEN l_tax >= 0.05 THEN 'read timeout' ELSE '' END AS error,
    '/store/' || l_partkey AS local_path, CAST(l_suppkey AS VARCHAR) AS parser_version, l_suppkey AS supplier
  FROM lineitem)"""


def attachments(spark, sf) -> DataFrame:
    flag = F.col("l_returnflag")
    ident = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 \
        + F.round(F.col("l_extendedprice") * 100).cast("long") % 10000000
    fmt = F.when(flag == "A", "pdf").when(flag == "N", "docx").otherwise("zip")
    part = F.col("l_partkey").cast("string")
    return table(spark, sf, "lineitem").select(
        ident.alias("id"), F.col("l_orderkey").alias("policy_id"),
        F.concat(F.lit("file "), "l_linenumber", F.lit("."), fmt).alias("name"),
        F.concat(F.lit("https://files.example.org/"), part).alias("url"), fmt.alias("fmt"),
        F.when(F.col("l_discount") < 0.02, "").otherwise(F.sha2(part, 256)).alias("sha256"),
        F.when(F.col("l_linestatus") == "F", "ok").when(F.col("l_quantity") < 10, "failed").otherwise("partial").alias("parse_status"),
        F.when(F.col("l_quantity") < 10, "").otherwise(F.concat(F.lit("Part "), part, F.lit(" supplied by "), "l_suppkey")).alias("parsed_text"),
        F.when(F.col("l_tax") >= 0.07, "HTTP 404").when(F.col("l_tax") >= 0.05, "read timeout").otherwise("").alias("error"),
        F.concat(F.lit("/store/"), part).alias("local_path"), F.col("l_suppkey").cast("string").alias("parser_version"),
        F.col("l_suppkey").alias("supplier"))


# ---- event logs ------------------------------------------------------------------------------

EVENTS_SQL = """log AS (
  SELECT event_id AS id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at FROM events)"""


def log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


ATTEMPTS_SQL = EVENTS_SQL + """, attempts AS (
  SELECT id, user_id AS fetch_id, 'https://files.example.org/' || k AS url,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS download_status,
    CASE WHEN event_type IN ('view', 'click') THEN 'ok' ELSE 'partial' END AS parse_status,
    CASE WHEN event_type = 'error' THEN CASE WHEN value < 5 THEN 'HTTP 404' WHEN value < 15 THEN '附件下载失败'
         WHEN value < 30 THEN '需要 playwright' ELSE 'read timeout' END
         WHEN event_type = 'signup' THEN '未命中，不收录' ELSE '' END AS error, seen_at AS checked_at
  FROM log)"""


def attempts(spark, sf) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return log(spark, sf).select(
        "id", F.col("user_id").alias("fetch_id"), F.concat(F.lit("https://files.example.org/"), "k").alias("url"),
        F.when(kind == "error", "failed").otherwise("ok").alias("download_status"),
        F.when(kind.isin("view", "click"), "ok").otherwise("partial").alias("parse_status"),
        F.when(kind == "error", F.when(value < 5, "HTTP 404").when(value < 15, "附件下载失败")
               .when(value < 30, "需要 playwright").otherwise("read timeout"))
        .when(kind == "signup", "未命中，不收录").otherwise("").alias("error"), F.col("seen_at").alias("checked_at"))


# ---- approval documents ----------------------------------------------------------------------
# One approval letter per order, written from the order, its customer and its line items.

APPROVAL_SQL = """ap AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN '项目建议书' WHEN 'O' THEN '可行性研究报告' ELSE '初步设计' END AS matter, o_orderpriority AS prio, o_totalprice AS price,
   year(o_orderdate) AS y, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS day, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS cust, c_mktsegment AS seg
   FROM orders JOIN customer ON o_custkey = c_custkey),
items AS (SELECT l_orderkey AS doc_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey + l_quantity / 100.0 AS ord, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS s,
   CASE l_returnflag WHEN 'A' THEN '总建筑面积' || CAST(l_quantity AS BIGINT) || '平方米，' WHEN 'N' THEN '新建泵站' || l_suppkey || '号管线长度约' || CAST(l_quantity AS BIGINT) || '公里，' ELSE '栽植乔木' || CAST(l_quantity AS BIGINT) || '株，' END AS text FROM lineitem),
raw_lines AS (
  SELECT doc_id, 1 AS page, 1 AS k, '发改投资' || CASE prio WHEN '5-LOW' THEN '[' || y || ']' ELSE '〔' || y || '〕' END || doc_id || '号' AS text FROM ap
  UNION ALL SELECT doc_id, 1, 2, '关于' || seg || '工程' || matter || '的批复' FROM ap
  UNION ALL SELECT doc_id, 1, 3, '西湖区建设局：' FROM ap
  UNION ALL SELECT doc_id, 1, 4, '项目代码为2024-' || cust || '-04-01-' || cust || '。' FROM ap
  UNION ALL SELECT doc_id, 2, 1, CASE prio WHEN '1-URGENT' THEN '一、总体要求：' WHEN '2-HIGH' THEN '一、工程任务和规模' ELSE '一、建设内容及规模：' END FROM ap
  UNION ALL SELECT doc_id, 3, 1, '二、建设地点：位于' || seg || '。' FROM ap
  UNION ALL SELECT doc_id, 3, 2, CASE prio WHEN '3-MEDIUM' THEN '三、投资总概算为' ELSE '三、项目投资估算为' END || CAST(floor(price) AS BIGINT) || '万元。' FROM ap
  UNION ALL SELECT doc_id, 3, 3, CASE prio WHEN '4-NOT SPECIFIED' THEN '运营资金全部由区级安排。' ELSE '建设资金由区财政统筹。' END FROM ap
  UNION ALL SELECT doc_id, 3, 4, '四、实施周期24个月。请据此开展工作。' FROM ap
  UNION ALL SELECT doc_id, 3, 5, '西湖区建设局' || day || '印发' FROM ap
  UNION ALL SELECT doc_id, 2, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY ord), text FROM items WHERE doc_id IN (SELECT doc_id FROM ap)),
numbered AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS n, text FROM raw_lines),
lines AS (SELECT doc_id, 'p' || page || '-l' || n AS id, page, n, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page, n) - length(text) AS start, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page, n) AS end_ FROM numbered),
texts AS (SELECT doc_id, string_agg(text, '' ORDER BY page, n) AS text FROM lines GROUP BY 1)"""


def approval_raw_lines(spark, sf) -> DataFrame:
    """Text lines as a PDF decoder would deliver them, page numbers and watermarks included."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    cat = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    matter = F.when(s == "F", "项目建议书").when(s == "O", "可行性研究报告").otherwise("初步设计")
    y, cust, seg = F.year("o_orderdate"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.col("c_mktsegment")
    day = cat(y, "年", F.month("o_orderdate"), "月", F.dayofmonth("o_orderdate"), "日")
    key = F.col("o_orderkey")
    letter = [
        (1, 1, cat("发改投资", F.when(prio == "5-LOW", cat("[", y, "]")).otherwise(cat("〔", y, "〕")), key, "号")), (1, 2, cat("关于", seg, "工程", matter, " 的批复")),
        (1, 3, F.lit("西湖区建设局：")), (1, 4, cat("项目代码为2024-", cust, "-04-01-", cust, "。")), (1, 5, F.lit("浙江政务服务网")), (1, 6, F.lit("—1—")),
        (2, 1, F.when(prio == "1-URGENT", "一、总体要求：").when(prio == "2-HIGH", "一、工程任务和规模").otherwise("一、建设内容及规模：")),
        (3, 1, cat("二、建设地点：位于", seg, "。")), (3, 2, cat(F.when(prio == "3-MEDIUM", "三、投资总概算为").otherwise("三、项目投资估算为"), F.floor("o_totalprice"), "万元。")),
        (3, 3, F.when(prio == "4-NOT SPECIFIED", "运营资金全部由区级安排。").otherwise("建设资金由区财政统筹。")), (3, 4, F.lit("四、实施周期24个月。请据此开展工作。")), (3, 5, cat("西湖区建设局", day, "印发"))]
    rows = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(float(k * 20 if k < 6 else 780)).alias("y"), t.alias("text")) for p, k, t in letter])
    own = o.select(key.alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.page", "r.y", F.lit(0.0).alias("x"), "r.text")
    q, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    text = F.when(flag == "A", cat("总建筑面积", q, "平方米，")).when(flag == "N", cat("新建泵站", F.col("l_suppkey"), "号管线长度约", q, "公里，")).otherwise(cat("栽植乔木", q, "株，"))
    # on one band from left to right, below the heading
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(2).alias("page"), F.lit(300.0).alias("y"),
                                                (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") + F.col("l_quantity") / 100.0).cast("double").alias("x"), text.alias("text"))
    items = items.join(o.select(key.alias("doc_id")), "doc_id", "left_semi")
    both = own.unionByName(items)
    return both.select("doc_id", "page", "text", F.array("x", "y", F.lit(500.0), F.col("y") + 12).alias("bbox"), F.lit(800.0).alias("page_height"), F.lit("text").alias("method"))
