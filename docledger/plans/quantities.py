"""Queries over quantities and stage comparison.

Projects are customers, documents their orders (stage by status), metrics their line items, whose
quantities are written in different units and precisions.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import quantity as Q, skew
from docledger.operators.approval import compare as C
from docledger.plans import binding as B
from docledger.plans.registry import query

_AMOUNT_SQL = """w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS e, l_tax FROM lineitem),
t AS (SELECT *, CASE f WHEN 'A' THEN CASE s WHEN 'F' THEN '约' || q || '公里' ELSE q || '亩' END WHEN 'N' THEN CASE s WHEN 'F' THEN q || '公里-' || e || '米' ELSE '不超过' || (e // 1000) || ',' || lpad(CAST(e % 1000 AS VARCHAR), 3, '0') || '.5万元' END
   ELSE CASE s WHEN 'F' THEN q || '平方米-' || e || '米' ELSE '共 ' || q || ' 座以上' END END AS raw FROM w)"""


def _amounts(spark, sf):
    f, s, q, e = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("long"), F.col("l_extendedprice").cast("decimal(20,2)")
    e = F.round(e, 0).cast("long")
    cat = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    raw = F.when(f == "A", F.when(s == "F", cat("约", q, "公里")).otherwise(cat(q, "亩"))).when(
        f == "N", F.when(s == "F", cat(q, "公里-", e, "米")).otherwise(cat("不超过", F.floor(e / 1000), ",", F.lpad((e % 1000).cast("string"), 3, "0"), ".5万元"))) \
        .otherwise(F.when(s == "F", cat(q, "平方米-", e, "米")).otherwise(cat("共 ", q, " 座以上")))
    return B.spread(B.table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", raw.alias("raw"))


_Q_SQL = _AMOUNT_SQL + """, qs AS (SELECT l_orderkey, l_linenumber, l_partkey, raw, CASE WHEN f = 'A' AND s = 'F' THEN q * 1000.0 WHEN f = 'A' THEN q * 2000.0 / 3 WHEN f = 'N' AND s = 'F' THEN CASE WHEN e >= q * 1000 THEN q * 1000.0 END
    WHEN f = 'N' THEN e + 0.5 WHEN s = 'O' THEN q END AS number, CASE WHEN f = 'N' AND s = 'F' AND e >= q * 1000 THEN e END AS upper,
  CASE WHEN f = 'A' THEN CASE s WHEN 'F' THEN '米' ELSE '平方米' END WHEN f = 'N' THEN CASE s WHEN 'F' THEN CASE WHEN e >= q * 1000 THEN '米' END ELSE '万元' END WHEN s = 'O' THEN '座' END AS unit,
  CASE WHEN f = 'A' AND s = 'F' THEN '约' WHEN f = 'N' AND s = 'O' THEN '不超过' WHEN f = 'R' AND s = 'O' THEN '以上' WHEN f = 'R' OR (f = 'N' AND s = 'F' AND e < q * 1000) THEN NULL ELSE '' END AS qualifier,
  CASE WHEN f = 'A' AND s = 'O' THEN true WHEN f = 'R' AND s = 'F' THEN NULL WHEN f = 'N' AND s = 'F' AND e < q * 1000 THEN NULL ELSE false END AS approximate,
  CASE WHEN f = 'A' AND s = 'F' THEN 1000 WHEN f = 'A' THEN 1000.0 / 3 WHEN f = 'N' AND s = 'O' THEN 0.1 WHEN f = 'R' AND s = 'O' THEN 1 END AS tolerance FROM t)"""


@query("qty_quantity", f"WITH {_Q_SQL} SELECT l_orderkey, l_linenumber, raw, round(number::DOUBLE, 6) AS number, upper::DOUBLE AS upper, unit, qualifier, approximate FROM qs")
def quantity(spark, sf):
    rows = _amounts(spark, sf).withColumn("q", Q.quantity(F.col("raw")))
    return rows.select("l_orderkey", "l_linenumber", "raw", F.round(F.col("q.number").cast("double"), 6).alias("number"), F.col("q.upper").cast("double").alias("upper"),
                       "q.unit", "q.qualifier", F.col("q.approximate_conversion").alias("approximate"))


@query("qty_quantity_key", f"WITH {_Q_SQL} SELECT unit, qualifier, count(*) AS n, count(DISTINCT (round(number::DOUBLE, 6), upper)) AS keys FROM qs WHERE number IS NOT NULL GROUP BY 1, 2")
def quantity_key(spark, sf):
    # an exploded array of one: the filter and the columns of the key read one parse
    rows = _amounts(spark, sf).select(F.explode(F.array(Q.quantity_key(Q.quantity(F.col("raw"))))).alias("k")).where("k IS NOT NULL")
    return rows.groupBy("k.unit", "k.qualifier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("keys"))


@query("qty_round_tolerance", f"WITH {_Q_SQL} SELECT l_orderkey, l_linenumber, raw, round(tolerance::DOUBLE, 6) AS tolerance FROM qs")
def round_tolerance(spark, sf):
    return _amounts(spark, sf).select("l_orderkey", "l_linenumber", "raw", F.round(Q.round_tolerance(F.col("raw")).cast("double"), 6).alias("tolerance"))


# metric m of an order: kilometres or metres of the same length, sometimes "about", sometimes more metres
METRIC_SQL = """docs AS (SELECT 'K' || o_custkey AS project_key, o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN '建议书/立项' WHEN 'O' THEN '可行性研究' ELSE '初步设计' END AS stage,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS d, o_orderpriority AS filename, o_totalprice AS price FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY r, d, filename, doc_id) AS doc_rank, count(*) OVER (PARTITION BY project_key) AS n_docs FROM docs),
mm AS (SELECT d.project_key, d.doc_id, d.doc_rank, d.n_docs, d.stage, 'M' || l_returnflag || l_linenumber AS name, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS idx,
  CASE WHEN l_discount >= 0.05 THEN 'extracted' ELSE 'reviewed' END AS status, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_tax > 0.06 THEN '约' ELSE '' END AS pre, l_linestatus AS s, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 700 END AS more FROM lineitem JOIN ranked d ON l_orderkey = d.doc_id),
mv AS (SELECT *, pre || CASE s WHEN 'F' THEN q || '公里' ELSE (q * 1000 + more) || '米' END AS value FROM mm),
g AS (SELECT project_key, name, doc_id, doc_rank, n_docs, stage, string_agg(value, '；' ORDER BY idx, value) AS value, CASE WHEN count(*) = 1 THEN min(status) WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN bool_and(status = 'reviewed') THEN 'reviewed' ELSE 'needs_review' END AS status,
   arg_min(q, row(idx, value)) AS q, arg_min(pre, row(idx, value)) AS pre, arg_min(s, row(idx, value)) AS s, arg_min(more, row(idx, value)) AS more FROM mv GROUP BY 1, 2, 3, 4, 5, 6),
mc AS (SELECT *, CASE s WHEN 'F' THEN q * 1000 ELSE q * 1000 + more END AS num, (CASE s WHEN 'F' THEN 500.0 ELSE 0.5 END) * (CASE pre WHEN '约' THEN 2 ELSE 1 END) AS tol FROM g)"""


def docs(spark, sf):
    o, s = B.table(spark, sf, "orders"), F.col("o_orderstatus")
    rows = o.select(F.concat(F.lit("K"), "o_custkey").alias("project_key"), F.col("o_orderkey").alias("doc_id"),
                    F.when(s == "F", "建议书/立项").when(s == "O", "可行性研究").otherwise("初步设计").alias("stage"),
                    F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.dayofmonth("o_orderdate"), F.lit("日")).alias("issued"), F.col("o_orderpriority").alias("filename"), "o_totalprice")
    return C.order_stages(rows)


def metrics(spark, sf, ranked=None):
    q = F.col("l_quantity").cast("long")
    more = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), 0).otherwise(700)
    value = F.concat(F.when(F.col("l_tax") > 0.06, "约").otherwise(""), F.when(F.col("l_linestatus") == "F", F.concat(q, F.lit("公里"))).otherwise(F.concat(q * 1000 + more, F.lit("米"))))
    li = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("M"), "l_returnflag", "l_linenumber").alias("name"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("idx"), value.alias("value"), F.when(F.col("l_discount") >= 0.05, "extracted").otherwise("reviewed").alias("status"))
    d = docs(spark, sf) if ranked is None else ranked
    return li.join(d.select("project_key", "doc_id", "doc_rank", "stage", "filename"), "doc_id")


@query("cmp_order_stages", f"WITH {METRIC_SQL} SELECT project_key, doc_id, stage, doc_rank FROM ranked")
def order_stages(spark, sf):
    return docs(spark, sf).select("project_key", "doc_id", "stage", "doc_rank")


FIXED_SQL = METRIC_SQL + """, fx AS (SELECT project_key, doc_id, doc_rank, '项目名称' AS name, CASE filename WHEN '1-URGENT' THEN '工程〔1〕' ELSE '工程[1]。' END AS value, 'extracted' AS status, NULL AS reason FROM ranked
  UNION ALL SELECT project_key, doc_id, doc_rank, '项目单位', CASE WHEN filename <> '5-LOW' THEN 'office' END, CASE WHEN filename = '5-LOW' THEN 'missing' ELSE 'extracted' END, CASE WHEN filename = '5-LOW' AND price > 250000 THEN 'unextracted' WHEN filename = '5-LOW' THEN 'absent' END FROM ranked
  UNION ALL SELECT project_key, doc_id, doc_rank, '建设地点', 'here', CASE WHEN price > 480000 THEN 'needs_review' ELSE 'extracted' END, NULL FROM ranked
  UNION ALL SELECT project_key, doc_id, doc_rank, '建设周期', CASE WHEN price > 120000 THEN CASE r WHEN 0 THEN '2年' ELSE '24个月' END ELSE '24.3个月' END, 'extracted', NULL FROM ranked
  UNION ALL SELECT project_key, doc_id, doc_rank, '总投资/匡算/估算/概算', CASE r WHEN 2 THEN '概算总投资' ELSE '投资估算为' END || CASE WHEN price > 60000 THEN '3亿元' ELSE '30000.4万元' END, 'extracted', NULL FROM ranked),
fq AS (SELECT *, CASE name WHEN '建设周期' THEN CASE value WHEN '24.3个月' THEN 24.3 ELSE 24 END WHEN '总投资/匡算/估算/概算' THEN CASE WHEN contains(value, '亿') THEN 30000 ELSE 30000.4 END END AS num,
   CASE name WHEN '建设周期' THEN CASE value WHEN '24.3个月' THEN 0.05 WHEN '2年' THEN 6 ELSE 0.5 END WHEN '总投资/匡算/估算/概算' THEN CASE WHEN contains(value, '亿') THEN 5000 ELSE 0.05 END END AS tol,
   CASE WHEN contains(value, '概算') THEN '概算' ELSE '估算' END AS basis, replace(replace(replace(value, '〔', '['), '〕', ']'), '。', '') AS nv FROM fx),
fs AS (SELECT project_key, name, count(*) AS n_docs, CASE WHEN bool_or(status IN ('needs_review')) THEN 'review' WHEN count(value) < count(*) AND count(DISTINCT value) <= 1 THEN CASE WHEN bool_or(coalesce(reason, '') = 'unextracted') THEN
     CASE WHEN count(value) = 0 AND false THEN 'same' ELSE 'unextracted' END ELSE 'missing' END WHEN count(DISTINCT value) <= 1 THEN 'same' WHEN count(DISTINCT nv) = 1 THEN 'equivalent' ELSE 'different' END AS status,
   count(num) AS qn, count(DISTINCT num) AS dn, max(num) - min(num) AS spread, max(tol) AS tol, count(DISTINCT basis) AS bases, count(DISTINCT value) AS dv,
   string_agg(basis, ' → ' ORDER BY doc_rank) AS steps FROM fq GROUP BY 1, 2)"""


def fixed_cells(spark, sf, ranked=None):
    d = docs(spark, sf) if ranked is None else ranked
    f, p, r = F.col("filename"), F.col("o_totalprice"), F.col("stage")
    low = f == "5-LOW"
    nothing = F.lit(None).cast("string")
    cell = lambda name, value, status, reason=nothing: F.struct(F.lit(name).alias("name"), value.alias("value"), status.alias("status"), reason.alias("reason"))
    done = F.lit("extracted")
    money = F.concat(F.when(r == "初步设计", "概算总投资").otherwise("投资估算为"), F.when(p > 60000, "3亿元").otherwise("30000.4万元"))
    cells = F.array(
        cell("项目名称", F.when(f == "1-URGENT", "工程〔1〕").otherwise("工程[1]。"), done),
        cell("项目单位", F.when(~low, "office"), F.when(low, "missing").otherwise("extracted"), F.when(low & (p > 250000), "unextracted").when(low, "absent")),
        cell("建设地点", F.lit("here"), F.when(p > 480000, "needs_review").otherwise("extracted")),
        cell("建设周期", F.when(p > 120000, F.when(r == "建议书/立项", "2年").otherwise("24个月")).otherwise("24.3个月"), done), cell("总投资/匡算/估算/概算", money, done))
    return d.select("project_key", "doc_id", "doc_rank", F.explode(cells).alias("c")).select("project_key", "doc_id", "doc_rank", "c.*")


@query("cmp_compare_fixed", f"WITH {FIXED_SQL} SELECT project_key, name, n_docs, status FROM fs")
def compare_fixed(spark, sf):
    return C.compare_fixed(fixed_cells(spark, sf))


@query("cmp_fixed_quantity_notes", f"""WITH {FIXED_SQL}, n AS (SELECT *, name IN ('建设周期', '总投资/匡算/估算/概算') AND status NOT IN ('review', 'missing', 'unextracted') AS measured, name = '建设周期' OR bases = 1 AS one FROM fs),
  n2 AS (SELECT *, CASE WHEN measured AND dn = 1 AND one AND dv > 1 THEN 'equivalent' ELSE status END AS st FROM n), n3 AS (SELECT *, measured AND st = 'different' AND one AND n_docs >= 2 AND spread > 0 AND spread <= tol AS rounded FROM n2)
  SELECT project_key, name, n_docs, CASE WHEN rounded THEN 'equivalent' ELSE st END AS status, measured AND name = '总投资/匡算/估算/概算' AND bases > 1 AS basis_note, coalesce(rounded, false) AND NOT (name = '总投资/匡算/估算/概算' AND bases > 1) AS rounding_note,
    CASE WHEN measured AND name = '总投资/匡算/估算/概算' AND bases > 1 THEN '投资口径：' || steps || '；阶段金额变化不直接认定为异常。' ELSE '' END AS note FROM n3""")
def fixed_quantity_notes(spark, sf):
    n = C.fixed_quantity_notes(fixed_cells(spark, sf))
    basis, rounding = F.startswith("note", F.lit("投资口径")), F.startswith("note", F.lit("各阶段写法精度不同"))
    return n.select("project_key", "name", "n_docs", "status", basis.alias("basis_note"), rounding.alias("rounding_note"), F.when(basis, F.col("note")).otherwise("").alias("note"))


@query("cmp_metric_cells", f"WITH {METRIC_SQL} SELECT project_key, name, doc_id, doc_rank, value, status FROM mc")
def metric_cells(spark, sf):
    return C.metric_cells(metrics(spark, sf))


STATUS_SQL = METRIC_SQL + """, ms AS (SELECT project_key, name, max(n_docs) AS n_docs, count(*) AS n_present, bool_or(status IN ('conflict', 'needs_review')) AS review, count(DISTINCT value) AS dv, count(DISTINCT replace(value, '；', '；')) AS nv,
    count(DISTINCT row(num, pre)) AS dk, max(num) - min(num) AS spread, max(tol) AS tol FROM mc GROUP BY 1, 2),
ms2 AS (SELECT *, CASE WHEN review THEN 'review' WHEN n_present < n_docs AND dv <= 1 THEN 'missing' WHEN dv <= 1 THEN 'same' ELSE 'different' END AS base FROM ms),
ms3 AS (SELECT *, n_present > 1 AND base <> 'review' AND dk = 1 AND (dv > 1 OR n_present < n_docs) AS eq FROM ms2),
ms4 AS (SELECT *, NOT eq AND n_present > 1 AND base <> 'review' AND spread > 0 AND spread <= tol AS rounded FROM ms3),
st AS (SELECT project_key, name, n_docs, n_present, CASE WHEN eq OR rounded THEN CASE WHEN n_present = n_docs THEN 'equivalent' ELSE 'missing' END ELSE base END AS status, CASE WHEN rounded THEN 'rounding' ELSE '' END AS note_kind,
   n_present > 1 AND base <> 'review' AND NOT rounded AS comparable FROM ms4)"""


def _cells(spark, sf, d=None):
    """Metric cells with their quantities, written once for the branches that read them."""
    return skew.pinned(Q.with_quantity(C.metric_cells(metrics(spark, sf, d))))


def _statuses(spark, sf):
    d = skew.pinned(docs(spark, sf))
    cells = _cells(spark, sf, d)
    return d, cells, C.metric_status(cells, C.doc_counts(d))


@query("cmp_metric_status", f"WITH {STATUS_SQL} SELECT *, 26 AS priority FROM st")
def metric_status(spark, sf):
    return _statuses(spark, sf)[2]


DELTA_SQL = STATUS_SQL + """, lagged AS (SELECT mc.*, lag(num) OVER w AS pnum, lag(tol) OVER w AS ptol, lag(stage) OVER w AS pstage, lag(pre) OVER w AS ppre FROM mc JOIN st USING (project_key, name) WHERE comparable WINDOW w AS (PARTITION BY project_key, name ORDER BY doc_rank)),
dl AS (SELECT project_key, name, doc_rank, pstage AS stage_from, stage AS stage_to, CAST(num - pnum AS DOUBLE) AS delta, round((num - pnum) * 100.0 / pnum, 6) AS percent, abs(num - pnum) <= greatest(tol, ptol) AS rounding,
  pstage || '→' || stage || '：' || CASE WHEN num > pnum THEN '+' ELSE '' END || (num - pnum) || '米' AS step, pre || ppre <> '' AS loose FROM lagged WHERE num <> pnum)"""


@query("cmp_metric_deltas", f"""WITH {DELTA_SQL} SELECT project_key, name, doc_rank, stage_from, stage_to, delta, percent, rounding, step || CASE WHEN rounding THEN '（差异属书写精度或约数范围，未认定为变化）' ELSE
  CASE WHEN abs(percent) < 0.005 THEN '（变动比例小于0.01%）' ELSE '（' || CASE WHEN percent > 0 THEN '+' ELSE '' END || printf('%.2f', round_even(percent, 2)) || '%）' END || CASE WHEN loose THEN '，含约数/限定' ELSE '' END END AS note FROM dl""")
def metric_deltas(spark, sf):
    d, cells, s = _statuses(spark, sf)
    return C.metric_deltas(cells, s, d).withColumn("delta", F.col("delta").cast("double")).withColumn("percent", F.round("percent", 6))


@query("cmp_metric_notes", f"WITH {DELTA_SQL} SELECT st.project_key, st.name, status, (SELECT count(*) FROM dl WHERE dl.project_key = st.project_key AND dl.name = st.name) AS steps, note_kind = 'rounding' AS rounding FROM st")
def metric_notes(spark, sf):
    d, cells, s = _statuses(spark, sf)
    s = skew.pinned(s)  # read for the steps, the rounded metrics and all others
    n = C.metric_notes(cells, s, C.metric_deltas(cells, s, d))
    return n.select("project_key", "name", "status", F.when(F.col("note_kind") == "rounding", 0).otherwise(F.regexp_count("note", F.lit("→"))).cast("long").alias("steps"),
                    F.startswith("note", F.lit("各阶段写法精度不同")).alias("rounding"))


ALIGN_SQL = METRIC_SQL + """, one AS (SELECT project_key, name, max(num) AS num, max(pre) AS pre, arg_min(value, doc_rank) AS value FROM mc GROUP BY 1, 2 HAVING count(DISTINCT row(num, pre)) = 1),
gr AS (SELECT *, count(*) OVER (PARTITION BY project_key, num, pre) AS group_size, min(name) OVER (PARTITION BY project_key, num, pre) AS anchor FROM one QUALIFY group_size > 1)"""


@query("cmp_alignment_groups", f"WITH {ALIGN_SQL} SELECT project_key, name, value, num || '||米|' || pre AS quantity, group_size, anchor FROM gr")
def alignment_groups(spark, sf):
    return C.alignment_groups(_cells(spark, sf))


@query("cmp_align_metrics", f"""WITH {ALIGN_SQL} SELECT a.project_key, a.name AS name_a, b.name AS name_b, a.value, a.num || '||米|' || a.pre AS quantity, a.name || '｜' || b.name AS pair FROM gr a JOIN gr b ON a.project_key = b.project_key AND a.num = b.num AND a.pre = b.pre AND a.name < b.name AND a.name = a.anchor
  WHERE NOT EXISTS (SELECT 1 FROM mc x JOIN mc y ON x.doc_id = y.doc_id WHERE x.project_key = a.project_key AND y.project_key = a.project_key AND x.name = a.name AND y.name = b.name)
  AND NOT (a.name = 'MA1' AND b.name = 'MN2')""")
def align_metrics(spark, sf):
    decided = docs(spark, sf).select("project_key", F.lit("MA1｜MN2").alias("pair"))
    return C.align_metrics(_cells(spark, sf), decided)


@query("cmp_comparison", f"""WITH {FIXED_SQL} SELECT project_key, count(*) AS fixed_rows FROM fs GROUP BY 1""")
def comparison(spark, sf):
    d, cells, s = _statuses(spark, sf)
    notes = s.withColumn("note", F.lit(""))
    rows = C.comparison(C.fixed_quantity_notes(fixed_cells(spark, sf, d)), notes, C.align_metrics(cells))
    return rows.where("kind = 'fixed'").groupBy("project_key").agg(F.count(F.lit(1)).alias("fixed_rows"))
