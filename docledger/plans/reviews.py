"""Queries over the human review of approval documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import quantity as N, skew
from docledger.operators.approval import compare as C, progress as R
from docledger.plans import binding as B, quantities as Q
from docledger.plans.registry import query
from docledger.sources import sinks as K

# cells of an order letter and its line items as metrics, with states that need a human
STATE_SQL = """rd AS (SELECT o_orderkey AS doc_id, 'K' || o_custkey AS project_key, o_orderpriority AS prio, o_totalprice AS price, CASE o_orderstatus WHEN 'F' THEN '建议书/立项' WHEN 'O' THEN '可行性研究' ELSE '待确认' END AS stage FROM orders),
rc AS (SELECT doc_id, '标题' AS name, 'title' AS value, CASE WHEN prio = '1-URGENT' THEN 'needs_review' ELSE 'extracted' END AS status, CASE WHEN prio = '1-URGENT' AND price > 250000 THEN 'agent-read' ELSE 'rule' END AS method, NULL AS reason FROM rd
  UNION ALL SELECT doc_id, '项目代码', NULL, 'missing', 'rule', CASE WHEN prio = '2-HIGH' THEN 'unextracted' ELSE 'absent' END FROM rd UNION ALL SELECT doc_id, '项目名称', 'name', 'reviewed', 'human', NULL FROM rd),
rm AS (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS idx, 'M' || l_returnflag AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '米' AS value, CASE WHEN l_tax > 0.06 THEN 'needs_review' ELSE 'extracted' END AS status,
   CASE WHEN l_linestatus = 'F' THEN 'human' ELSE 'rule' END AS method FROM lineitem),
rx AS (SELECT *, count(DISTINCT value) OVER (PARTITION BY doc_id, name) > 1 AS clash FROM rm)"""
S = "WITH " + STATE_SQL


def docs(spark, sf):
    s = F.col("o_orderstatus")
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("K"), "o_custkey").alias("project_key"), F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"),
        F.when(s == "F", "建议书/立项").when(s == "O", "可行性研究").otherwise("待确认").alias("stage"), F.lit(3).alias("revision"), F.lit("name").alias("project_name"), F.lit("f.pdf").alias("filename"))


def cells(spark, sf):
    urgent, none = F.col("prio") == "1-URGENT", F.lit(None).cast("string")
    row = lambda n, v, s, m, r: F.struct(F.lit(n).alias("name"), v.alias("value"), s.alias("status"), m.alias("method"), r.alias("reason"))
    rows = F.array(
        row("标题", F.lit("title"), F.when(urgent, "needs_review").otherwise("extracted"), F.when(urgent & (F.col("price") > 250000), "agent-read").otherwise("rule"), none),
        row("项目代码", none, F.lit("missing"), F.lit("rule"), F.when(F.col("prio") == "2-HIGH", "unextracted").otherwise("absent")), row("项目名称", F.lit("name"), F.lit("reviewed"), F.lit("human"), none))
    return docs(spark, sf).select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*")


def metrics(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("idx"), F.concat(F.lit("M"), "l_returnflag").alias("name"),
        F.concat(F.col("l_quantity").cast("long"), F.lit("米")).alias("value"), F.when(F.col("l_tax") > 0.06, "needs_review").otherwise("extracted").alias("status"),
        F.when(F.col("l_linestatus") == "F", "human").otherwise("rule").alias("method"))


PENDING_SQL = STATE_SQL + """, pend AS (SELECT doc_id, 0 AS "order", 'stage' AS kind, NULL AS idx, '审批阶段' AS name, 'needs_review' AS status, '请按批复标题确认审批阶段' AS why FROM rd WHERE stage = '待确认'
  UNION ALL SELECT doc_id, 1, 'fixed', NULL, name, status, CASE WHEN method = 'agent-read' THEN '由自检循环补回（采用了放宽的识别办法），可信度低于主干直取，需人工核对' WHEN reason = 'unextracted' THEN '原文有该要素的线索，但自动提取未取到' ELSE '系统给出的是推断值或图形候选，需人工确认' END FROM rc WHERE status = 'needs_review' OR coalesce(reason, '') = 'unextracted'
  UNION ALL SELECT doc_id, 2, 'metric', idx, name, CASE WHEN clash THEN 'conflict' ELSE status END, CASE WHEN clash THEN '同一文档内出现多个值，需人工选定统计口径' ELSE '系统给出的是推断值或图形候选，需人工确认' END FROM rx WHERE clash OR status = 'needs_review')"""


def items(spark, sf):
    return R.pending_items(docs(spark, sf), cells(spark, sf), metrics(spark, sf))


@query("rvw_pending_items", f'WITH {PENDING_SQL} SELECT doc_id, "order", kind, idx, name, status, why FROM pend')
def pending_items(spark, sf):
    return items(spark, sf).select("doc_id", "order", "kind", "idx", "name", "status", "why")


@query("rvw_absent_items", f"{S} SELECT doc_id, name, '未检出相关线索，建议抽查原文' AS why FROM rc WHERE reason = 'absent'")
def absent_items(spark, sf):
    return R.absent_items(cells(spark, sf))


@query("rvw_reassess_conflicts", f"{S} SELECT doc_id, idx, name, CASE WHEN clash THEN 'conflict' WHEN method = 'human' THEN 'reviewed' ELSE 'needs_review' END AS status FROM rx")
def reassess_conflicts(spark, sf):
    return R.reassess_conflicts(metrics(spark, sf).withColumn("status", F.lit("conflict"))).select("doc_id", "idx", "name", "status")


_EDITS_SQL = STATE_SQL + """, ed AS (SELECT doc_id, doc_id * 10 + 1 AS edit_id, CASE prio WHEN '1-URGENT' THEN 'fixed' WHEN '2-HIGH' THEN 'stage' WHEN '3-MEDIUM' THEN 'fixed' WHEN '4-NOT SPECIFIED' THEN 'fixed' ELSE 'other' END AS kind, prio, price,
   CASE prio WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN CASE WHEN price > 250000 THEN '字段内容无效' ELSE '' END WHEN '3-MEDIUM' THEN '项目代码须为四位-六位-两位-两位-六位数字' WHEN '4-NOT SPECIFIED' THEN '文件已被修改，请刷新后再试' ELSE '字段类型无效' END AS why FROM rd)"""


def _corrected(spark, sf):
    d = docs(spark, sf)
    prio = F.col("prio")
    e = d.select((F.col("doc_id") * 10 + 1).alias("edit_id"), "doc_id", F.when(prio == "4-NOT SPECIFIED", 2).otherwise(3).alias("revision"),
                 F.when(prio == "2-HIGH", "stage").when(prio == "5-LOW", "other").otherwise("fixed").alias("kind"), F.when(prio == "1-URGENT", "标题").otherwise("项目代码").alias("name"), F.lit(None).cast("long").alias("idx"),
                 F.when(prio == "1-URGENT", " 新标题 ").when(prio == "2-HIGH", F.when(F.col("price") > 250000, F.repeat(F.lit("x"), 15001)).otherwise("初步设计")).otherwise("2024-1").alias("value"),
                 F.lit(None).cast("string").alias("metric_name"), F.array().cast("array<string>").alias("evidence_ids"), F.lit("why").alias("reason"))
    # a second edit of the same revision comes too late
    late = e.where("name = '标题'").withColumn("edit_id", F.col("edit_id") + 1)
    lines = d.select("doc_id", F.lit("p1-l1").alias("id"))
    return R.apply_corrections(d.drop("prio", "price"), cells(spark, sf), metrics(spark, sf), lines, e.unionByName(late))


@query("rvw_apply_corrections", f"""WITH {_EDITS_SQL} SELECT c.doc_id, c.name, CASE WHEN c.name = '标题' AND prio = '1-URGENT' THEN '新标题' ELSE value END AS value, CASE WHEN c.name = '标题' AND prio = '1-URGENT' THEN 'reviewed' ELSE status END AS status,
  CASE WHEN c.name = '标题' AND prio = '1-URGENT' THEN 'human' ELSE method END AS method FROM rc c JOIN rd USING (doc_id)""")
def apply_corrections(spark, sf):
    return _corrected(spark, sf)[1].select("doc_id", "name", "value", "status", "method")


@query("rvw_corrected_documents", f"WITH {_EDITS_SQL} SELECT d.doc_id, CASE WHEN ed.prio = '2-HIGH' AND ed.why = '' THEN '初步设计' ELSE stage END AS stage, CASE WHEN ed.why = '' THEN 4 ELSE 3 END AS revision FROM rd d JOIN ed USING (doc_id)")
def corrected_documents(spark, sf):
    return _corrected(spark, sf)[0].select("doc_id", "stage", "revision")


@query("rvw_refused_corrections", f"WITH {_EDITS_SQL} SELECT edit_id, why FROM ed WHERE why <> '' UNION ALL SELECT edit_id + 1, '文件已被修改，请刷新后再试' FROM ed WHERE prio = '1-URGENT'")
def refused_corrections(spark, sf):
    return _corrected(spark, sf)[4].select("edit_id", "why")


def _decisions(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", F.lit("MA").alias("name"), F.when(F.col("prio") == "5-LOW", " ").otherwise("MN").alias("other"),
                    F.when(F.col("prio") == "1-URGENT", "keep").when(F.col("prio") == "2-HIGH", "drop").otherwise("merge").alias("decision"))


_ALIGNED_SQL = STATE_SQL + """, h AS (SELECT rd.*, doc_id IN (SELECT doc_id FROM rm WHERE name = 'MA') AS has FROM rd),
al AS (SELECT rm.doc_id, CASE WHEN rm.name = 'MA' AND prio IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'MN' ELSE rm.name END AS name, value, has AND prio IN ('3-MEDIUM', '4-NOT SPECIFIED') AS merged FROM rm JOIN h USING (doc_id))"""


@query("rvw_apply_alignment", f"""WITH {_ALIGNED_SQL} SELECT doc_id, name, value, CASE WHEN merged AND name = 'MN' THEN 1 ELSE count(*) END AS n FROM al GROUP BY doc_id, name, value, merged""")
def apply_alignment(spark, sf):
    m = R.apply_alignment(metrics(spark, sf), _decisions(spark, sf))[0]
    return m.groupBy("doc_id", "name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("rvw_alignment_history", f"WITH {_ALIGNED_SQL} SELECT doc_id, 'MA｜MN' AS name, CASE WHEN prio = '1-URGENT' THEN '不合并' ELSE 'MN' END AS after FROM h WHERE has AND prio IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED')")
def alignment_history(spark, sf):
    return R.apply_alignment(metrics(spark, sf), _decisions(spark, sf))[1].select("doc_id", "name", "after")


def _pairs(spark, sf):
    ranked = skew.pinned(Q.docs(spark, sf))
    rows = skew.pinned(Q.metrics(spark, sf, ranked))
    return rows, skew.pinned(C.align_metrics(skew.pinned(N.with_quantity(C.metric_cells(rows)))))


_ALIGN_PAIRS = Q.ALIGN_SQL + """, prs AS (SELECT a.project_key, a.name AS name_a, b.name AS name_b FROM gr a JOIN gr b ON a.project_key = b.project_key AND a.num = b.num AND a.pre = b.pre AND a.name < b.name AND a.name = a.anchor
  WHERE NOT EXISTS (SELECT 1 FROM mc x JOIN mc y ON x.doc_id = y.doc_id WHERE x.project_key = a.project_key AND y.project_key = a.project_key AND x.name = a.name AND y.name = b.name))"""


@query("rvw_alignment_items", f"WITH {_ALIGN_PAIRS} SELECT p.project_key, name_a || '｜' || name_b AS pair, m.name, m.doc_id, m.idx, m.value FROM prs p JOIN mv m ON m.project_key = p.project_key AND m.name IN (name_a, name_b)")
def alignment_items(spark, sf):
    rows, pairs = _pairs(spark, sf)
    return R.alignment_items(pairs, rows).select("project_key", "pair", "name", "doc_id", "idx", "value")


@query("rvw_project_progress", f"""WITH {PENDING_SQL}, pn AS (SELECT project_key, count(*) AS n FROM pend JOIN rd USING (doc_id) GROUP BY 1), tc AS (SELECT project_key, count(*) AS n FROM rd WHERE prio = '1-URGENT' GROUP BY 1)
  SELECT project_key, count(*) AS documents, count(*) FILTER (stage = '建议书/立项') AS stage_0, count(*) FILTER (stage = '可行性研究') AS stage_1, count(*) FILTER (stage = '初步设计') AS stage_2, coalesce(max(pn.n), 0) AS pending, coalesce(max(tc.n), 0) AS touched,
  CASE WHEN max(pn.n) IS NULL THEN '待核对项已处理' WHEN max(tc.n) IS NULL THEN '未开始' ELSE '进行中' END AS status FROM rd LEFT JOIN pn USING (project_key) LEFT JOIN tc USING (project_key) GROUP BY 1""")
def project_progress(spark, sf):
    d = docs(spark, sf)
    history = d.where("prio = '1-URGENT'").select("doc_id", F.lit("fixed").alias("kind"))
    none = d.select("project_key").where(F.lit(False))
    p = R.project_progress(d, items(spark, sf), none, history)
    return p.select("project_key", "documents", "stage_0", "stage_1", "stage_2", "pending", "touched", "status")


@query("rvw_merge_reprocessed", f"""{S} SELECT doc_id, name, CASE WHEN name = '项目名称' OR prio = '5-LOW' THEN value WHEN name = '项目代码' THEN '2024' ELSE 'fresh' END AS value FROM rc JOIN rd USING (doc_id)""")
def merge_reprocessed(spark, sf):
    d, c, m = docs(spark, sf), cells(spark, sf), metrics(spark, sf)
    fresh_docs = d.where("prio <> '5-LOW'").withColumn("stage", F.lit("初步设计"))
    fresh = c.join(fresh_docs.select("doc_id"), "doc_id", "left_semi").withColumn("value", F.when(F.col("name") == "项目代码", "2024").otherwise("fresh")).withColumn("method", F.lit("rule"))
    history = d.where("prio = '1-URGENT'").select("doc_id", F.lit("stage").alias("kind"))
    return R.merge_reprocessed(d.drop("prio", "price"), c, m, history, fresh_docs, fresh, m)[1].select("doc_id", "name", "value")


@query("snk_comparison_relations", f"{S} SELECT 'cells' AS relation, count(*) AS n FROM rc UNION ALL SELECT 'evidence', count(*) FROM rc WHERE value IS NOT NULL UNION ALL SELECT 'pending', (SELECT count(*) FROM rd WHERE prio = '1-URGENT')")
def comparison_relations(spark, sf):
    d = docs(spark, sf)
    e = F.when(F.col("value").isNotNull(), F.array(F.struct(F.lit("p1-l1").alias("id"), F.lit(1).alias("page"), F.lit("q").alias("quote")))).otherwise(F.array())
    c = cells(spark, sf).join(d.select("doc_id", "project_key"), "doc_id").withColumn("evidence", e)
    rel = K.comparison_relations(c, d.where(F.lit(False)), d.where("prio = '1-URGENT'"), d.where(F.lit(False)))
    return K.table_stats({k: rel[k] for k in ("cells", "evidence", "pending")}).withColumnRenamed("table", "relation")
