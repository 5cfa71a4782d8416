"""Queries over approval documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import skew
from docledger.operators.approval import fields as A, lines as L, metrics as M
from docledger.plans import binding as B
from docledger.plans.registry import query

S = "WITH " + B.APPROVAL_SQL


def lines(spark, sf):
    """Lines with offsets, written once for the branches that read them."""
    return L.placed_lines(B.approval_raw_lines(spark, sf))


def documents(spark, sf, of, *beside):
    """What `of` returns for the documents of one row, and for the lines of the longer ones."""
    return L.each_extent(L.documents(B.approval_raw_lines(spark, sf)), of, *beside)


def parts_of(l):
    """Lines, texts and sections: rows of packed documents, each with one column more, or tables written once for the operators that read them."""
    if L.packed(l):
        t = L.document_text(l)
        return l, t, L.sections(t)
    return l, skew.pinned(L.document_text(l)), skew.pinned(L.sections(l))


def sections_alone(spark, sf):
    """Sections for queries that read nothing else of the lines."""
    return L.raw_sections(B.approval_raw_lines(spark, sf))


@query("apr_clean_lines", f"{S} SELECT doc_id, id, page, text FROM lines")
def clean_lines(spark, sf):
    return L.clean_lines(B.approval_raw_lines(spark, sf)).select("doc_id", "id", "page", "text")


@query("apr_line_offsets", f"{S} SELECT doc_id, id, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS \"end\" FROM lines")
def line_offsets(spark, sf):
    return L.line_offsets(L.clean_lines(B.approval_raw_lines(spark, sf))).select("doc_id", "id", "start", "end")


@query("apr_document_text", f"{S} SELECT doc_id, text FROM texts")
def document_text(spark, sf):
    return L.document_text(lines(spark, sf))


@query("apr_evidence", f"""{S}, sp AS (SELECT doc_id, CAST(position('项目代码为' IN text) - 4 AS BIGINT) AS a, CAST(position('。' IN text) + 9 AS BIGINT) AS b FROM texts)
  SELECT s.doc_id, id AS line_id, substr(text, greatest(a - start, 0)::BIGINT + 1, (least(b, end_) - greatest(a, start))::BIGINT) AS quote FROM sp s JOIN lines l ON l.doc_id = s.doc_id AND end_ > a AND start < b""")
def evidence(spark, sf):
    l = lines(spark, sf)
    t = L.document_text(l)
    spans = t.select("doc_id", (F.locate("项目代码为", F.col("text")) - 4).cast("long").alias("start"), (F.locate("。", F.col("text")) + 9).cast("long").alias("end"))
    return L.evidence(spans, l).select("doc_id", "line_id", "quote")


SECTIONS_SQL = B.APPROVAL_SQL + r""", hd AS (SELECT *, regexp_matches(text, '^[一二三四]、') AS head, regexp_extract(text, '^([一二三四]、[^：:。]{2,25})[：:。]', 0) AS t FROM lines),
cr AS (SELECT *, last_value(CASE WHEN head THEN start END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, n) AS hat FROM hd),
secs AS (SELECT doc_id, CAST(hat AS BIGINT) AS heading_start, max(CASE WHEN head THEN CASE WHEN t <> '' THEN regexp_extract(text, '^([一二三四]、[^：:。]{2,25})[：:。]', 1) ELSE text END END) AS heading,
  CAST(max(CASE WHEN head THEN CASE WHEN t <> '' THEN start + length(t) ELSE end_ END END) AS BIGINT) AS start, CAST(max(end_) AS BIGINT) AS end_,
  string_agg(CASE WHEN head THEN CASE WHEN t <> '' THEN substr(text, length(t) + 1) ELSE '' END ELSE text END, '' ORDER BY page, n) AS text FROM cr WHERE hat IS NOT NULL GROUP BY 1, 2)"""


@query("apr_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, heading_start, heading, start, end_ AS \"end\", text FROM secs")
def sections(spark, sf):
    return sections_alone(spark, sf)


_FOUND_SQL = f"""{S}, f AS (SELECT doc_id, text, '标题' AS name, '关于' || seg || '工程' || matter || '的批复' AS value FROM ap JOIN texts USING (doc_id) UNION ALL SELECT doc_id, text, '项目代码', '2024-' || cust || '-04-01-' || cust FROM ap JOIN texts USING (doc_id)
  UNION ALL SELECT doc_id, text, '印发日期', day FROM ap JOIN texts USING (doc_id) UNION ALL SELECT doc_id, text, '建设周期', '24个月' FROM ap JOIN texts USING (doc_id)
  UNION ALL SELECT doc_id, text, '总投资/匡算/估算/概算', '项目投资估算为' || CAST(floor(price) AS BIGINT) || '万元' FROM ap JOIN texts USING (doc_id) WHERE prio <> '3-MEDIUM' UNION ALL SELECT doc_id, text, '资金来源', '建设资金由区财政统筹' FROM ap JOIN texts USING (doc_id) WHERE prio <> '4-NOT SPECIFIED')
  SELECT doc_id, name, value, CAST(position(value IN text) - 1 AS BIGINT) AS start FROM f"""


@query("apr_fixed_fields", _FOUND_SQL)
def fixed_fields(spark, sf):
    return A.fixed_fields(L.document_text(lines(spark, sf))).select("doc_id", "name", "value", "start")


@query("apr_with_evidence", f"SELECT doc_id, name, value AS quoted FROM ({_FOUND_SQL})")
def with_evidence(spark, sf):
    cells = documents(spark, sf, lambda l: L.with_evidence(A.fixed_fields(L.document_text(l)), l, ["doc_id", "name"]))
    return cells.select("doc_id", "name", F.array_join(F.transform("evidence", lambda e: e["quote"]), "").alias("quoted"))


@query("apr_doc_number", f"""{S} SELECT doc_id, text AS value, replace(replace(text, '[', '〔'), ']', '〕') AS normalized, contains(text, '[') AS warned FROM lines WHERE page = 1 AND n = 1""")
def doc_number(spark, sf):
    return A.doc_number(lines(spark, sf)).select("doc_id", "value", "normalized", F.col("warning").isNotNull().alias("warned"))


@query("apr_stage", f"""{S} SELECT doc_id, CASE matter WHEN '项目建议书' THEN '建议书/立项' WHEN '可行性研究报告' THEN '可行性研究' ELSE '初步设计' END AS stage FROM ap""")
def stage(spark, sf):
    f = A.fixed_fields(L.document_text(lines(spark, sf))).where("name = '标题'")
    return f.select("doc_id", A.stage(F.col("value")).alias("stage"))


@query("apr_project_name", f"""{S} SELECT doc_id, seg || '工程' AS value, CAST(position(seg IN text) - 1 AS BIGINT) AS start, 'needs_review' AS status FROM ap JOIN texts USING (doc_id)""")
def project_name(spark, sf):
    f = A.fixed_fields(L.document_text(lines(spark, sf))).where("name = '标题'")
    return A.project_name(f).select("doc_id", "value", "start", "status")


@query("apr_imprint", f"{S} SELECT doc_id, '西湖区建设局' AS value, CAST(position(day || '印发' IN text) - 7 AS BIGINT) AS start FROM ap JOIN texts USING (doc_id)")
def imprint(spark, sf):
    return A.imprint(lines(spark, sf)).select("doc_id", "value", "start")


@query("apr_addressee", f"{S} SELECT doc_id, '西湖区建设局' AS value, CAST(start AS BIGINT) AS start FROM lines WHERE page = 1 AND n = 3")
def addressee(spark, sf):
    return A.addressee(lines(spark, sf)).select("doc_id", "value", "start")


@query("apr_section_fields", f"""WITH {SECTIONS_SQL} SELECT doc_id, '建设内容' AS name, text AS value, start FROM secs WHERE heading LIKE '%建设内容%' AND text <> '' UNION ALL SELECT doc_id, '建设地点', text, start FROM secs WHERE heading LIKE '%建设地点%'""")
def section_fields(spark, sf):
    return A.section_fields(sections_alone(spark, sf)).select("doc_id", "name", "value", "start")


@query("apr_known_metrics", f"""WITH {SECTIONS_SQL} SELECT i.doc_id, '总建筑面积' AS name, q || '平方米' AS value, CASE prio WHEN '2-HIGH' THEN 'design' ELSE 'construction' END AS scope, count(*) AS n
  FROM items i JOIN ap USING (doc_id) WHERE f = 'A' AND prio <> '1-URGENT' GROUP BY 1, 2, 3, 4""")
def known_metrics(spark, sf):
    return M.known_metrics(sections_alone(spark, sf)).groupBy("doc_id", "name", "value", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("apr_open_metrics", f"""WITH {SECTIONS_SQL} SELECT i.doc_id, '号管线长度' AS name, '约' || q || '公里' AS value, count(*) AS n FROM items i JOIN ap USING (doc_id) WHERE f = 'N' AND prio <> '1-URGENT' GROUP BY 1, 2, 3""")
def open_metrics(spark, sf):
    return M.open_metrics(sections_alone(spark, sf)).groupBy("doc_id", "name", "value").agg(F.count(F.lit(1)).alias("n"))


METRICS_SQL = SECTIONS_SQL + """, mt AS (SELECT DISTINCT i.doc_id, CASE f WHEN 'A' THEN '总建筑面积' ELSE '号管线长度' END AS name, CASE f WHEN 'A' THEN q || '平方米' ELSE '约' || q || '公里' END AS value FROM items i JOIN ap USING (doc_id) WHERE f <> 'R' AND prio <> '1-URGENT'),
mt2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id, name) > 1 THEN 'conflict' ELSE 'extracted' END AS status FROM mt)"""


@query("apr_metrics", f"WITH {METRICS_SQL} SELECT doc_id, name, value, status FROM mt2")
def metrics(spark, sf):
    return M.metrics(sections_alone(spark, sf)).select("doc_id", "name", "value", "status")


@query("apr_mark_conflicts", f"WITH {METRICS_SQL} SELECT DISTINCT doc_id, '指标“' || name || '”存在多个值，请核对统计范围。' AS warning FROM mt2 WHERE status = 'conflict'")
def mark_conflicts(spark, sf):
    return M.conflict_warnings(M.metrics(sections_alone(spark, sf)))


CELLS_SQL = METRICS_SQL + """, cl AS (SELECT doc_id, unnest(['发文字号', '标题', '印发机关', '印发日期', '项目名称', '项目代码', '项目单位', '建设地点', '建设周期']) AS name FROM ap UNION ALL SELECT doc_id, '建设内容' FROM ap WHERE prio IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') AND EXISTS (SELECT 1 FROM items i WHERE i.doc_id = ap.doc_id)
  UNION ALL SELECT doc_id, '总投资/匡算/估算/概算' FROM ap WHERE prio <> '3-MEDIUM' UNION ALL SELECT doc_id, '资金来源' FROM ap WHERE prio <> '4-NOT SPECIFIED'),
full_cells AS (SELECT ap.doc_id, f.name, prio, cl.doc_id IS NOT NULL AS has, CASE WHEN cl.doc_id IS NOT NULL THEN NULL WHEN f.name = '总投资/匡算/估算/概算' OR f.name = '资金来源' OR (f.name = '建设内容' AND prio IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) THEN 'unextracted' ELSE 'absent' END AS reason
  FROM ap CROSS JOIN (SELECT unnest(['发文机关标志', '发文字号', '标题', '印章', '印发机关', '印发日期', '项目名称', '项目代码', '项目单位', '建设内容', '建设地点', '总投资/匡算/估算/概算', '资金来源', '建设周期']) AS name) f LEFT JOIN cl ON cl.doc_id = ap.doc_id AND cl.name = f.name)"""


def all_cells(p):
    l, t, s = p
    return A.missing_reason(A.document_cells(l, t, s), t)


@query("apr_missing_reason", f"WITH {CELLS_SQL} SELECT doc_id, name, has, reason FROM full_cells")
def missing_reason(spark, sf):
    cells = documents(spark, sf, lambda l: all_cells(parts_of(l)))
    return cells.select("doc_id", "name", F.col("value").isNotNull().alias("has"), "reason")


@query("apr_quality_summary", f"""WITH {CELLS_SQL} SELECT doc_id, count(*) FILTER (has) AS evidence_fields, count(*) FILTER (has AND name IN ('项目名称', '项目单位')) AS review_fields, count(*) FILTER (reason = 'absent') AS missing_absent,
  count(*) FILTER (reason = 'unextracted') AS missing_unextracted FROM full_cells GROUP BY 1""")
def quality_summary(spark, sf):
    return A.quality_summary(documents(spark, sf, lambda l: all_cells(parts_of(l))))


@query("apr_refine_header_mark", f"""{S} SELECT doc_id, CASE prio WHEN '2-HIGH' THEN '别处局文件' ELSE seg || '局文件' END AS value, CASE prio WHEN '1-URGENT' THEN 'trimmed' WHEN '2-HIGH' THEN 'mismatch' ELSE '' END AS kind FROM ap WHERE length(seg) >= 4""")
def refine_header_mark(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("length(c_mktsegment) >= 4")
    prio, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    mark = F.when(prio == "1-URGENT", F.concat(F.lit("水印"), seg, F.lit("局网"), seg, F.lit("局文件"))).when(prio == "2-HIGH", "别处局文件").otherwise(F.concat(seg, F.lit("局文件")))
    return o.select(F.col("o_orderkey").alias("doc_id"), A.refine_header_mark(mark, F.when(prio != "5-LOW", F.concat(seg, F.lit("局办公室"))).otherwise("")).alias("r")).select("doc_id", "r.value", "r.kind")


ISSUES_SQL = CELLS_SQL + """, issues AS (SELECT ap.doc_id, 'METRIC_EMPTY' AS code, '' AS field FROM ap WHERE prio <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.doc_id = ap.doc_id)
  UNION ALL SELECT doc_id, 'FIELD_EMPTY_HINT', '总投资/匡算/估算/概算' FROM ap WHERE prio = '3-MEDIUM' UNION ALL SELECT doc_id, 'FIELD_EMPTY_HINT', '资金来源' FROM ap WHERE prio = '4-NOT SPECIFIED')"""


def checked(l):
    p = parts_of(l)
    cells = A.document_cells(*p)
    if L.packed(l):
        return p, cells, M.metrics(cells)  # the same rows, cells and metrics side by side
    return p, skew.pinned(cells), skew.pinned(M.metrics(p[2]))


@query("apr_self_check", f"WITH {ISSUES_SQL} SELECT doc_id, code, field FROM issues")
def self_check(spark, sf):
    def of(l):
        (l, t, s), cells, found = checked(l)
        return M.self_check(t, s, cells, found).select("doc_id", "code", "field")
    return documents(spark, sf, of)


@query("apr_widen_metrics", f"""WITH {METRICS_SQL} SELECT DISTINCT i.doc_id, CASE f WHEN 'A' THEN '总建筑面积' ELSE '新建泵站' || s || '号管线长度' END AS name, CASE f WHEN 'A' THEN q || '平方米' ELSE '约' || q || '公里' END AS value
  FROM items i JOIN ap USING (doc_id) WHERE prio = '2-HIGH' AND f <> 'R'""")
def widen_metrics(spark, sf):
    s = skew.pinned(sections_alone(spark, sf))
    return M.widen_metrics(s, s.select("doc_id").distinct(), M.BASELINE_SECTIONS).select("doc_id", "name", "value")


@query("apr_alt_form_metrics", f"""WITH {METRICS_SQL} SELECT DISTINCT i.doc_id, CASE f WHEN 'A' THEN '总建筑面积' WHEN 'N' THEN '号管线长度' ELSE '栽植乔木' END AS name, CASE f WHEN 'A' THEN q || '平方米' WHEN 'N' THEN '约' || q || '公里' ELSE q || '株' END AS value
  FROM items i JOIN ap USING (doc_id) WHERE prio = '2-HIGH' AND f <> 'N'""")
def alt_form_metrics(spark, sf):
    s = skew.pinned(sections_alone(spark, sf))
    gate = s.where("heading LIKE '%工程任务%'").select("doc_id")
    return M.alt_form_metrics(s, gate).select("doc_id", "name", "value")


@query("apr_relaxed_fields", f"""{S} SELECT doc_id, '总投资/匡算/估算/概算' AS name, '投资总概算为' || CAST(floor(price) AS BIGINT) || '万元' AS value FROM ap WHERE prio = '3-MEDIUM' UNION ALL SELECT doc_id, '资金来源', '运营资金全部由区级安排' FROM ap WHERE prio = '4-NOT SPECIFIED'""")
def relaxed_fields(spark, sf):
    def of(l):
        (l, t, s), cells, found = checked(l)
        return M.relaxed_fields(t, cells, t.select("doc_id")).select("doc_id", "name", "value")
    return documents(spark, sf, of)


REPAIR_SQL = ISSUES_SQL + """, em AS (SELECT doc_id, prio, EXISTS (SELECT 1 FROM items i WHERE i.doc_id = ap.doc_id AND f = 'R') AS trees, doc_id IN (SELECT doc_id FROM issues WHERE code = 'METRIC_EMPTY') AS empty FROM ap WHERE doc_id IN (SELECT doc_id FROM issues)),
tr AS (SELECT doc_id, 1 AS step, CASE WHEN empty THEN 'widen_sections' ELSE 'read_section' END AS action FROM em UNION ALL SELECT doc_id, 2, 'alt_form_metrics' FROM em WHERE empty
  UNION ALL SELECT doc_id, 3, CASE WHEN prio IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'read_section' ELSE 'escalate' END FROM em WHERE empty AND (NOT trees OR prio IN ('3-MEDIUM', '4-NOT SPECIFIED'))
  UNION ALL SELECT doc_id, 2, 'escalate' FROM em WHERE NOT empty AND prio = '3-MEDIUM')"""


def _repaired(l):
    (l, t, s), cells, found = checked(l)
    facts = M.check_facts(t, s, cells, found)
    return found, facts, M.repair_rounds(t, s, cells, found, facts)


@query("apr_repair_rounds", f"WITH {REPAIR_SQL} SELECT doc_id, step, action FROM tr WHERE action <> 'escalate' OR step <> 2")
def repair_rounds(spark, sf):
    return documents(spark, sf, lambda l: _repaired(l)[2][2].select("doc_id", "step", "action"))


@query("apr_repair_audit", f"""WITH {REPAIR_SQL}, b AS (SELECT doc_id, count(*) AS n FROM mt GROUP BY 1), i AS (SELECT doc_id, count(*) AS n FROM issues GROUP BY 1), s AS (SELECT doc_id, count(*) FILTER (action <> 'escalate' OR step <> 2) AS n FROM tr GROUP BY 1),
  a AS (SELECT doc_id, count(DISTINCT q) AS n FROM items JOIN em USING (doc_id) WHERE empty AND f = 'R' GROUP BY 1)
  SELECT ap.doc_id, coalesce(i.n, 0) AS silent_issues, coalesce(b.n, 0) AS metrics_before, coalesce(b.n, 0) + coalesce(a.n, 0) AS metrics_after, coalesce(s.n, 0) AS steps,
   CASE WHEN em.empty AND NOT em.trees THEN 'escalated' ELSE 'ok' END AS status, coalesce(a.n, 0) AS gain FROM ap LEFT JOIN i USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN em USING (doc_id)""")
def repair_audit(spark, sf):
    def of(l):
        found, facts, (c, m, trace, outcome, issues) = _repaired(l)
        return M.repair_audit(found, M.issues_of(facts), m, outcome)
    return documents(spark, sf, of)


@query("apr_ground_proposals", f"""{S} SELECT doc_id, name, CASE k WHEN 1 THEN '' WHEN 2 THEN 'value not in evidence' WHEN 3 THEN 'unknown evidence id' WHEN 4 THEN 'protected field' WHEN 5 THEN 'not a quantity' ELSE '' END AS reason FROM ap,
  (VALUES (1, '标题'), (2, '资金来源'), (3, '建设周期'), (4, '项目代码'), (5, '面积'), (6, '工期')) v(k, name)""")
def ground_proposals(spark, sf):
    p = lambda kind, name, value, *ids: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(value).alias("value"), F.array(*[F.lit(i) for i in ids]).alias("evidence_ids"))
    rows = F.array(p("field", "标题", "的批复 西湖区", "p1-l3", "p1-l2"), p("field", "资金来源", "凭空编造", "p3-l3"), p("field", "建设周期", "24个月", "p9-l9"), p("field", "项目代码", "2024", "p1-l4"),
                   p("metric", "面积", "实施周期", "p3-l4"), p("metric", "工期", "24个月", "p3-l4"))
    props = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(rows).alias("p")).select("doc_id", "p.*")
    return documents(spark, sf, lambda l, p: A.ground_proposals(p, l).select("doc_id", "name", "reason"), props)


@query("apr_project_groups", f"""{S} SELECT doc_id, '2024-' || cust || '-04-01-' || cust AS project_key, seg || '工程' AS project_name, CASE matter WHEN '项目建议书' THEN '建议书/立项' WHEN '可行性研究报告' THEN '可行性研究' ELSE '初步设计' END AS stage, day AS issued FROM ap""")
def project_groups(spark, sf):
    def of(l):
        p = parts_of(l)
        cells = A.document_cells(*p)
        docs = cells if L.packed(cells) else p[1]
        return A.project_groups(cells, docs.withColumn("filename", F.concat("doc_id", F.lit(".pdf")))).select("doc_id", "project_key", "project_name", "stage", "issued")
    return documents(spark, sf, of)
