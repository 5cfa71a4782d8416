"""Documents of one row: the operators find in them what they find line by line, and neither shuffle nor join for it."""
import pytest
from pyspark.sql import functions as F

from docledger.operators.approval import fields as A, lines as L, metrics as M
from docledger.plans import approval as P

LETTER = [(1, "发改投资〔2024〕5号"), (1, "关于甲乙工程可行性研究报告 的批复"), (1, "西湖区建设局："), (1, "项目代码为2024-000123-04-01-000123。"), (1, "浙江政务服务网"), (1, "—1—"),
          (2, "一、工程任务和规模"), (2, "总建筑面积50平方米，"), (2, "新建泵站7号管线长度约3公里，总建筑面积60平方米，栽植乔木9株，"), (3, "二、建设地点：位于甲乙。"),
          (3, "三、投资总概算为12万元。运营资金全部由区级安排。"), (3, "四、建设内容：道路。请据此开展工作。"), (3, "西湖区建设局2024年3月5日印发"), (3, "建设单位：甲乙公司，工期为24个月")]
OTHER = [(1, "关于丙工程立项申请的批复"), (1, "丁集团公司："), (2, "一、建设规模：栽植乔木8株"), (2, "区政府办公室"), (3, "项目投资估算为8万元。资金来源为自筹。")]
BARE = [(1, "无")]


def _raw(rows, far=60):
    """Letters of one piece of pages, one with pages far beyond, one of many lines, and one without an id."""
    docs = [(1, LETTER), (2, OTHER), (3, BARE), (4, [(p + far * (p > 1), t) for p, t in LETTER]), (5, LETTER + [(4, f"行{i}") for i in range(30)]), (None, OTHER)]
    return rows("doc_id LONG, page INT, text STRING, bbox ARRAY<DOUBLE>, page_height DOUBLE, method STRING",
                [(d, p, t, [float(i % 2), 100.0 + 20.0 * i, 1.0, 1.0], 2000.0, "text") for d, lines in docs for i, (p, t) in enumerate(lines)][::-1])


def _grouped(l):
    cells = A.document_cells(*P.parts_of(l))
    docs = cells if L.packed(cells) else L.document_text(l)
    return A.project_groups(cells, docs.withColumn("filename", F.concat("doc_id", F.lit(".pdf")))).select("doc_id", "project_key", "project_name", "stage", "issued")


def _checked(take):
    def of(l):
        (lines, texts, sections), cells, found = P.checked(l)
        return take(texts, sections, cells, found)
    return of


def _audit(l):
    found, facts, (_, metrics, _, outcome, _) = P._repaired(l)
    return M.repair_audit(found, M.issues_of(facts), metrics, outcome)


def _left(l):
    return P._repaired(l)[2][4].select("doc_id", "code", "field")


def _evidence(l):
    e = L.with_evidence(A.fixed_fields(L.document_text(l)), l, ["doc_id", "name"])
    return e.select("doc_id", "name", "value", "start", "end", F.to_json("evidence").alias("evidence"))


PLANS = {
    "F1 apr_repair_audit": _audit, "F2 apr_repair_rounds": lambda l: P._repaired(l)[2][2].select("doc_id", "step", "action", "added", "fields", F.array_join("codes", ",").alias("codes")),
    "F3 apr_relaxed_fields": _checked(lambda t, s, c, f: M.relaxed_fields(t, c, t.select("doc_id"))), "F4 apr_self_check": _checked(lambda t, s, c, f: M.self_check(t, s, c, f).select("doc_id", "code", "severity", "field")),
    "F5, F6 apr_missing_reason, apr_quality_summary": lambda l: P.all_cells(P.parts_of(l)), "F7 apr_project_groups": _grouped, "F8 apr_with_evidence": _evidence, "issues after the repair": _left}


def _repairs(l):
    """The audit of each document beside its trace and the issues that are left, as texts."""
    found, facts, (_, metrics, trace, outcome, left) = P._repaired(l)
    texts = [df.select("doc_id", F.to_json(F.struct(*sorted(df.columns))).alias("row")) for df in (M.repair_audit(found, M.issues_of(facts), metrics, outcome), trace, left)]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


@pytest.mark.parametrize("of", [_repairs, PLANS["F4 apr_self_check"], PLANS["F3 apr_relaxed_fields"], PLANS["F5, F6 apr_missing_reason, apr_quality_summary"], _evidence])
def test_packed_documents_give_the_rows_of_their_lines(rows, monkeypatch, of):
    monkeypatch.setattr(L, "LINES_PER_ROW", 20)
    raw = _raw(rows)
    got, want = L.each_extent(L.documents(raw), of), of(L.placed_lines(raw))
    assert got.columns == want.columns
    got, want = got.collect(), want.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.doc_id for r in got}) >= 2


@pytest.mark.parametrize("name", PLANS)
def test_packed_documents_are_neither_shuffled_nor_joined(rows, name):
    docs = L.documents(_raw(rows).where("doc_id < 4")).drop("_piece", "_many")
    plan = PLANS[name](docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Join ", "Aggregate [", "Window ", "Repartition"))


def test_metrics_of_packed_documents(rows):
    docs = L.documents(_raw(rows).where("doc_id < 3")).drop("_piece", "_many")
    found = M.metrics(A.document_cells(*P.parts_of(docs)))
    got = found.select("doc_id", F.posexplode("_metrics").alias("idx", "m"), "_quantities").select("doc_id", "m.*", "idx", F.col("_quantities")[F.col("idx")].alias("q"))
    want = M.metrics(L.sections(L.placed_lines(_raw(rows).where("doc_id < 3"))))
    take = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert take(got) == take(want) and {"conflict", "extracted"} == {r.status for r in got.collect()}


def test_proposals_of_packed_documents(rows):
    raw = _raw(rows)
    p = [(d, "field", "标题", "的批复西湖区", ["p1-l3", "p1-l2"]) for d in (1, 2, 4, 5, 9, None)] + [(1, "field", "标题", "的批复西湖区", ["p1-l3", "p8-l8"]), (1, "field", "资金来源", None, ["p3-l2"]), (1, "metric", "工期", "24个月", None),
         (4, "metric", "工期", "24个月", ["p63-l5"]), (1, "metric", "工期", "24", ["p3-l5"]), (1, "field", "印章", "甲", ["p1-l1"]), (1, "metric", "工期", "", ["p3-l5"])]
    props = rows("doc_id LONG, kind STRING, name STRING, value STRING, evidence_ids ARRAY<STRING>", p)
    got = L.each_extent(L.documents(raw), lambda l, p: A.ground_proposals(p, l), props)
    want = A.ground_proposals(props, L.placed_lines(raw))
    take = lambda df: sorted(map(str, df.collect()))
    assert take(got) == take(want) and got.count() == len(p) and got.where("accepted").count() >= 3
    packed = A.ground_proposals(props, L.documents(raw.where("doc_id < 4")).drop("_piece", "_many"))
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
