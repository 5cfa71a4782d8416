"""Approval documents: each text is searched once by each pattern, lines meet once, long documents keep their sections."""
from pyspark.sql import functions as F

from docledger.operators.approval import fields as A, lines as L


def _lines(rows, *pages):
    """Lines (doc_id, page, n, text, start, end, bbox) of (doc_id, page, text) in reading order."""
    out, at, n = [], {}, {}
    for doc, page, text in pages:
        n[doc, page] = n.get((doc, page), 0) + 1
        start = at.get(doc, 0)
        at[doc] = start + len(text)
        out.append((doc, page, n[doc, page], f"p{page}-l{n[doc, page]}", text, start, at[doc], [0.0, 20.0 * n[doc, page], 1.0, 1.0], 800.0))
    return rows("doc_id LONG, page INT, n INT, id STRING, text STRING, start LONG, `end` LONG, bbox ARRAY<DOUBLE>, page_height DOUBLE", out)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_of_short_and_long_documents(rows):
    one = ("前言", "一、建设内容：道路", "长5米", "二、无冒号标题", "正文")
    pages = [(1, 1, t) for t in one] + [(2, p, t) for p, t in zip((1, 1, 60, 120, 120), one)] + [(3, 1, "没有标题"), (None, 1, "一、建设内容：无号")]
    got = sorted(tuple(r) for r in L.sections(_lines(rows, *pages)).select("doc_id", "heading_start", "heading", "start", "end", "text").collect())
    want = [(2, "一、建设内容", 9, 14, "道路长5米"), (14, "二、无冒号标题", 21, 23, "正文")]
    assert got == [(d, *w) for d in (1, 2) for w in want]


def test_sections_shuffle_short_documents_once(rows):
    l = _lines(rows, (1, 1, "一、建设内容：道路"), (1, 2, "长5米"))
    assert _plan(L.sections(l)).count("Aggregate [") == 1
    assert _plan(L.document_text(l)).count("Aggregate [") == 1


def test_each_pattern_searches_a_text_once(rows):
    texts = rows("doc_id LONG, text STRING", [(1, "关于甲乙丙工程初步设计的批复"), (2, None)])
    found = A.fixed_fields(texts)
    assert [tuple(r) for r in found.select("name", "value", "start", "end").collect()] == [("标题", "关于甲乙丙工程初步设计的批复", 0, 14)]
    assert _plan(found).count("regexp_extract(text") == len(A.FIXED_PATTERNS)


def test_missing_reason_keeps_repeated_and_empty_cells(rows):
    texts = rows("doc_id LONG, text STRING", [(1, "建设周期与资金来源另定"), (2, None)])
    cells = rows("doc_id LONG, name STRING, value STRING, start LONG, `end` LONG, status STRING, method STRING", [
        (1, "标题", "甲", 0, 1, "extracted", "rule"), (1, "标题", "乙", 1, 2, "extracted", "rule"), (1, "资金来源", None, None, None, "missing", "rule")])
    out = A.missing_reason(cells, texts)
    assert out.columns == ["doc_id", "name", "value", "start", "end", "status", "method", "reason"]
    got = {(r.doc_id, r.name, r.value): r.reason for r in out.collect()}
    assert len(got) == 15 + 14
    assert got[1, "标题", "甲"] is None and got[1, "标题", "乙"] is None
    assert got[1, "资金来源", None] == got[1, "建设周期", None] == "unextracted" and got[1, "印章", None] == got[2, "标题", None] == "absent"


def test_evidence_of_a_cell_over_many_lines_and_of_none(rows):
    l = _lines(rows, *[(1, 1 + i // 40, f"行{i:04d}") for i in range(1500)])
    cells = rows("doc_id LONG, name STRING, start LONG, `end` LONG", [(1, "all", 0, 7500), (1, "none", None, None), (None, "x", 0, 5)])
    got = {(r.doc_id, r.name): r.quoted for r in L.with_evidence(cells, l, ["doc_id", "name"]).select("doc_id", "name", F.array_join(F.transform("evidence", lambda e: e["quote"]), "").alias("quoted")).collect()}
    assert got == {(1, "all"): "".join(f"行{i:04d}" for i in range(1500)), (1, "none"): None, (None, "x"): None}


def test_proposals_join_lines_once(rows):
    l = _lines(rows, (1, 1, "甲乙"), (1, 2, "24个月"))
    p = rows("doc_id LONG, kind STRING, name STRING, value STRING, evidence_ids ARRAY<STRING>", [(1, "metric", "工期", "乙24", ["p2-l1", "p1-l1"]), (1, "field", "标题", "甲乙", ["p1-l1", "p9-l9"])])
    out = A.ground_proposals(p, l)
    assert {r.name: r.reason for r in out.collect()} == {"工期": "not a quantity", "标题": "unknown evidence id"}
    assert _plan(out).count("Join ") == 2


def _raw(rows, *pages):
    """Raw lines (doc_id, page, text) one below the other, in no order."""
    return rows("doc_id LONG, page INT, text STRING, bbox ARRAY<DOUBLE>, page_height DOUBLE, method STRING",
                [(d, p, t, [0.0, 100.0 + 20.0 * i, 1.0, 1.0], 8000.0, "text") for i, (d, p, t) in enumerate(pages)][::-1])


def test_raw_lines_meet_once_on_the_way_to_sections(rows, monkeypatch):
    one = ("前言", "一、建设内容：道 路", "长5米", "浙江政务服务网", "二、无冒号标题", "正文", "—1—")
    spread = [(2, p, t) for p, t in zip((1, 1, 60, 60, 120, 320, 320), one)]
    alone = [(4, 70, "一、建设规模：甲"), (4, 130, "乙"), (4, 190, "丙"), (4, 191, "二、其他"), (5, 80, "没有"), (5, 140, "标题")]
    for pages in ([(1, 1, t) for t in one] + [(3, 1, "没有标题"), (None, 1, "一、建设内容：无号")], spread + alone + [(1, 1, t) for t in one]):
        raw = _raw(rows, *pages)
        written, pinned = [], L.skew.pinned
        monkeypatch.setattr(L.skew, "pinned", lambda df, by=None: written.append(df) or pinned(df, by))  # noqa: B023
        got = L.raw_sections(raw)
        assert _plan(written[0]).count("Aggregate [") == 1 and "Window" not in _plan(written[0]) and "Join" not in _plan(written[0])
        monkeypatch.undo()
        want = L.sections(L.placed_lines(raw))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 2
