"""Steps that meet their rows once: corrections, quantity keys, metric differences, metric cells, repair checks."""
from pyspark.sql import functions as F

from docledger.functions import quantity as Q
from docledger.operators import evaluate as E
from docledger.operators.approval import compare as C, metrics as M, progress as R


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_a_refused_edit_takes_no_part_in_the_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "K", 3, "初步设计", "n", "f"), (2, "K", 3, "初步设计", "n", "f")], "doc_id long, project_key string, revision int, stage string, project_name string, filename string")
    cells = spark.createDataFrame([(1, "标题", "a", "extracted", "rule"), (2, "标题", "b", "extracted", "rule")], "doc_id long, name string, value string, status string, method string")
    metrics = spark.createDataFrame([(1, 0, "长", "1米", "extracted", "rule")], "doc_id long, idx long, name string, value string, status string, method string")
    lines = spark.createDataFrame([(1, "p1-l1")], "doc_id long, id string")
    edits = spark.createDataFrame(
        [(11, 1, 3, "fixed", "标题", None, "x" * 15001, None, [], ""), (12, 1, 3, "fixed", "标题", None, " 新 ", None, [], ""), (13, 9, 3, "fixed", "标题", None, "y" * 15001, None, [], ""),
         (14, 2, 2, "stage", "", None, "z" * 15001, None, [], ""), (15, 2, 3, "fixed", "项目代码", None, "2024-1", None, [], "")],
        "edit_id long, doc_id long, revision int, kind string, name string, idx long, value string, metric_name string, evidence_ids array<string>, reason string")
    written, pinned = [], R.skew.pinned

    def spy(df, by=None):
        written.append(pinned(df, by))
        return written[-1]
    monkeypatch.setattr(R.skew, "pinned", spy)
    _, new_cells, _, _, refused = R.apply_corrections(docs, cells, metrics, lines, edits)
    assert {(r.edit_id, r.why) for r in refused.collect()} == {
        (11, "字段内容无效"), (13, "文件不存在"), (14, "文件已被修改，请刷新后再试"), (15, "项目代码须为四位-六位-两位-两位-六位数字")}
    assert {(r.doc_id, r.value) for r in new_cells.collect()} == {(1, "新"), (2, "b")}
    assert written[0].agg(F.sum(F.length("value"))).first()[0] == 1


def test_quantity_key_parses_a_text_once(spark):
    rows = spark.createDataFrame([("约5公里",), ("none",), ("3公里-2公里",), ("2公里-3000米",)], "raw string")
    keys = rows.select(F.explode(F.array(Q.quantity_key(Q.quantity(F.col("raw"))))).alias("k")).where("k IS NOT NULL").select("k.*")
    assert _plan(keys).count("regexp_extract(") == 1
    assert {(float(r.number), r.upper and float(r.upper), r.unit, r.qualifier) for r in keys.collect()} == {(5000.0, None, "米", "约"), (2000.0, 3000.0, "米", "")}


def test_metric_differences_meet_once(spark):
    shape = "filename string, name string, value string"
    gold = spark.createDataFrame([("a", "n", "1米"), ("a", "n", "1 米"), ("b", "n", "2米"), (None, "n", "3米"), ("c", "n", None)], shape)
    found = spark.createDataFrame([("a", "n", "1 米"), ("d", "n", "4米"), ("d", "n", "4米"), (None, "n", "3米")], shape)
    out = E.metric_differences(gold, found)
    assert "Join" not in _plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("b", "n", "2米", "missing"), (None, "n", "3米", "missing"), ("c", "n", None, "missing"), ("d", "n", "4米", "extra"), (None, "n", "3米", "extra")], key=str)


def test_metric_cells_are_one_aggregate(spark):
    rows = spark.createDataFrame(
        [("K", "m", 1, 1, 200_005, "2米", "reviewed"), ("K", "m", 1, 1, 7, "1米", "reviewed"), ("K", "m", 2, 2, 1, "3米", "extracted"), ("K", "e", 1, 1, 2, "4米", "reviewed"), ("K", "e", 1, 1, 1, "4米", "reviewed"),
         (None, "m", 3, 1, 1, "5米", "extracted"), (None, "m", 3, 1, 2, "6米", "extracted"), ("K", "z", 3, 3, 1, None, "reviewed"), ("K", "z", 3, 3, 2, "7米", "reviewed")],
        "project_key string, name string, doc_id long, doc_rank long, idx long, value string, status string")
    out = C.metric_cells(rows)
    assert "Join" not in _plan(out)
    assert {(r.project_key, r.name, r.doc_id, r.value, r.status) for r in out.collect()} == {
        ("K", "m", 1, "1米；2米", "conflict"), ("K", "m", 2, "3米", "extracted"), ("K", "e", 1, "4米；4米", "reviewed"), (None, "m", 3, None, "conflict"), ("K", "z", 3, "；7米", "conflict")}


def test_deltas_of_one_and_of_several_pieces_agree(spark):
    cells = [("K", "m", d, d, f"{d * d}米", "extracted") for d in range(1, 6)]
    shape = "project_key string, name string, doc_id long, doc_rank long, value string, status string"
    docs = spark.createDataFrame([("K", d, "初步设计") for d in range(1, 6)] + [("L", 200_001, "初步设计"), ("L", 200_002, "初步设计")], "project_key string, doc_id long, stage string")
    statuses = spark.createDataFrame([("K", "m", True), ("L", "m", True)], "project_key string, name string, comparable boolean")
    far = [("L", "m", 200_001, 99_999, "1米", "extracted"), ("L", "m", 200_002, 100_000, "9米", "extracted")]
    short, long = (C.metric_deltas(spark.createDataFrame(rows, shape), statuses, docs) for rows in (cells, cells + far))
    take = lambda df: sorted((r.project_key, r.doc_rank, float(r.delta)) for r in df.collect())
    assert take(short) == [("K", 2, 3.0), ("K", 3, 5.0), ("K", 4, 7.0), ("K", 5, 9.0)]
    assert take(long) == take(short) + [("L", 100_000, 8.0)]


def test_issues_read_off_the_facts(spark):
    texts = spark.createDataFrame([(1, "总投资为5万元。"), (2, "工期为3个月。"), (3, "无")], "doc_id long, text string")
    sections = spark.createDataFrame([(1, 0, "一、建设规模", 0, 9, "x"), (2, 0, "一、建设规模", 0, 9, "x"), (3, 0, "一、其他", 0, 1, "x")], "doc_id long, heading_start long, heading string, start long, end long, text string")
    cells = spark.createDataFrame([(2, "建设周期", "3个月")], "doc_id long, name string, value string")
    found = spark.createDataFrame([(2, "长", "多米")], "doc_id long, name string, value string")
    issues = M.issues_of(M.check_facts(texts, sections, cells, found))
    columns = ["doc_id", "code", "severity", "field"]
    want = M.self_check(texts, sections, cells, found).select(*columns)
    assert sorted(map(tuple, issues.select(*columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 3


def test_relaxed_patterns_search_a_text_once(spark):
    texts = spark.createDataFrame([(1, "前投资总概算为5万元。运营资金全部由区级安排。"), (2, "无")], "doc_id long, text string")
    cells = spark.createDataFrame([], "doc_id long, name string, value string")
    out = M.relaxed_fields(texts, cells, texts.select("doc_id"))
    assert _plan(out).count("regexp_extract(text") == len(M.RELAXED_FIELDS)
    assert {(r.name, r.value, r.start, r.end) for r in out.collect()} == {(M.INVESTMENT, "投资总概算为5万元", 1, 10), (M.FUNDING, "运营资金全部由区级安排", 11, 22)}
