"""Human review of approval documents and its progress (RVW)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docledger.functions import skew, text as X
from docledger.operators.approval.compare import pair_key
from docledger.operators.approval.fields import FIELDS, REVIEW_STATES, STAGES
from docledger.operators.approval.metrics import mark_conflicts

# ---- fixed values: reasons shown to the reviewer ----
WHY = {"needs_review": "系统给出的是推断值或图形候选，需人工确认", "conflict": "同一文档内出现多个值，需人工选定统计口径",
       "uncertain": "页面不可读，无法证明该要素确实缺失", "unextracted": "原文有该要素的线索，但自动提取未取到"}
WHY_AGENT = "由自检循环补回（采用了放宽的识别办法），可信度低于主干直取，需人工核对"
WHY_STAGE = "请按批复标题确认审批阶段"
WHY_ABSENT = "未检出相关线索，建议抽查原文"
DECIDED_STAGES = STAGES[:4]
NOT_MERGED = "不合并"
CODE = r"^\d{4}-\d{6}-\d{2}-\d{2}-\d{6}$"
SEAL_VALUES = ("有", "无", "无法判断", "")


def _why(state, method):
    out = F.when(F.startswith(X.text(method), F.lit("agent-")), WHY_AGENT)
    for k, v in WHY.items():
        out = out.when(state == k, v)
    return out.otherwise("需人工确认")


def apply_corrections(docs: DataFrame, cells: DataFrame, metrics: DataFrame, lines: DataFrame, edits: DataFrame):
    """Apply human edits (RVW-1). Returns (docs, cells, metrics, history, refused).

    `edits`: edit_id, doc_id, revision, kind (fixed / metric / stage), name, idx, value, metric_name,
    evidence_ids, reason. Of the valid edits of a document the first in edit_id order is taken; the
    others were made against a revision that no longer exists.
    """
    kind, name, value = F.col("kind"), F.col("name"), F.col("value")
    # what an edit says by itself is judged first: the text of a refused edit takes no part in the joins
    own = F.when(F.length(value) > 15000, "字段内容无效").when(F.length(X.text("reason")) > 1000, "说明过长").when(~kind.isin("fixed", "metric", "stage"), "字段类型无效") \
        .when((kind == "stage") & ~value.isin(*STAGES), "审批阶段无效").when((kind == "fixed") & ~name.isin(*FIELDS), "未知字段") \
        .when((kind == "fixed") & (name == "项目代码") & (value != "") & ~value.rlike(CODE), "项目代码须为四位-六位-两位-两位-六位数字") \
        .when((kind == "fixed") & (name == "印章") & ~value.isin(*SEAL_VALUES), "印章值须为有、无或无法判断")
    e = edits.select(*[c for c in edits.columns if c != "value"], F.explode(F.array(X.strip(X.text("value")))).alias("value"))
    e = e.withColumn("_own", own).withColumn("value", F.when(F.col("_own").isNull(), value)).drop("reason") \
        .join(docs.select("doc_id", F.col("revision").alias("_rev"), F.col("stage").alias("_stage")), "doc_id", "left")
    m = metrics.select("doc_id", "idx", F.col("name").alias("_metric"))
    e = e.join(m, ["doc_id", "idx"], "left")
    cited = e.select("edit_id", "doc_id", F.explode("evidence_ids").alias("id")).distinct()
    unknown = cited.join(lines.select("doc_id", "id"), ["doc_id", "id"], "left_anti").select("edit_id").distinct().withColumn("_unknown", F.lit(True))
    e = e.join(unknown, "edit_id", "left")
    new_name = F.coalesce(X.strip(F.col("metric_name")), name)
    why = F.when(F.col("_rev").isNull(), "文件不存在").when(F.col("revision") != F.col("_rev"), "文件已被修改，请刷新后再试") \
        .when(F.col("_own").isNotNull(), F.col("_own")) \
        .when((kind == "metric") & F.col("_metric").isNull(), "指标索引无效").when((kind == "metric") & (F.col("_metric") != name), "指标名称与索引不匹配") \
        .when((kind == "metric") & ((new_name == "") | (F.length(new_name) > 80)), "指标名称无效").when(F.col("_unknown"), "引用证据不在本文件中").otherwise("")
    e = skew.pinned(e.withColumn("why", why).withColumn("_new_name", new_name))
    first = e.where("why = ''").groupBy("doc_id").agg(F.min("edit_id").alias("_first"))
    e = e.join(first, "doc_id", "left").withColumn("why", F.when((F.col("why") == "") & (F.col("edit_id") != F.col("_first")), "文件已被修改，请刷新后再试").otherwise(F.col("why")))
    refused = e.where("why != ''").select("edit_id", "doc_id", "why")
    good = e.where("why = ''")
    state = F.when(F.col("_value") != "", "reviewed").otherwise("missing")

    fixed = good.where("kind = 'fixed'").select("doc_id", "name", F.col("value").alias("_value"))
    c = cells.join(fixed, ["doc_id", "name"], "left")
    hit = F.col("_value").isNotNull()
    c = c.withColumn("_before", F.when(hit, F.col("value"))).withColumn("value", F.when(hit, F.when(F.col("_value") != "", F.col("_value"))).otherwise(F.col("value"))) \
        .withColumn("status", F.when(hit, state).otherwise(F.col("status"))).withColumn("method", F.when(hit, "human").otherwise(F.col("method")))
    fixed_history = c.where(hit).select("doc_id", F.lit("fixed").alias("kind"), "name", F.lit(None).cast("int").alias("idx"), F.col("_before").alias("before"), F.col("_value").alias("after"))
    new_cells = c.select(*cells.columns)

    measured = good.where("kind = 'metric'").select("doc_id", "idx", F.col("value").alias("_value"), "_new_name")
    k = metrics.join(measured, ["doc_id", "idx"], "left")
    k = k.withColumn("_before", F.when(hit, F.col("value"))).withColumn("_old", F.col("name")).withColumn("name", F.when(hit, F.col("_new_name")).otherwise(F.col("name"))) \
        .withColumn("value", F.when(hit, F.when(F.col("_value") != "", F.col("_value"))).otherwise(F.col("value"))) \
        .withColumn("status", F.when(hit, state).otherwise(F.col("status"))).withColumn("method", F.when(hit, "human").otherwise(F.col("method")))
    metric_history = k.where(hit).select("doc_id", F.lit("metric").alias("kind"), F.col("_old").alias("name"), "idx", F.col("_before").alias("before"), F.col("_value").alias("after"))
    touched = measured.select("doc_id").distinct()
    edited = k.select(*metrics.columns)
    new_metrics = edited.join(touched, "doc_id", "left_anti").unionByName(reassess_conflicts(edited.join(touched, "doc_id", "left_semi")))

    stages = good.where("kind = 'stage'").select("doc_id", F.col("value").alias("_value"))
    code = fixed.where("name = '项目代码'").select("doc_id", F.col("_value").alias("_code"))
    title = fixed.where("name = '项目名称'").select("doc_id", F.col("_value").alias("_name"))
    d = docs.join(stages, "doc_id", "left").join(code, "doc_id", "left").join(title, "doc_id", "left") \
        .join(good.select("doc_id", F.lit(1).alias("_bump")), "doc_id", "left")
    stage_history = d.where(hit).select("doc_id", F.lit("stage").alias("kind"), F.lit("审批阶段").alias("name"), F.lit(None).cast("int").alias("idx"), F.col("stage").alias("before"), F.col("_value").alias("after"))
    new = {"stage": F.coalesce("_value", "stage"), "revision": F.col("revision") + F.coalesce("_bump", F.lit(0)),
           "project_key": F.when(F.col("_code").isNull(), F.col("project_key")).when(F.col("_code") != "", F.col("_code")).otherwise(F.concat(F.lit("unassigned:"), "doc_id")),
           "project_name": F.when(F.col("_name").isNull(), F.col("project_name")).when(F.col("_name") != "", F.col("_name")).otherwise(F.col("filename"))}
    new_docs = d.select(*[new[x].alias(x) if x in new else F.col(x) for x in docs.columns])
    return new_docs, new_cells, new_metrics, fixed_history.unionByName(metric_history).unionByName(stage_history), refused


def reassess_conflicts(metrics: DataFrame) -> DataFrame:
    """Set or clear conflicts from the current values; a cleared human value is reviewed, any other to review (RVW-3)."""
    v = F.when(X.text("value") != "", F.col("value"))
    clash = metrics.groupBy("doc_id", "name").agg(F.coalesce(F.min(v) != F.max(v), F.lit(False)).alias("_clash"))
    rows = metrics.join(clash, ["doc_id", "name"])
    status = F.when(F.col("_clash"), "conflict").when(F.col("status") == "conflict", F.when(F.col("method") == "human", "reviewed").otherwise("needs_review")).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*metrics.columns)


def apply_alignment(metrics: DataFrame, decisions: DataFrame):
    """Merge renames a metric and drops equal duplicates, preferring values no human typed; keep only records (RVW-2).

    `decisions`: doc_id, name, other, decision (merge / keep). Returns (metrics, history, refused).
    """
    known = metrics.select("doc_id", "name").distinct().withColumn("_known", F.lit(True))
    d = decisions.withColumn("other", X.strip(X.text("other"))).join(known, ["doc_id", "name"], "left")
    why = F.when(~F.col("decision").isin("merge", "keep"), "对齐处理方式无效（merge 或 keep）").when((F.col("other") == "") | (F.col("other") == F.col("name")), "对方指标名称无效") \
        .when(F.length("other") > 80, "指标名称过长").when(F.col("_known").isNull(), "本文件中不存在该指标").otherwise("")
    d = d.withColumn("why", why)
    good = d.where("why = ''")
    history = good.select("doc_id", F.lit("align").alias("kind"), pair_key(F.col("name"), F.col("other")).alias("name"), F.col("name").alias("before"),
                          F.when(F.col("decision") == "merge", F.col("other")).otherwise(NOT_MERGED).alias("after"))
    merge = good.where("decision = 'merge'").groupBy("doc_id", "name").agg(F.min("other").alias("_other"))
    rows = metrics.join(merge, ["doc_id", "name"], "left").withColumn("name", F.coalesce("_other", "name")).drop("_other")
    # only names that received a merge lose equal duplicates
    target = merge.select("doc_id", F.col("_other").alias("name")).distinct()
    merged = skew.newest(rows.join(target, ["doc_id", "name"], "left_semi"), ["doc_id", "name", "value"], [(F.col("method") == "human").asc(), F.col("idx")])
    kept = rows.join(target, ["doc_id", "name"], "left_anti").unionByName(merged.select(*rows.columns))
    return kept.select(*metrics.columns), history, d.where("why != ''").select("doc_id", "name", "why")


def pending_items(docs: DataFrame, cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """What a human still has to look at (RVW-4): fields, metrics, undetermined stages (order 0 first)."""
    unextracted = (F.col("status") == "missing") & F.coalesce(F.col("reason") == "unextracted", F.lit(False))
    state = F.when(unextracted, "unextracted").otherwise(F.col("status"))
    settled = (X.text("method") == "human") & ~F.col("status").isin(*REVIEW_STATES)
    none = F.lit(None)
    fields = cells.where(~settled & (F.col("status").isin(*REVIEW_STATES) | unextracted)).select(
        "doc_id", F.lit(1).alias("order"), F.lit("fixed").alias("kind"), none.cast("int").alias("idx"), "name", "value", "status", "method", _why(state, F.col("method")).alias("why"))
    v = F.when(X.text("value") != "", F.col("value"))
    clash = metrics.groupBy("doc_id", "name").agg(F.coalesce(F.min(v) != F.max(v), F.lit(False)).alias("_clash"))
    m = metrics.join(clash, ["doc_id", "name"]).withColumn("status", F.when(F.col("_clash"), "conflict").otherwise(F.col("status")))
    m = m.where(F.col("status").isin(*REVIEW_STATES)).select("doc_id", F.lit(2).alias("order"), F.lit("metric").alias("kind"), "idx", "name", "value", "status", "method",
                                                            _why(F.col("status"), F.col("method")).alias("why"))
    s = docs.where(~F.coalesce("stage", F.lit("")).isin(*DECIDED_STAGES)).select(
        "doc_id", F.lit(0).alias("order"), F.lit("stage").alias("kind"), none.cast("int").alias("idx"), F.lit("审批阶段").alias("name"), F.col("stage").alias("value"),
        F.lit("needs_review").alias("status"), none.cast("string").alias("method"), F.lit(WHY_STAGE).alias("why"))
    return s.unionByName(fields).unionByName(m)


def absent_items(cells: DataFrame) -> DataFrame:
    """Empty fields without any cue, for spot checks (RVW-5)."""
    return cells.where((X.text("value") == "") & (F.col("reason") == "absent")).select("doc_id", "name", F.lit(WHY_ABSENT).alias("why"))


def decided_pairs(history: DataFrame, docs: DataFrame) -> DataFrame:
    return history.where("kind = 'align'").join(docs.select("doc_id", "project_key"), "doc_id").select("project_key", F.col("name").alias("pair")).distinct()


def alignment_items(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Holders of each undecided pair (RVW-6): one row per pair and metric. `metrics`: project_key, doc_id, stage, filename, name, idx, value."""
    names = pairs.select("project_key", "pair", F.explode(F.array("name_a", "name_b")).alias("name"))
    return names.join(metrics, ["project_key", "name"]).select("project_key", "pair", "name", "doc_id", "stage", "filename", "idx", "value")


def project_progress(docs: DataFrame, items: DataFrame, pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Pending, touched, status and stage counts per project (RVW-7)."""
    project = docs.select("doc_id", "project_key")
    stages = docs.groupBy("project_key").agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("stage") == s).alias(f"stage_{i}") for i, s in enumerate(STAGES[:3])])

    def per(df, name):
        return df.groupBy("project_key").agg(F.count(F.lit(1)).alias(name))
    fields = per(items.join(project, "doc_id"), "field_pending")
    touched = per(history.where(F.col("kind").isin("fixed", "metric", "stage", "align")).join(project, "doc_id"), "touched")
    out = stages.join(fields, "project_key", "left").join(per(pairs, "alignment_pending"), "project_key", "left").join(touched, "project_key", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("field_pending", "alignment_pending", "touched")})
    pending = F.col("field_pending") + F.col("alignment_pending")
    return out.withColumn("pending", pending).withColumn("status", F.when(pending == 0, "待核对项已处理").when(F.col("touched") == 0, "未开始").otherwise("进行中"))


def merge_reprocessed(docs: DataFrame, cells: DataFrame, metrics: DataFrame, history: DataFrame, fresh_docs: DataFrame, fresh_cells: DataFrame, fresh_metrics: DataFrame):
    """A fresh extraction takes over except where humans worked (RVW-8). Returns (docs, cells, metrics)."""
    redone = fresh_docs.select("doc_id")
    human = cells.where("method = 'human'").join(redone, "doc_id", "left_semi")
    untouched = cells.join(redone, "doc_id", "left_anti")
    new_cells = untouched.unionByName(human).unionByName(fresh_cells.join(human.select("doc_id", "name"), ["doc_id", "name"], "left_anti").select(*cells.columns))
    worked = history.where(F.col("kind").isin("metric", "align")).select("doc_id").distinct()
    replaced = redone.join(worked, "doc_id", "left_anti")
    new_metrics = metrics.join(replaced, "doc_id", "left_anti").unionByName(fresh_metrics.join(replaced, "doc_id", "left_semi").select(*metrics.columns))
    reviewed = history.where("kind = 'stage'").select("doc_id").distinct().withColumn("_kept", F.lit(True))
    f = fresh_docs.select("doc_id", F.col("stage").alias("_stage"))
    code = new_cells.where("name = '项目代码'").select("doc_id", F.col("value").alias("_code"))
    title = new_cells.where("name = '项目名称'").select("doc_id", F.col("value").alias("_name"))
    d = docs.join(f, "doc_id", "left").join(reviewed, "doc_id", "left").join(code, "doc_id", "left").join(title, "doc_id", "left")
    again = F.col("_stage").isNotNull()
    new = {"stage": F.when(again & F.col("_kept").isNull(), F.col("_stage")).otherwise(F.col("stage")), "revision": F.col("revision") + again.cast("int"),
           "project_key": F.when(again, F.coalesce("_code", F.concat(F.lit("unassigned:"), "doc_id"))).otherwise(F.col("project_key")),
           "project_name": F.when(again, F.coalesce("_name", "filename")).otherwise(F.col("project_name"))}
    return d.select(*[new[x].alias(x) if x in new else F.col(x) for x in docs.columns]), new_cells, new_metrics


__all__ = ["absent_items", "alignment_items", "apply_alignment", "apply_corrections", "decided_pairs", "mark_conflicts", "merge_reprocessed", "pending_items", "project_progress", "reassess_conflicts"]
