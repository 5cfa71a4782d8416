"""Comparison of one project's documents across stages (CMP).

Everything is long-form: `cells` (project_key, doc_id, doc_rank, name, value, status, reason) and
`metric_cells` (only present cells; a cell that is not there is missing). The number of documents of
a project stands beside them, so no project x name grid is ever built.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.functions import quantity as Q, skew, text as X
from docledger.operators.approval.fields import INVESTMENT, PERIOD, REVIEW_STATES, STAGES
from docledger.operators.approval.metrics import KNOWN_METRICS
from docledger.operators.library import mapped

KEY = ["project_key", "name"]


def stage_rank(stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == s, F.lit(i)) for i, s in enumerate(STAGES)], F.lit(len(STAGES) - 1))


def date_number(value: Column) -> Column:
    """YYYYMMDD of a written date, 0 without one."""
    p = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    parts = [F.coalesce(F.regexp_extract(X.text(value), p, i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    return parts[0] * 10000 + parts[1] * 100 + parts[2]


def order_stages(docs: DataFrame) -> DataFrame:
    """Add doc_rank: stage, issue date, file name (CMP-1). `docs`: project_key, doc_id, stage, issued, filename."""
    rows = docs.withColumn("_r", stage_rank(F.col("stage"))).withColumn("_d", date_number(F.col("issued")))
    piece = F.col("_r") * 10000 + F.floor(F.col("_d") / 10000)
    return skew.numbered(rows, ["project_key"], [F.col("_r"), F.col("_d"), F.col("filename"), F.col("doc_id")], piece, "doc_rank").drop("_r", "_d")


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("project_key").agg(F.count(F.lit(1)).alias("n_docs"))


def norm(value: Column) -> Column:
    """Format-free form of a value."""
    return F.replace(F.translate(X.without_space(X.text(value)), "〔〕，", "[],"), F.lit("。"), F.lit(""))


def _value_aggregates() -> dict[str, Column]:
    v = F.when(X.text("value") != "", F.col("value"))
    return {"_cells": F.count(F.lit(1)), "_present": F.count(v), "_min": F.min(v), "_max": F.max(v), "_norm_min": F.min(F.when(v.isNotNull(), norm(v))),
            "_norm_max": F.max(F.when(v.isNotNull(), norm(v))), "_review": F.bool_or(F.col("status").isin(*REVIEW_STATES)),
            "_blank": F.count_if(F.col("value") == ""), "_lost": F.bool_or(F.coalesce(F.col("reason") == "unextracted", F.lit(False)))}


def _status(total: Column) -> Column:
    """review > missing / unextracted > same > equivalent > different."""
    one = (F.col("_present") == 0) | (F.col("_min") == F.col("_max"))
    whole = F.col("_present") == total
    nothing = (F.col("_present") == 0) & ((F.col("_blank") == 0) | (F.col("_blank") == total))
    return F.when(F.col("_review"), "review").when(~whole & one, F.when(F.col("_lost"), "unextracted").otherwise("missing")) \
        .when((whole & one) | nothing, "same").when((F.col("_norm_min") == F.col("_norm_max")), "equivalent").otherwise("different")


def compare_fixed(cells: DataFrame) -> DataFrame:
    """Status of every fixed field over all documents of a project (CMP-2)."""
    return cells.groupBy(*KEY).agg(*[c.alias(n) for n, c in _value_aggregates().items()]).select(*KEY, F.col("_cells").alias("n_docs"), _status(F.col("_cells")).alias("status"))


def basis(value: Column) -> Column:
    """Estimate basis named in an investment value."""
    return X.first_filled(F.regexp_extract(X.text(value), "匡算|估算|概算", 0), F.lit("总投资"))


def _rounding_note(shown: Column) -> Column:
    spread = F.col("_q_max") - F.col("_q_min")
    return F.concat(F.lit("各阶段写法精度不同（"), shown, F.lit("），极差 "), Q.plain(spread), F.col("_u_min"), F.lit(" 属书写精度或约数范围，未认定为内容变化。"))


def _written(rows: DataFrame) -> DataFrame:
    """Distinct written values of a group in document order, joined: project_key, name, _shown."""
    first = rows.where(X.text("value") != "").groupBy(*KEY, "value").agg(F.min("doc_rank").alias("_o"))
    return skew.joined(first, KEY, [F.col("_o"), F.col("value")], skew.piece_of("_o"), "value", " 与 ", "_shown")


def fixed_quantity_notes(cells: DataFrame) -> DataFrame:
    """Fixed fields with quantities read as quantities: equal or rounded values are equivalent, and a
    changed estimate basis is noted (CMP-3). Refines compare_fixed; returns every fixed field."""
    rows = Q.with_quantity(cells).withColumn("_basis", basis(F.col("value")))
    key = Q.quantity_key(F.col("q"))
    aggs = {**_value_aggregates(), **Q.rounding_aggregates()}
    g = rows.groupBy(*KEY).agg(*[c.alias(n) for n, c in aggs.items()], F.count("q").alias("_q_n"), F.min(key).alias("_k_min"), F.max(key).alias("_k_max"),
                               F.min("_basis").alias("_b_min"), F.max("_basis").alias("_b_max"))
    g = g.withColumn("status", _status(F.col("_cells")))
    measured = F.col("name").isin(PERIOD, INVESTMENT) & ~F.col("status").isin("review", "missing", "unextracted")
    one_basis = (F.col("name") == PERIOD) | (F.col("_b_min") == F.col("_b_max"))
    equal = measured & (F.col("_q_n") == F.col("_cells")) & (F.col("_k_min") == F.col("_k_max")) & one_basis & (F.col("_min") != F.col("_max"))
    g = g.withColumn("status", F.when(equal, "equivalent").otherwise(F.col("status")))
    rounded = measured & (F.col("status") == "different") & one_basis & Q.rounding_equivalent()
    g = g.withColumn("_rounded", rounded).withColumn("status", F.when(F.col("_rounded"), "equivalent").otherwise(F.col("status"))) \
        .withColumn("_bases", measured & (F.col("name") == INVESTMENT) & (F.col("_b_min") != F.col("_b_max")))
    shown = _written(rows.join(g.where("_rounded").select(*KEY), KEY, "left_semi"))
    steps = skew.joined(rows.join(g.where("_bases").select(*KEY), KEY, "left_semi"), KEY, [F.col("doc_rank")], skew.piece_of("doc_rank"), "_basis", " → ", "_steps")
    out = g.join(shown, KEY, "left").join(steps, KEY, "left")
    note = F.when(F.col("_bases"), F.concat(F.lit("投资口径："), "_steps", F.lit("；阶段金额变化不直接认定为异常。"))).when(F.col("_rounded"), _rounding_note(F.col("_shown"))).otherwise("")
    return out.select(*KEY, F.col("_cells").alias("n_docs"), "status", note.alias("note"))


def metric_cells(metrics: DataFrame) -> DataFrame:
    """One cell per (project, name, document): several hits are joined and marked (CMP-4).

    `metrics`: project_key, doc_id, doc_rank, name, idx, value, status. Missing cells are not materialised.
    """
    key = ["project_key", "name", "doc_id", "doc_rank"]
    # one aggregate: the hits of a cell end as one text of one row in any case
    out = metrics.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.min("status").alias("_status"),
                                    F.bool_and(F.coalesce(F.col("status") == "reviewed", F.lit(False))).alias("_reviewed"), F.count_if(F.col("value").isNull()).alias("_null"),
                                    F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), X.text("value").alias("t")))).alias("_l"))
    named = F.col("project_key").isNotNull() & F.col("name").isNotNull() & F.col("doc_id").isNotNull() & F.col("doc_rank").isNotNull()
    text = F.when(named, F.array_join(F.transform("_l", lambda h: h["t"]), "；"))
    clash = (F.col("_min") != F.col("_max")) | ((F.col("_null") > 0) & (F.col("_null") < F.col("_n")))
    return out.select(*key, F.when(F.col("_n") > 1, text).otherwise(F.col("_min")).alias("value"),
                      F.when(F.col("_n") == 1, F.col("_status")).when(F.coalesce(clash, F.lit(False)), "conflict").when(F.col("_reviewed"), "reviewed").otherwise("needs_review").alias("status"))


def metric_priority(name: Column) -> Column:
    """Known metrics first, in their fixed order."""
    return F.coalesce(*[F.when(name == n, F.lit(i)) for i, (n, _) in enumerate(KNOWN_METRICS)], F.lit(len(KNOWN_METRICS)))


def metric_status(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Status per metric of a project, exact and rounded quantities counting as equivalent (CMP-5).

    `cells` from metric_cells, `counts` from doc_counts. Adds note_kind: rounding or ''.
    """
    rows = Q.with_quantity(cells).withColumn("reason", F.lit(None).cast("string"))
    key = Q.quantity_key(F.col("q"))
    has = F.col("q").isNotNull()
    rounding = {n: (F.count_if(has) if n == "_q_rows" else c) for n, c in Q.rounding_aggregates().items()}
    bounded = F.bool_and(F.when(has, F.col("q.upper").isNull() & ~F.col("q.qualifier").rlike(Q.BOUNDS) & ~F.startswith(F.col("q.dimension"), F.lit("count:")) & F.col("tolerance").isNotNull()))
    rounding["_q_ok"] = F.coalesce(bounded, F.lit(False))
    rounding["_q_tol"] = F.max(F.when(has, F.col("tolerance")))
    g = rows.groupBy(*KEY).agg(*[c.alias(n) for n, c in {**_value_aggregates(), **rounding}.items()], F.min(key).alias("_k_min"), F.max(key).alias("_k_max"),
                               F.bool_or(F.col("q.upper").isNotNull()).alias("_ranges"))
    g = g.join(counts, "project_key")
    g = g.withColumn("status", _status(F.col("n_docs")))
    enough = (F.col("_q_rows") > 1) & ~F.col("status").isin("review", "unextracted")
    varied = (F.col("_min") != F.col("_max")) | (F.col("_present") < F.col("n_docs"))
    full = F.col("_q_rows") == F.col("n_docs")
    equal = enough & (F.col("_k_min") == F.col("_k_max")) & varied
    rounded = enough & ~equal & Q.rounding_equivalent()
    g = g.withColumn("_equal", F.coalesce(equal, F.lit(False))).withColumn("_rounded", F.coalesce(rounded, F.lit(False)))
    status = F.when(F.col("_equal") | F.col("_rounded"), F.when(full, "equivalent").otherwise("missing")).otherwise(F.col("status"))
    comparable = enough & ~F.col("_rounded") & (F.col("_u_min") == F.col("_u_max")) & ~F.coalesce("_ranges", F.lit(False))
    return g.select(*KEY, metric_priority(F.col("name")).alias("priority"), "n_docs", F.col("_present").alias("n_present"), status.alias("status"),
                    F.when(F.col("_rounded"), "rounding").otherwise("").alias("note_kind"), F.coalesce(comparable, F.lit(False)).alias("comparable"))


def _stated_before(rows: DataFrame, cells: DataFrame, own: Column) -> DataFrame:
    """Add `own` of the preceding document that states the metric. Projects of one piece of documents need no totals across pieces."""
    piece = skew.piece_of("doc_rank")
    if cells.where((piece != 0) | F.col("project_key").isNull() | F.col("name").isNull()).head(1):
        return skew.previous(rows, KEY, "doc_rank", piece, own, "_prev")
    return rows.withColumn("_prev", F.lag(own).over(W.partitionBy(*KEY).orderBy("doc_rank")))


def metric_deltas(cells: DataFrame, statuses: DataFrame, docs: DataFrame) -> DataFrame:
    """Differences between consecutive documents that state a metric (CMP-6): one row per changed step.

    Only metrics in one unit without ranges whose values are not all one written precision.
    """
    rows = Q.with_quantity(cells).where("q IS NOT NULL").select(*KEY, "doc_id", "doc_rank", "q", "tolerance")
    # documents first: the rows then stay where the statuses of their metric are
    rows = rows.join(docs.select("project_key", "doc_id", "stage"), ["project_key", "doc_id"]).join(statuses.where("comparable").select(*KEY), KEY, "left_semi")
    rows = _stated_before(rows, cells, F.struct("q", "tolerance", "stage")).where("_prev IS NOT NULL")
    a, b = F.col("_prev.q.number"), F.col("q.number")
    rows = rows.where(a != b).withColumn("delta", (b - a).cast("decimal(38,12)"))
    loose = lambda q, t: q["qualifier"].rlike(Q.BOUNDS) | F.startswith(q["dimension"], F.lit("count:")) | t.isNull()
    rounding = ~loose(F.col("_prev.q"), F.col("_prev.tolerance")) & ~loose(F.col("q"), F.col("tolerance")) \
        & (F.col("_prev.q.dimension") == F.col("q.dimension")) & (F.abs("delta") <= F.greatest(F.col("_prev.tolerance"), F.col("tolerance")))
    pct = F.when(a != 0, (F.col("delta") * 100 / a).cast("decimal(30,12)"))
    step = F.concat("_prev.stage", F.lit("→"), "stage", F.lit("："), Q.signed(F.col("delta")), "q.unit")
    ratio = F.when(pct.isNull(), "").when(F.abs(pct) < F.lit("0.005").cast("decimal(4,3)"), "（变动比例小于0.01%）").otherwise(F.concat(F.lit("（"), F.when(pct > 0, "+").otherwise(""), F.bround(pct, 2).cast("decimal(30,2)").cast("string"), F.lit("%）")))
    qualified = (F.col("_prev.q.qualifier") != "") | (F.col("q.qualifier") != "")
    note = F.when(rounding, F.concat(step, F.lit("（差异属书写精度或约数范围，未认定为变化）"))).otherwise(
        F.concat(step, ratio, F.when(qualified, "，含约数/限定").otherwise("")))
    return rows.select(*KEY, "doc_rank", F.col("_prev.stage").alias("stage_from"), F.col("stage").alias("stage_to"), "delta", pct.cast("double").alias("percent"), rounding.alias("rounding"), note.alias("note"))


def metric_notes(cells: DataFrame, statuses: DataFrame, deltas: DataFrame) -> DataFrame:
    """The note of each metric row: its steps, or the written values of one precision (CMP-5, CMP-6)."""
    steps = skew.joined(deltas, KEY, [F.col("doc_rank")], skew.piece_of("doc_rank"), "note", "；", "_steps")
    rounded = Q.with_quantity(cells).join(statuses.where("note_kind = 'rounding'").select(*KEY), KEY, "left_semi").where("q IS NOT NULL")
    spread = rounded.groupBy(*KEY).agg(F.min("q.number").alias("_q_min"), F.max("q.number").alias("_q_max"), F.min("q.unit").alias("_u_min"))
    spread = spread.join(_written(rounded), KEY, "left").select(*KEY, _rounding_note(F.col("_shown")).alias("_rounding"))
    return statuses.join(steps, KEY, "left").join(spread, KEY, "left").withColumn("note", F.coalesce("_rounding", "_steps", F.lit(""))).drop("_steps", "_rounding")


def alignment_groups(cells: DataFrame) -> DataFrame:
    """Metric names of a project that state the same quantity (CMP-7): project_key, quantity, name, value, group_size, anchor.

    A name counts when all its quantities agree; the anchor is the first name of its group.
    """
    rows = Q.with_quantity(cells).where("q IS NOT NULL").withColumn("k", Q.quantity_key(F.col("q")))
    one = rows.groupBy(*KEY).agg(F.min("k").alias("k"), F.max("k").alias("_k"), F.min_by("value", "doc_rank").alias("value")).where("k = _k").drop("_k")
    one = one.withColumn("quantity", F.concat_ws("|", Q.plain(F.col("k.number")), F.coalesce(Q.plain(F.col("k.upper")), F.lit("")), F.col("k.unit"), F.col("k.qualifier"))).drop("k")
    size = one.groupBy("project_key", "quantity").agg(F.count(F.lit(1)).alias("group_size"), F.min("name").alias("anchor")).where("group_size > 1")
    return one.join(size, ["project_key", "quantity"])


def pair_key(a: Column, b: Column) -> Column:
    """Order-free key of two names."""
    return F.concat(F.least(a, b), F.lit("｜"), F.greatest(a, b))


def alignment_links(cells: DataFrame) -> DataFrame:
    """Every name of a group but the anchor, linked with it: name_a (the anchor), name_b, value, quantity, pair, overlap.

    One row per name at every size of a group. `overlap` says whether one document states both names; it is
    tested by joins on (name, document), so no document set is collected.
    """
    groups = skew.pinned(alignment_groups(cells))  # read for the anchors and for the other names
    first = groups.where("name = anchor").select("project_key", "quantity", F.col("name").alias("name_a"), "value")
    links = groups.where("name <> anchor").select("project_key", "quantity", F.col("name").alias("name_b")).join(first, ["project_key", "quantity"]) \
        .withColumn("pair", pair_key(F.col("name_a"), F.col("name_b")))
    stated = cells.where(X.text("value") != "").select("project_key", "name", "doc_id")
    shared = links.select("project_key", "name_a", "name_b").join(stated.withColumnRenamed("name", "name_b"), ["project_key", "name_b"]) \
        .join(stated.withColumnRenamed("name", "name_a"), ["project_key", "name_a", "doc_id"], "left_semi")
    shared = shared.select("project_key", "name_a", "name_b").distinct().withColumn("overlap", F.lit(True))
    return links.join(shared, ["project_key", "name_a", "name_b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def align_metrics(cells: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Suspected same metric under two names (CMP-7): links to the anchor without a common document, not yet decided."""
    links = alignment_links(cells).where("NOT overlap").drop("overlap")
    return links if decided is None else links.join(decided.select("project_key", "pair").distinct(), ["project_key", "pair"], "left_anti")


LABELS = {"same": "一致", "different": "内容变化", "equivalent": "表述不同 / 标准值相同", "missing": "未载明", "review": "待核对", "align": "疑似同一指标", "unextracted": "原文有线索未提取到"}


def comparison(fixed: DataFrame, notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """All comparison rows of a project: fixed fields, then metrics, with their label; aligned names are marked."""
    named = pairs.select("project_key", F.explode(F.array("name_a", "name_b")).alias("name")).distinct().withColumn("_align", F.lit(True))
    m = notes.join(named, KEY, "left").select(*KEY, F.lit("metric").alias("kind"), F.when(F.col("_align"), "align").otherwise(F.col("status")).alias("status"), "note")
    both = fixed.select(*KEY, F.lit("fixed").alias("kind"), "status", "note").unionByName(m)
    return both.withColumn("label", mapped(F.col("status"), LABELS))
