"""Evaluation of predictions against labels (EVA-1 to EVA-7, EVA-14 to EVA-18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X

CATEGORIES = ("guide", "access", "guarantee", "incentive")
LABEL_STATES = ("ai_draft", "human_reviewed", "unspecified")
NO_STRINGS = F.array


def _empty() -> Column:
    return F.array().cast("array<string>")


def ratio(a: Column, b: Column) -> Column:
    """a / b to four decimals, half to even; NULL on a zero denominator."""
    return F.bround(F.try_divide(a.cast("double"), b.cast("double")), 4)


def label_violations(labels: DataFrame) -> DataFrame:
    """Add violations, all broken label rules of the row (EVA-1)."""
    by_id = labels.groupBy("id").agg(F.count(F.lit(1)).alias("_same_id"))
    identity = ["page_url", "content_sha256"]
    filled = labels.select("page_url", X.text("content_sha256").alias("content_sha256")).where(X.text("page_url") != "")
    by_url = filled.groupBy(*identity).agg(F.count(F.lit(1)).alias("_same_url"))
    rows = labels.withColumn("content_sha256", X.text("content_sha256")).join(by_id, "id", "left").join(by_url, identity, "left")
    cats = F.coalesce("categories", _empty())
    checks = [
        (~F.coalesce(F.col("id") > 0, F.lit(False)), "标注 id 必须为正整数"), (F.col("_same_id") > 1, "标注 ID 重复"),
        (F.col("relevant").isNull(), "relevant 必须为布尔值"),
        (F.col("categories").isNull() | ~F.forall(cats, lambda c: c.isin(*CATEGORIES)), "非法分类标签，categories 必须为四类字符串数组"),
        (F.size(cats) != F.size(F.array_distinct(cats)), "分类标签重复"),
        ((F.size(cats) > 0) != F.col("relevant"), "相关文件必须有分类；非相关文件应无分类标签"),
        (~F.coalesce("label_status", F.lit("unspecified")).isin(*LABEL_STATES), "非法 label_status"),
        ((F.col("content_sha256") != "") & ~F.col("content_sha256").rlike("^[0-9a-f]{64}$"), "content_sha256 必须为原采集内容指纹"),
        (F.col("_same_url") > 1, "标注来源版本重复")]
    found = F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))
    return rows.withColumn("violations", found).select(*labels.columns, "violations")


def require_valid(labels: DataFrame) -> DataFrame:
    """The labels, or an error naming the first violation."""
    bad = label_violations(labels).where(F.size("violations") > 0).select("id", "violations").head(1)
    if bad:
        raise ValueError(f"label {bad[0]['id']}: {bad[0]['violations'][0]}")
    return labels


def label_summary(labels: DataFrame) -> DataFrame:
    """total, per status, reviewed, snapshot-bound (EVA-2)."""
    status = F.coalesce("label_status", F.lit("unspecified"))
    return labels.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(status == s).alias(s) for s in LABEL_STATES],
        F.count_if((X.text("page_url") != "") & (X.text("content_sha256") != "")).alias("snapshot_bound"))


def resolve_labels(labels: DataFrame, policies: DataFrame) -> DataFrame:
    """Bind every label to one stored version (EVA-3): adds policy_id and problem ('' if bound).

    A URL (with its hash, if labelled) outranks the id. Matches are counted before the join, so a
    URL shared by many rows costs one row.
    """
    by_hash = policies.groupBy("page_url", "content_sha256").agg(F.count(F.lit(1)).alias("_n1"), F.max("id").alias("_id1"))
    by_url = policies.groupBy("page_url").agg(F.count(F.lit(1)).alias("_n2"), F.max("id").alias("_id2"))
    by_id = policies.select("id", F.lit(1).alias("_n3"))
    has_url, has_hash = X.text("page_url") != "", X.text("content_sha256") != ""
    rows = labels.join(by_hash, ["page_url", "content_sha256"], "left").join(by_url, "page_url", "left").join(by_id, "id", "left")
    n = F.coalesce(F.when(has_url & has_hash, F.col("_n1")).when(has_url, F.col("_n2")).otherwise(F.col("_n3")), F.lit(0))
    match = F.when(has_url & has_hash, F.col("_id1")).when(has_url, F.col("_id2")).otherwise(F.col("id"))
    rows = rows.withColumn("_n", n).withColumn("policy_id", F.when(n == 1, match))
    stored = policies.select(F.col("id").alias("policy_id"), *[F.col(c).alias(f"_{c}") for c in ("title", "wenhao", "content_sha256")])
    rows = rows.join(stored, "policy_id", "left")
    taken = rows.where("policy_id IS NOT NULL").groupBy("policy_id").agg(F.count(F.lit(1)).alias("_taken"))
    rows = rows.join(taken, "policy_id", "left")

    def differs(c):
        return (X.text(c) != "") & (X.without_space(X.text(c)) != X.without_space(X.text(f"_{c}")))
    problem = F.when((F.col("_n") != 1) & has_url, "来源版本缺失或不唯一").when(F.col("_n") != 1, "政策 ID 不存在") \
        .when(differs("title"), "title 与数据库不匹配").when(differs("wenhao"), "wenhao 与数据库不匹配") \
        .when(differs("content_sha256"), "content_sha256 与数据库不匹配").when(F.col("_taken") > 1, "多条标注匹配同一数据库记录").otherwise("")
    return rows.withColumn("problem", problem).select(*labels.columns, "policy_id", "problem")


def _paired(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Join on id; `pred` holds the classes a yes prediction claims."""
    gold = labels.select("id", "relevant", F.coalesce("categories", _empty()).alias("truth"))
    given = F.filter(F.split(X.text("category"), ","), lambda c: c != "")
    yes = F.col("is_investment_policy") == "yes"
    return gold.join(predictions, "id").withColumn("yes", yes).withColumn("pred", F.when(yes, given).otherwise(_empty()))


def score(labels: DataFrame, predictions: DataFrame, by=()) -> DataFrame:
    """Relevance and class metrics (EVA-4); pending is never right, relevant and pending is a miss."""
    inv, rel, yes = F.col("is_investment_policy"), F.col("relevant"), F.col("yes")
    same = (F.size(F.array_except("truth", "pred")) == 0) & (F.size(F.array_except("pred", "truth")) == 0)
    out = _paired(labels, predictions).groupBy(*by).agg(
        F.count(F.lit(1)).alias("labeled_records"), F.count_if(yes & rel).alias("tp"), F.count_if(yes & ~rel).alias("fp"),
        F.count_if(~yes & rel).alias("fn"), F.count_if((inv == "no") & ~rel).alias("tn"), F.count_if(inv == "pending").alias("pending"),
        F.count_if(F.col("method") == "rule_fallback").alias("rule_fallback"), F.count_if(F.col("need_review")).alias("need_review"),
        F.sum(F.size(F.array_intersect("truth", "pred"))).alias("ct"), F.sum(F.size(F.array_except("pred", "truth"))).alias("cp"),
        F.sum(F.size(F.array_except("truth", "pred"))).alias("cn"),
        F.count_if((inv != "pending") & (yes == rel) & same).alias("exact"))
    c = F.col
    return out.select(
        *by, "labeled_records", ratio(c("tp"), c("tp") + c("fp")).alias("relevance_precision"), ratio(c("tp"), c("tp") + c("fn")).alias("relevance_recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("relevance_f1"), ratio(c("ct"), c("ct") + c("cp")).alias("category_micro_precision"),
        ratio(c("ct"), c("ct") + c("cn")).alias("category_micro_recall"), ratio(2 * c("ct"), 2 * c("ct") + c("cp") + c("cn")).alias("category_micro_f1"),
        ratio(c("exact"), c("labeled_records")).alias("exact_match"), ratio(c("labeled_records") - c("pending"), c("labeled_records")).alias("decision_coverage"),
        "tp", "fp", "fn", "tn", "pending", "rule_fallback", "need_review")


def score_by_class(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """tp / fp / fn of each class, all four always present (EVA-5)."""
    counts = []
    for i, name in enumerate(CATEGORIES):
        t, p = F.array_contains("truth", name), F.array_contains("pred", name)
        counts += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(~t & p).alias(f"fp{i}"), F.count_if(t & ~p).alias(f"fn{i}")]
    one = _paired(labels, predictions).agg(*counts)
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
                     for i, n in enumerate(CATEGORIES)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def compare_methods(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """EVA-4 per prediction run plus run_complete and evaluation_status (EVA-6). `predictions` carries run and method."""
    total = labels.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce("label_status", F.lit("")) == "human_reviewed").alias("_reviewed"))
    done = predictions.groupBy("run").agg(F.count_if(F.col("method") == "llm").alias("llm_classified"))
    out = score(labels, predictions, ["run"]).join(done, "run").crossJoin(total)  # one total row
    complete = F.col("llm_classified") == F.col("_n")
    state = F.when(~complete, "incomplete").when(F.col("_reviewed") == F.col("_n"), "human_reviewed").otherwise("exploratory")
    return out.withColumn("run_complete", complete).withColumn("evaluation_status", state).drop("_n", "_reviewed")


def material_readiness(labels: DataFrame, docs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Body and analysis size, attachments and the analysis hash of every labelled document (EVA-7)."""
    from docledger.operators.pages import analysis_text
    wanted = docs.join(labels.select("id"), "id", "left_semi")
    own = attachments.join(labels.select(F.col("id").alias("policy_id")), "policy_id", "left_semi")
    counts = own.groupBy(F.col("policy_id").alias("id")).agg(F.count(F.lit(1)).alias("attachments"), F.count_if(X.text("parse_status") != "ok").alias("attachments_incomplete"))
    rows = analysis_text(wanted, own).join(counts, "id", "left")
    return rows.select("id", F.length(X.text("content")).alias("body_chars"), F.length("analysis_text").alias("analysis_chars"),
                       F.coalesce("attachments", F.lit(0)).alias("attachments"), F.coalesce("attachments_incomplete", F.lit(0)).alias("attachments_incomplete"),
                       X.sha256(F.col("analysis_text")).alias("analysis_sha256"))


def error_types(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Errors of each prediction (EVA-14)."""
    rows = _paired(labels, predictions)
    inv, rel = F.col("is_investment_policy"), F.col("relevant")
    found = F.array_compact(F.array(
        F.when(F.col("method") != "llm", "service_failure_or_fallback"), F.when(inv == "pending", "pending"),
        F.when(rel & (inv == "no"), "false_exclusion"), F.when(~rel & (inv == "yes"), "false_inclusion"),
        F.when(F.size(F.array_except("truth", "pred")) > 0, "missing_categories"), F.when(F.size(F.array_except("pred", "truth")) > 0, "extra_categories")))
    return rows.select("id", found.alias("errors"))


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def acceptance(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Bucket of each boundary case (EVA-15): silent_false_accept, missed, auto_ok, to_review."""
    got, todo = F.col("is_investment_policy"), F.col("todo_type")
    bucket = F.when((F.col("expect") == "no") & (got == "yes") & (todo == "none"), "silent_false_accept") \
        .when((F.col("expect") == "yes") & (got == "no"), "missed").when((todo == "none") & (got == F.col("expect")), "auto_ok").otherwise("to_review")
    return cases.join(verdicts, "id").withColumn("bucket", bucket)


def acceptance_rates(bucketed: DataFrame) -> DataFrame:
    b = F.col("bucket")
    n = bucketed.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("expect") == "yes").alias("positives"), F.count_if(F.col("expect") == "no").alias("negatives"),
        *[F.count_if(b == k).alias(k) for k in ("silent_false_accept", "missed", "auto_ok", "to_review")])
    c = F.col
    return n.withColumn("silent_rate", ratio(c("silent_false_accept"), c("negatives"))).withColumn("missed_rate", ratio(c("missed"), c("positives"))) \
        .withColumn("auto_rate", ratio(c("auto_ok"), c("cases"))).withColumn("human_rate", ratio(c("cases") - c("auto_ok"), c("cases")))


SAMPLE_FAILURES = ("failed", "documents_incomplete", "attachments_failed", "attachments_unparsed")


def source_acceptance(sources: DataFrame, samples: DataFrame) -> DataFrame:
    """accepted and the first reason otherwise (EVA-16).

    `sources`: source, error (discovery error or ''), national_repost; `samples`: source, url, body_chars and counters.
    """
    failing = F.lit(False)
    for c in SAMPLE_FAILURES:
        failing = failing | (F.col(c) > 0)
    bad = (F.col("body_chars") == 0) | failing
    per = samples.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("url"))).alias("_url"))
    rows = sources.join(per, "source", "left").withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("bad", F.coalesce("bad", F.lit(0)))
    reason = F.when(F.col("national_repost"), "疑似中央文件转载子栏目").when(F.col("error") != "", F.col("error")) \
        .when(F.col("samples") == 0, "未取到样本").when(F.col("bad") > 0, F.concat(F.lit("样本异常: "), F.col("_url"))).otherwise("")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").drop("_url")


def ingest_verdict(rounds: DataFrame, ledger: DataFrame, attachments: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Was a source ingested to the end, completely and repeatably? (EVA-17) One row per source.

    `rounds`: source_id, round, end_reached, documents_incomplete, ingested, updated, duplicates;
    `attachments`: source_id, parse_status; `runs`: source_id, id, status; `sources`: source_id, last_error.
    """
    r = rounds.groupBy("source_id").agg(F.count(F.lit(1)).alias("_rounds"), F.max_by(F.struct("end_reached", "documents_incomplete"), "round").alias("_last"))
    second = rounds.where("round = 2").select("source_id", ((F.col("ingested") == 0) & (F.col("updated") == 0) & (F.col("duplicates") > 0)).alias("_stable"))
    l = ledger.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidates_total"), F.count_if(~F.col("status").isin("processed", "excluded")).alias("unresolved_candidates"))
    a = attachments.groupBy("source_id").agg(F.count_if(F.col("parse_status") != "ok").alias("_bad_files"))
    last_run = runs.groupBy("source_id").agg(F.max_by("status", "id").alias("_run"))
    out = sources.join(r, "source_id", "left").join(second, "source_id", "left").join(l, "source_id", "left").join(a, "source_id", "left").join(last_run, "source_id", "left")
    no, zero = F.lit(False), F.lit(0)
    out = out.withColumn("candidates_total", F.coalesce("candidates_total", zero)).withColumn("unresolved_candidates", F.coalesce("unresolved_candidates", zero))
    checks = {
        "discovery_reached_end": F.coalesce("_last.end_reached", no) & (X.text("last_error") == ""),
        "candidate_processing_complete": (F.col("candidates_total") > 0) & (F.col("unresolved_candidates") == 0),
        "material_complete": (F.coalesce("_bad_files", zero) == 0) & (F.coalesce("_last.documents_incomplete", zero) == 0),
        "last_run_ok": F.coalesce(F.col("_run") == "ok", no), "two_rounds_completed": F.coalesce(F.col("_rounds") >= 2, no),
        "stable_input_idempotence_verified": F.coalesce("_stable", no)}
    overall = F.lit(True)
    for name, c in checks.items():
        out = out.withColumn(name, c)
        overall = overall & F.col(name)
    return out.withColumn("overall_ok", overall).select("source_id", "candidates_total", "unresolved_candidates", *checks, "overall_ok")


def field_accuracy(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per field: value right up to white space, gold pages among the found ones (EVA-18).

    Both sides: filename, field, value (NULL if absent), pages ARRAY<INT>; `extracted` also status.
    """
    e = extracted.select("filename", "field", F.col("value").alias("_value"), F.col("pages").alias("_pages"), "status")
    rows = gold.join(e, ["filename", "field"], "left")
    right = X.without_space(F.col("value")).eqNullSafe(X.without_space(F.col("_value")))
    located = F.when(F.col("value").isNotNull(), F.size(F.array_except("pages", F.coalesce("_pages", F.array().cast("array<int>")))) == 0)
    return rows.select("filename", "field", "value", F.col("_value").alias("actual"), right.alias("correct"), located.alias("located"),
                       F.coalesce(F.col("status").isin("needs_review", "uncertain", "conflict"), F.lit(False)).alias("review"))


def field_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"), F.count("located").alias("present"),
                       F.count_if("located").alias("located"), F.count_if("review").alias("manual_review_fields")) \
        .withColumn("accuracy", ratio(F.col("correct"), F.col("total"))).withColumn("recall", ratio(F.col("located"), F.col("present")))


def metric_differences(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """Metrics on one side only: extra or missing; both sides filename, name, value (EVA-18)."""
    key = ["filename", "name", "value"]
    side = lambda rows, extra: rows.select("filename", "name", X.without_space(F.col("value")).alias("value"), F.lit(extra).alias("_x"), F.lit(not extra).alias("_g"))
    # both sides meet once, as two flags of a metric; one with a NULL equals none of the other side
    rows = side(gold, False).unionByName(side(extracted, True)).groupBy(*key).agg(F.bool_or("_x").alias("_x"), F.bool_or("_g").alias("_g"))
    alone = F.col("filename").isNull() | F.col("name").isNull() | F.col("value").isNull()
    kinds = F.array(F.when(F.col("_x") & (~F.col("_g") | alone), "extra"), F.when(F.col("_g") & (~F.col("_x") | alone), "missing"))
    return rows.select(*key, F.explode(F.array_compact(kinds)).alias("kind"))


def metric_score(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    key = ["filename", "name", "value"]
    g = gold.select("filename", "name", X.without_space(F.col("value")).alias("value")).distinct().withColumn("g", F.lit(1))
    x = extracted.select("filename", "name", X.without_space(F.col("value")).alias("value")).distinct().withColumn("x", F.lit(1))
    n = g.join(x, key, "full").agg(F.count_if((F.col("g") == 1) & (F.col("x") == 1)).alias("true_positive"), F.count("x").alias("predicted"), F.count("g").alias("expected"))
    return n.withColumn("precision", F.coalesce(ratio(F.col("true_positive"), F.col("predicted")), F.lit(0.0))) \
        .withColumn("recall", ratio(F.col("true_positive"), F.col("expected")))
