"""Rule classification of documents (CLS-1 to CLS-11, CLS-16 to CLS-19).

Each step is a projection over the whole text: keyword tests are `contains` expressions in one
codegen stage, so the classifier never shuffles and never leaves the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X
from docledger.operators.library import CATEGORY_NAMES, mapped
from docledger.operators.ruleset import DEFAULT, RuleSet, norm_word

# ---- fixed values: document types and message texts ----
DOC_TYPES = {"draft": "征求意见稿", "interpretation": "解读", "formal": "正式政策", "notice": "申报通知", "approval": "项目批复"}
OTHER = "其他"
MODEL_VERSION = "rule-v3"
MISSING_STATES = ("failed", "missing", "not_parsed", "needs_ocr", "unsupported")
PERMANENT_ERROR = r"(?i)HTTP\s*4(?:04|10)\b|not\s+found"
NO_TEXT_REASON = "正文或附件不完整，待补采/重解析后自动重跑分类"
NO_MODEL_REASON = "未配置可用的大模型接口"
JOIN = "；"


def join_filled(sep: str, *cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*cols), lambda v: v != ""), sep)


def _contains_any(col: Column, words) -> Column:
    return X.contains_any(col, [norm_word(w) for w in words])


def prepared(docs: DataFrame, text: str = "content") -> DataFrame:
    """Add the match forms of the title and of title plus whole text (CLS-1)."""
    return docs.withColumn("_title", X.norm_text(F.col("title"))) \
        .withColumn("_text", X.norm_text(F.concat(X.text("title"), F.lit(" "), X.text(text))))


def doc_type(title: Column, rules: RuleSet = DEFAULT) -> Column:
    """Document type by the first matching word group of the title (CLS-2)."""
    out = F
    for group, name in DOC_TYPES.items():
        out = out.when(_contains_any(title, rules.doc_types.get(group, ())), name)
    return out.otherwise(OTHER)


def keyword_hits(docs: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Matching words per group, in rule order (CLS-3). Needs `prepared` columns."""
    for group in ("strong", "lifecycle", "weak"):
        docs = docs.withColumn(f"{group}_hits", X.hits(F.col("_text"), rules.words(group)))
    return docs.withColumn("title_hit", X.contains_any(F.col("_title"), rules.words("title")))


def exclude(docs: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Add doc_type and exclusion, the reason a document is out of scope ('' if it is not) (CLS-4)."""
    title = F.col("_title")
    out = docs.withColumn("doc_type", doc_type(title, rules)) \
        .withColumn("_hard", X.first_of(title, rules.words("exclude_hard"))) \
        .withColumn("_soft", X.first_of(title, rules.words("exclude_soft"))) \
        .withColumn("_op", X.first_of(title, rules.words("operational")))
    kind = F.concat(F.lit("文件类型为「"), "doc_type", F.lit("」，属单个项目批复或政策解读，不是对一类项目普遍适用的政策正文，不收录"))
    hard = F.concat(F.lit("命中事务性关键词「"), "_hard", F.lit("」，属事务公告而非政策正文，不收录"))
    soft = F.concat(F.lit("命中信息发布类关键词「"), "_soft", F.lit("」，属信息发布而非政策正文，不收录"))
    operational = F.concat(F.lit("命中存量企业运行类政策（"), "_op",
                           F.lit("）：调整对象为已投产企业日常运行成本，不涉及新建或改建项目，按业务口径不收录"))
    reason = F.when(F.col("doc_type").isin("项目批复", "解读"), kind).when(F.col("_hard") != "", hard) \
        .when((F.col("_soft") != "") & ~X.contains_any(title, rules.policy_forms), soft) \
        .when((F.col("_op") != "") & ~X.contains_any(title, rules.words("operational_override")), operational).otherwise("")
    return out.withColumn("exclusion", reason).drop("_hard", "_soft", "_op")


def categories(docs: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Add category_scores: classes with hits, most hits first, ties in rule order (CLS-6)."""
    scored = []
    for i, (key, (name, words)) in enumerate(rules.categories.items()):
        found = X.hits(F.col("_text"), [norm_word(w) for w in words])
        docs = docs.withColumn(f"_c{i}", found)
        scored.append(F.struct((-F.size(f"_c{i}")).alias("minus"), F.lit(i).alias("ordinal"), F.lit(key).alias("key"), F.col(f"_c{i}").alias("hits"),
                               F.concat(F.lit(name + ":"), F.array_join(F.slice(f"_c{i}", 1, 3), "、")).alias("words")))
    some = F.filter(F.array(*scored), lambda s: s["minus"] < 0)
    return docs.withColumn("_by_rule", some).withColumn("category_scores", F.array_sort("_by_rule")) \
        .drop(*[f"_c{i}" for i in range(len(scored))])


def relevance(docs: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Add is_investment_policy, a first todo_type, hint and the words behind it (CLS-5).

    Strong or life-cycle words decide; a title word needs a common word beside it; common words
    alone, or class words in a policy form, only raise a question.
    """
    strong = F.concat("strong_hits", "lifecycle_hits")
    weak_n = F.size("weak_hits")
    has_class = F.size("category_scores") > 0
    formal = F.col("doc_type").isin("正式政策", "征求意见稿", "申报通知")
    by_title = F.col("title_hit")
    docs = docs.withColumn("_all", strong).withColumn(
        "_case", F.when(F.size("_all") > 0, "strong").when(by_title & (weak_n > 0), "title")
        .when(by_title | (weak_n >= rules.weak_pending), "unsure").when(has_class & formal, "probe").otherwise("none"))
    case = F.col("_case")
    thin = (case == "strong") & (F.size("_all") < rules.min_strong) & ~by_title
    thin_hint = F.concat(F.lit("仅命中 "), F.size("_all").cast("string"), F.lit(" 个项目相关表述（"), F.array_join(F.slice("_all", 1, 2), "、"),
                         F.lit("）且标题未体现投资主题，可能是偶然提及、否定语境或引用他文，需人工确认是否收录"))
    unsure_hint = F.when(by_title, "标题含投资相关词，但正文未出现明确的项目管理表述，需确认是否收录并归类").otherwise(
        F.concat(F.lit("正文出现 "), weak_n.cast("string"), F.lit(" 处投资类通用词，但无明确的项目管理表述，需确认是否与本库主题相关")))
    probe_hint = F.lit("命中某类政策特征条款但未见明确投资项目表述，需确认是否收录（正文可能过短或主要内容在附件）")
    return docs.withColumn("is_investment_policy", F.when(case.isin("strong", "title"), "yes").when(case.isin("unsure", "probe"), "pending").otherwise("no")) \
        .withColumn("todo_type", F.when(thin, "review").when(case.isin("unsure", "probe"), "scope").otherwise("none")) \
        .withColumn("reviewer_hint", F.when(thin, thin_hint).when(case == "unsure", unsure_hint).when(case == "probe", probe_hint).otherwise("")) \
        .withColumn("_words", F.when(case == "strong", F.col("_all")).when(case.isin("title", "unsure"), F.col("weak_hits")).otherwise(F.array().cast("array<string>")))


def boundary_flags(docs: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Add boundary: the known mixed case, a tie at the top, or relevance without a class (CLS-7)."""
    out = F
    for hint, note in rules.boundary:
        out = out.when(F.contains("_title", F.lit(norm_word(hint))), f"命中边界样例「{hint}」：{note}")
    scores = F.col("category_scores")
    tie = (F.size(scores) > 1) & (F.get(scores, 0)["minus"] == F.get(scores, 1)["minus"])
    out = out.when(tie, "多类命中得分相同，无法区分主次，需人工确认") \
        .when((F.col("is_investment_policy") == "yes") & (F.size(scores) == 0), "判为投资相关政策，但未命中任何一类的特征条款，需人工归类")
    return docs.withColumn("boundary", out.otherwise(""))


def todo_type(docs: DataFrame) -> DataFrame:
    """Final todo: boundary cases go to review, strong positives become candidates, never silently in (CLS-8)."""
    with_boundary = F.when((F.col("boundary") != "") & (F.col("todo_type") == "none"), "review").otherwise(F.col("todo_type"))
    return docs.withColumn("reviewer_hint", join_filled(JOIN, F.col("reviewer_hint"), F.col("boundary"))) \
        .withColumn("todo_type", with_boundary).withColumn(
        "todo_type", F.when((F.col("is_investment_policy") == "yes") & (F.col("todo_type") == "none"), "candidate").otherwise(F.col("todo_type")))


def explain(docs: DataFrame) -> DataFrame:
    """Readable reason, a sentence with six words at most, then the class evidence (CLS-9); matched_words has all words."""
    words = F.when(F.size("_words") > 0, F.concat(F.lit("命中投资相关关键词："), F.array_join(F.slice("_words", 1, 6), "、"))) \
        .otherwise("正式文件未命中投资关键词")
    evidence = F.transform("_by_rule", lambda s: s["words"])
    return docs.withColumn("matched_words", F.col("_words")).withColumn("reason", F.when(F.size(evidence) > 0, F.concat(words, F.lit("；分类依据："), F.array_join(evidence, JOIN))).otherwise(words))


VERDICT = ["is_investment_policy", "todo_type", "need_review", "doc_type", "category", "category_names", "reason", "reviewer_hint"]


def classify(docs: DataFrame, rules: RuleSet = DEFAULT, text: str = "content") -> DataFrame:
    """The whole rule verdict (CLS-1 to CLS-9), added to `docs`."""
    keep = docs.columns
    out = explain(todo_type(boundary_flags(relevance(categories(keyword_hits(exclude(prepared(docs, text), rules), rules), rules), rules), rules)))
    out_of_scope = F.col("exclusion") != ""
    nothing = ~out_of_scope & (F.col("_case") == "none")
    no = out_of_scope | nothing
    no_reason = F.when(out_of_scope, F.col("exclusion")).otherwise(
        F.concat(F.lit("未命中任何投资项目相关表述（文件类型："), "doc_type", F.lit("），不收录")))
    keys = F.transform("category_scores", lambda s: s["key"])
    names = F.transform(keys, lambda k: mapped(k, CATEGORY_NAMES, k))
    fields = {
        "is_investment_policy": F.when(no, "no").otherwise(F.col("is_investment_policy")),
        "todo_type": F.when(no, "none").otherwise(F.col("todo_type")),
        "category": F.when(no, "").otherwise(F.array_join(keys, ",")),
        "category_names": F.when(no, "").otherwise(F.array_join(names, ",")),
        "reason": F.when(no, no_reason).otherwise(F.col("reason")),
        "reviewer_hint": F.when(no, "").otherwise(F.col("reviewer_hint")),
        "matched_words": F.when(no, F.array().cast("array<string>")).otherwise(F.col("matched_words"))}
    out = out.select(*keep, "doc_type", *[c.alias(n) for n, c in fields.items()])
    return out.withColumn("need_review", F.col("todo_type").isin("candidate", "review", "scope")) \
        .withColumn("model_version", F.lit(MODEL_VERSION)).withColumn("method", F.lit("rule"))


def permanent_error(col: Column) -> Column:
    return X.text(col).rlike(PERMANENT_ERROR)


def material_gate(verdicts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Missing text outranks the verdict (CLS-10); dead links are only a hint while usable text exists.

    The hint names three of them, gone_names has all.

    `verdicts` carries id, content, parse_error and the verdict; `attachments` policy_id, id, name,
    parse_status (NULL allowed), parsed_text, error.
    """
    blank = X.strip(X.text("parsed_text")) == ""
    status = F.coalesce("parse_status", F.when(X.text("parsed_text") != "", "ok").otherwise("missing"))
    rows = attachments.withColumn("_absent", status.isin(*MISSING_STATES) | blank) \
        .withColumn("_gone", F.col("_absent") & permanent_error(F.col("error")))
    per_doc = rows.groupBy(F.col("policy_id").alias("id")).agg(
        F.count_if("_absent").alias("_n_absent"), F.count_if("_gone").alias("_n_gone"), F.bool_or(~blank).alias("_text"))
    label = X.first_filled(X.text("name"), F.lit("未命名附件"))
    dead = rows.where("_gone").groupBy(F.col("policy_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("_k"), label.alias("n")))), lambda s: s["n"]).alias("gone_names"),
        F.min_by("error", "id").alias("_error"))
    dead = dead.withColumn("_names", F.array_join(F.transform(F.slice("gone_names", 1, 3), lambda n: F.substring(n, 1, 30)), "、"))
    out = verdicts.join(per_doc, "id", "left").join(dead, "id", "left")
    usable = (X.strip(X.text("content")) != "") | F.coalesce("_text", F.lit(False))
    absent, gone = F.coalesce("_n_absent", F.lit(0)), F.coalesce("_n_gone", F.lit(0))
    incomplete = (X.text("parse_error") != "") | ((absent > 0) & ~((gone == absent) & usable))
    dead_hint = F.concat(F.lit("附件《"), "_names", F.lit("》在来源站点已失效（"), "_error", F.lit("），本条按现有材料判定"))
    hint = F.when(F.col("_incomplete"), join_filled(JOIN, F.col("reviewer_hint"), F.lit(NO_TEXT_REASON))) \
        .when(gone > 0, join_filled(JOIN, F.col("reviewer_hint"), dead_hint)).otherwise(F.col("reviewer_hint"))
    out = out.withColumn("_incomplete", incomplete).withColumn("reviewer_hint", hint) \
        .withColumn("todo_type", F.when(F.col("_incomplete"), "material").otherwise(F.col("todo_type"))) \
        .withColumn("need_review", F.when(F.col("_incomplete"), False).otherwise(F.col("need_review"))) \
        .withColumn("is_investment_policy", F.when(F.col("_incomplete") & (F.col("is_investment_policy") == "no"), "pending")
                    .otherwise(F.col("is_investment_policy")))
    return out.select(*verdicts.columns, F.coalesce("gone_names", F.array().cast("array<string>")).alias("gone_names"))


def fallback_state(verdicts: DataFrame, answered: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Documents without a model answer keep the rule verdict as a system todo (CLS-11)."""
    done = answered.select("id").distinct().withColumn("_answered", F.lit(True))
    out = verdicts.join(done, "id", "left")
    out = out.join(errors.select("id", F.col("error").alias("_error")), "id", "left") if errors is not None \
        else out.withColumn("_error", F.lit(None).cast("string"))
    lost = F.col("_answered").isNull()
    why = X.first_filled(X.text("_error"), F.lit(NO_MODEL_REASON))
    return out.withColumn("method", F.when(lost, "rule_fallback").otherwise(F.col("method"))) \
        .withColumn("fallback_reason", F.when(lost, why).otherwise("")) \
        .withColumn("todo_type", F.when(lost, "system").otherwise(F.col("todo_type"))) \
        .withColumn("need_review", ~lost & F.col("need_review")) \
        .withColumn("is_investment_policy", F.when(lost & (F.col("is_investment_policy") == "no"), "pending").otherwise(F.col("is_investment_policy"))) \
        .withColumn("reviewer_hint", F.when(lost, join_filled(JOIN, F.col("reviewer_hint"), why)).otherwise(F.col("reviewer_hint"))) \
        .drop("_answered", "_error")


def review_status(verdicts: DataFrame) -> DataFrame:
    """Tentative negatives become pending; then pending / rejected / confirmed_auto (CLS-16)."""
    out = verdicts.withColumn("is_investment_policy", F.when(F.col("need_review") & (F.col("is_investment_policy") == "no"), "pending")
                              .otherwise(F.col("is_investment_policy")))
    inv = F.col("is_investment_policy")
    return out.withColumn("review_status", F.when(F.col("need_review") | (inv == "pending"), "pending").when(inv == "no", "rejected").otherwise("confirmed_auto"))


def stored_todo(policies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Todo from stored fields by priority: material, system, scope, review, none (CLS-17, mode todo)."""
    empty = attachments.where(X.strip(X.text("parsed_text")) == "").select(F.col("policy_id").alias("id")).distinct().withColumn("_empty", F.lit(True))
    out = policies.join(empty, "id", "left")
    todo = F.when((X.strip(X.text("parse_error")) != "") | F.col("_empty"), "material") \
        .when(X.strip(X.text("fallback_reason")) != "", "system").when(F.col("is_investment_policy") == "pending", "scope") \
        .when(F.col("need_review").cast("boolean"), "review").otherwise("none")
    return out.withColumn("new_todo", todo).drop("_empty")


def rejudge(policies: DataFrame, attachments: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Re-run the rules for rows judged by rule, derive the todo of the others (CLS-17, mode rejudge).

    Adds new_todo, the new verdict columns (new_*) and `changes`: is the row rewritten?
    """
    from docledger.operators.materials import attachment_gap
    is_rule = F.col("classification_method") == "rule"
    gaps = attachments.where(attachment_gap()).select(F.col("policy_id").alias("id")).distinct().withColumn("_gap", F.lit(True))
    # documents are judged on title, body and the attachment texts
    from docledger.operators.pages import analysis_text
    judged = classify(analysis_text(policies.where(is_rule), attachments).select("id", "title", "analysis_text"), rules, "analysis_text") \
        .drop("title", "analysis_text", "method")
    judged = judged.select("id", *[F.col(c).alias(f"new_{c}") for c in VERDICT])
    out = policies.where(is_rule).join(judged, "id").join(gaps, "id", "left") \
        .withColumn("new_todo", F.when((X.strip(X.text("parse_error")) != "") | F.col("_gap"), "material").otherwise(F.col("new_todo_type"))) \
        .drop("_gap", "new_todo_type").withColumn("changes", F.lit(True))
    rest = stored_todo(policies.where(~is_rule), attachments)
    rest = rest.withColumn("changes", F.col("new_todo") != X.first_filled(X.text("todo_type"), F.lit("none")))
    return out.unionByName(rest, allowMissingColumns=True)


def todo_shift(rejudged: DataFrame) -> DataFrame:
    """Rows per todo before and after, and how many rows are rewritten (CLS-17)."""
    old = X.first_filled(X.text("todo_type"), F.lit("none"))
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), old.alias("todo"), F.col("changes").alias("c")),
                              F.struct(F.lit("after").alias("side"), F.col("new_todo").alias("todo"), F.col("changes").alias("c"))))
    return rejudged.select(sides.alias("s")).groupBy("s.side", "s.todo").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("s.c").alias("rewritten"))


def model_retry_candidates(policies: DataFrame) -> DataFrame:
    """Fallback rows without a human decision (CLS-18)."""
    return policies.where((F.col("classification_method") == "rule_fallback") & ~F.col("review_status").isin("confirmed", "adjusted", "rejected"))


def classification_counts(verdicts: DataFrame) -> DataFrame:
    """llm / rule / fallback counts and token sums (CLS-19)."""
    method = F.when(F.col("method") == "llm", "llm_classified").when(F.col("method") == "rule_fallback", "llm_fallback").otherwise("rule_classified")
    return verdicts.groupBy(method.alias("counter")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
