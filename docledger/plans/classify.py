"""Queries over classification and model answers.

The warehouse texts are not Chinese, so the queries bind the same rules to words of those texts;
the published vocabulary is exercised on its own examples in the tests.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import responses as R, rules as C
from docledger.operators.ruleset import RuleSet
from docledger.plans import binding as B
from docledger.plans.registry import query

RULES = RuleSet(
    exclude_hard=("thwh", "ouè"), exclude_soft=("eanen", "lle"), policy_forms=("tion", "der"), operational=("ndst", "keit"),
    operational_override=("heon", "ung"),
    strong=("erblestnd", "thhahe", "gungheit", "eauxde", "thedtion", "onwhthe"), lifecycle=("andthwh", "dieund", "reinghe"),
    weak=("tionthe", "ofthe", "andthe", "inthe", "dela", "derdie", "thatin"), title=("thattion", "ingan", "hent"), weak_pending=3, min_strong=2,
    categories={"guide": ("引导类", ("hereas", "edible", "einung")), "access": ("准入类", ("worthless", "thatand", "quede")),
                "guarantee": ("保障类", ("eanea", "lachla", "ngheit")), "incentive": ("激励约束类", ("whthat", "inoran", "losdel", "hehely"))},
    boundary=(("hatti", "note one"), ("ouon", "note two")),
    doc_types={"draft": ("shethe",), "interpretation": ("tioned", "ment"), "formal": ("the", "der", "que"), "notice": ("and",), "approval": ("of",)})


def lst(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def hit(column, words) -> str:
    return f"list_filter({lst(words)}, lambda w: contains({column}, w))"


def any_of(column, words) -> str:
    return f"len({hit(column, words)}) > 0"


def first_of(column, words) -> str:
    return f"coalesce({hit(column, words)}[1], '')"


_KINDS = [("draft", "征求意见稿"), ("interpretation", "解读"), ("formal", "正式政策"), ("notice", "申报通知"), ("approval", "项目批复")]
_CATS = list(RULES.categories.items())
NORM_SQL = B.DOCS_SQL + f""", n AS (SELECT *, replace(replace(lower(title), ' ', ''), chr(10), '') AS t,
    replace(replace(lower(title || ' ' || content), ' ', ''), chr(10), '') AS x FROM docs),
h AS (SELECT *, {hit('x', RULES.strong)} AS strong, {hit('x', RULES.lifecycle)} AS life, {hit('x', RULES.weak)} AS weak, {any_of('t', RULES.title)} AS title_hit,
    CASE {' '.join(f"WHEN {any_of('t', RULES.doc_types[g])} THEN '{name}'" for g, name in _KINDS)} ELSE '其他' END AS doc_type,
    {', '.join(f"{hit('x', words)} AS c{i}" for i, (_, (_, words)) in enumerate(_CATS))},
    {first_of('t', RULES.exclude_hard)} AS hard, {first_of('t', RULES.exclude_soft)} AS soft, {first_of('t', RULES.operational)} AS op FROM n)"""

_EXCLUSION_SQL = f"""CASE WHEN doc_type IN ('项目批复', '解读') THEN '文件类型为「' || doc_type || '」，属单个项目批复或政策解读，不是对一类项目普遍适用的政策正文，不收录'
  WHEN hard <> '' THEN '命中事务性关键词「' || hard || '」，属事务公告而非政策正文，不收录'
  WHEN soft <> '' AND NOT {any_of('t', RULES.policy_forms)} THEN '命中信息发布类关键词「' || soft || '」，属信息发布而非政策正文，不收录'
  WHEN op <> '' AND NOT {any_of('t', RULES.operational_override)} THEN '命中存量企业运行类政策（' || op || '）：调整对象为已投产企业日常运行成本，不涉及新建或改建项目，按业务口径不收录'
  ELSE '' END"""

VERDICT_SQL = NORM_SQL + f""", s AS (SELECT *, {_EXCLUSION_SQL} AS exclusion, strong || life AS sl,
    list_filter([{', '.join(f"{{'minus': -len(c{i}), 'ordinal': {i}, 'key': '{k}', 'name': '{name}', 'words': c{i}}}" for i, (k, (name, _)) in enumerate(_CATS))}], lambda c: c.minus < 0) AS byrule FROM h),
r AS (SELECT *, list_sort(byrule) AS scores, CASE WHEN len(sl) > 0 THEN 'strong' WHEN title_hit AND len(weak) > 0 THEN 'title'
    WHEN title_hit OR len(weak) >= 3 THEN 'unsure' WHEN len(byrule) > 0 AND doc_type IN ('正式政策', '征求意见稿', '申报通知') THEN 'probe' ELSE 'none' END AS kase FROM s),
r2 AS (SELECT *, kase = 'strong' AND len(sl) < 2 AND NOT title_hit AS thin, exclusion <> '' OR kase = 'none' AS is_no,
    CASE WHEN kase IN ('strong', 'title') THEN 'yes' ELSE 'pending' END AS inv,
    CASE WHEN kase = 'strong' THEN sl WHEN kase IN ('title', 'unsure') THEN weak ELSE [] END AS words FROM r),
r3 AS (SELECT *, CASE WHEN thin THEN 'review' WHEN kase IN ('unsure', 'probe') THEN 'scope' ELSE 'none' END AS todo1,
    CASE WHEN thin THEN '仅命中 ' || len(sl) || ' 个项目相关表述（' || array_to_string(sl[1:2], '、') || '）且标题未体现投资主题，可能是偶然提及、否定语境或引用他文，需人工确认是否收录'
      WHEN kase = 'unsure' AND title_hit THEN '标题含投资相关词，但正文未出现明确的项目管理表述，需确认是否收录并归类'
      WHEN kase = 'unsure' THEN '正文出现 ' || len(weak) || ' 处投资类通用词，但无明确的项目管理表述，需确认是否与本库主题相关'
      WHEN kase = 'probe' THEN '命中某类政策特征条款但未见明确投资项目表述，需确认是否收录（正文可能过短或主要内容在附件）' ELSE '' END AS hint1,
    CASE WHEN contains(t, 'hatti') THEN '命中边界样例「hatti」：note one' WHEN contains(t, 'ouon') THEN '命中边界样例「ouon」：note two'
      WHEN len(scores) > 1 AND scores[1].minus = scores[2].minus THEN '多类命中得分相同，无法区分主次，需人工确认'
      WHEN inv = 'yes' AND len(scores) = 0 THEN '判为投资相关政策，但未命中任何一类的特征条款，需人工归类' ELSE '' END AS bound FROM r2),
r4 AS (SELECT *, CASE WHEN todo1 = 'none' THEN CASE WHEN bound <> '' THEN 'review' WHEN inv = 'yes' THEN 'candidate' ELSE 'none' END ELSE todo1 END AS todo2 FROM r3),
verdict AS (SELECT id, title, content, lang, CASE WHEN is_no THEN 'no' ELSE inv END AS is_investment_policy, CASE WHEN is_no THEN 'none' ELSE todo2 END AS todo_type, doc_type,
    CASE WHEN is_no THEN '' ELSE array_to_string(list_transform(scores, lambda c: c.key), ',') END AS category,
    CASE WHEN is_no THEN '' ELSE array_to_string(list_transform(scores, lambda c: c.name), ',') END AS category_names,
    CASE WHEN exclusion <> '' THEN exclusion WHEN is_no THEN '未命中任何投资项目相关表述（文件类型：' || doc_type || '），不收录'
      ELSE CASE WHEN len(words) > 0 THEN '命中投资相关关键词：' || array_to_string(words[1:6], '、') ELSE '正式文件未命中投资关键词' END ||
        CASE WHEN len(byrule) > 0 THEN '；分类依据：' || array_to_string(list_transform(byrule, lambda c: c.name || ':' || array_to_string(c.words[1:3], '、')), '；') ELSE '' END END AS reason,
    CASE WHEN is_no THEN '' ELSE concat_ws('；', nullif(hint1, ''), nullif(bound, '')) END AS reviewer_hint FROM r4),
judged AS (SELECT *, todo_type IN ('candidate', 'review', 'scope') AS need_review FROM verdict)"""


def verdicts(spark, sf):
    return C.classify(B.docs(spark, sf), RULES)


@query("cls_norm_text", f"WITH {NORM_SQL} SELECT id, t AS title_form, sha256(x) AS text_form FROM h")
def norm_text(spark, sf):
    return C.prepared(B.docs(spark, sf)).select("id", F.col("_title").alias("title_form"), X.sha256(F.col("_text")).alias("text_form"))


@query("cls_doc_type", f"WITH {NORM_SQL} SELECT id, doc_type FROM h")
def doc_type(spark, sf):
    return C.prepared(B.docs(spark, sf)).select("id", C.doc_type(F.col("_title"), RULES).alias("doc_type"))


@query("cls_keyword_hits", f"WITH {NORM_SQL} SELECT id, array_to_string(strong, ',') AS strong, array_to_string(life, ',') AS lifecycle, array_to_string(weak, ',') AS weak, title_hit FROM h")
def keyword_hits(spark, sf):
    h = C.keyword_hits(C.prepared(B.docs(spark, sf)), RULES)
    return h.select("id", *[F.array_join(f"{g}_hits", ",").alias(g) for g in ("strong", "lifecycle", "weak")], "title_hit")


@query("cls_exclude", f"WITH {NORM_SQL} SELECT id, doc_type, {_EXCLUSION_SQL} AS exclusion FROM h")
def exclude(spark, sf):
    return C.exclude(C.prepared(B.docs(spark, sf)), RULES).select("id", "doc_type", "exclusion")


@query("cls_categories", f"WITH {VERDICT_SQL} SELECT id, array_to_string(list_transform(scores, lambda c: c.key || ':' || -c.minus), ',') AS scores FROM r")
def categories(spark, sf):
    c = C.categories(C.prepared(B.docs(spark, sf)), RULES)
    return c.select("id", F.array_join(F.transform("category_scores", lambda s: F.concat(s["key"], F.lit(":"), -s["minus"])), ",").alias("scores"))


def _relevance(spark, sf):
    d = C.exclude(C.prepared(B.docs(spark, sf)), RULES)
    return C.relevance(C.categories(C.keyword_hits(d, RULES), RULES), RULES)


@query("cls_relevance", f"WITH {VERDICT_SQL} SELECT id, CASE WHEN kase = 'none' THEN 'no' ELSE inv END AS is_investment_policy, todo1 AS todo_type, hint1 AS reviewer_hint FROM r3")
def relevance(spark, sf):
    return _relevance(spark, sf).select("id", "is_investment_policy", "todo_type", "reviewer_hint")


@query("cls_boundary_flags", f"""WITH {VERDICT_SQL} SELECT id, CASE WHEN bound LIKE '判为%' AND kase = 'none' THEN '' ELSE bound END AS boundary FROM r3""")
def boundary_flags(spark, sf):
    return C.boundary_flags(_relevance(spark, sf), RULES).select("id", "boundary")


@query("cls_todo_type", f"WITH {VERDICT_SQL} SELECT id, todo_type, need_review FROM judged")
def todo_type(spark, sf):
    return verdicts(spark, sf).select("id", "todo_type", "need_review")


@query("cls_explain", f"WITH {VERDICT_SQL} SELECT id, reason, reviewer_hint FROM judged")
def explain(spark, sf):
    return verdicts(spark, sf).select("id", "reason", "reviewer_hint")


@query("cls_classify", f"WITH {VERDICT_SQL} SELECT id, is_investment_policy, todo_type, need_review, doc_type, category, category_names, reason, reviewer_hint FROM judged")
def classify(spark, sf):
    return verdicts(spark, sf).select("id", *C.VERDICT)


_GATE_SQL = B.POLICIES_SQL + ", " + B.ATTACHMENTS_SQL + """, a AS (SELECT *, parse_status = 'failed' OR parsed_text = '' AS absent, (parse_status = 'failed' OR parsed_text = '') AND error = 'HTTP 404' AS gone FROM attachments),
g AS (SELECT policy_id, count(*) FILTER (absent) AS na, count(*) FILTER (gone) AS ng, bool_or(parsed_text <> '') AS txt,
   array_to_string(list(name ORDER BY id) FILTER (gone)[1:3], '、') AS names FROM a GROUP BY policy_id),
v AS (SELECT p.*, coalesce(na, 0) AS na, coalesce(ng, 0) AS ng, names, parse_error <> '' OR (coalesce(na, 0) > 0 AND NOT (na = ng AND (wenhao <> '' OR coalesce(txt, false)))) AS inc
   FROM flagged p LEFT JOIN g ON policy_id = p.id)"""


@query("cls_material_gate", f"""WITH {_GATE_SQL} SELECT id, CASE WHEN inc THEN 'material' ELSE todo_type END AS todo_type, NOT inc AND need_review = 1 AS need_review,
  CASE WHEN review_status = 'rejected' THEN CASE WHEN inc THEN 'pending' ELSE 'no' END ELSE 'yes' END AS is_investment_policy,
  CASE WHEN inc THEN 'h；正文或附件不完整，待补采/重解析后自动重跑分类' WHEN ng > 0 THEN 'h；附件《' || names || '》在来源站点已失效（HTTP 404），本条按现有材料判定' ELSE 'h' END AS reviewer_hint FROM v""")
def material_gate(spark, sf):
    v = B.policies(spark, sf).select("id", F.col("wenhao").alias("content"), "parse_error", "todo_type", (F.col("need_review") == 1).alias("need_review"),
                                     F.when(F.col("review_status") == "rejected", "no").otherwise("yes").alias("is_investment_policy"), F.lit("h").alias("reviewer_hint"))
    return C.material_gate(v, B.attachments(spark, sf)).select("id", "todo_type", "need_review", "is_investment_policy", "reviewer_hint")


@query("cls_fallback_state", f"""WITH {VERDICT_SQL}, m AS (SELECT j.*, id IN (SELECT doc_id FROM labels) AS answered FROM judged j)
  SELECT id, CASE WHEN answered THEN 'rule' ELSE 'rule_fallback' END AS method, CASE WHEN answered THEN '' ELSE '未配置可用的大模型接口' END AS fallback_reason,
  CASE WHEN answered THEN todo_type ELSE 'system' END AS todo_type, answered AND need_review AS need_review,
  CASE WHEN NOT answered AND is_investment_policy = 'no' THEN 'pending' ELSE is_investment_policy END AS is_investment_policy,
  CASE WHEN answered THEN reviewer_hint ELSE concat_ws('；', nullif(reviewer_hint, ''), '未配置可用的大模型接口') END AS reviewer_hint FROM m""")
def fallback_state(spark, sf):
    answered = B.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return C.fallback_state(verdicts(spark, sf), answered).select(
        "id", "method", "fallback_reason", "todo_type", "need_review", "is_investment_policy", "reviewer_hint")


_CHUNKS_SQL = B.DOCS_SQL + """, chunks AS (SELECT id, lang, CAST(c AS INTEGER) AS chunk, greatest(ceil(length(content) / 500.0), 1)::INTEGER AS n_chunks, substr(content, c * 500 + 1, 500) AS body
  FROM (SELECT id, lang, content, unnest(range(0, greatest(ceil(length(content) / 500.0), 1)::BIGINT)) AS c FROM docs))"""


@query("cls_chunk_text", f"WITH {_CHUNKS_SQL} SELECT id, chunk, n_chunks, sha256(body) AS body, n_chunks > 24 AS truncated FROM chunks")
def chunk_text(spark, sf):
    return R.chunk_text(B.docs(spark, sf), 500, max_chunks=24).withColumn("body", X.sha256(F.col("body")))


@query("cls_evidence_coverage", f"""WITH {B.DOCS_SQL}, e AS (SELECT id, replace(lower(substr(title, 1, 60)), ' ', '') AS e, replace(replace(lower(substr(content, length(split_part(content, chr(10), 1)) + 1)), ' ', ''), chr(10), '') AS s FROM docs)
  SELECT id, round(CASE WHEN e = '' THEN 0 WHEN contains(s, e) THEN 1 WHEN length(e) < 4 THEN 0
    ELSE len(list_filter(list_transform(range(1, length(e) - 2), lambda i: substr(e, i, 4)), lambda g: contains(s, g)))::DOUBLE / (length(e) - 3) END, 6) AS coverage FROM e""")
def evidence_coverage(spark, sf):
    d = B.docs(spark, sf)
    rest = F.expr("substr(content, length(substring_index(content, '\n', 1)) + 1)")
    return d.select("id", F.round(R.evidence_coverage(F.substring("title", 1, 60), rest), 6).alias("coverage"))


def _responses(spark, sf):
    """Model answers derived from the chunks: one way of being right or wrong per language."""
    chunks = R.chunk_text(B.docs(spark, sf), 500).join(B.docs(spark, sf).select("id", "lang"), "id")
    quote = F.substring("body", 5, 40)
    proof = F.create_map(F.lit("guide"), quote, F.lit("access"), F.when(F.col("chunk") == 0, quote).otherwise("zzzz"))
    lang = F.col("lang")
    en = F.to_json(F.struct(F.lit("yes").alias("is_investment_policy"), F.lit("正式政策").alias("doc_type"), F.array(F.lit("guide"), F.lit("access")).alias("category"),
                            F.lit("why").alias("category_reason"), proof.alias("category_evidence"), quote.alias("evidence"), F.lit(False).alias("need_review"), F.lit(0.9).alias("confidence")))
    fr = F.to_json(F.struct(F.lit("no").alias("is_investment_policy"), F.array().cast("array<string>").alias("category"), quote.alias("evidence"),
                            F.lit(False).alias("need_review"), F.lit(0.5).alias("confidence")))
    de = F.to_json(F.struct(F.lit("maybe").alias("is_investment_policy"), F.lit("guide").alias("category"), F.lit("Buch").alias("doc_type"), F.lit("").alias("evidence"),
                            F.lit("yes").alias("need_review"), F.lit(True).alias("confidence")))
    es = F.to_json(F.struct(F.lit("pending").alias("is_investment_policy"), F.lit("征求意见稿").alias("doc_type"), F.lit("0000 1111 0000").alias("evidence"),
                            F.lit(True).alias("need_review"), F.lit(1.5).alias("confidence"), F.lit("look").alias("reviewer_hint")))
    body = F.when(lang == "en", en).when(lang == "fr", fr).when(lang == "de", de).otherwise(es)
    return chunks.select("id", "chunk", body.alias("body")), chunks.select("id", "chunk", "body")


_ANSWERS_SQL = _CHUNKS_SQL + """, q AS (SELECT *, substr(body, 5, 40) AS quote, trim(replace(substr(body, 5, 40), chr(10), ' ')) = '' AS blank,
  replace(replace(lower(substr(body, 5, 40)), ' ', ''), chr(10), '') AS nq, chunk = 0 OR contains(replace(replace(lower(body), ' ', ''), chr(10), ''), 'zzzz') AS proved FROM chunks),
answers AS (SELECT id, lang, chunk,
  CASE lang WHEN 'en' THEN 'yes' WHEN 'fr' THEN 'no' ELSE 'pending' END AS is_investment_policy,
  CASE lang WHEN 'en' THEN 'guide,access' ELSE '' END AS categories,
  CASE lang WHEN 'en' THEN '正式政策' WHEN 'es' THEN '征求意见稿' ELSE '其他' END AS doc_type,
  CASE lang WHEN 'en' THEN blank OR NOT proved ELSE true END AS need_review,
  CASE WHEN lang = 'en' AND NOT blank AND proved THEN 'none' ELSE 'review' END AS todo_type,
  CASE WHEN lang IN ('en', 'fr') AND NOT blank THEN quote ELSE '' END AS evidence,
  CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN 0.5 END AS confidence,
  CASE lang WHEN 'en' THEN concat_ws('；', CASE WHEN blank THEN '模型未提供原文证据，需人工核对' END, CASE WHEN blank THEN '引导类缺少可定位的独立证据' END, CASE WHEN blank OR NOT proved THEN '准入类缺少可定位的独立证据' END)
    WHEN 'fr' THEN CASE WHEN blank THEN '模型未提供原文证据，需人工核对' ELSE '' END
    WHEN 'de' THEN '相关性枚举无效；分类数组无效；文件类型无效；复核标志必须为布尔值；模型未提供原文证据，需人工核对'
    ELSE 'look；证据无法在原文定位；征求意见稿，须确认收录范围及效力状态' END AS reviewer_hint FROM q)"""


@query("cls_validate_responses", f"WITH {_ANSWERS_SQL} SELECT id, chunk, is_investment_policy, categories, doc_type, need_review, todo_type, evidence, confidence, reviewer_hint FROM answers")
def validate_responses(spark, sf):
    v = R.validate_responses(*_responses(spark, sf))
    return v.withColumn("categories", F.array_join("categories", ",")).drop("reason")


@query("cls_merge_chunks", f"""WITH {_ANSWERS_SQL} SELECT id, CASE WHEN bool_or(is_investment_policy = 'yes') THEN 'yes' WHEN bool_and(is_investment_policy = 'no') THEN 'no' ELSE 'pending' END AS is_investment_policy,
  max(categories) AS category, max(doc_type) AS doc_type, bool_or(need_review) OR max(lang) NOT IN ('en', 'fr') AS need_review, min(confidence) AS confidence FROM answers GROUP BY id""")
def merge_chunks(spark, sf):
    merged = R.merge_chunks(R.validate_responses(*_responses(spark, sf)))
    return merged.select("id", "is_investment_policy", "category", "doc_type", "need_review", "confidence")


@query("cls_review_status", f"""WITH {VERDICT_SQL} SELECT id, CASE WHEN need_review OR is_investment_policy = 'pending' THEN 'pending' WHEN is_investment_policy = 'no' THEN 'rejected' ELSE 'confirmed_auto' END AS review_status FROM judged""")
def review_status(spark, sf):
    return C.review_status(verdicts(spark, sf)).select("id", "review_status")


def _stored(spark, sf):
    flag = F.col("review_status")
    return B.policies(spark, sf).select(
        "id", "title", F.col("wenhao").alias("content"), "parse_error", "todo_type", "need_review", "review_status",
        F.when(flag == "confirmed", "rule_fallback").when(flag == "pending", "rule").otherwise("llm").alias("classification_method"),
        F.when(flag == "confirmed", "no answer").otherwise("").alias("fallback_reason"),
        F.when(flag == "pending", "pending").when(flag == "rejected", "no").otherwise("yes").alias("is_investment_policy"))


_STORED_SQL = B.POLICIES_SQL + ", " + B.ATTACHMENTS_SQL + """, st AS (SELECT *, CASE WHEN parse_error <> '' OR EXISTS (SELECT 1 FROM attachments a WHERE a.policy_id = p.id AND a.parsed_text = '') THEN 'material'
  WHEN review_status = 'confirmed' THEN 'system' WHEN review_status = 'pending' THEN 'scope' WHEN need_review = 1 THEN 'review' ELSE 'none' END AS new_todo FROM flagged p)"""


@query("cls_stored_todo", f"WITH {_STORED_SQL} SELECT id, todo_type, new_todo FROM st")
def stored_todo(spark, sf):
    return C.stored_todo(_stored(spark, sf), B.attachments(spark, sf)).select("id", "todo_type", "new_todo")


@query("cls_rejudge_shift", f"""WITH {_STORED_SQL}, rj AS (SELECT *, CASE WHEN review_status = 'pending' THEN CASE WHEN parse_error <> '' OR EXISTS (SELECT 1 FROM attachments a WHERE a.policy_id = st.id AND a.parsed_text = '' AND a.sha256 <> '' AND a.fmt <> 'zip')
     THEN 'material' ELSE 'none' END ELSE new_todo END AS nt, review_status = 'pending' OR new_todo <> todo_type AS ch FROM st)
  SELECT 'before' AS side, todo_type AS todo, count(*) AS n, count(*) FILTER (ch) AS rewritten FROM rj GROUP BY 2 UNION ALL SELECT 'after', nt, count(*), count(*) FILTER (ch) FROM rj GROUP BY 2""")
def rejudge_shift(spark, sf):
    return C.todo_shift(C.rejudge(_stored(spark, sf), B.attachments(spark, sf)))


@query("cls_model_retry_candidates", f"WITH {B.POLICIES_SQL} SELECT id FROM policies WHERE review_status = 'confirmed_auto'")
def model_retry_candidates(spark, sf):
    p = B.policies(spark, sf).withColumn("classification_method", F.when(F.col("review_status").isin("confirmed", "confirmed_auto"), "rule_fallback").otherwise("rule"))
    return C.model_retry_candidates(p).select("id")


@query("cls_classification_counts", """SELECT CASE lang WHEN 'en' THEN 'llm_classified' WHEN 'fr' THEN 'llm_fallback' ELSE 'rule_classified' END AS counter, count(*) AS n,
  CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(n_chars // 10) AS BIGINT) AS output_tokens FROM documents GROUP BY 1""")
def classification_counts(spark, sf):
    d = B.table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "llm").when(F.col("lang") == "fr", "rule_fallback").otherwise("rule").alias("method"),
        F.col("n_chars").alias("input_tokens"), F.floor(F.col("n_chars") / 10).alias("output_tokens"))
    return C.classification_counts(d)
