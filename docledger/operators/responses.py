"""Model answers checked against the source text (CLS-12 to CLS-15)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import text as X
from docledger.operators.library import CATEGORY_NAMES, mapped
from docledger.operators.rules import DOC_TYPES, JOIN, OTHER

LOW_CONFIDENCE = 0.8
MIN_COVERAGE = 0.6


def chunk_text(docs: DataFrame, size: int, text: str = "content", max_chunks: int | None = None) -> DataFrame:
    """Fixed-size character chunks of the whole text, at least one (CLS-12): id, chunk, n_chunks, body, truncated.

    Every chunk is emitted; `truncated` says that a caller limited to max_chunks will not read all of them.
    """
    n = F.greatest(F.ceil(F.length(X.text(text)) / F.lit(size)), F.lit(1)).cast("int")
    rows = docs.select("id", X.text(text).alias("_t"), n.alias("n_chunks")) \
        .select("id", "n_chunks", "_t", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    truncated = F.lit(False) if max_chunks is None else F.col("n_chunks") > max_chunks
    return rows.select("id", "chunk", "n_chunks", F.col("_t").substr(F.col("chunk") * size + 1, F.lit(size)).alias("body"), truncated.alias("truncated"))


def evidence_coverage(evidence: Column, source: Column, n: int = 4) -> Column:
    """1 if the evidence occurs in the source, else the share of its n-grams that do (CLS-15)."""
    # bound once as a struct: an expression inside the n-gram lambda would be evaluated per n-gram
    pair = F.array(F.struct(X.norm_text(evidence).alias("e"), X.norm_text(source).alias("s")))
    return F.get(F.transform(pair, lambda p: _coverage(p["e"], p["s"], n)), F.lit(0))


def _coverage(e: Column, s: Column, n: int) -> Column:
    size = F.length(e)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(e, i, n))
    share = F.size(F.filter(grams, lambda g: F.contains(s, g))) / F.greatest(size - (n - 1), F.lit(1))
    return F.when(size == 0, 0.0).when(F.contains(s, e), 1.0).when(size < n, 0.0).otherwise(share)


def _raw_type(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))


def validate_responses(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Check each answer (id, chunk, body JSON) against its chunk (CLS-14).

    Hard errors drop the classes and make the verdict pending; warnings keep it and ask for review.
    """
    rows = responses.withColumn("_v", F.try_parse_json("body")).join(
        chunks.select("id", "chunk", F.col("body").alias("_source")), ["id", "chunk"])

    def string(name):
        return F.try_variant_get("_v", f"$.{name}", "string")

    rows = rows.withColumn("_inv_raw", F.when(_raw_type(F.col("_v"), "$.is_investment_policy") == "STRING", string("is_investment_policy"))) \
        .withColumn("_cat_type", _raw_type(F.col("_v"), "$.category")) \
        .withColumn("_cats_raw", F.transform(F.try_variant_get("_v", "$.category", "array<variant>"), lambda c: F.when(
            F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.lit("?")))) \
        .withColumn("_type_raw", F.when(_raw_type(F.col("_v"), "$.doc_type") == "ABSENT", OTHER).otherwise(F.coalesce(string("doc_type"), F.lit("?")))) \
        .withColumn("_flag", F.when(_raw_type(F.col("_v"), "$.need_review") == "BOOLEAN", F.try_variant_get("_v", "$.need_review", "boolean"))) \
        .withColumn("_ev", F.when(_raw_type(F.col("_v"), "$.evidence") == "STRING", string("evidence"))) \
        .withColumn("_num", F.when(_raw_type(F.col("_v"), "$.confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get("_v", "$.confidence", "double")))
    none = F.array().cast("array<string>")
    bad_inv = ~F.coalesce(F.col("_inv_raw").isin("yes", "no", "pending"), F.lit(False))
    is_list = F.col("_cat_type").startswith("ARRAY")
    known = F.lit(list(CATEGORY_NAMES))
    bad_cats = ~((F.col("_cat_type") == "ABSENT") | (is_list & F.forall(F.coalesce("_cats_raw", none), lambda c: F.array_contains(known, c))))
    bad_type = ~F.col("_type_raw").isin(*DOC_TYPES.values(), OTHER)
    rows = rows.withColumn("_inv", F.when(bad_inv, "pending").otherwise(F.col("_inv_raw"))) \
        .withColumn("_cats", F.when(bad_cats, none).otherwise(F.array_distinct(F.coalesce("_cats_raw", none)))) \
        .withColumn("doc_type", F.when(bad_type, OTHER).otherwise(F.col("_type_raw"))) \
        .withColumn("_blank", X.strip(X.text("_ev")) == "") \
        .withColumn("_cover", evidence_coverage(F.col("_ev"), F.col("_source")))
    quotes = F.from_json(F.get_json_object("body", "$.category_evidence"), "map<string,string>")
    rows = rows.withColumn("_quotes", quotes).withColumn("_norm_source", X.norm_text(F.col("_source")))
    source = F.col("_norm_source")
    unproven = F.filter("_cats", lambda c: (X.strip(F.coalesce(F.col("_quotes")[c], F.lit(""))) == "")
                        | ~F.contains(source, X.norm_text(F.col("_quotes")[c])))
    unproven = F.when(F.col("_inv") == "yes", F.transform(unproven, lambda c: F.concat(mapped(c, CATEGORY_NAMES, c), F.lit("缺少可定位的独立证据")))).otherwise(none)
    lost = ~F.col("_blank") & (F.col("_cover") < MIN_COVERAGE)
    paraphrase = ~F.col("_blank") & (F.col("_cover") >= MIN_COVERAGE) & (F.col("_cover") < 1)
    percent = F.concat(F.lit("证据为改写引用（原文覆盖率 "), F.bround(F.col("_cover") * 100, 0).cast("int").cast("string"), F.lit("%），需人工核对"))
    rows = rows.withColumn("_errors", F.array_compact(F.array(
        F.when(bad_inv, "相关性枚举无效"), F.when(bad_cats, "分类数组无效"), F.when(bad_type, "文件类型无效"),
        F.when(F.col("_flag").isNull(), "复核标志必须为布尔值"), F.when(lost, "证据无法在原文定位"),
        F.when((F.col("_inv") == "yes") & (F.size("_cats") == 0), "相关政策未分类"),
        F.when((F.col("_inv") == "no") & (F.size("_cats") > 0), "非相关文件不应输出投资类别"))))
    rows = rows.withColumn("_unproven", unproven).withColumn("_warnings", F.concat(
        F.array_compact(F.array(F.when(F.col("_blank"), "模型未提供原文证据，需人工核对"), F.when(paraphrase, percent))), F.col("_unproven"),
        F.array_compact(F.array(F.when(F.col("doc_type") == "征求意见稿", "征求意见稿，须确认收录范围及效力状态")))))
    broken = F.size("_errors") > 0
    confidence = F.when((F.col("_num") >= 0) & (F.col("_num") <= 1), F.col("_num"))
    flag = F.coalesce("_flag", F.lit(True)) | F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(True)) | (F.size("_warnings") > 0)
    proof = F.array_join(F.transform(F.map_entries("_quotes"), lambda e: F.concat(X.json_string(e["key"]), F.lit(": "), X.json_string(e["value"]))), ", ")
    reason = F.concat(X.text(string("category_reason")), F.when(
        (F.coalesce(F.size("_quotes"), F.lit(0)) > 0) & (F.size("_unproven") == 0), F.concat(F.lit("；分类证据：{"), proof, F.lit("}"))).otherwise(""))
    hint = F.array_join(F.concat(F.array(X.text(string("reviewer_hint"))), F.col("_errors"), F.col("_warnings")), JOIN)
    return rows.withColumn("confidence", confidence).withColumn("_review", flag | broken).select(
        "id", "chunk", F.when(broken, "pending").otherwise(F.col("_inv")).alias("is_investment_policy"),
        F.when(broken, none).otherwise(F.col("_cats")).alias("categories"), "doc_type", F.col("_review").alias("need_review"),
        F.when(F.col("_review"), "review").when(F.col("_inv") == "pending", "scope").otherwise("none").alias("todo_type"),
        F.when(F.col("_blank") | lost, "").otherwise(F.col("_ev")).alias("evidence"), "confidence",
        reason.alias("reason"), F.regexp_replace(hint, "^；+|；+$", "").alias("reviewer_hint"))


def ordered_distinct(rows: DataFrame, value: str, sep: str) -> DataFrame:
    """Distinct non-blank values per id in first-chunk order, joined.

    The list is bounded by the chunks of one document, which all came out of one text cell.
    """
    first = rows.where(X.text(value) != "").groupBy("id", value).agg(F.min("chunk").alias("_at"))
    packed = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_at", value))).alias("_l"))
    return packed.select("id", F.array_join(F.transform("_l", lambda s: s[value]), sep).alias(value))


def merge_chunks(verdicts: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """One verdict per document from its chunk verdicts (CLS-13).

    Any yes is yes, all no is no, else pending; classes come from yes chunks in order of first
    appearance; disagreement or truncation asks for review; the lowest confidence counts.
    """
    inv = F.col("is_investment_policy")
    per = verdicts.groupBy("id").agg(
        F.bool_or(inv == "yes").alias("_yes"), F.bool_and(inv == "no").alias("_no"), F.bool_or(inv == "no").alias("_some_no"),
        F.bool_or("need_review").alias("_review"), F.min("confidence").alias("confidence"),
        F.min_by(F.when(F.col("doc_type") != OTHER, F.col("doc_type")), F.when(F.col("doc_type") != OTHER, F.col("chunk"))).alias("_type"))
    cats = verdicts.where(inv == "yes").select("id", "chunk", F.posexplode("categories").alias("p", "c")).groupBy("id", "c") \
        .agg(F.min(F.struct("chunk", "p")).alias("at"))
    cats = cats.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda s: s["c"]), ",").alias("category"))
    out = per.join(cats, "id", "left")
    for name, sep in (("reason", JOIN), ("reviewer_hint", JOIN), ("evidence", "\n")):
        if name in verdicts.columns:
            out = out.join(ordered_distinct(verdicts, name, sep), "id", "left").withColumn(name, X.text(name))
    out = out.join(truncated.select("id", F.col("truncated").alias("_cut")), "id", "left") if truncated is not None else out.withColumn("_cut", F.lit(False))
    cut = F.coalesce("_cut", F.lit(False))
    relevant = F.when(F.col("_yes"), "yes").when(F.col("_no") & ~cut, "no").otherwise("pending")
    split = F.col("_yes") & F.col("_some_no")
    if "reviewer_hint" in out.columns:
        out = out.withColumn("reviewer_hint", F.concat("reviewer_hint", F.when(split, "；不同段落相关性判断不一致，需整篇复核").otherwise(""),
                                                       F.when(cut, "；材料超过配置的分段上限，部分内容未分析").otherwise("")))
    review = cut | F.col("_review") | split | (~F.col("_yes") & ~F.col("_no"))
    return out.withColumn("is_investment_policy", relevant).withColumn("category", X.text("category")) \
        .withColumn("doc_type", F.coalesce("_type", F.lit(OTHER))).withColumn("need_review", review) \
        .withColumn("todo_type", F.when(review, "review").otherwise("none")).withColumn("input_truncated", cut) \
        .withColumn("method", F.lit("llm")).drop("_yes", "_no", "_some_no", "_review", "_type", "_cut")
