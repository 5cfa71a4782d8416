"""Human review of policies (OPS-8, OPS-9)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docledger.functions import text as X
from docledger.operators.library import CATEGORY_NAMES, mapped

STATUS = {"confirm": "confirmed", "adjust": "adjusted", "reject": "rejected"}


def apply_review(policies: DataFrame, actions: DataFrame):
    """Apply review actions (OPS-8). Returns (policies, events, refused actions).

    `actions`: policy_id, action, categories, note, created_at and, where given, action_id. The first valid action of
    a policy is applied (by created_at, then action_id, else the action itself); further ones are refused for the next
    batch. `policies` carries material_gap (MAT-8) and incomplete (MAT-7).
    """
    tie = F.col("action_id") if "action_id" in actions.columns else F.struct("action", X.text("note"))
    rows = actions.join(policies.select(F.col("id").alias("policy_id"), F.col("category").alias("_category")), "policy_id", "left")
    cats = F.array_distinct(F.coalesce("categories", F.array().cast("array<string>")))
    known = F.lit(list(CATEGORY_NAMES))
    bad_cats = (F.size(cats) == 0) | ~F.forall(cats, lambda c: F.array_contains(known, c))
    why = F.when(F.col("_category").isNull(), "政策不存在").when(~F.col("action").isin(*STATUS), "未知审核动作") \
        .when((F.col("action") == "adjust") & bad_cats, "请选择有效的政策分类") \
        .when((F.col("action") == "confirm") & (F.col("_category") == ""), "未分类政策请先调整分类后采纳").otherwise("")
    valid = rows.withColumn("why", why)
    valid = valid.withColumn("_ok", F.when(F.col("why") == "", 0).otherwise(1))
    ranked = valid.withColumn("_rank", F.row_number().over(W.partitionBy("policy_id", "_ok").orderBy("created_at", tie)))
    checked = ranked.withColumn("why", F.when((F.col("_ok") == 0) & (F.col("_rank") > 1), "同一批次已有该政策的审核动作").otherwise(F.col("why")))
    refused = checked.where("why != ''").select("policy_id", "action", "why")
    good = checked.where("why = ''").select(F.col("policy_id").alias("id"), F.col("action").alias("_action"), F.col("note").alias("_note"),
                                            F.col("created_at").alias("_at"), cats.alias("_cats"))
    both = policies.join(good, "id", "left")
    acted, reject = F.col("_action").isNotNull(), F.col("_action") == "reject"
    names = F.transform("_cats", lambda c: mapped(c, CATEGORY_NAMES, c))
    new = {
        "review_status": mapped(F.col("_action"), STATUS), "todo_type": F.when(reject, "none").when(F.col("incomplete"), "material").otherwise("none"),
        "need_review": F.lit(0), "parse_requires_review": F.col("material_gap").cast("int"), "is_investment_policy": F.when(reject, "no").otherwise("yes"),
        "category": F.when(F.col("_action") == "adjust", F.array_join("_cats", ",")).otherwise(F.col("category")),
        "category_names": F.when(F.col("_action") == "adjust", F.array_join(names, ",")).otherwise(F.col("category_names"))}
    columns = [c for c in policies.columns if c not in ("material_gap", "incomplete")]
    updated = {c: F.when(acted, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns}
    events = both.where(acted).select(
        F.col("id").alias("policy_id"), F.col("_action").alias("action"), F.to_json(F.struct(*columns)).alias("before_json"),
        F.to_json(F.struct(*[updated[c] for c in columns])).alias("after_json"), F.col("_note").alias("note"), F.col("_at").alias("created_at"))
    return both.select(*[updated[c] for c in columns]), events, refused


def review_history(events: DataFrame, policy_id=None) -> DataFrame:
    """Review events newest first (OPS-9)."""
    rows = events if policy_id is None else events.where(F.col("policy_id") == policy_id)
    return rows.orderBy("policy_id", F.col("created_at").desc())
