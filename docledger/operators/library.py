"""Library queries and reports (LIB)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X
from docledger.operators.identity import latest_version

# ---- fixed values of the ledger's vocabulary ----
CATEGORY_NAMES = {"guide": "引导类", "access": "准入类", "guarantee": "保障类", "incentive": "激励约束类"}
REVIEW_LABELS = {"pending": "待复核", "confirmed": "人工确认", "confirmed_auto": "模型通过", "adjusted": "已调整", "rejected": "已剔除"}
TODO_META = {  # type: (name, owner)
    "material": ("材料待补", "机器自修"), "system": ("系统待修", "运维处理"), "candidate": ("高置信候选", "业务抽检"),
    "review": ("结论待确认", "业务确认"), "scope": ("待定口径", "业务拍板"), "none": ("无需处理", "—")}
TODO_ORDER = ("material", "system", "candidate", "review", "scope")
HUMAN_QUEUES = ("review", "scope")
PAGE_SIZES = (20, 50, 100)
SORTABLE = {  # key: (column, default direction)
    "id": ("id", "desc"), "title": ("title", "asc"), "wenhao": ("wenhao", "asc"), "category": ("category_names", "asc"),
    "region": ("region", "asc"), "date": ("page_date", "desc"), "todo": ("todo_type", "asc")}
CENTRAL = ("国家", "中央", "全国")
SAMPLE_REGION = "样例"


def mapped(col: Column, values: dict, default: Column | None = None) -> Column:
    """Lookup in a fixed vocabulary as a CASE expression."""
    out = reduce(lambda acc, kv: acc.when(col == kv[0], kv[1]), values.items(), F)
    return out.otherwise(F.lit("") if default is None else default)


def policy_predicate(region="", category="", review_status="", todo="") -> Column:
    """The one predicate shared by list, count and export (LIB-1), on current versions."""
    out = F.lit(True)
    if todo:
        out = out & (F.col("todo_type") == todo)
    elif not review_status:
        out = out & (F.col("review_status") != "rejected")
    if region:
        out = out & (F.col("region") == region)
    if category:
        out = out & (X.like(F.col("category"), category) | X.like(F.col("category_names"), category))
    if review_status == "pending":
        out = out & ((F.col("review_status") == "pending") | (F.col("parse_requires_review") == 1))
    elif review_status:
        out = out & (F.col("review_status") == review_status)
    return out


def filter_policies(policies: DataFrame, attachments: DataFrame | None = None, keyword: str = "", **conditions) -> DataFrame:
    rows = latest_version(policies).where(policy_predicate(**conditions))
    return keyword_search(rows, attachments, keyword) if keyword else rows


def keyword_search(policies: DataFrame, attachments: DataFrame, keyword: str, wildcards: bool = True) -> DataFrame:
    """Keyword in title, body, number or the text of any attachment (LIB-2)."""
    inside = attachments.where(X.like(F.col("parsed_text"), keyword, wildcards)) \
        .select(F.col("policy_id").alias("id")).distinct().withColumn("_inside", F.lit(True))
    own = F.lit(False)
    for c in ("title", "content", "wenhao"):
        if c in policies.columns:
            own = own | X.like(F.col(c), keyword, wildcards)
    return policies.join(inside, "id", "left").where(own | F.col("_inside")).drop("_inside")


def attachment_excerpt(policies: DataFrame, attachments: DataFrame, keyword: str) -> DataFrame:
    """Name and surroundings (30 before, 70 after) of the first matching attachment, '' when none (LIB-3)."""
    # X.like may match a wildcard keyword that does not occur literally: the excerpt then starts at 0
    matching = attachments.where(X.like(F.col("parsed_text"), keyword) & (X.text("name") != ""))
    first = skew.newest(matching.select("policy_id", "id", "name", "parsed_text"), ["policy_id"], [F.col("id")])
    at = F.greatest(F.locate(keyword.lower(), F.lower("parsed_text")) - 1, F.lit(0))
    start = F.greatest(at - 30, F.lit(0))
    cut = F.col("parsed_text").substr(start + 1, at + len(keyword) + 70 - start)
    found = first.select(F.col("policy_id").alias("id"), F.col("name").alias("matched_attachment"), cut.alias("attachment_excerpt"))
    return policies.join(found, "id", "left") \
        .withColumn("matched_attachment", X.text("matched_attachment")).withColumn("attachment_excerpt", X.text("attachment_excerpt"))


def resolve_sort(sort: str = "", order: str = "") -> tuple[str, str]:
    key = sort.strip() if sort.strip() in SORTABLE else "id"
    direction = order.strip().lower()
    return key, direction if direction in ("asc", "desc") else SORTABLE[key][1]


def order_columns(sort: str = "", order: str = "") -> list[Column]:
    """Whitelisted order; blanks last in either direction, newest id breaks ties (LIB-4)."""
    key, direction = resolve_sort(sort, order)
    column = F.col(SORTABLE[key][0])
    ranked = column.asc() if direction == "asc" else column.desc()
    if key == "id":
        return [ranked]
    return [(column.isNull() | (column == "")).asc(), ranked, F.col("id").desc()]


def order_policies(policies: DataFrame, sort: str = "", order: str = "") -> DataFrame:
    return policies.orderBy(*order_columns(sort, order))


def page(policies: DataFrame, number: int = 1, size: int = 20, sort: str = "", order: str = "") -> DataFrame:
    """One page of the ordered list (LIB-5): sorted on narrow columns, wide columns joined to the page's rows."""
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    key = SORTABLE[resolve_sort(sort, order)[0]][0]
    narrow = policies.select(*dict.fromkeys(["id", key]))
    chosen = order_policies(narrow, sort, order).offset((max(number, 1) - 1) * size).limit(size)
    # at most 100 ids, so broadcasting them is bounded
    return policies.join(F.broadcast(chosen.select("id")), "id")


def count_rows(policies: DataFrame) -> DataFrame:
    return policies.agg(F.count(F.lit(1)).alias("total"))


def dashboard(policies: DataFrame, sources: DataFrame, ledger: DataFrame, runs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Fourteen counters as one row (LIB-7): one aggregate per table, joined as single rows."""
    todo = {f"todo_{t}": F.col("todo_type") == t for t in ("material", "review", "scope", "system")}
    counters = {
        "policies": F.col("review_status") != "rejected", "pending_review": F.col("need_review") == 1,
        "confirmed": F.col("review_status").isin("confirmed", "adjusted"), "rejected": F.col("review_status") == "rejected",
        **todo, "auto_confirmed": (F.col("todo_type") == "none") & (F.col("review_status") == "confirmed_auto")}
    columns = ["policy_key", "version", "id", "review_status", "need_review", "todo_type"]
    out = latest_version(policies.select(*columns)).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
    out = out.crossJoin(sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("enabled") == 1).alias("sources_enabled")))
    for name, df in (("fetches", ledger), ("runs", runs), ("attachments", attachments)):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return out


def region_overview(policies: DataFrame) -> DataFrame:
    """Current, non-rejected policies per region: totals, newest date, classes, review load (LIB-8)."""
    columns = ["policy_key", "version", "id", "region", "review_status", "page_date", "category", "need_review"]
    rows = latest_version(policies.select(*columns)).where("review_status != 'rejected'")
    return rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("total"), F.max("page_date").alias("latest_date"),
        *[F.count_if(F.contains("category", F.lit(c))).alias(c) for c in CATEGORY_NAMES],
        F.count_if(F.col("need_review") == 1).alias("todo")).orderBy(F.col("total").desc(), "region")


def central_local_split(overview: DataFrame) -> DataFrame:
    """Regions and policies per bucket: central, local, sample, unlabelled (LIB-9)."""
    region = X.text("region")
    bucket = F.when(region.isin(*CENTRAL), "central").when(region == SAMPLE_REGION, "sample") \
        .when(region == "", "unlabelled").otherwise("local")
    return overview.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("regions"), F.sum("total").alias("total"))


def _todo_rows(policies: DataFrame) -> DataFrame:
    columns = [c for c in ("policy_key", "version", "id", "title", "review_status", "todo_type") if c in policies.columns]
    return latest_version(policies.select(*columns)).where("review_status != 'rejected'")


def todo_overview(policies: DataFrame) -> DataFrame:
    """One cell per todo type in fixed order, zero-filled, with its owner (LIB-10)."""
    spark = policies.sparkSession
    cells = spark.createDataFrame([(i, k, *TODO_META[k]) for i, k in enumerate(TODO_ORDER)], "position INT, todo_type STRING, name STRING, owner STRING")
    counts = _todo_rows(policies).groupBy("todo_type").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, "todo_type", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("position")


def todo_totals(policies: DataFrame) -> DataFrame:
    """total, human, machine, system, clear (LIB-10)."""
    kind = F.col("todo_type")
    return _todo_rows(policies).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind.isin(*HUMAN_QUEUES)).alias("human"),
        F.count_if(kind == "material").alias("machine"), F.count_if(kind == "system").alias("system"), F.count_if(kind == "none").alias("clear"))


def todo_samples(policies: DataFrame) -> DataFrame:
    """Newest policy of each todo type (LIB-11)."""
    return _todo_rows(policies).where(F.col("todo_type").isin(*TODO_ORDER)).groupBy("todo_type") \
        .agg(F.max("id").alias("id"), F.max_by("title", "id").alias("title"))


def todo_lists(policies: DataFrame, k: int = 6) -> DataFrame:
    """Newest k policies of each todo type, rejected ones included as in the todo filter (LIB-12)."""
    rows = latest_version(policies).where(F.col("todo_type").isin(*TODO_ORDER))
    return skew.newest(rows, ["todo_type"], [F.col("id").desc()], k, rank="position")


def category_counts(policies: DataFrame) -> DataFrame:
    """Current, non-rejected policies per class combination, most common first (LIB-13)."""
    rows = latest_version(policies.select("policy_key", "version", "id", "review_status", "category_names"))
    name = X.first_filled(X.text("category_names"), F.lit("未分类"))
    return rows.where("review_status != 'rejected'").groupBy(name.alias("category_names")) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


def regions(policies: DataFrame) -> DataFrame:
    """Distinct non-empty regions of current, non-rejected policies (LIB-14)."""
    rows = latest_version(policies.select("policy_key", "version", "id", "review_status", "region"))
    return rows.where("review_status != 'rejected' AND region != ''").select("region").distinct().orderBy("region")


def policy_bundle(policies: DataFrame, children: dict[str, tuple[DataFrame, str]], size: int = 1000) -> DataFrame:
    """Everything known about each policy (LIB-15): (policy_id, kind, part, items as JSON texts).

    `children` maps a kind to (rows with policy_id, ordering column). Lists come in parts of `size`.
    """
    union = None
    for kind, (rows, order) in children.items():
        fields = [c for c in rows.columns if c != "policy_id"]
        one = rows.select("policy_id", F.lit(kind).alias("kind"), F.col(order).cast("long").alias("_o"), F.to_json(F.struct(*fields)).alias("item"))
        union = one if union is None else union.unionByName(one)
    union = union.join(policies.select(F.col("id").alias("policy_id")), "policy_id", "left_semi")
    out = skew.listed(union, ["policy_id", "kind"], [F.col("_o"), F.col("item")], skew.piece_of("_o"), ["item"], "items", size)
    return out.withColumn("items", F.transform("items", lambda s: s["item"]))


def list_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Registry in id order (LIB-16)."""
    return (sources.where("enabled = 1") if enabled_only else sources).orderBy("id")


def list_ledger(ledger: DataFrame, source_id=None, status: str = "", limit: int | None = None) -> DataFrame:
    """Ledger rows newest first (LIB-17); the first `limit` only where asked for."""
    rows = ledger if source_id is None else ledger.where(F.col("source_id") == source_id)
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.orderBy(F.col("id").desc())
    return rows if limit is None else rows.limit(limit)
