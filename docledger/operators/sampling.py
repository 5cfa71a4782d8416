"""Auditable sampling (EVA-8 to EVA-13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X

REVIEW_COLUMNS = ("relevant", "categories", "label_status", "reviewer", "reviewed_at", "note")


def candidate_pools(ledger: DataFrame, observations: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row per HTTPS URL (EVA-11): the ledger first, then filtered sightings, then reference rows never seen.

    Among ledger rows of a URL the newest id counts, among sightings and reference rows the first.
    """
    cols = ["page_url", "title", "source_name", "status"]
    fetched = ledger.select(*cols, F.lit(0).alias("_prio"), (-F.col("id")).alias("_ord"))
    filtered = observations.where("admitted = 0").withColumn("status", F.lit("list_filtered")) \
        .select(*cols, F.lit(1).alias("_prio"), F.col("seq").cast("long").alias("_ord"))
    rows = fetched.unionByName(filtered)
    if reference is not None:
        rows = rows.unionByName(reference.withColumn("status", F.lit("not_discovered")).select(*cols, F.lit(2).alias("_prio"), F.col("seq").cast("long").alias("_ord")))
    return skew.newest(rows.where(F.col("page_url").startswith("https://")), ["page_url"], [F.col("_prio"), F.col("_ord")]).drop("_prio", "_ord")


def stratified_sample(pool: DataFrame, limit: int, seed: str = "investment-audit-v1") -> DataFrame:
    """Deterministic round robin over stages (EVA-8): each stage in the order of sha256(seed + url)."""
    hashed = pool.withColumn("_h", X.sha256(F.concat(F.lit(seed), "page_url")))
    ranked = skew.newest(hashed, ["status"], [F.col("_h"), F.col("page_url")], limit, rank="turn")
    return ranked.orderBy("turn", "status").limit(limit).drop("_h")


def historical_flag(sample: DataFrame, known: DataFrame) -> DataFrame:
    """URL, number or title already known (EVA-10). Blank numbers and titles never match."""
    out = sample.withColumn("_number", X.normalized_label(F.col("wenhao"))).withColumn("_name", X.normalized_label(F.col("title")))
    flags = []
    sides = (("page_url", known.select("page_url")), ("_number", known.select(X.normalized_label(F.col("wenhao")).alias("_number"))),
             ("_name", known.select(X.normalized_label(F.col("title")).alias("_name"))))
    for column, side in sides:
        out = out.join(side.where(X.text(column) != "").distinct().withColumn(f"_in{column}", F.lit(True)), column, "left")
        flags.append(F.coalesce(f"_in{column}", F.lit(False)))
    return out.withColumn("historical", flags[0] | flags[1] | flags[2]).select(*sample.columns, "historical")


def split_holdout(sample: DataFrame, seed: str = "investment-audit-v1") -> DataFrame:
    """Family (number, title or URL) and split (EVA-9): history and four fifths of the families develop, the rest is held out."""
    family = X.first_filled(X.normalized_label(F.col("wenhao")), X.normalized_label(F.col("title")), F.col("page_url"))
    out = sample.withColumn("family", family)
    bucket = F.conv(F.substring(X.sha256(F.concat(F.lit(seed), "family")), 1, 8), 16, 10).cast("long") % 5
    return out.withColumn("split", F.when(F.col("historical") | (bucket != 0), "development").otherwise("holdout"))


def review_funnel(sample: DataFrame) -> DataFrame:
    """Where reviewed, relevant samples got lost (EVA-12)."""
    stage, inv = F.col("pipeline_stage"), F.col("is_investment_policy")
    outcome = F.when(stage == "not_discovered", "list_not_discovered").when(stage == "list_filtered", "list_filter_false_exclusion") \
        .when(stage.isin("discovered", "downloaded"), "queued_or_unfinished").when(~F.col("material_complete"), "material_failure") \
        .when((stage == "excluded") | (inv == "no"), "classification_false_exclusion").when(inv == "pending", "classification_pending").otherwise("relevant_retained")
    rows = sample.where((F.col("label_status") == "human_reviewed") & F.col("relevant"))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def frozen_sample_check(sample: DataFrame, manifest: DataFrame) -> DataFrame:
    """Samples added, removed, duplicated or altered since the manifest was frozen (EVA-13); empty if none."""
    fixed = [c for c in manifest.columns if c != "sample_id" and c not in REVIEW_COLUMNS]
    digest = X.sha256(F.to_json(F.struct(*fixed)))
    now = sample.withColumn("_d", digest).groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_d"))
    then = manifest.select("sample_id", digest.alias("_m"))
    problem = F.when(F.col("_m").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_n") > 1, "duplicated").when(F.col("_d") != F.col("_m"), "altered")
    return now.join(then, "sample_id", "full").select("sample_id", problem.alias("problem")).where("problem IS NOT NULL")


#: Sums of row hashes are taken modulo this, in two lanes.
LANE = 1 << 60


def _row_lanes(corpus: DataFrame) -> list[Column]:
    """Two 60-bit numbers from the hash of a row's fields in order of their names; null and empty differ."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = X.sha256(F.concat(*[part(c) for c in sorted(corpus.columns)]))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17)]


def _sums() -> list[Column]:
    """Count and lane sums; sums of parts add up to the sums of the whole, and a row that occurs twice counts twice."""
    return [F.count(F.lit(1)).alias("n"), *[(F.sum(F.col(lane).cast("decimal(20,0)")) % F.lit(LANE).cast("decimal(20,0)")).cast("long").alias(lane) for lane in ("low", "high")]]


def corpus_hash(corpus: DataFrame) -> DataFrame:
    """Order-free fingerprint of a multiset of rows (EVA-13): rows and the sums of their hashes."""
    low, high = _row_lanes(corpus)
    sums = corpus.select(low.alias("low"), high.alias("high")).agg(*_sums())
    return sums.select("n", F.concat_ws(":", F.lpad(F.lower(F.hex(F.coalesce("low", F.lit(0)))), 15, "0"), F.lpad(F.lower(F.hex(F.coalesce("high", F.lit(0)))), 15, "0")).alias("fingerprint"))


def range_sums(corpus: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Count and sums for each range of the key's hash (its first hex digits); ranges without rows are left out.

    A map-side aggregate: only 16**digits numbers leave a task. Sums of parts of a corpus are merged by `merged_sums`.
    """
    low, high = _row_lanes(corpus)
    name = F.substring(X.sha256(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits)
    return corpus.select(name.alias("range"), low.alias("low"), high.alias("high")).groupBy("range").agg(*_sums())


def merged_sums(*parts: DataFrame) -> DataFrame:
    """Sums of a corpus from the sums of its parts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    _, low, high = _sums()
    return rows.groupBy("range").agg(F.sum("n").alias("n"), low, high)


def range_tree(sums: DataFrame, digits: int = 2) -> DataFrame:
    """Ranges hashed upwards (EVA-13): range, n, digest of every level; the range "" is the whole corpus."""
    level = sums.select("range", "n", X.sha256(F.concat_ws(":", "n", "low", "high")).alias("digest"))
    out = level
    for size in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("range", 1, size).alias("up")).agg(
            F.sum("n").alias("n"), X.sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: F.concat(x["range"], x["digest"])), "")).alias("digest"))
        level = level.withColumnRenamed("up", "range")
        out = out.unionByName(level)
    return out


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranges whose rows differ between two tables of sums: range, n_before, n_after."""
    then = before.select("range", F.struct("n", "low", "high").alias("b"))
    now = after.select("range", F.struct("n", "low", "high").alias("a"))
    return then.join(now, "range", "full").where(~F.col("a").eqNullSafe(F.col("b"))) \
        .select("range", F.coalesce("b.n", F.lit(0)).alias("n_before"), F.coalesce("a.n", F.lit(0)).alias("n_after"))
