"""Incremental versions of the ledger operators on Structured Streaming (STR).

Inputs are file sources; a bounded number of cycles is trigger(availableNow=True), an interval is
trigger(processingTime=...). State survives restarts in each query's checkpoint location.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docledger.functions import skew, text as X
from docledger.operators import identity as I, pages as G, responses as R, rules as C
from docledger.operators.library import CATEGORY_NAMES, mapped
from docledger.operators.ruleset import DEFAULT, RuleSet
from docledger.sources import sinks as K


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def has_commits(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_commits")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def committed(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """Committed rows of a table; a batch that is run again must not see its own, so it reads those before it."""
    rows = K.read_committed(spark, root, name)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def current_policies(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Committed policies as they stand: a later batch's row of an id replaces the earlier ones."""
    return skew.newest(committed(spark, root, "policies", before), ["id"], [F.desc("batch_id")]).drop("batch_id")


def current_attachments(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Committed attachments as they stand: a later batch's rows of a policy replace all its earlier ones."""
    rows = committed(spark, root, "attachments", before)
    last = rows.groupBy("policy_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["policy_id", "batch_id"], "left_semi").drop("batch_id")


def library(spark: SparkSession, root: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keys and hashes of the current policies, and all links; empty before the first batch."""
    if not has_commits(spark, root):
        return spark.createDataFrame([], "id LONG, policy_key STRING, version LONG, content_sha256 STRING"), spark.createDataFrame([], "policy_id LONG, page_url STRING")
    policies = current_policies(spark, root, before).select("id", "policy_key", "version", "content_sha256")
    return policies, committed(spark, root, "policy_sources", before).select("policy_id", "page_url")


FAILED_EMPTY = "正文解析为空"
VARIANT_HINT = "同文号的其他来源内容不同，请核对转载或修订关系"
ATTACHMENT = "policy_id LONG, id LONG, name STRING, url STRING, sha256 STRING, parse_status STRING, parsed_text STRING, error STRING"


#: Characters of a chunk that a model answers for.
CHUNK_SIZE = 10_000
JUDGED_BY = ["classification_method", "fallback_reason"]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Documents of fetched pages under the page's id; a page without a title gets one that says so."""
    return G.parse_pages(pages.withColumn("raw_page_sha256", X.sha256(F.col("html")))).withColumn("id", F.col("page_id")).withColumn("title", X.first_filled(X.text("title"), F.lit("待核实标题")))


def model_verdicts(texts: DataFrame, answers: DataFrame, rules: RuleSet = DEFAULT, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Verdict of each document (id, title, content, parse_error, analysis_text): merged from its checked answers (id, chunk,
    body), else by the rules and marked as fallback (CLS-11 to CLS-14)."""
    chunks = R.chunk_text(texts.join(answers.select("id").distinct(), "id", "left_semi"), chunk_size, "analysis_text")
    merged = skew.pinned(R.merge_chunks(R.validate_responses(answers, chunks)))
    ruled = C.fallback_state(C.classify(texts.join(merged.select("id"), "id", "left_anti"), rules, "analysis_text"), merged.select("id"))
    names = F.array_join(F.transform(F.filter(F.split("category", ","), lambda k: k != ""), lambda k: mapped(k, CATEGORY_NAMES, k)), ",")
    said = texts.join(merged.withColumn("category_names", names).withColumn("fallback_reason", F.lit("")), "id")
    columns = [*texts.columns, *C.VERDICT, "method", "fallback_reason"]
    return ruled.select(*columns).unionByName(said.select(*columns))


def judged_pages(pages: DataFrame, attachments: DataFrame, rules: RuleSet, answers: DataFrame | None = None, chunk_size: int = CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """Fetched pages to documents with verdict, gate and fingerprint, and the pages that gave none with the reason.

    `attachments` carry the page id as policy_id. Analysed is the body with the attachment texts (EXT-10).
    """
    docs = skew.pinned(parsed_pages(pages))
    own = skew.pinned(attachments.join(docs.select(F.col("id").alias("policy_id")), "policy_id", "left_semi"))
    with_files = own.select(F.col("policy_id").alias("id")).distinct().withColumn("_files", F.lit(True))
    rows = docs.join(with_files, "id", "left").withColumn("_empty", (X.strip(X.text("content")) == "") & F.col("_files").isNull())
    failed = rows.where("_empty").select("id", "page_url", X.first_filled(X.text("parse_error"), F.lit(FAILED_EMPTY)).alias("reason"))
    docs = I.content_fingerprint(I.policy_key(rows.where("NOT _empty").drop("_empty", "_files")), own)
    texts = G.analysis_text(docs, own).select("id", "title", "content", "parse_error", "analysis_text")
    if answers is None:
        verdict = C.classify(texts, rules, "analysis_text").withColumn("fallback_reason", F.lit(""))
    else:
        verdict = model_verdicts(skew.pinned(texts), answers, rules, chunk_size)
    gated = C.review_status(C.material_gate(verdict, own)).withColumnRenamed("method", "classification_method").withColumn("analysis_sha256", X.sha256(F.col("analysis_text")))
    return docs.join(gated.select("id", "analysis_sha256", *C.VERDICT, *JUDGED_BY, "review_status"), "id"), failed


#: What a stored policy keeps of its page's extraction, and what of its verdict.
EXTRACTED = ["content", "content_sha256", "analysis_sha256", "parse_error", "raw_page_sha256"]
JUDGED = [*C.VERDICT, *JUDGED_BY, "review_status"]
KEPT_VERSION = "附件下载失败，保留已有政策版本并等待补采"


def refetched(docs: DataFrame, files: DataFrame, root: str, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages whose URL belongs to a stored policy and that show the same original again (VER-12 to VER-14).

    Returns what became of them (id, page_url, outcome, reason), the policies to replace, their attachments to replace and
    the review events. The same original makes no version: the better of both extractions stays, blank metadata are
    filled, and a row that a human decided keeps its decision and takes the content only. Of several such pages of one
    policy in a batch the last one counts, the others are duplicates. A page that is another original but misses an
    attachment fails and leaves the stored version alone.
    """
    spark = docs.sparkSession
    old, links = current_policies(spark, root, batch_id), library(spark, root, batch_id)[1]
    linked = I.policy_for_url(links, old).select("page_url", F.col("policy_id"))
    own_hash = old.select(F.col("id").alias("policy_id"), F.col("raw_page_sha256").alias("_raw"), F.col("content_sha256").alias("_hash"))
    pages = skew.pinned(docs.join(linked, "page_url").join(own_hash, "policy_id")
                        .withColumn("_again", (F.col("raw_page_sha256") == F.col("_raw")) | (F.col("content_sha256") == F.col("_hash"))).drop("_raw", "_hash"))
    again = pages.where("_again")
    last = skew.pinned(again.groupBy("policy_id").agg(F.max("id").alias("id")))
    new = skew.pinned(again.join(last, ["policy_id", "id"], "left_semi"))
    old = skew.pinned(old.join(new.select(F.col("policy_id").alias("id")), "id", "left_semi"))
    by_policy = new.select(F.col("id").alias("_page"), "policy_id")
    new_files = files.withColumnRenamed("policy_id", "_page").join(by_policy, "_page").drop("_page")
    old_files = current_attachments(spark, root, batch_id).join(old.select(F.col("id").alias("policy_id")), "policy_id", "left_semi")
    fresh = new.drop("id").withColumnRenamed("policy_id", "id")
    same, kept = I.reconcile_same_original(old, fresh, old_files, new_files)
    same = skew.pinned(same.where("same_original").select("id", "changed", F.col("content").alias("_content"), F.col("parse_error").alias("_error")))
    better = fresh.join(same, "id").withColumn("content_sha256", F.when(F.col("content") == F.col("_content"), F.col("content_sha256"))) \
        .join(old.select("id", F.col("content_sha256").alias("_hash")), "id").withColumn("content_sha256", F.coalesce("content_sha256", "_hash")) \
        .withColumn("content", F.col("_content")).withColumn("parse_error", F.col("_error"))
    changed = skew.pinned(better.where("changed").select("id", "changed", *EXTRACTED, *I.METADATA, *JUDGED))
    refreshed, reparses = I.refresh_analysis(old.join(changed.select("id"), "id", "left_semi"), changed)
    filled, fills = I.backfill_metadata(old.join(same.where("NOT changed").select("id"), "id", "left_semi"), better)
    fills = skew.pinned(fills)
    rows = refreshed.unionByName(filled.join(fills.select(F.col("policy_id").alias("id")), "id", "left_semi"))
    moved = new_files.drop(*I.ATTACHMENT_STATE).join(kept, ["policy_id", "url"]).join(changed.select(F.col("id").alias("policy_id")), "policy_id", "left_semi")
    ended = again.join(same.select(F.col("id").alias("policy_id"), "changed"), "policy_id").join(last.withColumnRenamed("id", "_last"), "policy_id") \
        .select("id", "page_url", F.when(F.col("changed") & (F.col("id") == F.col("_last")), "reparsed").otherwise("duplicate").alias("outcome"), F.lit("").alias("reason"))
    lost = files.where(F.col("parse_status") == "failed").select(F.col("policy_id").alias("id")).distinct()
    failed = pages.join(ended.select("id"), "id", "left_anti").join(lost, "id", "left_semi").select("id", "page_url", F.lit("failed").alias("outcome"), F.lit(KEPT_VERSION).alias("reason"))
    return skew.pinned(ended.unionByName(failed)), rows, moved.select(*files.columns), reparses.unionByName(fills)


def speaking_order(docs: DataFrame) -> DataFrame:
    """Column `turn`: 1 for the page that speaks first for its URL in a batch, the first eligible one by id (without any, the
    first one), and 2 for all others. The aggregate is written before it is joined, so that a URL with very many pages is dealt
    over several tasks."""
    speaker = skew.pinned(docs.groupBy("page_url").agg(F.min(F.struct((~F.col("eligible")).alias("last"), F.col("id").alias("id"))).alias("s")).select("page_url", F.col("s.id").alias("_speaker")))
    return docs.join(speaker, "page_url").withColumn("turn", F.when(F.col("id") == F.col("_speaker"), 1).otherwise(2)).drop("_speaker")


def decided_batch(docs: DataFrame, policies: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions (VER-5 to VER-7) for all pages of a batch in two passes, however often a URL repeats.

    The speakers of all URLs go first and tie each URL to a key. In the second pass every page belongs to the key of its URL:
    the first eligible page of a (key, hash) in id order is stored, versions follow in that order, the rest are repeats.
    """
    done = None
    for turn in (1, 2):
        now = docs.where(F.col("turn") == turn).select("id", "page_url", "policy_key", "content_sha256", "arrival", "eligible")
        decided = skew.pinned(I.variant_key(I.dedup_decision(now, policies, links)))
        fresh = decided.where("decision IN ('ingested', 'updated', 'suspected_duplicate')")
        policies = policies.unionByName(fresh.select("id", "policy_key", "version", "content_sha256"))
        # repeats of a document of this batch find it by key and hash
        match = skew.pinned(policies.groupBy("policy_key", "content_sha256").agg(F.max_by("id", "version").alias("_same")))
        repeats = decided.where("decision = 'duplicate_skip'").join(match, ["policy_key", "content_sha256"], "left") \
            .withColumn("matched_id", F.coalesce("matched_id", "_same")).drop("_same")
        decided = repeats.unionByName(decided.where("decision <> 'duplicate_skip'"))
        links = links.unionByName(repeats.select(F.col("matched_id").alias("policy_id"), "page_url")) \
            .unionByName(fresh.select(F.col("id").alias("policy_id"), "page_url"))
        done = decided if done is None else done.unionByName(decided)
    return done


def ingest_batch(root: str, rules: RuleSet = DEFAULT, attachments: DataFrame | None = None, chunk_size: int = CHUNK_SIZE):
    """foreachBatch function: fetched pages (page_id, page_url, html, source_name) to the stored ledger (STR-1, STR-6).

    Every page gets one ledger row with its outcome and reason: failed, excluded, duplicate, suspected_duplicate,
    updated or ingested. The verdict and the material gate come first; only documents that are kept found keys and
    take versions. Several pages of one URL in a batch are taken in order of their ids, after the first pages of all
    URLs that can be kept (`speaking_order`). Suspected duplicates and new versions wait for review whatever the verdict.
    Hashes are looked up among all stored versions, so a late repost of old content never becomes a new current version.
    A repeated batch id rewrites the same partitions.

    Pages that show a stored original again refresh its row and make no version (`refetched`); their outcome is reparsed or
    duplicate. `current_policies` reads the rows as they stand.

    With `answers` (id, chunk, body) pages are judged by their model answers, and pages that have none fall back on the
    rules (CLS-11 to CLS-14).
    """
    def ingest(pages: DataFrame, batch_id: int, answers: DataFrame | None = None) -> None:
        spark = pages.sparkSession
        files = spark.createDataFrame([], ATTACHMENT) if attachments is None else attachments
        docs, failed = judged_pages(pages, files, rules, answers, chunk_size)
        docs = skew.pinned(docs.withColumn("arrival", F.col("page_id")).withColumn("eligible", F.col("is_investment_policy") != "no"))
        failed = skew.pinned(failed).select("id", "page_url", F.lit("failed").alias("outcome"), "reason")
        refreshed = replaced = None
        events = spark.createDataFrame([], "policy_id LONG, action STRING, before_json STRING, after_json STRING")
        if has_commits(spark, root):
            refreshed, replaced, moved, events = refetched(docs, files, root, batch_id)
            docs = skew.pinned(docs.join(refreshed.select("id"), "id", "left_anti"))
            failed = failed.unionByName(refreshed)
        done = decided_batch(skew.pinned(speaking_order(docs.select("id", "page_url", "policy_key", "content_sha256", "arrival", "eligible"))), *library(spark, root, batch_id))
        own = docs.select("id", "title", *EXTRACTED[:1], *EXTRACTED[2:], *I.METADATA, *JUDGED)
        rows = skew.pinned(done.join(own, "id"))
        suspected, again = F.col("decision") == "suspected_duplicate", F.col("decision") == "updated"
        stored = rows.where("decision IN ('ingested', 'updated', 'suspected_duplicate')").withColumns({
            "need_review": F.col("need_review") | suspected | again,
            "review_status": F.when(suspected | again, "pending").otherwise(F.col("review_status")),
            "reviewer_hint": F.when(suspected, C.join_filled(C.JOIN, F.col("reviewer_hint"), F.lit(VARIANT_HINT))).otherwise(F.col("reviewer_hint"))})
        linked = rows.where("decision = 'duplicate_skip'").select(F.col("matched_id").alias("policy_id"), "page_url") \
            .unionByName(stored.select(F.col("id").alias("policy_id"), "page_url"))
        outcome = F.when(F.col("decision") == "duplicate_skip", "duplicate").otherwise(F.col("decision"))
        reason = F.when(F.col("decision") == "excluded", F.col("reason")).otherwise(X.text("parse_error"))
        ledger = rows.select("id", "page_url", outcome.alias("outcome"), reason.alias("reason")) \
            .unionByName(failed)
        policies = stored.select("id", "policy_key", "version", "page_url", "title", *EXTRACTED, *I.METADATA, "related_policy_key", *JUDGED)
        own_files = files.join(stored.select(F.col("id").alias("policy_id")), "policy_id", "left_semi").select(*files.columns)
        if refreshed is not None:
            policies, own_files = policies.unionByName(replaced), own_files.unionByName(moved)
        K.store_batch(root, batch_id, {"policies": policies, "attachments": own_files, "policy_sources": linked.distinct(), "fetch_records": ledger, "review_events": events})
    return ingest


def ingest_stream(pages: DataFrame, root: str, checkpoint: str, rules: RuleSet = DEFAULT, attachments: DataFrame | None = None, **trigger):
    """Start the ingestion of a page stream (STR-1)."""
    return pages.writeStream.foreachBatch(ingest_batch(root, rules, attachments)).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def first_sightings_batch(root: str):
    """foreachBatch function: first sighting of each (source_id, page_url) with its time (STR-2).

    Seen keys are a table, so a key is first seen once however late it comes again; a repeated batch id rewrites
    its own partition.
    """
    def note(observations: DataFrame, batch_id: int) -> None:
        spark = observations.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        first = observations.groupBy("source_id", "page_url").agg(F.min("observed_at").alias("observed_at"))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            seen = spark.read.parquet(root).where(F.col("batch") < batch_id)
            first = first.join(seen, ["source_id", "page_url"], "left_anti")
        first.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return note


def newest_observations(observations: DataFrame) -> DataFrame:
    """Attributes of the newest sighting of each (source, URL), update mode (STR-2)."""
    return observations.groupBy("source_id", "page_url").agg(F.max_by(F.struct("title", "admitted", "reason"), "observed_at").alias("o"), F.max("observed_at").alias("observed_at")) \
        .select("source_id", "page_url", "o.*", "observed_at")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """Current attempt of each (fetch, URL), update mode (STR-4)."""
    return attempts.groupBy("fetch_id", "url").agg(F.max_by(F.struct("download_status", "parse_status", "error"), "id").alias("a"), F.max("id").alias("id")) \
        .select("fetch_id", "url", "id", "a.*")


def run_progress(events: DataFrame) -> DataFrame:
    """Live counts by run, action and status, update mode (STR-5)."""
    return events.groupBy("run_id", "action", "status").agg(F.count(F.lit(1)).alias("n"))


# a fetch may retry after a failure; processed and excluded rows can be checked again
ALLOWED = {None: ("discovered",), "discovered": ("downloaded", "failed"), "downloaded": ("processed", "excluded", "failed"), "failed": ("downloaded", "failed"),
           "processed": ("downloaded", "failed"), "excluded": ("downloaded", "failed")}
STATES = (None, "discovered", "downloaded", "failed", "processed", "excluded")
#: Events of one key that one task composes; longer histories are composed piece by piece.
LIFE_PIECE = 10_000


def _event_map(status: Column) -> Column:
    """What an event does from each state: [(state after it, steps taken, steps refused), ...] by number of the state before."""
    def entry(i, state):
        out = F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("steps"), F.lit(1).cast("long").alias("refused"))
        for j, after in enumerate(STATES):
            if after in ALLOWED[state]:
                out = F.when(status == after, F.struct(F.lit(j).alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("refused"))).otherwise(out)
        return out
    return F.array(*[entry(i, s) for i, s in enumerate(STATES)])


def _composed(maps: Column) -> Column:
    """One map for a list of maps in order: each entry goes on from where the map before it led."""
    start = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("refused")) for i in range(len(STATES))])

    def after(done, nxt):
        return F.transform(done, lambda e: F.struct(F.get(nxt, e["to"])["to"].alias("to"), (e["steps"] + F.get(nxt, e["to"])["steps"]).alias("steps"),
                                                    (e["refused"] + F.get(nxt, e["to"])["refused"]).alias("refused")))
    return F.aggregate(maps, start, after)


def life_maps(events: DataFrame, piece: int = LIFE_PIECE) -> DataFrame:
    """fetch_id, first id, last id and the composed map of its events (id, fetch_id, status), each id once.

    Maps compose, so the events of a key are composed per piece of ids first and then piece by piece; a hot key is
    spread over as many tasks as it has pieces.
    """
    once = events.groupBy("fetch_id", "id").agg(F.min("status").alias("status"))
    ordered = lambda *v: F.transform(F.array_sort(F.collect_list(F.struct(*v))), lambda x: x["map"])
    part = once.select("fetch_id", "id", F.floor(F.col("id") / piece).alias("piece"), _event_map(F.col("status")).alias("map"))
    part = part.groupBy("fetch_id", "piece").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), ordered("id", "map").alias("maps"))
    part = part.withColumn("map", _composed(F.col("maps"))).drop("maps")
    whole = part.groupBy("fetch_id").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), ordered("piece", "map").alias("maps"))
    return whole.withColumn("map", _composed(F.col("maps"))).drop("maps")


def lifecycle(events: DataFrame) -> DataFrame:
    """State machine per ledger row (STR-3): fetch_id, status, steps, refused after all its events in id order."""
    entry = F.get("map", F.lit(0))
    return life_maps(events).select("fetch_id", F.get(F.array(*[F.lit(s).cast("string") for s in STATES]), entry["to"]).alias("status"), entry["steps"].alias("steps"), entry["refused"].alias("refused"))


def lifecycle_batch(root: str):
    """foreachBatch function for lifecycle on a stream: the state of a key is its composed map so far.

    Each batch writes the keys it touched as state version batch_id; ids up to a key's last one are left out, so
    repeated deliveries and a repeated batch change nothing.
    """
    def advance(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = events
        if known:
            before = spark.read.parquet(root).where(F.col("batch") < batch_id)
            state = before.groupBy("fetch_id").agg(F.max_by(F.struct("first_id", "last_id", "map"), "batch").alias("s"))
            fresh = events.join(state.select("fetch_id", F.col("s.last_id").alias("_last")), "fetch_id", "left").where("_last IS NULL OR id > _last").drop("_last")
        new = life_maps(fresh)
        if known:
            both = new.join(state, "fetch_id", "left")
            new = both.select("fetch_id", F.coalesce("s.first_id", "first_id").alias("first_id"), "last_id",
                              F.when(F.col("s").isNull(), F.col("map")).otherwise(_composed(F.array("s.map", "map"))).alias("map"))
        new.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return advance


def lifecycle_state(spark: SparkSession, root: str) -> DataFrame:
    """fetch_id, status, steps, refused from the newest state of each key."""
    s = spark.read.parquet(root).groupBy("fetch_id").agg(F.max_by("map", "batch").alias("map"))
    entry = F.get("map", F.lit(0))
    return s.select("fetch_id", F.get(F.array(*[F.lit(x).cast("string") for x in STATES]), entry["to"]).alias("status"), entry["steps"].alias("steps"), entry["refused"].alias("refused"))
