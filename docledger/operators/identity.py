"""Identity, deduplication and versions of documents (VER)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X

HUMAN_DECIDED = ("confirmed", "adjusted", "rejected")
METADATA = ("wenhao", "page_date", "doc_date", "issuing_authority")
ATTACHMENT_STATE = ("sha256", "parsed_text", "parse_status")


def policy_key(docs: DataFrame) -> DataFrame:
    """Add policy_key, key_source and title_norm (VER-1, VER-2).

    A document number identifies across sites, with brackets unified and the year kept; a bare
    notice number is prefixed by its issuer. Without a number: issuer and title, else the URL hash.
    """
    issuer = X.first_filled(X.text("issuing_authority"), X.text("source_name"))
    number = X.without_space(X.nfkc(X.text("wenhao")))
    number = F.regexp_replace(F.regexp_replace(number, r"[\[【(]", "〔"), r"[\]】)]", "〕")
    number = F.when(number.rlike("^(公告|通知|令)〔"), F.concat(issuer, F.lit(":"), number)).otherwise(number)
    out = docs.withColumn("title_norm", X.norm_title(F.col("title")))
    by_title = F.when(F.col("title_norm") == "", X.sha256(X.text("page_url"))) \
        .otherwise(F.concat(issuer, F.lit(":"), F.col("title_norm")))
    numbered = X.text("wenhao") != ""
    return out.withColumn("policy_key", F.when(numbered, number).otherwise(by_title)) \
        .withColumn("key_source", F.when(numbered, "wenhao").otherwise("title"))


def fingerprint_text(content: Column, hashes: Column) -> Column:
    """JSON text `[body, [hash, ...]]` spaced as Python's json.dumps writes it."""
    listed = F.array_join(F.transform(hashes, X.json_string), ", ")
    return F.concat(F.lit("["), X.json_string(X.without_space(content)), F.lit(", ["), listed, F.lit("]]"))


def content_fingerprint(docs: DataFrame, attachments: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Add content_sha256 over the body without white space and the sorted distinct attachment hashes (VER-3).

    Hashes are sorted per (document, first two characters) and those pieces joined in order, so the sort of a
    document with very many attachments is spread; the value is the same at every size.
    """
    if attachments is None:
        return docs.withColumn("content_sha256", X.sha256(fingerprint_text(X.text("content"), F.array().cast("array<string>"))))
    hashed = attachments.select(F.col("policy_id").alias(key), F.when(X.text("sha256") != "", F.col("sha256"))
                                .otherwise(F.concat(F.lit("missing:"), X.text("url"))).alias("h")).distinct()
    pieces = hashed.groupBy(key, F.substring("h", 1, 2).alias("piece")).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    per_doc = pieces.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "hs"))), lambda p: p["hs"])).alias("_hashes"))
    none = F.array().cast("array<string>")
    return docs.join(per_doc, key, "left").withColumn(
        "content_sha256", X.sha256(fingerprint_text(X.text("content"), F.coalesce("_hashes", none)))).drop("_hashes")


def latest_version(policies: DataFrame) -> DataFrame:
    """Rows holding the highest version of their key (VER-4)."""
    return skew.newest(policies, ["policy_key"], [F.col("version").desc(), F.col("id").desc()])


def policy_for_url(links: DataFrame, policies: DataFrame) -> DataFrame:
    """Newest policy linked to each URL (VER-11): page_url, policy_id, policy_key."""
    newest = links.groupBy("page_url").agg(F.max("policy_id").alias("policy_id"))
    keys = policies.select(F.col("id").alias("policy_id"), "policy_key")
    return newest.join(keys, "policy_id").select("page_url", "policy_id", "policy_key")


def dedup_decision(incoming: DataFrame, library: DataFrame, links: DataFrame) -> DataFrame:
    """Decide each incoming document against the library and the rest of its batch (VER-5, VER-6, STR-6).

    `incoming`: page_url (one row per URL), policy_key, content_sha256, arrival; a column `eligible` (default
    true) is false for documents that will not be stored: they found no key and take no version, and are
    `excluded` unless they repeat a stored one.
    The hash is looked up among all versions of a key, so a late repost of old content never
    rolls the key back. Rows of one batch see each other in arrival order: the first new row of an
    unknown key founds it, rows from URLs already linked to a key append versions, any other URL
    with different content under a known key is a suspected duplicate.
    """
    origin = policy_for_url(links, library).select("page_url", F.col("policy_key").alias("origin_key"))
    stays = F.col("eligible") if "eligible" in incoming.columns else F.lit(True)
    rows = incoming.join(origin, "page_url", "left") \
        .withColumn("policy_key", F.coalesce("origin_key", "policy_key")).withColumn("_stays", stays)
    heads = library.groupBy("policy_key").agg(F.max("version").alias("lib_version"), F.max_by("id", "version").alias("lib_id"))
    same = library.groupBy("policy_key", "content_sha256").agg(
        F.max("version").alias("same_version"), F.max_by("id", "version").alias("same_id"))
    # read three times below: keep the narrow joined rows instead of joining again
    rows = skew.pinned(rows.join(heads, "policy_key", "left").join(same, ["policy_key", "content_sha256"], "left"))
    # written before they are joined: an aggregate of the same key would keep its exchange, which the skew split can't cut
    founders = skew.pinned(rows.where("lib_version IS NULL AND _stays").groupBy("policy_key").agg(F.min("arrival").alias("founded_at")))
    rows = rows.join(founders, "policy_key", "left").withColumn(
        "adds", F.col("_stays") & F.col("same_version").isNull() & F.when(F.col("lib_version").isNull(),
                                                        F.coalesce(F.col("arrival") == F.col("founded_at"), F.lit(False)))
        .otherwise(F.col("origin_key").isNotNull()))
    first = skew.pinned(rows.where("adds").groupBy("policy_key", "content_sha256").agg(F.min("arrival").alias("first_at")))
    rows = rows.join(first, ["policy_key", "content_sha256"], "left").withColumn(
        "repeat", F.col("same_version").isNotNull() | F.coalesce(F.col("first_at") < F.col("arrival"), F.lit(False)))
    decision = F.when(F.col("repeat"), "duplicate_skip").when(~F.col("_stays"), "excluded") \
        .when(F.col("adds") & F.col("lib_version").isNull(), "ingested") \
        .when(F.col("adds"), "updated").otherwise("suspected_duplicate")
    rows = rows.withColumn("decision", decision)
    new = skew.numbered(rows.where("decision IN ('ingested', 'updated')"), ["policy_key"], [F.col("arrival")],
                        skew.piece_of("arrival"), "_step") \
        .select("policy_key", "content_sha256",
                (F.coalesce("lib_version", F.lit(0)) + F.col("_step")).alias("new_version"))
    rows = rows.join(new, ["policy_key", "content_sha256"], "left")
    version = F.when(F.col("decision") == "suspected_duplicate", F.lit(1)).when(F.col("decision") == "excluded", F.lit(None)) \
        .otherwise(F.coalesce("same_version", "new_version")).cast("long")
    return rows.withColumn("version", version).withColumn(
        "matched_id", F.when(F.col("decision") == "duplicate_skip", F.col("same_id"))
        .when(~F.col("decision").isin("ingested", "excluded"), F.col("lib_id"))) \
        .select(*incoming.columns, "origin_key", "decision", "version", "matched_id")


def append_version(batch: DataFrame, library: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Version = previous maximum + 1; several new rows of a key number consecutively (VER-6)."""
    heads = library.groupBy("policy_key").agg(F.max("version").alias("_prev"))
    stepped = skew.numbered(batch, ["policy_key"], [F.col(arrival)], skew.piece_of(arrival), "_step")
    return stepped.join(heads, "policy_key", "left") \
        .withColumn("version", (F.coalesce("_prev", F.lit(0)) + F.col("_step")).cast("long")).drop("_prev", "_step")


def variant_key(decisions: DataFrame) -> DataFrame:
    """Suspected duplicates live under their own key, point at the original and need review (VER-7)."""
    suspected = F.col("decision") == "suspected_duplicate"
    variant = F.concat("policy_key", F.lit(":variant:"), F.substring(X.sha256(F.col("page_url")), 1, 16))
    return decisions.withColumn("related_policy_key", F.when(suspected, F.col("policy_key")).otherwise("")) \
        .withColumn("policy_key", F.when(suspected, variant).otherwise(F.col("policy_key"))) \
        .withColumn("force_review", suspected)


def link_provenance(links: DataFrame, sightings: DataFrame) -> DataFrame:
    """Upsert (policy, source, URL): the newest sighting supplies fetch_id and last_seen_at (VER-8)."""
    both = links.unionByName(sightings)
    return both.groupBy("policy_id", "source_id", "page_url").agg(
        F.max_by("fetch_id", F.struct("last_seen_at", "fetch_id")).alias("fetch_id"), F.max("last_seen_at").alias("last_seen_at"))


def point_ledger(ledger: DataFrame, sightings: DataFrame) -> DataFrame:
    """Ledger rows point at the policy their fetch fed last (VER-8)."""
    fed = sightings.groupBy(F.col("fetch_id").alias("id")).agg(F.max_by("policy_id", "last_seen_at").alias("_fed"))
    return ledger.join(fed, "id", "left").withColumn("policy_id", F.coalesce("_fed", "policy_id")).drop("_fed")


def provenance(policies: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct places every key was seen at, across all its versions (VER-9)."""
    named = sources.select(F.col("id").alias("source_id"), "site", "region")
    return links.join(policies.select(F.col("id").alias("policy_id"), "policy_key"), "policy_id") \
        .join(named, "source_id", "left") \
        .select("policy_key", "page_url", "site", "region", "last_seen_at").distinct()


def version_history(policies: DataFrame, key: str | None = None) -> DataFrame:
    """All versions, newest first (VER-10)."""
    rows = policies if key is None else policies.where(F.col("policy_key") == key)
    return rows.orderBy("policy_key", F.col("version").desc())


def reconcile_same_original(old: DataFrame, new: DataFrame, old_atts: DataFrame, new_atts: DataFrame):
    """Is a refetch the same original, and what survives of both extractions? (VER-12)

    Documents carry id, content, parse_error, content_sha256, raw_page_sha256; attachments carry
    policy_id, url, sha256, parsed_text, parse_status. Returns (documents, attachments).
    """
    o = old_atts.select("policy_id", "url", F.struct(*ATTACHMENT_STATE).alias("o"))
    n = new_atts.select("policy_id", "url", F.struct(*ATTACHMENT_STATE).alias("n"))
    pairs = o.join(n, ["policy_id", "url"], "full")
    clash = (F.col("o.sha256") != "") & (F.col("n.sha256") != "") & (F.col("o.sha256") != F.col("n.sha256"))
    keep_old = (F.col("n.sha256") == "") | ((F.col("o.parse_status") == "ok") & (F.col("n.parse_status") != "ok"))
    pairs = pairs.withColumn("same_file", F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.coalesce(clash, F.lit(False))) \
        .withColumn("m", F.when(keep_old, F.col("o")).otherwise(F.col("n")))
    per_doc = pairs.groupBy(F.col("policy_id").alias("id")).agg(
        F.bool_and("same_file").alias("_files_agree"), F.bool_or(~F.col("m").eqNullSafe(F.col("o"))).alias("_files_moved"))
    fields = ["content", "parse_error", "content_sha256", "raw_page_sha256"]
    docs = old.select("id", F.struct(*fields).alias("o")).join(new.select("id", F.struct(*fields).alias("n")), "id") \
        .join(per_doc, "id", "left")
    same = ((F.col("o.raw_page_sha256") == F.col("n.raw_page_sha256")) | (F.col("o.content_sha256") == F.col("n.content_sha256"))) \
        & F.coalesce("_files_agree", F.lit(True))
    poorer = (F.col("n.parse_error") != "") & (F.col("o.content") != "") & (F.col("o.parse_error") == "")
    content = F.when(poorer, F.col("o.content")).otherwise(F.col("n.content"))
    error = F.when(poorer, F.col("o.parse_error")).otherwise(F.col("n.parse_error"))
    docs = docs.withColumn("same_original", same).withColumn("content", content).withColumn("parse_error", error)
    docs = docs.withColumn("changed", F.col("same_original") & (
        (F.col("content") != F.col("o.content")) | (F.col("parse_error") != F.col("o.parse_error"))
        | F.coalesce("_files_moved", F.lit(False))))
    kept = pairs.join(docs.where("same_original").select(F.col("id").alias("policy_id")), "policy_id", "left_semi") \
        .select("policy_id", "url", *[F.col(f"m.{f}").alias(f) for f in ATTACHMENT_STATE])
    return docs.select("id", "same_original", "changed", "content", "parse_error"), kept


def backfill_metadata(old: DataFrame, new: DataFrame):
    """Fill only blank metadata; audit what was filled (VER-13). Returns (documents, review events)."""
    fresh = new.select("id", *[F.col(c).alias(f"_{c}") for c in METADATA])
    both = old.join(fresh, "id", "left")
    filled = {c: (X.text(c) == "") & (X.text(f"_{c}") != "") for c in METADATA}
    docs = both.select(*[F.when(filled[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c)
                         for c in old.columns])
    any_filled = filled[METADATA[0]]
    for c in METADATA[1:]:
        any_filled = any_filled | filled[c]
    events = both.where(any_filled).select(
        F.col("id").alias("policy_id"), F.lit("metadata_backfill").alias("action"),
        F.to_json(F.struct(*[F.when(filled[c], X.text(c)).alias(c) for c in METADATA])).alias("before_json"),
        F.to_json(F.struct(*[F.when(filled[c], F.col(f"_{c}")).alias(c) for c in METADATA])).alias("after_json"))
    return docs, events


def refresh_analysis(old: DataFrame, new: DataFrame):
    """Apply a newer extraction of the same original (VER-14). `new` carries id, changed and new values.

    Rows a human decided take only the content columns and get a recheck flag; other rows take
    everything. Returns (documents, reparse events).
    """
    content_fields = ("content", "content_sha256", "analysis_sha256", "parse_error", "raw_page_sha256")
    given = [c for c in new.columns if c not in ("id", "changed")]
    both = old.join(new.select("id", "changed", *[F.col(c).alias(f"_{c}") for c in given]), "id", "left")
    touched = F.col("changed").isNotNull()
    human = F.col("review_status").isin(*HUMAN_DECIDED)
    flag = human & F.coalesce("changed", F.lit(False))

    def value(c: str) -> Column:
        base = F.col(c)
        if c in METADATA and c in given:
            base = F.when(touched & (X.text(c) == "") & (X.text(f"_{c}") != ""), F.col(f"_{c}")).otherwise(base)
        elif c in content_fields and c in given:
            base = F.when(touched, F.col(f"_{c}")).otherwise(base)
        elif c in given:
            base = F.when(touched & ~human, F.col(f"_{c}")).otherwise(base)
        if c in ("parse_requires_review", "need_review"):
            base = F.when(flag, F.lit(1).cast(old.schema[c].dataType)).otherwise(base)
        return base.alias(c)

    old_text = X.first_filled(X.text("analysis_sha256"), X.sha256(X.text("content")))
    events = both.where(F.col("changed")).select(
        F.col("id").alias("policy_id"), F.lit("reparse").alias("action"),
        F.to_json(F.struct(old_text.alias("analysis_sha256"), "review_status")).alias("before_json"),
        F.to_json(F.struct(F.col("_analysis_sha256").alias("analysis_sha256"),
                           human.alias("human_decision_preserved"))).alias("after_json"))
    return both.select(*[value(c) for c in old.columns]), events


def dedupe_by_bytes(uploads: DataFrame, library: DataFrame) -> DataFrame:
    """Identical bytes are a duplicate of the stored file, or of the first such upload (VER-15)."""
    known = library.groupBy("sha256").agg(F.min("id").alias("known_id"))
    first = uploads.groupBy("sha256").agg(F.min("id").alias("first_id"))
    rows = uploads.join(known, "sha256", "left").join(first, "sha256")
    return rows.withColumn("duplicate_of", F.coalesce("known_id", F.when(F.col("first_id") < F.col("id"), F.col("first_id")))) \
        .drop("known_id", "first_id")


def initial_provenance(policies: DataFrame, ledger: DataFrame, links: DataFrame) -> DataFrame:
    """Add links derived from the ledger for policies that have none recorded (VER-16)."""
    fetched = ledger.select(F.col("id").alias("source_fetch_id"), "source_id")
    derived = policies.join(fetched, "source_fetch_id").select(
        F.col("id").alias("policy_id"), F.col("source_fetch_id").alias("fetch_id"), "source_id", "page_url",
        F.col("created_at").alias("last_seen_at"))
    missing = derived.join(links, ["policy_id", "source_id", "page_url"], "left_anti")
    return links.unionByName(missing)
