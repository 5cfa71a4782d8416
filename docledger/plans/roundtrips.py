"""Readers and sinks on given tables: written in the reader's format under the shared folder, then read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docledger import schemas
from docledger.functions import skew
from docledger.operators import sampling as E
from docledger.plans import binding as B
from docledger.plans.registry import query
from docledger.session import ensure_checkpoint_dir
from docledger.sources import sinks as K, tables as S


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("src_read_events", """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS run_id, event_type AS action, CASE WHEN value > 20 THEN 'ok' ELSE 'attention' END AS status,
  CAST(epoch_us(ts) AS BIGINT) AS created_at FROM events""")
def read_table(spark, sf):
    """A ledger table with its fixed schema (SRC-1)."""
    root = _folder(spark)
    log = B.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("action"),
        F.when(F.col("value") > 20, "ok").otherwise("attention").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    S.conform(log, schemas.schema("agent_events")).write.parquet(f"{root}/agent_events")
    return S.read_table(spark, root, "agent_events").select("id", "run_id", "action", "status", F.unix_micros("created_at").alias("created_at"))


@query("src_load_sources", "SELECT row_number() OVER (ORDER BY s_name) AS id, s_name AS name, 'R' || s_nationkey AS region, CAST(s_acctbal > 0 AS INTEGER) AS enabled FROM supplier")
def load_sources(spark, sf):
    """A registry of all suppliers (SRC-2), written as JSON lines in name order and read in parallel."""
    path = f"{_folder(spark)}.jsonl"
    rows = B.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("R"), "s_nationkey").alias("region"), (F.col("s_acctbal") > 0).alias("enabled"), F.lit("x").alias("unknown_key"))
    rows.repartitionByRange(8, "name").sortWithinPartitions("name").write.json(path)
    return S.load_sources(spark, path).select("id", "name", "region", "enabled")


@query("src_read_approval_docs", """WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 1000 AS part, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders)
  SELECT md5(o_custkey || '-' || part) AS id, count(*) AS n_metrics, 'S' || min(o_orderstatus) AS stage, 'K' || o_custkey AS project_key,
         max(price)::VARCHAR AS investment, string_agg(o_orderkey || '=' || price, ',' ORDER BY o_orderkey) AS metrics FROM o GROUP BY o_custkey, part""")
def read_approval_docs(spark, sf):
    """Approval documents stored as one JSON file each under a 32-hex name (SRC-7): the orders of a customer are the metrics
    of its documents, 1,000 at most in one. The folder also holds a file of another name, which the reader has to leave out."""
    root = _folder(spark)
    o = B.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("value"),
        F.lit("extracted").alias("status"), F.lit("rule").alias("method"), F.col("o_orderstatus").alias("scope"))
    parts = skew.listed(o, ["o_custkey"], [F.col("o_orderkey")], skew.piece_of("o_orderkey"), ["name", "value", "status", "method", "scope"], "metrics")
    top = F.array_max(F.transform("metrics", lambda m: m["value"].cast("decimal(15,2)"))).cast("string")
    docs = parts.select(
        F.md5(F.concat_ws("-", "o_custkey", "part")).alias("id"), F.concat(F.lit("S"), F.array_min("metrics.scope")).alias("stage"), F.concat(F.lit("K"), "o_custkey").alias("project_key"),
        F.create_map(F.lit("总投资"), F.struct(top.alias("value"), F.lit("extracted").alias("status"))).alias("fields"), "metrics")
    files = docs.select(F.col("id").alias("name"), F.to_json(F.struct(*docs.columns)).alias("json"))
    foreign = spark.range(1).select(F.lit("index").alias("name"), F.lit('{"id": "index", "stage": "S", "metrics": []}').alias("json"))
    K.store_json_files(files.unionByName(foreign), root)
    found = S.read_approval_docs(spark, root)
    pair = F.transform("metrics", lambda m: F.concat(m["name"], F.lit("="), m["value"]))
    return found.select("id", F.size("metrics").cast("long").alias("n_metrics"), "stage", "project_key", F.col("fields")["总投资"]["value"].alias("investment"), F.array_join(pair, ",").alias("metrics"))


@query("src_read_originals", """SELECT item_id AS id, 'txt' AS fmt, sha256(text || chr(10)) AS sha256, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size FROM benchmark""")
def read_originals(spark, sf):
    """Stored files with size, format and hash (SRC-3): one text file for each benchmark item."""
    path = _folder(spark)
    B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    found = S.read_originals(spark, path)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("id"), "fmt", "sha256", F.col("size").cast("long").alias("size"))


@query("src_read_labels", "SELECT doc_id AS id, quality = 1 AS relevant, CASE WHEN toxic = 1 THEN 'access,incentive' ELSE 'guide' END AS categories, 'human' AS label_status FROM labels")
def read_labels(spark, sf):
    """Gold labels, one JSON object a line (SRC-6)."""
    path = _folder(spark)
    gold = B.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant"),
        F.when(F.col("toxic") == 1, F.array(F.lit("access"), F.lit("incentive"))).otherwise(F.array(F.lit("guide"))).alias("categories"), F.lit("human").alias("label_status"))
    gold.write.json(path)
    return S.read_labels(spark, path).select("id", "relevant", F.array_join("categories", ",").alias("categories"), "label_status")


@query("snk_export_project", "SELECT o_orderkey AS id, 'K' || o_custkey AS project_key, o_orderstatus AS stage FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def export_project(spark, sf):
    """The documents of one project as JSON (SNK-5), read back."""
    path = _folder(spark)
    docs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("K"), "o_custkey").alias("project_key"), F.col("o_orderstatus").alias("stage"))
    first = B.table(spark, sf, "orders").agg(F.concat(F.lit("K"), F.min("o_custkey"))).first()[0]
    K.export_project(docs, path, first)
    return spark.read.schema(docs.schema).json(path)


@query("eva_corpus_hash", "SELECT count(*) AS n, true AS order_free, true AS tells_change FROM documents")
def corpus_hash(spark, sf):
    """The corpus fingerprint (EVA-13) does not depend on the order of rows and changes with one of them."""
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    one, two = E.corpus_hash(d), E.corpus_hash(d.repartition(7, "text"))
    changed = E.corpus_hash(d.withColumn("text", F.when(F.col("doc_id") == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return one.join(two.select(F.col("fingerprint").alias("b")), F.lit(True)).join(changed.select(F.col("fingerprint").alias("c")), F.lit(True)) \
        .select("n", (F.col("fingerprint") == F.col("b")).alias("order_free"), (F.col("fingerprint") != F.col("c")).alias("tells_change"))
