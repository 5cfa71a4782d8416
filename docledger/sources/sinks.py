"""Sinks (SNK): exports, comparison relations, idempotent batch stores, maintenance."""
from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docledger import schemas
from docledger.functions import skew, text as X
from docledger.operators import library as L
from docledger.sources.tables import folder_of, shared_folder

LIBRARY_TABLES = ("review_events", "attachment_attempts", "attachments", "policy_sources", "policies")
LOG_TABLES = ("run_logs", "agent_events")
PROTECTED_TABLES = ("source_configs",)


def export_rows(filtered: DataFrame, sort: str = "", order: str = "") -> DataFrame:
    """All rows of the current filter in its sort order, with readable labels (SNK-1)."""
    todo = F.coalesce("todo_type", F.lit("none"))
    named = {k: v[0] for k, v in L.TODO_META.items() if k != "none"}
    owner = {k: v[1] for k, v in L.TODO_META.items() if k != "none"}
    unknown = F.when(todo == "none", "").otherwise(todo)
    rows = L.order_policies(filtered, sort, order)
    return rows.select(
        "id", "title", "wenhao", X.first_filled(X.text("category_names"), F.lit("未分类")).alias("category_names"), "region",
        F.substring(X.text("page_date"), 1, 10).alias("page_date"), L.mapped(F.col("review_status"), L.REVIEW_LABELS).alias("review_status"),
        L.mapped(todo, named, unknown).alias("todo"), L.mapped(todo, owner, F.when(todo == "none", "").otherwise("-")).alias("owner"),
        "site", "page_url")


def export_csv(filtered: DataFrame, path: str, sort: str = "", order: str = "") -> None:
    """CSV files in sort order, one for each range of the sort."""
    rows = formula_safe(export_rows(filtered, sort, order))
    rows.write.mode("overwrite").option("header", "true").csv(path)


def formula_safe(df: DataFrame) -> DataFrame:
    """Neutralise spreadsheet formulas in every text column (SNK-2)."""
    return df.select(*[X.formula_safe(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name)
                       for f in df.schema.fields])


def nested_policies(policies: DataFrame, attachments: DataFrame, provenance: DataFrame, size: int = 1000) -> DataFrame:
    """Policies with attachment and provenance arrays (SNK-3).

    Arrays hold at most `size` structs; a policy with more children continues in further `part`s.
    """
    atts = skew.listed(attachments, ["policy_id"], [F.col("id")], skew.piece_of("id"),
                       [c for c in attachments.columns if c != "policy_id"], "attachments", size)
    seen = skew.listed(provenance, ["policy_key"], [F.col("last_seen_at"), F.col("page_url")], F.substring("last_seen_at", 1, 7),
                       [c for c in provenance.columns if c != "policy_key"], "sources", size)
    seen = policies.select(F.col("id").alias("policy_id"), "policy_key").join(seen, "policy_key").drop("policy_key")
    parts = atts.join(seen, ["policy_id", "part"], "full")
    out = policies.join(parts.withColumnRenamed("policy_id", "id"), "id", "left")
    return out.withColumn("part", F.coalesce("part", F.lit(0)))


def export_nested_json(policies: DataFrame, attachments: DataFrame, provenance: DataFrame, path: str) -> None:
    nested_policies(policies, attachments, provenance).write.mode("overwrite").json(path)


def comparison_relations(cells: DataFrame, history: DataFrame, pending: DataFrame, comparison: DataFrame) -> dict[str, DataFrame]:
    """The five relations behind the comparison workbook (SNK-4)."""
    evidence = cells.select("project_key", "doc_id", "name", "value", F.explode("evidence").alias("e")) \
        .select("project_key", "doc_id", "name", "value", "e.id", "e.page", "e.quote")
    single = cells.select("project_key", "doc_id", "name", "value", "status", "method")
    return {"evidence": evidence, "cells": single, "history": history, "pending": pending, "comparison": comparison}


def write_relations(relations: dict[str, DataFrame], root: str) -> None:
    for name, df in relations.items():
        formula_safe(df).write.mode("overwrite").partitionBy("project_key").parquet(f"{root}/{name}")


def export_project(docs: DataFrame, path: str, project_key: str | None = None) -> None:
    """All documents, or those of one project; an unknown project is an error, not an empty file (SNK-5)."""
    rows = docs if project_key is None else docs.where(F.col("project_key") == project_key)
    if project_key is not None and rows.isEmpty():
        raise ValueError(f"unknown project: {project_key}")
    rows.write.mode("overwrite").json(path)


def store_json_files(rows: DataFrame, root: str) -> int:
    """One file `<name>.json` a row (name, json) in the folders of `root`, the form `read_approval_docs` reads; returns how many were written.

    Files are spread over 256 folders by their names (`tables.folder_of`), so that no folder has to be listed in one piece. Tasks write
    the files of their rows. A file is put in place under its name when it is complete, so a task that runs again
    leaves the same files. `root` is a folder or address that driver and executors share.
    """
    def write(batches):
        store, base = shared_folder(root)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("json").to_pylist()):
                if not name or "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                folder = f"{base}/{folder_of(name)}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode())
                store.move(part, f"{folder}/{name}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    return rows.select("name", "json").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def store_batch(root: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Write the tables of one batch together (SNK-6).

    Every table gets the partition batch_id=<id>, replaced as a whole, so a repeated batch leaves
    the same rows; the commit marker comes last and readers ignore batches without one.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias("committed")).write.mode("overwrite").parquet(f"{root}/_commits/batch_id={batch_id}")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    commits = spark.read.parquet(f"{root}/_commits").select("batch_id").distinct()
    return spark.read.parquet(f"{root}/{name}").join(commits, "batch_id", "left_semi")


def scoped_clear(spark: SparkSession, tables: dict[str, DataFrame], scope: str) -> dict[str, DataFrame]:
    """Empty the tables of `library`, `logs` or `all`; sources stay, the ledger forgets policy ids (SNK-7)."""
    if scope not in ("library", "logs", "all"):
        raise ValueError(f"unknown scope: {scope}")
    doomed = (LIBRARY_TABLES if scope != "logs" else ()) + (LOG_TABLES if scope != "library" else ())
    out = {n: spark.createDataFrame([], df.schema) if n in doomed and n not in PROTECTED_TABLES else df for n, df in tables.items()}
    if scope != "logs" and "fetch_records" in out:
        out["fetch_records"] = out["fetch_records"].withColumn("policy_id", F.lit(None).cast("long"))
    return out


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table (SNK-8)."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)


def ledger_schema(name: str):
    return schemas.schema(name)
