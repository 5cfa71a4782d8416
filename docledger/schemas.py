"""Schemas of the ledger tables, as DDL."""
from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "source_configs": "id LONG, name STRING, site STRING, region STRING, category STRING, enabled INT, list_url STRING, "
                      "link_selector STRING, include ARRAY<STRING>, exclude ARRAY<STRING>, allowed_hosts ARRAY<STRING>, "
                      "max_pages INT, pagination STRING, list_format STRING, detail_url_pattern STRING, "
                      "last_checked_at TIMESTAMP, last_success_at TIMESTAMP, last_error STRING",
    "fetch_records": "id LONG, source_id LONG, page_url STRING, title STRING, status STRING, error STRING, "
                     "content_sha256 STRING, raw_path STRING, discovered_at TIMESTAMP, downloaded_at TIMESTAMP, "
                     "processed_at TIMESTAMP, last_checked_at TIMESTAMP, policy_id LONG, classification_json STRING, "
                     "document_json STRING",
    "policies": "id LONG, policy_key STRING, version LONG, title STRING, wenhao STRING, issuing_authority STRING, "
                "page_date STRING, doc_date STRING, region STRING, site STRING, page_url STRING, doc_type STRING, "
                "category STRING, category_names STRING, is_investment_policy STRING, need_review INT, todo_type STRING, "
                "review_status STRING, reason STRING, evidence STRING, reviewer_hint STRING, confidence DOUBLE, "
                "model_version STRING, classification_method STRING, fallback_reason STRING, input_truncated INT, "
                "input_tokens INT, output_tokens INT, content STRING, content_sha256 STRING, analysis_sha256 STRING, "
                "raw_page_sha256 STRING, source_fetch_id LONG, parse_error STRING, parse_requires_review INT, "
                "related_policy_key STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "attachments": "id LONG, policy_id LONG, name STRING, url STRING, local_path STRING, fmt STRING, sha256 STRING, "
                   "parse_status STRING, parsed_text STRING, error STRING, parser_version STRING, parse_method STRING, "
                   "total_pages INT, parsed_pages INT",
    "attachment_attempts": "id LONG, fetch_id LONG, url STRING, fmt STRING, download_status STRING, parse_status STRING, "
                           "error STRING, checked_at TIMESTAMP",
    "discovery_observations": "source_id LONG, page_url STRING, title STRING, admitted INT, reason STRING, observed_at TIMESTAMP",
    "policy_sources": "policy_id LONG, fetch_id LONG, source_id LONG, page_url STRING, last_seen_at TIMESTAMP",
    "review_events": "policy_id LONG, action STRING, before_json STRING, after_json STRING, note STRING, created_at TIMESTAMP",
    "run_logs": "run_id STRING, source_id LONG, kind STRING, status STRING, summary STRING, progress STRING, "
                "model_version STRING, note STRING, started_at TIMESTAMP, finished_at TIMESTAMP",
    "agent_events": "id LONG, run_id STRING, fetch_id LONG, action STRING, status STRING, message STRING, created_at TIMESTAMP",
    "attachment_verify": "local_path STRING, size LONG, mtime_ns LONG, sha256 STRING, ok INT, checked_at TIMESTAMP",
    "labels": "id LONG, relevant BOOLEAN, categories ARRAY<STRING>, title STRING, wenhao STRING, hard BOOLEAN, note STRING, "
              "page_url STRING, content_sha256 STRING, label_status STRING",
}

EVIDENCE = "ARRAY<STRUCT<id: STRING, page: INT, bbox: ARRAY<DOUBLE>, quote: STRING>>"
CELL = f"STRUCT<value: STRING, status: STRING, method: STRING, reason: STRING, evidence: {EVIDENCE}>"
QUANTITY = "STRUCT<number: DECIMAL(38,12), upper: DECIMAL(38,12), unit: STRING, dimension: STRING, qualifier: STRING, " \
           "raw_unit: STRING, approximate_conversion: BOOLEAN>"
METRIC = f"STRUCT<name: STRING, value: STRING, status: STRING, method: STRING, scope: STRING, evidence: {EVIDENCE}>"
HISTORY = "STRUCT<time: DOUBLE, kind: STRING, name: STRING, index: INT, before: STRING, after: STRING, reason: STRING>"
APPROVAL_DOC = (
    "id STRING, filename STRING, stage STRING, project_key STRING, project_name STRING, revision INT, "
    f"fields MAP<STRING, {CELL}>, metrics ARRAY<{METRIC}>, warnings ARRAY<STRING>, history ARRAY<{HISTORY}>")
LINES = "doc_id STRING, id STRING, page INT, text STRING, bbox ARRAY<DOUBLE>, method STRING"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
