"""Pages that wait for model answers (STR-1 with CLS-11 to CLS-14).

A page is asked about in chunks; its answers arrive as rows of their own, in any order and any number of batches. Keyed
state holds what a page still waits for, and an event-time timer ends the wait. Every page ends once: with all its answers,
or with the rules once its patience is over. Answers that come later are kept as candidates for a new try (CLS-18).

What becomes of a page depends on the times its rows carry, not on how they fall into batches: an answer counts if its time
is at most `patience` after the question's. Of the answers to a chunk that are there when the last chunk is answered, the earliest counts. Rows older than the watermark are dropped
by Spark, so `delay` has to cover how late a row can be delivered.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docledger.functions import skew
from docledger.operators import rules as C
from docledger.operators.responses import chunk_text
from docledger.operators.ruleset import DEFAULT, RuleSet
from docledger.sources import sinks as K
from docledger.streaming import streams as T

ANSWERED, FALLBACK, LATE = "answered", "fallback", "late"
ENDED = "id long, outcome string, chunk int, body string"
#: Chunks the page was asked about (0 until the question is there), time of the question, whether it has ended, answers so far.
WAITING = "n_chunks int, asked_at long, ended boolean, chunks array<int>, times array<long>, bodies array<string>"


def questions(pages: DataFrame, at, chunk_size: int = T.CHUNK_SIZE) -> DataFrame:
    """id, n_chunks and at of each fetched page without attachments: what a model client is asked, one answer a chunk."""
    docs = T.parsed_pages(pages).withColumn("analysis_text", F.concat(F.lit("[正文]\n"), F.coalesce("content", F.lit(""))))
    size = F.greatest(F.ceil(F.length("analysis_text") / chunk_size), F.lit(1)).cast("int")
    return docs.select("id", size.alias("n_chunks"), at.alias("at"))


def question_chunks(docs: DataFrame, chunk_size: int = T.CHUNK_SIZE) -> DataFrame:
    """id, chunk and body of every chunk of documents with an analysis_text."""
    return chunk_text(docs, chunk_size, "analysis_text").select("id", "chunk", "body")


def _waiter(patience_ms: int, keep_ms: int):
    def wait(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, asked, ended, chunks, times, bodies = state.get if state.exists else (0, 0, False, [], [], [])
        given = {c: (t, b) for c, t, b in zip(chunks, times, bodies)}
        out = []
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            if not n:  # answers to a question that never came
                out = [(LATE, c, b) for c, (_, b) in sorted(given.items())]
                state.remove()
            else:
                out, ended = [(FALLBACK, None, None)], True
                out += [(LATE, c, b) for c, (t, b) in sorted(given.items()) if t > asked + patience_ms]
                state.update((n, asked, True, [], [], []))
                state.setTimeoutTimestamp(max(asked + patience_ms + keep_ms, state.getCurrentWatermarkMs() + 1))
        else:
            rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.ms, r.chunk, r.body or ""))
            latest = max(r.ms for r in rows)
            for r in rows:
                if r.n_chunks > 0:
                    if not n:
                        n, asked = int(r.n_chunks), int(r.ms)
                elif ended:
                    out.append((LATE, int(r.chunk), r.body))
                else:
                    now = (int(r.ms), r.body)
                    given[int(r.chunk)] = min(given.get(int(r.chunk), now), now, key=lambda g: (g[0], g[1] or ""))
            if n and not ended:
                out += [(LATE, c, b) for c, (t, b) in sorted(given.items()) if t > asked + patience_ms or c >= n]
                given = {c: (t, b) for c, (t, b) in given.items() if t <= asked + patience_ms and c < n}
                if len(given) == n:
                    out += [(ANSWERED, c, b) for c, (_, b) in sorted(given.items())]
                    ended, given = True, {}
            due = (asked if n else latest) + patience_ms + (keep_ms if ended or not n else 0)
            if due <= state.getCurrentWatermarkMs():
                if n and not ended:
                    out, ended, given = [*out, (FALLBACK, None, None)], True, {}
                due = state.getCurrentWatermarkMs() + max(keep_ms, 1)
            state.update((n, asked, ended, list(given), [t for t, _ in given.values()], [b for _, b in given.values()]))
            state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame({"id": [key[0]] * len(out), "outcome": [o for o, _, _ in out], "chunk": pd.array([c for _, c, _ in out], "Int32"), "body": [b for _, _, b in out]})
    return wait


def ended_pages(asked: DataFrame, answers: DataFrame, patience: int, delay: int = 3600, keep: int = 7 * 24 * 3600) -> DataFrame:
    """Streams of questions (id, n_chunks, at) and answers (id, chunk, at, body) to a stream of id, outcome, chunk, body.

    `patience`, `delay` (of delivery) and `keep` (how long an ended page is remembered) are seconds. Each page gives its
    answers (outcome `answered`, one row a chunk) or one row `fallback`; answers that come too late are rows `late`.
    """
    both = asked.select(F.col("id").cast("long").alias("id"), F.col("n_chunks").cast("int").alias("n_chunks"), F.lit(-1).alias("chunk"), F.col("at").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("body")) \
        .unionByName(answers.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("n_chunks"), F.col("chunk").cast("int").alias("chunk"), F.col("at").cast("timestamp").alias("at"), "body"))
    rows = both.where("id IS NOT NULL AND at IS NOT NULL").withColumn("ms", F.unix_millis("at")).withWatermark("at", f"{delay} seconds")
    return rows.groupBy("id").applyInPandasWithState(_waiter(patience * 1000, keep * 1000), ENDED, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def ended_batch(root: str, pages: DataFrame, rules: RuleSet = DEFAULT, attachments: DataFrame | None = None, chunk_size: int = T.CHUNK_SIZE):
    """foreachBatch function: ended pages to the ledger under `root`/ledger, late answers to `root`/late.

    `pages` is the table of fetched pages; those that ended in this batch are judged by their answers or by the rules.
    """
    store = T.ingest_batch(f"{root}/ledger", rules, attachments, chunk_size)

    def finish(ended: DataFrame, batch_id: int) -> None:
        ended = skew.pinned(ended)
        ended.where(F.col("outcome") == LATE).select("id", "chunk", "body").write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        due = ended.where(F.col("outcome") != LATE)
        now = pages.join(due.select(F.col("id").alias("page_id")).distinct(), "page_id", "left_semi")
        store(now, batch_id, due.where(F.col("outcome") == ANSWERED).select("id", "chunk", "body"))
    return finish


def retry_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Stored policies judged by the rules for want of an answer, without a human decision, whose answer came late (CLS-18)."""
    late = spark.read.schema("id long, chunk int, body string, batch_id long").parquet(f"{root}/late").select("id").distinct()
    return C.model_retry_candidates(K.read_committed(spark, f"{root}/ledger", "policies")).join(late, "id", "left_semi")
