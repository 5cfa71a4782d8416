"""Pages that wait for model answers, and many pages of one URL in one batch."""
import random
from datetime import datetime, timedelta

import pytest

from docledger.streaming import answers as A, streams as T
from tests.test_ledger import RULES

START = datetime(2026, 1, 1)


def _run(spark, folder, asked, answers, splits):
    """Deal the rows into that many files, one a batch, and gather what ends."""
    schema_q, schema_a = "id long, n_chunks int, at timestamp", "id long, chunk int, at timestamp, body string"
    for name, rows, schema in (("q", asked, schema_q), ("a", answers, schema_a)):
        size = -(-len(rows) // splits)
        for k in range(splits):
            spark.createDataFrame(rows[k * size:(k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    ended = A.ended_pages(T.read_stream(spark, f"{folder}/q", schema_q, 1), T.read_stream(spark, f"{folder}/a", schema_a, 1), 3600, delay=30 * 24 * 3600 if splits > 1 else 600)

    def save(df, batch_id):
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
    ended.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return sorted(((r.id, r.outcome, r.chunk, r.body) for r in spark.read.schema(f"{A.ENDED}, batch int").parquet(f"{folder}/out").collect()), key=str)


@pytest.mark.parametrize("splits", [1, 3])
def test_every_page_ends_once(spark, tmp_path, splits):
    rng = random.Random(splits)
    minute = lambda m: START + timedelta(minutes=m)
    asked = [(i, 1 + i % 3, minute(i)) for i in range(24)]
    answers, want = [], []
    for i, n, at in asked:
        kind = i % 4
        times = {c: at + timedelta(minutes=5 + c) for c in range(n)}
        if kind == 1:
            times[n - 1] = at + timedelta(minutes=61)  # a minute too late
        if kind == 2:
            del times[n - 1]
        answers += [(i, c, t, f"{i}-{c}") for c, t in times.items()]
        answers += [(i, c, t + timedelta(minutes=1), "again") for c, t in list(times.items())[:1] if kind == 0 and n > 1]
        if kind in (0, 3):
            want += [(i, "answered", c, f"{i}-{c}") for c in range(n)]
        else:
            want += [(i, "fallback", None, None)] + ([(i, "late", n - 1, f"{i}-{n - 1}")] if kind == 1 else [])
    answers.append((24, 0, minute(0), "nobody asked"))
    # time goes on until all patience is over
    asked.append((99, 1, START + timedelta(days=60)))
    rng.shuffle(answers)
    rng.shuffle(asked) if splits == 1 else asked.sort(key=lambda r: r[2])
    got = _run(spark, str(tmp_path), asked, answers, splits)
    # a second answer is used only where it was there alone when the page ended; else it is forgotten, or late after the end
    again = [r for r in got if r[3] == "again"]
    assert splits > 1 or all(r[1] == "late" for r in again)
    used = {r[:3] for r in again if r[1] == "answered"}
    got = [(*r[:3], f"{r[0]}-{r[2]}") if r[:3] in used and r[3] == "again" else r for r in got if not (r[0] == 99 or r[1] == "late" and (r[3] == "again" or ("answered", r[2]) in {u[1:] for u in used if u[0] == r[0]}))]
    assert sorted(got, key=str) == sorted([*want, (24, "late", 0, "nobody asked")], key=str)


def _page(title, body):
    return f"<html><body><h1>{title}</h1><article><p>{body}</p></article></body></html>"


def test_answers_reach_the_ledger(spark, rows, tmp_path):
    """Model answers decide; a page without them falls back; errors of an answer drop its classes; chunks are merged."""
    pages = rows("page_id LONG, page_url STRING, html STRING, source_name STRING", [(i, f"https://a.example.org/{i}", _page(f"Title {i}", f"body of page {i} " * 18), "a") for i in range(5)])
    yes = '{"is_investment_policy": "yes", "category": ["guide"], "category_evidence": {"guide": "body of page 0"}, "evidence": "body of page 0", "need_review": false, "confidence": 0.9, "doc_type": "正式政策"}'
    no = '{"is_investment_policy": "no", "category": [], "evidence": "body of page %d", "need_review": false, "confidence": 0.9, "category_reason": "other"}'
    given = [(0, 0, yes), *[(0, c, no % 0) for c in range(1, 3)], *[(1, c, no % 1) for c in range(3)], (2, 0, "not json"), *[(2, c, no % 2) for c in range(1, 3)]]
    T.ingest_batch(str(tmp_path / "l"), RULES, chunk_size=100)(pages, 0, rows("id LONG, chunk INT, body STRING", given))
    from docledger.sources import sinks as K
    ledger = {r.id: r for r in K.read_committed(spark, str(tmp_path / "l"), "fetch_records").collect()}
    stored = {r.id: r for r in K.read_committed(spark, str(tmp_path / "l"), "policies").collect()}
    assert len(ledger) == 5 and ledger[1].outcome == "excluded" and ledger[1].reason == "other"
    assert (stored[0].is_investment_policy, stored[0].category, stored[0].classification_method, stored[0].need_review) == ("yes", "guide", "llm", True)
    assert "不同段落" in stored[0].reviewer_hint and stored[2].is_investment_policy == "pending" and stored[2].need_review
    for i in (3, 4):
        assert (stored[i].classification_method, stored[i].todo_type, stored[i].is_investment_policy) == ("rule_fallback", "system", "pending") and stored[i].fallback_reason


def _jobs(spark, run):
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None), default=0)
    run()
    return max(tracker.getJobIdsForGroup(None)) - before


def test_many_pages_of_one_url(spark, rows, tmp_path):
    """Hundreds of refetches of one URL in a batch: versions in order, repeats found, and no more jobs than for two."""
    schema = "page_id LONG, page_url STRING, html STRING, source_name STRING"
    text = lambda k: _page("Investment measures", f"investment project approval text {k} " * 5)
    many = rows(schema, [(i, "https://a.example.org/x", text(i // 3), "a") for i in range(300)])
    few = rows(schema, [(i, "https://a.example.org/x", text(i), "a") for i in range(2)])
    answers = rows("id LONG, chunk INT, body STRING", [])
    jobs = _jobs(spark, lambda: T.ingest_batch(str(tmp_path / "m"), RULES)(many, 0, answers))
    assert jobs <= _jobs(spark, lambda: T.ingest_batch(str(tmp_path / "f"), RULES)(few, 0, answers)) + 5
    from docledger.sources import sinks as K
    got = {r.id: r for r in K.read_committed(spark, str(tmp_path / "m"), "policies").collect()}
    assert {i: r.version for i, r in got.items()} == {3 * k: k + 1 for k in range(100)} and len({r.policy_key for r in got.values()}) == 1
    outcomes = {r.id: r.outcome for r in K.read_committed(spark, str(tmp_path / "m"), "fetch_records").collect()}
    assert outcomes == {i: "ingested" if i == 0 else "updated" if i % 3 == 0 else "duplicate" for i in range(300)}
