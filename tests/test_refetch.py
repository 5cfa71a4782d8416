"""Pages that are fetched again: the same original makes no version, human decisions stay, missing files fail."""
from pyspark.sql import functions as F

from docledger.sources import sinks as K
from docledger.streaming import streams as T
from tests.test_ledger import RULES

PAGE = "page_id LONG, page_url STRING, html STRING, source_name STRING"


def _html(body, head=""):
    return f"<html><head>{head}</head><body><h1>投资项目管理办法</h1><article><p>{body}</p></article></body></html>"


def test_refetch(spark, rows, tmp_path):
    root = str(tmp_path / "l")
    url = lambda k: f"https://a.example.org/{k}"
    text = lambda k: f"投资项目 核准 办法 正文 {k} " * 4
    file = lambda page, status, sha, body: (page, 1, "f", "https://a.example.org/f.pdf", sha, status, body, "")

    def ingest(batch, pages, files=()):
        T.ingest_batch(root, RULES, rows(T.ATTACHMENT, list(files)))(rows(PAGE, [(*p, f"s{p[1][-1]}") for p in pages]), batch)
        return {r.id: r.outcome for r in K.read_committed(spark, root, "fetch_records").where(F.col("batch_id") == batch).collect()}

    assert ingest(0, [(k, url(k), _html(text(k))) for k in range(4)], [file(2, "failed", "", ""), file(3, "ok", "aa", "old text")]) == dict.fromkeys(range(4), "ingested")
    first = {r.id: r for r in T.current_policies(spark, root).collect()}
    # a person adjusts policies 0 and 2
    decided = T.current_policies(spark, root).where("id IN (0, 2)").withColumn("review_status", F.lit("adjusted")).withColumn("category", F.lit("guarantee"))
    K.store_batch(root, 1, {"policies": decided})
    date = '<meta name="PubDate" content="2026-09-01">'
    again = [(10, url(0), _html(text(0), date)), (11, url(0), _html(text(0), date)), (12, url(1), _html(text(1))), (13, url(2), _html(text(2))), (14, url(3), _html(text(3) + "neu"))]
    files = [file(13, "ok", "bb", "now there is text"), file(14, "failed", "", "")]
    outcomes = ingest(2, again, files)
    assert outcomes == {10: "duplicate", 11: "duplicate", 12: "duplicate", 13: "reparsed", 14: "failed"}
    now = {r.id: r for r in T.current_policies(spark, root).collect()}
    assert set(now) == set(first) and all(r.version == 1 for r in now.values())
    # metadata are filled without a version, the decision stays
    assert (first[0].page_date, now[0].page_date, now[0].review_status, now[0].category) == ("", "2026-09-01", "adjusted", "guarantee")
    assert now[1] == first[1] and now[3] == first[3]
    # a file that is there at last changes the content columns of a decided row, not the decision
    assert now[2].review_status == "adjusted" and now[2].category == "guarantee" and now[2].content_sha256 != first[2].content_sha256
    assert {(r.policy_id, r.parsed_text) for r in T.current_attachments(spark, root).collect()} == {(2, "now there is text"), (3, "old text")}
    events = {(r.policy_id, r.action) for r in K.read_committed(spark, root, "review_events").collect()}
    assert events == {(0, "metadata_backfill"), (2, "reparse")}
    # the same batch once more, after its commit, leaves the same rows
    assert ingest(2, again, files) == outcomes
    assert {r.id: r for r in T.current_policies(spark, root).collect()} == now
    # other content is a new version that waits for review
    assert ingest(3, [(20, url(0), _html(text(0) + "neu", date))]) == {20: "updated"}
    assert {r.id: (r.version, r.review_status) for r in T.current_policies(spark, root).where("id IN (0, 20)").collect()} == {0: (1, "adjusted"), 20: (2, "pending")}
