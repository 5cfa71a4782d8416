"""Versions, list order, pages, review state, streams."""
import random

from pyspark.sql import functions as F

from docledger.operators import review as RV
from docledger.operators import identity as I, library as L, pages as G
from docledger.operators.approval import fields as A, progress as R
from docledger.operators.ruleset import RuleSet
from docledger.sources import sinks as K
from docledger.streaming import streams as T


def _one_by_one(incoming, library, links):
    """The batch rules applied to one document after the other."""
    versions, by_url, out = {}, dict(links), {}
    for key, version, digest in library:
        versions.setdefault(key, {}).setdefault(digest, version)
    for arrival, url, key, digest in sorted(incoming):
        known = by_url.get(url)
        key = known or key
        have = versions.get(key)
        if have is not None and digest in have:
            out[arrival] = ("duplicate_skip", have[digest])
        elif have is not None and known is None:
            out[arrival] = ("suspected_duplicate", 1)
        else:
            version = max(have.values(), default=0) + 1 if have else 1
            versions.setdefault(key, {})[digest] = version
            out[arrival] = ("updated" if have else "ingested", version)
    return out


def test_batch_decisions_equal_one_by_one(rows):
    rnd = random.Random(3)
    library = [(f"k{k}", v, f"h{k}{v}") for k in range(6) for v in (1, 2)]
    links = [(f"u{k}", f"k{k}") for k in range(6)]
    incoming = [(i, f"u{i}" if i < 6 else f"w{i}", f"k{rnd.randrange(12)}", f"h{rnd.randrange(12)}{rnd.randrange(1, 4)}") for i in rnd.sample(range(200), 120)]
    lib = rows("id LONG, policy_key STRING, version LONG, content_sha256 STRING", [(i, *r) for i, r in enumerate(library)])
    ids = {(k, v): i for i, (k, v, _) in enumerate(library)}
    link = rows("policy_id LONG, page_url STRING", [(ids[k, 2], u) for u, k in links])
    got = I.dedup_decision(rows("arrival LONG, page_url STRING, policy_key STRING, content_sha256 STRING", incoming), lib, link)
    assert {r["arrival"]: (r["decision"], r["version"]) for r in got.collect()} == _one_by_one(incoming, library, links)


def test_blank_dates_sort_last_both_ways(rows):
    p = rows("id INT, page_date STRING", [(1, "2026-01-02"), (2, ""), (3, "2026-03-01"), (4, "2026-01-02"), (5, None)])
    order = lambda direction: [r["id"] for r in L.order_policies(p, "date", direction).collect()]
    assert order("asc") == [4, 1, 3, 5, 2] and order("") == [3, 4, 1, 2, 5]
    assert [r["id"] for r in L.order_policies(p, "nonsense").collect()] == [5, 4, 3, 2, 1]


def test_wildcards_and_case(rows):
    p = rows("id INT, title STRING, content STRING, wenhao STRING", [(1, "Abc", "", ""), (2, "aXc", "", ""), (3, "", "É", "")])
    a = rows("policy_id INT, parsed_text STRING", [(3, "xx ABC")])
    assert {r["id"] for r in L.keyword_search(p, a, "a_c").collect()} == {1, 2, 3}
    assert {r["id"] for r in L.keyword_search(p, a, "a_c", wildcards=False).collect()} == set()
    assert {r["id"] for r in L.keyword_search(p, a, "é").collect()} == set()


def test_pages(rows):
    html = """<html><head><title>站点</title><meta name="PubDate" content="2026年3月4日"></head><body><nav>导航</nav><h1>关于 <b>投资</b></h1><p>浙发改〔2026〕1<span>2号</span></p>
      <div class="a content"><p>第一条 <b>加粗</b>正文内容足够长的一段文字用于测试。</p><p>根据国办发〔2020〕9号。</p><p>浙江省财政厅</p><p>2026年3月1日</p></div><footer>页脚</footer></body></html>"""
    r = G.parse_pages(rows("page_url STRING, source_name STRING, html STRING", [("https://h/1", "s", html), ("https://h/2", "s", "<title>安全验证</title>x"), ("https://h/3", "s", "<body>短</body>")]))
    one, two, three = sorted(r.collect(), key=lambda x: x["page_url"])
    assert one["title"] == "关于 投资" and one["wenhao"] == "浙发改〔2026〕12号" and one["page_date"] == "2026-03-04"
    assert one["content"].startswith("第一条加粗正文内容") and (one["doc_date"], one["issuing_authority"]) == ("2026-03-01", "浙江省财政厅")
    assert two["parse_error"] == G.BLOCKED and two["content"] == "" and three["parse_error"] == G.NO_CONTAINER


def test_pages_nested_as_deep_as_they_like(rows):
    deep = "<body><div id='content'>" + "<i>" * 5000 + "正文内容足够长的一段文字用于测试，嵌套很深也不出错。" + "<p>甲<b>乙</b> 丙</p><p>丁<br>戊</p></div></body>"
    out = {r["page_url"]: r for r in G.parse_pages(rows("page_url STRING, source_name STRING, html STRING", [("u1", "s", deep), ("u2", "s", "<![bad[x]]><body>y")])).collect()}
    assert out["u1"]["content"].split("\n") == ["正文内容足够长的一段文字用于测试，嵌套很深也不出错。", "甲乙丙", "丁", "戊"] and out["u1"]["parse_error"] == ""
    assert out["u2"]["parse_error"] == G.NO_CONTAINER


def test_document_number_forms_and_stage(rows):
    forms = ["发改〔2025〕1号", "发改[2025]1号", "发改［2025］１号", "发改【2025〕1号", "发改(2025)1号", "发改（2025） 1号"]
    got = rows("v STRING", [(f,) for f in forms]).select(A.normalize_doc_number(F.col("v")).alias("v")).distinct().collect()
    assert [r["v"] for r in got] == ["发改〔2025〕1号"]
    titles = {"关于某项目立项申请的批复": "建议书/立项", "关于某可行性研究报告的批复": "可行性研究", "关于某初步设计的批复": "初步设计", "关于某项目核准的批复": "核准/备案", "关于某事的函": "待确认"}
    out = rows("t STRING", [(t,) for t in titles]).select("t", A.stage(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in out} == titles


def test_alignment_merge_prefers_machine_value(rows):
    m = rows("doc_id INT, idx INT, name STRING, value STRING, status STRING, method STRING",
             [(1, 0, "a", "5米", "extracted", "human"), (1, 1, "b", "5米", "extracted", "rule"), (1, 2, "b", "6米", "extracted", "rule"), (2, 0, "a", "5米", "extracted", "rule")])
    d = rows("doc_id INT, name STRING, other STRING, decision STRING", [(1, "a", "b", "merge"), (2, "a", "b", "keep"), (2, "x", "y", "merge")])
    kept, history, refused = R.apply_alignment(m, d)
    assert {(r["doc_id"], r["name"], r["value"], r["method"]) for r in kept.collect()} == {(1, "b", "5米", "rule"), (1, "b", "6米", "rule"), (2, "a", "5米", "rule")}
    assert {(r["doc_id"], r["after"]) for r in history.collect()} == {(1, "b"), (2, R.NOT_MERGED)} and refused.count() == 1


def test_repeated_batch_is_idempotent(spark, rows, tmp_path):
    root = str(tmp_path / "ledger")
    for batch in (0, 1, 1):
        K.store_batch(root, batch, {"policies": rows("id INT", [(batch,)])})
    assert sorted(r["id"] for r in K.read_committed(spark, root, "policies").collect()) == [0, 1]


RULES = RuleSet(strong=("投资项目",), categories={"access": ("准入类", ("核准",))}, title=("项目",), doc_types={"formal": ("办法",)})


def test_ingest_stream_does_not_roll_back(spark, rows, tmp_path):
    page = lambda n: f"<body><h1>标题</h1><div id='content'>第{n}版 固定资产投资项目 项目核准 的正文内容足够长可以入库保存下来。</div></body>"
    schema, root = "page_id LONG, page_url STRING, source_name STRING, html STRING", str(tmp_path)
    # first version, its revision at the same URL, then the first text again: an old repost
    for i, n in enumerate((1, 2, 1)):
        rows(schema, [(i, "https://h/a", "s", page(n))]).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = T.read_stream(spark, f"{root}/in", rows(schema, []).schema)
        T.ingest_stream(stream, f"{root}/ledger", f"{root}/ck", RULES).awaitTermination()
    versions = K.read_committed(spark, f"{root}/ledger", "policies").collect()
    assert sorted(r["version"] for r in versions) == [1, 2]
    outcomes = {r["id"]: r["outcome"] for r in K.read_committed(spark, f"{root}/ledger", "fetch_records").collect()}
    assert outcomes == {0: "ingested", 1: "updated", 2: "duplicate"}


def test_lifecycle_stream_equals_replay(spark, rows, tmp_path):
    rnd, events = random.Random(5), []
    for i in range(300):
        events.append((i, rnd.randrange(7), rnd.choice(["discovered", "downloaded", "processed", "excluded", "failed"])))
    want = {}
    for _, key, status in events:
        now, steps, refused = want.get(key, (None, 0, 0))
        want[key] = (status, steps + 1, refused) if status in T.ALLOWED[now] else (now, steps, refused + 1)
    schema = "id LONG, fetch_id LONG, status STRING"
    for part in (events[:150], events[150:]):
        rows(schema, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows(schema, events[100:160]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # delivered again
    stream = T.read_stream(spark, str(tmp_path / "in"), rows(schema, []).schema, files_per_trigger=1)
    stream.writeStream.foreachBatch(T.lifecycle_batch(str(tmp_path / "state"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    for df in (T.lifecycle_state(spark, str(tmp_path / "state")), T.lifecycle(rows(schema, events))):
        assert {r["fetch_id"]: (r["status"], r["steps"], r["refused"]) for r in df.collect()} == want


def test_first_sightings_never_repeat(spark, rows, tmp_path):
    note = T.first_sightings_batch(str(tmp_path / "seen"))
    schema = "source_id LONG, page_url STRING, observed_at LONG"
    note(rows(schema, [(1, "a", 5), (1, "a", 3), (1, "b", 4)]), 0)
    note(rows(schema, [(1, "a", 99), (2, "a", 98)]), 1)
    note(rows(schema, [(1, "a", 99), (2, "a", 98)]), 1)  # the same batch again
    got = sorted((r["source_id"], r["page_url"], r["observed_at"]) for r in spark.read.parquet(str(tmp_path / "seen")).collect())
    assert got == [(1, "a", 3), (1, "b", 4), (2, "a", 98)]


def _page(title, body, container=True, number=""):
    inner = f"<div id='content'>{body}</div>" if container else f"<p>{body}</p>"
    return f"<html><head><meta name='文号' content='{number}'></head><body><h1>{title}</h1>{inner}</body></html>"


GOOD = "固定资产投资项目 项目核准 的正文内容足够长可以入库保存下来，"


def test_ingest_records_every_page(spark, rows, tmp_path):
    """Eight pages: an excluded first document of a key, a blocked page, a page without container, two pages of one URL, a repeat and a variant."""
    pages = [(1, "https://h/1", _page("关于召开会议的通知", "与投资无关的会务安排内容足够长的一段文字。", number="发改〔2025〕1号")),
             (2, "https://h/2", _page("关于项目核准的通知", GOOD + "二", number="发改〔2025〕1号")),
             (3, "https://h/3", "<html><head><title>安全验证</title></head><body>x</body></html>"),
             (4, "https://h/4", _page("关于项目核准的办法", GOOD + "四", container=False)),
             (5, "https://h/5", _page("关于项目核准的通知", GOOD + "二", number="发改〔2025〕1号")),
             (6, "https://h/6", _page("关于项目核准的通知", GOOD + "六", number="发改〔2025〕1号")),
             (7, "https://h/7", _page("关于项目备案的通知", GOOD + "七")), (8, "https://h/7", _page("关于项目备案的通知", GOOD + "八"))]
    files = [(2, 20, "a.pdf", "https://h/a.pdf", "f" * 64, "ok", "附件正文", ""), (5, 50, "a.pdf", "https://h/a.pdf", "f" * 64, "ok", "附件正文", "")]
    batch = rows("page_id LONG, page_url STRING, source_name STRING, html STRING", [(i, u, "s", h) for i, u, h in pages])
    T.ingest_batch(str(tmp_path / "l"), attachments=rows(T.ATTACHMENT, files))(batch, 0)
    fetched = {r["id"]: r for r in K.read_committed(spark, str(tmp_path / "l"), "fetch_records").collect()}
    assert {i: r["outcome"] for i, r in fetched.items()} == {1: "excluded", 2: "ingested", 3: "failed", 4: "ingested", 5: "duplicate", 6: "suspected_duplicate", 7: "ingested", 8: "updated"}
    assert fetched[1]["reason"] and fetched[3]["reason"] and fetched[4]["reason"]
    stored = {r["id"]: r for r in K.read_committed(spark, str(tmp_path / "l"), "policies").collect()}
    assert set(stored) == {2, 4, 6, 7, 8} and (stored[2]["version"], stored[8]["version"]) == (1, 2)
    assert stored[4]["todo_type"] == "material" and stored[6]["need_review"] and stored[6]["related_policy_key"] == stored[2]["policy_key"]
    assert (stored[8]["review_status"], stored[8]["need_review"]) == ("pending", True)
    links = {(r["policy_id"], r["page_url"]) for r in K.read_committed(spark, str(tmp_path / "l"), "policy_sources").collect()}
    assert links == {(2, "https://h/2"), (2, "https://h/5"), (4, "https://h/4"), (6, "https://h/6"), (7, "https://h/7"), (8, "https://h/7")}
    assert [r["policy_id"] for r in K.read_committed(spark, str(tmp_path / "l"), "attachments").collect()] == [2]


def test_fingerprint_is_one_rule_at_every_size(spark, rows):
    import hashlib
    import json
    sizes = (1000, 1001, 5000)
    atts = [(n, f"https://h/{i}", hashlib.sha256(f"{n}-{i}".encode()).hexdigest() if i % 10 else "") for n in sizes for i in range(n)]
    got = I.content_fingerprint(rows("id LONG, content STRING", [(n, " a b ") for n in sizes]), rows("policy_id LONG, url STRING, sha256 STRING", atts)).collect()
    for r in got:
        hashes = sorted({h or "missing:" + u for n, u, h in atts if n == r["id"]})
        assert r["content_sha256"] == hashlib.sha256(json.dumps(["ab", hashes], ensure_ascii=False).encode()).hexdigest()


def test_review_actions_of_one_instant(rows):
    p = rows("id LONG, category STRING, category_names STRING, review_status STRING, todo_type STRING, need_review INT, parse_requires_review INT, is_investment_policy STRING, material_gap BOOLEAN, incomplete BOOLEAN",
             [(1, "guide", "引导类", "pending", "review", 1, 0, "yes", False, False)])
    acts = rows("policy_id LONG, action STRING, categories ARRAY<STRING>, note STRING, created_at LONG",
                [(1, "adjust", [], "", 1), (1, "reject", None, "b", 2), (1, "confirm", None, "a", 2), (1, "confirm", None, "a", 2)])
    out, events, refused = RV.apply_review(p, acts)
    assert [r["review_status"] for r in out.collect()] == ["confirmed"] and [r["action"] for r in events.collect()] == ["confirm"]
    assert sorted(r["action"] for r in refused.collect()) == ["adjust", "confirm", "reject"]


def test_corpus_hash_counts_repeats(rows):
    """Rows that occur twice count twice, sums of parts merge, and a change is told by its range."""
    from docledger.operators import sampling as S
    of = lambda values: rows("id LONG, t STRING", values)
    x, y, z = (1, "x"), (2, None), (3, "")
    value = lambda values: S.corpus_hash(of(values)).first()
    assert value([x, x, y]) != value([z, z, y]) and value([x, y, x]) == value([x, x, y]) and value([x, y]) != value([x, x, y])
    whole, parts = S.range_sums(of([x, y, z, x]), "id"), S.merged_sums(S.range_sums(of([x, y]), "id"), S.range_sums(of([z, x]), "id"))
    assert S.changed_ranges(whole, parts).count() == 0 and S.range_tree(whole).where("range = ''").first() == S.range_tree(parts).where("range = ''").first()
    changed = S.changed_ranges(whole, S.range_sums(of([x, y, (3, "w")]), "id")).collect()
    assert sorted((r.n_before, r.n_after) for r in changed) == [(1, 1), (2, 1)]
