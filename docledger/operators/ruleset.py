"""The classification rule set as data."""
from __future__ import annotations

from dataclasses import dataclass, field


def norm_word(word: str) -> str:
    return word.lower().replace(" ", "").replace("\n", "")


@dataclass(frozen=True)
class RuleSet:
    exclude_hard: tuple = ()
    exclude_soft: tuple = ()
    policy_forms: tuple = ()
    operational: tuple = ()
    operational_override: tuple = ()
    strong: tuple = ()
    lifecycle: tuple = ()
    weak: tuple = ()
    title: tuple = ()
    weak_pending: int = 4
    min_strong: int = 2
    categories: dict = field(default_factory=dict)   # key: (name, words), in rule order
    boundary: tuple = ()                             # (title hint, note)
    doc_types: dict = field(default_factory=dict)    # draft / interpretation / formal / notice / approval: words

    def words(self, group: str) -> list[str]:
        return [norm_word(w) for w in getattr(self, group)]


# ---- fixed values: the published classification vocabulary (version 2026-09-11) ----
DEFAULT = RuleSet(
    exclude_hard=("比选", "中选", "遴选", "招募", "询价", "获奖", "公示", "公众参与", "研究承担单位"),
    exclude_soft=("会议", "座谈会", "人事", "任免", "公示名单", "采购公告", "招标公告", "中标", "成交结果", "解读", "一图读懂", "问答"),
    policy_forms=("办法", "规定", "条例", "意见", "决定", "方案", "规划", "目录", "细则", "指引", "导则", "制度"),
    operational=("差别化电价", "分时电价", "峰谷电价", "阶梯电价", "有序用电"),
    operational_override=("项目", "工程", "建设"),
    strong=("固定资产投资项目", "企业投资项目", "政府投资项目", "投资项目", "中央预算内投资", "专项债券", "重大项目", "重点工程",
            "工程建设项目", "投资管理", "投资计划", "项目审批", "项目核准", "项目备案", "项目单位", "项目资金", "专项资金", "项目申报",
            "项目库", "项目建设"),
    lifecycle=("项目储备", "可行性研究", "项目建议书", "投资决策", "核准目录", "审批权限", "投资项目管理", "用地预审", "规划选址",
               "土地报批", "用地指标", "土地供应", "环境影响评价", "节能审查", "能耗审查", "水土保持", "社会稳定风险", "安全评价",
               "施工许可", "施工图审查", "招标投标", "工程监理", "竣工验收", "项目资本金", "投资补助", "贷款贴息", "项目监管",
               "绩效评价", "后评价", "项目稽察"),
    weak=("投资", "项目", "审批", "核准", "备案", "申报", "建设"),
    title=("投资", "项目", "工程", "建设"),
    categories={
        "guide": ("引导类", ("发展规划", "规划", "产业导向", "导向目录", "产业目录", "区域布局", "布局指引", "鼓励发展", "支持方向",
                          "重点领域", "鼓励类", "优先发展", "投资方向", "发展导向", "产业政策")),
        "access": ("准入类", ("核准", "备案", "审批", "市场准入", "负面清单", "前置条件", "准入门槛", "节能审查", "能耗审查", "环评",
                           "环境影响评价", "许可", "核准目录", "投资项目管理")),
        "guarantee": ("保障类", ("用地", "土地", "要素保障", "用地保障", "资金支持", "信贷", "融资", "专项债券", "基金", "财政资金",
                              "能耗指标", "指标保障", "人才", "要素供给", "倾斜支持")),
        "incentive": ("激励约束类", ("奖补", "补贴", "奖励", "税收优惠", "减免", "价格支持", "上网电价", "绩效考核", "绩效评价", "后评价",
                                "监管", "检查", "惩戒", "责任追究", "约谈", "问责", "退出机制")),
    },
    boundary=(
        ("能耗双控", "规定项目能耗准入条件→准入类；安排能耗指标保障→保障类。须看条款实际作用。"),
        ("节能审查", "作为项目前置门槛→准入类；作为用能指标保障→保障类。"),
        ("中央预算内投资管理办法", "涉及资金分配（保障）与申报条件（准入），通常多标签。"),
        ("招投标", "工程建设项目的招投标监管属\"项目全过程监管\"，归激励约束类（任务书原文含\"项目全过程监管\"）。"),
        ("信用记录", "判断对象是\"项目\"而非\"市场主体\"。要求企业提供信用报告属企业资格管理，不构成项目准入门槛； "
                 "仅当条款直接针对项目申报、项目资金申请时收录。泛谈信用体系建设的判否。"),
        ("实施细则", "细则类文件多类混杂，允许多标签，不强行单标签。"),
    ),
    doc_types={
        "draft": ("征求意见稿", "公开征求意见"),
        "interpretation": ("解读", "问答", "一图读懂", "说明"),
        "formal": ("通知", "意见", "办法", "规划", "方案", "规定", "决定", "条例", "细则", "指引", "目录", "标准"),
        "notice": ("申报", "征集", "组织申报", "开展申报", "报送"),
        "approval": ("批复", "核准批复"),
    },
)
